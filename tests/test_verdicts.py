"""One case for every arm of the guards; order is part of the contract."""

import pytest
from pyspark.sql import functions as F

from attestry.operators import verdicts

GOOD = dict(verdict="covered", confidence=0.9, evidence=["Storage is encrypted by default"], best_score=0.03, rationale="Storage is encrypted", cited_total=1, cited_generated=0, fabricated=[], conflicted=False, clause_text="Storage is to be encrypted", figure_text="")
SCHEMA = "verdict string, confidence double, evidence array<string>, best_score double, rationale string, cited_total int, cited_generated int, fabricated array<string>, conflicted boolean, clause_text string, figure_text string"


@pytest.mark.parametrize(
    "change,want",
    [
        ({}, ("covered", None)),
        ({"evidence": []}, ("needs_review", "cites nothing")),
        ({"cited_generated": 1}, ("needs_review", "figures only")),
        ({"cited_generated": 1, "figure_text": "storage encrypted"}, ("covered", None)),
        ({"verdict": "contradicts", "cited_generated": 1, "figure_text": "storage encrypted"}, ("needs_review", "figures only")),
        ({"fabricated": ["d1"]}, ("needs_review", "decision not on record")),
        ({"conflicted": True}, ("needs_review", "decisions disagree")),
        ({"conflicted": True, "verdict": "partial"}, ("partial", None)),
        ({"verdict": "contradicts", "rationale": "It must use keys", "clause_text": "Keys are the preferred storage"}, ("needs_review", "overreach")),
        ({"verdict": "contradicts", "rationale": "It is not documented"}, ("not_assessable", "hedged breach")),
        ({"clause_text": "Storage is an approved workload"}, ("not_assessable", "approval missing")),
        ({"clause_text": "Storage encryption, governance and monitoring"}, ("partial", "families missing")),
        ({"clause_text": "Latency and performance budgets", "evidence": ["The cipher and access list"]}, ("needs_review", "subject mismatch")),
        ({"verdict": "absent", "evidence": [], "best_score": 0.01}, ("needs_review", "weak retrieval")),
        ({"verdict": "absent", "evidence": [], "confidence": 0.5}, ("needs_review", "low confidence")),
        ({"verdict": "absent", "evidence": []}, ("absent", None)),
    ],
)
def test_guard(spark, change, want):
    row = GOOD | change
    got = verdicts.guard(spark.createDataFrame([tuple(row[c.split()[0]] for c in SCHEMA.split(", "))], SCHEMA)).first()
    assert (got["verdict_after"], got["why"]) == want


@pytest.mark.parametrize("counts,sig,unsettled,want", [((1, 0), "significant", 0, "board"), ((1, 0), "not_significant", 0, "architect"), ((0, 0), "significant", 0, "architect"), ((0, 0), "not_significant", 1, "architect"), ((0, 0), None, 0, "architect"), ((0, 0), "not_significant", 0, "auto_approve")])
def test_next_step(spark, counts, sig, unsettled, want):
    x = verdicts.next_step(F.lit(counts[0]), F.lit(counts[1]), F.lit(sig).cast("string"), F.lit(unsettled))
    assert spark.range(1).select(x).first()[0] == want


def test_brief_severity(spark):
    b = lambda v, o: spark.range(1).select(verdicts.brief_severity(F.lit(v), F.lit(o)).alias("x")).first()["x"]
    assert tuple(b("partial", "must")) == ("high", True) and tuple(b("absent", "unstated")) == ("low", False) and tuple(b("absent", "may")) == ("medium", True) and b("covered", "must") is None


def test_unanswered_never_triggers(spark):
    answers = spark.createDataFrame([("r", "2024-01-31", "cost", None, None), ("r", "2024-01-31", "systems", None, ["a", " ", "b"])], "request_id string, as_of string, field string, value string, items array<string>")
    rules = spark.createDataFrame([("c", True, "cost", "at_least", "1", None, "t"), ("n", True, "systems", "count_at_least", "3", None, "t"), ("m", True, "systems", "count_at_least", "2", None, "t"), ("u", True, "cost", "odd", "1", None, "t")], "category string, active boolean, field string, operator string, value string, items array<string>, text string")
    got = {r["category"]: r["triggered"] for r in verdicts.significance(answers, rules).collect()}
    assert got == {"c": False, "n": False, "m": True, "u": False}


def test_risk_without_a_word_is_not_assessed(spark):
    s = spark.createDataFrame([("security", ["a", "b"]), ("cost", ["c"])], "dimension string, clauses array<string>")
    f = spark.createDataFrame([("a", "partial", "must"), ("b", "contradicts", "must"), ("c", "covered", "must")], "clause_id string, verdict string, obligation string")
    assert {r["dimension"]: r["risk"] for r in verdicts.risk(s, f, ["security", "cost", "time"]).collect()} == {"security": "critical", "cost": "not assessed", "time": "not assessed"}


def test_project_verdict_order(spark):
    f = spark.createDataFrame([("a", "covered"), ("a", "contradicts"), ("b", "absent"), ("b", "partial"), ("c", "strange")], "clause_id string, verdict string")
    assert {r["clause_id"]: r["verdict"] for r in verdicts.project_verdict(f).collect()} == {"a": "contradicts", "b": "partial", "c": "absent"}
