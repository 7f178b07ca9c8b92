"""Listings, groups, evidence cards, second readings, advice, table shapes and page mapping on literal rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from attestry.functions import text
from attestry.operators import analytics, evidence, search, structure


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_project_listing(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    projects = spark.createDataFrame([("p", "One"), ("q", "Two")], "project_id string, name string")
    documents = spark.createDataFrame([("d", "p", "ready", day(3)), ("e", "p", "parsing", day(5))], "document_id string, project_id string, status string, updated_at timestamp")
    runs = spark.createDataFrame(
        [("r1", "d", None, "complete", day(1)), ("r2", "d", None, "complete", day(2)), ("r3", "d", None, "failed", day(4)), ("r4", None, "p", "complete", day(3)), ("r5", "x", None, "complete", day(3))],
        "run_id string, document_id string, project_id string, state string, started_at timestamp",
    )
    findings = spark.createDataFrame([("r1", "covered", "pending"), ("r2", "covered", "pending"), ("r2", "absent", "pending"), ("r2", "partial", "accepted"), ("r4", "partial", "pending")], "run_id string, verdict string, reviewer_state string")
    got = rows(analytics.project_listing(projects, documents, runs, findings), "project_id", "designs", "ready", "runs", "unreviewed", "last_activity")
    assert got == [("p", 2, 1, 4, 2, day(5)), ("q", 0, 0, 0, 0, None)]
    snap = {r["run_id"]: r for r in analytics.outcome_snapshot(findings, ["covered", "partial"]).collect()}
    assert snap["r2"]["verdicts"] == {"covered": 1, "partial": 1} and (snap["r2"]["unreviewed"], snap["r2"]["total"]) == (1, 2)


def test_the_first_claim_wins(spark):
    groups = spark.createDataFrame([("r", 1, "a  b", [1, 2, 2]), ("r", 2, "c", [2, 3]), ("r", 3, "d", [3, 4, 2]), ("r", 4, " ", [5, 6]), ("r", 5, "e", [5, 6])], "run_id string, place int, label string, findings array<int>")
    assert rows(analytics.claimed_groups(groups), "place", "label", "findings") == [(1, "a b", [1, 2]), (3, "d", [3, 4]), (5, "e", [5, 6])]


def test_backfill_and_joins(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (3, None)], "id int, v string")
    b = spark.createDataFrame([(1, "one"), (2, "two")], "id int, v string")
    assert rows(analytics.backfill(a, b, ["id"], "v"), "id", "v")[:2] == [(1, "one"), (2, "x")]
    s = spark.createDataFrame([("s1", "d"), ("s2", "d"), ("s3", "e")], "section_id string, document_id string")
    c = spark.createDataFrame([("s1",), ("s1",), ("s2",)], "section_id string")
    assert rows(analytics.clauses_per_document(s, c), "document_id", "clauses") == [("d", 3), ("e", 0)]
    one = spark.range(1)
    starts = lambda t: one.select(text.title_starts(F.lit(t), F.lit("AR-0001")).alias("x")).first()["x"]
    assert starts("AR-0001 plan") and starts("AR 0001 plan") and not starts("AR-00012 plan")
    q = one.select(search.clause_query(F.lit("Keys"), F.lit(None).cast("string"), F.array(F.lit("must rotate"), F.lit(" "))).alias("q")).first()["q"]
    assert q == "Keys\nmust rotate"


def test_tables_for_evidence(spark):
    chunks = spark.createDataFrame([("c1", "table", "t1", "x"), ("c2", "section", "s1", "alpha beta gamma"), ("c3", "clause", "k1", "alpha beta gamma"), ("c4", "section", "s2", "delta epsilon"), ("c5", "table", "gone", "x")], "chunk_id string, source_kind string, source_id string, text string")
    clauses = spark.createDataFrame([("k1", "s1")], "clause_id string, section_id string")
    tables = spark.createDataFrame([("t1", "s1", ["alpha beta", "gamma"]), ("t2", "s1", ["other words"]), ("t3", "s2", ["delta epsilon"]), ("t4", "s2", ["delta epsilon zeta"])], "table_id string, section_id string, cells array<string>")
    assert rows(evidence.tables_for(chunks, clauses, tables), "chunk_id", "table_id") == [("c1", "t1"), ("c2", "t1"), ("c3", "t1")]


def test_evidence_cards(spark):
    many = " ".join(f"word{i}" for i in range(20))
    ev = spark.createDataFrame(
        [
            ("f", 0, "d", "t1", [2], None, "cells", ["alpha beta", "gamma"]), ("f", 1, "d", None, [], None, "alpha beta gamma", []), ("f", 2, "d", None, [], None, many, []), ("f", 3, "d", None, [], None, f"{many} longer", []),
            ("f", 4, "d", "t1", [0], None, "cells", ["alpha beta", "gamma"]), ("f", 5, "e", None, [], None, many, []), ("f", 6, "d", None, [], "g", many, []),
        ],
        "finding_id string, at int, document_id string, table_id string, rows array<int>, figure_id string, excerpt string, cells array<string>",
    )
    got = [(r["document_id"], r["table_id"], r["rows"], r["excerpt"][-6:]) for r in evidence.fold_evidence(ev).orderBy("place").collect()]
    assert got == [("d", "t1", [0, 2], "cells"), ("d", None, [], "longer"), ("e", None, [], "word19"), ("d", None, [], "word19")]
    order = spark.createDataFrame([("f", 0, None, "Other", "Field Portal fails"), ("f", 1, None, "Field Portal", "Field Portal fails"), ("f", 2, "q", "Other", "Field Portal fails")], "finding_id string, at int, breach_quote string, document_title string, rationale string")
    assert rows(evidence.evidence_order(order), "place", "at") == [(1, 2), (2, 1), (3, 0)]


def test_second_reading(spark):
    said = "The store is encrypted with managed keys."
    f = [("r", "d", f"c{i:02}", i, "absent" if i < 30 else "partial", 0.8, "It is not specified." if i != 30 else "It differs.") for i in range(32)]
    findings = spark.createDataFrame(f, "run_id string, design string, clause_id string, clause_ordinal int, verdict string, confidence double, rationale string")
    batches = evidence.to_confirm(findings).cache()
    assert batches.count() == 31 and batches.agg(F.max("batch"), F.max("number")).first() == (1, 25)
    answers = spark.createDataFrame(
        [("r", "d", "doc", 0, 1, "Covered ", "store is encrypted", 1, "yes"), ("r", "d", "doc", 0, 2, "covered", "invented words", 1, "no"), ("r", "d", "doc", 0, 3, "absent", "store is encrypted", 1, "no"), ("r", "d", "doc", 7, 1, "covered", "store is encrypted", 1, "no")],
        "run_id string, design string, document_id string, batch int, number int, verdict string, quote string, page int, rationale string",
    )
    pages = spark.createDataFrame([("doc", 1, said)], "document_id string, page int, text string")
    got = evidence.adopt_confirmations(findings, batches, answers, pages)
    assert rows(got.filter("confirmed"), "clause_id", "verdict", "confidence", "rationale") == [("c00", "covered", 0.7, "yes")] and got.count() == 32


def test_advice(spark):
    sections = spark.createDataFrame([("d", 1, "The gateway drops messages after retries."), ("d", 2, "The broker keeps messages for a day. The portal calls the broker.")], "document_id string, section int, text string")
    rec = "Route failed messages to a dead letter queue"
    items = [
        ("a1", "Queue failures", rec, 1, "gateway", "improve", "drops messages after retries", ["4.1", "9.9"]), ("a2", "Queue  failures!", rec, 1, "gateway", "improve", "drops messages", []), ("a3", "Moved", rec, 1, "broker", "improve", "keeps messages for a day", []),
        ("a4", "No quote", rec, 1, "gateway", "improve", None, []), ("a5", "Invented", rec, 1, "gateway", "improve", "never written", []), ("a6", "Filler", "Follow industry best practices for all of it", 1, "gateway", "add", None, []),
        ("a7", "Unknown", rec, 9, "gateway", "add", None, []), ("a8", "Nowhere", rec, 1, "mainframe", "add", None, []), ("a9", "", rec, 1, "gateway", "add", None, []), ("b1", "Add", rec, 1, "portal", "add", None, []),
    ]
    advice = spark.createDataFrame([("d", *x) for x in items], "document_id string, advice_id string, title string, recommendation string, section int, component string, kind string, quote string, clauses array<string>")
    got = {r["advice_id"]: (r["reason"], r["section"], r["clauses"]) for r in evidence.check_advice(advice, sections, spark.createDataFrame([("d", "4.1")], "document_id string, ref string")).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a1": None, "a2": "duplicate", "a3": None, "a4": "missing quote", "a5": "quote not found", "a6": "generic", "a7": "unknown section", "a8": "unanchored", "a9": "empty", "b1": None}
    assert got["a1"][2] == ["4.1"] and got["a3"][1] == got["b1"][1] == 2


def test_table_shapes(spark):
    grids = {
        "plain": [["Name", "Value"], ["a", "1"], ["b", ""]],
        "wrapped": [["How", "Who"], ["it is met", None], [None, "x"], [None, "y"]],
        "header": [["App", "Owner", ""], ["", "", "hosted"], ["a", "o", ""], ["b", "p", ""]],
        "merged": [["Area", None, "Note"], ["x", None, "n"], ["y", None, "m"]],
        "repeats": [["Area", "", "Note"], ["x", "x", "n"], ["y", "y", "m"]],
        "comments": [["", "Comments"], ["x", ""], ["y", ""]],
        "drawing": [["only", ""], ["a", ""], ["b", ""]],
        "same": [["A", "A"], ["1", "2"]],
        "short": [["A", "B", "C"], ["1", "2"]],
    }
    df = spark.createDataFrame([(t, i, r) for t, g in grids.items() for i, r in enumerate(g)], "table_id string, row int, cells array<string>")
    got = {r["table_id"]: (r["columns"], r["rows"]) for r in structure.shape_tables(df).collect()}
    assert got["plain"] == (["Name", "Value"], [["a", "1"], ["b", None]])
    assert got["header"] == (["App", "Owner", "hosted"], [["a", "o", None], ["b", "p", None]])
    assert got["merged"] == got["repeats"] == (["Area", "Note"], [["x", "n"], ["y", "m"]])
    assert "comments" not in got and "drawing" not in got and got["same"] == (["A", "A (2)"], [["1", "2"]]) and got["short"][1] == [["1", "2", None]]


def test_pages_never_fall(spark):
    said = ["Introduction to the whole", "A paragraph that wraps over lines of print", "tiny", "Introduction to the whole", "Nothing like it is printed", "The last paragraph of all"]
    lines = spark.createDataFrame([("d", i, t) for i, t in enumerate(said)], "document_id string, ordinal int, text string")
    printed = spark.createDataFrame([("d", 1, "Introduction to the whole"), ("d", 2, "A paragraph that wraps"), ("d", 2, "over lines of print"), ("d", 4, "The last paragraph of all"), ("d", 3, "Introduction to the whole")], "document_id string, page int, text string")
    assert [r["page"] for r in structure.pages_in_order(lines, printed).orderBy("ordinal").collect()] == [1, 2, 2, 3, 3, 4]


def test_outline_sections_and_content(spark):
    lines = spark.createDataFrame([("d", 0, "front", None), ("d", 1, "Scope", 1), ("d", 2, "All of it.", None), ("d", 3, "Detail", 2), ("e", 0, "just text", None)], "document_id string, ordinal int, text string, depth int")
    got = structure.outline_sections(lines)
    assert rows(got, "document_id", "section", "first", "last", "depth", "title") == [("d", 0, 0, 0, 1, "Front matter"), ("d", 1, 1, 2, 1, "Scope"), ("d", 2, 3, 3, 2, "Detail"), ("e", 0, 0, 0, 1, "Document")]
    clauses = spark.createDataFrame([("d", 1, 1, "k1", "must", None), ("d", 1, 2, "k2", "old", "k1")], "document_id string, section int, ordinal int, clause_id string, statement string, superseded_by_id string")
    tables = spark.createDataFrame([("d", 1, 1, "t1")], "document_id string, section int, ordinal int, table_id string")
    whole = {(r["document_id"], r["section"]): r for r in structure.section_content(got, lines.drop("depth"), clauses, tables).collect()}
    assert [x["text"] for x in whole["d", 1]["lines"]] == ["Scope", "All of it."] and [x["clause_id"] for x in whole["d", 1]["clauses"]] == ["k1"] and whole["e", 0]["tables"] is None


def test_reading_statistics(spark):
    lines = spark.createDataFrame([("d", i) for i in range(6)], "document_id string, ordinal int")
    members = spark.createDataFrame([("d", "r1", "statement", 0), ("d", "r1", "requirements", 1), ("d", "r2", "statement", 2), ("d", "r2", "requirements", 99)], "document_id string, rule_id string, part string, ordinal int")
    labels = spark.createDataFrame([("d", 3, "heading"), ("d", 4, "heading"), ("d", 2, "note")], "document_id string, ordinal int, label string")
    checked = spark.createDataFrame([("d", 4, 1)], "document_id string, named int, dropped int")
    r = evidence.reading_statistics(lines, members, labels, checked).first()
    assert (r["lines"], r["covered"], r["in_rules"], r["rules"], r["requirements"], r["labelled"], r["numbers_checked"], r["numbers_invalid"]) == (6, 5, 3, 2, 2, {"heading": 2, "note": 1}, 4, 1)


def test_answers_quotes_are_all_checked(spark):
    said = [f"Sentence number {i} stands here." for i in range(9)]
    quotes = spark.createDataFrame([("a", [" ".join(said), "An invented one."])], "answer_id string, quotes array<string>")
    parts = evidence.split_quotes(quotes)
    assert parts.count() == 10


def test_scopes(spark):
    df = spark.createDataFrame([("o", "d", None), ("o", "e", "high"), ("p", "d", None)], "organisation_id string, document_id string, sensitivity string")
    assert search.scoped(df).count() == 3 and search.scoped(df, "o").count() == 2 and search.scoped(df, "o", ["e"]).count() == 1
    assert search.scoped(df, sensitivities=["low"]).count() == 2 and search.scoped(df, documents=spark.createDataFrame([("d",), ("d",)], "document_id string")).count() == 2


def test_evidence_windows_respect_the_scope(spark):
    body = lambda i: " ".join(f"term{i}x{k}" for k in range(25))
    chunks = spark.createDataFrame(
        [(i, "ab"[i % 2], i % 4, "o" if i < 18 else "p", None, "figure" if i == 17 else "section", "h", "h", 1, f"shared {body(i if i != 6 else 2)}") for i in range(20)],
        "chunk_id long, design string, document_id long, organisation_id string, source_id string, source_kind string, heading_path string, heading string, page int, text string",
    )
    vectors = chunks.select("chunk_id", F.array(F.cos(F.col("chunk_id") / 10), F.sin(F.col("chunk_id") / 10)).alias("vector"))
    queries = spark.createDataFrame([(1, [1.0, 0.0], ["shared", "term2x1"])], "query_id long, query array<double>, terms array<string>")
    got = search.evidence_windows(queries, chunks, vectors, limit=3, organisation="o").orderBy("place").collect()
    ids = [r["chunk_id"] for r in got]
    assert len(ids) == 6 and [r["design"] for r in got] == list("ababab") and max(ids) < 18
    assert 2 in ids and 6 not in ids  # the same words in the same document
    assert 17 in ids  # a figure on the page keeps a place


def test_regions_ranges_and_contents(spark):
    lines = spark.createDataFrame([("d", 1, 0, 0.0, 0.0, 20.0, 100.0, "x"), ("d", 1, 1, 8.0, 0.0, 40.0, 100.0, "y"), ("d", 2, 2, 12.0, 0.0, 18.0, 100.0, "z")], "document_id string, page int, ordinal int, y double, x0 double, y1 double, x1 double, text string")
    regions = spark.createDataFrame([("d", 1, 9.0, 15.0, 0.0, 100.0)], "document_id string, page int, top double, bottom double, left double, right double")
    assert rows(structure.in_regions(lines, regions), "ordinal") == [(0,)]
    points = spark.createDataFrame([("d", i) for i in range(6)], "document_id string, ordinal int")
    ranges = spark.createDataFrame([("d", 1, 4, "note")], "document_id string, from_at int, to_at int, label string")
    assert rows(structure.in_ranges(points, ranges, "document_id", "ordinal", points.filter("ordinal = 2")), "ordinal") == [(1,), (3,), (4,)]
    toc = spark.createDataFrame([("d", 1, f"Part {i} ........ {i + 3}") for i in range(5)] + [("d", 2, "Part 1 ........ 4")], "document_id string, page int, text string")
    assert rows(structure.contents_pages(toc), "page") == [(1,)]
    checked = spark.createDataFrame([("d", "matched"), ("d", "drifted"), ("d", "missing"), ("d", "unexpected")], "document_id string, state string")
    assert round(structure.contents_coverage(checked).first()["coverage"], 3) == 0.667


def test_counts_and_priorities(spark):
    people = spark.createDataFrame([("o", "invited"), ("o", "blocked"), ("o", "invited"), ("p", "member")], "org string, status string")
    assert rows(analytics.roster_counts(people, "org", ["invited", "blocked"]), "org", "invited", "blocked", "people") == [("o", 2, 1, 3), ("p", 0, 0, 1)]
    facts = spark.createDataFrame([("a", 1.5, "2024-01-01"), ("b", 2.0, "2024-01-02"), ("a", 1.0, "2024-01-01")], "who string, spent double, at string")
    assert tuple(analytics.platform_totals(facts, "spent", "who").first()) == (4.5, 3, 2, "2024-01-02")
    s = spark.createDataFrame([("d", i, p) for i, p in enumerate(["low", "high", "odd", "high", "medium"])], "document_id string, at int, priority string")
    got = analytics.by_priority(s, "document_id", ["high", "medium", "low"], most=3).orderBy("place").collect()
    assert [(r["at"], r["more"]) for r in got] == [(1, 2), (3, 2), (4, 2)]


def test_earlier_twins_against_all_pairs(spark):
    import random

    from attestry.operators import search

    rng = random.Random(4)
    base = [[f"w{rng.randrange(60)}" for _ in range(rng.randrange(5, 60))] for _ in range(25)]
    texts = base + [[w for w in b if rng.random() > 0.06] + [f"w{rng.randrange(60)}"] * (k % 3) for k, b in enumerate(base)] + base[:3]
    said = [(k, " ".join(t)) for k, t in enumerate(texts)]
    words = {k: {w for w in t.split() if len(w) >= 3} for k, t in said}
    held = lambda a, b: len(words[a] & words[b]) >= 0.9 * len(words[b])
    want = {b: min(a for a in range(b) if held(a, b)) for b, w in words.items() if len(w) >= 20 and any(held(a, b) for a in range(b))}
    got = search.earlier_twins(spark.createDataFrame(said, "id long, text string")).collect()
    assert {r["id"]: r["twin"] for r in got} == want and len(want) > 10


@pytest.mark.parametrize("more", [0, 4, 100])
def test_twins_share_enough_rare_words(spark, monkeypatch, more):
    """Texts that meet by one rare word only are no pair that is verified; any number of further words gives the same twins."""
    monkeypatch.setattr(search, "MORE", more)
    said = [(k, " ".join(f"w{k}x{j}" for j in range(30)) + f" rare{k // 2} shared") for k in range(12)]
    said += [(20, said[3][1] + " one two three"), (21, " ".join(said[4][1].split()[:28])), (22, " ".join(said[5][1].split()[3:]) + " a1b c2d e3f g4h")]
    got = search.earlier_twins(spark.createDataFrame(said, "id long, text string"))
    assert {r["id"]: r["twin"] for r in got.collect()} == {20: 3, 21: 4}
    assert "need" in got._jdf.queryExecution().optimizedPlan().toString()
