"""Conclusions held against their clauses: cases for each word rule, and for how they decide a verdict."""

import pytest
from pyspark.sql import functions as F

from attestry.functions import text
from attestry.operators import fidelity, verdicts

PLACEMENT = "Title: Placement Statement: The criteria below shall be used to determine the preferred place. Requirements: - Alpha and Beta shall be assessed as the primary platform preference. - Other platforms shall apply when mandatory placement requirements or approved exceptions are present."
SPECIFIC = "Title: Approved Platform-Specific Deployments Statement: Workloads with an approved target platform or designated infrastructure model shall be treated as platform-specific. Requirements: - They shall not default to Alpha when a confirmed solution architecture requires a specific platform."
PUBLIC = "Title: Public Hosting Statement: Public hosting shall be considered for elastic workloads.\nRequirements:\n- It must comply with governance, cybersecurity, identity, data protection, network connectivity, resiliency, and regulatory requirements."
RESIDENCY = "Statement: Customer data shall not be stored outside the region. Storage outside the region is prohibited."
KEYS = "Statement: Keys must be generated and retired through a key management process. Rationale: Keys stored with data undermine encryption entirely. Requirements: Keys must be held in a hardware module."
SCHEMA = "verdict string, confidence double, evidence array<string>, best_score double, rationale string, cited_total int, cited_generated int, fabricated array<string>, conflicted boolean, clause_text string, figure_text string"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def guard(spark, verdict, rationale, clause, evidence, confidence=0.9):
    row = (verdict, confidence, evidence, 1.0, rationale, len(evidence), 0, [], False, clause, "")
    return verdicts.guard(spark.createDataFrame([row], SCHEMA)).first()["verdict_after"]


@pytest.mark.parametrize(
    "verdict,rationale,clause,evidence,want",
    [
        ("contradicts", "The design names Gamma, violating the clause's mandatory platform preference; it must use Alpha unless exceptions are approved.", PLACEMENT, ["Gamma hosts the services."], "needs_review"),
        ("contradicts", "it must use Alpha unless exceptions are approved", PLACEMENT, ["Gamma hosts the services."], "needs_review"),
        ("contradicts", "Records are replicated abroad; the design must use an in-region store.", RESIDENCY, ["The store replicates records abroad."], "contradicts"),
        ("covered", "The design specifies Gamma, thus meeting the clause's requirement for approved platform-specific deployment.", SPECIFIC, ["Gamma is the container platform."], "not_assessable"),
        ("covered", "Gamma is the target under board decision 2291.", SPECIFIC, ["Gamma is the approved target platform per architecture review board decision 2291."], "covered"),
        ("covered", "Zoning, firewalls and identity management imply compliance with governance and security requirements.", PUBLIC, ["Zoning separates the tiers.", "The directory provides identity."], "partial"),
        ("covered", "Governance, cybersecurity, identity, encryption, connectivity, resilience and regulatory duties are each documented.", PUBLIC, ["Governance, security and identity are described."], "covered"),
        ("absent", "Nothing mentions expansion triggers.", "Statement: Expansion shall follow agreed thresholds.", [], "absent"),
        ("absent", "Nothing addresses this.", PLACEMENT, [], "absent"),
        ("contradicts", "Readiness is not confirmed before final approval. It uses one unit.", "Statement: Readiness shall be shown.", ["Readiness is planned."], "not_assessable"),
        ("contradicts", "The portal uses one unit and lacks documented approval.", "Statement: Units shall be separate.", ["One unit holds the portal."], "contradicts"),
        ("covered", "Throughput is measured.", "Statement: throughput and capacity shall be sized.", ["Access is granted by the cipher authorization desk."], "needs_review"),
        ("covered", "The service logs.", "Statement: Services shall emit structured logs.", ["The app logs."], "covered"),
    ],
)
def test_guard_reads_the_clause(spark, verdict, rationale, clause, evidence, want):
    assert guard(spark, verdict, rationale, clause, evidence) == want
    assert guard(spark, verdict, rationale, clause, evidence, confidence=1.0) == want


def test_an_approved_catalogue_item_needs_no_record(spark):
    for clause in ("Images must be built from an approved base image", "Names use approved abbreviations only", "Periods are based on legal requirements. Certified copies are held.", "Integrations shall use the approved service catalogue."):
        assert not one(spark, fidelity.approval_missing(F.lit(clause), F.lit("We use the standard image."), F.lit("")))
    assert one(spark, fidelity.approval_missing(F.lit(SPECIFIC), F.lit("Gamma runs it."), F.lit("meets the approved platform requirement")))


def test_only_one_breath_is_a_list(spark):
    size = lambda t: len(one(spark, fidelity.enumerated_families(F.lit(t))))
    assert size(PUBLIC) == 7 and size(KEYS) < 3 and size("Governance applies. Security applies. Identity applies.") < 3
    assert set(one(spark, fidelity.families_missing(F.lit(PUBLIC), F.lit("Zoning. Identity by directory."), F.lit("")))) >= {"data protection", "resiliency", "regulatory"}


@pytest.mark.parametrize(
    "rationale,want",
    [
        ("The designs mention scaling but do not confirm that expansion is triggered by load.", True), ("Readiness is not confirmed before approval.", True), ("It includes ids but does not confirm alerts.", True),
        ("The hub uses direct access to the store.", False), ("It stores credentials in files with no documented manager.", False), ("The design runs one machine with no resilience.", False),
        ("It uses direct access. This risks exposure. The fix is not documented.", False), ("Direct access.", False), ("", False),
    ],
)
def test_a_silence_is_no_breach(spark, rationale, want):
    assert one(spark, fidelity.hedged_breach(F.lit(rationale))) is want


@pytest.mark.parametrize(
    "verdict,confidence,rationale,clause,want,part",
    [
        ("Partial ", 2.0, "Messages are dropped after retries.", "Statement: messages", "contradicts", "dropped"),
        ("not_assessable", 0.4, "No record is quoted. The design uses layers, aligning with the principle.", "Statement: fit", "covered", "layers"),
        ("partial", 0.4, "A part is unmet. Add a retry, which complies with the clause.", "Statement: fit", "partial", "Add"),
        ("not_assessable", 0.4, "No approval is on record.", "Statement: Data in transit shall use tls.", "needs_review", "approval"),
        ("not_assessable", 0.4, "No approval is on record.", "Statement: tls needs an approval.", "not_assessable", "approval"),
        ("partial", None, "Two families are met; regulatory requirements are not addressed.", "Statement: encryption and identity.", "partial", "requirement for regulatory"),
        ("odd", -1.0, None, None, "needs_review", ""),
    ],
)
def test_answers_put_right(spark, verdict, confidence, rationale, clause, want, part):
    row = spark.createDataFrame([(verdict, confidence, rationale, clause)], "verdict string, confidence double, rationale string, clause_text string")
    got = verdicts.normalise_answer(row).first()
    assert got["verdict"] == want and part in got["rationale"] and 0 <= got["confidence"] <= 1


@pytest.mark.parametrize(
    "parsed,requirements,statement,title,want",
    [
        (["should", "must"], ["Records are retained", "Logs are archived"], None, None, ("must", "parsed")), (["may", "must"], ["Records are retained"], "Retention of records", None, ("unstated", "unstated")), ([""], ["a"], None, None, ("unstated", "unstated")),
        ([], ["Records shall be kept for seven years"], None, None, ("must", "read")), ([], [], "Logs should be retained", None, ("should", "read")), ([], ["External platforms must be justified"], "Designs should leverage native capabilities", None, ("should", "read")),
        ([], ["Records shall be kept"], "Data retention", None, ("must", "read")), ([], ["Data may not leave the region"], None, None, ("must", "read")), ([], ["Keys shall not be shared"], None, None, ("must", "read")), ([], ["Export is prohibited"], None, None, ("must", "read")),
        ([], ["Retention is described"], "Data retention", None, ("unstated", "unstated")), ([], ["Mustard supply is seasonal"], None, None, ("unstated", "unstated")), ([], ["Flows require review"], None, None, ("must", "read")), ([], ["It runs on machines"], None, "Services may be shared", ("may", "read")),
    ],
)
def test_obligation(spark, parsed, requirements, statement, title, want):
    row = spark.createDataFrame([(parsed, requirements, statement, title)], "p array<string>, r array<string>, s string, t string")
    assert tuple(row.select(text.obligation(F.col("p"), F.col("r"), F.col("s"), F.col("t")).alias("x")).first()["x"]) == want


def test_sharpening(spark):
    rows = [
        ("The portal must encrypt every stored record with managed keys", ["c1"], None), ("The portal must encrypt", ["c1"], "too short"), ("The portal encrypts every stored record with keys", ["c1"], "states no duty"), ("The portal must use robust keys for every record", ["c1"], "vague"),
        ("Records must be kept for at least seven years", ["c1"], "exists already"), ("Field Portal records must be held in one region", ["c1"], "names the design"), ("Every record must be held in one region", [], "rests on nothing"), ("x must " * 60, ["c1"], "too long"),
    ]
    df = spark.createDataFrame([(a, b, ["records must be kept, for at least seven years"], "Field Portal › 4 Storage") for a, b, _ in rows], "line string, basis array<string>, existing array<string>, design_name string")
    assert [r["reason"] for r in verdicts.sharpening(df).collect()] == [w for _, _, w in rows]


def test_normalise_reads_compatibility_forms(spark):
    assert one(spark, text.normalise(F.lit("“ﬁle” Ｆｕｌｌ—ﬂow"))) == "file full flow"
    assert [one(spark, text.reference(F.lit(n))) for n in (7, 9999, 10000, 123456)] == ["AR-0007", "AR-9999", "AR-10000", "AR-123456"]
