"""Gaps: phrases, lines, other sections, cited passages, vague words, one a section."""

import sys
import unicodedata

from attestry.operators import coverage, evidence

SECTIONS = {
    3: ["## Tools in use", "Area | Tool", "Review of code | Gerrit, Sonar, and a nightly lint run", "Build | Bazel, Make, Ninja,", "Packer", "Secrets | Locker", "Rollout | Argo", "- Watching |", "Grafana"],
    4: ["Pipeline", "On site", "Unit tests(short)", "Image store", "Signed image", "Rollout", "Scan of images", "Sign in", "Audit trail"],
    6: ["Way of working", "3 Weeks", "The ﬁrst team signs every image before it is rolled out. Keys are kept for ten years."],
    7: ["The same words stand in two of the sections", "Nothing else of note"],
    8: ["The same words stand in two of the sections", ""],
}
WHAT = "The design does not say who looks after this"


def placed(spark, gaps, cited=()):
    gaps = [("d", k, s, q, w) for k, (s, q, w) in enumerate((*g, WHAT)[:3] for g in gaps)]
    rows = spark.createDataFrame(gaps, "document_id string, gap_id int, section int, quote string, what string")
    sections = spark.createDataFrame([("d", n, lines) for n, lines in SECTIONS.items()], "document_id string, section int, lines array<string>")
    pages = spark.createDataFrame([("d", n, "\n".join(lines)) for n, lines in SECTIONS.items()], "document_id string, page int, text string")
    passages = spark.createDataFrame([("d", c) for c in cited], "document_id string, passage string")
    out = coverage.place_gaps(rows, sections, pages, passages).collect()
    assert len(out) == len(gaps)
    return [(r["section"], r["quote"], r["by_lines"], r["reason"]) for r in sorted(out, key=lambda r: r["gap_id"])]


def test_quotes_by_lines(spark):
    assert placed(spark, [(3, "Secrets | Locker")]) == [(3, "Secrets | Locker", True, None)]
    labels = "Unit tests(short)\nImage store\nScan of images\nSign in\nAudit trail"
    assert placed(spark, [(4, labels), (3, "Watching - Grafana")]) == [(4, labels.replace("\n", " · "), True, None), (3, "Watching | · Grafana", True, None)]
    assert placed(spark, [(4, "Audit trail\nOn site")]) == [(4, "On site · Audit trail", True, None)]


def test_quotes_refused(spark):
    refused = [(3, "Secrets | Locker\nSecrets | Vault"), (3, "Secrets"), (6, "3 Weeks"), (3, "Area | Too"), (4, "Secrets | Locker"), (3, ""), (3, None), (3, "words that the design never says at all")]
    assert {r[1:] for r in placed(spark, refused)} == {(None, False, "unverified")}
    assert placed(spark, [(9, "Secrets | Locker")]) == [(9, None, False, "unknownSection")]


def test_phrases_go_where_they_stand(spark):
    long = "Review of code | Gerrit, Sonar, and a nightly lint run"
    assert placed(spark, [(3, long)]) == [(3, long, False, None)]
    assert placed(spark, [(4, long)]) == [(3, long, False, None)]  # in just one other section
    split = "Build | Bazel, Make, Ninja, Packer"
    assert placed(spark, [(3, split)]) == [(3, split, False, None)]
    assert placed(spark, [(3, "The same words stand in two of the sections")])[0][3] == "outsideSection"
    assert placed(spark, [(7, "The same words stand in two of the sections")])[0][0::3] == (7, None)
    two = "Nobody says this sentence at all. Keys are kept for ten years."
    assert placed(spark, [(6, two)]) == [(6, "Keys are kept for ten years.", False, None)]
    assert placed(spark, [(6, "the first team … before it is rolled out")])[0][3] is None  # a ligature, an ellipsis


def test_cited_vague_and_repeated(spark):
    years = "Keys are kept for ten years"
    assert placed(spark, [(6, years)], [years + "."])[0][3] == "alreadyJudged"
    assert placed(spark, [(6, years)], ["ten years"])[0][3] == "alreadyJudged"
    assert placed(spark, [(6, years)], ["kept", None, ""])[0][3] == "alreadyJudged"
    assert placed(spark, [(6, years)], [f"{years} " + "and so on " * 20])[0][3] is None
    assert placed(spark, [(6, years, "Diagram of the key store and its clients")])[0][3] == "vague"
    assert placed(spark, [(6, years, "Too short")])[0][3] == "vague"
    got = placed(spark, [(6, years, "Too short"), (6, years), (6, "invented words that are not there"), (4, "3 Weeks of it"), (3, "Secrets | Locker"), (3, "Rollout | Argo")])
    assert [r[3] for r in got] == ["vague", None, "repeated", "unverified", None, "repeated"]


def test_only_the_first_gaps_are_read(spark):
    rows = spark.createDataFrame([("d", k, 6, "Keys are kept for ten years", WHAT) for k in range(60)], "document_id string, gap_id int, section int, quote string, what string")
    sections = spark.createDataFrame([("d", 6, SECTIONS[6])], "document_id string, section int, lines array<string>")
    pages = spark.createDataFrame([("d", 1, "\n".join(SECTIONS[6]))], "document_id string, page int, text string")
    out = coverage.place_gaps(rows, sections, pages, spark.createDataFrame([], "document_id string, passage string"))
    assert out.count() == coverage.MOST_GAPS and out.filter("reason is null").count() == 1


def test_compatibility_forms(spark):
    said = ["".join(map(chr, range(k, min(k + 4096, sys.maxunicode + 1)))) for k in range(0, sys.maxunicode + 1, 4096) if not 0xD000 <= k <= 0xDFFF] + ["ẹ́ ṩ̇ Å ① ﬁ ｆ ² ㎏", "", None]
    got = evidence.with_compatible(spark.createDataFrame([(x, x) for x in said], "t string, u string"), "t").collect()
    assert [r["t"] for r in got] == [x if x is None else unicodedata.normalize("NFKC", x) for x in said] and [r["u"] for r in got] == said


def test_quotes_with_combining_accents(spark):
    pages = spark.createDataFrame([("d", 1, "The cafe\u0301 keeps its keys № 5")], "document_id string, page int, text string")
    quotes = spark.createDataFrame([("d", "q", "café keeps its keys no 5", 1)], "document_id string, quote_id string, quote string, page int")
    assert evidence.verify_quotes(quotes, pages).first()["page"] == 1
