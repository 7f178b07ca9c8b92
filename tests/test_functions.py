import pytest
from pyspark.sql import functions as F

from attestry.functions import dates, lexical, text, vector


def one(spark, expr, **columns):
    df = spark.range(1)
    for k, v in columns.items():
        df = df.withColumn(k, F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)))
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "said,want",
    [("Systems must log.", "must"), ("It may not be used.", "must"), ("It should log.", "should"), ("It may log.", "may"), ("It logs.", None), ("Users can not log in", "must")],
)
def test_modal(spark, said, want):
    assert one(spark, text.strongest_modal(F.col("t")), t=said) == want


def test_obligation_takes_parsed_strengths_only_if_they_line_up(spark):
    o = lambda parsed, reqs: one(spark, text.obligation(F.col("p"), F.col("r"), F.lit("It should be so."), F.lit("")), p=parsed, r=reqs)
    assert tuple(o(["should", "must"], ["a", "b"])) == ("must", "parsed")
    assert tuple(o(["must"], ["a", "b"])) == ("should", "read")


@pytest.mark.parametrize("said,want", [("a multi-\nline text", "a multiline text"), ("cloud-\nbased text", "cloud-based text"), ("in Nord-\nRhein", "in Nord-Rhein"), ("service-\noriented", "service-oriented"), ("aware-\nness in-\nformation", "awareness information"), ("ISO-\n27001 Shibboleth-\n  Based", "ISO-27001 Shibboleth-Based")])
def test_wraps(spark, said, want):
    assert one(spark, text.rejoin_wraps(F.col("t")), t=said) == want


def test_reflow_joins_only_long_open_lines(spark):
    long = "a" * 70
    assert one(spark, text.reflow(F.col("t")), t=f"{long}\nand on\nShort\nand") == f"{long} and on\nShort\nand"
    assert one(spark, text.reflow(F.col("t")), t=f"{long}.\nand on") == f"{long}.\nand on"


@pytest.mark.parametrize(
    "quote,passage,want",
    [("Keys are rotated", "All keys ARE  rotated yearly", True), ("keys … yearly", "keys are rotated yearly", True), ("yearly … keys", "keys are rotated yearly", False), ("key", "keys are", False), ("…", "keys", False)],
)
def test_quote(spark, quote, passage, want):
    assert one(spark, text.quote_in(F.col("q"), F.col("p")), q=quote, p=passage) is want


def test_scrub_and_fingerprint(spark):
    assert one(spark, text.scrub(F.col("t")), t="a.b@c.org called 0123456789 at 12") == "<email> called <number> at 12"
    assert one(spark, text.fingerprint(F.lit("a"), F.lit("b"))) != one(spark, text.fingerprint(F.lit("ab"), F.lit("")))


@pytest.mark.parametrize("line,want", [("3.1 Key management", ("numbered", 2)), ("Appendix B Terms", ("appendix", 1)), ("Key Management", ("title", None)), ("this is a sentence.", None), ("Ends with a stop.", None), ("Statement: All of it", None), ("Version 1.2 of it", None), ("Rationale", ("title", None)), ("Appendix b", ("appendix", 1))])
def test_heading(spark, line, want):
    got = one(spark, text.heading(F.col("t")), t=line)
    assert (got and (got["kind"], got["depth"])) == want


def test_small_text_functions(spark):
    assert tuple(one(spark, text.toc_entry(F.lit("Access control ...... 12")))) == (None, "Access control", 12, 1)
    assert tuple(one(spark, text.toc_entry(F.lit("1.1. Purpose   5")))) == ("1.1", "Purpose", 5, 2)
    assert tuple(one(spark, text.toc_entry(F.lit("appendix b: Glossary of Terms ..... 27")))) == ("Appendix B", "Glossary of Terms", 27, 1)
    assert one(spark, text.toc_entry(F.lit("Room 12"))) is None and one(spark, text.toc_entry(F.lit("Too far ..... 6000"))) is None
    assert one(spark, text.render_row(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("1"), F.lit(None)))) == "a: 1; b: not specified"
    assert one(spark, text.unique_headers(F.col("h")), h=["x", "y", "x"]) == ["x", "y", "x (2)"]
    assert one(spark, text.labelled_part(F.lit("Statement: S. Rationale: R."), "Rationale")) == "R."
    assert one(spark, text.version_stated(F.lit("1.2"), F.lit("runs 1.2 now"))) and not one(spark, text.version_stated(F.lit("1.2"), F.lit("runs 11.2 now")))
    assert one(spark, text.product_matches(F.lit("Postgre SQL"), F.lit("uses PostgreSQL 15")))
    assert one(spark, text.shorten(F.lit("one two three"), 8)) == "one two…" or one(spark, text.shorten(F.lit("one two three"), 8)) == "one…"
    assert one(spark, text.file_format(F.unhex(F.lit("255044462D312E37")))) == "pdf"
    assert one(spark, text.normative(F.lit("All systems must encrypt data at rest."))) and not one(spark, text.normative(F.lit("You must.")))
    assert one(spark, text.vague_gap(F.lit("Architecture sketch of HR System, ETL Job"))) and one(spark, text.vague_gap(F.lit("Stores keys in files")))
    assert not one(spark, text.vague_gap(F.lit("Keys are rotated where appropriate by the platform team"))) and one(spark, text.generic(F.lit("Rotate the keys where appropriate in all of them")))
    for said, want in [("The zone runs in two sites and fails over to the other by itself.", True), ("Details of the availability zones to be agreed with the operator.", False), ("All of the servers are listed in the file Server List.xlsx here.", False), ("TBC. The availability of all of these zones is not known as yet.", False), ("No sentence here but quite some words so that it is long enough", False)]:
        assert one(spark, text.substantive(F.col("t")), t=said) is want
    assert not one(spark, text.substantive(F.lit("TBD")))


def test_lexical_and_vector(spark):
    assert one(spark, lexical.keywords(F.lit("The keys that encrypt data"))) == ["keys", "encrypt"]
    assert one(spark, lexical.query_terms(F.lit("That this with"))) == []
    assert one(spark, lexical.query_terms(F.lit("Systems must use TLS 1.2. or IP keys"))) == ["tls", "1.2", "ip", "keys"] and one(spark, lexical.query_terms(F.lit("data must"))) == ["data", "must"]
    assert one(spark, vector.cosine_distance(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(2.0)))) == 1.0
    assert one(spark, vector.threshold(F.lit("unknown"))) == 0.42


def test_dates(spark):
    d = lambda x: F.lit(x).cast("date")
    s = lambda eol, sup: tuple(one(spark, dates.lifecycle_status(d(eol), d(sup), d("2024-06-01"))))
    assert [s("2024-05-31", None), s("2024-06-01", None), s("2030-01-01", "2024-01-01"), s(None, None)] == [("ended", False), ("ending", False), ("supported", True), ("supported", False)]
    assert str(one(spark, F.add_months(d("2024-01-31"), 1))) == "2024-02-29"
    assert str(one(spark, dates.backoff(F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit(30)))) == "2024-01-01 01:00:00"


def test_sql_functions_are_the_columns(spark):
    from attestry.functions import lexical, registered
    from attestry.operators import verdicts

    registered.register(spark)
    rows = spark.createDataFrame([("The system must use 4.2 keys and Keys", "Key Storage"), ("shall use data", "a"), ("", "")], "body string, heading string")
    rows.createOrReplaceTempView("said")
    got = spark.sql("SELECT content_words(body) AS c, search_terms(body) AS q, chunk_weights(heading, body) AS w FROM said").collect()
    want = rows.select(lexical.content_words(F.col("body")).alias("c"), lexical.query_terms(F.col("body")).alias("q")).collect()
    assert [(r["c"], r["q"]) for r in got] == [(r["c"], r["q"]) for r in want] and got[0]["q"] == ["4.2", "keys"]
    assert [(x["term"], x["weight"]) for x in got[0]["w"]][:3] == [("key", 10), ("storage", 10), ("system", 1)]
    kinds = spark.createDataFrame([(v, o) for v in [*verdicts.KNOWN, "odd"] for o in ("must", "should", "may", "unstated")], "v string, o string")
    kinds.createOrReplaceTempView("kinds")
    assert [r[0] for r in spark.sql("SELECT verdict_severity(v, o) FROM kinds").collect()] == [r[0] for r in kinds.select(verdicts.severity(F.col("v"), F.col("o"))).collect()]
