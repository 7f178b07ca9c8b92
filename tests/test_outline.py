"""Headings and sections by how a document prints them."""

from pyspark.sql import functions as F

from attestry.operators import structure

LINES = "document_id string, ordinal int, page int, y double, x0 double, x1 double, text string, font string, size double, bold boolean, italic boolean, color int"
BODY, HEAD, SUB, SMALL, LARGE = ("Sans", 12.0, False), ("Sans", 16.0, True), ("Sans", 12.0, True), ("Sans", 11.0, True), ("Other", 18.0, False)
PROSE = "Some words of the body that go on for a while and say what is so."


def doc(spark, said, name="d"):
    rows = [(name, k, page, 20.0 * k, 50.0, 300.0, text, *style[:3], False, 0) for k, (text, style, page) in enumerate(x if len(x) == 3 else (*x, 1) for x in said)]
    return spark.createDataFrame(rows, LINES)


def outline(spark, said, **regions):
    titles = spark.createDataFrame([("d", "The design")], "document_id string, document_title string")
    got = structure.printed_sections(doc(spark, said), titles, **regions).orderBy("section").collect()
    return [(r["number"], r["title"], r["depth"], r["path"], r["text"]) for r in got]


def test_numbers_appendices_and_titles(spark):
    said = [("1 Scope", HEAD), (PROSE, BODY), ("1.2 Systems", SUB), (PROSE, BODY), ("Deployment", SUB), (PROSE, BODY), ("2. Delivery", HEAD), (PROSE, BODY), ("Statement: All of it", SUB), ("Ends with a stop.", SUB), ("appendix a: Terms", HEAD), (PROSE, BODY), ("Sources", SUB), (PROSE, BODY)]
    assert [r[:4] for r in outline(spark, said)] == [
        ("1", "Scope", 1, "The design › 1 Scope"), ("1.2", "Systems", 2, "The design › 1 Scope › 1.2 Systems"), (None, "Deployment", 3, "The design › 1 Scope › 1.2 Systems › Deployment"), ("2", "Delivery", 1, "The design › 2 Delivery"),
        ("Appendix A", "Terms", 1, "The design › Appendix A Terms"), (None, "Sources", 2, "The design › Appendix A Terms › Sources"),
    ]
    assert outline(spark, said)[3][4] == f"{PROSE}\nStatement: All of it\nEnds with a stop."


def test_deep_numbers_may_be_small(spark):
    said = [("3 Servers", HEAD), (PROSE, BODY), ("3.4.3.1 Virtual Servers", SMALL), (PROSE, BODY), ("3.4 of these are bold", SMALL), (PROSE, BODY), ("Small Title", SMALL), (PROSE, BODY), ("3.4.4 plain words", BODY), *[(PROSE, BODY)] * 8]
    # Bold at 11 points is no level of its own.
    assert [r[0] for r in outline(spark, said)] == ["3", "3.4.3.1"]


def test_documents_with_bold_numbers(spark):
    chapters = [x for k in range(1, 6) for x in ((f"{k} Chapter", HEAD), (PROSE, BODY), (PROSE, BODY))]
    sheet = [("Embedded Sheet", LARGE), (PROSE, BODY)]
    assert [r[1] for r in outline(spark, [*chapters, *sheet])] == ["Chapter"] * 5
    # Of four numbered headings nothing follows; nor if they aren't bold.
    assert outline(spark, [*chapters[:12], *sheet])[-1][1] == "Embedded Sheet"
    plain = [(t, ("Sans", 16.0, False) if s == HEAD else s) for t, s in chapters]
    assert outline(spark, [*plain, *sheet])[-1][1] == "Embedded Sheet"


def test_regions_and_contents(spark):
    said = [("Contents", HEAD, 1), ("1 Scope", HEAD, 1), ("1 Scope", HEAD, 2), (PROSE, BODY, 2), ("Column Name", SUB, 2), ("2 In a table", SUB, 2), ("Box Label", SUB, 3), ("3 In a figure", HEAD, 3), (PROSE, BODY, 3), *[(PROSE, BODY, 4)] * 6]
    region = lambda page, a, b: spark.createDataFrame([("d", page, a, b, 0.0, 400.0)], "document_id string, page int, top double, bottom double, left double, right double")
    contents = spark.createDataFrame([("d", 1)], "document_id string, page int")
    got = outline(spark, said, contents=contents, tables=region(2, 79.0, 101.0), figures=region(3, 119.0, 141.0))
    assert [(r[0], r[1]) for r in got] == [("1", "Scope"), ("3", "In a figure")]
    assert got[0][4] == f"{PROSE}\nColumn Name\n2 In a table\nBox Label"


def test_without_headings(spark):
    assert outline(spark, [(PROSE, BODY), (PROSE, BODY)]) == [(None, "The design", 1, "The design", f"{PROSE}\n{PROSE}")]
    assert structure.printed_sections(doc(spark, [(PROSE, BODY)]).filter("false"), spark.createDataFrame([("d", "x")], "document_id string, document_title string")).count() == 0


def test_body_is_what_sets_most(spark):
    got = structure.printing(doc(spark, [("1 Scope", HEAD), (PROSE, BODY), ("Loud words", LARGE), (PROSE * 3, ("Sans", 14.0, False))])).select("body.*", F.array_sort("levels").alias("levels")).first()
    assert (got["size"], got["bold"]) == (14.0, False) and [tuple(x) for x in got["levels"]] == [(16.0, True), (18.0, False)]
