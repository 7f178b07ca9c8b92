from pyspark.sql import functions as F

from attestry.operators import analytics, evidence, search, state, structure

LINES = "document_id string, ordinal int, page int, y double, x0 double, text string"


def lines(spark, said):
    return spark.createDataFrame([("d", i, 1 + i // 10, 100.0, 10.0, t) for i, t in enumerate(said)], LINES)


def test_sections_and_paths(spark):
    rows = lines(spark, ["1 Scope", "it covers all of the parts.", "1.1 Access Rules", "they hold for all.", "1.1.1 Keys", "2 Terms", "Glossary", "words are listed here."])
    got = {r["title"]: (r["depth"], r["path"], r["is_parent"]) for r in structure.sections(rows).collect()}
    assert got["1.1.1 Keys"] == (3, "1 Scope > 1.1 Access Rules > 1.1.1 Keys", False)
    assert got["2 Terms"] == (1, "2 Terms", True) and got["Glossary"] == (2, "2 Terms > Glossary", False)
    assert got["1 Scope"][2] is True


def test_a_table_region_opens_no_section(spark):
    rows = lines(spark, ["1 Scope", "2 Cells"]).withColumn("y", F.col("ordinal") * 10.0)
    regions = spark.createDataFrame([("d", 1, 5.0, 20.0, 0.0, 50.0)], "document_id string, page int, top double, bottom double, left double, right double")
    assert [r["title"] for r in structure.sections(rows, regions).collect() if r["title"]] == ["1 Scope"]


def test_furniture_needs_three_pages(spark):
    said = [("d", 3 * p + k, p, y, 0.0, t) for p in range(1, 5) for k, (y, t) in enumerate([(10.0, f"Page {p}"), (50.0, f"own {'abcd'[p - 1]} text")])]
    df = spark.createDataFrame(said, LINES)
    assert [r["mask"] for r in structure.furniture(df).collect()] == ["Page #"]
    assert structure.furniture(df.filter("page < 3")).count() == 0
    assert structure.without_furniture(df).count() == 4


def test_islands_passages_and_windows(spark):
    rows = spark.createDataFrame([("d", 1, "text", "a"), ("d", 2, "text", "b"), ("d", 3, "bullet", "c"), ("d", 4, "text", "d"), ("d", 6, "text", "e")], "document_id string, ordinal int, kind string, text string")
    assert [r["text"] for r in structure.passages(rows).orderBy("first").collect()] == ["a\nb", "c", "d", "e"]
    views = structure.windows(spark.range(300).select(F.lit("d").alias("document_id"), F.col("id").cast("int").alias("ordinal")))
    per = views.groupBy("ordinal").count()
    assert per.count() == 300 and per.agg(F.max("count")).first()[0] == 2
    fused = structure.fuse_windows(views.withColumn("role", F.col("window").cast("string")))
    assert {r["ordinal"]: r["role"] for r in fused.collect()}[119] == "1"


def test_contents_check(spark):
    e = spark.createDataFrame([("d", "Scope", 1), ("d", "Terms", 2), ("d", "Gone", 9)], "document_id string, title string, page int")
    s = spark.createDataFrame([("d", "SCOPE", 1), ("d", "Terms", 7), ("d", "New", 8)], "document_id string, title string, page int")
    assert {r["title"]: r["state"] for r in structure.contents_check(e, s).collect()} == {"Scope": "matched", "Terms": "drifted", "Gone": "missing", "New": "unexpected"}


def test_chunks(spark):
    s = spark.createDataFrame([("d", 1, "1 A", "x" * 100, "text"), ("d", 2, "2 B", "y" * 100, "text")], "document_id string, section int, path string, prose string, kind string")
    c = spark.createDataFrame([("d", 1, 1, "A must be.")], "document_id string, section int, ordinal int, text string")
    t = spark.createDataFrame([("d", 2, 1, ["k", "v"], [["a", None], ["b", "2"]])], "document_id string, section int, ordinal int, headers array<string>, rows array<array<string>>")
    f = spark.createDataFrame([("d", 2, 1, "rejected", "no", None), ("d", 2, 2, "ok", "old", "new")], "document_id string, section int, ordinal int, state string, description string, correction string")
    got = [(r["source_kind"], r["text"]) for r in structure.chunks(s, c, t, f).orderBy("ordinal").collect()]
    assert [k for k, _ in got] == ["clause", "table", "table_row", "table_row", "figure", "section"]
    assert got[2][1] == "2 B\nk: a; v: not specified" and got[4][1] == "2 B\nnew"


def test_quotes(spark):
    pages = spark.createDataFrame([("d", 1, "alpha beta"), ("d", 2, "gamma delta"), ("d", 3, "alpha beta")], "document_id string, page int, text string")
    q = spark.createDataFrame([("d", "named", "alpha", 3), ("d", "other", "gamma", 3), ("d", "over", "beta gamma", 1), ("d", "none", "omega", 1)], "document_id string, quote_id string, quote string, page int")
    assert {r["quote_id"]: r["page"] for r in evidence.verify_quotes(q, pages).collect()} == {"named": 3, "other": 2, "over": 1, "none": None}


def test_quotes_meet_pages_with_their_longest_word(spark):
    """Of 400 pages two have the word; before, each quote was held against each page of its document."""
    pages = spark.createDataFrame([("d", k, "plain words are here" + " and cryptography" * (k in (7, 300))) for k in range(400)] + [("d", 401, "the lone end"), ("d", 402, ""), ("d", 403, "of it"), ("d", 404, None)], "document_id string, page int, text string")
    said = [("d", "a", "and cryptography", 300), ("d", "b", "cryptography … plain", 1), ("d", "c", "HERE and Cryptography plain", 9), ("d", "e", "end of", 1), ("d", "f", " … ", 1), ("d", "g", None, 1), ("x", "h", "plain", 1)]
    got = evidence.verify_quotes(spark.createDataFrame(said, "document_id string, quote_id string, quote string, page int"), pages)
    assert {r["quote_id"]: r["page"] for r in got.collect()} == {"a": 300, "b": 7, "c": 7, "e": None, "f": None, "g": None, "h": None}
    assert "array_intersect" in got._jdf.queryExecution().optimizedPlan().toString()


def test_rehome(spark):
    s = spark.createDataFrame([("d", 1, "keys rotate yearly here"), ("d", 2, "logs are kept"), ("d", 3, "logs are kept")], "document_id string, section int, text string")
    what = "Nothing states who rotates these keys at all"
    g = spark.createDataFrame([("a", "d", 2, "keys rotate", what), ("b", "d", 1, "logs are kept", what + " b"), ("c", "d", 2, "logs are kept", what + " c"), ("v", "d", 1, "keys rotate", "too vague")], "gap_id string, document_id string, section int, quote string, what string")
    assert {r["gap_id"]: r["section"] for r in evidence.rehome(g, s).collect()} == {"a": 1, "c": 2}


def test_release_line(spark):
    import datetime as dt

    p = spark.createDataFrame([("1", "java", "17.0.2"), ("2", "java", "8.x"), ("3", "java", "99"), ("4", "java", "1.8"), ("5", "py", "2")], "product_id string, product string, version string")
    r = spark.createDataFrame([("java", "17", dt.date(2030, 1, 1), None), ("java", "17.0", dt.date(2023, 1, 1), None), ("java", "8", dt.date(2024, 7, 1), None), ("py", "2.7", None, None)], "product string, line string, eol date, support date")
    got = {x["product_id"]: (x["line"], x["status"]) for x in evidence.technology(p, r, F.lit("2024-06-01").cast("date")).collect()}
    assert got == {"1": ("17.0", "ended"), "2": ("8", "ending"), "3": (None, "unknown"), "4": ("8", "ending"), "5": (None, "unknown")}


HITS = "query_id long, place long, chunk_id long, document_id long, source_id string, source_kind string, text string, page int, heading string"


def test_folds(spark):
    words = " ".join(f"word{i:02d}" for i in range(30))
    rows = [(1, 1, 10, 1, "t1", "table_row", "row", 1, "h"), (1, 2, 11, 1, "t1", "table", "table", 1, "h"), (1, 3, 12, 1, None, "section", words, 1, "h"), (1, 4, 13, 1, None, "section", words + " more", 1, "h"), (1, 5, 14, 2, None, "section", words, 1, "h")]
    df = spark.createDataFrame(rows, HITS)
    tables = search.fold_tables(df)
    assert {(r["chunk_id"], r["place"]) for r in tables.collect()} == {(11, 1), (12, 3), (13, 4), (14, 5)}
    assert {r["chunk_id"] for r in search.fold_twins(tables).collect()} == {11, 12, 14}


def test_figure_kept(spark):
    rows = [(1, 1, 10, 1, None, "section", "storage keys", 3, "a"), (1, 2, 11, 1, None, "section", "other words", 4, "b"), (1, 3, 12, 1, None, "figure", "network", 3, "a"), (1, 4, 13, 1, None, "figure", "storage layout", 3, "x")]
    got = {(r["place"], r["chunk_id"]) for r in search.keep_figure(spark.createDataFrame(rows, HITS), 2).collect()}
    assert got == {(1, 10), (2, 13)}


def test_state(spark):
    rows = spark.createDataFrame([("a", "x", None), ("b", "y", "c")], "clause_id string, statement string, superseded_by_id string")
    after = state.supersede(rows, spark.createDataFrame([("a", "a2", "x2")], "clause_id string, draft_id string, statement string"))
    assert {r["clause_id"]: r["statement"] for r in state.live(after).collect()} == {"a2": "x2"}
    roster = spark.createDataFrame([("o", "a@x.org", "owner", "active"), ("o", "b@x.org", "member", "active")], "organisation_id string, email string, role string, status string")
    assert {r["email"]: r["status"] for r in state.revoke(roster, ["a@x.org", "b@x.org"]).collect()} == {"a@x.org": "active", "b@x.org": "revoked"}


def test_merge_outcomes(spark):
    rows = spark.createDataFrame([("r", 2, ["c"], 1, "partial", False, 1, True, 5), ("r", 1, ["a", "b"], 2, "complete", True, 3, False, 4)], "run string, ordinal int, items array<string>, n int, state string, truncated boolean, reads int, cached boolean, at int")
    got = analytics.merge_outcomes(rows, ["complete", "partial"]).first()
    assert (got["items"], got["n"], got["state"], got["truncated"], got["reads"], got["cached"], got["generated_at"]) == (["a", "b", "c"], 3, "complete", True, 3, False, 5)
