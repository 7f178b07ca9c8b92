"""Best rows by tiles against rankings of all pairs."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from attestry.functions import lexical, stemming
from attestry.operators import search, tiles
from attestry.plans import catalog


def odd_vectors(n=240, width=64):
    r = random.Random(7)
    said = [[r.gauss(0, 1) for _ in range(width)] for _ in range(n)]
    for i in range(0, n, 9):
        said[i] = said[4]  # one vector many times
    said[100] = [0.0] * width
    said[13] = said[200] = None
    said[14] = [None] * width
    said[15] = [None, *said[15][1:]]
    said[16] = [math.nan, *said[16][1:]]
    return said


@pytest.mark.parametrize("name", ["dense_topk_per_label", "nearest_under_threshold"])
def test_dense_queries_on_odd_vectors(spark, tmp_path, name, monkeypatch):
    """Equal vectors, some without a direction, null ones and null components; before, a vector of zeros ended the job and null ones came first."""
    rows = [(i, i % 3, v) for i, v in enumerate(odd_vectors())]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.execute(catalog.oracle_sql()[name]).fetchall()
    got = catalog.queries()[name](spark, str(tmp_path))
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_nearest_in_small_tiles_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(tiles, "BLOCK", 3)
    said = odd_vectors(240, 5)[:99]
    vectors = spark.createDataFrame(list(enumerate(said)), "chunk_id long, vector array<double>").filter("vector is not null")
    queries = vectors.filter("chunk_id % 11 = 0").select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("query"))
    got = search.ranked(tiles.nearest(queries, vectors, 7), "r", F.col("distance"), F.col("chunk_id"), by="query_id", pool=7)
    sound = lambda v: all(x is not None and math.isfinite(x) for x in v)
    rows = [(r["chunk_id"], r["vector"]) for r in vectors.collect()]
    for q in queries.collect():
        d = sorted((1 - math.sumprod(q["query"], v) / math.sqrt(math.sumprod(v, v) * math.sumprod(q["query"], q["query"])), i) for i, v in rows if sound(v))
        assert {r["chunk_id"] for r in got.filter(F.col("query_id") == q["query_id"]).collect()} <= {i for x, i in d if x <= d[6][0] + 1e-9}
    assert got.count() == 7 * queries.count()


def test_lexical_best_is_the_full_ranking(spark, monkeypatch):
    """Several blocks of queries and tiles, terms by product and one by one, ties, headings, a value of by that is null."""
    r = random.Random(3)
    words = [*"keys key rotated rotation storing stored cloud the and".split(), "1.2", "a..b", *(f"w{i}" for i in range(60))]
    body = lambda n: " ".join(r.choices(words, [1 / (1 + i) for i in range(len(words))], k=n))
    chunks = spark.createDataFrame([(i, r.choice("ab") if i % 5 else None, r.choice([None, body(2)]), body(r.randrange(30)) if i % 9 else None) for i in range(300)], "chunk_id long, design string, heading_path string, text string")
    queries = spark.createDataFrame([(i, list({*body(1 + i).split()})) for i in range(17)], "query_id long, terms array<string>")
    asked = lexical.asked_terms(queries)
    all_hits = lexical.weighted_terms(chunks).join(asked, "term").groupBy("query_id", "chunk_id").agg(F.sum("weight").alias("rank"))
    for by in ([], ["design"]):
        keys = ["query_id", *by]
        order = (F.desc("rank"), F.col("chunk_id"))
        want = search.ranked(all_hits.join(chunks.select("chunk_id", *by), "chunk_id"), "n", *order, by=keys, pool=6)
        for cells, block in ((2_000_000, 10_000), (40, 5)):
            monkeypatch.setattr(tiles, "CELLS", cells)
            monkeypatch.setattr(tiles, "BLOCK", block)
            got = search.ranked(tiles.lexical_best(asked, chunks, 6, by), "n", *order, by=keys, pool=6)
            columns = [*keys, "chunk_id", "rank", "n"]
            assert sorted(map(repr, got.select(*columns).collect())) == sorted(map(repr, want.select(*columns).collect()))
    assert tiles.lexical_best(asked.filter("false"), chunks, 6).count() == 0


def test_dots_within_words(spark):
    """As in the SQL twins, dots are cut at a word's ends only; before, a..b was two words."""
    row = spark.createDataFrame([("...a..b. 1.2.. .c .. d.",)], "t string").select(lexical.lexemes(F.col("t")).alias("w")).first()
    assert row["w"] == ["a..b", "1.2", "c"] + ["d"]


def test_stems_by_columns(spark):
    words = "running flies generalizations happiness dying early easily hoping agreed cosmos national university communism canning y yes sayer 1.2 ab ties hopping biliti logi rationalize".split()
    rows = spark.createDataFrame([(w,) for w in words], "word string")
    got = {r["word"]: r["stem"] for r in stemming.stems_of(rows).collect()}
    assert got == {r["word"]: r["s"] for r in rows.select("word", stemming.stem(F.col("word")).alias("s")).collect()}
