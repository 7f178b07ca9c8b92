"""The lexical index against the full ranking."""

import random

import pytest
from pyspark.sql import functions as F

from attestry.functions import lexical
from attestry.operators import lexindex, search


def chunks_of(n, seed=0):
    rng = random.Random(seed)
    words = ["keys", "rotated", "rotation", "encrypting", "encryption", "network", "backup", "tls1.2", "server", "the"]
    rows = []
    for k in range(n):
        text = " ".join(rng.choices(words, weights=[9, 3, 3, 2, 2, 5, 1, 1, 8, 9], k=rng.randrange(1, 40)))
        rows.append((k, rng.choice(["Keys", "Backup of it", "", None]), text + (" zebra" if k % 97 == 0 else "")))
    return [*rows, (n, None, None), (n + 1, "", "")]


def full(chunks, asked, k):
    hits = lexical.weighted_terms(chunks).join(asked, "term").groupBy("query_id", "chunk_id").agg(F.sum("weight").alias("rank"))
    return sorted(map(tuple, search.ranked(hits, "_n", F.desc("rank"), F.col("chunk_id"), by="query_id", pool=k).select("query_id", "chunk_id", "rank").collect()))


@pytest.mark.parametrize("block,first", [(16, 1), (64, 2), (1024, 4)])
def test_best_chunks_by_bounds(spark, tmp_path, monkeypatch, block, first):
    monkeypatch.setattr(lexindex, "BLOCK", block)
    monkeypatch.setattr(lexindex, "FIRST", first)
    monkeypatch.setattr(lexindex, "GROWTH", 2)
    chunks = spark.createDataFrame(chunks_of(600), "chunk_id long, heading_path string, text string")
    lexindex.write(chunks, str(tmp_path / "index"))
    index = lexindex.read(spark, str(tmp_path / "index"))
    queries = spark.createDataFrame([(1, ["encrypted", "rotate"]), (2, ["zebras"]), (3, ["keys", "server", "network"]), (4, ["unknown"]), (5, ["backups", "tls1.2"]), (6, [])], "query_id long, terms array<string>")
    asked = lexical.asked_terms(queries)
    hits, reads = lexindex.search(index, asked, 5)
    assert sorted(map(tuple, hits.select("query_id", "chunk_id", "rank").collect())) == full(chunks, asked, 5)
    by_query = {r["query_id"]: r for r in reads.collect()}
    assert set(by_query) == {1, 2, 3, 5} and all(r["scored"] <= r["blocks"] and r["read"] <= r["entries"] for r in by_query.values())
    if block == 16:  # headings outweigh the rest: blocks without one are never scored
        assert by_query[5]["scored"] < by_query[5]["blocks"] and by_query[5]["read"] < by_query[5]["entries"]


def test_weights_and_terms_by_stem(spark):
    chunks = spark.createDataFrame([(1, "Key Rotation", "Rotated keys, rotating the key. TLS 1.2.")], "chunk_id long, heading_path string, text string")
    assert {r["term"]: r["weight"] for r in lexical.weighted_terms(chunks).collect()} == {"key": 12, "rotat": 12, "tls": 1, "1.2": 1}
    asked = spark.createDataFrame([(1, ["rotations", "rotate", "keys"])], "query_id long, terms array<string>")
    assert sorted(r["term"] for r in lexical.asked_terms(asked).collect()) == ["key", "rotat"]


def test_one_query_meets_stems(spark):
    chunks = spark.createDataFrame([(1, "rotated keys"), (2, "a key"), (3, "nothing")], "chunk_id long, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "chunk_id long, vector array<double>")
    got = search.hybrid(chunks, vectors, [1.0, 0.0], ["keys", "rotation"], "chunk_id").collect()
    assert [(r["chunk_id"], r["lexical_rank"]) for r in got] == [(1, 1), (2, 2)]


def test_nothing_asked(spark):
    chunks = spark.createDataFrame(chunks_of(3), "chunk_id long, heading_path string, text string")
    none = spark.createDataFrame([], "query_id long, term string")
    hits, reads = lexindex.search(lexindex.postings(chunks), none, 3)
    assert hits.count() == 0 and reads.count() == 0
