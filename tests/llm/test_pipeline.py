"""The stages over awkward rows and the whole pipeline against brute force."""

import collections
import random

import brute
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, version string, text_hash string, _row string, key string"


def documents(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t), *["a clashing name"] * 5) for d, t in rows], SCHEMA)


def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    bench = [line(14) for _ in range(4)]
    texts = ["\n".join(line(rng.choice([12, 25, 40])) for _ in range(3)) for _ in range(40)]
    shared = [line(60) for _ in range(3)]
    for i in range(8):
        texts.append(f"{line(30)}\n{shared[i % 3]}\n{line(26)}")  # a passage that others hold too
        near = texts[i].split(" ")
        near[rng.randrange(len(near))] = "changed"
        texts.append(" ".join(near))  # a near copy
        texts.append(texts[i + 8])  # a copy
    texts += [f"{line(30)} {bench[0]} {line(20)}", f"{line(12)}\n{line(30)} {bench[1]}"]
    texts += [None, "", " \t\n ", "too short", " ".join(["again"] * 60), "x" * 5000, " ".join(["y" * 40] * 700) + " " + line(900)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, line(50)), (None, line(40)), (None, texts[2])]
    rng.shuffle(rows)
    return rows, bench


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows, bench = corpus()
    path = str(tmp_path_factory.mktemp("corpus"))
    documents(spark, rows).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(i, int(i % 5 != 0), int(i % 7 == 0)) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows, bench, labels


def pairs(df):
    return collections.Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_stages_against_brute_force(spark, tables):
    """Each stage on what its predecessor kept, and the last one's digests."""
    import corpus_pipeline as cp
    import tiktoken

    from attestry.llm import bpe, quality

    path, rows, bench, labels = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, stages = docs.columns, dict(cp.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]

    def step(name, want):
        nonlocal docs, rows
        docs = stages[name](spark, docs, path).cache()
        assert docs.columns == columns and pairs(docs) == collections.Counter(want), name
        assert all(r["n_chars"] == len(r["text"]) and r["h"] == r["_row"] == "a clashing name" for r in docs.collect())
        rows = want

    step("quality_rules", [r for r, (_, kept) in zip(rows, brute.quality(rows, labels, quality.BUCKETS, quality.SCALE, quality.HELD, quality.REJECTED), strict=True) if kept])
    left, _ = brute.without_repeated_lines(rows)
    step("line_dedup", [(d, t) for (d, before), t in zip(rows, left, strict=True) if t == before or brute.split(t)])
    step("near_dedup", [r for r, g in zip(rows, brute.near_duplicates(rows), strict=True) if r[0] == g])
    step("decontamination", [r for r, bad in zip(rows, brute.contaminated([t for _, t in rows], bench), strict=True) if not bad])
    assert 20 < len(rows) < 60
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got = collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in stages["byte_bpe"](spark, docs, path).collect())
    ids = [(d, lib.encode_ordinary(t), t) for d, t in rows]
    assert got == collections.Counter((d, len(i), brute.sha(",".join(map(str, i)).encode()), brute.sha(t.encode())) for d, i, t in ids)


def test_stages_take_an_empty_table(spark, tables):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{tables[0]}/documents.parquet").filter("false")
    for name, stage in cp.STAGES:
        out = stage(spark, docs, tables[0])
        assert out.count() == 0 and (name == "byte_bpe" or out.columns == docs.columns)


def test_run_leaves_nothing_but_its_result(spark, tables):
    import os

    import corpus_pipeline as cp

    from attestry.llm.common import shared_dir

    where = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(where))
    out = cp.run(spark, tables[0])
    made = set(os.listdir(where)) - before
    assert out.count() > 20 and len(made) == 1 and os.listdir(f"{where}/{made.pop()}") == ["4-byte_bpe"]


def test_registered():
    import __spark_entry__ as e

    assert {"pipeline", *(f"op{n}" for n in range(1, 11))} <= {k.split("_")[0] for k in e.queries()}


def test_quality_stage_uses_all_trusted_labels(spark, tables, tmp_path):
    """Labels of documents that aren't there change nothing, however many they are."""
    import corpus_pipeline as cp

    path, _, _, labels = tables
    docs, stage = spark.read.parquet(f"{path}/documents.parquet"), dict(cp.STAGES)["quality_rules"]
    more = spark.range(1_000_000, 5_000_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    more.unionByName(spark.read.parquet(f"{path}/labels.parquet")).write.parquet(f"{tmp_path}/labels.parquet")
    assert pairs(stage(spark, docs, str(tmp_path))) == pairs(stage(spark, docs, path))
