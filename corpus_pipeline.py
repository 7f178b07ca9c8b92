"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, encoding.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. All
but the last return the columns of docs. Rows without a doc_id pass through the stages that join by it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm import bpe, decontaminate, linededup, minhash, quality
from attestry.llm.common import cut, remove, scratch, shared_dir, table


def _whole(docs: DataFrame) -> DataFrame:
    """doc_id and text beside the whole row, whose other columns may have any names."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio."""
    return quality.quality(_whole(docs), table(spark, sf_dir, "labels"), keep=("_row",)).filter("kept").select("_row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand earlier in the corpus; a document goes if no word is left of it."""
    rows = linededup.dedup_lines(_whole(docs), keep=("_row",))
    rows = rows.filter((F.col("n_dropped") == 0) | (F.col("words_after") > 0))
    row = F.col("_row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.col("n_dropped") == 0, F.col("_row.n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return rows.select(row.alias("_row")).select("_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least doc_id.

    A row goes by its doc_id and its text's hash, so another text with the same doc_id is judged by itself.
    """
    others = minhash.near_duplicates(docs).filter("not kept and doc_id is not null")
    others = cut(others.select(F.col("doc_id").alias("_id"), F.col("version").alias("_version")).distinct())
    return docs.join(others, (docs["doc_id"].cast("long") == others["_id"]) & (F.xxhash64(docs["text"]) == others["_version"]), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    hit = cut(decontaminate.hits(docs, table(spark, sf_dir, "benchmark")).filter("contaminated").select(F.col("doc_id").alias("_id"), "text_hash").distinct())
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["_id"]) & (F.xxhash64(docs["text"]) == hit["text_hash"]), "left_anti")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the bytes that they decode to."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(bpe.encode(docs, path, public_tokenizers.PATTERN), path)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: Stages hold models and graph components, which SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written and read again, so a lost executor repeats one stage at most.

    What a stage wrote on its way goes when it is done, its predecessor's result with it.
    """
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
