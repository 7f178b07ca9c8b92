"""A lexical index: postings by stem in blocks of chunks, and the best chunks of queries by block bounds.

Chunks are dealt to blocks of about ``BLOCK`` by hash. A posting row holds a term's chunks of one block and the
largest weight among them; written once and sorted by term, it is read by its narrow columns alone until a block
is scored. A query's score in a block is at most the sum of its terms' largest weights there. Blocks are scored
best bound first, ever more a round; a query stops at blocks whose bound is under its k-th score so far.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestry.functions import lexical
from attestry.lineage import cut

BLOCK = 1_024
FIRST, GROWTH = 4, 8  # blocks of a query scored in the first round; how many times more each round


def postings(chunks: DataFrame) -> DataFrame:
    """(term, block, most, n, entries (chunk_id, weight)) of chunks (chunk_id, heading_path, text)."""
    blocks = max(1, -(-chunks.count() // BLOCK))
    terms = lexical.weighted_terms(chunks).withColumn("block", F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)).cast("long"))
    # About BLOCK entries at most: a chunk has a term once.
    return terms.groupBy("term", "block").agg(F.max("weight").alias("most"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("chunk_id", "weight"))).alias("entries"))


def write(chunks: DataFrame, path: str) -> None:
    """Files cover ranges of terms, so that a scan for some terms skips the others' row groups."""
    postings(chunks).repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def bounds(index: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, block, bound, n): the most that a chunk of the block can score, and the entries that scoring it reads."""
    met = index.select("term", "block", "most", "n").join(asked, "term")
    return met.groupBy("query_id", "block").agg(F.sum("most").alias("bound"), F.sum("n").alias("n"))


def scored(index: DataFrame, asked: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, rank): each query's best k of its blocks."""
    met = asked.join(blocks.select("query_id", "block"), "query_id").join(index.select("term", "block", "entries"), ["term", "block"])
    hits = met.select("query_id", F.explode("entries").alias("e")).groupBy("query_id", F.col("e.chunk_id").alias("chunk_id")).agg(F.sum("e.weight").alias("rank"))
    return best(hits, k)


def best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("rank"), "chunk_id")
    return hits.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).drop("_n")


def search(index: DataFrame, asked: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Hits and reads: (query_id, chunk_id, rank), the best k chunks by the sum of weights of asked (query_id, term), ties to
    the smaller id; and (query_id, blocks, scored, entries, read): blocks and entries with its terms, and those looked at."""
    asked = cut(asked)
    whole = left = cut(bounds(index, asked))
    hits = done = None
    size = FIRST
    while not left.isEmpty():
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
        now = cut(left.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= size).drop("_n"))
        more = scored(index, asked, now, k)
        hits = cut(more if hits is None else best(hits.unionByName(more), k))  # k rows a query at most
        done = now if done is None else done.unionByName(now)
        floor = hits.groupBy("query_id").agg(F.count("*").alias("found"), F.min("rank").alias("least"))
        rest = left.join(now.select("query_id", "block"), ["query_id", "block"], "left_anti").join(floor, "query_id", "left")
        # A chunk that ties with the k-th may come before it by its id.
        left = cut(rest.filter(F.col("found").isNull() | (F.col("found") < k) | (F.col("bound") >= F.col("least"))).drop("found", "least"))
        size *= GROWTH
    if hits is None:
        hits, done = whole.select("query_id", F.col("block").alias("chunk_id"), F.col("bound").alias("rank")), whole
    total = whole.groupBy("query_id").agg(F.count("*").alias("blocks"), F.sum("n").alias("entries"))
    return hits, total.join(done.groupBy("query_id").agg(F.count("*").alias("scored"), F.sum("n").alias("read")), "query_id")


def top(index: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    return search(index, asked, k)[0]
