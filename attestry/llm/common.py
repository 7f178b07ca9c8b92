"""What several operators share: where lineage is cut, word splitting, literals."""

import tempfile
import uuid
from collections.abc import Iterable
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

WORD_GAP = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: spark.checkpoint.dir, or in local mode a new one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not path and not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return (path or sc.getCheckpointDir()).rstrip("/")


_SCOPES: list[list[str]] = []  # tables written by cut(), for each scratch() that is open


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark writes."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession):
    """Tables that cut() writes inside go at the end; what is built from them must be written before."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            remove(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and go on from there; survives the loss of executors.

    A table rather than checkpoint(): it is compressed, its true size decides how later joins run, and
    the plan that made it can be forgotten.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_counted(df: DataFrame, which: Column | None = None) -> tuple[DataFrame, int]:
    """cut(df) and how many of its rows hold which, all if not given, counted as they are written.

    A count of its own would be another job, with plans and broadcasts that the driver holds. A stage run
    again may be counted twice; none stays none.
    """
    seen = Observation()
    out = cut(df.observe(seen, F.count_if(F.lit(True) if which is None else which).alias("n")))
    return out, seen.get["n"]


def cut_each(spark: SparkSession, frames: Iterable[DataFrame], schema: str) -> DataFrame:
    """Frames of one schema, each appended to a table in the shared folder before the next is made, as cut() does with one."""
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    spark.createDataFrame([], schema).write.parquet(path)
    for df in frames:
        df.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Runs of anything but ASCII white space, in order; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def translate_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often body or its lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def literal_array(values, kind: str) -> Column:
    """A constant array that the optimizer folds into one literal; for tables of a fixed size."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def array_row(spark: SparkSession, name: str, values: list[int]) -> DataFrame:
    """One row with an array of ints, to be broadcast; for tables of a fixed size that are too long for a literal."""
    return spark.createDataFrame(pa.table({name: pa.array([values], pa.list_(pa.int32()))}))


def crc_bucket(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string")) % n
