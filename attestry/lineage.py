"""Where a plan that grows with the rounds of a loop is cut: a checkpoint in the folder that all executors share."""

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df, written to spark.checkpoint.dir and read from there; in local mode without that setting to a new folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        sc.setCheckpointDir(path)
    elif not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()
