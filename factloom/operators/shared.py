"""Tables in the folder that the cluster shares, where long plans are cut."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where that is unset, a folder of our own in local mode, and an error on a cluster."""
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="factloom-checkpoint-"))
    return (spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")).rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in ``shared_dir``; what is there is removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table and read it again: a lost executor then costs the tasks that read it, and Spark knows its size."""
    path = shared_path(df.sparkSession, f"cut-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_and_count(df: DataFrame, of: Column | None = None) -> tuple[DataFrame, int]:
    """``cut``, with the number of rows, or of those for which ``of`` holds, seen while they are written."""
    seen = Observation()
    table = cut(df.observe(seen, F.count(F.lit(1) if of is None else F.when(of, 1)).alias("n")))
    return table, seen.get["n"]
