"""Cutting lineage through the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def ensure_shared_dir(spark: SparkSession) -> None:
    """Use the session's ``spark.checkpoint.dir``; where it is unset, make a folder of our own in local mode and refuse on a cluster."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="factloom-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there.

    A lost executor then costs the tasks that read it, not the steps before; Spark removes the
    files when the plan that reads them is gone (``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    ensure_shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    """How many partitions the session gives a shuffle."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cut_by(df: DataFrame, key: str, width: int | None = None) -> DataFrame:
    """Deal ``df`` by ``key`` to ``width`` partitions and cut; later groupings by ``key`` then move only their other side.

    A checkpoint keeps its partitioning only if the plan that it comes from is not adaptive.
    """
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(df.repartition(width or shuffle_width(spark), key))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared checkpoint folder; what is there is removed when the session's JVM ends."""
    ensure_shared_dir(spark)
    path = f"{(spark.sparkContext.getCheckpointDir() or spark.conf.get('spark.checkpoint.dir')).rstrip('/')}/{name}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def cut_in_loop(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    A checkpoint keeps Spark's estimate of its size, a product over joins: in a loop of joins its number of
    digits grows by a factor each round, and after some ten rounds planning does not end. A table's
    size is that of its files.
    """
    path = shared_path(df.sparkSession, f"cut-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scrap(table: DataFrame) -> None:
    """Remove the files of a table of ``cut_in_loop`` that nothing reads any more."""
    spark = table.sparkSession
    for folder in {path.rsplit("/", 1)[0] for path in table.inputFiles()}:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def cut_and_sum(df: DataFrame, weight: str) -> tuple[DataFrame, int, int]:
    """``cut_in_loop``, with the sum and the largest of ``weight``, seen while it is written (0 without rows)."""
    seen = Observation()
    table = cut_in_loop(df.observe(seen, F.sum(weight).alias("total"), F.max(weight).alias("most")))
    return table, seen.get["total"] or 0, seen.get["most"] or 0


def numbered(docs: DataFrame, id_col: str, text_col: str, name: str = "row") -> DataFrame:
    """``docs`` with a long ``name`` that no two rows share and no row lacks, in order of ``id_col``.

    It is the id itself if ids are so. Otherwise rows are sorted by id, rows without one last, and by a hash
    of the text within an id, numbered and written, so that a lost task can't number them anew.
    """
    ids = docs.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.count("*").alias("n"))
    if ids.where("n > 1 or id is null").isEmpty():
        return docs.withColumn(name, F.col(id_col).cast("long"))
    place = docs.withColumn(name, F.monotonically_increasing_id())
    order = [F.col(id_col).cast("long").asc_nulls_last(), F.xxhash64(text_col), F.col(name)]
    return cut_in_loop(place.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow batches hold at most ``rows`` rows from now on; whole texts make Spark's default of 10,000 large.

    Spark reads this setting of the session when a plan runs, so it stays set.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows or int(spark.conf.get(name)) <= 0:
        spark.conf.set(name, str(rows))


#: A key of more than 1 / SHARE of all rows is dealt to several tasks; there can be no more than SHARE of these.
SHARE = 10_000


def salted_join(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int, most: int) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row for each key and in ``weight`` how many of ``rows`` have it.

    ``total`` and ``most`` are the sum and the largest of the weights. The rows of a frequent key are dealt
    by a hash of their other columns, and its row of the table is repeated for each share. Frequent keys
    are fewer than ``SHARE`` at any size, so they go to every executor.
    """
    share = max(1, total // SHARE)
    if most <= share:
        return rows.join(table, keys)
    salts = F.ceil(F.col(weight) / F.lit(share)).cast("int")
    hot = table.where(salts > 1).select(*keys, salts.alias("_salts"))
    others = [c for c in rows.columns if c not in keys]
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*others), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return dealt.join(copies, [*keys, "_salt"]).drop("_salt")
