"""Incremental ingest: what changed between two listings, which projects that makes stale, and a file stream that acts on it."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.operators.graph import reach


def manifest_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(path, change)`` of two listings ``(path, digest)``: added, removed or changed. Deletions and renames show here, unlike in a stream."""
    a, b = before.groupBy("path").agg(F.max("digest").alias("old")), after.groupBy("path").agg(F.max("digest").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).where("change is not null")


def stale_projects(changes: DataFrame, files: DataFrame, references: DataFrame) -> DataFrame:
    """``(node)``: projects of changed files and all that refer to them; ``references(src, dst)``: src refers to dst."""
    touched = changes.join(files, "path").select(F.col("project").alias("node")).distinct()
    return reach(references.select(F.col("dst").alias("src"), F.col("src").alias("dst")), touched).select("node")


# What is watched, and folders that are not.
SOURCE, PROJECT, LIBRARY = (".cs",), (".csproj", ".props", ".targets"), (".dll",)
IGNORED = ("obj", "bin")


def watched(path: Column) -> Column:
    """Whether a change of this file matters: by its ending, and unless it is below an ignored folder."""
    clean = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    ends = clean.rlike("(?:" + "|".join(x.replace(".", r"\.") for x in SOURCE + PROJECT + LIBRARY) + ")$")
    return ends & ~clean.rlike(r"(?:^|/)(?:" + "|".join(IGNORED) + ")/")


def classified(changes: DataFrame, files: DataFrame) -> DataFrame:
    """``(path, change, effect)`` of the watched ``changes(path, change)``: a known source file that is still there is a ``document``, a library ``metadata``, all else asks for a ``reload``."""
    known = files.select("path").distinct().withColumn("known", F.lit(True))
    clean = F.lower("path")
    effect = (
        F.when(clean.endswith(LIBRARY[0]), "metadata").when(clean.endswith(SOURCE[0]) & F.col("known").isNotNull() & (F.col("change") == "changed"), "document").otherwise("reload")
    )
    return changes.where(watched(F.col("path"))).join(known, "path", "left").select("path", "change", effect.alias("effect"))


def debounced(events: DataFrame, gap_ms: int = 200) -> DataFrame:
    """``(batch, path, first, last, n)`` of ``events(path, at)``: a batch ends when nothing has happened for ``gap_ms``; a path counts once in it. One listing's events are ordered in one task, as they came."""
    at = F.unix_millis(F.col("at").cast("timestamp"))
    order = Window.orderBy("at")
    new = F.coalesce((at - F.lag(at).over(order)) > gap_ms, F.lit(True)).cast("int")
    numbered = events.withColumn("new", new).withColumn("batch", F.sum("new").over(order))
    return numbered.groupBy("batch", "path").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n"))


class StaleSet:
    """Names that wait for a rebuild. ``drain`` hands them out to one worker at a time, and puts them back if its work fails."""

    def __init__(self) -> None:
        self._names: set[str] = set()
        self._lock, self._work = threading.Lock(), threading.Lock()

    def add(self, names: set[str]) -> None:
        with self._lock:
            self._names |= names

    def waiting(self) -> set[str]:
        with self._lock:
            return set(self._names)

    @contextmanager
    def drain(self) -> Iterator[set[str]]:
        with self._work:
            with self._lock:
                taken, self._names = self._names, set()
            try:
                yield set(taken)
            except BaseException:
                self.add(taken)
                raise


def watch(spark: SparkSession, folder: str, checkpoint: str, refresh: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Give the new source files of ``folder`` to ``refresh(files, batch)`` as ``(path, text)``, all there is and then stop; a failed batch comes again."""
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).where(F.lower("path").endswith(SOURCE[0]) & watched(F.col("path")))
    return files.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
