"""Facts of snapshots as partitioned tables: a refresh works out again only the projects that a change makes stale.

Below one folder, ``facts`` is partitioned by the snapshot that made a project's facts and by project, and ``projects`` by snapshot:
which projects it has, and which snapshot made the facts of each. ``files`` keeps each snapshot's listing. A refresh writes facts of stale projects,
then the listing, then ``projects``; a snapshot is there when its rows of ``projects`` are. A refresh that fails before leaves the last snapshot as it was,
and the next one writes the same partitions again. Readers name the snapshot they read, so a refresh changes nothing under them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.errors import NotLoaded
from factloom.operators.shared import cut, cut_and_count
from factloom.streaming.changes import manifest_diff, stale_projects

_PROJECTS = "project string, made_in long, snapshot long"
_FILES = "path string, digest string, project string, snapshot long"


def _put(rows: DataFrame, path: str, *by: str) -> None:
    """Replace the partitions that the rows have, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


@dataclass
class FactStore:
    """``schema``: columns of the facts that ``extract(files)`` gives for files ``(path, digest, project, ...)``; it has ``project`` and, in each row, something else that is not null."""

    spark: SparkSession
    path: str
    schema: str
    extract: Callable[[DataFrame], DataFrame]

    def _columns(self) -> list[str]:
        return [x.split()[0] for x in self.schema.split(", ")]

    def _read(self, table: str, schema: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{table}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def latest(self) -> int | None:
        """The last whole snapshot; None before the first."""
        projects = self._read("projects", _PROJECTS)
        return None if projects is None else projects.agg(F.max("snapshot")).first()[0]

    def projects(self, snapshot: int) -> DataFrame:
        """``(project, made_in)`` of a snapshot."""
        projects = self._read("projects", _PROJECTS)
        if projects is None:
            raise NotLoaded("the store has no snapshot")
        return projects.where(F.col("snapshot") == snapshot).where("project is not null").select("project", "made_in")

    def facts(self, snapshot: int | None = None) -> DataFrame:
        """The facts of a snapshot, the last one by default; what a project's partition held before or after is not seen."""
        snapshot = self.latest() if snapshot is None else snapshot
        if snapshot is None:
            raise NotLoaded("the store has no snapshot")
        facts = self._read("facts", f"{self.schema}, made_in long")
        if facts is None:
            return self.spark.createDataFrame([], self.schema)
        told = F.coalesce(*(F.col(c).cast("string") for c in self._columns() if c != "project"))
        return facts.where(told.isNotNull()).join(self.projects(snapshot), ["project", "made_in"], "left_semi").select(*self._columns())

    def refresh(self, files: DataFrame, references: DataFrame) -> tuple[int, int]:
        """Make the next snapshot of ``files(path, digest, project, ...)``: its number, and how many projects were worked out again.

        ``references(src, dst)``: src refers to dst, so it is stale when dst is. Without a change there is no new snapshot.
        """
        now = files.select("path", "digest", "project")
        last = self.latest()
        if last is None:
            stale, n = cut_and_count(now.select("project").distinct())
        else:
            before = self._read("files", _FILES).where((F.col("snapshot") == last) & F.col("path").isNotNull()).select("path", "digest", "project")
            changes = _moves(before, now)
            places = before.select("path", "project").unionByName(now.select("path", "project")).distinct()
            stale, n = cut_and_count(stale_projects(changes, places, references).select(F.col("node").cast("string").alias("project")))
            if not n:
                return last, 0
        snapshot = 0 if last is None else last + 1
        # a row without facts for each stale project, so that what a failed refresh has left there goes
        made = self.extract(files.join(stale, "project", "left_semi")).select(*self._columns()).unionByName(stale, allowMissingColumns=True)
        _put(made.withColumn("made_in", F.lit(snapshot).cast("long")), f"{self.path}/facts", "made_in", "project")
        marker = self.spark.createDataFrame([(None,)], "project string")  # a snapshot without files is one too
        _put(now.withColumn("snapshot", F.lit(snapshot).cast("long")).unionByName(marker.withColumn("snapshot", F.lit(snapshot).cast("long")), allowMissingColumns=True), f"{self.path}/files", "snapshot")
        kept = now.select("project").distinct().join(stale.withColumn("made_in", F.lit(snapshot).cast("long")), "project", "left")
        if last is not None:
            kept = kept.join(self.projects(last).withColumnRenamed("made_in", "before"), "project", "left").select("project", F.coalesce("made_in", "before").alias("made_in"))
        _put(cut(kept.select("project", "made_in")).unionByName(marker, allowMissingColumns=True).withColumn("snapshot", F.lit(snapshot).cast("long")), f"{self.path}/projects", "snapshot")
        return snapshot, n


def _moves(before: DataFrame, now: DataFrame) -> DataFrame:
    """``(path, change)``; a file that went from one project to another has changed."""
    keyed = lambda df: df.select("path", F.concat_ws(":", "project", "digest").alias("digest"))
    return manifest_diff(keyed(before), keyed(now))
