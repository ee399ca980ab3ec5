"""Loaded snapshots by name, the active one, and background tasks."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.errors import AmbiguousMatch, InvalidArgument, NotLoaded, ProjectNotFound

#: Seconds for which a finished task is listed, and kept.
LISTED_S, KEPT_S = 300, 3600


@dataclass
class Catalog:
    """Fact tables of each snapshot; queries take one snapshot and see only its tables."""

    spark: SparkSession
    loaded: dict[str, dict[str, DataFrame]] = field(default_factory=dict)
    active: str | None = None
    makers: dict[str, Callable[[], dict[str, DataFrame]]] = field(default_factory=dict)
    skipped: dict[str, list[tuple[str, str]]] = field(default_factory=dict)
    broken: dict[str, str] = field(default_factory=dict)

    def load(self, name: str, tables: dict[str, DataFrame] | Callable[[], dict[str, DataFrame]], skipped: list[tuple[str, str]] = ()) -> None:
        """Add or replace a snapshot and make it the active one; given as what makes its tables, it can be rebuilt. ``skipped`` are projects that could not be read, and why."""
        if callable(tables):
            self.makers[name] = tables
            tables = tables()
        else:
            self.makers.pop(name, None)
        self.loaded[name] = tables
        self.skipped[name] = list(skipped)
        self.broken.pop(name, None)
        self.active = name

    def rebuild(self, name: str | None = None) -> str:
        """Make a snapshot's tables anew, the active one's by default; queries see the old ones until all are there, and go on with them if that fails."""
        name = name or self.active
        if name not in self.loaded:
            raise NotLoaded("no such snapshot is loaded", name=name)
        if name not in self.makers:
            raise InvalidArgument("this snapshot was given as tables", name=name)
        try:
            self.loaded[name] = self.makers[name]()
        except Exception as e:
            self.broken[name] = str(e)
            raise
        self.broken.pop(name, None)
        return name

    def activate(self, part: str) -> str:
        """The one snapshot whose name holds ``part``, ignoring case."""
        found = [n for n in self.loaded if part.lower() in n.lower()]
        if len(found) != 1:
            raise (AmbiguousMatch if found else ProjectNotFound)(f"{len(found)} snapshots match", name=part, found=found)
        self.active = found[0]
        return found[0]

    def unload(self, name: str) -> None:
        """Forget a snapshot; the first of the rest becomes active."""
        if self.loaded.pop(name, None) is None:
            raise ProjectNotFound("not loaded", name=name)
        for known in (self.makers, self.skipped, self.broken):
            known.pop(name, None)
        if self.active == name:
            self.active = next(iter(self.loaded), None)

    def table(self, name: str) -> DataFrame:
        if self.active is None:
            raise NotLoaded("no snapshot is loaded")
        return self.loaded[self.active][name]

    def listing(self, limit: int = 50) -> DataFrame:
        """``(path, active, tables, status, skipped)`` in order of path; status: ready, empty, or error after a rebuild that failed."""
        status = lambda n: "error" if n in self.broken else "ready" if self.loaded[n] else "empty"
        rows = [(n, n == self.active, len(t), status(n), len(self.skipped.get(n, ()))) for n, t in sorted(self.loaded.items())]
        return self.spark.createDataFrame(rows[:limit], "path string, active boolean, tables int, status string, skipped int")

    def sizes(self) -> DataFrame:
        """``(path, facts)``: how many rows the tables of each snapshot have."""
        rows = self.spark.createDataFrame([], "path string, n long")
        for name, tables in self.loaded.items():
            for table in tables.values():
                rows = rows.unionByName(table.agg(F.count("*").alias("n")).select(F.lit(name).alias("path"), "n"))
        return rows.groupBy("path").agg(F.sum("n").alias("facts"))


@dataclass
class Tasks:
    """Allowed jobs in threads of their own; with a session, each has a job group, so that its Spark jobs can be told apart and cancelled."""

    allowed: dict[str, Callable[[], object]]
    known: dict[str, dict] = field(default_factory=dict)
    spark: SparkSession | None = None

    def start(self, tool: str) -> str:
        if tool not in self.allowed:
            raise InvalidArgument("not a background task", tool=tool)
        task = uuid.uuid4().hex
        row = self.known[task] = {"tool": tool, "status": "running", "started": time.time(), "ended": None, "result": None, "error": None, "cancelled": False}

        def run() -> None:
            if self.spark:
                self.spark.sparkContext.setJobGroup(task, tool, interruptOnCancel=True)
            try:
                result = self.allowed[tool]()
                row["result"], row["status"] = result, "cancelled" if row["cancelled"] else "completed"
            except Exception as e:  # reported by status()
                row["error"], row["status"] = str(e), "cancelled" if row["cancelled"] else "failed"
            row["ended"] = time.time()

        thread = InheritableThread(target=run, daemon=True) if self.spark else threading.Thread(target=run, daemon=True)
        thread.start()
        row["thread"] = thread
        return task

    def status(self, task: str) -> dict:
        self._evict()
        if task not in self.known:
            raise InvalidArgument("unknown task", taskId=task)
        return {k: v for k, v in self.known[task].items() if k != "thread"}

    def cancel(self, task: str) -> None:
        """Cancel a task's Spark jobs, those that run and those that it would start; one that has ended stays as it is."""
        if self.spark is None:
            raise InvalidArgument("tasks without a session cannot be cancelled", taskId=task)
        if self.status(task)["ended"] is None:
            self.known[task]["cancelled"] = True
            self.spark.sparkContext.cancelJobGroupAndFutureJobs(task) if hasattr(self.spark.sparkContext, "cancelJobGroupAndFutureJobs") else self.spark.sparkContext.cancelJobGroup(task)

    def jobs(self, task: str) -> dict[int, str]:
        """The Spark jobs of a task and how each is: RUNNING, SUCCEEDED, FAILED."""
        self.status(task)
        if self.spark is None:
            return {}
        tracker = self.spark.sparkContext.statusTracker()
        found = {j: tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(task)}
        return {j: info.status for j, info in sorted(found.items()) if info}

    def running(self) -> list[str]:
        self._evict()
        return [t for t, r in self.known.items() if r["ended"] is None or time.time() - r["ended"] < LISTED_S]

    def _evict(self) -> None:
        for t in [t for t, r in self.known.items() if r["ended"] and time.time() - r["ended"] > KEPT_S]:
            del self.known[t]
