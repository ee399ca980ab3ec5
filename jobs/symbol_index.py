"""Keep an index of what source files declare, and their metrics, up to date with a table of files.

    python -m jobs.symbol_index --documents PATH --output PATH [--config jobs/symbol_index.json]

The output has two tables, both partitioned by project and by a slice of the files (a hash of their ids): ``symbols``
(what a file declares, where first and how often) and ``files`` (digest and metrics of each file). ``files`` is also the mark:
a run compares its digests with those of the documents, and reads texts and writes again only in the slices in which a file was
added, removed or changed. ``symbols`` is written before ``files``; a run that fails in between is seen by the next one as not having
happened, which writes the same slices again. A run without changes writes nothing.

Each slice holds one row without a file, so that a slice whose files are all gone is overwritten too.
"""

from __future__ import annotations

import argparse
import json
import logging
import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from factloom.operators.shared import cut_and_count
from factloom.streaming.changes import manifest_diff

log = logging.getLogger("jobs.symbol_index")

CONFIG = os.path.join(os.path.dirname(os.path.abspath(__file__)), "symbol_index.json")
FILES = "file long, digest string, n_lines long, n_words long, score long, generated boolean, project string, slice int"
SYMBOLS = "file long, name string, line int, n long, project string, slice int"
PLACE = ["project", "slice"]
NO_PROJECT = "(none)"


def load_config(path: str = CONFIG) -> dict:
    """The settings of a JSON file: slices, declaration, branch, generated."""
    with open(path) as f:
        return json.load(f)


def read_output(spark: SparkSession, output: str, table: str) -> DataFrame | None:
    """A table of the output without the rows that have no file; None before the first run."""
    try:
        return spark.read.schema({"files": FILES, "symbols": SYMBOLS}[table]).parquet(f"{output}/{table}").where("file is not null")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_documents(spark: SparkSession, path: str, slices: int) -> DataFrame:
    """``(file, text, digest, project, slice)``; rows without an id are no files, and a null text is empty."""
    project = F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.lit(NO_PROJECT))
    rows = spark.read.parquet(path).where("doc_id is not null").select(F.col("doc_id").cast("long").alias("file"), F.coalesce("text", F.lit("")).alias("text"), project.alias("project"))
    return rows.select("file", "text", F.sha2("text", 256).alias("digest"), "project", F.pmod(F.xxhash64("file"), F.lit(slices)).cast("int").alias("slice"))


def _manifest(rows: DataFrame) -> DataFrame:
    """``(path, digest)``, one row for each file; rows that share an id are one file of several parts."""
    part = F.concat_ws(":", "project", "digest")
    return rows.groupBy(F.col("file").alias("path")).agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(part))), 256).alias("digest"))


def stale_slices(before: DataFrame, now: DataFrame) -> DataFrame:
    """``(project, slice)`` in which a file of ``before`` or ``now`` is not the same in both."""
    changed = manifest_diff(_manifest(before), _manifest(now)).select(F.col("path").alias("file"))
    places = before.select("file", *PLACE).unionByName(now.select("file", *PLACE))
    return places.join(changed, "file", "left_semi").select(*PLACE).distinct()


def metrics(docs: DataFrame, config: dict) -> DataFrame:
    """One row for each document, as ``FILES``."""
    return docs.select(
        "file",
        "digest",
        F.regexp_count("text", F.lit(r"\n")).cast("long").alias("n_lines"),
        F.regexp_count("text", F.lit(r"[^ \t\r\n]+")).cast("long").alias("n_words"),
        (1 + F.regexp_count("text", F.lit(config["branch"]))).cast("long").alias("score"),
        F.contains(F.lower(F.substring("text", 1, 1024)), F.lit(config["generated"])).alias("generated"),
        *PLACE,
    )


def declarations(docs: DataFrame, config: dict) -> DataFrame:
    """What each file declares, as ``SYMBOLS``: names that a line begins with, with the first line and how many there are."""
    lines = docs.select("file", *PLACE, F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    named = lines.select("file", *PLACE, F.regexp_extract("raw", config["declaration"], 1).alias("name"), (F.col("at") + 1).alias("line")).where("name <> ''")
    return named.groupBy("file", *PLACE, "name").agg(F.min("line").cast("int").alias("line"), F.count("*").alias("n"))


def _write(rows: DataFrame, markers: DataFrame, path: str) -> int:
    """Overwrite the slices of ``markers``; how many rows went in, markers left out."""
    seen = Observation()
    both = rows.observe(seen, F.count("*").alias("n")).unionByName(markers, allowMissingColumns=True)
    both.hint("rebalance", *PLACE).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PLACE).parquet(path)
    return seen.get["n"]


def run(spark: SparkSession, documents: str, output: str, config: dict) -> dict:
    """Bring ``output`` up to date with ``documents``; what was read and written, in numbers."""
    docs = read_documents(spark, documents, config["slices"])
    before = read_output(spark, output, "files")
    places = docs.select(*PLACE).distinct() if before is None else stale_slices(before, docs)
    stale, n_stale = cut_and_count(places)
    told = {"first": before is None, "stale_slices": n_stale, "files": 0, "symbols": 0}
    if n_stale or before is None:
        due = docs if before is None else docs.join(stale, PLACE, "left_semi")
        told["symbols"] = _write(declarations(due, config), stale, f"{output}/symbols")
        told["files"] = _write(metrics(due, config), stale, f"{output}/files")
    log.info("read %s: %d slices to write again; wrote %d files and %d symbols to %s", documents, n_stale, told["files"], told["symbols"], output)
    return told


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    parser.add_argument("--documents", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--config", default=CONFIG)
    given = parser.parse_args()
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("symbol_index").getOrCreate()
    try:
        run(spark, given.documents, given.output, load_config(given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
