"""Report the health of projects: what is unused, obsolete but used, misnamed, large, coupled or untested, with the worst of each.

    python -m jobs.health_report --symbols PATH --uses PATH --output PATH --label 2024-05-01 [--config jobs/health_report.json]

Symbols are rows of a table with id, name, project and size; uses are rows that name a symbol, a file, a user and a weight, and
the order of uses within a file makes calls. The report has a row for each of the worst items of a project in a
dimension, with how many there are, and one row (project ``*``, site 0) with the total of each dimension. It is written below
``label=...`` and ``dimension=...``; writing a label again replaces its dimensions, and leaves other labels alone.
"""

from __future__ import annotations

import argparse
import json
import logging
import os
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators import code_queries as Q
from factloom.operators.shared import cut_and_count

log = logging.getLogger("jobs.health_report")

CONFIG = os.path.join(os.path.dirname(os.path.abspath(__file__)), "health_report.json")
REPORT = "project string, n long, site int, item long, weight double, label string, dimension string"
DIMENSIONS = ["unused", "obsolete", "naming", "large", "coupled", "uncovered"]
ALL = "*"


def load_config(path: str = CONFIG) -> dict:
    """The settings of a JSON file: thresholds, and how many items a project has in each dimension."""
    with open(path) as f:
        return json.load(f)


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    """``(id, name, project, size)``."""
    return spark.read.parquet(path).where("p_partkey is not null").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.coalesce("p_brand", F.lit("")).alias("project"), F.col("p_size").alias("size"))


def read_uses(spark: SparkSession, path: str) -> DataFrame:
    """``(id, file, user, weight, at, place)``; ``place`` is a total order within a file."""
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    return spark.read.parquet(path).where("l_partkey is not null").select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("file"), F.col("l_suppkey").alias("user"), F.col("l_quantity").alias("weight"), F.col("l_shipdate").alias("at"), place.alias("place"))


def calls(uses: DataFrame, least: float) -> DataFrame:
    """``(src, dst)``: of uses with at least this weight, one symbol and the next in the file."""
    order = Window.partitionBy("file").orderBy("place")
    rows = uses.where(F.col("weight") >= least).select(F.col("id").alias("src"), F.lead("id").over(order).alias("dst"))
    return rows.where("dst is not null and src <> dst").distinct()


def findings(symbols: DataFrame, uses: DataFrame, config: dict) -> DataFrame:
    """``(dimension, project, item, weight)`` of every dimension; the heavier the worse."""
    of = symbols.select("id", "project", "size")
    recent = uses.where((F.col("weight") >= config["call_weight"]) & (F.col("at") >= F.lit(config["recent"]).cast("timestamp")))
    old = symbols.select("id", "name", (F.col("size") >= config["error_size"]).alias("is_error"), "size").where(F.col("size") >= config["obsolete_size"])
    sizes = uses.groupBy(F.col("id").alias("type")).agg(F.count("*").alias("lines"), F.countDistinct("file").alias("members"), F.countDistinct("user").alias("users"))
    users = uses.select(F.col("id").alias("type"), F.lit("in").alias("way"), F.col("user").alias("ns"))
    tests = symbols.where(F.col("project") == config["test_project"]).select(F.col("id").alias("node"))
    candidates = symbols.where(F.col("project") != config["test_project"]).select(F.col("id").alias("node"))
    found = {
        "unused": Q.unused(of, recent.select("id"), [("generated", F.col("size") >= config["generated_size"])]).where("excused is null").select("id", F.col("size").alias("weight")),
        "obsolete": Q.obsolete_usage(old, uses.select(F.col("id").alias("target"), "file")).select("id", F.col("n").alias("weight")),
        "naming": symbols.where(~F.coalesce("name", F.lit("")).rlike(config["name"])).select("id", F.length(F.coalesce("name", F.lit(""))).alias("weight")),
        "large": Q.large_types(sizes, config["max_members"], config["max_lines"]).select(F.col("type").alias("id"), F.col("size").alias("weight")),
        "coupled": Q.god_objects(sizes, {"lines": config["coupled_lines"], "members": config["coupled_members"]}, users, config["coupled_users"], config["coupled_users"]).select(F.col("type").alias("id"), F.col("n_in").alias("weight")),
        "uncovered": Q.uncovered(candidates, calls(uses, config["call_weight"]), tests).select(F.col("node").alias("id"), F.lit(1).alias("weight")),
    }
    rows = [df.select(F.lit(name).alias("dimension"), "id", F.col("weight").cast("double").alias("weight")) for name, df in found.items()]
    return reduce(DataFrame.unionByName, rows).join(of, "id").select("dimension", "project", F.col("id").alias("item"), "weight")


def run(spark: SparkSession, symbols: str, uses: str, output: str, label: str, config: dict) -> dict:
    """Write the report of ``label``; what was read and written, in numbers."""
    facts, n = cut_and_count(findings(read_symbols(spark, symbols), read_uses(spark, uses), config))
    worst = Q.health(facts, config["hotspots"]).select("dimension", "project", "n", "site", "item", "weight")
    every = spark.createDataFrame([(d,) for d in DIMENSIONS], "dimension string").join(facts.groupBy("dimension").agg(F.count("*").alias("n")), "dimension", "left")
    totals = every.select("dimension", F.lit(ALL).alias("project"), F.coalesce("n", F.lit(0)).alias("n"), F.lit(0).alias("site"))
    seen = Observation()
    report = worst.unionByName(totals, allowMissingColumns=True).withColumn("label", F.lit(label)).observe(seen, F.count("*").alias("n"))
    report.repartition("dimension").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("label", "dimension").parquet(output)
    log.info("read %s and %s: %d findings; wrote %d rows to %s, label %s", symbols, uses, n, seen.get["n"], output, label)
    return {"findings": n, "rows": seen.get["n"]}


def read_output(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(REPORT).parquet(output)


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("symbols", "uses", "output", "label"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", default=CONFIG)
    given = parser.parse_args()
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("health_report").getOrCreate()
    try:
        run(spark, given.symbols, given.uses, given.output, given.label, load_config(given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
