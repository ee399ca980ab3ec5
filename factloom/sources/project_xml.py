"""Project files by Spark's XML source: one row for each project element, whole; what is broken is told, not read in part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.shared import cut

_PACKAGE = "_Include string, _Version string, Version string"
_REFERENCE = "_Include string"
_GROUP = f"PackageReference array<struct<{_PACKAGE.replace(' string', ': string')}>>, ProjectReference array<struct<{_REFERENCE.replace(' string', ': string')}>>"
#: What is read of a project; ``_corrupt`` holds the text of one that is not well formed.
SCHEMA = f"_Sdk string, _xmlns string, ItemGroup array<struct<{_GROUP.replace('PackageReference array', 'PackageReference: array').replace('ProjectReference array', 'ProjectReference: array')}>>, _corrupt string"


def project_rows(spark: SparkSession, path: str) -> DataFrame:
    """``(path, _Sdk, _xmlns, ItemGroup, _corrupt)`` of the files below ``path``; comments are no elements. A file without a whole project element has no row; an empty file is not seen."""
    reader = spark.read.format("xml").schema(SCHEMA).option("rowTag", "Project").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", True)
    return reader.load(path).select(F.col("_metadata.file_path").alias("path"), "*")


def packages(spark: SparkSession, path: str) -> DataFrame:
    """``(path, name, version)`` of the package references of whole projects: the version is the attribute, else the element, else ``*``."""
    groups = project_rows(spark, path).where("_corrupt is null").select("path", F.explode("ItemGroup").alias("g"))
    one = groups.select("path", F.explode("g.PackageReference").alias("p")).where("p._Include is not null")
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    return one.select("path", F.col("p._Include").alias("name"), F.coalesce(some("p._Version"), some("p.Version"), F.lit("*")).alias("version"))


def references(spark: SparkSession, path: str) -> DataFrame:
    """``(src, dst)``: which project file refers to which, both as paths; ``..`` and backslashes are resolved."""
    groups = project_rows(spark, path).where("_corrupt is null").select("path", F.explode("ItemGroup").alias("g"))
    one = groups.select("path", F.explode("g.ProjectReference").alias("p")).where("p._Include is not null")
    folder = F.regexp_replace("path", r"/[^/]*$", "")
    parts = F.split(F.concat(folder, F.lit("/"), F.replace("p._Include", F.lit("\\"), F.lit("/"))), "/")
    up = lambda done, step: F.when(step == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(step == ".", done).otherwise(F.concat(done, F.array(step)))
    return one.select(F.col("path").alias("src"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/").alias("dst")).distinct()


def broken(spark: SparkSession, path: str) -> DataFrame:
    """``(path)`` of files of which no whole project could be read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("_metadata.file_path").alias("path"))
    # Spark reads what is corrupt only along with other columns
    rows = cut(project_rows(spark, path).select("path", "_Sdk", "_corrupt"))
    return files.join(rows.where("_corrupt is null").select("path").distinct(), "path", "left_anti")
