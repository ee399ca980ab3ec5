"""Solution and project files: lists of projects, references, packages, kinds."""

from __future__ import annotations

import posixpath
import re
import xml.etree.ElementTree as ET
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.errors import FileNotFound, InvalidArgument
from factloom.functions.predicates import glob_regex
from factloom.operators.graph import reach

_SLN_PROJECT = re.compile(r"""^Project\(["'][^"']*["']\)\s*=\s*["']([^"']*)["'],\s*["']([^"']*\.(?:cs|vb|fs)proj)["']""", re.M)


def _join(base: str, path: str) -> str:
    return posixpath.normpath(posixpath.join(posixpath.dirname(base), path.replace("\\", "/")))


def _parse(text: str) -> ET.Element | None:
    try:
        return ET.fromstring(text.removeprefix("﻿"))
    except ET.ParseError:
        return None


def solution_projects(path: str, text: str) -> list[str]:
    """Project paths of a ``.sln`` or ``.slnx`` file; none if it can't be read."""
    if path.lower().endswith(".slnx"):
        root = _parse(text)
        return [] if root is None else [_join(path, p.get("Path")) for p in root.iter("Project") if p.get("Path")]
    return [_join(path, m[2]) for m in _SLN_PROJECT.finditer(text)]


def project_kind(text: str | None) -> str:
    """SdkStyle, Legacy, Unknown or Missing."""
    root = None if text is None else _parse(text)
    if root is None:
        return "Missing" if text is None else "Unknown"
    if root.get("Sdk") or any(x.tag.rpartition("}")[2] == "Sdk" for x in root):
        return "SdkStyle"
    return "Legacy" if root.tag.startswith("{http://schemas.microsoft.com/developer/msbuild/") else "Unknown"


def project_facts(path: str, text: str) -> list[tuple[str, str, str]]:
    """``(kind, name, version)`` of references and packages; a package's version is its attribute, else its element, else ``*``."""
    root = _parse(text)
    out = []
    for x in root.iter() if root is not None else ():
        tag = x.tag.rpartition("}")[2]
        if tag == "ProjectReference" and x.get("Include"):
            out.append(("reference", _join(path, x.get("Include")), ""))
        elif tag == "PackageReference" and x.get("Include"):
            child = next((c.text for c in x if c.tag.rpartition("}")[2] == "Version"), None)
            out.append(("package", x.get("Include"), x.get("Version") or child or "*"))
    return out


def is_test_project(text: str) -> bool:
    """Whether it refers to a package of a known test framework."""
    return bool(re.search(r'PackageReference\s+Include="(xunit|nunit|mstest)', text, re.I))


def find_solution(folder: str) -> str | None:
    """The solution file nearest above a local folder, or in it: of several the one with the shortest path, then the first by name."""
    here = Path(folder).resolve()
    for place in (here, *here.parents):
        found = sorted((len(str(p)), str(p)) for p in place.iterdir() if p.suffix in (".sln", ".slnx")) if place.is_dir() else []
        if found:
            return found[0][1]
    return None


def require_file(path: str) -> str:
    """The path, or an error if no such file is there."""
    if not Path(path).is_file():
        raise FileNotFound("no such file", path=path)
    return path


def _without_comments(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<!--.*?-->", "")


def _well_formed(text: Column) -> Column:
    """Whether the text is one XML element, to its end."""
    return F.trim(F.regexp_replace(text, "\ufeff", "")).rlike(r"(?s)^(?:<\?.*?\?>\s*)?<Project\b.*(?:</Project>|/>)\s*$")


def packages(projects: DataFrame) -> DataFrame:
    """``(path, name, version)`` of ``projects(path, text)``, in the JVM; commented elements do not count, and text that is cut off gives none.

    A version is the attribute, else the element, else ``*``; names are taken as they stand, in single or double quotes.
    """
    body = projects.where(_well_formed(F.col("text"))).select("path", _without_comments(F.col("text")).alias("text"))
    nodes = F.expr(r"regexp_extract_all(text, '(?s)<PackageReference\\b[^>]*?(?:/>|>.*?</PackageReference>)', 0)")
    one = body.select("path", F.explode(nodes).alias("x"))
    attribute = lambda name: F.nullif(F.regexp_extract("x", rf"""^<PackageReference\b[^>]*?\b{name}\s*=\s*["']([^"']*)["']""", 1), F.lit(""))
    child = F.nullif(F.trim(F.regexp_extract("x", r"<Version>([^<]*)</Version>", 1)), F.lit(""))
    return one.select("path", attribute("Include").alias("name"), F.coalesce(attribute("Version"), child, F.lit("*")).alias("version")).where("name is not null")


def project_table(projects: DataFrame) -> DataFrame:
    """``(path, kind, is_test)`` of ``projects(path, text)``: SdkStyle, Legacy, Unknown or Missing (no text), and whether it refers to a test framework's package."""
    text = _without_comments(F.col("text"))
    head = F.regexp_extract(text, r"(?s)(<Project\b[^>]*>)", 1)
    kind = (
        F.when(F.col("text").isNull(), "Missing")
        .when(~_well_formed(F.col("text")), "Unknown")
        .when(head.rlike(r"\bSdk\s*=") | text.rlike(r"<Sdk\b"), "SdkStyle")
        .when(head.contains("http://schemas.microsoft.com/developer/msbuild/"), "Legacy")
        .otherwise("Unknown")
    )
    test = F.coalesce(text.rlike(r"(?i)PackageReference\s+Include=[\"'](?:xunit|nunit|mstest)"), F.lit(False))
    return projects.select("path", kind.alias("kind"), test.alias("is_test"))


def markup_map(markup: DataFrame, generated: DataFrame) -> DataFrame:
    """``(markup, generated)``: of ``markup(path)``, .razor and .cshtml files, and ``generated(path)`` the first generated file whose name is that of the markup file, with or without its folders, in the generator's spelling."""
    hint = lambda c: F.regexp_replace(F.lower(F.replace(c, F.lit("\\"), F.lit("/"))), r"[^a-z0-9]+", "_")
    named = markup.where(F.lower("path").rlike(r"\.(?:razor|cshtml)$")).select(F.col("path").alias("markup"), F.split(F.replace("path", F.lit("\\"), F.lit("/")), "/").alias("parts"))
    # every ending of the path, longest first: one of them is the generated file's hint
    ends = named.withColumn("skip", F.explode(F.sequence(F.lit(1), F.size("parts")))).select("markup", "skip", hint(F.array_join(F.slice("parts", F.col("skip"), F.size("parts")), "/")).alias("hint"))
    files = generated.where(F.lower("path").endswith(".g.cs")).select(F.col("path").alias("generated"), F.regexp_replace(hint(F.element_at(F.split("path", r"[/\\\\]"), -1)), "_g_cs$", "").alias("hint"))
    return ends.join(files, "hint").groupBy("markup").agg(F.min(F.struct("skip", "generated"))["generated"].alias("generated"))


def ingest(projects: list[str], load, retries: int = 1) -> tuple[list, list[tuple[str, str]]]:
    """What ``load(project)`` gives for each project, and ``(project, reason)`` of those skipped: one that fails is tried again, and does not stop the others."""
    loaded, skipped = [], []
    for project in projects:
        for attempt in range(retries + 1):
            try:
                loaded.append(load(project))
                break
            except Exception as e:  # reported as skipped
                if attempt == retries:
                    skipped.append((project, str(e)))
    return loaded, skipped


def filtered_projects(spark: SparkSession, projects: list[str], references: DataFrame, include: list[str] | None = None, roots: list[str] | None = None) -> DataFrame:
    """``(node)``: projects that a glob matches or that are named, and all they refer to; no match is an error."""
    rows = spark.createDataFrame([(p,) for p in projects], "node string")
    wanted = F.lit(False)
    for glob in include or []:
        wanted = wanted | F.element_at(F.split("node", "/"), -1).rlike(glob_regex(glob + ("" if glob.lower().endswith(".csproj") else ".csproj")))
    if roots:
        wanted = wanted | F.lower("node").isin([r.lower() for r in roots])
    seeds = rows.where(wanted)
    if seeds.isEmpty():
        raise InvalidArgument("no project matches", include=include, rootProjects=roots)
    return reach(references, seeds).select("node")
