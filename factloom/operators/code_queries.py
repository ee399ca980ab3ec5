"""The query tools as functions of role-named columns, so that any fact table with these roles will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from factloom.errors import InvalidArgument
from factloom.functions.predicates import match_rank, scope_matches

from .envelope import first_by, first_sites
from .graph import reach, shortest_chains


def search_symbols(symbols: DataFrame, query: str) -> DataFrame:
    """Symbols ``(id, name)`` whose name holds the query, with their rank: exact, prefix, substring."""
    return symbols.withColumn("rank", match_rank(F.col("name"), query)).where("rank is not null")


def references(occurrences: DataFrame, targets: DataFrame, kinds: list[str] | None, known: list[str]) -> DataFrame:
    """Occurrences ``(target, file, line, col, kind, ...)`` of the target ids, one for each place; kinds are checked first."""
    unknown = [k for k in kinds or [] if k.lower() not in known]
    if unknown:
        raise InvalidArgument(f"unknown kinds: {unknown}", kinds=unknown)
    found = occurrences.join(targets, "target", "left_semi")
    places = first_by(found, ["file", "line", "col"], [c for c in found.columns if c not in ("file", "line", "col")])
    return places.where(F.lower("kind").isin([k.lower() for k in kinds])) if kinds else places


def callers(occurrences: DataFrame, targets: DataFrame) -> DataFrame:
    """Places that use one of the targets, one for each (file, line)."""
    found = occurrences.join(targets, "target", "left_semi")
    return found.groupBy("file", "line").agg(F.min("project").alias("project"), F.count("*").alias("n"))


def change_impact(refs: DataFrame, calls: DataFrame) -> DataFrame:
    """Files and projects that references or calls touch: ``(kind, name)``, each once."""
    both = refs.select("file", "project").unionByName(calls.select("file", "project"))
    return both.select(F.explode(F.array(F.struct(F.lit("file").alias("kind"), F.lower(F.col("file").cast("string")).alias("name")), F.struct(F.lit("project").alias("kind"), F.lower(F.col("project").cast("string")).alias("name")))).alias("x")).select("x.*").distinct()


def unused(symbols: DataFrame, refs: DataFrame, reasons: list[tuple[str, Column]]) -> DataFrame:
    """Symbols without a reference, and the first reason that excuses each one (null: none)."""
    reason = F.coalesce(*(F.when(test, F.lit(name)) for name, test in reasons)) if reasons else F.lit(None)
    return symbols.join(refs.select("id").distinct(), "id", "left_anti").withColumn("excused", reason)


def obsolete_usage(symbols: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Uses of obsolete symbols ``(id, name, is_error)``: ``(name, is_error, n, first_file)``; unused ones are left out."""
    return symbols.join(occurrences, symbols["id"] == occurrences["target"]).groupBy("id", "name", "is_error").agg(F.count("*").alias("n"), F.min("file").alias("first_file"))


def breaking_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Entries ``(name, kind, access, seq)`` of two surfaces compared by name, the last of each name: ``(severity, change, name)``.

    A change of kind hides one of access; a smaller access number is wider.
    """
    last = lambda df: df.groupBy("name").agg(F.max(F.struct("seq", "kind", "access")).alias("e")).select("name", "e.kind", "e.access")
    a, b = last(before).alias("a"), last(after).alias("b")
    change = (
        F.when(F.col("b.kind").isNull(), "Removed")
        .when(F.col("a.kind").isNull(), "Added")
        .when(F.col("a.kind") != F.col("b.kind"), "KindChanged")
        .when(F.col("a.access") < F.col("b.access"), "AccessibilityNarrowed")
        .when(F.col("a.access") > F.col("b.access"), "AccessibilityWidened")
    )
    out = a.join(b, F.col("a.name") == F.col("b.name"), "full_outer").select(F.coalesce("a.name", "b.name").alias("name"), change.alias("change")).where("change is not null")
    return out.withColumn("severity", F.when(F.col("change").isin("Added", "AccessibilityWidened"), "NonBreaking").otherwise("Breaking"))


def architecture(edges: DataFrame, rules: list[dict], max_sites: int) -> DataFrame:
    """Violations of rules over edges ``(source, target, file, line)``: ``(rule, source, target, n, site, file, line)``.

    A rule forbids, or allows only, targets of patterns for sources of a pattern; self edges never count. Rules become predicates of one scan.
    """
    broken = []
    for i, rule in enumerate(rules):
        if rule["kind"] not in ("forbid", "allowOnly"):
            raise InvalidArgument("unknown kind of rule", ruleIndex=i, kind=rule["kind"])
        hit = F.lit(False)
        for pattern in rule["to"]:
            hit = hit | scope_matches(F.col("target"), pattern)
        broken.append(F.when(scope_matches(F.col("source"), rule["from"]) & (hit if rule["kind"] == "forbid" else ~hit), F.lit(rule["name"])))
    hits = edges.where("source <> target").withColumn("rule", F.explode(F.array_compact(F.array(*broken))))
    counts = hits.groupBy("rule", "source", "target").agg(F.count("*").alias("n"))
    return first_sites(hits, ["rule", "source", "target"], ["file", "line", "tie"], max_sites).join(counts, ["rule", "source", "target"]).select("rule", "source", "target", "n", "site", "file", "line")


def large_types(members: DataFrame, max_members: int, max_lines: int) -> DataFrame:
    """Types of ``(type, members, lines)`` with at least so many members or lines."""
    return members.where((F.col("members") >= max_members) | (F.col("lines") >= max_lines)).withColumn("size", F.greatest("members", "lines"))


def god_objects(sizes: DataFrame, axes: dict[str, int], coupling: DataFrame, least_in: int, least_out: int) -> DataFrame:
    """Types over every size axis and over one coupling axis; only suspects are joined with ``coupling(type, way, ns)``."""
    suspects = sizes
    for axis, least in axes.items():
        suspects = suspects.where(F.col(axis) > least)
    spaces = coupling.join(suspects.select("type"), "type", "left_semi").groupBy("type").agg(
        F.countDistinct(F.when(F.col("way") == "in", F.col("ns"))).alias("n_in"), F.countDistinct(F.when(F.col("way") == "out", F.col("ns"))).alias("n_out")
    )
    return suspects.join(spaces, "type").where((F.col("n_in") >= least_in) | (F.col("n_out") >= least_out))


def innermost(points: DataFrame, spans: DataFrame) -> DataFrame:
    """For each point ``(scope, at, id)`` the innermost span ``(scope, start, stop, span)`` that holds it, if any: ``(scope, at, id, span, start)``.

    A span holds from its start to before its stop; spans of a scope nest or are apart, and one without a stop holds nothing.
    Two passes over a scope's starts, stops and points in order: the first gives each span's depth and what encloses it, the second
    each point the last border before it. Work grows with the rows, not with points times spans.
    """
    kept = spans.where("start < stop").select("scope", "start", "stop", "span")
    me = F.struct("start", "span")
    nothing = F.lit(None).cast(kept.select(me.alias("x")).schema["x"].dataType)
    # at one place stops come before starts, inner stops first; of starts the outer one first
    opens = kept.select("scope", F.col("start").alias("at"), F.lit(1).alias("step"), F.col("stop").alias("far"), me.alias("me"))
    closes = kept.select("scope", F.col("stop").alias("at"), F.lit(-1).alias("step"), F.col("start").alias("far"), me.alias("me"))
    order = [F.col("at"), F.col("step"), F.col("far").desc(), (F.col("me.span") * F.col("step")) if _numeric(kept, "span") else F.col("me.span")]
    borders = opens.unionByName(closes)
    running = Window.partitionBy("scope").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    deep = borders.withColumn("depth", F.sum("step").over(running))
    # a start is the innermost span from there on; after a stop it is the last start of the depth that is left
    level = Window.partitionBy("scope", "depth").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    opened = F.last(F.when(F.col("step") > 0, F.col("me")), ignorenulls=True).over(level)
    inner = deep.select("scope", "at", F.lit(0).alias("late"), F.col("depth"), *[F.col(c) for c in ("step", "far", "me")], F.when(F.col("depth") > 0, opened).otherwise(nothing).alias("inner"), F.lit(True).alias("border"))
    asked = points.select("scope", "at", "id")
    both = inner.select("scope", "at", "late", "step", "far", "me", F.lit(None).cast(asked.schema["id"].dataType).alias("id"), "inner", "border").unionByName(
        asked.select("scope", "at", F.lit(1).alias("late"), F.lit(0).alias("step"), F.lit(None).cast(kept.schema["stop"].dataType).alias("far"), nothing.alias("me"), "id", nothing.alias("inner"), F.lit(False).alias("border"))
    )
    last = Window.partitionBy("scope").orderBy("at", "late", *order[1:]).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("s", F.last(F.when(F.col("border"), F.struct("inner")), ignorenulls=True).over(last)["inner"])
    return found.where("not border and s is not null").select("scope", "at", "id", F.col("s.span").alias("span"), F.col("s.start").alias("start")).distinct()


def _numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, NumericType)


def uncovered(candidates: DataFrame, calls: DataFrame, tests: DataFrame, max_depth: int = 3) -> DataFrame:
    """Candidates ``(node, ...)`` that no test reaches within ``max_depth`` calls."""
    return candidates.join(reach(calls, tests, max_depth), "node", "left_anti")


def health(facts: DataFrame, per: int) -> DataFrame:
    """Of ``(project, dimension, item, weight)``: counts of each dimension and its ``per`` worst items."""
    counts = facts.groupBy("project", "dimension").agg(F.count("*").alias("n"))
    worst = first_sites(facts.withColumn("minus", -F.col("weight")), ["project", "dimension"], ["minus", "item"], per)
    return worst.join(counts, ["project", "dimension"]).select("project", "dimension", "n", "site", "item", "weight")


def exception_flow(calls: DataFrame, root: DataFrame, throws: DataFrame, catches: DataFrame, max_depth: int = 3) -> DataFrame:
    """What ``root(node)`` may let out: ``(node, exception, depth, path, caught_by)``, ``caught_by`` null if it escapes.

    A throw ``(node, exception)`` goes outward along the call chain; the innermost method of the chain
    with a clause ``(node, exception)`` for it, or for all (null), catches it. Of several chains to a method the
    shortest counts, of these the smallest.
    """
    chains = shortest_chains(calls, root, max_depth)
    raised = chains.join(throws.select("node", "exception").distinct(), "node")
    frames = raised.select("node", "exception", F.posexplode("path").alias("at", "frame"))
    clauses = catches.select(F.col("node").alias("frame"), F.col("exception").alias("clause"))
    held = frames.join(clauses, "frame").where("clause is null or clause = exception")
    caught = held.groupBy("node", "exception").agg(F.max_by("frame", "at").alias("caught_by"))
    return raised.join(caught, ["node", "exception"], "left").select("node", "exception", "depth", "path", "caught_by")


def extension_methods(tree: DataFrame, of: DataFrame, methods: DataFrame) -> DataFrame:
    """Methods ``(receiver, name, ...)`` that fit ``of(node)`` or a type above it in ``tree(src, dst)``, with the distance of their receiver."""
    return methods.join(reach(tree, of).select(F.col("node").alias("receiver"), F.col("depth").alias("distance")), "receiver")


def data_flow(accesses: DataFrame, start: Column, stop: Column) -> DataFrame:
    """Of ``(scope, var, at, writes)``, variables that a region from ``start`` to before ``stop`` touches, and how.

    Straight-line order: one flows in if it was written before and read inside before any write inside, out
    if it is written inside and read after. One aggregation, whatever the number of variables.
    """
    at, writes = F.col("at"), F.col("writes")
    inside, before, after = (at >= start) & (at < stop), at < start, at >= stop
    seen = accesses.groupBy("scope", "var").agg(
        F.min(F.when(inside & ~writes, at)).alias("first_read"),
        F.min(F.when(inside & writes, at)).alias("first_write"),
        F.coalesce(F.max(before & writes), F.lit(False)).alias("written_before"),
        F.coalesce(F.max(after & ~writes), F.lit(False)).alias("read_after"),
        F.coalesce(F.max(before | after), F.lit(False)).alias("used_outside"),
    )
    exposed = F.col("first_read").isNotNull() & (F.col("first_write").isNull() | (F.col("first_read") <= F.col("first_write")))
    return seen.where("first_read is not null or first_write is not null").select(
        "scope",
        "var",
        F.col("first_read").isNotNull().alias("read_inside"),
        F.col("first_write").isNotNull().alias("written_inside"),
        (F.col("written_before") & exposed).alias("flows_in"),
        (F.col("first_write").isNotNull() & F.col("read_after")).alias("flows_out"),
        "used_outside",
    )


def rename_plan(symbols: DataFrame, occurrences: DataFrame, targets: DataFrame, new_name: str | DataFrame) -> DataFrame:
    """Edits and conflicts of a rename, not applied: ``(what, file, line, col, old, new)``.

    Each place of the targets is one edit; a symbol ``(target, name, container)`` that bears the new name in a
    target's container is a conflict. ``new_name`` is a name, or a table of one row with one in ``new``.
    """
    if isinstance(new_name, str):
        if not new_name.strip():
            raise InvalidArgument("a new name is needed", newName=new_name)
        new_name = symbols.sparkSession.createDataFrame([(new_name,)], "new string")
    named = targets.select("target").distinct().join(F.broadcast(new_name.select("new")))  # of one row
    renamed = symbols.join(named, "target").select("target", F.col("name").alias("old"), "container", "new")
    edits = occurrences.select("target", "file", "line", "col").distinct().join(renamed, "target")
    edits = edits.select(F.lit("edit").alias("what"), "file", "line", "col", "old", "new")
    spots = renamed.select("container", F.col("new").alias("name")).distinct()
    clashes = symbols.join(targets, "target", "left_anti").select(F.col("target").alias("id"), "name", "container").join(spots, ["container", "name"])
    return edits.unionByName(clashes.select(F.lit("conflict").alias("what"), F.lit(None).cast("long").alias("file"), F.lit(None).cast("int").alias("line"), F.col("id").cast("string").alias("col"), F.col("name").alias("old"), F.col("name").alias("new")))


def assembly_summary(types: DataFrame) -> DataFrame:
    """Namespaces of public types ``(namespace, name)``: ``(namespace, n_types, names)``, names distinct and sorted."""
    return types.groupBy("namespace").agg(F.count("*").alias("n_types"), F.array_join(F.sort_array(F.collect_set("name")), ",").alias("names"))
