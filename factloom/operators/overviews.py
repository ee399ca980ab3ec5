"""Tools that put others together over facts: a type, a file or a method at a glance, and the text of methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .code_tools import accessibility, base_edges, conflicts, di_registrations, has_word, last_segment, resolve, symbol_context
from .graph import reach, reach_from_each


def type_overviews(facts: DataFrame, requests: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """``(request, type, file, line, project, bases, injected, members, ancestors, derived, n_diagnostics, diagnostics)`` of the requests' types.

    Context, hierarchy and the ``diagnostics(id, severity, file, line)`` of the type's file, case ignored. Types above and below are
    sorted names, from all distances; diagnostics are ids, sorted, each once.
    """
    context = symbol_context(facts, requests)
    asked = context.select("type").distinct()
    near = reach_from_each(base_edges(facts)).where("root <> node")
    up = near.join(asked.withColumnRenamed("type", "root"), "root", "left_semi").groupBy(F.col("root").alias("type")).agg(F.sort_array(F.collect_set("node")).alias("ancestors"))
    down = near.join(asked.withColumnRenamed("type", "node"), "node", "left_semi").groupBy(F.col("node").alias("type")).agg(F.sort_array(F.collect_set("root")).alias("derived"))
    of_file = diagnostics.groupBy(F.lower("file").alias("low")).agg(F.count("*").alias("n_diagnostics"), F.sort_array(F.collect_set("id")).alias("diagnostics"))
    out = context.join(up, "type", "left").join(down, "type", "left").withColumn("low", F.lower("file")).join(of_file, "low", "left")
    empty = F.array().cast("array<string>")
    return out.select("request", "type", "file", "line", "project", "bases", "injected", "members", F.coalesce("ancestors", empty).alias("ancestors"), F.coalesce("derived", empty).alias("derived"), F.coalesce("n_diagnostics", F.lit(0)).alias("n_diagnostics"), F.coalesce("diagnostics", empty).alias("diagnostics"))


def file_overviews(facts: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """``(file, types, n_types, n_members, n_errors, n_warnings)`` of each file that declares something or has diagnostics: simple names of its types, each once, sorted."""
    declared = facts.where("kind in ('type', 'member')").groupBy(F.lower("file").alias("low")).agg(
        F.min("file").alias("file"), F.sort_array(F.collect_set(F.when(F.col("kind") == "type", F.col("name")))).alias("types"), F.count_if(F.col("kind") == "type").alias("n_types"), F.count_if(F.col("kind") == "member").alias("n_members")
    )
    severity = F.lower("severity")
    found = diagnostics.groupBy(F.lower("file").alias("low")).agg(F.min("file").alias("other"), F.count_if(severity == "error").alias("n_errors"), F.count_if(severity == "warning").alias("n_warnings"))
    out = declared.join(found, "low", "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(F.coalesce("file", "other").alias("file"), F.coalesce("types", F.array().cast("array<string>")).alias("types"), zero("n_types"), zero("n_members"), zero("n_errors"), zero("n_warnings"))


def analyze_methods(facts: DataFrame, requests: DataFrame) -> DataFrame:
    """``(request, signature, file, line, n_overloads, callers, callees)``: of each request's methods the first by project, file and line, the members that call one of that name, and the names that it calls, each once and sorted."""
    methods = resolve(facts, requests).where("kind in ('method', 'constructor')")
    first = methods.groupBy("request").agg(F.min(F.struct("project", "file", "line", "id", "full_name")).alias("f"), F.count("*").alias("n_overloads"))
    calls = facts.where("kind = 'call'").select("name", "detail", F.col("container").alias("caller")).distinct()
    named = methods.select("request", "name", F.col("kind").alias("detail")).distinct()
    inward = calls.join(named, ["name", "detail"]).groupBy("request").agg(F.sort_array(F.collect_set("caller")).alias("callers"))
    own = first.select("request", F.col("f.full_name").alias("caller"))
    outward = calls.join(own, "caller").groupBy("request").agg(F.sort_array(F.collect_set("name")).alias("callees"))
    out = first.join(inward, "request", "left").join(outward, "request", "left")
    empty = F.array().cast("array<string>")
    return out.select("request", F.col("f.id").alias("signature"), F.col("f.file").alias("file"), F.col("f.line").alias("line"), "n_overloads", F.coalesce("callers", empty).alias("callers"), F.coalesce("callees", empty).alias("callees"))


def method_sources(facts: DataFrame, requests: DataFrame, files: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """``(request, status, id, file, line, text, candidates)`` of each of ``requests(request)``, from ``files(file, text)``.

    ``ok`` has a row for each method of the one group (container and name) that the request names, with the text of its lines, leading blank lines left out;
    ``ambiguous`` one row with the groups to choose from; ``unsupportedKind`` what is no method, constructor, property, indexer or operator;
    ``metadata`` what only ``metadata(full_name)`` has; ``notFound`` the rest.
    """
    found = resolve(facts, requests)
    group = F.concat_ws(".", "container", "name")
    code = F.col("kind").isin("method", "constructor", "property", "indexer", "operator", "conversion", "destructor")
    groups = Window.partitionBy("request")
    seen = found.withColumn("group", group).withColumn("groups", F.size(F.collect_set("group").over(groups))).withColumn("has_code", F.max(code).over(groups))
    ambiguous = seen.where("groups > 1").groupBy("request").agg(F.array_join(F.sort_array(F.collect_set("group")), ",").alias("candidates"))
    one = seen.where("groups = 1")
    lines = files.select("file", F.split("text", "\n").alias("lines"))
    good = one.where(code).join(lines, "file", "left")
    taken = F.filter(F.slice("lines", F.col("line"), F.greatest(F.col("end_line") - F.col("line") + 1, F.lit(0))), lambda x: x.isNotNull())
    text = F.regexp_replace(F.array_join(taken, "\n"), r"^(?:[ \t]*\n)+", "")
    none = F.lit(None).cast("string")
    row = lambda status, **c: [F.col("request"), F.lit(status).alias("status"), *(c.get(n, none if n != "line" else F.lit(None).cast("int")).alias(n) for n in ("id", "file", "line", "text", "candidates"))]
    out = good.select(*row("ok", id=F.col("id"), file=F.col("file"), line=F.col("line"), text=text))
    out = out.unionByName(ambiguous.select(*row("ambiguous", candidates=F.col("candidates"))))
    out = out.unionByName(one.where(~code & ~F.col("has_code")).groupBy("request").agg(F.min("id").alias("id")).select(*row("unsupportedKind", id=F.col("id"))))
    missing = requests.select("request").distinct().join(found.select("request").distinct(), "request", "left_anti")
    if metadata is not None:
        outside = missing.join(metadata.select(F.col("full_name").alias("request")).distinct(), "request", "left_semi")
        out = out.unionByName(outside.select(*row("metadata")))
        missing = missing.join(outside, "request", "left_anti")
    return out.unionByName(missing.select(*row("notFound")))


def _accessible(access: Column, project: Column, from_project: str | None) -> Column:
    """Whether something of this accessibility can be used from a project, null if none is given; ``friend`` tells whether the project lets that one in."""
    if from_project is None:
        return F.lit(None).cast("boolean")
    near = (F.lower(project) == from_project.lower()) | F.coalesce("friend", F.lit(False))
    return F.when(access == "public", True).when(access.isin("internal", "protected internal"), near).otherwise(False)


def creation_options(facts: DataFrame, requests: DataFrame, friends: DataFrame | None = None, from_project: str | None = None) -> DataFrame:
    """``(request, how, member, params, is_async, accessible)``: every way to get one of the requests' types.

    ``constructor``: declared ones but copy constructors, else one without parameters, and none of types that are abstract, static or
    interfaces. ``factory``: static members anywhere whose type it is, also as ``Task`` or ``ValueTask`` of it (``is_async``). ``registration``: services
    that register it, the lifetime as ``params``. ``required``: members that an initialiser must set, those of bases too, the nearest of a name.
    ``accessible`` is null unless ``from_project`` is given; ``friends(project, friend)`` lets the internals of a project be seen by another.
    """
    types = resolve(facts, requests).where("what = 'type'").select("request", F.col("full_name").alias("type"), F.col("name").alias("simple"), "modifiers", F.col("kind").alias("type_kind"), "project")
    let_in = None if friends is None or from_project is None else friends.where(F.lower("friend") == from_project.lower()).select("project").distinct().withColumn("friend", F.lit(True))
    seen = lambda df: df.withColumn("friend", F.lit(False)) if let_in is None else df.join(let_in, "project", "left")
    rows = facts.where("kind = 'member'").select(F.col("container").alias("holder"), F.col("full_name").alias("member"), "name", F.col("detail").alias("member_kind"), F.col("modifiers").alias("flags"), F.col("type").alias("result"), F.col("extra").alias("params"), F.col("project").alias("home"))
    able = types.where(F.col("type_kind").isin("class", "struct", "record") & ~has_word(F.col("modifiers"), "abstract") & ~has_word(F.col("modifiers"), "static"))
    declared = able.join(rows.where("member_kind = 'constructor'"), F.col("type") == F.col("holder")).where(~has_word(F.col("flags"), "static"))
    access = accessibility(F.col("flags"), "private")
    made = seen(declared.where(last_segment(F.col("params")) != F.col("simple")))
    out = ["request", "how", "member", "params", "is_async", "accessible"]
    own = made.select("request", F.lit("constructor").alias("how"), "member", "params", F.lit(False).alias("is_async"), _accessible(access, F.col("project"), from_project).alias("accessible"))
    plain = seen(able.join(declared.select("request").distinct(), "request", "left_anti"))
    default = plain.select("request", F.lit("constructor").alias("how"), F.concat("type", F.lit("."), "simple").alias("member"), F.lit("").alias("params"), F.lit(False).alias("is_async"), _accessible(accessibility(F.col("modifiers"), "internal"), F.col("project"), from_project).alias("accessible"))
    later = r"^(?:\w+\.)*(?:Task|ValueTask)<(.+)>$"
    static = rows.where(has_word(F.col("flags"), "static") & F.col("member_kind").isin("method", "property", "field")).withColumn("is_async", F.col("result").rlike(later))
    static = static.withColumn("simple", last_segment(F.when(F.col("is_async"), F.regexp_extract("result", later, 1)).otherwise(F.col("result"))))
    factory = seen(static.join(types.select("request", "simple"), "simple").withColumnRenamed("home", "project"))
    factories = factory.select("request", F.lit("factory").alias("how"), "member", "params", "is_async", _accessible(access, F.col("project"), from_project).alias("accessible"))
    served = di_registrations(facts).select(F.explode(F.array_distinct(F.array(last_segment(F.col("service")), last_segment(F.col("implementation"))))).alias("simple"), F.col("service").alias("member"), F.col("lifetime").alias("params"))
    registered = served.join(types.select("request", "simple"), "simple").select("request", F.lit("registration").alias("how"), "member", "params", F.lit(False).alias("is_async"), F.lit(None).cast("boolean").alias("accessible")).distinct()
    above = reach_from_each(base_edges(facts)).select(F.col("root").alias("type"), F.col("node").alias("holder"), "depth").where("type <> holder")
    chain = types.select("request", "type", F.col("type").alias("holder"), F.lit(0).alias("depth")).unionByName(types.select("request", "type").join(above, "type"))
    must = chain.join(rows.where(has_word(F.col("flags"), "required")), "holder").groupBy("request", "name").agg(F.min(F.struct("depth", "member", "result")).alias("m"))
    required = must.select("request", F.lit("required").alias("how"), F.col("m.member").alias("member"), F.col("m.result").alias("params"), F.lit(False).alias("is_async"), F.lit(None).cast("boolean").alias("accessible"))
    return own.select(*out).unionByName(default).unionByName(factories).unionByName(registered).unionByName(required)


def conflicts_of_change(before: DataFrame, after: DataFrame, changed: DataFrame, references: DataFrame) -> DataFrame:
    """``conflicts`` of the projects ``changed(project)`` and of all that refer to them, at any distance, by ``references(src, dst)``: src refers to dst; both listings have a ``project``."""
    back = references.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    touched = reach(back, changed.select(F.col("project").alias("node"))).select(F.col("node").alias("project"))
    rows = [df.join(touched, "project", "left_semi").drop("project") for df in (before, after)]
    return conflicts(*rows)


def assembly_namespace(types: DataFrame, members: DataFrame, bases: DataFrame, assembly: str, namespace: str) -> DataFrame:
    """``(type, kind, modifiers, base, interfaces, members, summary)`` of the public top-level types of a namespace of an assembly.

    ``types(type, name, assembly, namespace, kind, access, container, modifiers, base, summary)``, ``members(type, signature, access)``, ``bases(src, dst)`` of
    interfaces. Members are signatures of public ones, each once and sorted; those of an interface include what it inherits. Interfaces are the direct ones.
    """
    own = types.where((F.lower("assembly") == assembly.lower()) & (F.col("namespace") == namespace) & (F.col("access") == "public") & F.col("container").isNull())
    kinds = own.select("type", "kind").distinct()
    above = reach_from_each(bases).select(F.col("root").alias("type"), F.col("node").alias("holder")).join(kinds.where("kind = 'interface'").select("type"), "type", "left_semi")
    holders = kinds.select("type", F.col("type").alias("holder")).unionByName(above).distinct()
    public = members.where("access = 'public'").select(F.col("type").alias("holder"), "signature")
    listed = holders.join(public, "holder").groupBy("type").agg(F.sort_array(F.collect_set("signature")).alias("members"))
    direct = bases.join(kinds.select(F.col("type").alias("src")), "src", "left_semi").groupBy(F.col("src").alias("type")).agg(F.sort_array(F.collect_set("dst")).alias("interfaces"))
    empty = F.array().cast("array<string>")
    out = own.join(listed, "type", "left").join(direct, "type", "left")
    return out.select("type", "kind", "modifiers", "base", F.coalesce("interfaces", empty).alias("interfaces"), F.coalesce("members", empty).alias("members"), "summary")
