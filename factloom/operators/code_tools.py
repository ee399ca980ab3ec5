"""The query tools over facts from C# text (``factloom.sources.csharp``).

Names are resolved by text: a dotted name is a full name, or one without its type arguments, or a type and its member; another
one is a simple name. A reference is of every symbol with its simple name, so where several symbols share a name each has the
uses of all (``confidence`` says ``name_only``).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.errors import AmbiguousMatch, InvalidArgument, SymbolNotFound
from factloom.functions.predicates import match_rank
from factloom.sources.csharp import REF_KINDS

from .graph import reach

# Names of test attributes, by framework.
TEST_ATTRIBUTES = {"Fact": "XUnit", "Theory": "XUnit", "Test": "NUnit", "TestCase": "NUnit", "TestCaseSource": "NUnit", "TestMethod": "MSTest", "DataTestMethod": "MSTest"}
# Calls that reflect, and their kind.
REFLECTION = {"GetType": "type_lookup", "CreateInstance": "instantiation", "GetMethod": "member_lookup", "GetProperty": "member_lookup", "GetField": "member_lookup", "GetMembers": "member_lookup", "Invoke": "invocation", "GetCustomAttributes": "attribute_lookup"}
# Calls that register a service, and its lifetime.
LIFETIMES = {f"{form}{life}": life for life in ("Singleton", "Scoped", "Transient") for form in ("Add", "TryAdd", "AddKeyed")}
# Beginnings of names of the framework's own types.
FRAMEWORK = ["System", "Microsoft"]
_TOKENS = ["+", "-", "!", "~", "++", "--", "true", "false", "*", "/", "%", "&", "|", "^", "<<", ">>", ">>>", "==", "!=", "<", "<=", ">", ">="]


def stripped(name: Column) -> Column:
    """A name without type arguments, however deep they nest, without arity marks and ``global::``. A bracket that nothing closes stays, as does one that closes nothing."""
    plain = F.regexp_replace(name, r"^global::", "")
    pieces = F.regexp_extract_all(plain, F.lit(r"[^<>]+|[<>]"), F.lit(0))
    # texts of the brackets that are open, outermost first; the first is what stands outside of any
    start = F.array(F.lit(""))

    def step(held: Column, piece: Column) -> Column:
        rest, last = F.slice(held, F.lit(1), F.size(held) - 1), F.element_at(held, -1)
        opened, closed = F.concat(held, F.array(F.lit("<"))), (piece == ">") & (F.size(held) > 1)
        return F.when(piece == "<", opened).when(closed, rest).otherwise(F.concat(rest, F.array(F.concat(last, piece))))

    flat = F.when(F.contains(plain, F.lit("<")), F.aggregate(pieces, start, step, lambda held: F.array_join(held, ""))).otherwise(plain)
    return F.trim(F.regexp_replace(flat, r"`\d+", ""))


def last_segment(name: Column) -> Column:
    """What stands after the last dot of a name without type arguments."""
    return F.element_at(F.split(stripped(name), r"\."), -1)


def has_word(modifiers: Column, word: str) -> Column:
    return F.array_contains(F.split(modifiers, " "), word)


def accessibility(modifiers: Column, default: str) -> Column:
    """public, protected internal, private protected, protected, internal or private."""
    has = lambda w: has_word(modifiers, w)
    return (
        F.when(has("public"), "public")
        .when(has("protected") & has("internal"), "protected internal")
        .when(has("protected") & has("private"), "private protected")
        .when(has("protected"), "protected")
        .when(has("internal"), "internal")
        .when(has("private"), "private")
        .otherwise(default)
    )


def symbols(facts: DataFrame) -> DataFrame:
    """Types and members: ``(id, name, kind, container, file, project, line, end_line, modifiers, type, params)``; a type that several files or projects declare is the first."""
    rows = facts.where("kind in ('type', 'member')")
    id_ = F.when((F.col("kind") == "member") & F.col("detail").isin("method", "constructor", "operator", "conversion", "indexer"), F.concat("full_name", F.lit("("), "extra", F.lit(")"))).otherwise(F.col("full_name"))
    named = rows.select(id_.alias("id"), "full_name", "name", F.col("kind").alias("what"), F.col("detail").alias("kind"), "container", "file", "project", "line", "end_line", "modifiers", "type", F.col("extra").alias("params"))
    rest = [c for c in named.columns if c != "id"]
    return named.groupBy("id").agg(F.min(F.struct("project", "file", "line", *[c for c in rest if c not in ("project", "file", "line")])).alias("s")).select("id", *(F.col("s")[c].alias(c) for c in rest))


def resolve(facts: DataFrame, requests: DataFrame, required: bool = False) -> DataFrame:
    """``(request, ...symbol)`` of ``requests(request)``: types first (dotted: by full name, then without type arguments; else by simple name, case counts), then members as ``Type.Member`` or simple name, case ignored.

    With ``required``, a request that nothing answers is an error.
    """
    every = symbols(facts)
    low, container = F.lower("name"), F.element_at(F.split("container", r"\."), -1)
    keys = F.when(
        F.col("what") == "type",
        F.array(F.struct(F.lit(0).alias("tier"), F.col("full_name").alias("key")), F.struct(F.lit(1).alias("tier"), F.col("name").alias("key"))),
    ).otherwise(
        F.array(
            F.struct(F.lit(2).alias("tier"), F.concat(F.lower("container"), F.lit("."), low).alias("key")),
            F.struct(F.lit(2).alias("tier"), F.concat(F.lower(container), F.lit("."), low).alias("key")),
            F.struct(F.lit(3).alias("tier"), low.alias("key")),
        )
    )
    known = every.withColumn("k", F.explode(F.array_distinct(keys))).select("*", "k.tier", "k.key").drop("k")
    plain = stripped(F.col("request"))
    asked = requests.select("request").distinct().withColumn("k", F.explode(F.array_distinct(F.array(*(F.struct(F.lit(t).alias("tier"), (plain if t < 2 else F.lower(plain)).alias("key")) for t in range(4)))))).select("request", "k.*")
    found = asked.join(known, ["tier", "key"]).drop("key").distinct()
    best = found.groupBy("request").agg(F.min("tier").alias("tier"))
    out = found.join(best, ["request", "tier"]).drop("tier").dropDuplicates(["request", "id"])
    if required:
        missing = [r.request for r in requests.select("request").distinct().join(best, "request", "left_anti").limit(10).collect()]
        if missing:
            raise SymbolNotFound(f"no symbol {missing[0]!r}", symbols=missing)
    return out


def definitions(facts: DataFrame, requests: DataFrame) -> DataFrame:
    """``(request, id, kind, file, line, project)`` of each request's symbols."""
    return resolve(facts, requests).select("request", "id", "kind", "file", "line", "project")


def references(facts: DataFrame, requests: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """``(request, file, line, col, kind, enclosing, project, confidence)``: uses of the requests' symbols, one for each place; a method that is read is a method group."""
    unknown = [k for k in kinds or [] if k.lower() not in REF_KINDS]
    if unknown:
        raise InvalidArgument(f"unknown kinds: {unknown}", kinds=unknown, known=REF_KINDS)
    targets = resolve(facts, requests).select("request", "name", (F.col("kind") == "method").alias("method")).groupBy("request", "name").agg(F.max("method").alias("method"))
    uses = facts.where("kind = 'ref'").select("name", "file", "line", "col", F.col("detail").alias("use"), F.col("container").alias("enclosing"), "project", "confidence")
    out = uses.join(targets, "name").withColumn("kind", F.when(F.col("method") & (F.col("use") == "read"), "method_group").otherwise(F.col("use")))
    out = out.where(F.col("kind").isin([k.lower() for k in kinds])) if kinds else out
    out = out.groupBy("request", "file", "line", "col").agg(F.min(F.struct("project", "kind", "enclosing", "confidence")).alias("x"))
    return out.select("request", "file", "line", "col", "x.kind", "x.enclosing", "x.project", "x.confidence")


def callers(facts: DataFrame, requests: DataFrame) -> DataFrame:
    """``(request, caller, file, line, project)``: members that call a request's methods or constructors, by place."""
    targets = resolve(facts, requests).where("what = 'member' or what = 'type'").select("request", "name", F.when(F.col("what") == "type", "constructor").when(F.col("kind") == "constructor", "constructor").otherwise("method").alias("detail")).distinct()
    calls = facts.where("kind = 'call'").select("name", "detail", F.col("container").alias("caller"), "file", "line", "project")
    return calls.join(targets, ["name", "detail"]).select("request", "caller", "file", "line", "project").distinct()


def call_edges(facts: DataFrame) -> DataFrame:
    """``(src, dst)``: members and the members whose names they call; a constructor is known by its type's name."""
    members = facts.where("kind = 'member'").select(F.col("full_name").alias("dst"), F.when(F.col("detail") == "constructor", "constructor").otherwise("method").alias("detail"), "name").distinct()
    return facts.where("kind = 'call'").select(F.col("container").alias("src"), "name", "detail").distinct().join(members, ["name", "detail"]).select("src", "dst").distinct()


def base_edges(facts: DataFrame) -> DataFrame:
    """``(src, dst)``: types and what they derive from, by full name where a type of that name is known."""
    types = facts.where("kind = 'type'").select("full_name", "name").distinct()
    bases = facts.where("kind = 'base'").select(F.col("container").alias("src"), stripped(F.col("name")).alias("base")).distinct()
    near = bases.join(types.select(F.col("name").alias("key"), "full_name"), last_segment(F.col("base")) == F.col("key"), "left")
    return near.select("src", F.coalesce("full_name", "base").alias("dst")).distinct()


def implementations(facts: DataFrame, request: DataFrame) -> DataFrame:
    """``(type, depth)``: types that derive from, or implement, one of the requests' types."""
    down = base_edges(facts).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    seeds = resolve(facts, request).where("what = 'type'").select(F.col("full_name").alias("node"))
    return reach(down, seeds).where("depth > 0").select(F.col("node").alias("type"), "depth")


def type_hierarchy(facts: DataFrame, request: DataFrame) -> DataFrame:
    """``(relation, type, depth)``: bases and derived types of the requests' types."""
    up = base_edges(facts)
    seeds = resolve(facts, request).where("what = 'type'").select(F.col("full_name").alias("node"))
    bases = reach(up, seeds).where("depth > 0").select(F.lit("base").alias("relation"), F.col("node").alias("type"), "depth")
    return bases.unionByName(implementations(facts, request).select(F.lit("derived").alias("relation"), "type", "depth"))


def symbol_context(facts: DataFrame, requests: DataFrame) -> DataFrame:
    """``(request, type, file, line, project, bases, injected, members)``: bases, types of constructors' parameters, and public members other than constructors, each sorted."""
    types = resolve(facts, requests).where("what = 'type'").select("request", F.col("full_name").alias("type"), "file", "line", "project")
    bases = facts.where("kind = 'base'").select(F.col("container").alias("type"), F.col("name").alias("base"))
    members = facts.where("kind = 'member'").select(F.col("container").alias("type"), "name", "modifiers", "detail", "extra")
    injected = members.where("detail = 'constructor' and extra <> ''").select("type", F.explode(F.split("extra", ", ")).alias("injected"))
    public = members.where((F.col("detail") != "constructor") & has_word(F.col("modifiers"), "public"))
    sides = [df.groupBy("type").agg(F.sort_array(F.collect_set(c)).alias(out)) for df, c, out in ((bases, "base", "bases"), (injected, "injected", "injected"), (public, "name", "members"))]
    out = reduce(lambda a, b: a.join(b, "type", "left"), sides, types)
    return out.select("request", "type", "file", "line", "project", *(F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("bases", "injected", "members")))


def file_overview(facts: DataFrame, file: str) -> DataFrame:
    """``(kind, name, line, end_line, modifiers)``: types and members of a file, in order of their lines when sorted."""
    return facts.where((F.col("file") == file) & F.col("kind").isin("type", "member")).select(F.col("detail").alias("kind"), F.col("full_name").alias("name"), "line", "end_line", "modifiers")


def overloads(facts: DataFrame, requests: DataFrame) -> DataFrame:
    """``(request, place, signature, n_params, modifiers, type)``: methods of a request's name in its first type, or its constructors for ``Type.Type``, by number of parameters and signature."""
    found = resolve(facts, requests).where("kind in ('method', 'constructor')")
    first = found.groupBy("request").agg(F.min("container").alias("container"))
    found = found.join(first, ["request", "container"]).withColumn("n_params", F.when(F.col("params") == "", 0).otherwise(F.size(F.split("params", ", "))))
    order = Window.partitionBy("request").orderBy("n_params", "id")
    return found.select("request", F.row_number().over(order).alias("place"), F.col("id").alias("signature"), "n_params", "modifiers", "type")


def operators_of(facts: DataFrame, requests: DataFrame) -> DataFrame:
    """``(request, type, token, kind, arity, checked, result, params)``: user-defined operators and conversions of the requests' types."""
    types = resolve(facts, requests).where("what = 'type'").select("request", F.col("full_name").alias("type"))
    rows = facts.where("kind = 'member' and detail in ('operator', 'conversion')")
    token = F.when(F.col("detail") == "conversion", F.col("name")).otherwise(F.regexp_replace("name", r"^operator ", ""))
    rows = rows.select(F.col("container").alias("type"), token.alias("token"), F.col("detail").alias("kind"), F.size(F.split("extra", ", ")).alias("arity"), has_word(F.col("modifiers"), "checked").alias("checked"), F.col("type").alias("result"), F.col("extra").alias("params"))
    return types.join(rows.where((F.col("kind") == "conversion") | F.col("token").isin(_TOKENS)), "type").select("request", "type", "token", "kind", "arity", "checked", "result", "params")


def reachable_types(facts: DataFrame) -> DataFrame:
    """``(type)``: types that are public as is every type that holds them."""
    types = facts.where("kind = 'type'").select("full_name", "container", "modifiers").distinct()
    hidden = types.where(~has_word(F.col("modifiers"), "public")).select(F.col("full_name").alias("holder")).distinct()
    holders = types.select("full_name", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("full_name", r"\."))), lambda n: F.array_join(F.slice(F.split("full_name", r"\."), 1, n), "."))).alias("holder"))
    return types.select("full_name").distinct().join(holders.join(hidden, "holder", "left_semi").select("full_name").distinct(), "full_name", "left_anti").select(F.col("full_name").alias("type"))


def public_api(facts: DataFrame) -> DataFrame:
    """``(kind, name, signature, access, project, file, line)``: public and protected types and members that can be reached from outside."""
    open_ = reachable_types(facts)
    every = symbols(facts)
    types = every.where("what = 'type'").join(open_.withColumnRenamed("type", "full_name"), "full_name", "left_semi").withColumn("access", F.lit("public"))
    holders = facts.where("kind = 'type' and detail in ('interface', 'enum')").select(F.col("full_name").alias("container")).distinct().withColumn("plain", F.lit(True))
    members = every.where("what = 'member'").join(open_.withColumnRenamed("type", "container"), "container", "left_semi").join(holders, "container", "left")
    members = members.withColumn("access", F.when(F.col("plain"), "public").otherwise(accessibility(F.col("modifiers"), "private"))).where("access in ('public', 'protected', 'protected internal') and kind <> 'destructor'")
    columns = ["kind", F.col("full_name").alias("name"), F.col("id").alias("signature"), "access", "project", "file", "line"]
    return types.select(*columns).unionByName(members.select(*columns))


def event_subscribers(facts: DataFrame, requests: DataFrame) -> DataFrame:
    """``(request, file, line, col, subscribes, handler, enclosing, project)``: ``+=`` and ``-=`` on names of the requests' events, one for each place and what stands there; of a file in several projects the first project."""
    events = resolve(facts, requests).where("kind = 'event'").select("request", "name").distinct()
    rows = facts.where("kind = 'subscribe'").select("name", "file", "line", "col", (F.col("detail") == "+=").alias("subscribes"), F.col("extra").alias("handler"), F.col("container").alias("enclosing"), "project")
    found = rows.join(events, "name").groupBy("request", "file", "line", "col", "subscribes", "handler", "enclosing").agg(F.min("project").alias("project"))
    return found.select("request", "file", "line", "col", "subscribes", "handler", "enclosing", "project")


def attribute_usages(facts: DataFrame, attribute: str) -> DataFrame:
    """``(target, file, line, project, arguments)``: uses of an attribute by its name with or without ``Attribute``, case ignored, one for each (target, file, line)."""
    low = attribute.lower().removesuffix("attribute")
    name = F.lower(last_segment(F.col("name")))
    rows = facts.where((F.col("kind") == "attribute") & name.isin(low, f"{low}attribute"))
    return rows.groupBy(F.col("container").alias("target"), "file", "line").agg(F.min("project").alias("project"), F.min("detail").alias("arguments"))


def async_violations(facts: DataFrame, tests: DataFrame | None = None) -> DataFrame:
    """``(pattern, severity, member, file, line, project)``; projects of ``tests(project)`` are left out.

    SyncOverAsyncResult (``.Result`` of a task), SyncOverAsyncWait, SyncOverAsyncGetResult and AsyncVoid (but for event handlers) are errors; a
    dropped call of an asynchronous method is MissingAwait in an asynchronous member, else FireAndForget, a warning. What
    is a task is told by name: methods declared with a task as result, or named ``...Async``.
    """
    rows = facts if tests is None else facts.join(tests.select("project").distinct(), "project", "left_anti")
    members = rows.where("kind = 'member'")
    tasks = members.where(F.col("type").rlike(r"^(?:\w+\.)*(?:Task|ValueTask)(?:<|$)")).select("name").distinct().withColumn("task", F.lit(True))
    calls = rows.where("kind = 'call' and detail = 'method'").join(tasks, "name", "left").withColumn("task", F.coalesce("task", F.col("name").endswith("Async")))
    of = members.select(F.col("full_name").alias("container"), F.col("file"), has_word(F.col("modifiers"), "async").alias("async")).groupBy("container", "file").agg(F.max("async").alias("async"))
    place = ["container", "file", "line", "project"]
    reads = rows.where("kind = 'ref' and name = 'Result' and detail = 'read'").select(F.lit("SyncOverAsyncResult").alias("pattern"), *place)
    waits = calls.where("name in ('Wait', 'WaitAll', 'WaitAny') and (extra = 'Task' or name = 'Wait')").select(F.lit("SyncOverAsyncWait").alias("pattern"), *place)
    results = calls.where("name = 'GetResult' and extra like '%GetAwaiter()'").select(F.lit("SyncOverAsyncGetResult").alias("pattern"), *place)
    handler = F.col("extra").rlike(r"^object\??, \w*EventArgs$")
    voids = members.where(has_word(F.col("modifiers"), "async") & (F.col("type") == "void") & ~handler).select(F.lit("AsyncVoid").alias("pattern"), F.col("full_name").alias("container"), "file", "line", "project")
    dropped = calls.where("task and m = 1").join(of, ["container", "file"], "left").select(F.when(F.coalesce("async", F.lit(False)), "MissingAwait").otherwise("FireAndForget").alias("pattern"), *place)
    out = reduce(DataFrame.unionByName, [reads, waits, results, voids, dropped])
    return out.select("pattern", F.when(F.col("pattern").isin("MissingAwait", "FireAndForget"), "Warning").otherwise("Error").alias("severity"), F.col("container").alias("member"), "file", "line", "project")


def disposable_misuse(facts: DataFrame, disposables: DataFrame | None = None) -> DataFrame:
    """``(pattern, severity, member, name, file, line, project)``: locals of a disposable type that are neither in a ``using`` nor returned, passed on, assigned or disposed of (a warning), and disposables made and dropped (an error).

    Disposable are the types of ``disposables(type)`` and those of the facts that derive from ``IDisposable`` or ``IAsyncDisposable`` at any distance.
    """
    down = base_edges(facts).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    seeds = facts.sparkSession.createDataFrame([(n,) for n in ("IDisposable", "IAsyncDisposable", "System.IDisposable", "System.IAsyncDisposable")], "node string")
    own = reach(down, seeds).where("depth > 0").select(last_segment(F.col("node")).alias("type"))
    types = (own if disposables is None else own.unionByName(disposables.select("type"))).distinct()
    place = ["container", "file", "line", "project"]
    kept = facts.where("kind = 'kept'").select("container", "file", "name").distinct()
    made = facts.where("kind = 'local' and detail = 'plain' and extra <> 'value'").withColumn("made", last_segment(F.col("type"))).join(types.withColumnRenamed("type", "made"), "made", "left_semi")
    loose = made.join(kept, ["container", "file", "name"], "left_anti").select(F.lit("LocalNotDisposed").alias("pattern"), F.lit("Warning").alias("severity"), "name", *place)
    bare = facts.where("kind = 'call' and detail = 'constructor' and m = 1").join(types.withColumnRenamed("type", "name"), "name", "left_semi").select(F.lit("BareCreation").alias("pattern"), F.lit("Error").alias("severity"), "name", *place)
    return loose.unionByName(bare).withColumnRenamed("container", "member")


def di_registrations(facts: DataFrame, service: str | None = None) -> DataFrame:
    """``(service, implementation, lifetime, file, line, project)`` of ``Add...``, ``TryAdd...`` and ``AddKeyed...`` calls with type arguments; with one argument only, the service stands for itself, or ``(factory)`` if something is passed.

    ``service`` filters by service or implementation, as a full name or its last segment.
    """
    lifetime = F.create_map(*(F.lit(x) for pair in LIFETIMES.items() for x in pair))
    rows = facts.where((F.col("kind") == "call") & F.col("name").isin(list(LIFETIMES)) & (F.col("type") != "")).withColumn("types", F.split("type", ", "))
    one = F.element_at("types", 1)
    out = rows.select(one.alias("service"), F.when(F.size("types") > 1, F.element_at("types", 2)).when(F.col("n") > 0, "(factory)").otherwise(one).alias("implementation"), lifetime[F.col("name")].alias("lifetime"), "file", "line", "project")
    if service is None:
        return out
    return out.where((F.col("service") == service) | (F.col("implementation") == service) | (last_segment(F.col("service")) == service) | (last_segment(F.col("implementation")) == service))


def reflection_usage(facts: DataFrame, symbol: str | None = None) -> DataFrame:
    """``(kind, target, member, file, line, project)``: calls by which types reflect; ``symbol`` is a part of what stands before the call."""
    kind = F.create_map(*(F.lit(x) for pair in REFLECTION.items() for x in pair))
    rows = facts.where((F.col("kind") == "call") & F.col("name").isin(list(REFLECTION)))
    rows = rows.where((F.col("extra") == "Activator") | F.col("extra").contains("typeof(") | F.col("extra").contains("GetType()") | F.col("extra").rlike(r"(?i)(?:^|\.)\w*(?:type|method|property|field|member|assembly)\w*(?:\(|$)") | ((F.col("name") == "GetType") & (F.col("extra") == "Type")))
    out = rows.select(kind[F.col("name")].alias("kind"), F.concat_ws(".", F.nullif("extra", F.lit("")), "name").alias("target"), F.col("container").alias("member"), "file", "line", "project")
    return out if symbol is None else out.where(F.col("target").contains(symbol))


def naming_violations(facts: DataFrame) -> DataFrame:
    """``(rule, name, suggestion, file, line, project)``: interfaces not named I and an upper letter, types, methods and properties not in PascalCase, private fields without an underscore, parameters not in camelCase."""
    name, kind = F.col("name"), F.col("detail")
    upper = F.concat(F.upper(F.substring("name", 1, 1)), F.expr("substring(name, 2)"))
    lower = F.concat(F.lower(F.substring("name", 1, 1)), F.expr("substring(name, 2)"))
    pascal = ~name.rlike(r"^[A-Z]")
    type_, member = F.col("kind") == "type", F.col("kind") == "member"
    private = accessibility(F.col("modifiers"), "private") == "private"
    rule = (
        F.when(type_ & (kind == "interface") & ~name.rlike(r"^I[A-Z]"), F.struct(F.lit("InterfacePrefix").alias("rule"), F.concat(F.lit("I"), upper).alias("suggestion")))
        .when(type_ & pascal, F.struct(F.lit("TypePascalCase").alias("rule"), upper.alias("suggestion")))
        .when(member & (kind == "method") & pascal, F.struct(F.lit("MethodPascalCase").alias("rule"), upper.alias("suggestion")))
        .when(member & (kind == "property") & pascal, F.struct(F.lit("PropertyPascalCase").alias("rule"), upper.alias("suggestion")))
        .when(member & (kind == "field") & private & ~has_word(F.col("modifiers"), "static") & ~name.startswith("_"), F.struct(F.lit("PrivateFieldUnderscore").alias("rule"), F.concat(F.lit("_"), lower).alias("suggestion")))
        .when((F.col("kind") == "param") & name.rlike(r"^[A-Z]"), F.struct(F.lit("ParameterCamelCase").alias("rule"), lower.alias("suggestion")))
    )
    records = facts.where("kind = 'type' and detail = 'record'").select(F.concat("full_name", F.lit("."), "name").alias("container"), F.lit("param").alias("kind")).distinct()
    rows = facts.where("kind in ('type', 'member', 'param')").join(records, ["container", "kind"], "left_anti")
    return rows.withColumn("r", rule).where("r is not null").select("r.rule", F.col("full_name").alias("name"), "r.suggestion", "file", "line", "project")


def test_methods(facts: DataFrame) -> DataFrame:
    """``(member, framework, attribute, file, project)``: methods with a test attribute, the first one if there are several."""
    framework = F.create_map(*(F.lit(x) for pair in TEST_ATTRIBUTES.items() for x in pair))
    short = F.regexp_replace(last_segment(F.col("name")), "Attribute$", "")
    rows = facts.where("kind = 'attribute'").withColumn("attribute", short).where(F.col("attribute").isin(list(TEST_ATTRIBUTES)))
    first = rows.groupBy("container", "file", "project").agg(F.min(F.struct("line", "col", "attribute")).alias("x"))
    return first.select(F.col("container").alias("member"), framework[F.col("x.attribute")].alias("framework"), "x.attribute", "file", "project")


def test_summary(facts: DataFrame) -> DataFrame:
    """``(project, framework, attribute, n_tests, n_rows, symbols)``: tests by project, framework and attribute, their inline rows, and how many names that are not of a framework they refer to."""
    tests = test_methods(facts)
    rows = facts.where("kind = 'attribute'").where(last_segment(F.col("name")).isin("InlineData", "TestCase", "DataRow")).groupBy(F.col("container").alias("member"), "file", "project").agg(F.count("*").alias("rows"))
    known = facts.where("kind = 'type'").select("name").distinct()
    used = facts.where("kind = 'ref' and detail <> 'attribute'").join(known, "name", "left_semi").where(~F.col("name").isin(FRAMEWORK)).select(F.col("container").alias("member"), "file", "project", "name").distinct()
    groups = ["project", "framework", "attribute"]
    counts = tests.join(rows, ["member", "file", "project"], "left").groupBy(*groups).agg(F.count("*").alias("n_tests"), F.coalesce(F.sum("rows"), F.lit(0)).alias("n_rows"))
    names = tests.join(used, ["member", "file", "project"]).groupBy(*groups).agg(F.countDistinct("name").alias("symbols"))
    return counts.join(names, groups, "left").withColumn("symbols", F.coalesce("symbols", F.lit(0)))


def majority_framework(facts: DataFrame) -> DataFrame:
    """``(framework)``, one row: that of the most test methods, XUnit before NUnit before MSTest on a tie, XUnit without any."""
    order = F.create_map(F.lit("XUnit"), F.lit(0), F.lit("NUnit"), F.lit(1), F.lit("MSTest"), F.lit(2))
    counts = test_methods(facts).groupBy("framework").agg(F.count("*").alias("n"))
    return counts.agg(F.coalesce(F.max(F.struct("n", -order[F.col("framework")], "framework"))["framework"], F.lit("XUnit")).alias("framework"))


def complexity_metrics(facts: DataFrame, threshold: int = 10, metric: str = "cyclomatic", project: str | None = None) -> DataFrame:
    """``(member, file, line, project, cyclomatic, cognitive, nesting)`` of members whose score is at least ``threshold``; a property counts by its worst accessor."""
    if metric not in ("cyclomatic", "cognitive"):
        raise InvalidArgument("metric must be cyclomatic or cognitive", metric=metric)
    rows = facts.where("kind = 'member' and n > 0").select(F.col("full_name").alias("member"), "file", "line", "project", F.col("n").alias("cyclomatic"), F.col("m").alias("cognitive"), F.col("nest").alias("nesting"))
    if project is not None:
        rows = rows.where(F.lower("project").contains(project.lower()))
    return rows.where(F.col(metric) >= threshold)


def complexity_summary(facts: DataFrame, threshold: int = 10) -> DataFrame:
    """``(highest, mean, over_threshold, highest_cognitive)``, one row; zeros without members."""
    rows = complexity_metrics(facts, 0)
    return rows.agg(*(F.coalesce(x, F.lit(0)).alias(n) for x, n in ((F.max("cyclomatic"), "highest"), (F.avg("cyclomatic"), "mean"), (F.count_if(F.col("cyclomatic") > threshold), "over_threshold"), (F.max("cognitive"), "highest_cognitive"))))


def throw_sites(facts: DataFrame, exception: str, derived: bool = False) -> DataFrame:
    """``(exception, member, file, line, col, project)``: throws of an exception type, by simple or full name; what is thrown again has its clause's type, a bare clause's is ``System.Exception``."""
    rows = facts.where("kind = 'throw'").withColumn("thrown", F.when(~F.col("name").startswith("("), F.col("name")).otherwise(F.when(F.col("extra") == "(bare catch)", "System.Exception").otherwise(F.col("extra"))))
    return _of_type(facts, rows, "thrown", exception, derived).select(F.col("thrown").alias("exception"), F.col("container").alias("member"), "file", "line", "col", "project").dropDuplicates(["file", "line", "col"])


def catch_blocks(facts: DataFrame, exception: str, bases: bool = False) -> DataFrame:
    """``(exception, member, file, line, has_filter, rethrows, is_empty, project)``: clauses for an exception type; with ``bases`` those for a type above it and bare ones too."""
    rows = facts.where("kind = 'catch'").withColumn("caught", F.col("name"))
    if bases:
        seeds = facts.sparkSession.createDataFrame([(exception,)], "node string").unionByName(facts.where("kind = 'type'").where((F.col("full_name") == exception) | (F.col("name") == exception)).select(F.col("full_name").alias("node")))
        above = reach(base_edges(facts), seeds.distinct()).select(last_segment(F.col("node")).alias("t")).distinct()
        rows = rows.withColumn("t", last_segment(F.col("caught"))).join(above, "t", "left_semi").unionByName(rows.where("caught in ('(bare catch)', 'Exception', 'System.Exception')").withColumn("t", F.lit(""))).drop("t").distinct()
    else:
        rows = _of_type(facts, rows, "caught", exception, False)
    return rows.select(F.col("caught").alias("exception"), F.col("container").alias("member"), "file", "line", (F.col("n") > 0).alias("has_filter"), (F.col("detail") == "rethrows").alias("rethrows"), (F.col("detail") == "empty").alias("is_empty"), "project")


def _of_type(facts: DataFrame, rows: DataFrame, column: str, exception: str, derived: bool) -> DataFrame:
    same = (F.col(column) == exception) | (last_segment(F.col(column)) == exception) | (F.col(column) == exception.rpartition(".")[2])
    if not derived:
        return rows.where(same)
    down = base_edges(facts).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    seeds = facts.sparkSession.createDataFrame([(exception,)], "node string").unionByName(facts.where("kind = 'type'").where((F.col("full_name") == exception) | (F.col("name") == exception)).select(F.col("full_name").alias("node")))
    below = reach(down, seeds.distinct()).select(last_segment(F.col("node")).alias("t")).distinct()
    return rows.withColumn("t", last_segment(F.col(column))).join(below, "t", "left_semi").drop("t")


def instantiation_options(facts: DataFrame, requests: DataFrame) -> DataFrame:
    """``(request, how, member, params)``: public constructors of the requests' types (one without parameters if none is declared and the type can be made), and public static members that return them."""
    types = resolve(facts, requests).where("what = 'type'").select("request", F.col("full_name").alias("type"), F.col("name").alias("simple"), "modifiers", F.col("kind").alias("type_kind"))
    members = facts.where("kind = 'member'").select(F.col("container").alias("holder"), F.col("full_name").alias("member"), F.col("detail").alias("member_kind"), F.col("modifiers").alias("flags"), F.col("type").alias("result"), F.col("extra").alias("params"))
    made = types.join(members.where("member_kind = 'constructor'"), types["type"] == members["holder"])
    own = made.where(has_word(F.col("flags"), "public")).select("request", F.lit("constructor").alias("how"), "member", "params")
    plain = types.where(F.col("type_kind").isin("class", "struct", "record") & ~has_word(F.col("modifiers"), "abstract") & ~has_word(F.col("modifiers"), "static")).join(made.select("request").distinct(), "request", "left_anti")
    default = plain.select("request", F.lit("constructor").alias("how"), F.concat("type", F.lit("."), "simple").alias("member"), F.lit("").alias("params"))
    static = members.where(has_word(F.col("flags"), "public") & has_word(F.col("flags"), "static") & F.col("member_kind").isin("method", "property", "field")).withColumn("simple", last_segment(F.col("result")))
    return own.unionByName(default).unionByName(static.join(types.select("request", "simple"), "simple").select("request", F.lit("factory").alias("how"), "member", "params"))


def extension_methods(facts: DataFrame, request: str) -> DataFrame:
    """``(method, receiver, distance, file, line)``: methods with a ``this`` parameter of the requested type or one above it; those of a type parameter or object too, without a distance."""
    asked = facts.sparkSession.createDataFrame([(request,)], "request string")
    types = resolve(facts, asked).where("what = 'type'").select(F.col("full_name").alias("node"))
    above = reach(base_edges(facts), types).groupBy(last_segment(F.col("node")).alias("receiver")).agg(F.min("depth").alias("distance"))
    methods = facts.where("kind = 'param' and n = 0").where(F.col("detail").startswith("this")).select(F.col("container").alias("method"), last_segment(F.col("type")).alias("receiver"), "file", "line")
    any_ = methods.where(F.col("receiver").rlike("^(?:T|object)$")).withColumn("distance", F.lit(None).cast("int"))
    return methods.join(above, "receiver").unionByName(any_).select("method", "receiver", "distance", "file", "line")


def change_signature(facts: DataFrame, requests: DataFrame, order: list[str | tuple[str, str, str]]) -> DataFrame:
    """``(what, member, file, line, before, after)``: declarations of the requests' methods with the parameters named in ``order``, in that order, and the calls to adapt.

    An entry is the name of a parameter, or ``(name, type, value)`` of a new one with what calls pass for it; parameters
    not named are taken away. A name that the method has not, or twice, is an error.
    """
    kept = [x for x in order if isinstance(x, str)]
    if len(set(kept)) != len(kept):
        raise InvalidArgument("a parameter is named twice", order=order)
    found = resolve(facts, requests, required=True).where("kind in ('method', 'constructor')").select("id", "full_name", "name", "file", "line")
    params = facts.where("kind = 'param'").select(F.col("container").alias("full_name"), F.col("file"), "n", F.col("name").alias("p"), "type", "detail")
    listed = found.join(params, ["full_name", "file"], "left").groupBy("id", "full_name", "name", "file", "line").agg(F.sort_array(F.collect_list(F.struct("n", "p", F.concat_ws(" ", F.nullif("detail", F.lit("")), "type", "p").alias("t")))).alias("params"))
    def named(k: str) -> Column:
        return F.filter("params", lambda x: x["p"] == k)

    lacking = listed.where(reduce(lambda a, b: a | b, (F.size(named(k)) == 0 for k in kept), F.lit(False))).select("id").limit(1).collect()
    if lacking:
        raise InvalidArgument("the method has no such parameter", method=lacking[0].id, order=order)
    parts = [F.element_at(named(k), 1)["t"] if isinstance(k, str) else F.lit(f"{k[1]} {k[0]}") for k in order]
    before = F.array_join(F.transform("params", lambda x: x["t"]), ", ")
    after = F.concat_ws(", ", *parts) if parts else F.lit("")
    edits = listed.select(F.lit("declaration").alias("what"), F.col("full_name").alias("member"), "file", "line", before.alias("before"), after.alias("after"))
    passed = [F.element_at(named(k), 1)["n"].cast("string") if isinstance(k, str) else F.lit(k[2]) for k in order]
    calls = facts.where("kind = 'call'").select("name", F.col("container").alias("member"), F.col("file").alias("at_file"), F.col("line").alias("at_line"), F.col("n").alias("given")).distinct()
    sites = calls.join(listed.select("name", "params"), "name")
    sites = sites.where(F.col("given") <= F.size("params")).select(F.lit("call").alias("what"), "member", F.col("at_file").alias("file"), F.col("at_line").alias("line"), F.array_join(F.transform("params", lambda x: x["n"].cast("string")), ", ").alias("before"), (F.concat_ws(", ", *passed) if passed else F.lit("")).alias("after"))
    return edits.unionByName(sites).distinct()


def test_skeletons(facts: DataFrame, requests: DataFrame, framework: str | None = None) -> DataFrame:
    """``(type, class_name, text)``: a test class for each requested type, with a test for each of its public or protected methods and one for each exception type that a method throws itself.

    The framework is the given one or that of most tests. What is tested is made by the public constructor of fewest parameters, by
    default values; without one a note stands there.
    """
    if framework is not None and framework not in ("XUnit", "NUnit", "MSTest"):
        raise InvalidArgument("unknown framework", framework=framework)
    types = resolve(facts, requests, required=True).where("what = 'type'").select(F.col("full_name").alias("type"), "name").distinct()
    chosen = majority_framework(facts) if framework is None else facts.sparkSession.createDataFrame([(framework,)], "framework string")
    marks = F.create_map(F.lit("XUnit"), F.lit("Fact"), F.lit("NUnit"), F.lit("Test"), F.lit("MSTest"), F.lit("TestMethod"))
    members = facts.where("kind = 'member'").select(F.col("container").alias("type"), F.col("full_name").alias("member"), F.col("name").alias("method"), "detail", "modifiers", "extra", "line")
    public = accessibility(F.col("modifiers"), "private").isin("public", "protected", "protected internal")
    methods = members.where((F.col("detail") == "method") & public)
    throws = facts.where("kind = 'throw'").where(~F.col("name").startswith("(") & ~F.col("name").isin("Exception", "System.Exception")).select(F.col("container").alias("member"), last_segment(F.col("name")).alias("thrown")).distinct()
    tests = methods.select("type", "line", F.concat("method", F.lit("_Works")).alias("test")).unionByName(methods.join(throws, "member").select("type", "line", F.concat("method", F.lit("_Throws"), "thrown").alias("test"))).distinct()
    makers = members.where((F.col("detail") == "constructor") & has_word(F.col("modifiers"), "public")).withColumn("n", F.when(F.col("extra") == "", 0).otherwise(F.size(F.split("extra", ", "))))
    maker = makers.groupBy("type").agg(F.min(F.struct("n", "extra")).alias("x"))
    none = members.where("detail = 'constructor'").select("type").distinct().withColumn("declared", F.lit(True))
    listed = tests.join(F.broadcast(chosen)).withColumn("text", F.concat(F.lit("    ["), marks[F.col("framework")], F.lit("]\n    public void "), "test", F.lit("()\n    {\n    }\n")))
    listed = listed.groupBy("type").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "test", "text"))), lambda x: x["text"]), "\n").alias("body"))
    rows = types.join(listed, "type", "left").join(maker, "type", "left").join(none, "type", "left")
    given = F.when(F.col("x.extra") == "", "").otherwise(F.array_join(F.transform(F.split("x.extra", ", "), lambda t: F.concat(F.lit("default("), t, F.lit(")"))), ", "))
    sut = F.when(F.col("x").isNotNull(), F.concat(F.lit("new "), "name", F.lit("("), given, F.lit(")"))).when(F.col("declared").isNull(), F.concat(F.lit("new "), "name", F.lit("()"))).otherwise(F.lit("default! /* TODO: make one */"))
    text = F.concat(F.lit("public class "), "name", F.lit("Tests\n{\n    private readonly "), "name", F.lit(" _sut = "), sut, F.lit(";\n\n"), F.coalesce("body", F.lit("")), F.lit("}\n"))
    return rows.select("type", F.concat("name", F.lit("Tests")).alias("class_name"), text.alias("text"))


def search(facts: DataFrame, query: str, metadata: DataFrame | None = None) -> DataFrame:
    """``(id, full_name, name, kind, project, file, line, rank)``: types, then members, whose simple name holds the query, case ignored; exact first, then prefixes.

    Only if no type or member does, and the query has 3 characters or more, types of ``metadata(full_name, name)`` are looked at.
    """
    found = symbols(facts).withColumn("rank", match_rank(F.col("name"), query)).where("rank is not null").select("id", "full_name", "name", "kind", "project", "file", "line", "rank")
    if metadata is None or len(query) < 3:
        return found
    other = metadata.withColumn("rank", match_rank(F.col("name"), query)).where("rank is not null")
    none = found.limit(1).agg((F.count("*") == 0).alias("none")).where("none")
    other = other.join(F.broadcast(none)).select(F.col("full_name").alias("id"), "full_name", "name", F.lit("metadata").alias("kind"), F.lit("").alias("project"), F.lit("").alias("file"), F.lit(0).alias("line"), "rank")
    return found.unionByName(other)


# Attributes that excuse a symbol without references, by reason.
EXCUSES = {
    "mcpTool": ["McpServerTool", "McpServerToolType", "McpServerPrompt", "McpServerResource"],
    "generated": ["GeneratedCode", "CompilerGenerated"],
    "testMethod": [*TEST_ATTRIBUTES, "SetUp", "TearDown", "OneTimeSetUp", "OneTimeTearDown", "TestInitialize", "TestCleanup"],
    "testContainer": ["TestFixture", "TestClass", "Collection"],
    "composition": ["Export", "InheritedExport", "Import", "ImportMany", "ImportingConstructor"],
    "interop": ["FieldOffset", "MarshalAs", "StructLayout", "InlineArray"],
}


def excuses(facts: DataFrame) -> DataFrame:
    """``(symbol, reason)``: the first reason, in the order of ``EXCUSES``, that excuses a type or member by its own attributes or its type's; a type with a test, or below one, is a test container."""
    short = F.regexp_replace(last_segment(F.col("name")), "Attribute$", "")
    rank = F.lit(None).cast("int")
    for n, names in reversed(list(enumerate(EXCUSES.values()))):
        rank = F.when(F.col("short").isin(names), n).otherwise(rank)
    marked = facts.where("kind = 'attribute'").withColumn("short", short).withColumn("rank", rank).where("rank is not null").select(F.col("container").alias("symbol"), "rank")
    members = facts.where("kind = 'member'").select(F.col("full_name").alias("symbol"), F.col("container").alias("type"), "detail").distinct()
    tests = marked.where("rank = 2").join(members, "symbol").select(F.col("type").alias("node"))
    containers = tests.unionByName(marked.where("rank = 3").select(F.col("symbol").alias("node"))).distinct()
    down = base_edges(facts).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    below = reach(down, containers).select(F.col("node").alias("symbol"), F.lit(3).alias("rank"))
    own = marked.where("rank <> 5 and rank <> 3").unionByName(below)
    interop = marked.where("rank = 5").join(members.where("detail = 'field'").select("symbol"), "symbol", "left_semi")
    by_type = own.where("rank <> 2").unionByName(marked.where("rank = 5")).withColumnRenamed("symbol", "type").join(members, "type").where("rank <> 5 or detail = 'field'").select("symbol", "rank")
    best = own.unionByName(interop).unionByName(by_type).groupBy("symbol").agg(F.min("rank").alias("rank"))
    return best.select("symbol", F.element_at(F.array(*(F.lit(x) for x in EXCUSES)), F.col("rank") + 1).alias("reason"))


def unused_symbols(facts: DataFrame, internal: bool = False, project: str | None = None) -> DataFrame:
    """``(id, name, kind, project, file, line, excused)``: types and members whose name nothing refers to, and what excuses each (null: nothing).

    Public ones, and with ``internal`` others too; interfaces, static types, types with a Main, overrides, constructors, operators and
    what is not a type, method, property, field or event are left out, as are members of a type that is unused itself, and of interfaces. Uses in generated
    files (by name) do not count.
    """
    rows = symbols(facts).where("kind in ('class', 'struct', 'record', 'enum', 'delegate', 'method', 'property', 'field', 'event') and name <> 'Main'")
    holders = facts.where("kind = 'type' and detail = 'interface'").select(F.col("full_name").alias("container")).distinct()
    mains = facts.where("kind = 'member' and name = 'Main'").select(F.col("container").alias("full_name")).distinct()
    access = accessibility(F.col("modifiers"), "private")
    rows = rows.where(~has_word(F.col("modifiers"), "override") & ~((F.col("what") == "type") & has_word(F.col("modifiers"), "static")))
    rows = rows.where((access == "public") if not internal else F.lit(True)).join(holders, "container", "left_anti").join(mains, "full_name", "left_anti")
    rows = rows if project is None else rows.where(F.lower("project") == project.lower())
    used = facts.where("kind = 'ref'").where(~F.lower("file").endswith(".g.cs")).select("name").distinct()
    implemented = facts.where("kind = 'member'").join(holders, "container", "left_semi").select("name").distinct()
    loose = rows.join(used, "name", "left_anti").join(implemented, "name", "left_anti")
    dead = loose.where("what = 'type'").select(F.col("full_name").alias("container")).distinct()
    loose = loose.join(dead, "container", "left_anti").join(excuses(facts).withColumnRenamed("symbol", "full_name"), "full_name", "left")
    return loose.select("id", "name", "kind", "project", "file", "line", F.col("reason").alias("excused"))


def obsolete_usage(facts: DataFrame) -> DataFrame:
    """``(name, is_error, n, first_file, message)``: symbols with an Obsolete attribute, and how often their names are used."""
    marked = facts.where("kind = 'attribute'").where(last_segment(F.col("name")).isin("Obsolete", "ObsoleteAttribute"))
    message = F.regexp_extract("detail", r'^"((?:[^"\\]|\\.)*)"', 1)
    marked = marked.groupBy(F.col("container").alias("symbol")).agg(F.max(F.col("detail").rlike(r",\s*(?:error\s*:\s*)?true\s*$")).alias("is_error"), F.min(message).alias("message"))
    uses = facts.where("kind = 'ref'").groupBy("name").agg(F.count("*").alias("n"), F.min("file").alias("first_file"))
    return marked.withColumn("name", last_segment(F.col("symbol"))).join(uses, "name").select(F.col("symbol").alias("name"), "is_error", "n", "first_file", "message")


def large_classes(facts: DataFrame, max_members: int = 20, max_lines: int = 500, project: str | None = None) -> DataFrame:
    """``(type, members, lines, size, project)``: types with at least so many members or lines."""
    types = facts.where("kind = 'type'").groupBy(F.col("full_name").alias("type")).agg(F.sum(F.col("end_line") - F.col("line") + 1).alias("lines"), F.min("project").alias("project"))
    members = facts.where("kind = 'member'").groupBy(F.col("container").alias("type")).agg(F.count("*").alias("members"))
    rows = types.join(members, "type", "left").withColumn("members", F.coalesce("members", F.lit(0)))
    rows = rows if project is None else rows.where(F.lower("project") == project.lower())
    return rows.where((F.col("members") >= max_members) | (F.col("lines") >= max_lines)).select("type", "members", "lines", F.greatest("members", "lines").alias("size"), "project")


def api_entries(facts: DataFrame) -> DataFrame:
    """A surface to compare: ``(name, kind, access, seq)`` with a smaller access for wider ones."""
    order = F.when(F.col("access") == "public", 0).when(F.col("access") == "protected internal", 1).otherwise(2)
    return public_api(facts).select(F.col("signature").alias("name"), "kind", order.alias("access"), F.struct("project", "file", "line").alias("seq"))


def read_baseline(facts: DataFrame, path: str) -> DataFrame:
    """The surface that a JSON file holds as a list of ``{"name", "kind", "accessibility"}``; later entries of a name win. Comments are allowed."""
    rows = facts.sparkSession.read.schema("name string, kind string, accessibility string").option("allowComments", True).json(path, multiLine=True)
    order = F.when(F.lower("accessibility") == "public", 0).when(F.lower("accessibility") == "protected internal", 1).otherwise(2)
    return rows.where("name is not null").select("name", "kind", order.alias("access"), F.monotonically_increasing_id().alias("seq"))


def breaking_changes(facts: DataFrame, baseline: DataFrame) -> DataFrame:
    """``(severity, change, name)`` of the facts' surface against ``baseline(name, kind, access, seq)``."""
    from .code_queries import breaking_changes as compare

    return compare(baseline, api_entries(facts)).select("severity", "change", "name")


def conflicts(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(id, path, line, n)``: errors ``(id, path, line, suppressed)`` that a change adds: for each id and path, case ignored, as many rows as there are more of
    them after than before, those on lines unseen before first."""

    def live(df: DataFrame) -> DataFrame:
        return df.where(~F.coalesce("suppressed", F.lit(False))).withColumn("key", F.lower("path"))

    had = live(before).groupBy("id", "key").agg(F.count("*").alias("had"), F.collect_set("line").alias("lines"))
    place = Window.partitionBy("id", "key").orderBy(F.array_contains(F.coalesce("lines", F.array().cast("array<int>")), F.col("line").cast("int")), "line", "path")
    size = Window.partitionBy("id", "key")
    rows = live(after).join(had, ["id", "key"], "left").withColumn("more", F.count("*").over(size) - F.coalesce("had", F.lit(0)))
    return rows.withColumn("n", F.row_number().over(place)).where("n <= more").select("id", "path", "line", "n")


def refuse_degraded(load_diagnostics: DataFrame) -> None:
    """An error if the load had failures ``(project, message)``: no change is planned on a snapshot with gaps."""
    rows = load_diagnostics.limit(10).collect()
    if rows:
        raise InvalidArgument("the snapshot was loaded with gaps", diagnostics=[r.asDict() for r in rows])


SEVERITIES = ["error", "warning", "info", "hidden"]


def diagnostics(rows: DataFrame, severity: str = "warning", project: str | None = None) -> DataFrame:
    """Rows ``(id, severity, suppressed, project, file, line, ...)`` that are not suppressed and at least as severe, with their ``rank``."""
    if severity.lower() not in SEVERITIES:
        raise InvalidArgument("unknown severity", severity=severity, known=SEVERITIES)
    rank = F.array_position(F.array(*(F.lit(s) for s in SEVERITIES)), F.lower("severity")).cast("int")
    out = rows.withColumn("rank", rank).where((F.col("rank") > 0) & (F.col("rank") <= SEVERITIES.index(severity.lower()) + 1) & ~F.coalesce("suppressed", F.lit(False)))
    return out if project is None else out.where(F.lower("project").contains(project.lower()))


def god_objects(facts: DataFrame, lines: int = 300, members: int = 15, fields: int = 10, least: int = 5) -> DataFrame:
    """``(type, lines, members, fields, n_in, n_out, axes)``: types over every size axis that ``least`` namespaces or more refer to, or that refer to as many, those of the framework not counted."""
    from .code_queries import god_objects as over

    types = facts.where("kind = 'type'").groupBy(F.col("full_name").alias("type"), "name", F.col("container").alias("ns")).agg(F.sum(F.col("end_line") - F.col("line") + 1).alias("lines"))
    counted = facts.where("kind = 'member'").groupBy(F.col("container").alias("type")).agg(F.count("*").alias("members"), F.count_if(F.col("detail") == "field").alias("fields"))
    sizes = types.join(counted, "type").select("type", "lines", "members", "fields")
    names = types.select("type", "name", "ns").where(~F.col("ns").rlike("^(?:" + "|".join(FRAMEWORK) + r")(?:\.|$)"))
    refs = facts.where("kind = 'ref'").select("name", F.col("container").alias("member")).distinct()
    owner = facts.where("kind = 'member'").select(F.col("full_name").alias("member"), F.col("container").alias("holder")).distinct()
    uses = refs.join(owner, "member").join(names, "name").where("holder <> type").join(names.select(F.col("type").alias("holder"), F.col("ns").alias("from_ns")), "holder")
    both = uses.select("type", F.lit("in").alias("way"), F.col("from_ns").alias("ns")).unionByName(uses.select(F.col("holder").alias("type"), F.lit("out").alias("way"), "ns"))
    return over(sizes, {"lines": lines, "members": members, "fields": fields}, both.distinct(), least, least).withColumn("axes", F.lit(3) + (F.col("n_in") >= least).cast("int") + (F.col("n_out") >= least).cast("int"))


def rename(facts: DataFrame, request: str, new_name: str) -> DataFrame:
    """``(what, file, line, col, end_col, old, new)``: the text edits of a rename, not applied, declarations and uses alike, and conflicts: members or types of the new name beside a renamed one.

    The request must name one simple name; overrides and overloads share it and are renamed with it.
    """
    if not re.fullmatch(r"@?[^\W\d]\w*", new_name):
        raise InvalidArgument("not a name", newName=new_name)
    asked = facts.sparkSession.createDataFrame([(request,)], "request string")
    found = resolve(facts, asked, required=True)
    names = [r.name for r in found.select("name").distinct().limit(2).collect()]
    if len(names) > 1:
        raise AmbiguousMatch("the request has several names", request=request, names=names)
    old = names[0]
    declared = facts.where(F.col("kind").isin("type", "member") & (F.col("name") == old)).join(found.select("full_name").distinct(), "full_name", "left_semi")
    spots = facts.where("kind = 'ref'").where(F.col("name") == old).select("file", "line", "col", F.lit("edit").alias("what"))
    heads = declared.select("file", "line", "col", F.lit("declaration").alias("what"))
    edits = spots.unionByName(heads).distinct().select("what", "file", "line", "col", (F.col("col") + len(old)).alias("end_col"), F.lit(old).alias("old"), F.lit(new_name).alias("new"))
    taken = facts.where(F.col("kind").isin("type", "member") & (F.col("name") == new_name)).join(found.select("container").distinct(), "container", "left_semi")
    clashes = taken.select(F.lit("conflict").alias("what"), "file", "line", "col", (F.col("col") + len(new_name)).alias("end_col"), F.col("name").alias("old"), F.lit(new_name).alias("new"))
    return edits.unionByName(clashes)


def doc_comment(xml: Column) -> Column:
    """``(summary, exceptions)`` of a documentation comment's XML: its summary as one line, and the types it says may be thrown."""
    whole = F.concat(F.lit("<doc>"), F.coalesce(xml, F.lit("")), F.lit("</doc>"))
    summary = F.trim(F.regexp_replace(F.xpath_string(whole, F.lit("//summary")), r"\s+", " "))
    thrown = F.transform(F.xpath(whole, F.lit("//exception/@cref")), lambda x: F.regexp_replace(x, r"^[A-Z]:", ""))
    return F.struct(summary.alias("summary"), thrown.alias("exceptions"))


def metadata_assemblies(types: DataFrame) -> DataFrame:
    """``(assembly, version, n_types)`` of ``types(assembly, version, full_name)``, each assembly and version once."""
    return types.groupBy("assembly", "version").agg(F.countDistinct("full_name").alias("n_types"))
