"""The query tools bound to C# text that is made of the driver's parts, and the same answers in SQL on the parts.

Each part is a file with one class, whose lines depend on its size, and a project by its brand; so what the extractor
and the tools find in the text can be worked out from the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.stack_trace import trace_rows
from factloom.operators import code_tools as T
from factloom.operators.shared import cut
from factloom.sources import csharp, solution

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _fill(template: str) -> Column:
    """A text with ``{k}`` (part key), ``{z}`` (size), ``{b}`` (brand), ``{next}`` and ``{root}`` filled in."""
    parts, rest = [], template
    columns = {"{k}": "k", "{z}": "z", "{b}": "b", "{next}": "next", "{root}": "root"}
    while rest:
        at, key = min(((rest.find(c), c) for c in columns if c in rest), default=(len(rest), ""))
        parts.append(F.lit(rest[:at]))
        if key:
            parts.append(F.col(columns[key]).cast("string"))
        rest = rest[at + len(key) :]
    return F.concat(*parts)


def _case(by: int, *texts: str) -> Column:
    out = F.lit("")
    for n, text in enumerate(texts):
        out = F.when(F.col("z") % by == n, _fill(text)).otherwise(out)
    return out


def sources(spark: SparkSession, d: str) -> DataFrame:
    """``(file, project, text)``, a file for each part."""
    parts = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("z"), F.regexp_replace("p_brand", "#", "").alias("b"))
    parts = parts.withColumn("next", F.col("k") + 1).withColumn("root", F.col("k") % 10)
    lines = [
        F.lit("using System;"),
        _fill("namespace {b};"),
        F.concat(F.when(F.col("z") % 5 == 0, F.lit('[Obsolete("x")] ')).otherwise(""), _fill("public class Part{k}"), _case(3, " : Root{root}, IDisposable", " : IThing")),
        F.lit("{"),
        F.lit("    public event EventHandler Sold;"),
        F.concat(F.lit("    private int "), F.when(F.col("z") % 4 == 0, "count").otherwise("_count"), F.lit(";")),
        _fill("    public Part{k}(int a) { _c = a; }"),
        _case(2, "    public static Part{k} operator +(Part{k} a, Part{k} b) => a;", "    public static implicit operator int(Part{k} a) => 1;"),
        F.concat(
            F.lit("    public "),
            _case(6, "async void Fire() { await RunAsync(); }", "void Fire() { RunAsync(); }", "async Task Fire() { RunAsync(); }", "int Fire() { return t.Result; }", "void Fire() { t.Wait(); }", "int Fire() { return t.GetAwaiter().GetResult(); }"),
        ),
        F.concat(_fill("    public int Score(int x) { if (x > {z} && x < 50) { return Part{next}.Max; }"), F.when(F.col("z") > 25, " for (;;) { x++; }").otherwise(""), F.lit(" return x; }")),
        F.concat(F.lit("    public void Use() { other.Sold "), F.when(F.col("z") % 2 == 0, "+=").otherwise("-="), F.when(F.col("z") % 7 == 0, " (s, e) => Go()").otherwise(_fill(" Part{k}.OnSold")), _fill("; new Part{next}(1).Score(2); }")),
        _case(
            8,
            '    public void Reg(IServices s) { s.AddScoped<IThing, Part{k}>(); typeof(Part{k}).GetMethod("Use"); }',
            "    public void Leak() { var d = new Stream1(); }",
            "    public void Risk() { try { throw new Core.Err{root}(); } catch (Err1) { } }",
            "    [Fact] public void Test1() { new Part{k}(1).Use(); }",
            "    [TestCase(1)] [TestCase(2)] public void Test2(int a) { Use(); }",
        ),
        F.lit("}"),
        F.when(F.col("k").between(1, 10), F.concat(_fill("public class Root{root}"), F.when(F.col("root") > 0, " : Root0").otherwise(""), F.lit(" { }"))).otherwise(""),
    ]
    return parts.select(F.concat(F.lit("Part"), "k", F.lit(".cs")).alias("file"), F.col("b").alias("project"), F.concat_ws("\n", *lines).alias("text"))


_facts: dict[tuple[str, str], DataFrame] = {}


def facts(spark: SparkSession, d: str) -> DataFrame:
    """The facts of ``sources``: a snapshot that is taken once in a session and folder."""
    key = spark.sparkContext.applicationId, d
    if key not in _facts:
        _facts[key] = cut(csharp.facts(sources(spark, d)))
    return _facts[key]


def _ask(spark: SparkSession, d: str, where: str, form: str = "Part{k}") -> DataFrame:
    rows = spark.read.parquet(f"{d}/part.parquet").where(where).select(F.col("p_partkey").alias("k"), F.col("p_size").alias("z"), F.regexp_replace("p_brand", "#", "").alias("b"), F.lit("").alias("next"), F.lit("").alias("root"))
    return rows.select(_fill(form).alias("request"))


_P = "WITH p AS (SELECT p_partkey AS k, CAST(p_size AS INT) AS z, replace(p_brand, '#', '') AS b, p_partkey % 10 AS root, replace(p_brand, '#', '') || '.Part' || p_partkey AS type, 'Part' || p_partkey || '.cs' AS file FROM part)"


@_query(
    f"""{_P}, t AS (SELECT * FROM p WHERE z = 7 OR z = 16), u AS (
SELECT t.k, 'usage' AS kind, 0 AS n FROM t UNION ALL SELECT t.k, 'read', 1 FROM t JOIN p ON p.k = t.k - 1 UNION ALL SELECT t.k, 'object_creation', 1 FROM t JOIN p ON p.k = t.k - 1
UNION ALL SELECT k, 'declaration', CASE WHEN z % 2 = 0 THEN 3 ELSE 1 END FROM t UNION ALL SELECT k, 'read', 1 FROM t WHERE z % 7 <> 0
UNION ALL SELECT k, unnest(['type_argument', 'typeof']), 1 FROM t WHERE z % 8 = 0)
SELECT 'Part' || k AS request, kind, CAST(sum(n) AS BIGINT) AS n FROM u GROUP BY ALL HAVING sum(n) > 0"""
)
def cs_find_references(spark: SparkSession, d: str) -> DataFrame:
    found = T.references(facts(spark, d), _ask(spark, d, "p_size in (7, 16)"))
    return found.groupBy("request", "kind").agg(F.count("*").alias("n"))


@_query(f"{_P} SELECT t.type AS request, p.type || '.Use' AS caller, p.file, CAST(11 AS INT) AS line, p.b AS project FROM p AS t JOIN p ON p.k = t.k - 1 WHERE t.z % 5 = 2 UNION SELECT t.type, t.type || '.Test1', t.file, 12, t.b FROM p AS t WHERE t.z % 5 = 2 AND t.z % 8 = 3")
def cs_find_callers(spark: SparkSession, d: str) -> DataFrame:
    return T.callers(facts(spark, d), _ask(spark, d, "p_size % 5 = 2", "{b}.Part{k}"))


@_query(f"{_P} SELECT b || '.Root' || root AS type, CAST(1 AS INT) AS depth FROM p WHERE k BETWEEN 1 AND 9 UNION ALL SELECT type, CASE WHEN root = 0 THEN 1 ELSE 2 END FROM p WHERE z % 3 = 0")
def cs_find_implementations(spark: SparkSession, d: str) -> DataFrame:
    return T.implementations(facts(spark, d), spark.createDataFrame([("Root0",)], "request string"))


@_query(f"{_P} SELECT 'Part' || k AS request, type, CASE WHEN z % 2 = 0 THEN '+' ELSE 'implicit' END AS token, CASE WHEN z % 2 = 0 THEN 'operator' ELSE 'conversion' END AS kind, CASE WHEN z % 2 = 0 THEN 2 ELSE 1 END AS arity, false AS checked, CASE WHEN z % 2 = 0 THEN 'Part' || k ELSE 'int' END AS result, CASE WHEN z % 2 = 0 THEN 'Part' || k || ', Part' || k ELSE 'Part' || k END AS params FROM p WHERE z <= 20")
def cs_get_operators(spark: SparkSession, d: str) -> DataFrame:
    return T.operators_of(facts(spark, d), _ask(spark, d, "p_size <= 20"))


@_query(f"{_P} SELECT file, z % 2 = 0 AS subscribes, CASE WHEN z % 7 = 0 THEN '<lambda at 11>' ELSE 'Part' || k || '.OnSold' END AS handler, type || '.Use' AS enclosing, b AS project FROM p")
def cs_find_event_subscribers(spark: SparkSession, d: str) -> DataFrame:
    asked = _ask(spark, d, "p_partkey = 7", "Part{k}.Sold")
    return T.event_subscribers(facts(spark, d), asked).select("file", "subscribes", "handler", "enclosing", "project")


@_query(f"{_P} SELECT kind, count(*) AS n FROM (SELECT unnest(['class', 'event', 'constructor', CASE WHEN z % 2 = 0 THEN 'operator' ELSE 'conversion' END, 'method', 'method', 'method'] || CASE WHEN z % 8 <= 4 THEN ['method'] ELSE [] END || CASE WHEN k BETWEEN 1 AND 10 THEN ['class'] ELSE [] END) AS kind FROM p) GROUP BY kind")
def cs_get_public_api_surface(spark: SparkSession, d: str) -> DataFrame:
    return T.public_api(facts(spark, d)).groupBy("kind").agg(F.count("*").alias("n"))


@_query(f"{_P} SELECT ['AsyncVoid', 'FireAndForget', 'MissingAwait', 'SyncOverAsyncResult', 'SyncOverAsyncWait', 'SyncOverAsyncGetResult'][z % 6 + 1] AS pattern, CASE WHEN z % 6 IN (1, 2) THEN 'Warning' ELSE 'Error' END AS severity, type || '.Fire' AS member, file, CAST(9 AS INT) AS line, b AS project FROM p")
def cs_find_async_violations(spark: SparkSession, d: str) -> DataFrame:
    return T.async_violations(facts(spark, d))


@_query(f"{_P} SELECT 'LocalNotDisposed' AS pattern, 'Warning' AS severity, type || '.Leak' AS member, 'd' AS name, file, CAST(12 AS INT) AS line, b AS project FROM p WHERE z % 8 = 1")
def cs_find_disposable_misuse(spark: SparkSession, d: str) -> DataFrame:
    return T.disposable_misuse(facts(spark, d), spark.createDataFrame([("Stream1",)], "type string"))


@_query(f"{_P} SELECT 'IThing' AS service, 'Part' || k AS implementation, 'Scoped' AS lifetime, file, CAST(12 AS INT) AS line, b AS project FROM p WHERE z % 8 = 0")
def cs_get_di_registrations(spark: SparkSession, d: str) -> DataFrame:
    return T.di_registrations(facts(spark, d), "IThing")


@_query(f"{_P} SELECT 'member_lookup' AS kind, 'typeof(Part' || k || ').GetMethod' AS target, type || '.Reg' AS member, file, CAST(12 AS INT) AS line, b AS project FROM p WHERE z % 8 = 0")
def cs_find_reflection_usage(spark: SparkSession, d: str) -> DataFrame:
    return T.reflection_usage(facts(spark, d))


@_query(f"{_P} SELECT 'PrivateFieldUnderscore' AS rule, type || '.count' AS name, '_count' AS suggestion, file, CAST(6 AS INT) AS line, b AS project FROM p WHERE z % 4 = 0")
def cs_find_naming_violations(spark: SparkSession, d: str) -> DataFrame:
    return T.naming_violations(facts(spark, d))


@_query(f"{_P} SELECT type AS target, file, CAST(3 AS INT) AS line, b AS project, '\"x\"' AS arguments FROM p WHERE z % 5 = 0")
def cs_find_attribute_usages(spark: SparkSession, d: str) -> DataFrame:
    return T.attribute_usages(facts(spark, d), "ObsoleteAttribute")


@_query(f"{_P} SELECT type || '.Score' AS member, file, CAST(10 AS INT) AS line, b AS project, CAST(4 AS INT) AS cyclomatic, CAST(3 AS INT) AS cognitive, CAST(1 AS INT) AS nesting FROM p WHERE z > 25")
def cs_get_complexity_metrics(spark: SparkSession, d: str) -> DataFrame:
    return T.complexity_metrics(facts(spark, d), 4)


@_query(f"{_P} SELECT 'Core.Err' || root AS exception, type || '.Risk' AS member, file, CAST(12 AS INT) AS line, b AS project FROM p WHERE z % 8 = 2 AND root = 1")
def cs_find_throw_sites(spark: SparkSession, d: str) -> DataFrame:
    return T.throw_sites(facts(spark, d), "Core.Err1").drop("col")


@_query(f"{_P} SELECT b AS project, count(*) AS n, true AS is_empty FROM p WHERE z % 8 = 2 GROUP BY b")
def cs_find_catch_blocks(spark: SparkSession, d: str) -> DataFrame:
    return T.catch_blocks(facts(spark, d), "Err1").groupBy("project", "is_empty").agg(F.count("*").alias("n"))


@_query(f"{_P} SELECT b AS project, CASE z % 8 WHEN 3 THEN 'XUnit' ELSE 'NUnit' END AS framework, CASE z % 8 WHEN 3 THEN 'Fact' ELSE 'TestCase' END AS attribute, count(*) AS n_tests, CAST(sum(CASE z % 8 WHEN 3 THEN 0 ELSE 2 END) AS BIGINT) AS n_rows, count(DISTINCT CASE WHEN z % 8 = 3 THEN k END) AS symbols FROM p WHERE z % 8 IN (3, 4) GROUP BY ALL")
def cs_get_test_summary(spark: SparkSession, d: str) -> DataFrame:
    return T.test_summary(facts(spark, d))


@_query(f"{_P} SELECT 'Part' || k || '.Part' || k AS request, CAST(1 AS INT) AS place, type || '.Part' || k || '(int)' AS signature, CAST(1 AS INT) AS n_params, 'public' AS modifiers, '' AS type FROM p WHERE z = 9")
def cs_get_overloads(spark: SparkSession, d: str) -> DataFrame:
    return T.overloads(facts(spark, d), _ask(spark, d, "p_size = 9", "Part{k}.Part{k}"))


@_query(f"{_P} SELECT 'Part' || k AS request, type, file, CAST(3 AS INT) AS line, b AS project, CASE z % 3 WHEN 0 THEN 'IDisposable,Root' || root WHEN 1 THEN 'IThing' ELSE '' END AS bases, 'int' AS injected, array_to_string(list_sort(['Fire', 'Score', 'Sold', 'Use', CASE WHEN z % 2 = 0 THEN 'operator +' ELSE 'implicit' END] || CASE WHEN z % 8 <= 4 THEN [['Reg', 'Leak', 'Risk', 'Test1', 'Test2'][z % 8 + 1]] ELSE [] END), ',') AS members FROM p WHERE z <= 16")
def cs_get_symbol_context(spark: SparkSession, d: str) -> DataFrame:
    out = T.symbol_context(facts(spark, d), _ask(spark, d, "p_size <= 16"))
    return out.select("request", "type", "file", "line", "project", *(F.array_join(c, ",").alias(c) for c in ("bases", "injected", "members")))


@_query(f"{_P} SELECT 'Part' || k AS request, 'constructor' AS how, type || '.Part' || k AS member, 'int' AS params FROM p WHERE z <= 12")
def cs_get_instantiation_options(spark: SparkSession, d: str) -> DataFrame:
    return T.instantiation_options(facts(spark, d), _ask(spark, d, "p_size <= 12"))


@_query(f"{_P} SELECT type || '.Score' AS id, 'Part' || k || '.score' AS request, file, CAST(10 AS INT) AS line FROM p WHERE z <= 10")
def cs_go_to_definition(spark: SparkSession, d: str) -> DataFrame:
    return T.definitions(facts(spark, d), _ask(spark, d, "p_size <= 10", "Part{k}.score")).select(F.regexp_replace("id", r"\(.*", "").alias("id"), "request", "file", "line")


@_query("SELECT 'src/P' || s_suppkey || '.csproj' AS path, unnest(['Lib' || s_nationkey, 'xunit']) AS name, unnest([CAST(s_nationkey AS VARCHAR) || '.1', '*']) AS version FROM supplier")
def get_nuget_dependencies(spark: SparkSession, d: str) -> DataFrame:
    nation = F.col("s_nationkey").cast("string")
    text = F.concat(F.lit('<Project Sdk="Microsoft.NET.Sdk"><!-- <PackageReference Include="Old" Version="0" /> --><ItemGroup><PackageReference Include="Lib'), nation, F.lit('"><Version>'), nation, F.lit('.1</Version></PackageReference><PackageReference Include="xunit"/></ItemGroup></Project>'))
    rows = spark.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.lit("src/P"), "s_suppkey", F.lit(".csproj")).alias("path"), text.alias("text"))
    return solution.packages(rows.unionByName(rows.select("path", F.lit("<Project><PackageReference Include='broken'").alias("text"))))


@_query(
    """SELECT event_id AS trace_id, CAST(unnest([0, 1, 2]) AS INT) AS position, unnest(['exception', 'frame', 'frame']) AS kind,
unnest(['App.Failure', 'App.User' || user_id || '.' || CASE event_type WHEN 'click' THEN 'Run' WHEN 'error' THEN 'Load.Inner' WHEN 'purchase' THEN 'Buy' ELSE 'User' || user_id END, 'App.Main.Start']) AS symbol,
unnest([NULL, CASE event_type WHEN 'click' THEN 'stateMachine' WHEN 'error' THEN 'localFunction' WHEN 'purchase' THEN 'lambda' ELSE 'constructor' END, 'method']) AS origin FROM events WHERE event_type IN ('click', 'error', 'purchase', 'signup')"""
)
def resolve_stack_trace(spark: SparkSession, d: str) -> DataFrame:
    user = F.concat(F.lit("   at App.User"), "user_id")
    shown = F.when(F.col("event_type") == "click", F.concat(user, F.lit(".<Run>d__4.MoveNext() in /src/A.cs:line 3"))).when(F.col("event_type") == "error", F.concat(user, F.lit(".<Load>g__Inner|3_0(Int32 x)"))).when(F.col("event_type") == "purchase", F.concat(user, F.lit(".<>c__DisplayClass2_0.<Buy>b__1(Object s, EventArgs e)"))).otherwise(F.concat(user, F.lit("..ctor(Int32 a)")))
    rows = spark.read.parquet(f"{d}/events.parquet").where("event_type in ('click', 'error', 'purchase', 'signup')")
    traces = rows.select(F.col("event_id").alias("trace_id"), F.concat(F.lit("App.Failure: no\n"), shown, F.lit("\n   at App.Main.Start(String[] args)")).alias("text"))
    return trace_rows(traces).select("trace_id", "position", "kind", "symbol", "origin")
