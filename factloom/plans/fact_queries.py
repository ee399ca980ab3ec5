"""The query tools over a table of facts that is made of the driver's tables by columns, without any text, and the same in SQL.

Nations are types in namespaces of their regions, and derive from nations of half their number. Parts are their members: methods (with
overloads), properties, fields, constructors, events, operators and factories. Lines use, call and subscribe to them; suppliers
register services, events reflect, customers are tests. Facts have the columns of ``factloom.sources.csharp.SCHEMA``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import code_tools as T
from factloom.operators import overviews
from factloom.operators.shared import cut
from factloom.sources.csharp import SCHEMA

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = f"WITH RECURSIVE {_FACTS} {sql}"
        return f

    return register


_KINDS = ["method", "property", "field", "constructor", "event", "operator", "method"]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _pick(index: Column, *values: Column | str) -> Column:
    return F.element_at(F.array(*(F.lit(v) if isinstance(v, str) else v for v in values)), (index + 1).cast("int"))


def _facts_of(rows: DataFrame, kind: str, **columns: Column | str) -> DataFrame:
    """Rows of ``SCHEMA``; what is not given is empty or 0."""
    out = []
    for name, type_ in (x.split(" ") for x in SCHEMA.split(", ")):
        value = columns.get(name, kind if name == "kind" else "exact" if name == "confidence" else "" if type_ == "string" else F.lit(0))
        out.append((F.lit(value) if isinstance(value, str) else value).cast(type_).alias(name))
    return rows.select(*out)


def _members(spark: SparkSession, d: str) -> DataFrame:
    nation = _t(spark, d, "nation").select((F.col("n_nationkey")).alias("t"), F.col("n_regionkey").alias("r"))
    p, z = F.col("p_partkey"), F.col("p_size")
    parts = _t(spark, d, "part").withColumn("t", (p % 25).cast("int")).join(nation, "t").withColumn("k", z % 7)
    type_ = _text("App.R", F.col("r"), ".N", F.col("t"))
    name = _pick(F.col("k"), _text("M", p % 30), _text("Pr", p % 50), _text("f", p % 50), _text("N", F.col("t")), _text("Ev", p % 20), F.when(p % 2 == 0, "operator +").otherwise("operator -"), _text("Make", p % 10))
    params = F.when(F.col("k").isin(0, 3), F.array_join(F.array_repeat(F.lit("int"), (p % 3).cast("int")), ", ")).when(F.col("k") == 5, _text("N", F.col("t"), ", N", F.col("t"))).otherwise("")
    flags = F.when(F.col("k").isin(5, 6), "public static").when(z % 3 == 0, "private").otherwise("public")
    result = F.when(F.col("k") == 6, _text("N", F.floor(p / 25).cast("long") % 25)).when(F.col("k") == 3, "").otherwise("int")
    return parts.select(p.alias("p"), "k", z.alias("z"), "t", type_.alias("container"), name.alias("name"), params.alias("params"), flags.alias("modifiers"), result.alias("result"), _text("P", F.col("r")).alias("project"))


def facts(spark: SparkSession, d: str) -> DataFrame:
    """All facts, written once for each call."""
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    nation = _t(spark, d, "nation")
    full = _text("App.R", r, ".N", n)
    types = _facts_of(nation, "type", file=_text("N", n, ".cs"), project=_text("P", r), name=_text("N", n), full_name=full, container=_text("App.R", r), line=F.lit(1), end_line=200 + n, modifiers=F.when(n % 5 == 0, "internal").otherwise(F.when(n % 4 == 3, "public abstract").otherwise("public")), detail=_pick(n % 4, "class", "interface", "struct", "class"))
    bases = _facts_of(nation.where("n_nationkey >= 2"), "base", file=_text("N", n, ".cs"), project=_text("P", r), name=_text("N", F.floor(n / 2).cast("int")), container=full)
    m = _members(spark, d)
    at = (F.col("p") % 90 + 2).cast("int")
    members = _facts_of(m, "member", file=_text("N", F.col("t"), ".cs"), project=F.col("project"), name=F.col("name"), full_name=_text(F.col("container"), ".", F.col("name")), container=F.col("container"), line=at, end_line=at + F.col("z") % 5, modifiers=F.col("modifiers"), detail=_pick(F.col("k"), *_KINDS), type=F.col("result"), extra=F.col("params"), n=F.when(F.col("k") == 0, F.col("z")).otherwise(0))
    lines = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").join(m.select(F.col("p").alias("l_partkey"), "k", F.col("name")), "l_partkey")
    caller = m.where("k = 0").select(F.col("p").alias("l_suppkey"), _text(F.col("container"), ".", F.col("name")).alias("own"))
    lines = lines.join(caller, "l_suppkey", "left").withColumn("enclosing", F.coalesce("own", _text("App.Use.O", F.col("l_orderkey") % 50, ".Run")))
    place = {"file": _text("O", F.col("l_orderkey"), ".cs"), "project": _text("P", F.col("l_suppkey") % 5), "line": F.col("l_linenumber"), "col": (F.col("l_partkey") % 1000 * 10 + F.col("l_suppkey") % 10).cast("int"), "container": F.col("enclosing"), "name": F.col("name")}
    calls = _facts_of(lines.where("k in (0, 3, 6)"), "call", detail=F.when(F.col("k") == 3, "constructor").otherwise("method"), **place)
    events = _facts_of(lines.where("k = 4"), "subscribe", detail=F.when(F.col("l_returnflag") == "A", "+=").otherwise("-="), extra=_text("H", F.col("l_suppkey")), **place)
    s = F.col("s_suppkey")
    services = _facts_of(_t(spark, d, "supplier"), "call", file=_text("S", s, ".cs"), project=_text("P", s % 5), line=(s % 40).cast("int"), container=_text("App.Boot.S", s), detail="method", name=_pick(s % 4, "AddScoped", "TryAddSingleton", "AddKeyedTransient", "AddOther"), type=F.when(s % 3 == 0, _text("N", F.col("s_nationkey"), ", App.R1.N", s % 25)).otherwise(_text("N", F.col("s_nationkey"))), n=F.when(s % 3 == 2, 1).otherwise(0))
    e = F.col("event_id")
    reflect = _facts_of(_t(spark, d, "events").where("event_type = 'signup'"), "call", file=_text("E", e % 100, ".cs"), project=_text("P", e % 5), line=(e % 500).cast("int"), container=_text("App.Run.U", F.col("user_id")), detail="method", name=_pick(e % 5, "GetMethod", "CreateInstance", "Invoke", "Find", "GetType"), extra=_pick(e % 3, _text("typeof(N", F.col("user_id") % 25, ")"), "Activator", "thing"))
    c = F.col("c_custkey")
    test = {"file": _text("C", c, ".cs"), "project": _text("T", F.col("c_nationkey") % 3), "container": _text("App.Tests.C", c)}
    customers = _t(spark, d, "customer")
    marks = _facts_of(customers, "attribute", name=_pick(c % 5, "Fact", "Theory", "TestMethod", "Obsolete", "Xunit.FactAttribute"), line=F.lit(3), **test)
    rows = _facts_of(customers.where("c_custkey % 5 = 1").withColumn("i", F.explode(F.sequence(F.lit(1), (c % 4 + 1).cast("int")))), "attribute", name="InlineData", line=3 + F.col("i"), **test)
    refs = _facts_of(customers, "ref", name=_pick(c % 2, _text("N", F.col("c_nationkey")), "Other"), detail="usage", line=F.lit(9), **test)
    out = types
    for part in (bases, members, calls, events, services, reflect, marks, rows, refs):
        out = out.unionByName(part)
    return cut(out)


_FACTS = """m0 AS (SELECT p_partkey AS p, CAST(p_size AS INT) AS z, p_size % 7 AS k, p_partkey % 25 AS t, n_regionkey AS r FROM part JOIN nation ON p_partkey % 25 = n_nationkey),
m AS (SELECT *, 'App.R' || r || '.N' || t AS container, CASE k WHEN 0 THEN 'M' || (p % 30) WHEN 1 THEN 'Pr' || (p % 50) WHEN 2 THEN 'f' || (p % 50) WHEN 3 THEN 'N' || t WHEN 4 THEN 'Ev' || (p % 20) WHEN 5 THEN CASE WHEN p % 2 = 0 THEN 'operator +' ELSE 'operator -' END ELSE 'Make' || (p % 10) END AS name,
  CASE WHEN k IN (0, 3) THEN array_to_string(['int', 'int'][1:p % 3], ', ') WHEN k = 5 THEN 'N' || t || ', N' || t ELSE '' END AS params, CASE WHEN k IN (5, 6) THEN 'public static' WHEN z % 3 = 0 THEN 'private' ELSE 'public' END AS modifiers,
  CASE k WHEN 6 THEN 'N' || (p // 25 % 25) WHEN 3 THEN '' ELSE 'int' END AS result, 'P' || r AS project, 'N' || t || '.cs' AS file, CAST(p % 90 + 2 AS INT) AS line, CAST(p % 90 + 2 + z % 5 AS INT) AS end_line FROM m0),
ty AS (SELECT 'N' || n_nationkey AS name, 'App.R' || n_regionkey || '.N' || n_nationkey AS type, 'N' || n_nationkey || '.cs' AS file, CAST(1 AS INT) AS line, 'P' || n_regionkey AS project, n_nationkey AS n, CASE WHEN n_nationkey // 2 >= 0 AND n_nationkey >= 2 THEN 'N' || (n_nationkey // 2) END AS base FROM nation),
sy AS (SELECT * FROM (SELECT *, container || '.' || name || CASE WHEN k IN (0, 3, 5, 6) THEN '(' || params || ')' ELSE '' END AS id, row_number() OVER (PARTITION BY container, name, params, k IN (0, 3, 5, 6) ORDER BY project, file, line, end_line, modifiers, result) AS first FROM m) WHERE first = 1),
li AS (SELECT l.*, m.k, m.name, coalesce(c.container || '.' || c.name, 'App.Use.O' || (l_orderkey % 50) || '.Run') AS enclosing FROM lineitem l JOIN m ON l_partkey = m.p LEFT JOIN m c ON l_suppkey = c.p AND c.k = 0),
su AS (SELECT base AS lower, type AS upper FROM (SELECT a.type AS base, b.type FROM ty a JOIN ty b ON a.base = b.name)),
cl(lower, upper) AS (SELECT lower, upper FROM su UNION SELECT cl.lower, su.upper FROM cl JOIN su ON cl.upper = su.lower),
cx AS (SELECT ty.*, coalesce(base, '') AS bases, CASE WHEN EXISTS (SELECT 1 FROM m WHERE m.container = ty.type AND k = 3 AND params <> '') THEN 'int' ELSE '' END AS injected,
  coalesce((SELECT string_agg(DISTINCT m.name, ',' ORDER BY m.name) FROM m WHERE m.container = ty.type AND k <> 3 AND modifiers <> 'private'), '') AS members FROM ty),
dg AS (SELECT 'D' || (o_orderkey % 9) AS id, CASE WHEN o_orderstatus = 'F' THEN 'Error' ELSE 'warning' END AS severity, CASE WHEN o_orderkey % 3 = 0 THEN 'n' || (o_custkey % 40) || '.CS' ELSE 'N' || (o_custkey % 40) || '.cs' END AS file FROM orders WHERE o_orderkey % 2 = 0)"""


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "nation").select(_text("N", F.col("n_nationkey")).alias("request"))


def _diagnostics(spark: SparkSession, d: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey") % 40
    rows = _t(spark, d, "orders").where("o_orderkey % 2 = 0")
    return rows.select(_text("D", o % 9).alias("id"), F.when(F.col("o_orderstatus") == "F", "Error").otherwise("warning").alias("severity"), F.when(o % 3 == 0, _text("n", c, ".CS")).otherwise(_text("N", c, ".cs")).alias("file"), F.lit(1).alias("line"))


def _joined(df: DataFrame, *columns: str) -> DataFrame:
    """Arrays as texts."""
    return df.withColumns({c: F.array_join(c, ",") for c in columns})


@_query("SELECT name AS request, type, file, line, project, bases, injected, members FROM cx")
def facts_symbol_context(spark: SparkSession, d: str) -> DataFrame:
    return _joined(T.symbol_context(facts(spark, d), _asked(spark, d)), "bases", "injected", "members")


@_query("""SELECT name AS request, type, file, line, project, bases, injected, members, coalesce((SELECT string_agg(upper, ',' ORDER BY upper) FROM cl WHERE cl.lower = cx.type), '') AS ancestors, coalesce((SELECT string_agg(lower, ',' ORDER BY lower) FROM cl WHERE cl.upper = cx.type), '') AS derived,
(SELECT count(*) FROM dg WHERE lower(dg.file) = lower(cx.file)) AS n_diagnostics, coalesce((SELECT string_agg(DISTINCT id, ',' ORDER BY id) FROM dg WHERE lower(dg.file) = lower(cx.file)), '') AS diagnostics FROM cx""")
def facts_type_overview(spark: SparkSession, d: str) -> DataFrame:
    out = overviews.type_overviews(facts(spark, d), _asked(spark, d), _diagnostics(spark, d))
    return _joined(out, "bases", "injected", "members", "ancestors", "derived", "diagnostics")


@_query("""SELECT coalesce(a.file, b.file) AS file, coalesce(types, '') AS types, coalesce(n_types, 0) AS n_types, coalesce(n_members, 0) AS n_members, coalesce(n_errors, 0) AS n_errors, coalesce(n_warnings, 0) AS n_warnings
FROM (SELECT lower(file) AS low, min(file) AS file, string_agg(DISTINCT type, ',') AS types, count(type) AS n_types, count(*) FILTER (type IS NULL) AS n_members FROM (SELECT file, name AS type FROM ty UNION ALL SELECT file, NULL FROM m) GROUP BY 1) a
FULL JOIN (SELECT lower(file) AS low, min(file) AS file, count(*) FILTER (severity = 'Error') AS n_errors, count(*) FILTER (severity = 'warning') AS n_warnings FROM dg GROUP BY 1) b ON a.low = b.low""")
def facts_file_overview(spark: SparkSession, d: str) -> DataFrame:
    # only declarations here: uses stand in files of their own
    return _joined(overviews.file_overviews(facts(spark, d), _diagnostics(spark, d)), "types")


@_query("""SELECT 'N' || t || '.' || name AS request, CAST(row_number() OVER (PARTITION BY container, name ORDER BY n_params, id) AS INT) AS place, id AS signature, n_params, modifiers, result AS type
FROM (SELECT *, CAST(CASE WHEN params = '' THEN 0 ELSE len(string_split(params, ', ')) END AS INT) AS n_params FROM sy WHERE k IN (0, 3))""")
def facts_overloads(spark: SparkSession, d: str) -> DataFrame:
    asked = _members(spark, d).where("k in (0, 3)").select(_text("N", F.col("t"), ".", F.col("name")).alias("request"))
    return T.overloads(facts(spark, d), asked)


@_query("SELECT 'N' || t AS request, container AS type, replace(name, 'operator ', '') AS token, 'operator' AS kind, CAST(2 AS INT) AS arity, false AS checked, result, params FROM m WHERE k = 5")
def facts_operators(spark: SparkSession, d: str) -> DataFrame:
    return T.operators_of(facts(spark, d), _asked(spark, d))


@_query("SELECT DISTINCT name AS request, 'O' || l_orderkey || '.cs' AS file, l_linenumber AS line, count(*) FILTER (l_returnflag = 'A') > 0 AS subscribes, count(DISTINCT enclosing) AS n FROM li WHERE k = 4 GROUP BY name, l_orderkey, l_linenumber")
def facts_event_subscribers(spark: SparkSession, d: str) -> DataFrame:
    asked = _members(spark, d).where("k = 4").select(F.col("name").alias("request")).distinct()
    rows = T.event_subscribers(facts(spark, d), asked)
    return rows.groupBy("request", "file", "line").agg(F.max("subscribes").alias("subscribes"), F.countDistinct("enclosing").alias("n"))


@_query("""SELECT 'N' || t AS request, 'constructor' AS how, container || '.' || name AS member, params FROM m WHERE k = 3 AND modifiers = 'public'
UNION ALL SELECT name, 'constructor', type || '.' || name, '' FROM ty WHERE n % 4 IN (0, 2) AND type NOT IN (SELECT container FROM m WHERE k = 3)
UNION ALL SELECT result, 'factory', container || '.' || m.name, '' FROM m JOIN ty ON result = ty.name WHERE k = 6""")
def facts_instantiation_options(spark: SparkSession, d: str) -> DataFrame:
    return T.instantiation_options(facts(spark, d), _asked(spark, d))


@_query("""SELECT 'N' || s_nationkey AS service, CASE s_suppkey % 3 WHEN 0 THEN 'App.R1.N' || (s_suppkey % 25) WHEN 2 THEN '(factory)' ELSE 'N' || s_nationkey END AS implementation, ['Scoped', 'Singleton', 'Transient'][s_suppkey % 4 + 1] AS lifetime,
'S' || s_suppkey || '.cs' AS file, CAST(s_suppkey % 40 AS INT) AS line, 'P' || (s_suppkey % 5) AS project FROM supplier WHERE s_suppkey % 4 < 3""")
def facts_di_registrations(spark: SparkSession, d: str) -> DataFrame:
    return T.di_registrations(facts(spark, d))


@_query("""SELECT CASE event_id % 5 WHEN 0 THEN 'member_lookup' WHEN 1 THEN 'instantiation' WHEN 2 THEN 'invocation' ELSE 'type_lookup' END AS kind,
CASE event_id % 3 WHEN 0 THEN 'typeof(N' || (user_id % 25) || ')' ELSE 'Activator' END || '.' || ['GetMethod', 'CreateInstance', 'Invoke', '', 'GetType'][event_id % 5 + 1] AS target, 'App.Run.U' || user_id AS member, 'E' || (event_id % 100) || '.cs' AS file, CAST(event_id % 500 AS INT) AS line, 'P' || (event_id % 5) AS project
FROM events WHERE event_type = 'signup' AND event_id % 5 <> 3 AND event_id % 3 < 2""")
def facts_reflection_usage(spark: SparkSession, d: str) -> DataFrame:
    return T.reflection_usage(facts(spark, d))


@_query("""SELECT 'T' || (c_nationkey % 3) AS project, CASE c_custkey % 5 WHEN 2 THEN 'MSTest' ELSE 'XUnit' END AS framework, CASE c_custkey % 5 WHEN 1 THEN 'Theory' WHEN 2 THEN 'TestMethod' ELSE 'Fact' END AS attribute, count(*) AS n_tests,
CAST(sum(CASE c_custkey % 5 WHEN 1 THEN c_custkey % 4 + 1 ELSE 0 END) AS BIGINT) AS n_rows, count(DISTINCT CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END) AS symbols FROM customer WHERE c_custkey % 5 <> 3 GROUP BY 1, 2, 3""")
def facts_test_summary(spark: SparkSession, d: str) -> DataFrame:
    return T.test_summary(facts(spark, d))


@_query("""SELECT 'N' || t || '.' || name AS request, signature, file, line, n_overloads,
coalesce((SELECT string_agg(DISTINCT enclosing, ',' ORDER BY enclosing) FROM li WHERE li.k IN (0, 6) AND li.name = f.name), '') AS callers, coalesce((SELECT string_agg(DISTINCT li.name, ',' ORDER BY li.name) FROM li WHERE li.k IN (0, 3, 6) AND li.enclosing = f.full_name), '') AS callees
FROM (SELECT t, name, container || '.' || name AS full_name, arg_min(id, (project, file, line, id)) AS signature, arg_min(file, (project, file, line, id)) AS file, arg_min(line, (project, file, line, id)) AS line, count(*) AS n_overloads FROM sy WHERE k = 0 GROUP BY t, name, container) f""")
def facts_analyze_method(spark: SparkSession, d: str) -> DataFrame:
    asked = _members(spark, d).where("k = 0").select(_text("N", F.col("t"), ".", F.col("name")).alias("request"))
    return _joined(overviews.analyze_methods(facts(spark, d), asked), "callers", "callees")


@_query("""SELECT 'N' || t || '.' || name AS request, 'ok' AS status, id, file, line, (SELECT string_agg(CASE WHEN i % 7 = 0 THEN '' ELSE 'line ' || i || ' of N' || t END, chr(10) ORDER BY i) FROM (SELECT unnest(range(line, end_line + 1)) AS i) WHERE i >= CASE WHEN line % 7 = 0 THEN line + 1 ELSE line END) AS text, NULL AS candidates FROM sy WHERE k IN (0, 1, 3, 5, 6) AND NOT (line % 7 = 0 AND end_line = line)
UNION ALL SELECT 'N' || t || '.' || name, 'ok', id, file, line, '', NULL FROM sy WHERE k IN (0, 1, 3, 5, 6) AND line % 7 = 0 AND end_line = line
UNION ALL SELECT 'N' || t || '.' || name, 'unsupportedKind', id, NULL, NULL, NULL, NULL FROM sy WHERE k IN (2, 4)
UNION ALL SELECT name, CASE WHEN count(DISTINCT container) > 1 THEN 'ambiguous' ELSE NULL END, NULL, NULL, NULL, NULL, string_agg(DISTINCT container || '.' || name, ',' ORDER BY container || '.' || name) FROM sy WHERE k = 6 GROUP BY name HAVING count(DISTINCT container) > 1
UNION ALL SELECT 'Lib.C' || c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'metadata' ELSE 'notFound' END, NULL, NULL, NULL, NULL, NULL FROM customer""")
def facts_method_source(spark: SparkSession, d: str) -> DataFrame:
    """Every member's text by its lines, factories by simple name, and names that only metadata has or nothing."""
    m = _members(spark, d)
    outside = _t(spark, d, "customer").select(_text("Lib.C", F.col("c_custkey")).alias("request"), "c_custkey")
    several = m.where("k = 6").groupBy("name").agg(F.countDistinct("container").alias("n")).where("n > 1").select(F.col("name").alias("request"))
    asked = m.select(_text("N", F.col("t"), ".", F.col("name")).alias("request")).unionByName(several).unionByName(outside.select("request"))
    i = F.sequence(F.lit(1), F.lit(120))
    n = F.col("n_nationkey").cast("string")
    text = F.array_join(F.transform(i, lambda x: F.when(x % 7 == 0, "").otherwise(F.concat(F.lit("line "), x.cast("string"), F.lit(" of N"), n))), "\n")
    files = _t(spark, d, "nation").select(_text("N", F.col("n_nationkey"), ".cs").alias("file"), text.alias("text"))
    return overviews.method_sources(facts(spark, d), asked, files, outside.where("c_custkey % 2 = 0").select(F.col("request").alias("full_name")))


@_query("""SELECT request, how, member, params, is_async, CAST(accessible AS VARCHAR) AS accessible FROM (SELECT 'N' || t AS request, 'constructor' AS how, container || '.' || m.name AS member, params, false AS is_async, modifiers = 'public' AS accessible FROM m JOIN ty ON m.container = ty.type WHERE k = 3 AND (n % 4 IN (0, 2) OR n = 15)
UNION ALL SELECT name, 'constructor', type || '.' || name, '', false, n % 5 <> 0 OR project IN ('P0', 'P2') FROM ty WHERE (n % 4 IN (0, 2) OR n = 15) AND type NOT IN (SELECT container FROM m WHERE k = 3)
UNION ALL SELECT result, 'factory', container || '.' || m.name, '', false, true FROM m JOIN ty ON result = ty.name WHERE k = 6
UNION ALL SELECT 'N' || s_nationkey, 'factory', 'App.Make.S' || s_suppkey || '.NewAsync', 'int', true, CASE s_suppkey % 3 WHEN 0 THEN true WHEN 1 THEN 'P' || (s_suppkey % 5) IN ('P0', 'P2') ELSE false END FROM supplier
UNION ALL SELECT * FROM (SELECT DISTINCT unnest(list_distinct(['N' || s_nationkey, CASE s_suppkey % 3 WHEN 0 THEN 'N' || (s_suppkey % 25) WHEN 1 THEN 'N' || s_nationkey END])) AS request, 'registration', 'N' || s_nationkey, ['Scoped', 'Singleton', 'Transient'][s_suppkey % 4 + 1], false, NULL FROM supplier WHERE s_suppkey % 4 < 3) WHERE request IS NOT NULL
UNION ALL SELECT request, 'required', member, 'int', false, NULL FROM (SELECT ty.name AS request, q.type || '.Id' AS member, row_number() OVER (PARTITION BY ty.name ORDER BY d, q.type) AS first FROM ty JOIN (WITH RECURSIVE w(lower, upper, d) AS (SELECT type, type, 0 FROM ty UNION ALL SELECT w.lower, su.upper, d + 1 FROM w JOIN su ON w.upper = su.lower) SELECT lower, upper, d FROM w WHERE NOT (d > 0 AND lower = upper)) c ON c.lower = ty.type JOIN ty q ON q.type = c.upper AND q.n % 3 = 1) WHERE first = 1)""")
def facts_creation_options(spark: SparkSession, d: str) -> DataFrame:
    """Every way to get each nation's type as project P0 sees it, which is a friend of P2."""
    s = F.col("s_suppkey")
    makers = _facts_of(_t(spark, d, "supplier"), "member", file=_text("S", s, ".cs"), project=_text("P", s % 5), name="NewAsync", full_name=_text("App.Make.S", s, ".NewAsync"), container=_text("App.Make.S", s), detail="method", modifiers=_pick(s % 3, "public static", "internal static", "static"), type=_text("System.Task<App.N", F.col("s_nationkey"), ">"), extra="int")
    n = F.col("n_nationkey")
    home = _text("App.R", F.col("n_regionkey"), ".N", n)
    needed = _facts_of(_t(spark, d, "nation").where("n_nationkey % 3 = 1"), "member", file=_text("N", n, ".cs"), project=_text("P", F.col("n_regionkey")), name="Id", full_name=F.concat(home, F.lit(".Id")), container=home, detail="property", modifiers="public required", type="int")
    friends = spark.createDataFrame([("P2", "P0"), ("P3", "P1")], "project string, friend string")
    found = overviews.creation_options(facts(spark, d).unionByName(makers).unionByName(needed), _asked(spark, d), friends, "p0")
    return found.withColumn("accessible", F.col("accessible").cast("string"))


@_query("""SELECT 'T' || p_partkey AS type, CASE p_size % 3 WHEN 0 THEN 'interface' ELSE 'class' END AS kind, lower(p_type) AS modifiers, 'B' || (p_size % 4) AS base,
CASE WHEN p_size % 3 = 0 AND p_partkey >= 30 THEN 'T' || (p_partkey - 30) ELSE '' END AS interfaces, (SELECT coalesce(string_agg(DISTINCT 'M' || l_linenumber || '(' || (l_suppkey % 3) || ')', ',' ORDER BY 'M' || l_linenumber || '(' || (l_suppkey % 3) || ')'), '') FROM lineitem WHERE l_returnflag <> 'R' AND (l_partkey = p_partkey OR (p_size % 3 = 0 AND l_partkey IN (SELECT upper FROM ups WHERE lower = p_partkey)))) AS members, p_name AS summary
FROM part WHERE p_size > 5 AND p_brand = 'Brand#12' AND p_type <> 'PROMO'""")
def facts_assembly_namespace(spark: SparkSession, d: str) -> DataFrame:
    """A brand's namespace of an assembly of parts: interfaces extend the interface 30 numbers below."""
    p, z = F.col("p_partkey"), F.col("p_size")
    part = _t(spark, d, "part")
    types = part.select(_text("T", p).alias("type"), F.col("p_name").alias("name"), F.lit("Parts").alias("assembly"), F.col("p_brand").alias("namespace"), F.when(z % 3 == 0, "interface").otherwise("class").alias("kind"), F.when(z > 5, "public").otherwise("internal").alias("access"), F.when(F.col("p_type") == "PROMO", "Outer").alias("container"), F.lower("p_type").alias("modifiers"), _text("B", z % 4).alias("base"), F.col("p_name").alias("summary"))
    lines = _t(spark, d, "lineitem")
    members = lines.select(_text("T", F.col("l_partkey")).alias("type"), _text("M", F.col("l_linenumber"), "(", F.col("l_suppkey") % 3, ")").alias("signature"), F.when(F.col("l_returnflag") == "R", "private").otherwise("public").alias("access"))
    bases = part.where("p_size % 3 = 0 and p_partkey >= 30").select(_text("T", p).alias("src"), _text("T", p - 30).alias("dst"))
    return _joined(overviews.assembly_namespace(types, members, bases, "parts", "Brand#12"), "interfaces", "members")


ORACLE_SQL["facts_assembly_namespace"] = ORACLE_SQL["facts_assembly_namespace"].replace("WITH RECURSIVE ", "WITH RECURSIVE ups(lower, upper) AS (SELECT p_partkey, p_partkey - 30 FROM part WHERE p_size % 3 = 0 AND p_partkey >= 30 UNION SELECT lower, upper - 30 FROM ups JOIN part ON p_partkey = upper WHERE p_size % 3 = 0 AND upper >= 30), ", 1)


@_query("""SELECT id, path, line, CAST(n AS INT) AS n FROM (SELECT r.id, r.path, r.line, row_number() OVER (PARTITION BY r.id, lower(r.path) ORDER BY coalesce(list_contains(lines, r.line), false), r.line, r.path) AS n, count(*) OVER (PARTITION BY r.id, lower(r.path)) - coalesce(had, 0) AS more
FROM ce r LEFT JOIN (SELECT id, lower(path) AS low, count(*) AS had, list(DISTINCT line) AS lines FROM ce WHERE late = 0 GROUP BY ALL) h ON h.id = r.id AND h.low = lower(r.path) WHERE late = 1) WHERE n <= more""")
def facts_conflicts_of_change(spark: SparkSession, d: str) -> DataFrame:
    """New errors in project 2 and those that refer to it."""
    e, u = F.col("event_id"), F.col("user_id")
    rows = _t(spark, d, "events").where("event_type in ('error', 'click')").select(F.col("event_type").alias("id"), F.when(e % 3 == 0, _text("u", u)).otherwise(_text("U", u)).alias("path"), F.floor("value").cast("int").alias("line"), F.lit(False).alias("suppressed"), (u % 12).cast("string").alias("project"), (e % 2).alias("late"))
    references = _t(spark, d, "nation").where("n_nationkey between 1 and 11 and n_nationkey % 4 <> 1").select(F.col("n_nationkey").cast("string").alias("src"), (F.col("n_nationkey") - 1).cast("string").alias("dst"))
    changed = spark.createDataFrame([("2",)], "project string")
    return overviews.conflicts_of_change(rows.where("late = 0").drop("late"), rows.where("late = 1").drop("late"), changed, references)


ORACLE_SQL["facts_conflicts_of_change"] = ORACLE_SQL["facts_conflicts_of_change"].replace("WITH RECURSIVE ", "WITH RECURSIVE tp(p) AS (SELECT 2 UNION SELECT n_nationkey FROM tp JOIN nation ON n_nationkey - 1 = p WHERE n_nationkey BETWEEN 1 AND 11 AND n_nationkey % 4 <> 1), ce AS (SELECT event_type AS id, CASE WHEN event_id % 3 = 0 THEN 'u' ELSE 'U' END || user_id AS path, CAST(floor(value) AS INT) AS line, event_id % 2 AS late FROM events WHERE event_type IN ('error', 'click') AND user_id % 12 IN (SELECT p FROM tp)), ", 1)
