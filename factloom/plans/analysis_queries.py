"""Data flow, extension methods, kept closures, stack frames and project files bound to the driver's tables, and the same in SQL.

Roles: a user's events are a method, three events a block; clicks branch and errors loop back. Customers have generic types
made of nations, suppliers declare extension methods. Parts are symbols that the traces of orders name; they also make project files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.stack_trace import resolved_frames, trace_rows
from factloom.operators import closure, data_flow, graph, type_terms
from factloom.operators.shared import cut, shared_path
from factloom.sources import project_xml

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


@_query("""WITH RECURSIVE e AS (SELECT user_id AS scope, CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / 3) AS INT) AS node, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i,
  'v' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 6) AS var, event_type, event_type IN ('signup', 'purchase', 'error') AS writes FROM events),
last AS (SELECT scope, node, arg_max(event_type, i) AS kind, max(node) OVER (PARTITION BY scope) AS top FROM e GROUP BY scope, node),
steps AS (SELECT scope, node AS src, node + 1 AS dst FROM last WHERE node < top UNION SELECT scope, node, node + 2 FROM last WHERE kind = 'click' AND node + 2 <= top UNION SELECT scope, node, greatest(node - 2, 0) FROM last WHERE kind = 'error'),
acc AS (SELECT scope, node, var, NOT arg_min(writes, i) AS reads, bool_or(writes) AS writes, node BETWEEN 2 AND 5 AS inside FROM e GROUP BY scope, node, var),
w AS (SELECT scope, node, var FROM acc WHERE writes),
touched AS (SELECT DISTINCT scope, var FROM acc WHERE inside),
within AS (SELECT * FROM steps WHERE src BETWEEN 2 AND 5 AND dst BETWEEN 2 AND 5),
live(scope, node, var) AS (SELECT scope, node, var FROM acc WHERE reads AND inside UNION SELECT s.scope, s.src, var FROM live l JOIN within s ON s.scope = l.scope AND s.dst = l.node WHERE (s.scope, s.src, var) NOT IN (SELECT (scope, node, var) FROM w)),
came(scope, node, var) AS (SELECT a.scope, dst, var FROM acc a JOIN steps s ON s.scope = a.scope AND s.src = a.node WHERE a.writes AND NOT a.inside UNION SELECT s.scope, s.dst, var FROM came c JOIN steps s ON s.scope = c.scope AND s.src = c.node WHERE (c.scope, c.node, var) NOT IN (SELECT (scope, node, var) FROM w)),
went(scope, node, var) AS (SELECT a.scope, dst, var FROM acc a JOIN steps s ON s.scope = a.scope AND s.src = a.node WHERE a.writes AND a.inside UNION SELECT s.scope, s.dst, var FROM went c JOIN steps s ON s.scope = c.scope AND s.src = c.node WHERE (c.scope, c.node, var) NOT IN (SELECT (scope, node, var) FROM w)),
bare(scope, node, var) AS (SELECT scope, 2, var FROM touched WHERE (scope, 2) IN (SELECT (scope, node) FROM last) UNION SELECT s.scope, s.dst, var FROM bare b JOIN within s ON s.scope = b.scope AND s.src = b.node WHERE (b.scope, b.node, var) NOT IN (SELECT (scope, node, var) FROM w)),
exits AS (SELECT DISTINCT scope, src AS node FROM steps WHERE src BETWEEN 2 AND 5 AND NOT dst BETWEEN 2 AND 5 UNION SELECT scope, node FROM last l WHERE node BETWEEN 2 AND 5 AND NOT EXISTS (SELECT 1 FROM steps s WHERE s.scope = l.scope AND s.src = l.node)),
missed AS (SELECT DISTINCT scope, var FROM bare JOIN exits USING (scope, node) WHERE (scope, node, var) NOT IN (SELECT (scope, node, var) FROM w)),
ins AS (SELECT scope, var FROM live WHERE node = 2 INTERSECT SELECT scope, var FROM came WHERE node = 2),
outs AS (SELECT DISTINCT g.scope, g.var FROM went g JOIN acc a ON a.scope = g.scope AND a.node = g.node AND a.var = g.var WHERE a.reads AND NOT a.inside),
seen AS (SELECT scope, var, bool_or(inside AND reads) AS read_inside, bool_or(inside AND writes) AS written_inside, bool_or(NOT inside AND reads) AS read_outside, bool_or(NOT inside AND writes) AS written_outside FROM acc GROUP BY scope, var)
SELECT scope, var, read_inside, written_inside, written_inside AND (scope, var) NOT IN (SELECT (scope, var) FROM missed) AS always_assigned, (scope, var) IN (SELECT (scope, var) FROM ins) AS flows_in, (scope, var) IN (SELECT (scope, var) FROM outs) AS flows_out, read_outside, written_outside
FROM seen JOIN touched USING (scope, var)""")
def region_data_flow(spark: SparkSession, d: str) -> DataFrame:
    """What blocks 2 to 5 of each user's events do with the variables that these touch."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    writes = F.col("event_type").isin("signup", "purchase", "error")
    events = _t(spark, d, "events").withColumn("i", F.row_number().over(order)).select(F.col("user_id").alias("scope"), F.floor((F.col("i") - 1) / 3).cast("int").alias("node"), "i", _text("v", F.get_json_object("props", "$.k").cast("long") % 6).alias("var"), "event_type", writes.alias("writes"))
    last = cut(events.groupBy("scope", "node").agg(F.max_by("event_type", "i").alias("kind")).withColumn("top", F.max("node").over(Window.partitionBy("scope"))))
    to = lambda where, node: last.where(where).select("scope", F.col("node").alias("src"), F.expr(node).alias("dst"))
    edges = to("node < top", "node + 1").unionByName(to("kind = 'click' and node + 2 <= top", "node + 2")).unionByName(to("kind = 'error'", "greatest(node - 2, 0)"))
    accesses = events.groupBy("scope", "node", "var").agg((~F.min_by("writes", "i")).alias("reads"), F.max("writes").alias("writes"))
    region = last.where("node between 2 and 5").select("scope", "node")
    return data_flow.region_flow(edges, accesses, region, region.where("node = 2"))


@_query("""WITH c AS (SELECT DISTINCT c_custkey % 6 AS k, c_nationkey AS a, CASE WHEN c_custkey % 6 = 1 THEN c_nationkey * 7 % 25 ELSE c_nationkey END AS b FROM customer),
t AS (SELECT k, a, b, n_regionkey AS r, CASE k WHEN 0 THEN 'List<N' || a || '>' WHEN 1 THEN 'Map<N' || a || ', N' || b || '>' WHEN 2 THEN 'Map<N' || a || ', N' || b || '>' WHEN 3 THEN 'N' || a WHEN 4 THEN 'N' || a || '[]' ELSE 'Set<List<N' || a || '>>' END AS type FROM c JOIN nation ON a = n_nationkey),
m AS (SELECT s_suppkey AS s, s_suppkey % 8 AS g, s_nationkey AS n, s_nationkey % 5 AS r FROM supplier)
SELECT DISTINCT type, 'S' || s AS method,
  CAST(CASE WHEN g IN (1, 2, 3) THEN 0 WHEN g = 7 THEN 2 ELSE 1 END AS INT) AS distance,
  CASE g WHEN 0 THEN '?T=:N' || a WHEN 1 THEN '?K=:N' || a WHEN 3 THEN '?T=:N' || a WHEN 4 THEN '?A=:N' || a || '; ?B=:N' || b WHEN 5 THEN '?T=:N' || a ELSE '' END AS arguments
FROM t, m WHERE (g = 0 AND k IN (0, 4) AND t.r = m.r) OR (g = 1 AND k IN (1, 2) AND a = b) OR (g = 2 AND k = 3 AND a = n) OR (g = 3 AND k = 3 AND t.r = m.r) OR (g = 4 AND k IN (1, 2)) OR (g = 5 AND k = 5) OR (g = 6 AND k = 3 AND t.r = m.r) OR g = 7""")
def extension_methods_by_terms(spark: SparkSession, d: str) -> DataFrame:
    """Methods of suppliers that the generic types of customers have by extension."""
    a = F.col("c_nationkey")
    k = F.col("c_custkey") % 6
    other = F.when(k == 1, a * 7 % 25).otherwise(a)
    name = (
        F.when(k == 0, _text("List<N", a, ">")).when(k.isin(1, 2), _text("Map<N", a, ", N", other, ">")).when(k == 3, _text("N", a)).when(k == 4, _text("N", a, "[]")).otherwise(_text("Set<List<N", a, ">>"))
    )
    types = _t(spark, d, "customer").select(name.alias("type")).distinct().withColumn("term", type_terms.parsed(F.col("type")))
    generic = spark.createDataFrame([("List<?T>", "Seq<?T>"), ("Set<?T>", "Seq<?T>"), ("Map<?K, ?V>", "Seq<Pair<?K, ?V>>"), ("?T[]", "Seq<?T>"), ("Seq<?T>", "Any")], "of string, base string")
    plain = _t(spark, d, "nation").select(_text("N", F.col("n_nationkey")).alias("of"), _text("R", F.col("n_regionkey")).alias("base"))
    top = _t(spark, d, "region").select(_text("R", F.col("r_regionkey")).alias("of"), F.lit("Any").alias("base"))
    rules = generic.unionByName(plain).unionByName(top).select(type_terms.parsed(F.col("of")).alias("of"), type_terms.parsed(F.col("base")).alias("base"))
    g = F.col("s_suppkey") % 8
    region = _text("R", F.col("s_nationkey") % 5)
    receiver = (
        F.when(g == 0, "Seq<?T>").when(g == 1, "Map<?K, ?K>").when(g == 2, _text("N", F.col("s_nationkey"))).when(g == 3, "?T").when(g == 4, "Seq<Pair<?A, ?B>>").when(g == 5, "Seq<List<?T>>").when(g == 6, region).otherwise("Any")
    )
    own = _t(spark, d, "supplier").select(_text("S", F.col("s_suppkey")).alias("method"), receiver.alias("receiver"), region.alias("region"), g.alias("g"))
    constraints = own.where("g in (0, 3)").select("method", F.lit("?T").alias("name"), type_terms.parsed(F.col("region")).alias("bound"))
    return type_terms.extension_methods(types, rules, own.select("method", type_terms.parsed(F.col("receiver")).alias("receiver")), constraints)


_STEPS = "SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS dst FROM lineitem WHERE l_quantity >= 45) WHERE dst IS NOT NULL AND src < dst AND dst - src <= (SELECT count(*) FROM part) / 20"


@_query(f"""WITH RECURSIVE every AS ({_STEPS}), e AS (SELECT * FROM every WHERE NOT (src % 11 = 3 AND dst % 2 = 0)), r(root, node) AS (SELECT src, dst FROM e UNION SELECT root, dst FROM r JOIN e ON node = src) SELECT root, node FROM r""")
def maintained_closure(spark: SparkSession, d: str) -> DataFrame:
    """The closure of calls to nearby parts: worked out without some edges, then kept as these are added and others removed."""
    near = _t(spark, d, "part").count() / 20
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    rows = _t(spark, d, "lineitem").where("l_quantity >= 45").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"))
    every = rows.where((F.col("src") < F.col("dst")) & (F.col("dst") - F.col("src") <= near)).distinct()
    late, gone = (F.col("src") % 7 == 2) & (F.col("dst") % 3 == 0), (F.col("src") % 11 == 3) & (F.col("dst") % 2 == 0)
    before = every.where(~late | gone)
    return closure.maintain(closure.closure(before), before, every.where(late & ~gone), every.where(gone))


def _near_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls to nearby parts: upwards, and a few downwards, which make cycles."""
    near = _t(spark, d, "part").count() / 20
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    rows = _t(spark, d, "lineitem").where("l_quantity >= 45").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"))
    return rows.where((F.abs(F.col("src") - F.col("dst")) <= near) & ((F.col("src") < F.col("dst")) | (F.col("dst") % 5 == 0))).distinct()


_NEAR = "e AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS dst FROM lineitem WHERE l_quantity >= 45) WHERE dst IS NOT NULL AND abs(src - dst) <= (SELECT count(*) FROM part) / 20 AND (src < dst OR dst % 5 = 0)), r(root, node) AS (SELECT src, dst FROM e UNION SELECT root, dst FROM r JOIN e ON node = src)"


@_query(f"""WITH RECURSIVE {_NEAR}, nodes AS (SELECT src AS node FROM e UNION SELECT dst FROM e), bad AS (SELECT root AS node FROM r WHERE root = node UNION SELECT r.root FROM r JOIN r c ON c.root = c.node AND r.node = c.root),
up(node, level) AS (SELECT node, 0 FROM nodes WHERE node NOT IN (SELECT src FROM e) UNION SELECT e.src, level + 1 FROM up JOIN e ON e.dst = up.node WHERE e.src NOT IN (SELECT node FROM bad))
SELECT node, CAST(coalesce(max(level), 0) AS INT) AS level FROM nodes LEFT JOIN up USING (node) GROUP BY node""")
def call_levels(spark: SparkSession, d: str) -> DataFrame:
    """The longest way down from each part over calls to nearby parts; 0 for those on or above a cycle."""
    edges = _near_calls(spark, d)
    return graph.levels(edges, edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))))


@_query(f"WITH RECURSIVE {_NEAR} SELECT root AS node, count(*) AS n FROM r WHERE root <> node GROUP BY root")
def call_closure_sizes(spark: SparkSession, d: str) -> DataFrame:
    """How many parts each one reaches over calls to nearby parts."""
    return graph.closure_sizes(_near_calls(spark, d))


@_query("""WITH f AS (SELECT l_orderkey AS trace_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS position, 'App.' || replace(p_brand, '#', '') || '.' || replace(p_name, ' ', '_') AS symbol, l_suppkey % 4 AS n, CASE WHEN l_linenumber = 1 THEN '/src/' || l_partkey || '.cs' END AS file, CASE WHEN l_linenumber = 1 THEN l_suppkey END AS line
  FROM lineitem JOIN part ON l_partkey = p_partkey),
s AS (SELECT 'App.' || replace(p_brand, '#', '') || '.' || replace(p_name, ' ', '_') AS symbol, p_size % 3 AS has, p_partkey AS member, p_size % 5 <> 0 AS source, '/parts/' || (p_partkey % 10) || '.cs' AS file, p_size AS line FROM part WHERE p_size <= 30),
c AS (SELECT x.symbol, x.n, s.*, row_number() OVER (PARTITION BY x.symbol, x.n ORDER BY NOT source, has <> x.n, s.file, s.line, member) AS r FROM (SELECT DISTINCT symbol, n FROM f) x JOIN s ON s.symbol = x.symbol)
SELECT trace_id, CAST(position AS INT) AS position, f.symbol, member, CASE WHEN member IS NULL THEN 'unresolved' WHEN source THEN 'source' ELSE 'metadata' END AS status, coalesce(f.file, c.file) AS file, CAST(coalesce(f.line, c.line) AS INT) AS line
FROM f LEFT JOIN c ON c.symbol = f.symbol AND c.n = f.n AND r = 1""")
def resolve_frames(spark: SparkSession, d: str) -> DataFrame:
    """Orders as stack traces whose frames name parts, resolved against the parts up to size 30; overloads are told by their number of parameters."""
    name = F.concat(F.lit("App."), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("."), F.replace("p_name", F.lit(" "), F.lit("_")))
    parts = _t(spark, d, "part").select("p_partkey", "p_size", name.alias("symbol"))
    lines = _t(spark, d, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    given = F.array_join(F.array_repeat(F.lit("Map`2[System.String,List<Int32, Int32>] m"), (F.col("l_suppkey") % 4).cast("int")), ", ")
    place = F.when(F.col("l_linenumber") == 1, _text(" in /src/", F.col("l_partkey"), ".cs:line ", F.col("l_suppkey"))).otherwise("")
    frame = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", F.concat(F.lit("   at "), "symbol", F.lit("("), given, F.lit(")"), place).alias("text"))
    traces = lines.groupBy(F.col("l_orderkey").alias("trace_id")).agg(F.concat(F.lit("System.Exception: no\n"), F.array_join(F.transform(F.array_sort(F.collect_list(frame)), lambda x: x["text"]), "\n")).alias("text"))
    symbols = parts.where("p_size <= 30").select(F.col("symbol").alias("name"), (F.col("p_size") % 3).alias("parameters"), F.col("p_partkey").alias("member"), (F.col("p_size") % 5 != 0).alias("source"), _text("/parts/", F.col("p_partkey") % 10, ".cs").alias("file"), F.col("p_size").alias("line"))
    return resolved_frames(trace_rows(traces), symbols).drop("origin")


@_query("""WITH p AS (SELECT replace(p_brand, '#', '') AS project, p_partkey, replace(p_name, ' ', '.') || '.' || p_partkey AS name, p_size FROM part)
SELECT project, name, CASE p_size % 4 WHEN 2 THEN '*' ELSE CAST(p_size AS VARCHAR) || '.0' END AS version FROM p WHERE p_size % 4 <> 3 AND project <> 'Brand7'""")
def packages_of_project_files(spark: SparkSession, d: str) -> DataFrame:
    """Project files made of brands, one package a part, written and read with the XML source: attributes, elements, comments, and one file that is cut off."""
    size = F.col("p_size")
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit(".")), F.lit("."), F.col("p_partkey").cast("string"))
    item = (
        F.when(size % 4 == 0, _text('<PackageReference Include="', name, '" Version="', size, '.0" />'))
        .when(size % 4 == 1, _text("<PackageReference Include='", name, "'>\n  <Version>", size, ".0</Version>\n</PackageReference>"))
        .when(size % 4 == 2, _text('<PackageReference Include="', name, '"><PrivateAssets>all</PrivateAssets></PackageReference>'))
        .otherwise(_text('<!-- <PackageReference Include="', name, '" Version="1" /> -->'))
    )
    brand = F.replace("p_brand", F.lit("#"), F.lit(""))
    path = shared_path(spark, f"projects-{uuid.uuid4().hex}")
    _t(spark, d, "part").select(brand.alias("project"), item.alias("item")).groupBy("project").agg(F.array_join(F.array_sort(F.collect_list("item")), "\n").alias("body")).select(
        "project", F.concat(F.lit('<Project Sdk="Microsoft.NET.Sdk"><ItemGroup><!-- <ItemGroup> -->'), "body", F.when(F.col("project") == "Brand7", "<PackageReference Include=").otherwise("</ItemGroup></Project>")).alias("value")
    ).write.partitionBy("project").text(path)
    found = project_xml.packages(spark, path)
    return found.select(F.regexp_extract("path", r"project=([^/]+)/", 1).alias("project"), "name", "version")
