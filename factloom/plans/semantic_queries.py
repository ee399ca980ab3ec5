"""Names, dispatch, exceptions and snapshots bound to the driver's tables, and the same in SQL.

Roles: types = regions, nations below them, customers below these, some nested in another nation; parts of size 1 and suppliers stand in
namespaces. Members = orders of customers, parts of nations, events of regions. Uses = lines; files = orders, which import two namespaces.
Methods and call sites, tries and throws come from parts and lines; files of snapshots are orders, their projects nations.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators import binding, exceptions
from factloom.operators.shared import shared_path
from factloom.plans.fact_store import FactStore

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


def _id(letter: str, key: Column | str) -> Column:
    return F.concat(F.lit(letter), F.col(key).cast("string") if isinstance(key, str) else key.cast("string"))


def _union(*parts: DataFrame) -> DataFrame:
    first, *rest = parts
    for x in rest:
        first = first.unionByName(x)
    return first


def _space() -> Column:
    return F.concat(F.lit("app."), F.lower("c_mktsegment"), F.lit(".n"), F.col("c_nationkey").cast("string"))


def _types(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    around = F.when(F.col("c_custkey") % 3 == 0, _id("N", (F.col("c_nationkey") + 1) % 25))
    low = F.when(F.col("p_partkey") % 3 == 0, "app").when(F.col("p_partkey") % 3 == 1, "app.building")
    return _union(
        _t(spark, d, "customer").select(_id("C", "c_custkey").alias("type"), _id("m", F.col("c_custkey") % 97).alias("name"), _space().alias("namespace"), around.alias("container")),
        _t(spark, d, "nation").select(_id("N", "n_nationkey").alias("type"), _id("Nation", "n_nationkey").alias("name"), F.lit("app").alias("namespace"), none.alias("container")),
        _t(spark, d, "region").select(_id("R", "r_regionkey").alias("type"), _id("Region", "r_regionkey").alias("name"), F.lit("app").alias("namespace"), none.alias("container")),
        _t(spark, d, "supplier").select(_id("S", "s_suppkey").alias("type"), _id("m", F.col("s_suppkey") % 50 + 60).alias("name"), _id("lib", F.col("s_suppkey") % 5).alias("namespace"), none.alias("container")),
        _t(spark, d, "part").where("p_size = 1").select(_id("Q", "p_partkey").alias("type"), _id("m", F.col("p_partkey") % 90 + 40).alias("name"), low.alias("namespace"), none.alias("container")),
    )


def _bases(spark: SparkSession, d: str) -> DataFrame:
    return _union(
        _t(spark, d, "customer").select(_id("C", "c_custkey").alias("src"), _id("N", "c_nationkey").alias("dst")),
        _t(spark, d, "nation").select(_id("N", "n_nationkey").alias("src"), _id("R", "n_regionkey").alias("dst")),
    )


def _members(spark: SparkSession, d: str) -> DataFrame:
    return _union(
        _t(spark, d, "orders").select(_id("O", "o_orderkey").alias("member"), _id("m", F.col("o_orderkey") % 40).alias("name"), _id("C", "o_custkey").alias("type")),
        _t(spark, d, "part").where("p_size <= 10").select(_id("P", "p_partkey").alias("member"), _id("m", F.col("p_partkey") % 70).alias("name"), _id("N", F.col("p_partkey") % 25).alias("type")),
        _t(spark, d, "events").where("event_type = 'signup'").select(_id("E", "event_id").alias("member"), _id("m", F.col("event_id") % 85).alias("name"), _id("R", F.col("user_id") % 5).alias("type")),
    )


_TYPES = """types AS (
  SELECT 'C' || c_custkey AS type, 'm' || (c_custkey % 97) AS name, 'app.' || lower(c_mktsegment) || '.n' || c_nationkey AS namespace, CASE WHEN c_custkey % 3 = 0 THEN 'N' || ((c_nationkey + 1) % 25) END AS container FROM customer
  UNION ALL SELECT 'N' || n_nationkey, 'Nation' || n_nationkey, 'app', NULL FROM nation UNION ALL SELECT 'R' || r_regionkey, 'Region' || r_regionkey, 'app', NULL FROM region
  UNION ALL SELECT 'S' || s_suppkey, 'm' || (s_suppkey % 50 + 60), 'lib' || (s_suppkey % 5), NULL FROM supplier
  UNION ALL SELECT 'Q' || p_partkey, 'm' || (p_partkey % 90 + 40), CASE p_partkey % 3 WHEN 0 THEN 'app' WHEN 1 THEN 'app.building' END, NULL FROM part WHERE p_size = 1),
bases AS (SELECT 'C' || c_custkey AS src, 'N' || c_nationkey AS dst FROM customer UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation),
above(type, scope, depth) AS (SELECT type, type, 0 FROM types UNION SELECT type, dst, depth + 1 FROM above JOIN bases ON scope = src),
members AS (
  SELECT 'O' || o_orderkey AS member, 'm' || (o_orderkey % 40) AS name, 'C' || o_custkey AS type FROM orders
  UNION ALL SELECT 'P' || p_partkey, 'm' || (p_partkey % 70), 'N' || (p_partkey % 25) FROM part WHERE p_size <= 10
  UNION ALL SELECT 'E' || event_id, 'm' || (event_id % 85), 'R' || (user_id % 5) FROM events WHERE event_type = 'signup'),
declared AS (
  SELECT 'type' AS kind, container AS scope, name, type AS id FROM types WHERE container IS NOT NULL UNION SELECT 'namespace', coalesce(namespace, ''), name, type FROM types WHERE container IS NULL
  UNION SELECT 'type', type, name, min(member) FROM members GROUP BY type, name)"""


@_query(f"""WITH RECURSIVE {_TYPES},
uses AS (SELECT DISTINCT 'm' || (l_partkey % 150) AS name, CASE WHEN l_linenumber > 1 THEN 'C' || o_custkey END AS type, 'app.' || lower(c_mktsegment) || '.n' || c_nationkey AS namespace, l_orderkey AS file
         FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
chain AS (SELECT type, type AS enclosing, 0 AS outward FROM types UNION ALL SELECT type, container, 1 FROM types WHERE container IS NOT NULL),
visible AS (
  SELECT uses.*, 'type' AS kind, scope, 0 AS tier, outward, depth FROM uses JOIN chain USING (type) JOIN (SELECT type AS enclosing, scope, depth FROM above) USING (enclosing)
  UNION ALL SELECT uses.*, 'namespace', array_to_string(string_split(namespace, '.')[1:3 - dropped], '.'), 1, dropped, 0 FROM uses, (SELECT unnest(range(0, 4)) AS dropped)
  UNION ALL SELECT DISTINCT uses.*, 'namespace', 'lib' || (file % k), 2, 0, 0 FROM uses, (SELECT unnest([3, 5]) AS k)),
met AS (SELECT v.name, v.type, v.namespace, v.file, tier, outward, depth, count(DISTINCT id) AS n, min(id) AS id FROM visible v JOIN declared USING (kind, scope, name) GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY name, type, namespace, file ORDER BY tier, outward, depth) AS r FROM met)
SELECT u.name, u.type, u.file, CASE WHEN n IS NULL THEN 'notFound' WHEN n = 1 THEN 'ok' ELSE 'ambiguous' END AS status, CAST(tier AS INT) AS tier, CAST(outward AS INT) AS outward, CAST(depth AS INT) AS depth, CASE WHEN n = 1 THEN id END AS id, coalesce(n, 0) AS n
FROM uses u LEFT JOIN best b ON r = 1 AND b.name = u.name AND b.type IS NOT DISTINCT FROM u.type AND b.namespace = u.namespace AND b.file = u.file""")
def bind_names(spark: SparkSession, d: str) -> DataFrame:
    """What each name in each order means, by the scopes of the line's customer and namespace and of the order's imports."""
    customers = _t(spark, d, "customer").select("c_custkey", _space().alias("namespace"))
    orders = _t(spark, d, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "namespace")
    lines = _t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    uses = lines.select(_id("m", F.col("l_partkey") % 150).alias("name"), F.when(F.col("l_linenumber") > 1, _id("C", "o_custkey")).alias("type"), "namespace", F.col("l_orderkey").alias("file"))
    imports = _union(*(_t(spark, d, "orders").select(F.col("o_orderkey").alias("file"), _id("lib", F.col("o_orderkey") % k).alias("namespace")) for k in (3, 5)))
    return binding.bind(uses, _types(spark, d), _members(spark, d), _bases(spark, d), imports).drop("namespace")


@_query(f"""WITH RECURSIVE {_TYPES},
uses AS (SELECT DISTINCT 'C' || o_custkey AS type, 'm' || (l_suppkey % 100) AS name FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
met AS (SELECT u.type, u.name, depth, count(DISTINCT id) AS n, min(id) AS id FROM uses u JOIN above a ON a.type = u.type JOIN declared x ON x.kind = 'type' AND x.scope = a.scope AND x.name = u.name GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY type, name ORDER BY depth) AS r FROM met)
SELECT type, name, CASE WHEN n IS NULL THEN 'notFound' WHEN n = 1 THEN 'ok' ELSE 'ambiguous' END AS status, CAST(depth AS INT) AS depth, CASE WHEN n = 1 THEN id END AS id, coalesce(n, 0) AS n FROM uses LEFT JOIN (SELECT * FROM best WHERE r = 1) USING (type, name)""")
def bind_qualified_names(spark: SparkSession, d: str) -> DataFrame:
    """What each name means on each customer that it is asked of."""
    orders = _t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    uses = _t(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(orders, "l_orderkey").select(_id("C", "o_custkey").alias("type"), _id("m", F.col("l_suppkey") % 100).alias("name"))
    return binding.bind_qualified(uses, _types(spark, d), _members(spark, d), _bases(spark, d))


_METHODS = """methods AS (
  SELECT 'O' || o_orderkey AS member, 'C' || o_custkey AS type, 's' || (o_orderkey % 30) AS signature, o_orderstatus = 'F' AS overrides FROM orders
  UNION ALL SELECT 'P' || p_partkey, 'N' || (p_partkey % 25), 's' || (p_partkey % 45), p_size % 2 = 0 FROM part
  UNION ALL SELECT 'E' || event_id, 'R' || (user_id % 5), 's' || (event_id % 60), false FROM events WHERE event_type = 'signup'
  UNION ALL SELECT 'S' || s_suppkey, 'I' || (s_suppkey % 10), 's' || (s_suppkey % 60), false FROM supplier),
bases AS (SELECT 'C' || c_custkey AS src, 'N' || c_nationkey AS dst FROM customer UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation),
interfaces AS (SELECT DISTINCT 'N' || n_nationkey AS src, 'I' || (n_nationkey % 10) AS dst FROM nation WHERE n_nationkey % 2 = 0 UNION SELECT 'C' || c_custkey, 'I' || (c_custkey % 10) FROM customer WHERE c_custkey % 7 = 0 UNION SELECT 'I' || (s_suppkey % 10), 'I' || (s_suppkey % 10 % 3) FROM supplier WHERE s_suppkey % 10 >= 3),
above(type, scope, depth) AS (SELECT DISTINCT src, src, 0 FROM (SELECT src FROM bases UNION SELECT dst FROM bases) UNION SELECT type, dst, depth + 1 FROM above JOIN bases ON scope = src),
wider(type, interface) AS (SELECT a.type, i.dst FROM above a JOIN interfaces i ON a.scope = i.src UNION SELECT type, dst FROM wider JOIN interfaces ON interface = src),
single AS (SELECT type, signature, min(member) AS member FROM methods GROUP BY type, signature),
o1 AS (SELECT m.member AS src, b.member AS dst, row_number() OVER (PARTITION BY m.member ORDER BY depth, b.member) AS r FROM methods m JOIN above a ON m.type = a.type JOIN single b ON b.type = a.scope AND b.signature = m.signature WHERE m.overrides AND depth > 0),
o2 AS (SELECT m.member AS src, i.member AS dst, row_number() OVER (PARTITION BY w.type, i.member ORDER BY depth, m.member) AS r FROM wider w JOIN methods i ON i.type = w.interface JOIN above a ON a.type = w.type JOIN single m ON m.type = a.scope AND m.signature = i.signature),
edges AS (SELECT src, dst, 'override' AS how FROM o1 WHERE r = 1 UNION SELECT src, dst, 'interface' FROM o2 WHERE r = 1)"""


def _dispatch(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    methods = _union(
        _t(spark, d, "orders").select(_id("O", "o_orderkey").alias("member"), _id("C", "o_custkey").alias("type"), _id("s", F.col("o_orderkey") % 30).alias("signature"), (F.col("o_orderstatus") == "F").alias("overrides")),
        _t(spark, d, "part").select(_id("P", "p_partkey").alias("member"), _id("N", F.col("p_partkey") % 25).alias("type"), _id("s", F.col("p_partkey") % 45).alias("signature"), (F.col("p_size") % 2 == 0).alias("overrides")),
        _t(spark, d, "events").where("event_type = 'signup'").select(_id("E", "event_id").alias("member"), _id("R", F.col("user_id") % 5).alias("type"), _id("s", F.col("event_id") % 60).alias("signature"), F.lit(False).alias("overrides")),
        _t(spark, d, "supplier").select(_id("S", "s_suppkey").alias("member"), _id("I", F.col("s_suppkey") % 10).alias("type"), _id("s", F.col("s_suppkey") % 60).alias("signature"), F.lit(False).alias("overrides")),
    )
    interfaces = _union(
        _t(spark, d, "nation").where("n_nationkey % 2 = 0").select(_id("N", "n_nationkey").alias("src"), _id("I", F.col("n_nationkey") % 10).alias("dst")),
        _t(spark, d, "customer").where("c_custkey % 7 = 0").select(_id("C", "c_custkey").alias("src"), _id("I", F.col("c_custkey") % 10).alias("dst")),
        _t(spark, d, "supplier").where("s_suppkey % 10 >= 3").select(_id("I", F.col("s_suppkey") % 10).alias("src"), _id("I", F.col("s_suppkey") % 10 % 3).alias("dst")),
    )
    return methods, _bases(spark, d), interfaces.distinct()


@_query(f"WITH RECURSIVE {_METHODS} SELECT src, dst, how FROM edges")
def override_map(spark: SparkSession, d: str) -> DataFrame:
    """Which member stands in for which, by signature and nearest type."""
    return binding.override_edges(*_dispatch(spark, d)).select("src", "dst", "how")


@_query(f"""WITH RECURSIVE {_METHODS},
targets AS (SELECT 'P' || p_partkey AS target FROM part WHERE p_brand = 'Brand#11' AND p_size <= 6),
up(node) AS (SELECT target FROM targets UNION SELECT dst FROM up JOIN edges ON node = src),
down(node) AS (SELECT node FROM up WHERE node NOT IN (SELECT src FROM edges) UNION SELECT src FROM down JOIN edges ON node = dst),
calls AS (SELECT 'P' || l_partkey AS target, l_orderkey AS file, l_linenumber AS line, l_suppkey AS project FROM lineitem UNION ALL SELECT 'O' || l_orderkey, l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_linenumber = 2)
SELECT file, line, min(project) AS project, count(*) AS n, count(*) FILTER (target IN (SELECT target FROM targets)) AS direct FROM calls WHERE target IN (SELECT node FROM down) GROUP BY file, line""")
def find_callers_by_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Places that call some parts, also through what they override or do for an interface."""
    lines = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("project"), "l_partkey")
    calls = _union(lines.select(_id("P", "l_partkey").alias("target"), "file", "line", "project"), lines.where("line = 2").select(_id("O", "file").alias("target"), "file", "line", "project"))
    targets = _t(spark, d, "part").where("p_brand = 'Brand#11' and p_size <= 6").select(_id("P", "p_partkey").alias("target"))
    return binding.callers_by_dispatch(calls, targets, binding.override_graph(*_dispatch(spark, d)))


@_query("""WITH RECURSIVE sites AS (SELECT DISTINCT src, dst, "at" FROM (SELECT l_partkey AS src, (l_linenumber * 7 + l_partkey) % 100 AS "at", lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS dst FROM lineitem WHERE l_quantity >= 40) WHERE dst IS NOT NULL AND src <> dst),
walks(node, depth, chain) AS (SELECT p_partkey, 0, CAST([] AS STRUCT(node BIGINT, "at" BIGINT)[]) FROM part WHERE p_partkey = 77 UNION ALL SELECT dst, depth + 1, list_append(chain, {'node': src, 'at': "at"}) FROM walks JOIN sites ON node = src WHERE depth < 3),
chains AS (SELECT node, depth, chain FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY depth, chain) AS r FROM walks) WHERE r = 1),
throws AS (SELECT p_partkey AS node, p_partkey * 13 % 100 AS "at", p_type AS exception FROM part WHERE p_size >= 15 UNION SELECT p_partkey, p_partkey * 29 % 100, 'K' || (length(p_type) % 2) FROM part WHERE p_size % 7 = 0),
raised AS (SELECT t.*, depth, chain, list_append(chain, {'node': t.node, 'at': t."at"}) AS frames, row_number() OVER () AS throw FROM throws t JOIN chains USING (node)),
fits AS (SELECT DISTINCT p_type AS exception, unnest([p_type, 'K' || (length(p_type) % 2), 'Exception']) AS type FROM part UNION SELECT 'K' || k, unnest(['K' || k, 'Exception']) FROM (SELECT unnest([0, 1]) AS k)),
tries AS (SELECT p_partkey AS node, 1 AS span, 0 AS start, 100 AS stop FROM part WHERE p_size % 4 = 0 UNION ALL SELECT p_partkey, 2, 20, 70 FROM part WHERE p_size % 3 = 0 UNION ALL SELECT p_partkey, 3, 30, 50 FROM part WHERE p_size % 2 = 0),
clauses AS (
  SELECT p_partkey AS node, 1 AS span, 1 AS clause, 'Exception' AS type, p_partkey % 2 = 0 AS filtered FROM part UNION ALL SELECT p_partkey, 1, 2, NULL, false FROM part WHERE p_size % 8 = 0
  UNION ALL SELECT p_partkey, 2, 1, p_type, p_partkey % 5 = 0 FROM part UNION ALL SELECT p_partkey, 2, 2, 'K1', false FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 3, 1, 'K0', p_partkey % 3 = 0 FROM part),
f AS (SELECT throw, exception, unnest(frames) AS f, unnest(range(len(frames))) AS place FROM raised),
met AS (SELECT throw, place, start, stop, t.span, c.clause, t.node, filtered, row_number() OVER (PARTITION BY throw, filtered ORDER BY place DESC, start DESC, stop, t.span, c.clause) AS r,
               row_number() OVER (PARTITION BY throw ORDER BY place DESC, start DESC, stop, t.span, c.clause) AS every
        FROM f JOIN tries t ON t.node = f.node AND f."at" >= start AND f."at" < stop JOIN clauses c ON c.node = t.node AND c.span = t.span WHERE c.type IS NULL OR (exception, c.type) IN (SELECT (exception, type) FROM fits)),
caught AS (SELECT throw, node AS caught_in, span AS caught_span, clause AS caught_clause, every AS catch_at FROM met WHERE NOT filtered AND r = 1),
passed AS (SELECT throw, every AS filter_at FROM met WHERE filtered AND r = 1)
SELECT node, "at", exception, depth, array_to_string(list_transform(frames, lambda x: x.node), '>') AS chain, caught_in IS NULL AS escapes, caught_in, caught_span, caught_clause, coalesce(filter_at < coalesce(catch_at, 1000000), false) AS has_filter
FROM raised LEFT JOIN caught USING (throw) LEFT JOIN passed USING (throw)""")
def exception_paths(spark: SparkSession, d: str) -> DataFrame:
    """Throws within three calls of part 77, the chain that leads there, and the clause that catches each, if any."""
    part = _t(spark, d, "part").select(F.col("p_partkey").alias("node"), "p_type", F.col("p_size").alias("size"), F.concat(F.lit("K"), (F.length("p_type") % 2).cast("string")).alias("wide"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    lines = _t(spark, d, "lineitem").where("l_quantity >= 40").select(F.col("l_partkey").alias("src"), ((F.col("l_linenumber") * 7 + F.col("l_partkey")) % 100).alias("at"), F.lead("l_partkey").over(order).alias("dst"))
    throws = part.where("size >= 15").select("node", (F.col("node") * 13 % 100).alias("at"), F.col("p_type").alias("exception")).unionByName(part.where("size % 7 = 0").select("node", (F.col("node") * 29 % 100).alias("at"), F.col("wide").alias("exception")))
    span = lambda where, k, a, b: part.where(where).select("node", F.lit(k).alias("span"), F.lit(a).alias("start"), F.lit(b).alias("stop"))
    clause = lambda where, k, n, kind, filtered: part.where(where).select("node", F.lit(k).alias("span"), F.lit(n).alias("clause"), kind.cast("string").alias("type"), filtered.alias("filtered"))
    tries = _union(span("size % 4 = 0", 1, 0, 100), span("size % 3 = 0", 2, 20, 70), span("size % 2 = 0", 3, 30, 50))
    clauses = _union(
        clause("true", 1, 1, F.lit("Exception"), F.col("node") % 2 == 0),
        clause("size % 8 = 0", 1, 2, F.lit(None), F.lit(False)),
        clause("true", 2, 1, F.col("p_type"), F.col("node") % 5 == 0),
        clause("node % 3 = 0", 2, 2, F.lit("K1"), F.lit(False)),
        clause("true", 3, 1, F.lit("K0"), F.col("node") % 3 == 0),
    )
    bases = part.select(F.col("p_type").alias("src"), F.col("wide").alias("dst")).unionByName(part.select(F.col("wide").alias("src"), F.lit("Exception").alias("dst")))
    root = part.where("node = 77").select("node")
    return exceptions.exception_flow(lines.where("dst is not null and src <> dst").select("src", "dst", "at"), root, throws, tries, clauses, bases, 3)


def _orders_as_files(spark: SparkSession, d: str) -> DataFrame:
    customers = _t(spark, d, "customer").select("c_custkey", _id("n", "c_nationkey").alias("project"))
    orders = _t(spark, d, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return orders.select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderkey").alias("id"), "project", F.col("o_orderstatus").alias("status"), cents.alias("cents"))


def order_facts(files: DataFrame) -> DataFrame:
    """Facts of projects made of orders: by status, how many and their price."""
    return files.groupBy("project", "status").agg(F.count("*").alias("n_files"), F.sum("cents").alias("cents"))


@_query("""WITH RECURSIVE files AS (SELECT o_orderkey AS id, 'n' || c_nationkey AS project, o_orderstatus AS status, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders JOIN customer ON o_custkey = c_custkey),
now AS (SELECT id, project, status, CASE WHEN project = 'n7' AND id % 9 = 0 THEN cents + 1 ELSE cents END AS cents FROM files WHERE NOT (project = 'n3' AND id % 5 = 0)),
touched AS (SELECT 'n7' AS node WHERE EXISTS (SELECT 1 FROM files WHERE project = 'n7' AND id % 9 = 0) UNION SELECT 'n3' WHERE EXISTS (SELECT 1 FROM files WHERE project = 'n3' AND id % 5 = 0)),
refs AS (SELECT 'n' || n_nationkey AS src, 'n' || (n_nationkey - 1) AS dst FROM nation WHERE n_nationkey % 6 <> 0),
stale(node) AS (SELECT node FROM touched UNION SELECT src FROM stale JOIN refs ON node = dst)
SELECT project, status, count(*) AS n_files, CAST(sum(cents) AS BIGINT) AS cents, CAST(CASE WHEN project IN (SELECT node FROM stale) THEN 1 ELSE 0 END AS BIGINT) AS made_in FROM now GROUP BY project, status""")
def incremental_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts after a refresh of two changed projects and those that refer to them, equal to a rebuild; ``made_in`` tells which were worked out again."""
    before = _orders_as_files(spark, d)
    digest = F.sha2(F.concat_ws(":", "status", "cents"), 256)
    now = before.where("not (project = 'n3' and id % 5 = 0)").withColumn("cents", F.when((F.col("project") == "n7") & (F.col("id") % 9 == 0), F.col("cents") + 1).otherwise(F.col("cents")))
    refs = _t(spark, d, "nation").where("n_nationkey % 6 <> 0").select(_id("n", "n_nationkey").alias("src"), _id("n", F.col("n_nationkey") - 1).alias("dst"))
    store = FactStore(spark, shared_path(spark, f"facts-{uuid.uuid4().hex}"), "project string, status string, n_files long, cents long", order_facts)
    store.refresh(before.withColumn("digest", digest), refs)
    last, _ = store.refresh(now.withColumn("digest", digest), refs)
    return store.facts(last).join(store.projects(last), "project")
