"""Operators bound to the driver's tables, and the same in SQL.

Roles: symbol = part, occurrence = lineitem (file = order, line = line number, project = supplier), type
tree = region, nation, customer, call = next part of an order where the quantity is 40 or more, text =
documents, severity = order priority, snapshots = orders before and from 1998-06.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.predicates import contains_ci, percent, shortened
from factloom.operators import code_queries as Q
from factloom.operators import code_tools, graph
from factloom.operators.envelope import first_by, first_sites, list_result
from factloom.plans.snapshots import Catalog
from factloom.streaming.changes import manifest_diff

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_KIND = "CASE WHEN l_returnflag = 'R' THEN 'write' WHEN l_linestatus = 'O' THEN 'read' ELSE 'invocation' END"
_OCC = f"SELECT l_partkey AS target, l_orderkey AS file, l_linenumber AS line, md5(concat_ws('|', l_partkey, l_suppkey, epoch_us(l_shipdate), CAST(round(l_extendedprice * 100) AS BIGINT))) AS col, {_KIND} AS kind, l_suppkey AS project FROM lineitem"
_KINDS = ["write", "read", "invocation"]


def _place() -> Column:
    """What tells apart lines of an order with the same number."""
    return F.md5(F.concat_ws("|", "l_partkey", "l_suppkey", F.unix_micros(F.col("l_shipdate").cast("timestamp")), F.round(F.col("l_extendedprice") * 100).cast("long")))


def _occurrences(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "R", "write").when(F.col("l_linestatus") == "O", "read").otherwise("invocation")
    return _t(spark, d, "lineitem").select(F.col("l_partkey").alias("target"), F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), _place().alias("col"), kind.alias("kind"), F.col("l_suppkey").alias("project"))


_EDGES = "SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS dst FROM lineitem WHERE l_quantity >= 40) WHERE dst IS NOT NULL AND src <> dst"


def _calls(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    rows = _t(spark, d, "lineitem").where("l_quantity >= 40").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"))
    return rows.where("dst is not null and src <> dst").distinct()


def _targets(spark: SparkSession, d: str, where: str) -> DataFrame:
    return _t(spark, d, "part").where(where).select(F.col("p_partkey").alias("target"))


@_query(f"SELECT DISTINCT file, line, col, kind, project FROM ({_OCC}) WHERE target = 77 AND kind IN ('write', 'read') ORDER BY file, line, col LIMIT 500")
def find_references(spark: SparkSession, d: str) -> DataFrame:
    rows = Q.references(_occurrences(spark, d), _targets(spark, d, "p_partkey = 77"), ["Write", "read"], _KINDS)
    return list_result(rows, [F.col("file"), F.col("line"), F.col("col")], 500).items.select("file", "line", "col", "kind", "project")


@_query(f"SELECT dimension, key, count(*) AS n FROM (SELECT DISTINCT file, line, col, kind, project FROM ({_OCC}) o JOIN part ON target = p_partkey WHERE p_size = 7), LATERAL (SELECT unnest(['byKind', 'byProject']) AS dimension, unnest([kind, CAST(project AS VARCHAR)]) AS key) GROUP BY ALL")
def reference_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = Q.references(_occurrences(spark, d), _targets(spark, d, "p_size = 7"), None, _KINDS)
    return list_result(rows, [F.col("file"), F.col("line"), F.col("col")], 500, {"byKind": F.col("kind"), "byProject": F.col("project")}).summary


@_query(f"SELECT file, line, min(project) AS project, count(*) AS n FROM ({_OCC}) JOIN part ON target = p_partkey WHERE p_size = 7 GROUP BY file, line")
def find_callers(spark: SparkSession, d: str) -> DataFrame:
    return Q.callers(_occurrences(spark, d), _targets(spark, d, "p_size = 7"))


@_query(f"WITH o AS ({_OCC}), c AS (SELECT * FROM o WHERE target IN (77, 78)) SELECT DISTINCT 'file' AS kind, lower(CAST(file AS VARCHAR)) AS name FROM c UNION SELECT 'project', lower(CAST(project AS VARCHAR)) FROM c WHERE (file, line, project) IN (SELECT file, line, project FROM c)")
def analyze_change_impact(spark: SparkSession, d: str) -> DataFrame:
    occurrences, targets = _occurrences(spark, d), _targets(spark, d, "p_partkey in (77, 78)")
    return Q.change_impact(Q.references(occurrences, targets, None, _KINDS), Q.callers(occurrences, targets))


@_query("SELECT p_partkey AS id, p_name AS name, CASE WHEN lower(p_name) = 're' THEN 0 WHEN starts_with(lower(p_name), 're') THEN 1 ELSE 2 END AS rank FROM part WHERE contains(lower(p_name), 're') ORDER BY rank, name, id LIMIT 200")
def search_symbols(spark: SparkSession, d: str) -> DataFrame:
    rows = Q.search_symbols(_t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), "RE")
    return list_result(rows, [F.col("rank"), F.col("name"), F.col("id")], 200).items


@_query("SELECT min(p_partkey) AS id, p_name AS name, min(p_brand) AS container FROM (SELECT *, min(p_partkey) OVER (PARTITION BY p_name) AS first FROM part) WHERE p_partkey = first GROUP BY p_name")
def go_to_definition(spark: SparkSession, d: str) -> DataFrame:
    parts = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("container"))
    return first_by(parts, ["name"], ["id"]).select("id", "name", "container")


_TREE = "SELECT 'N' || n_nationkey AS child, 'R' || n_regionkey AS parent FROM nation UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer"


def _tree(spark: SparkSession, d: str) -> DataFrame:
    up = _t(spark, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("src"), F.concat(F.lit("R"), "n_regionkey").alias("dst"))
    return up.unionByName(_t(spark, d, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("src"), F.concat(F.lit("N"), "c_nationkey").alias("dst")))


@_query(f"WITH RECURSIVE t AS ({_TREE}), c(descendant, ancestor, depth) AS (SELECT child, parent, 1 FROM t UNION ALL SELECT descendant, parent, depth + 1 FROM c JOIN t ON ancestor = child) SELECT descendant, ancestor, depth FROM c")
def type_closure(spark: SparkSession, d: str) -> DataFrame:
    return graph.reach_from_each(_tree(spark, d)).select(F.col("root").alias("descendant"), F.col("node").alias("ancestor"), "depth")


@_query(f"WITH RECURSIVE t AS ({_TREE}), c(node, depth) AS (SELECT child, 1 FROM t WHERE parent = 'R1' UNION ALL SELECT child, depth + 1 FROM c JOIN t ON node = parent) SELECT node, depth FROM c")
def find_implementations(spark: SparkSession, d: str) -> DataFrame:
    down = _tree(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.reach(down, spark.createDataFrame([("R1",)], "node string")).where("depth > 0")


@_query(f"WITH RECURSIVE t AS ({_TREE}), up(node, depth) AS (SELECT parent, 1 FROM t WHERE child = 'C7' UNION ALL SELECT parent, depth + 1 FROM up JOIN t ON node = child), down(node, depth) AS (SELECT child, 1 FROM t WHERE parent = 'N3' UNION ALL SELECT child, depth + 1 FROM down JOIN t ON node = parent) SELECT 'base' AS relation, node, depth FROM up UNION ALL SELECT 'derived', node, depth FROM down")
def get_type_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    tree = _tree(spark, d)
    one = lambda x: spark.createDataFrame([(x,)], "node string")
    bases = graph.reach(tree, one("C7")).where("depth > 0").select(F.lit("base").alias("relation"), "node", "depth")
    down = tree.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return bases.unionByName(graph.reach(down, one("N3")).where("depth > 0").select(F.lit("derived").alias("relation"), "node", "depth"))


@_query("SELECT p_brand AS type, count(*) AS n_members, count(DISTINCT p_type) AS n_kinds, min(p_name) AS first_member, CAST(max(p_size) AS INT) AS largest FROM part GROUP BY p_brand")
def get_symbol_context(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").groupBy(F.col("p_brand").alias("type")).agg(F.count("*").alias("n_members"), F.countDistinct("p_type").alias("n_kinds"), F.min("p_name").alias("first_member"), F.max("p_size").alias("largest"))


@_query("SELECT p_brand AS type, n_members, count(o_orderkey) AS n_diagnostics FROM (SELECT p_brand, count(*) AS n_members FROM part GROUP BY p_brand) LEFT JOIN (SELECT DISTINCT p_brand AS b, o_orderkey FROM part JOIN lineitem ON p_partkey = l_partkey JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT') ON p_brand = b GROUP BY ALL")
def get_type_overview(spark: SparkSession, d: str) -> DataFrame:
    part = _t(spark, d, "part")
    urgent = _t(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    found = _t(spark, d, "lineitem").select("l_partkey", "l_orderkey").join(urgent, "l_orderkey").join(part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").select("p_brand", "l_orderkey").distinct()
    counts = found.groupBy("p_brand").agg(F.count("*").alias("n_diagnostics"))
    return part.groupBy("p_brand").agg(F.count("*").alias("n_members")).join(counts, "p_brand", "left").select(F.col("p_brand").alias("type"), "n_members", F.coalesce("n_diagnostics", F.lit(0)).alias("n_diagnostics"))


@_query("SELECT source AS file, count(*) AS n_rows, count(DISTINCT lang) AS n_langs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source")
def get_file_overview(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").groupBy(F.col("source").alias("file")).agg(F.count("*").alias("n_rows"), F.countDistinct("lang").alias("n_langs"), F.sum("n_chars").alias("chars"))


@_query("SELECT p_partkey AS id, p_name AS name, p_brand AS type, CAST(row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_size, p_partkey) AS INT) AS overload FROM part WHERE p_brand = 'Brand#11'")
def get_overloads(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("type", "name").orderBy("p_size", "id")
    return _t(spark, d, "part").where("p_brand = 'Brand#11'").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("type"), "p_size").select("id", "name", "type", F.row_number().over(order).alias("overload"))


@_query("SELECT event_id, CASE event_type WHEN 'view' THEN 'v' WHEN 'click' THEN 'c' WHEN 'purchase' THEN 'p' ELSE '?' END AS token, event_type IN ('view', 'click', 'purchase') AS known FROM events")
def get_operators(spark: SparkSession, d: str) -> DataFrame:
    tokens = F.create_map(*(F.lit(x) for pair in {"view": "v", "click": "c", "purchase": "p"}.items() for x in pair))
    return _t(spark, d, "events").select("event_id", F.coalesce(tokens[F.col("event_type")], F.lit("?")).alias("token"), tokens[F.col("event_type")].isNotNull().alias("known"))


@_query("SELECT DISTINCT event_type AS attribute, user_id AS target FROM events WHERE lower(event_type) IN ('signup', 'signupattribute') ORDER BY ALL LIMIT 500")
def find_attribute_usages(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "events").where(F.lower("event_type").isin("signup", "signupattribute")).select(F.col("event_type").alias("attribute"), F.col("user_id").alias("target")).distinct()
    return list_result(rows, [F.col("attribute"), F.col("target")], 500).items


@_query("SELECT p_partkey AS id, p_name AS name, CASE WHEN p_size >= 45 THEN 'generated' WHEN p_brand = 'Brand#11' THEN 'testMethod' WHEN p_type LIKE 'PROMO%' THEN 'interop' END AS excused FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 40 AND l_shipdate >= TIMESTAMP '2001-01-01')")
def find_unused_symbols(spark: SparkSession, d: str) -> DataFrame:
    refs = _t(spark, d, "lineitem").where("l_quantity >= 40 and l_shipdate >= timestamp '2001-01-01'").select(F.col("l_partkey").alias("id"))
    parts = _t(spark, d, "part").withColumnsRenamed({"p_partkey": "id", "p_name": "name"})
    reasons = [("generated", F.col("p_size") >= 45), ("testMethod", F.col("p_brand") == "Brand#11"), ("interop", F.col("p_type").startswith("PROMO"))]
    return Q.unused(parts, refs, reasons).select("id", "name", "excused")


@_query("SELECT p_partkey AS id, p_name AS name, p_size >= 48 AS is_error, count(*) AS n, min(l_orderkey) AS first_file FROM part JOIN lineitem ON p_partkey = l_partkey WHERE p_size >= 44 GROUP BY ALL")
def find_obsolete_usage(spark: SparkSession, d: str) -> DataFrame:
    old = _t(spark, d, "part").where("p_size >= 44").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_size") >= 48).alias("is_error"))
    return Q.obsolete_usage(old, _t(spark, d, "lineitem").select(F.col("l_partkey").alias("target"), F.col("l_orderkey").alias("file")))


@_query("SELECT event_id, event_type AS method, CAST(json_extract_string(props, '$.k') AS BIGINT) AS argument FROM events WHERE event_type IN ('click', 'purchase')")
def find_reflection_usage(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").where(F.col("event_type").isin("click", "purchase")).select("event_id", F.col("event_type").alias("method"), F.get_json_object("props", "$.k").cast("long").alias("argument"))


@_query("SELECT json_extract_string(props, '$.k') AS service, count(*) AS n, min(event_id) AS first_event FROM events GROUP BY 1")
def get_di_registrations(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").groupBy(F.get_json_object("props", "$.k").alias("service")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@_query(f"WITH RECURSIVE e AS ({_EDGES}), c(node, depth) AS (SELECT CAST(77 AS BIGINT), 0 UNION SELECT dst, depth + 1 FROM c JOIN e ON node = src WHERE depth < 3) SELECT node, min(depth) AS depth FROM c GROUP BY node")
def get_call_graph(spark: SparkSession, d: str) -> DataFrame:
    return graph.reach(_calls(spark, d), spark.createDataFrame([(77,)], "node long"), 3)


@_query(f"WITH RECURSIVE e AS ({_EDGES}), c(node) AS (SELECT dst FROM e WHERE src = 77 UNION SELECT dst FROM c JOIN e ON node = src) SELECT node, node IN (SELECT dst FROM e WHERE src = 77) AS direct FROM c")
def get_project_dependencies(spark: SparkSession, d: str) -> DataFrame:
    edges = _calls(spark, d)
    first = edges.where("src = 77").select(F.col("dst").alias("node"))
    return graph.reach(edges, first).select("node", (F.col("depth") == 0).alias("direct"))


@_query(f"""WITH RECURSIVE e AS ({_EDGES}),
c(a, last, path) AS (SELECT src, dst, [src, dst] FROM e WHERE src < dst UNION ALL SELECT a, dst, list_append(path, dst) FROM c JOIN e ON last = src WHERE dst > a AND NOT list_contains(path, dst) AND len(path) < 4)
SELECT CAST(len(path) AS INT) AS length, array_to_string(list_append(path, a), '>') AS cycle FROM c JOIN e ON last = src AND dst = a""")
def find_circular_dependencies(spark: SparkSession, d: str) -> DataFrame:
    return graph.simple_cycles(_calls(spark, d), 4).select("length", F.array_join("cycle", ">").alias("cycle"))


@_query(f"""WITH RECURSIVE e AS ({_EDGES}), r(a, b) AS (SELECT src, dst FROM e UNION SELECT a, dst FROM r JOIN e ON b = src)
SELECT r.a AS node, min(r.b) AS component, count(*) AS size FROM r JOIN r AS back ON back.a = r.b AND back.b = r.a GROUP BY r.a""")
def circular_components(spark: SparkSession, d: str) -> DataFrame:
    """Beside ``find_circular_dependencies``: every node on a cycle of any length, with its strongly connected component and the size of that."""
    found = graph.components(_calls(spark, d))
    return found.join(found.groupBy("component").agg(F.count("*").alias("size")), "component").select("node", "component", "size")


_TESTS = "SELECT p_partkey FROM part WHERE p_brand = 'Brand#11'"


@_query(f"""WITH RECURSIVE e AS ({_EDGES}), t AS ({_TESTS}), c(node, path, depth) AS (SELECT CAST(77 AS BIGINT), [CAST(77 AS BIGINT)], 0
UNION ALL SELECT src, list_append(path, src), depth + 1 FROM c JOIN e ON node = dst WHERE depth < 3 AND NOT list_contains(path, src) AND (depth = 0 OR node NOT IN (SELECT * FROM t)))
SELECT node AS test, depth, array_to_string(path, '>') AS chain FROM c WHERE depth > 0 AND node IN (SELECT * FROM t)""")
def find_tests_for_symbol(spark: SparkSession, d: str) -> DataFrame:
    tests = _t(spark, d, "part").where("p_brand = 'Brand#11'").select(F.col("p_partkey").alias("node"))
    back = _calls(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    found = graph.paths(back, spark.createDataFrame([(77,)], "node long"), 3, tests)
    return found.join(tests, "node", "left_semi").select(F.col("node").alias("test"), "depth", F.array_join("path", ">").alias("chain"))


_UNCOVERED = f"WITH RECURSIVE e AS ({_EDGES}), c(node, depth) AS (SELECT p_partkey, 0 FROM ({_TESTS}) UNION SELECT dst, depth + 1 FROM c JOIN e ON node = src WHERE depth < 3), u AS (SELECT p_partkey, p_size FROM part WHERE p_brand <> 'Brand#11' AND p_partkey NOT IN (SELECT node FROM c))"


def _uncovered(spark: SparkSession, d: str) -> DataFrame:
    parts = _t(spark, d, "part").select(F.col("p_partkey").alias("node"), "p_size", "p_brand")
    return Q.uncovered(parts.where("p_brand <> 'Brand#11'"), _calls(spark, d), parts.where("p_brand = 'Brand#11'").select("node"))


@_query(_UNCOVERED + " SELECT p_partkey AS node, p_size >= 25 AS hotspot FROM u")
def find_uncovered_symbols(spark: SparkSession, d: str) -> DataFrame:
    return _uncovered(spark, d).select("node", (F.col("p_size") >= 25).alias("hotspot"))


@_query(_UNCOVERED + " SELECT t AS total, t - n AS covered, CAST(CASE WHEN t = 0 THEN 100 ELSE floor((t - n) / t * 100) END AS BIGINT) AS coverage_percent FROM (SELECT (SELECT count(*) FROM part WHERE p_brand <> 'Brand#11') AS t, (SELECT count(*) FROM u) AS n)")
def coverage_summary(spark: SparkSession, d: str) -> DataFrame:
    total = _t(spark, d, "part").where("p_brand <> 'Brand#11'").select(F.col("p_partkey").alias("node")).withColumn("u", F.lit(0)).unionByName(_uncovered(spark, d).select("node", F.lit(1).alias("u")))
    n = total.agg(F.count_if(F.col("u") == 0).alias("total"), F.count_if(F.col("u") == 1).alias("bare"))
    return n.select("total", (F.col("total") - F.col("bare")).alias("covered"), percent(F.col("total") - F.col("bare"), F.col("total")).alias("coverage_percent"))


_ARCH = """WITH e AS (SELECT cn.n_name AS source, sn.n_name AS target, l_orderkey AS file, l_linenumber AS line, md5(concat_ws('|', l_partkey, l_suppkey, epoch_us(l_shipdate), CAST(round(l_extendedprice * 100) AS BIGINT))) AS tie
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey),
h AS (SELECT 'no-one' AS rule, * FROM e WHERE source = 'NATION_1' AND target IN ('NATION_2', 'NATION_3') UNION ALL SELECT 'only', * FROM e WHERE source = 'NATION_4' AND target NOT IN ('NATION_4', 'NATION_5'))
SELECT rule, source, target, n, CAST(site AS INT) AS site, file, line FROM (SELECT *, count(*) OVER (PARTITION BY rule, source, target) AS n, row_number() OVER (PARTITION BY rule, source, target ORDER BY file, line, tie) AS site FROM h WHERE source <> target) WHERE site <= 5"""


@_query(_ARCH)
def check_architecture(spark: SparkSession, d: str) -> DataFrame:
    nation = _t(spark, d, "nation").select("n_nationkey", "n_name")
    lines = _t(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", _place().alias("tie"))
    customers = _t(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("source"))
    suppliers = _t(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("target"))
    orders = _t(spark, d, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("l_orderkey"), "source")
    edges = lines.join(suppliers, "l_suppkey").join(orders, "l_orderkey").select("source", "target", F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), "tie")
    rules = [{"name": "no-one", "kind": "forbid", "from": "NATION_1", "to": ["NATION_2", "NATION_3"]}, {"name": "only", "kind": "allowOnly", "from": "NATION_4", "to": ["NATION_4", "NATION_5"]}]
    return Q.architecture(edges, rules, 5)


_SNAP = "SELECT o_custkey AS name, substr(o_orderpriority, 1, 1) AS access, o_orderstatus AS kind, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders WHERE o_orderdate {} TIMESTAMP '1998-06-01'"


@_query(f"""WITH a AS (SELECT * FROM ({_SNAP.format("<")}) WHERE r = 1), b AS (SELECT * FROM ({_SNAP.format(">=")}) WHERE r = 1)
SELECT coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL THEN 'Removed' WHEN a.name IS NULL THEN 'Added' WHEN a.kind <> b.kind THEN 'KindChanged' WHEN a.access < b.access THEN 'AccessibilityNarrowed' WHEN a.access > b.access THEN 'AccessibilityWidened' END AS change,
CASE WHEN a.name IS NULL OR (b.name IS NOT NULL AND a.kind = b.kind AND a.access > b.access) THEN 'NonBreaking' ELSE 'Breaking' END AS severity
FROM a FULL JOIN b ON a.name = b.name WHERE change IS NOT NULL""")
def find_breaking_changes(spark: SparkSession, d: str) -> DataFrame:
    orders = _t(spark, d, "orders").select(F.col("o_custkey").alias("name"), F.col("o_orderstatus").alias("kind"), F.substring("o_orderpriority", 1, 1).alias("access"), F.struct("o_orderdate", "o_orderkey").alias("seq"), "o_orderdate")
    cut = F.lit("1998-06-01").cast("timestamp")
    return Q.breaking_changes(orders.where(F.col("o_orderdate") < cut), orders.where(F.col("o_orderdate") >= cut))


@_query("SELECT dimension, key, count(*) AS n FROM part, LATERAL (SELECT unnest(['kind', 'project', 'size']) AS dimension, unnest([p_type, p_brand, CAST(p_size AS VARCHAR)]) AS key) WHERE p_size <= 40 GROUP BY ALL")
def get_public_api_surface(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "part").where("p_size <= 40")
    return list_result(rows, [F.col("p_name"), F.col("p_partkey")], 100, {"kind": F.col("p_type"), "project": F.col("p_brand"), "size": F.col("p_size")}).summary


_COMPLEX = r"SELECT doc_id, source, 1 + len(regexp_extract_all(text, ' (?:the|and|of|der|que|les)[ ,.]')) AS score FROM documents"


@_query(f"SELECT doc_id, source, score FROM ({_COMPLEX}) WHERE score >= 10")
def get_complexity_metrics(spark: SparkSession, d: str) -> DataFrame:
    score = 1 + F.regexp_count("text", F.lit(" (?:the|and|of|der|que|les)[ ,.]")).cast("long")
    return _t(spark, d, "documents").select("doc_id", "source", score.alias("score")).where("score >= 10")


@_query(f"SELECT source AS project, max(score) AS highest, round(avg(score), 6) AS mean, count(*) FILTER (score > 10) AS over_threshold FROM ({_COMPLEX}) GROUP BY source")
def complexity_summary(spark: SparkSession, d: str) -> DataFrame:
    score = 1 + F.regexp_count("text", F.lit(" (?:the|and|of|der|que|les)[ ,.]")).cast("long")
    return _t(spark, d, "documents").groupBy(F.col("source").alias("project")).agg(F.max(score).alias("highest"), F.round(F.avg(score), 6).alias("mean"), F.count_if(score > 10).alias("over_threshold"))


@_query("SELECT type, members, lines, greatest(members, lines) AS size FROM (SELECT o_custkey AS type, count(DISTINCT o_orderkey) AS members, count(*) AS lines FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey) WHERE members >= 20 OR lines >= 60")
def find_large_classes(spark: SparkSession, d: str) -> DataFrame:
    lines = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    orders = _t(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return Q.large_types(orders.groupBy(F.col("o_custkey").alias("type")).agg(F.countDistinct("o_orderkey").alias("members"), F.sum("n").alias("lines")), 20, 60)


@_query("""WITH s AS (SELECT l_suppkey AS type, count(*) AS lines, count(DISTINCT l_partkey) AS members, count(DISTINCT l_orderkey) AS fields FROM lineitem GROUP BY 1),
k AS (SELECT l_suppkey AS type, count(DISTINCT p_brand) AS n_out, count(DISTINCT c_nationkey) AS n_in FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT type, lines, members, fields, n_in, n_out FROM s JOIN k USING (type) WHERE lines > 600 AND members > 500 AND fields > 590 AND (n_in >= 25 OR n_out >= 25)""")
def find_god_objects(spark: SparkSession, d: str) -> DataFrame:
    lines = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("type"), "l_partkey", "l_orderkey")
    sizes = lines.groupBy("type").agg(F.count("*").alias("lines"), F.countDistinct("l_partkey").alias("members"), F.countDistinct("l_orderkey").alias("fields"))
    out = lines.join(_t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ns")), "l_partkey").select("type", F.lit("out").alias("way"), "ns")
    buyers = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("l_orderkey"), F.col("c_nationkey").cast("string").alias("ns"))
    both = out.unionByName(lines.join(buyers, "l_orderkey").select("type", F.lit("in").alias("way"), "ns"))
    return Q.god_objects(sizes, {"lines": 600, "members": 500, "fields": 590}, both, 25, 25)


@_query("SELECT p_partkey AS id, CASE WHEN NOT regexp_matches(p_name, '^[A-Z]') THEN 'PascalCase' ELSE 'suffix' END AS rule, upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS suggestion FROM part WHERE NOT regexp_matches(p_name, '^[A-Z]') AND p_size > 25 OR regexp_matches(p_type, 'STEEL$')")
def find_naming_violations(spark: SparkSession, d: str) -> DataFrame:
    lower = ~F.col("p_name").rlike("^[A-Z]")
    rows = _t(spark, d, "part").where((lower & (F.col("p_size") > 25)) | F.col("p_type").rlike("STEEL$"))
    return rows.select(F.col("p_partkey").alias("id"), F.when(lower, "PascalCase").otherwise("suffix").alias("rule"), F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substring(p_name, 2)")).alias("suggestion"))


@_query("SELECT event_id, user_id, CASE WHEN EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'purchase') THEN 'FireAndForget' ELSE 'MissingAwait' END AS pattern FROM events a WHERE event_type = 'signup' AND NOT EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND b.ts > a.ts)")
def find_async_violations(spark: SparkSession, d: str) -> DataFrame:
    events = _t(spark, d, "events")
    last = events.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("last"))
    rows = events.where("event_type = 'signup'").join(last, "user_id", "left").where("last is null or last <= ts")
    return rows.select("event_id", "user_id", F.when(F.col("last").isNull(), "MissingAwait").otherwise("FireAndForget").alias("pattern"))


@_query("SELECT event_id, value > 50 AS is_error FROM events a WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND b.props = a.props)")
def find_disposable_misuse(spark: SparkSession, d: str) -> DataFrame:
    events = _t(spark, d, "events")
    return events.where("event_type = 'click'").join(events.where("event_type = 'purchase'").select("user_id", "props"), ["user_id", "props"], "left_anti").select("event_id", (F.col("value") > 50).alias("is_error"))


@_query("SELECT o_orderkey AS id, CAST(substr(o_orderpriority, 1, 1) AS INT) AS rank, o_custkey AS file FROM orders WHERE substr(o_orderpriority, 1, 1) <= '2' ORDER BY rank, file, id LIMIT 1000")
def get_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("rank"), F.col("o_custkey").alias("file")).where("rank <= 2")
    return list_result(rows, [F.col("rank"), F.col("file"), F.col("id")], 1000).items


@_query("SELECT project, dimension, n, CAST(site AS INT) AS site, item, weight FROM (SELECT *, count(*) OVER (PARTITION BY project, dimension) AS n, row_number() OVER (PARTITION BY project, dimension ORDER BY -weight, item) AS site FROM (SELECT c_nationkey AS project, 'balance' AS dimension, c_custkey AS item, c_acctbal AS weight FROM customer UNION ALL SELECT s_nationkey, 'supply', s_suppkey, s_acctbal FROM supplier)) WHERE site <= 5")
def get_project_health(spark: SparkSession, d: str) -> DataFrame:
    a = _t(spark, d, "customer").select(F.col("c_nationkey").alias("project"), F.lit("balance").alias("dimension"), F.col("c_custkey").alias("item"), F.col("c_acctbal").alias("weight"))
    b = _t(spark, d, "supplier").select(F.col("s_nationkey").alias("project"), F.lit("supply").alias("dimension"), F.col("s_suppkey").alias("item"), F.col("s_acctbal").alias("weight"))
    return Q.health(a.unionByName(b), 5)


_SPANS = "SELECT user_id AS scope, ts AS start, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS stop, event_id AS span FROM events WHERE event_type IN ('signup', 'purchase')"


def _spans(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _t(spark, d, "events").where("event_type in ('signup', 'purchase')").select(F.col("user_id").alias("scope"), F.col("ts").alias("start"), F.lead("ts").over(order).alias("stop"), F.col("event_id").alias("span"))


@_query(f"""SELECT scope, "at", id, arg_max(span, (start, span)) AS span FROM (SELECT user_id AS scope, ts AS "at", event_id AS id FROM events WHERE event_type = 'error') JOIN ({_SPANS}) USING (scope) WHERE "at" >= start AND "at" < stop GROUP BY ALL""")
def find_throw_sites(spark: SparkSession, d: str) -> DataFrame:
    points = _t(spark, d, "events").where("event_type = 'error'").select(F.col("user_id").alias("scope"), F.col("ts").alias("at"), F.col("event_id").alias("id"))
    return Q.innermost(points, _spans(spark, d)).drop("start")


@_query(f"SELECT span, count(*) AS n_caught FROM (SELECT user_id AS scope, ts FROM events WHERE event_type = 'error') JOIN ({_SPANS}) USING (scope) WHERE ts >= start AND ts < stop GROUP BY span")
def find_catch_blocks(spark: SparkSession, d: str) -> DataFrame:
    points = _t(spark, d, "events").where("event_type = 'error'").select(F.col("user_id").alias("scope"), F.col("ts").alias("at"), F.col("event_id").alias("id"))
    return Q.innermost(points, _spans(spark, d)).groupBy("span").agg(F.count("*").alias("n_caught"))


@_query(r"SELECT page_id, href, split_part(href, '/', 2) AS generator FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages)")
def get_generated_code(spark: SparkSession, d: str) -> DataFrame:
    hrefs = F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1)))
    return _t(spark, d, "pages").select("page_id", hrefs.alias("href")).select("page_id", "href", F.coalesce(F.get(F.split("href", "/"), F.lit(1)), F.lit("")).alias("generator"))


@_query(r"SELECT split_part(href, '/', 2) AS generator, count(*) AS n, count(DISTINCT href) AS n_files FROM (SELECT unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY 1")
def get_source_generators(spark: SparkSession, d: str) -> DataFrame:
    return get_generated_code(spark, d).groupBy("generator").agg(F.count("*").alias("n"), F.countDistinct("href").alias("n_files"))


@_query("SELECT p_brand AS project, p_type AS framework, count(*) AS n_tests, CAST(sum(p_size) AS BIGINT) AS n_rows FROM part GROUP BY ALL")
def get_test_summary(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").groupBy(F.col("p_brand").alias("project"), F.col("p_type").alias("framework")).agg(F.count("*").alias("n_tests"), F.sum("p_size").alias("n_rows"))


@_query("SELECT event_id, user_id, event_type = 'signup' AS subscribes, CASE WHEN value > 50 THEN '<lambda at ' || event_id || '>' ELSE 'user.' || user_id END AS handler FROM events WHERE event_type IN ('signup', 'purchase')")
def find_event_subscribers(spark: SparkSession, d: str) -> DataFrame:
    handler = F.when(F.col("value") > 50, F.concat(F.lit("<lambda at "), "event_id", F.lit(">"))).otherwise(F.concat(F.lit("user."), "user_id"))
    return _t(spark, d, "events").where("event_type in ('signup', 'purchase')").select("event_id", "user_id", (F.col("event_type") == "signup").alias("subscribes"), handler.alias("handler"))


@_query("SELECT name AS request, CASE count(p_partkey) WHEN 0 THEN 'notFound' WHEN 1 THEN 'ok' ELSE 'ambiguous' END AS status, count(p_partkey) AS n FROM (SELECT DISTINCT p_name AS name FROM part WHERE p_name IS NOT NULL UNION SELECT 'no such part') LEFT JOIN part ON p_name = name GROUP BY name")
def get_method_source(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct name is requested and resolved against the whole table."""
    parts = _t(spark, d, "part").where("p_name is not null").groupBy(F.col("p_name").alias("request")).agg(F.count("p_partkey").alias("found"))
    asked = parts.select("request").unionByName(spark.createDataFrame([("no such part",)], "request string")).distinct()
    n = F.coalesce("found", F.lit(0))
    return asked.join(parts, "request", "left").select("request", F.when(n == 0, "notFound").when(n == 1, "ok").otherwise("ambiguous").alias("status"), n.alias("n"))


@_query("SELECT 'constructor' AS how, p_partkey AS id FROM part WHERE p_brand = 'Brand#11' UNION ALL SELECT 'factory', l_suppkey FROM (SELECT DISTINCT l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#11' AND l_quantity >= 49)")
def get_instantiation_options(spark: SparkSession, d: str) -> DataFrame:
    own = _t(spark, d, "part").where("p_brand = 'Brand#11'").select("p_partkey")
    made = _t(spark, d, "lineitem").where("l_quantity >= 49").join(own, F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("l_suppkey").distinct()
    return own.select(F.lit("constructor").alias("how"), F.col("p_partkey").alias("id")).unionByName(made.select(F.lit("factory").alias("how"), F.col("l_suppkey").alias("id")))


@_query(f"WITH e AS ({_EDGES}) SELECT 'caller' AS way, src AS node FROM e WHERE dst IN (77, 78, 79) UNION SELECT 'callee', dst FROM e WHERE src IN (77, 78, 79)")
def analyze_method(spark: SparkSession, d: str) -> DataFrame:
    edges, of = _calls(spark, d), [77, 78, 79]
    return edges.where(F.col("dst").isin(of)).select(F.lit("caller").alias("way"), F.col("src").alias("node")).unionByName(edges.where(F.col("src").isin(of)).select(F.lit("callee").alias("way"), F.col("dst").alias("node"))).distinct()


@_query("SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS snippet FROM documents WHERE contains(lower(source), 'src1')")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").where(contains_ci(F.col("source"), "SRC1")).select("doc_id", shortened(F.col("text"), 80).alias("snippet"))


@_query(f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY target, project ORDER BY file, line, col) AS site FROM ({_OCC})) SELECT target, project, CAST(site AS INT) AS site, file, line FROM r WHERE site <= 2")
def first_references(spark: SparkSession, d: str) -> DataFrame:
    return first_sites(_occurrences(spark, d), ["target", "project"], ["file", "line", "col"], 2).select("target", "project", "site", "file", "line")


@_query(f"""WITH RECURSIVE e AS ({_EDGES}), c(node, depth, path) AS (SELECT CAST(77 AS BIGINT), 0, [CAST(77 AS BIGINT)] UNION ALL SELECT dst, depth + 1, list_append(path, dst) FROM c JOIN e ON node = src WHERE depth < 3 AND NOT list_contains(path, dst)),
s AS (SELECT node, depth, path FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY depth, path) AS r FROM c) WHERE r = 1),
t AS (SELECT node, p_type AS exception, depth, path FROM s JOIN part ON node = p_partkey WHERE p_size >= 20 OR node = 77),
f AS (SELECT node, exception, unnest(path) AS frame, unnest(range(1, len(path) + 1)) AS pos FROM t),
k AS (SELECT p_partkey AS frame, CASE WHEN p_size % 2 = 0 THEN p_type END AS clause FROM part WHERE p_size <= 30),
h AS (SELECT node, arg_max(frame, pos) AS caught_by FROM f JOIN k USING (frame) WHERE clause IS NULL OR clause = exception GROUP BY node)
SELECT node, exception, depth, array_to_string(path, '>') AS chain, caught_by FROM t LEFT JOIN h USING (node)""")
def get_exception_flow(spark: SparkSession, d: str) -> DataFrame:
    part = _t(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_type").alias("exception"), "p_size")
    clauses = part.where("p_size <= 30").select("node", F.when(F.col("p_size") % 2 == 0, F.col("exception")).alias("exception"))
    found = Q.exception_flow(_calls(spark, d), spark.createDataFrame([(77,)], "node long"), part.where("p_size >= 20 or node = 77"), clauses)
    return found.select("node", "exception", "depth", F.array_join("path", ">").alias("chain"), "caught_by")


@_query("SELECT receiver, name, CAST(distance AS INT) AS distance FROM (SELECT 'N' || s_nationkey AS receiver, s_name AS name FROM supplier UNION ALL SELECT 'R' || r_regionkey, r_name FROM region) JOIN (SELECT 'N' || c_nationkey AS receiver, 1 AS distance FROM customer WHERE c_custkey = 7 UNION ALL SELECT 'R' || n_regionkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 7) USING (receiver) ORDER BY distance, name, receiver LIMIT 100")
def get_extension_methods(spark: SparkSession, d: str) -> DataFrame:
    own = _t(spark, d, "supplier").select(F.concat(F.lit("N"), "s_nationkey").alias("receiver"), F.col("s_name").alias("name"))
    methods = own.unionByName(_t(spark, d, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("receiver"), F.col("r_name").alias("name")))
    rows = Q.extension_methods(_tree(spark, d), spark.createDataFrame([("C7",)], "node string"), methods)
    return list_result(rows, [F.col("distance"), F.col("name"), F.col("receiver")], 100).items


_ACCESS = "SELECT l_suppkey AS scope, l_linenumber AS var, l_shipdate AS seen, l_returnflag = 'R' AS writes FROM lineitem"
_IN = "seen >= TIMESTAMP '1997-01-01' AND seen < TIMESTAMP '1997-04-01'"


@_query(f"""WITH s AS (SELECT scope, var, min(seen) FILTER ({_IN} AND NOT writes) AS r, min(seen) FILTER ({_IN} AND writes) AS w, bool_or(seen < TIMESTAMP '1997-01-01' AND writes) AS wb, bool_or(seen >= TIMESTAMP '1997-04-01' AND NOT writes) AS ra, bool_or(NOT ({_IN})) AS used_outside FROM ({_ACCESS}) GROUP BY scope, var)
SELECT scope, var, r IS NOT NULL AS read_inside, w IS NOT NULL AS written_inside, wb AND r IS NOT NULL AND (w IS NULL OR r <= w) AS flows_in, w IS NOT NULL AND ra AS flows_out, used_outside FROM s WHERE r IS NOT NULL OR w IS NOT NULL""")
def analyze_data_flow(spark: SparkSession, d: str) -> DataFrame:
    accesses = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("scope"), F.col("l_linenumber").alias("var"), F.col("l_shipdate").alias("at"), (F.col("l_returnflag") == "R").alias("writes"))
    return Q.data_flow(accesses, F.lit("1997-01-01").cast("timestamp"), F.lit("1997-04-01").cast("timestamp"))


@_query(f"WITH t AS (SELECT * FROM part WHERE p_partkey = 77), n AS (SELECT min(p_name) AS name FROM part WHERE p_brand = (SELECT p_brand FROM t) AND p_partkey <> 77) SELECT DISTINCT 'edit' AS what, file, line, col, (SELECT p_name FROM t) AS old, (SELECT name FROM n) AS new FROM ({_OCC}) WHERE target = 77 UNION ALL SELECT 'conflict', NULL, NULL, CAST(p_partkey AS VARCHAR), p_name, p_name FROM part WHERE p_brand = (SELECT p_brand FROM t) AND p_name = (SELECT name FROM n) AND p_partkey <> 77")
def rename_symbol(spark: SparkSession, d: str) -> DataFrame:
    symbols = _t(spark, d, "part").select(F.col("p_partkey").alias("target"), F.col("p_name").alias("name"), F.col("p_brand").alias("container"))
    brand = symbols.where("target = 77").select("container")
    taken = symbols.join(brand, "container", "left_semi").where("target <> 77").agg(F.coalesce(F.min("name"), F.lit("renamed")).alias("new"))
    return Q.rename_plan(symbols, _occurrences(spark, d), _targets(spark, d, "p_partkey = 77"), taken)


@_query("SELECT p_brand AS namespace, count(*) AS n_types, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS names FROM part GROUP BY p_brand")
def inspect_external_assembly(spark: SparkSession, d: str) -> DataFrame:
    return Q.assembly_summary(_t(spark, d, "part").select(F.col("p_brand").alias("namespace"), F.col("p_type").alias("name")))


_GRAPH = f"""WITH RECURSIVE e AS ({_EDGES}), c(node, depth) AS (SELECT CAST(77 AS BIGINT), 0 UNION SELECT dst, depth + 1 FROM c JOIN e ON node = src WHERE depth < 3),
n AS (SELECT node, min(depth) AS depth FROM c GROUP BY node ORDER BY depth, node LIMIT 60)"""


@_query(f"{_GRAPH} SELECT src, dst FROM e WHERE src IN (SELECT node FROM n WHERE depth < 3)")
def call_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """Calls of the 60 nearest callees of part 77 that are expanded within three steps, also to nodes beyond the 60."""
    _, edges = graph.call_graph(_calls(spark, d), spark.createDataFrame([(77,)], "node long"), "callees", 3, 60)
    return edges


@_query("SELECT 'R' || r_regionkey AS node, CAST(0 AS INT) AS level FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation) UNION ALL SELECT 'N' || n_nationkey, 1 FROM nation UNION ALL SELECT 'C' || c_custkey, 2 FROM customer")
def project_levels(spark: SparkSession, d: str) -> DataFrame:
    tree = _tree(spark, d)
    return graph.levels(tree, tree.select(F.col("src").alias("node")).unionByName(tree.select(F.col("dst").alias("node"))))


@_query("SELECT 'N' || n_nationkey AS node, CAST(1 AS BIGINT) AS n FROM nation UNION ALL SELECT 'C' || c_custkey, 2 FROM customer")
def closure_sizes(spark: SparkSession, d: str) -> DataFrame:
    return graph.closure_sizes(_tree(spark, d))


@_query("""WITH a AS (SELECT o_custkey AS path, max(o_orderstatus) AS old FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1), b AS (SELECT o_custkey AS path, max(o_orderstatus) AS new FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.path = b.path WHERE old IS NULL OR new IS NULL OR old <> new""")
def manifest_changes(spark: SparkSession, d: str) -> DataFrame:
    orders = _t(spark, d, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderstatus").alias("digest"), "o_orderdate")
    at = F.lit("1998-01-01").cast("timestamp")
    return manifest_diff(orders.where(F.col("o_orderdate") < at), orders.where(F.col("o_orderdate") >= at))


@_query("""WITH r AS (SELECT event_type AS id, 'U' || user_id AS path, CAST(floor(value) AS INT) AS line, event_id % 2 AS late FROM events WHERE event_type IN ('error', 'click')),
h AS (SELECT id, path, count(*) AS had, list(DISTINCT line) AS lines FROM r WHERE late = 0 GROUP BY ALL),
x AS (SELECT r.id, r.path, line, row_number() OVER (PARTITION BY r.id, r.path ORDER BY coalesce(list_contains(lines, line), false), line, r.path) AS n, count(*) OVER (PARTITION BY r.id, r.path) - coalesce(had, 0) AS more FROM r LEFT JOIN h ON r.id = h.id AND r.path = h.path WHERE late = 1)
SELECT id, path, line, CAST(n AS INT) AS n FROM x WHERE n <= more""")
def introduced_conflicts(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "events").where("event_type in ('error', 'click')").select(F.col("event_type").alias("id"), F.concat(F.lit("U"), "user_id").alias("path"), F.floor("value").cast("int").alias("line"), F.lit(False).alias("suppressed"), (F.col("event_id") % 2).alias("late"))
    return code_tools.conflicts(rows.where("late = 0").drop("late"), rows.where("late = 1").drop("late"))


@_query("SELECT unnest(['customers', 'orders', 'parts']) AS path, unnest([false, true, false]) AS active, CAST(unnest([2, 1, 1]) AS INT) AS tables, 'ready' AS status, CAST(0 AS INT) AS skipped, unnest([(SELECT count(*) FROM customer) + (SELECT count(*) FROM nation), (SELECT count(*) FROM orders), (SELECT count(*) FROM part)]) AS facts")
def list_solutions(spark: SparkSession, d: str) -> DataFrame:
    """Loaded snapshots, with how many rows their tables have."""
    catalog = Catalog(spark)
    catalog.load("parts", {"part": _t(spark, d, "part")})
    catalog.load("customers", {"customer": _t(spark, d, "customer"), "nation": _t(spark, d, "nation")})
    catalog.load("orders", lambda: {"orders": _t(spark, d, "orders")})
    catalog.activate("CUST")
    catalog.rebuild("orders")
    catalog.activate("ord")
    return catalog.listing().join(catalog.sizes(), "path")
