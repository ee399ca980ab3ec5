"""The jobs as queries over the driver's tables: each runs twice into a new folder, and its whole output is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.shared import shared_dir

from . import health_report, symbol_index


def _new_folder(spark: SparkSession, name: str) -> str:
    """A folder of our own in the shared one; its files stay."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_symbol_index(spark: SparkSession, d: str) -> DataFrame:
    """What every document declares, with the document's metrics."""
    out, config = _new_folder(spark, "job1_symbol_index"), symbol_index.load_config()
    for _ in range(2):
        symbol_index.run(spark, f"{d}/documents.parquet", out, config)
    symbols, files = symbol_index.read_output(spark, out, "symbols"), symbol_index.read_output(spark, out, "files")
    return files.select("project", "file", "n_lines", "n_words", "score", "generated").join(symbols.select("project", "file", "name", "line", "n"), ["project", "file"], "left")


def job2_health_report(spark: SparkSession, d: str) -> DataFrame:
    """The worst of each project in each dimension, and totals."""
    out = _new_folder(spark, "job2_health_report")
    for _ in range(2):
        health_report.run(spark, f"{d}/part.parquet", f"{d}/lineitem.parquet", out, "all", health_report.load_config())
    return health_report.read_output(spark, out).select("dimension", "project", "n", F.col("site").cast("int").alias("site"), "item", "weight")


QUERIES = {"job1_symbol_index": job1_symbol_index, "job2_health_report": job2_health_report}

_JOB1 = r"""
WITH docs AS (SELECT doc_id AS file, coalesce(nullif(trim(source), ''), '(none)') AS project, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents WHERE doc_id IS NOT NULL),
files AS (SELECT project, file, CAST(len(l) - 1 AS BIGINT) AS n_lines, CAST(len(regexp_extract_all(text, '[^ \t\r\n]+')) AS BIGINT) AS n_words,
                 CAST(1 + len(regexp_extract_all(text, ' (?:the|and|of|der|que|les)[ ,.]')) AS BIGINT) AS score, contains(lower(substr(text, 1, 1024)), '<auto-generated') AS generated FROM docs),
lines AS (SELECT project, file, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS raw FROM docs),
symbols AS (SELECT project, file, name, CAST(min(line) AS INT) AS line, count(*) AS n FROM (SELECT *, regexp_extract(raw, '^([A-Z][A-Za-z0-9_]+)', 1) AS name FROM lines) WHERE name <> '' GROUP BY ALL)
SELECT project, file, n_lines, n_words, score, generated, name, line, n FROM files LEFT JOIN symbols USING (project, file)
"""

_JOB2 = """
WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS dst FROM lineitem WHERE l_quantity >= 40) WHERE dst IS NOT NULL AND src <> dst),
covered(node, depth) AS (SELECT p_partkey, 0 FROM part WHERE p_brand = 'Brand#11' UNION SELECT dst, depth + 1 FROM covered JOIN e ON node = src WHERE depth < 3),
sizes AS (SELECT l_partkey AS id, count(*) AS lines, count(DISTINCT l_orderkey) AS members, count(DISTINCT l_suppkey) AS users FROM lineitem GROUP BY 1),
found AS (
  SELECT 'unused' AS dimension, p_partkey AS id, p_size AS weight FROM part WHERE p_size < 45 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 40 AND l_shipdate >= TIMESTAMP '2001-01-01')
  UNION ALL SELECT 'obsolete', p_partkey, count(*) FROM part JOIN lineitem ON l_partkey = p_partkey WHERE p_size >= 44 GROUP BY p_partkey
  UNION ALL SELECT 'naming', p_partkey, length(p_name) FROM part WHERE NOT regexp_matches(p_name, '^[a-m]')
  UNION ALL SELECT 'large', id, greatest(members, lines) FROM sizes WHERE members >= 40 OR lines >= 45
  UNION ALL SELECT 'coupled', id, users FROM sizes WHERE lines > 30 AND members > 30 AND users >= 28
  UNION ALL SELECT 'uncovered', p_partkey, 1 FROM part WHERE p_brand <> 'Brand#11' AND p_partkey NOT IN (SELECT node FROM covered)),
facts AS (SELECT dimension, p_brand AS project, id AS item, CAST(weight AS DOUBLE) AS weight FROM found JOIN part ON id = p_partkey),
ranked AS (SELECT *, count(*) OVER (PARTITION BY project, dimension) AS n, row_number() OVER (PARTITION BY project, dimension ORDER BY -weight, item) AS site FROM facts)
SELECT dimension, project, n, CAST(site AS INT) AS site, item, weight FROM ranked WHERE site <= 5
UNION ALL SELECT d, '*', count(item), 0, NULL, NULL FROM (SELECT unnest(['unused', 'obsolete', 'naming', 'large', 'coupled', 'uncovered']) AS d) LEFT JOIN facts ON dimension = d GROUP BY d
"""

ORACLE_SQL = {"job1_symbol_index": _JOB1, "job2_health_report": _JOB2}
