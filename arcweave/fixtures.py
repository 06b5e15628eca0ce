"""Named graphs over the star-schema tables, as SQL that Spark and DuckDB both read.

Each text gives (src, dst, weight) edges or (id) vertices; table names stand in braces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .graph import Graph
from .plans.tables import indexed

#: Suppliers that occur in one order; each keeps its five heaviest partners, ties to the smaller id.
SUPPLIER_CO = """
SELECT DISTINCT least(u, v) AS src, greatest(u, v) AS dst, weight FROM (
  SELECT u, v, weight, row_number() OVER (PARTITION BY u ORDER BY weight DESC, v) AS k FROM (
    SELECT a.s AS u, b.s AS v, CAST(count(*) AS DOUBLE) AS weight
    FROM (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM {lineitem}) a
    JOIN (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM {lineitem}) b ON a.o = b.o AND a.s <> b.s
    GROUP BY a.s, b.s) p) q
WHERE k <= 5"""
#: The same without the cut: all pairs of suppliers that occur in one order.
SUPPLIER_ALL = """
SELECT a.s AS src, b.s AS dst, CAST(count(*) AS DOUBLE) AS weight
FROM (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM {lineitem}) a
JOIN (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM {lineitem}) b ON a.o = b.o AND a.s < b.s
GROUP BY a.s, b.s"""
SUPPLIERS = "SELECT s_suppkey AS id, CAST(s_nationkey AS BIGINT) AS attr FROM {supplier}"

#: Supplier nation to customer nation, weighed by number of lines: every pair that occurs.
NATION_TRADE = """
SELECT CAST(s_nationkey AS BIGINT) AS src, CAST(c_nationkey AS BIGINT) AS dst, CAST(count(*) AS DOUBLE) AS weight
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {supplier} ON l_suppkey = s_suppkey
GROUP BY s_nationkey, c_nationkey"""
NATIONS = "SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_regionkey AS BIGINT) AS attr FROM {nation}"

#: Region (10 + key) to nation (100 + key) to supplier (1000 + key): a forest.
GEO_TREE = """
SELECT CAST(10 + n_regionkey AS BIGINT) AS src, CAST(100 + n_nationkey AS BIGINT) AS dst, CAST(1 AS DOUBLE) AS weight FROM {nation}
UNION ALL SELECT CAST(100 + s_nationkey AS BIGINT), 1000 + s_suppkey, CAST(1 AS DOUBLE) FROM {supplier}"""
GEO = """
SELECT id, id AS attr FROM (
  SELECT CAST(10 + r_regionkey AS BIGINT) AS id FROM {region}
  UNION ALL SELECT CAST(100 + n_nationkey AS BIGINT) FROM {nation}
  UNION ALL SELECT 1000 + s_suppkey FROM {supplier}) x"""

#: Parts (2 * key) and suppliers (2 * key + 1) that share a line.
PART_SUPPLIER = "SELECT DISTINCT 2 * l_partkey AS src, 2 * l_suppkey + 1 AS dst, CAST(1 AS DOUBLE) AS weight FROM {lineitem}"
PARTS = "SELECT DISTINCT id, id AS attr FROM (SELECT 2 * l_partkey AS id FROM {lineitem} UNION ALL SELECT 2 * l_suppkey + 1 FROM {lineitem}) x"

GRAPHS = {
    "supplier_co": (SUPPLIERS, SUPPLIER_CO, False),
    "supplier_all": (SUPPLIERS, SUPPLIER_ALL, False),
    "nation_trade": (NATIONS, NATION_TRADE, True),
    "geo_tree": (GEO, GEO_TREE, True),
    "part_supplier": (PARTS, PART_SUPPLIER, False),
}
TABLES = "region nation customer supplier part orders lineitem events".split()


def sql_frame(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The text over the Parquet tables of a folder."""
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text})


def load(spark: SparkSession, sf_dir: str, name: str) -> Graph:
    """A named graph; edge ids follow (src, dst)."""
    v, e, directed = GRAPHS[name]
    edges = indexed(sql_frame(spark, sf_dir, e), ["src", "dst"], "eid").select("eid", "src", "dst", "weight")
    return Graph(sql_frame(spark, sf_dir, v), edges, directed)
