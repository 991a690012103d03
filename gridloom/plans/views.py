"""Networks derived from the tables: the tree of customers and orders, the mesh of suppliers and parts, the lattice of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .registry import Tables


def _name(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column))


def tree(t: Tables) -> DataFrame:
    """node, parent, level, r, amps: orders hang on customers, these on nations, these on regions (the pads); orders are loads."""
    n = t.nation.select(_name("n", "n_nationkey").alias("node"), _name("r", "n_regionkey").alias("parent"), F.lit(1).alias("level"), (1 + F.col("n_nationkey") % 3).cast("bigint").alias("r"), F.lit(0).cast("bigint").alias("amps"))
    c = t.customer.select(_name("c", "c_custkey").alias("node"), _name("n", "c_nationkey").alias("parent"), F.lit(2).alias("level"), (1 + F.col("c_custkey") % 5).alias("r"), F.lit(0).cast("bigint").alias("amps"))
    o = t.orders.select(_name("o", "o_orderkey").alias("node"), _name("c", "o_custkey").alias("parent"), F.lit(3).alias("level"), (1 + F.col("o_orderkey") % 7).alias("r"), (1 + F.col("o_orderkey") % 5).alias("amps"))
    return n.unionByName(c).unionByName(o)


TREE = """tree AS (
  SELECT 'n' || n_nationkey AS node, 'r' || n_regionkey AS parent, 1 AS level, CAST(1 + n_nationkey % 3 AS BIGINT) AS r, CAST(0 AS BIGINT) AS amps FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 2, 1 + c_custkey % 5, 0 FROM customer
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 3, 1 + o_orderkey % 7, 1 + o_orderkey % 5 FROM orders)"""
#: Solved by hand: current of each edge upwards, drop of each node downwards.
SOLVED = (
    TREE
    + """,
  k3 AS (SELECT node, parent, r, amps AS i FROM tree WHERE level = 3),
  k2 AS (SELECT t.node, t.parent, t.r, coalesce(sum(k.i), 0)::BIGINT AS i FROM tree t LEFT JOIN k3 k ON k.parent = t.node WHERE t.level = 2 GROUP BY ALL),
  k1 AS (SELECT t.node, t.parent, t.r, coalesce(sum(k.i), 0)::BIGINT AS i FROM tree t LEFT JOIN k2 k ON k.parent = t.node WHERE t.level = 1 GROUP BY ALL),
  d1 AS (SELECT node, parent, 1 AS level, r, i, r * i AS drop FROM k1),
  d2 AS (SELECT k.node, k.parent, 2 AS level, k.r, k.i, d.drop + k.r * k.i AS drop FROM k2 k JOIN d1 d ON d.node = k.parent),
  d3 AS (SELECT k.node, k.parent, 3 AS level, k.r, k.i, d.drop + k.r * k.i AS drop FROM k3 k JOIN d2 d ON d.node = k.parent),
  solved AS (SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d3)"""
)


def mesh(t: Tables) -> DataFrame:
    """u (supplier), v (part), g BIGINT: the summed quantity of a pair."""
    return t.lineitem.groupBy(_name("s", "l_suppkey").alias("u"), _name("p", "l_partkey").alias("v")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("g"))


MESH = "mesh AS (SELECT 's' || l_suppkey AS u, 'p' || l_partkey AS v, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS g FROM lineitem GROUP BY ALL)"


def thin(t: Tables) -> DataFrame:
    """Links of customers and clerks' days: u (customer), v (order day and status): small components while there are few orders, one large one and the rest when there are many."""
    day = F.concat(F.lit("d"), F.date_format("o_orderdate", "yyyyMMdd"), "o_orderstatus", (F.col("o_custkey") % 40).cast("string"))
    return t.orders.select(_name("c", "o_custkey").alias("u"), day.alias("v"), (1 + F.col("o_orderkey") % 9).alias("r"))


THIN = "thin AS (SELECT 'c' || o_custkey AS u, 'd' || strftime(o_orderdate, '%Y%m%d') || o_orderstatus || (o_custkey % 40) AS v, 1 + o_orderkey % 9 AS r FROM orders)"


def lattice(t: Tables) -> DataFrame:
    """node, x, y, layer, amps, drop of parts on a lattice, all whole numbers."""
    k = F.col("p_partkey")
    return t.part.select(
        k.alias("node"), (k % 50 * 1000).alias("x"), (F.expr("p_partkey div 50") * 1000).alias("y"), F.concat(F.lit("M"), 1 + F.col("p_size") % 5).alias("layer"),
        F.col("p_size").cast("bigint").alias("amps"), (k * 7919 % 1000).alias("drop"),
    )


LATTICE = """lattice AS (SELECT p_partkey AS node, p_partkey % 50 * 1000 AS x, p_partkey // 50 * 1000 AS y, 'M' || (1 + p_size % 5) AS layer,
  CAST(p_size AS BIGINT) AS amps, p_partkey * 7919 % 1000 AS drop FROM part)"""
