"""Graph operators over trade between nations and between customers and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodebook.operators import graph, resolve
from lodebook.sources.tables import read_table


def trade_calls(spark, sf) -> DataFrame:
    """Every order line as a call from the customer to the supplier, at its line number."""
    orders = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    lines = read_table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    return lines.join(orders, "l_orderkey")


def nation_pairs(spark, sf) -> DataFrame:
    """Distinct (caller, callee) nation names of the trade graph."""
    customers = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    suppliers = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    nations = read_table(spark, sf, "nation").select("n_nationkey", "n_name")
    # Pre-aggregated on the keys before names are looked up.
    keys = (
        trade_calls(spark, sf).select("o_custkey", "l_suppkey").distinct()
        .join(customers, "o_custkey").join(suppliers, "l_suppkey")
        .select("c_nationkey", "s_nationkey").distinct()
    )
    buyer = nations.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("caller"))
    seller = nations.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("callee"))
    return keys.join(buyer, "c_nationkey").join(seller, "s_nationkey").select("caller", "callee")


def call_adjacency(spark, sf):
    return nation_pairs(spark, sf)


def order_pairs(spark, sf) -> DataFrame:
    """A sparser graph: order priorities and statuses, brands and part types as names."""
    orders = read_table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("cust"), F.col("o_custkey").cast("string")).alias("caller"))
    lines = read_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", F.concat(F.lit("part"), F.col("l_partkey").cast("string")).alias("callee"))
    parts = read_table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
    first = lines.join(orders, "l_orderkey").select("caller", "callee").distinct()
    second = parts.select(F.concat(F.lit("part"), F.col("l_partkey").cast("string")).alias("caller"), F.col("p_brand").alias("callee"))
    third = parts.select(F.col("p_brand").alias("caller"), F.col("p_type").alias("callee")).distinct()
    return first.unionByName(second).unionByName(third)


def call_graph_depth2(spark, sf):
    """Customer -> parts -> brands -> types, around the customer with the smallest key."""
    start = read_table(spark, sf, "orders").agg(F.min("o_custkey").alias("k")).first().k
    return graph.neighbourhood(order_pairs(spark, sf), f"cust{start}", 2)


def lookup_skewed(spark, sf):
    """Every order line with the name of its supplier's nation, counted.

    Few nations share all lines, so at a low limit most of them count as hot and are cut.
    """
    suppliers = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    lines = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").join(suppliers, "l_suppkey")
    nations = read_table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    found = resolve.lookup_join(
        lines, nations, ["s_nationkey"], "l_orderkey", resolve.hot_keys(lines, ["s_nationkey"], rows=1000))
    return found.groupBy("n_name").agg(F.count(F.lit(1)).alias("lines"))


PAIRS = """
pairs AS (
  SELECT DISTINCT 'cust' || o_custkey AS caller, 'part' || l_partkey AS callee FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT 'part' || p_partkey, p_brand FROM part
  UNION ALL SELECT DISTINCT p_brand, p_type FROM part)"""

QUERIES = {
    "call_adjacency": (call_adjacency, """
SELECT DISTINCT a.n_name AS caller, b.n_name AS callee
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON s_nationkey = b.n_nationkey"""),
    "call_graph_depth2": (call_graph_depth2, f"""
WITH RECURSIVE {PAIRS}, start AS (SELECT 'cust' || min(o_custkey) AS name FROM orders),
reach AS (SELECT name, 0 AS distance FROM start
          UNION SELECT p.callee, r.distance + 1 FROM reach r JOIN pairs p ON p.caller = r.name WHERE r.distance < 2),
nearest AS (SELECT name, min(distance) AS distance FROM reach GROUP BY name)
SELECT p.caller, p.callee, n.distance FROM nearest n JOIN pairs p ON p.caller = n.name"""),
    "lookup_skewed_key": (lookup_skewed, """
SELECT n_name, count(*) AS lines FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1"""),
}
