"""The ledgers that the standard tables hold, as edges, bids and labels, with the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(kind: str, *parts: str):
    """type:part:... identifiers; null if a part is null."""
    out = F.lit(kind)
    for p in parts:
        out = F.concat(out, F.lit(":"), F.col(p).cast("string"))
    return out


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges src, dst, edge_type, timestamp (days since 1970), amount."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate", "l_extendedprice")
    return orders.join(items, orders.o_orderkey == items.l_orderkey).select(
        key("acct", "o_custkey").alias("src"), key("acct", "l_partkey").alias("dst"), F.lit("pays").alias("edge_type"),
        F.datediff(F.to_date("l_shipdate"), F.lit("1970-01-01").cast("date")).cast("long").alias("timestamp"), F.col("l_extendedprice").alias("amount"),
    )


def bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bids tender, market, firm, buyer, year, amount, won; the lowest bid of a tender wins, ties by supplier, line and part."""
    from pyspark.sql import Window

    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    both = orders.join(items, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("amount", F.col("l_extendedprice") / F.col("l_quantity"))
    order = Window.partitionBy("o_orderkey").orderBy("amount", "l_suppkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return both.select(
        key("tender", "c_nationkey", "o_orderkey").alias("tender"), F.col("s_nationkey").alias("market"), key("firm", "s_nationkey", "s_suppkey").alias("firm"),
        key("buyer", "c_nationkey", "c_custkey").alias("buyer"), F.year("o_orderdate").alias("year"), "amount", (F.row_number().over(order) == 1).alias("won"),
    )


def account_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id and label: negative balance illicit, every fifth key unknown, else licit."""
    return table(spark, sf_dir, "customer").select(
        key("acct", "c_custkey").alias("node_id"),
        F.when(F.col("c_acctbal") < 0, "illicit").when(F.col("c_custkey") % 5 == 0, "unknown").otherwise("licit").alias("label"),
    )


PAYMENTS = """e AS (SELECT 'acct:' || o_custkey AS src, 'acct:' || l_partkey AS dst, 'pays' AS edge_type,
  date_diff('day', DATE '1970-01-01', l_shipdate::DATE) AS ts, l_extendedprice AS amount
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""
NODES = "n AS (SELECT node_id, min(ts) AS t FROM (SELECT src AS node_id, ts FROM e UNION ALL SELECT dst, ts FROM e) GROUP BY 1)"
BIDS = """b AS (SELECT 'tender:' || c_nationkey || ':' || o_orderkey AS tender, s_nationkey AS market, 'firm:' || s_nationkey || ':' || s_suppkey AS firm,
  'buyer:' || c_nationkey || ':' || c_custkey AS buyer, year(o_orderdate) AS year, l_extendedprice / l_quantity AS amount,
  row_number() OVER (PARTITION BY o_orderkey ORDER BY l_extendedprice / l_quantity, l_suppkey, l_linenumber, l_partkey, l_extendedprice) = 1 AS won
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey)"""
LABELS = "l AS (SELECT 'acct:' || c_custkey AS node_id, CASE WHEN c_acctbal < 0 THEN 'illicit' WHEN c_custkey % 5 = 0 THEN 'unknown' ELSE 'licit' END AS label FROM customer)"
