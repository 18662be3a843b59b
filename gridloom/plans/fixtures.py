"""Fields, graphs and tables derived from the driver's tables; the inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same fixtures for SQL, as common table expressions.
GRID_SQL = "grid AS (SELECT CAST(l_partkey % 16 AS INT) AS x, CAST(l_suppkey % 16 AS INT) AS y, CAST(l_linenumber - 1 AS INT) AS z, sum(l_quantity) / 8 AS v, count(*) AS n FROM lineitem GROUP BY 1, 2, 3)"
GRID2_SQL = "grid2 AS (SELECT CAST(l_partkey % 16 AS INT) AS x, CAST(l_suppkey % 16 AS INT) AS y, CAST(l_linenumber - 1 AS INT) AS z, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / 8 AS v FROM lineitem GROUP BY 1, 2, 3)"
VEC_SQL = "vec AS (SELECT CAST(l_partkey % 16 AS INT) AS x, CAST(l_suppkey % 16 AS INT) AS y, CAST(l_linenumber - 1 AS INT) AS z, sum(l_quantity) AS u0, CAST(sum(l_linenumber) AS DOUBLE) AS u1, CAST(count(*) AS DOUBLE) AS u2 FROM lineitem GROUP BY 1, 2, 3)"
ENSEMBLE_SQL = "ensemble AS (SELECT c_nationkey AS member, year(o_orderdate) AS time, o_orderpriority AS field, o_totalprice AS value FROM orders JOIN customer ON o_custkey = c_custkey)"
EDGES_SQL = "edges AS (SELECT DISTINCT 'c' || o_custkey AS src, 's' || l_suppkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cells():
    return (F.col("l_partkey") % 16).cast("int").alias("x"), (F.col("l_suppkey") % 16).cast("int").alias("y"), (F.col("l_linenumber") - 1).cast("int").alias("z")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar field (x, y, z, v, n), v in units of eight."""
    return table(spark, sf_dir, "lineitem").groupBy(*_cells()).agg((F.sum("l_quantity") / 8).alias("v"), F.count("*").alias("n"))


def grid2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second scalar field on the same cells (x, y, z, v)."""
    return table(spark, sf_dir, "lineitem").groupBy(*_cells()).agg((F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)) / 8).alias("v"))


def vecfield(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector field (x, y, z, u0, u1, u2)."""
    return table(spark, sf_dir, "lineitem").groupBy(*_cells()).agg(F.sum("l_quantity").alias("u0"), F.sum("l_linenumber").cast("double").alias("u1"), F.count("*").cast("double").alias("u2"))


def ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ensemble values (member, time, field, value)."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
    return joined.select(F.col("c_nationkey").alias("member"), F.year("o_orderdate").alias("time"), F.col("o_orderpriority").alias("field"), F.col("o_totalprice").alias("value"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph edges (src, dst): all distinct pairs of a customer and a supplier of one of its orders."""
    orders, lineitem = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    joined = orders.join(lineitem, orders.o_orderkey == lineitem.l_orderkey)
    pairs = joined.select("o_custkey", "l_suppkey").distinct()  # numbers, named afterwards: shorter rows to tell apart
    return pairs.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time series (user_id, event_type, ts, value)."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", "value")
