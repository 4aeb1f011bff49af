"""Keyed tables over plain files: latest row, upsert, delete, validity, changes, snapshots.

Files have no transaction log here: an upsert writes a new version beside the old one, and readers
choose a version. Concurrent writers are not coordinated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.operators.star import money
from lakeloom.plans.registry import Registry
from lakeloom.sources.tables import table

registry = Registry()


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """K1: the first row of each key by ``order``; ties need a unique column last in it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """K2: the base with every changed key's row replaced; ``changes`` has one row for each key.

    An anti join with the changes and a union: rows of the base are not sorted, and a small batch
    of changes is broadcast when its measured size allows.
    """
    return base.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def delete(base: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """K3: the base without the keys of another frame."""
    return base.join(gone.select(*keys).distinct(), keys, "left_anti")


def history(df: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """K4: from when to when each row was the current one of its key; the last is open."""
    w = Window.partitionBy(*keys).orderBy(at, tie)
    return df.withColumn("valid_from", F.col(at)).withColumn("valid_to", F.lead(at).over(w)).withColumn("is_current", F.col("valid_to").isNull())


ORDERS = ["o_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus"]


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(*ORDERS)


@registry.query(
    "k1_latest_order",
    """
SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) AS t WHERE r = 1
""",
)
def latest_order(spark: SparkSession, d: str) -> DataFrame:
    return latest(_orders(spark, d), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderdate")


@registry.query(
    "k2_upsert",
    """
SELECT o_orderkey, CASE WHEN o_orderdate >= TIMESTAMP '2001-01-01' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CAST(o_totalprice AS DECIMAL(12,2)) AS price FROM orders
""",
)
def upserted(spark: SparkSession, d: str) -> DataFrame:
    """Orders from 2001 on come again with another status."""
    base = _orders(spark, d).select("o_orderkey", "o_orderstatus", money("o_totalprice").alias("price"), "o_orderdate")
    late = base.filter("o_orderdate >= TIMESTAMP_NTZ '2001-01-01 00:00:00'").withColumn("o_orderstatus", F.lit("X"))
    return upsert(base, late, ["o_orderkey"]).select("o_orderkey", "o_orderstatus", "price")


@registry.query("k3_delete", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def deleted(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return delete(_orders(spark, d), gone, ["o_custkey"]).select("o_orderkey")


@registry.query(
    "k4_history",
    """
SELECT o_custkey, o_orderkey, o_orderdate AS valid_from, lead(o_orderdate) OVER w AS valid_to, lead(o_orderdate) OVER w IS NULL AS is_current
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
""",
)
def order_history(spark: SparkSession, d: str) -> DataFrame:
    return history(_orders(spark, d), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "valid_from", "valid_to", "is_current")


@registry.query("k5_changes_since", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '2000-06-30'")
def changes_since(spark: SparkSession, d: str) -> DataFrame:
    """K5: the filter reaches the scan, so files and row groups before the instant aren't read."""
    return _orders(spark, d).filter("o_orderdate > TIMESTAMP_NTZ '2000-06-30 00:00:00'").select("o_orderkey", "o_orderdate")


@registry.query(
    "k6_snapshot",
    """
SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r
FROM orders WHERE o_orderdate <= TIMESTAMP '1998-12-31') AS t WHERE r = 1
""",
)
def snapshot(spark: SparkSession, d: str) -> DataFrame:
    """K6: the current rows as of an instant."""
    before = _orders(spark, d).filter("o_orderdate <= TIMESTAMP_NTZ '1998-12-31 00:00:00'")
    return latest(before, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderdate")
