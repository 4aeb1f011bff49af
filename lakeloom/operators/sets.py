"""Sorting, limits, set operations, subqueries, recursion and sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.plans.registry import Registry
from lakeloom.sources.tables import table

registry = Registry()


def _keys(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers of pending orders and of urgent ones, once for each order."""
    orders = table(spark, d, "orders")
    return orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")), orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k"))


_A, _B = "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P'", "SELECT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'"


@registry.query("set_union_distinct", f"{_A} UNION {_B}")
def union_distinct(spark: SparkSession, d: str) -> DataFrame:
    a, b = _keys(spark, d)
    return a.union(b).distinct()


@registry.query("set_union_all", f"SELECT k, CAST(count(*) AS BIGINT) AS n FROM ({_A} UNION ALL {_B}) AS t GROUP BY 1")
def union_all(spark: SparkSession, d: str) -> DataFrame:
    a, b = _keys(spark, d)
    return a.unionAll(b).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@registry.query("set_intersect", f"{_A} INTERSECT {_B}")
def intersect(spark: SparkSession, d: str) -> DataFrame:
    a, b = _keys(spark, d)
    return a.intersect(b)


@registry.query("set_intersect_all", f"SELECT k, CAST(count(*) AS BIGINT) AS n FROM ({_A} INTERSECT ALL {_B}) AS t GROUP BY 1")
def intersect_all(spark: SparkSession, d: str) -> DataFrame:
    a, b = _keys(spark, d)
    return a.intersectAll(b).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@registry.query("set_except", f"{_B} EXCEPT {_A}")
def except_distinct(spark: SparkSession, d: str) -> DataFrame:
    a, b = _keys(spark, d)
    return b.subtract(a)


@registry.query("set_except_all", f"SELECT k, CAST(count(*) AS BIGINT) AS n FROM ({_A} EXCEPT ALL {_B}) AS t GROUP BY 1")
def except_all(spark: SparkSession, d: str) -> DataFrame:
    a, b = _keys(spark, d)
    return a.exceptAll(b).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@registry.query("set_drop_duplicates", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def drop_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").dropDuplicates(["c_mktsegment", "c_nationkey"]).select("c_mktsegment", "c_nationkey")


@registry.query("set_limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
def limit_offset(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(10).limit(20).select("o_orderkey")


@registry.query(
    "set_sort_nulls",
    "SELECT CAST(row_number() OVER (ORDER BY k DESC NULLS LAST, n_nationkey) AS BIGINT) AS place, n_nationkey FROM (SELECT n_nationkey, nullif(n_regionkey, 2) AS k FROM nation) AS t",
)
def sort_nulls(spark: SparkSession, d: str) -> DataFrame:
    """The place of each nation in an order with nulls last; a dimension of a fixed size."""
    from pyspark.sql import Window

    df = table(spark, d, "nation").withColumn("k", F.nullif(F.col("n_regionkey"), F.lit(2)))
    return df.select(F.row_number().over(Window.orderBy(F.desc_nulls_last("k"), "n_nationkey")).cast("long").alias("place"), "n_nationkey")


@registry.query("sub_scalar", "SELECT p_partkey FROM part p WHERE p_retailprice > (SELECT avg(q.p_retailprice) * 1.01 FROM part q WHERE q.p_brand = p.p_brand)")
def scalar_subquery(spark: SparkSession, d: str) -> DataFrame:
    """A correlated average, as a join with an aggregate."""
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice")
    mean = part.groupBy("p_brand").agg((F.avg("p_retailprice") * 1.01).alias("least"))
    return part.join(mean, "p_brand").filter("p_retailprice > least").select("p_partkey")


@registry.query("sub_in", "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_discount >= 0.1 AND l_quantity >= 50)")
def in_subquery(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(
        "SELECT s_suppkey FROM {supplier} WHERE s_suppkey IN (SELECT l_suppkey FROM {lineitem} WHERE l_discount >= 0.1 AND l_quantity >= 50)",
        supplier=table(spark, d, "supplier"),
        lineitem=table(spark, d, "lineitem"),
    )


@registry.query(
    "cte_recursive",
    """
WITH RECURSIVE r(day, n) AS (SELECT DATE '2024-01-01', 1 UNION ALL SELECT CAST(day + INTERVAL 1 DAY AS DATE), n + 1 FROM r WHERE n < 30)
SELECT day, CAST(count(event_id) AS BIGINT) AS events FROM r LEFT JOIN events ON CAST(ts AS DATE) = day GROUP BY 1
""",
)
def recursive(spark: SparkSession, d: str) -> DataFrame:
    """A calendar by recursion, so days without events have a row."""
    return spark.sql(
        """
        WITH RECURSIVE r(day, n) AS (SELECT DATE '2024-01-01', 1 UNION ALL SELECT date_add(day, 1), n + 1 FROM r WHERE n < 30)
        SELECT day, count(event_id) AS events FROM r LEFT JOIN (SELECT event_id, to_date(ts) AS on_day FROM {events}) ON on_day = day GROUP BY day
        """,
        events=table(spark, d, "events"),
    )


@registry.query("sample_bernoulli")
def sample(spark: SparkSession, d: str) -> DataFrame:
    """A tenth of the line items with a seed; which rows depends on the engine."""
    return table(spark, d, "lineitem").sample(fraction=0.1, seed=7).select("l_orderkey", "l_linenumber")


@registry.query("sample_stratified")
def sample_by(spark: SparkSession, d: str) -> DataFrame:
    """Other fractions for each status."""
    return table(spark, d, "orders").sampleBy("o_orderstatus", {"F": 0.5, "P": 0.1}, seed=7).select("o_orderkey", "o_orderstatus")


@registry.query("sample_split", "SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT o_orderkey) AS BIGINT) AS orders, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders GROUP BY 1")
def random_split(spark: SparkSession, d: str) -> DataFrame:
    """Three parts of a half, three and two tenths: together every order once."""
    every = in_parts(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), [0.5, 0.3, 0.2])
    return every.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderkey").alias("orders"), F.sum("o_orderkey").alias("total"))


def in_parts(df: DataFrame, shares: list[float]) -> DataFrame:
    """The rows with the number of the part that they fall in."""
    parts = [p.withColumn("part", F.lit(i)) for i, p in enumerate(df.randomSplit(shares, seed=7))]
    return reduce(DataFrame.union, parts)
