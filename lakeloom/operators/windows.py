"""Window functions: ranking, neighbours, frames by rows, by interval and by peer groups, qualify."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.operators.star import money
from lakeloom.plans.registry import Registry
from lakeloom.sources.tables import table

registry = Registry()


@registry.query(
    "win_ranking",
    """
SELECT p_partkey, CAST(rank() OVER w AS BIGINT) AS rank, CAST(dense_rank() OVER w AS BIGINT) AS dense, round(percent_rank() OVER w, 6) AS share, round(cume_dist() OVER w, 6) AS cumulative,
  CAST(ntile(4) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS BIGINT) AS quarter
FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)
""",
)
def ranking(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy("p_size")
    return table(spark, d, "part").select(
        "p_partkey",
        F.rank().over(w).cast("long").alias("rank"),
        F.dense_rank().over(w).cast("long").alias("dense"),
        F.round(F.percent_rank().over(w), 6).alias("share"),
        F.round(F.cume_dist().over(w), 6).alias("cumulative"),
        F.ntile(4).over(Window.partitionBy("p_brand").orderBy("p_size", "p_partkey")).cast("long").alias("quarter"),
    )


@registry.query(
    "win_neighbours",
    """
SELECT event_id, lag(value) OVER w AS before, lead(value, 2) OVER w AS after, first_value(value) OVER w AS first, nth_value(value, 3) OVER w AS third,
  last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER w AS last_purchase
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""",
)
def neighbours(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    frame = w.rowsBetween(Window.unboundedPreceding, 0)
    purchase = F.when(F.col("event_type") == "purchase", F.col("value"))
    return table(spark, d, "events").select(
        "event_id",
        F.lag("value").over(w).alias("before"),
        F.lead("value", 2).over(w).alias("after"),
        F.first("value").over(frame).alias("first"),
        F.nth_value("value", 3).over(frame).alias("third"),
        F.last(purchase, ignorenulls=True).over(frame).alias("last_purchase"),
    )


@registry.query(
    "win_rows_frame",
    """
SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS DECIMAL(30,2)) AS near FROM orders
""",
)
def rows_frame(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 1)
    return table(spark, d, "orders").select("o_orderkey", F.sum(money("o_totalprice")).over(w).cast("decimal(30,2)").alias("near"))


@registry.query(
    "win_interval_frame",
    """
SELECT event_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS BIGINT) AS recent FROM events
""",
)
def interval_frame(spark: SparkSession, d: str) -> DataFrame:
    frame = "count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW)"
    return table(spark, d, "events").select("event_id", F.expr(frame).alias("recent"))


def over_peer_groups(df: DataFrame, by: list[str], order: str, before: int, after: int, value: Column, name: str) -> DataFrame:
    """sum of ``value`` over a frame of whole peer groups: GROUPS BETWEEN before PRECEDING AND after FOLLOWING.

    Peer groups are numbered by dense_rank; a range frame over these numbers is the same frame.
    """
    numbered = df.withColumn("_group", F.dense_rank().over(Window.partitionBy(*by).orderBy(order)))
    frame = Window.partitionBy(*by).orderBy("_group").rangeBetween(-before, after)
    return numbered.withColumn(name, F.sum(value).over(frame)).drop("_group")


@registry.query(
    "win_groups_frame",
    "SELECT p_partkey, CAST(sum(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS total FROM part",
)
def groups_frame(spark: SparkSession, d: str) -> DataFrame:
    return over_peer_groups(table(spark, d, "part"), ["p_brand"], "p_size", 1, 0, F.col("p_partkey"), "total").select("p_partkey", "total")


@registry.query(
    "win_exclude_current",
    "SELECT s_suppkey, CAST(sum(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW) AS BIGINT) AS others FROM supplier",
)
def exclude_current(spark: SparkSession, d: str) -> DataFrame:
    """A frame without the row itself: the whole less its own value, null where nothing is left."""
    w = Window.partitionBy("s_nationkey")
    rest = F.when(F.count(F.lit(1)).over(w) > 1, F.sum("s_suppkey").over(w) - F.col("s_suppkey"))
    return table(spark, d, "supplier").select("s_suppkey", rest.alias("others"))


@registry.query("win_qualify", "SELECT c_custkey, c_nationkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 2")
def qualify(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, d, "customer").withColumn("_n", F.row_number().over(w)).filter("_n <= 2").select("c_custkey", "c_nationkey")
