"""Analytical queries over the star schema: joins, grouping sets, top-k, pivot, time series, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.plans.registry import Registry
from lakeloom.sources.tables import table

registry = Registry()


def money(column: str) -> Column:
    """Prices are stored as doubles; sums of decimals don't depend on the order of rows."""
    return F.col(column).cast("decimal(12,2)")


@registry.query(
    "b1_star_revenue",
    """
SELECT r_name, CAST(year(o_orderdate) AS BIGINT) AS order_year,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DECIMAL(30,4)) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY 1, 2
""",
)
def star_revenue(spark: SparkSession, d: str) -> DataFrame:
    """B1: discounted revenue by customer region and order year.

    lineitem is reduced to one row for each order before it meets orders, and to one for each
    nation and year before it meets the small dimensions.
    """
    per_order = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(money("l_extendedprice") * (1 - F.col("l_discount").cast("decimal(4,2)"))).alias("revenue"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").cast("long").alias("order_year"))
    by_nation = (
        per_order.join(orders, per_order.l_orderkey == orders.o_orderkey)
        .join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", "order_year")
        .agg(F.sum("revenue").alias("revenue"))
    )
    return (
        by_nation.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy("r_name", "order_year")
        .agg(F.sum("revenue").cast("decimal(30,4)").alias("revenue"))
    )


_LEVELS = "CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DECIMAL(30,2)) AS sum_qty, CAST(count(*) AS BIGINT) AS n, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS level"


def _levels(grouped, level: bool = True) -> DataFrame:
    measures = [F.sum(money("l_quantity")).cast("decimal(30,2)").alias("sum_qty"), F.count(F.lit(1)).alias("n")]
    return grouped.agg(*measures, *([F.grouping_id().cast("long").alias("level")] if level else []))


@registry.query("b2_rollup", f"SELECT l_returnflag, l_linestatus, {_LEVELS} FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(spark: SparkSession, d: str) -> DataFrame:
    """B2: subtotals from right to left."""
    return _levels(table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus"))


@registry.query("b2_cube", f"SELECT l_returnflag, l_linestatus, {_LEVELS} FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark: SparkSession, d: str) -> DataFrame:
    """B2: every combination of subtotals."""
    return _levels(table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus"))


@registry.query("b2_grouping_sets", f"SELECT l_returnflag, l_linestatus, {_LEVELS} FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    """B2: chosen combinations."""
    df = table(spark, d, "lineitem")
    return _levels(df.groupingSets([[df.l_returnflag], [df.l_linestatus], []], df.l_returnflag, df.l_linestatus))


@registry.query(
    "b3_top_orders_per_customer",
    """
SELECT o_custkey, o_orderkey, CAST(o_totalprice AS DECIMAL(12,2)) AS price, CAST(rank AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) AS t
WHERE rank <= 3
""",
)
def top_orders(spark: SparkSession, d: str) -> DataFrame:
    """The three largest orders of each customer; the limit is pushed below the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    df = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return df.withColumn("rank", F.row_number().over(w)).filter("rank <= 3").select("o_custkey", "o_orderkey", money("o_totalprice").alias("price"), F.col("rank").cast("long").alias("rank"))


@registry.query("b3_top_suppliers", "SELECT s_suppkey, s_name, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 10")
def top_suppliers(spark: SparkSession, d: str) -> DataFrame:
    """Sort with a limit: TakeOrderedAndProject, ten rows from each task."""
    return table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(10)


STATUSES = ["F", "O", "P"]


@registry.query(
    "b4_pivot",
    "SELECT o_orderpriority, "
    + ", ".join(f"CAST(count(CASE WHEN o_orderstatus = '{s}' THEN 1 END) AS BIGINT) AS {s}" for s in STATUSES)
    + " FROM orders GROUP BY 1",
)
def pivot(spark: SparkSession, d: str) -> DataFrame:
    """One column for each listed value, so the values need no extra pass."""
    df = table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", STATUSES).agg(F.count(F.lit(1)))
    return df.select("o_orderpriority", *(F.coalesce(s, F.lit(0)).cast("long").alias(s) for s in STATUSES))


@registry.query(
    "b4_unpivot",
    """
SELECT p_partkey, measure, value FROM (
  SELECT p_partkey, 'size' AS measure, CAST(p_size AS DOUBLE) AS value FROM part
  UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part) AS t
""",
)
def unpivot(spark: SparkSession, d: str) -> DataFrame:
    """One row for each measure of a part."""
    df = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return df.unpivot(["p_partkey"], ["size", "price"], "measure", "value")


@registry.query(
    "b5_hourly_events",
    "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2",
)
def hourly_events(spark: SparkSession, d: str) -> DataFrame:
    """A count for each hour and type."""
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")
    return table(spark, d, "events").groupBy(hour, "event_type").agg(F.count(F.lit(1)).alias("n"))


@registry.query(
    "b5_moving_average",
    """
SELECT day, n, round(avg(n) OVER (ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS last_three FROM (
  SELECT CAST(ts AS DATE) AS day, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1) AS t
""",
)
def moving_average(spark: SparkSession, d: str) -> DataFrame:
    """A frame over daily totals; only one row for each day reaches the single window partition."""
    daily = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return daily.withColumn("last_three", F.round(F.avg("n").over(Window.orderBy("day").rowsBetween(-2, 0)), 6))


@registry.query(
    "b6_sessions",
    """
SELECT user_id, session, CAST(count(*) AS BIGINT) AS n, min(ts) AS begins, max(ts) AS ends FROM (
  SELECT user_id, ts, CAST(sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 30 MINUTE THEN 1 ELSE 0 END)
         OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session
  FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) AS a) AS b
GROUP BY 1, 2
""",
)
def sessions(spark: SparkSession, d: str) -> DataFrame:
    """Runs of a user's events with gaps of at most 30 minutes; one shuffle serves both windows and the aggregate."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    df = table(spark, d, "events").select("user_id", "ts", "event_id").withColumn("before", F.lag("ts").over(w))
    new = F.when(F.col("before").isNull() | (F.col("ts") - F.col("before") > F.expr("INTERVAL 30 MINUTES")), 1).otherwise(0)
    df = df.withColumn("session", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("begins"), F.max("ts").alias("ends"))


FUNNEL = ["view", "click", "purchase"]


@registry.query(
    "b6_funnel",
    """
WITH a AS (SELECT user_id, min(ts) AS t1 FROM events WHERE event_type = 'view' GROUP BY 1),
b AS (SELECT e.user_id, min(ts) AS t2 FROM events e JOIN a ON a.user_id = e.user_id AND e.ts > t1 WHERE event_type = 'click' GROUP BY 1),
c AS (SELECT e.user_id, min(ts) AS t3 FROM events e JOIN b ON b.user_id = e.user_id AND e.ts > t2 WHERE event_type = 'purchase' GROUP BY 1)
SELECT 1 AS step, 'view' AS event_type, CAST(count(*) AS BIGINT) AS users FROM a
UNION ALL SELECT 2, 'click', CAST(count(*) AS BIGINT) FROM b UNION ALL SELECT 3, 'purchase', CAST(count(*) AS BIGINT) FROM c
""",
)
def funnel(spark: SparkSession, d: str) -> DataFrame:
    """Users that reach each step after the one before; each step keeps one time for each user, in one shuffle."""
    df = table(spark, d, "events").filter(F.col("event_type").isin(FUNNEL)).select("user_id", "ts", "event_type")
    per_user = Window.partitionBy("user_id")
    reached = None
    for i, step in enumerate(FUNNEL):
        here = F.col("event_type") == step
        if i:
            here = here & (F.col("ts") > F.col(f"t{i}"))
        df = df.withColumn(f"t{i + 1}", F.min(F.when(here, F.col("ts"))).over(per_user))
        reached = f"t{i + 1}"
    users = df.groupBy("user_id").agg(*(F.max(f"t{i + 1}").alias(f"t{i + 1}") for i in range(len(FUNNEL))))
    counts = users.agg(*(F.count(f"t{i + 1}").alias(s) for i, s in enumerate(FUNNEL)))
    steps = counts.unpivot([], FUNNEL, "event_type", "users")
    order = F.array_position(F.array(*map(F.lit, FUNNEL)), F.col("event_type")).cast("int")
    return steps.select(order.alias("step"), "event_type", "users")
