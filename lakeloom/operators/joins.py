"""Joins: every kind, points in ranges, lateral, and a salted join for hot keys (``intervals`` has overlaps and as-of joins)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.plans.registry import Registry
from lakeloom.sources.tables import table

registry = Registry()


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float, parts: int = 8) -> DataFrame:
    """Points with the half-open ranges [low, high) that hold them, by an equality on cells, so many to a ``width``.

    A range is repeated for each cell that it touches; with ranges about as wide as ``width`` that is once more
    than ``parts``, where a plain inequality would compare every point with every range. Nearly all pairs of
    a cell are results. Sides are merged by cell, so rows come out range by range, and the ranges of a cell with
    nearly the same points in the same order: such rows take little room where they are written.
    """
    cell = width / parts
    p = points.withColumn("_cell", F.floor(F.col(at) / cell))
    last = F.floor(F.col(high) / cell)
    r = ranges.filter(F.col(low) < F.col(high)).withColumn("_cell", F.explode(F.sequence(F.floor(F.col(low) / cell), last)))
    both = r.hint("merge").join(p, "_cell").filter((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high)))
    return both.select(*points.columns, *ranges.columns)


def salted_join(large: DataFrame, small: DataFrame, keys: list[str], hot: DataFrame, salts: int = 16) -> DataFrame:
    """An inner join whose hot keys are split: large rows get a salt, small rows of hot keys one of each.

    ``hot`` lists the keys that hold more than their share; other keys have salt 0 only.
    """
    hot = hot.select(*keys).distinct().withColumn("_hot", F.lit(True))
    n = F.when(F.col("_hot"), F.lit(salts)).otherwise(F.lit(1))
    a = large.join(hot, keys, "left").withColumn("_salt", F.pmod(F.monotonically_increasing_id(), n).cast("int"))
    b = small.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), n - 1)))
    return a.drop("_hot").join(b.drop("_hot"), [*keys, "_salt"]).drop("_salt")


_JOINS = {
    "inner": "JOIN",
    "left_outer": "LEFT JOIN",
    "right_outer": "RIGHT JOIN",
    "full_outer": "FULL JOIN",
}


_PENDING = "SELECT o_custkey AS a_key, CAST(count(*) AS BIGINT) AS pending FROM orders WHERE o_orderstatus = 'P' GROUP BY 1"
_URGENT = "SELECT o_custkey AS b_key, CAST(count(*) AS BIGINT) AS urgent FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1"


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers' pending and urgent orders; some customers have none of one kind."""
    orders = table(spark, d, "orders")
    a = orders.filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("a_key")).agg(F.count(F.lit(1)).alias("pending"))
    b = orders.filter("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("b_key")).agg(F.count(F.lit(1)).alias("urgent"))
    return a, b


def _register(how: str, sql: str) -> None:
    @registry.query(f"join_{how}", f"SELECT a_key, pending, b_key, urgent FROM ({_PENDING}) AS a {sql} ({_URGENT}) AS b ON a_key = b_key")
    def join(spark: SparkSession, d: str) -> DataFrame:
        a, b = _sides(spark, d)
        return a.join(b, F.col("a_key") == F.col("b_key"), how)


#: Physical strategies that a hint asks for; without one Catalyst chooses by measured sizes.
HINTS = {"broadcast_hash": "broadcast", "sort_merge": "merge", "shuffled_hash": "shuffle_hash"}


def _register_hint(name: str, hint: str) -> None:
    @registry.query(f"join_{name}", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
    def join(spark: SparkSession, d: str) -> DataFrame:
        nation = table(spark, d, "nation").select("n_nationkey", "n_name").hint(hint)  # a table of a fixed size
        return table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")


for _name, _hint in HINTS.items():
    _register_hint(_name, _hint)


@registry.query(
    "join_theta",
    "SELECT r_regionkey, CAST(count(*) AS BIGINT) AS n FROM customer JOIN region ON c_acctbal >= r_regionkey * 2000 - 1000 AND c_nationkey <> r_regionkey GROUP BY 1",
)
def theta(spark: SparkSession, d: str) -> DataFrame:
    """An inequality alone: a nested loop against a dimension of a fixed size, counted before it is shuffled."""
    region = F.broadcast(table(spark, d, "region").select("r_regionkey"))  # five rows
    on = (F.col("c_acctbal") >= F.col("r_regionkey") * 2000 - 1000) & (F.col("c_nationkey") != F.col("r_regionkey"))
    return table(spark, d, "customer").select("c_acctbal", "c_nationkey").join(region, on).groupBy("r_regionkey").agg(F.count(F.lit(1)).alias("n"))


for _how, _sql in _JOINS.items():
    _register(_how, _sql)


@registry.query("join_left_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def semi(spark: SparkSession, d: str) -> DataFrame:
    big = table(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(big, "c_custkey", "left_semi")


@registry.query("join_left_anti", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def anti(spark: SparkSession, d: str) -> DataFrame:
    many = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").select("p_partkey").join(many, "p_partkey", "left_anti")


@registry.query("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def cross(spark: SparkSession, d: str) -> DataFrame:
    """Two dimensions of a fixed size."""
    return table(spark, d, "region").select("r_name").crossJoin(table(spark, d, "nation").select("n_name"))


@registry.query(
    "join_range",
    """
SELECT o_orderkey, p_partkey FROM orders JOIN (SELECT p_partkey, p_retailprice * 100 AS low, p_retailprice * 100 + 50 AS high FROM part) AS p
ON o_totalprice >= low AND o_totalprice < high
""",
)
def price_bands(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose price lies in a band of a part's."""
    bands = table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") * 100).alias("low"), (F.col("p_retailprice") * 100 + 50).alias("high"))
    return range_join(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), bands, "o_totalprice", "low", "high", 50.0).select("o_orderkey", "p_partkey")


@registry.query(
    "join_lateral",
    """
SELECT c_custkey, o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) AS t
""",
)
def lateral(spark: SparkSession, d: str) -> DataFrame:
    """The two largest orders of each customer, as a correlated subquery.

    The subquery gives out what it sorts by: Spark keeps the order of a correlated limit only if the sort is right below it.
    """
    return spark.sql(
        "SELECT c_custkey, o_orderkey FROM {customer}, LATERAL (SELECT o_totalprice, o_orderkey FROM {orders} WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2)",
        customer=table(spark, d, "customer"),
        orders=table(spark, d, "orders"),
    )


@registry.query("join_salted", "SELECT user_id, CAST(count(*) AS BIGINT) AS pairs, CAST(sum(e.event_id) AS BIGINT) AS total FROM events e JOIN (SELECT DISTINCT user_id, event_type FROM events) u USING (user_id) GROUP BY 1")
def salted(spark: SparkSession, d: str) -> DataFrame:
    """Keys of over a hundredth of the rows are hot; they are counted first, and there are under a hundred."""
    df = table(spark, d, "events").select("user_id", "event_type", "event_id")
    counts = df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("all"))
    hot = counts.join(F.broadcast(total), F.col("n") * 100 > F.col("all"))  # one row
    joined = salted_join(df.select("user_id", "event_id"), df.select("user_id", "event_type").distinct(), ["user_id"], hot)
    return joined.groupBy("user_id").agg(F.count(F.lit(1)).alias("pairs"), F.sum("event_id").alias("total"))


@registry.query(
    "join_null_safe",
    "SELECT a.k AS k, CAST(count(*) AS BIGINT) AS n FROM (SELECT nullif(user_id % 5, 0) AS k FROM events) AS a JOIN (SELECT nullif(r_regionkey, 0) AS k FROM region) AS b ON a.k IS NOT DISTINCT FROM b.k GROUP BY 1",
)
def null_safe(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "events").select(F.nullif(F.col("user_id") % 5, F.lit(0)).alias("k"))
    b = table(spark, d, "region").select(F.nullif(F.col("r_regionkey"), F.lit(0)).alias("kb"))
    return a.join(b, F.col("k").eqNullSafe(F.col("kb"))).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@registry.query(
    "join_self",
    "SELECT a.o_orderkey AS first, b.o_orderkey AS second FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderdate = b.o_orderdate AND a.o_orderkey < b.o_orderkey",
)
def self_join(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders of one day; both keys are equalities, so pairs stay few."""
    df = table(spark, d, "orders")
    a = df.select(F.col("o_orderkey").alias("first"), "o_custkey", "o_orderdate")
    b = df.select(F.col("o_orderkey").alias("second"), "o_custkey", "o_orderdate")
    return a.join(b, ["o_custkey", "o_orderdate"]).filter("first < second").select("first", "second")
