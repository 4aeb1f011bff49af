"""JSON payloads of API sources: field extraction, flattening of nested records, quarantine of bad ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.plans.registry import Registry
from lakeloom.sources.tables import table

registry = Registry()

RECORD = "id BIGINT, items ARRAY<STRUCT<name: STRING, value: BIGINT>>"


@registry.query("a1_json_field", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark: SparkSession, d: str) -> DataFrame:
    """A1: one field by path; the parser stops once it has it."""
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@registry.query(
    "a1_json_by_type",
    "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total, CAST(max(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS largest FROM events GROUP BY 1",
)
def json_by_type(spark: SparkSession, d: str) -> DataFrame:
    """A1: a typed record by schema; the parser reads only the fields that are used."""
    df = table(spark, d, "events").select("event_type", F.from_json("props", "k BIGINT").alias("p"))
    return df.groupBy("event_type").agg(F.sum("p.k").alias("total"), F.max("p.k").alias("largest"))


def nested(df: DataFrame) -> DataFrame:
    """Payloads with a nested list, made from events, as an API would send them."""
    k = F.get_json_object("props", "$.k").cast("long")
    items = F.array(F.struct(F.col("event_type").alias("name"), k.alias("value")), F.struct(F.lit("user").alias("name"), F.col("user_id").alias("value")))
    return df.select(F.to_json(F.struct(F.col("event_id").alias("id"), items.alias("items"))).alias("payload"))


@registry.query(
    "a2_flattened",
    """
SELECT event_id AS id, event_type AS name, CAST(json_extract(props, '$.k') AS BIGINT) AS value FROM events
UNION ALL SELECT event_id, 'user', user_id FROM events
""",
)
def flattened(spark: SparkSession, d: str) -> DataFrame:
    """A2: one row for each entry of a nested list, by schema."""
    df = nested(table(spark, d, "events")).select(F.from_json("payload", RECORD).alias("r"))
    return df.select("r.id", F.inline("r.items"))


def quarantined(df: DataFrame, column: str) -> DataFrame:
    """All rows with ``is_valid``; a payload that is no JSON keeps its text, for a later repair."""
    parsed: Column = F.try_parse_json(column)
    return df.withColumn("is_valid", F.col(column).isNotNull() & parsed.isNotNull())


@registry.query(
    "a3_quarantine",
    """
SELECT CASE WHEN event_id % 7 = 0 THEN FALSE ELSE TRUE END AS is_valid, CAST(count(*) AS BIGINT) AS n, CAST(min(event_id) AS BIGINT) AS first FROM events GROUP BY 1
""",
)
def quarantine(spark: SparkSession, d: str) -> DataFrame:
    """A3: every seventh payload loses its end, and just these are told apart."""
    cut = F.when(F.col("event_id") % 7 == 0, F.expr("substring(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    df = quarantined(table(spark, d, "events").select("event_id", cut.alias("payload")), "payload")
    return df.groupBy("is_valid").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))


@registry.query("a4_variant", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) + 1 AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50")
def variant(spark: SparkSession, d: str) -> DataFrame:
    """Payloads kept as VARIANT and read by path."""
    df = table(spark, d, "events").select("event_id", F.parse_json("props").alias("v"))
    k = F.variant_get("v", "$.k", "bigint")
    return df.filter(k > 50).select("event_id", (k + 1).alias("k"))
