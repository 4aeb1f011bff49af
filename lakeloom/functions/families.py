"""More of each scalar function family as queries; built-in expressions like those of ``scalar``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.plans.registry import Registry
from lakeloom.sources.tables import table

registry = Registry()


@registry.query(
    "fn_strings_more",
    r"""
SELECT c_custkey, array_to_string(string_split(c_name, '#')[1:1], '#') AS before, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS titled,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'A351' WHEN 'BUILDING' THEN 'B435' WHEN 'FURNITURE' THEN 'F653' WHEN 'MACHINERY' THEN 'M256' WHEN 'HOUSEHOLD' THEN 'H243' END AS sound,
  CAST(CASE WHEN strpos(substr(c_mktsegment, 3), 'I') = 0 THEN 0 ELSE strpos(substr(c_mktsegment, 3), 'I') + 2 END AS BIGINT) AS place,
  substr(c_mktsegment, 1, 1) || '--' || substr(c_mktsegment, 4) AS laid, CAST(len(regexp_extract_all(c_mktsegment, '[AEIOU]')) AS BIGINT) AS vowels,
  [string_split(c_mktsegment, ' '), string_split(c_mktsegment, ' ')] AS spoken FROM customer
""",
)
def strings(spark: SparkSession, d: str) -> DataFrame:
    segment = F.col("c_mktsegment")
    return table(spark, d, "customer").select(
        "c_custkey",
        F.substring_index("c_name", "#", 1).alias("before"),
        F.initcap(segment).alias("titled"),
        F.soundex(segment).alias("sound"),
        F.locate("I", segment, 3).cast("long").alias("place"),
        F.overlay(segment, F.lit("--"), 2, 2).alias("laid"),
        F.regexp_count(segment, F.lit("[AEIOU]")).cast("long").alias("vowels"),
        F.sentences(F.concat(segment, F.lit(". "), segment, F.lit("."))).alias("spoken"),
    )


@registry.query("fn_hash_rows", "SELECT c_nationkey, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT c_name) AS BIGINT) AS names FROM customer GROUP BY 1")
def hash_rows(spark: SparkSession, d: str) -> DataFrame:
    """Murmur and xx hashes together tell all names of a nation apart."""
    df = table(spark, d, "customer").select("c_nationkey", F.struct(F.hash("c_name"), F.xxhash64("c_name")).alias("h"))
    return df.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("h").alias("names"))


@registry.query(
    "fn_dates_more",
    """
SELECT o_orderkey, CAST(date_diff('month', DATE '1995-01-01', CAST(date_trunc('month', o_orderdate) AS DATE)) AS DOUBLE) AS months,
  CAST(o_orderdate AS DATE) + CAST(8 - isodow(o_orderdate) AS INTEGER) AS monday, try_strptime(o_orderpriority, '%Y-%m-%d') IS NULL AS no_time,
  CAST(epoch(o_orderdate) AS BIGINT) AS seconds, CAST(make_date(CAST(year(o_orderdate) AS BIGINT), 12, 31) AS DATE) AS year_end FROM orders
""",
)
def dates(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey",
        F.months_between(F.trunc(day, "month"), F.lit("1995-01-01").cast("date")).alias("months"),
        F.next_day(day, "Mon").alias("monday"),
        F.try_to_timestamp("o_orderpriority", F.lit("yyyy-MM-dd")).isNull().alias("no_time"),
        (F.unix_date(day).cast("long") * 86_400 + F.hour("o_orderdate") * 3600 + F.minute("o_orderdate") * 60 + F.second("o_orderdate")).alias("seconds"),
        F.make_date(F.year(day), F.lit(12), F.lit(31)).alias("year_end"),
    )


@registry.query(
    "fn_numbers_more",
    "SELECT p_partkey, round_even(p_size / 2.0, 0) AS halved, round(exp(p_size / 50.0), 6) AS grown, round(cbrt(p_size), 6) AS root, CAST(p_size // 7 AS BIGINT) AS sevens, hex(p_size) AS hexed, round(atan2(p_size, 10.0), 6) AS angle FROM part",
)
def numbers(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, d, "part").select(
        "p_partkey",
        F.bround(size / 2, 0).alias("halved"),
        F.round(F.exp(size / 50), 6).alias("grown"),
        F.round(F.cbrt(size), 6).alias("root"),
        F.floor(size / 7).cast("long").alias("sevens"),
        F.hex(size).alias("hexed"),
        F.round(F.atan2(size, F.lit(10.0)), 6).alias("angle"),
    )


@registry.query(
    "fn_arrays_more",
    """
SELECT vec_id, list_bool_or(list_transform(e, lambda x: x > 1)) AS some_large, list_bool_and(list_transform(e, lambda x: x > -3)) AS none_low,
  list_sort(list_distinct(list_concat(bins[1:8], bins[5:16]))) AS joined, list_has_any(bins[1:8], bins[9:16]) AS shared, CAST(len(flatten([bins, bins])) AS BIGINT) AS doubled
FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 2) AS BIGINT)) AS bins FROM embeddings) AS t
""",
)
def arrays(spark: SparkSession, d: str) -> DataFrame:
    e = F.transform("embedding", lambda x: x.cast("double"))
    df = table(spark, d, "embeddings").select("vec_id", e.alias("e")).withColumn("bins", F.transform("e", lambda x: F.floor(x * 2)))
    part = lambda begin, size: F.slice("bins", begin, size)
    return df.select(
        "vec_id",
        F.exists("e", lambda x: x > 1).alias("some_large"),
        F.forall("e", lambda x: x > -3).alias("none_low"),
        F.array_sort(F.array_union(part(1, 8), part(5, 12))).alias("joined"),
        F.arrays_overlap(part(1, 8), part(9, 8)).alias("shared"),
        F.size(F.flatten(F.array("bins", "bins"))).cast("long").alias("doubled"),
    )


@registry.query("fn_explode_outer", "SELECT doc_id, word FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [NULL] ELSE w END) AS word FROM (SELECT doc_id, list_distinct(regexp_extract_all(text, '[0-9]{5,}')) AS w FROM documents) AS a) AS b")
def explode_outer(spark: SparkSession, d: str) -> DataFrame:
    """Long numbers of each document; a document without one keeps a row."""
    found = F.array_distinct(F.regexp_extract_all("text", F.lit("([0-9]{5,})"), 1))
    return table(spark, d, "documents").select("doc_id", F.explode_outer(found).alias("word"))


@registry.query(
    "fn_maps_more",
    "SELECT n_nationkey, list_sort(['key', lower(n_name), 'region']) AS keys, CAST(n_nationkey + n_regionkey + length(n_name) AS BIGINT) AS total, CAST(n_regionkey * 10 AS BIGINT) AS tens FROM nation",
)
def maps(spark: SparkSession, d: str) -> DataFrame:
    as_long = lambda c: F.col(c).cast("long")
    a = F.map_from_arrays(F.array(F.lit("KEY"), F.lit("REGION")), F.array(as_long("n_nationkey"), as_long("n_regionkey")))
    both = F.transform_keys(F.map_concat(a, F.create_map("n_name", F.length("n_name").cast("long"))), lambda k, v: F.lower(k))
    tens = F.transform_values(both, lambda k, v: v * 10)
    total = F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda s, x: s + x)
    df = table(spark, d, "nation").select("n_nationkey", both.alias("m"), tens.alias("t"))
    return df.select("n_nationkey", F.array_sort(F.map_keys("m")).alias("keys"), total.alias("total"), F.element_at("t", "region").alias("tens"))


@registry.query(
    "fn_json_more",
    """
SELECT event_type, 'OBJECT<k: ' || CASE json_type(props, '$.k') WHEN 'UBIGINT' THEN 'BIGINT' ELSE json_type(props, '$.k') END || '>' AS shape, json_keys(props) AS keys, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL
""",
)
def json_shapes(spark: SparkSession, d: str) -> DataFrame:
    """The type and the keys that JSON records have."""
    df = table(spark, d, "events").select("event_type", F.schema_of_variant(F.parse_json("props")).alias("shape"), F.json_object_keys("props").alias("keys"))
    return df.groupBy("event_type", "shape", "keys").agg(F.count(F.lit(1)).alias("n")).select("event_type", "shape", "keys", "n")


@registry.query("fn_xml_more", "SELECT n_nationkey, n_name AS name, CAST(n_regionkey AS BIGINT) AS region, n_name || ' & ' || CAST(n_regionkey AS VARCHAR) AS decoded, url_encode(n_name) AS encoded FROM nation")
def xml_records(spark: SparkSession, d: str) -> DataFrame:
    """XML text as a struct, and text through a URL; blanks are written %20."""
    text = F.concat(F.lit("<n><name>"), "n_name", F.lit("</name><region>"), F.col("n_regionkey").cast("string"), F.lit("</region></n>"))
    df = table(spark, d, "nation").select("*", F.from_xml(text, "name STRING, region BIGINT").alias("x"))
    there = F.concat(F.col("n_name"), F.lit(" & "), F.col("n_regionkey").cast("string"))
    return df.select("n_nationkey", "x.name", "x.region", F.url_decode(F.url_encode(there)).alias("decoded"), F.replace(F.url_encode("n_name"), F.lit("+"), F.lit("%20")).alias("encoded"))


@registry.query("fn_rename", "SELECT r_regionkey AS region, lower(r_name) AS name FROM region")
def rename(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "region").withColumnsRenamed({"r_regionkey": "region", "r_name": "name"}).withColumn("name", F.lower("name"))
