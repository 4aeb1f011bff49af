"""Scalar function families as queries: strings, hashes, dates, numbers, arrays, maps, JSON, XML, URLs, vectors.

All are built-in expressions, so they stay in generated code next to the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.plans.registry import Registry
from lakeloom.sources.tables import table

registry = Registry()


@registry.query(
    "fn_strings",
    r"""
SELECT c_custkey, lower(c_name) AS lowered, upper(substr(c_name, 1, 4)) AS head, trim('  ' || c_mktsegment || ' ') AS trimmed, split_part(c_name, '#', 2) AS number,
  regexp_extract(c_name, '([0-9]+)', 1) AS digits, regexp_replace(c_mktsegment, '[AEIOU]', '-', 'g') AS replaced, translate(c_mktsegment, 'ABC', 'xyz') AS translated,
  CAST(levenshtein(c_mktsegment, 'BUILDING') AS BIGINT) AS distance, CAST(strpos(c_mktsegment, 'U') AS BIGINT) AS place, contains(c_mktsegment, 'HOLD') AS has,
  starts_with(c_mktsegment, 'A') AS starts, ends_with(c_mktsegment, 'E') AS ends, lpad(CAST(c_nationkey AS VARCHAR), 4, '0') AS padded, reverse(c_mktsegment) AS reversed,
  concat_ws('/', c_mktsegment, CAST(c_nationkey AS VARCHAR)) AS joined, CAST(length(c_name) AS BIGINT) AS size FROM customer
""",
)
def strings(spark: SparkSession, d: str) -> DataFrame:
    name, segment, nation = F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey").cast("string")
    return table(spark, d, "customer").select(
        "c_custkey",
        F.lower(name).alias("lowered"),
        F.upper(F.substring(name, 1, 4)).alias("head"),
        F.trim(F.concat(F.lit("  "), segment, F.lit(" "))).alias("trimmed"),
        F.split_part(name, F.lit("#"), F.lit(2)).alias("number"),
        F.regexp_extract(name, r"([0-9]+)", 1).alias("digits"),
        F.regexp_replace(segment, "[AEIOU]", "-").alias("replaced"),
        F.translate(segment, "ABC", "xyz").alias("translated"),
        F.levenshtein(segment, F.lit("BUILDING")).cast("long").alias("distance"),
        F.instr(segment, "U").cast("long").alias("place"),
        F.contains(segment, F.lit("HOLD")).alias("has"),
        F.startswith(segment, F.lit("A")).alias("starts"),
        F.endswith(segment, F.lit("E")).alias("ends"),
        F.lpad(nation, 4, "0").alias("padded"),
        F.reverse(segment).alias("reversed"),
        F.concat_ws("/", segment, nation).alias("joined"),
        F.length(name).cast("long").alias("size"),
    )


@registry.query("fn_patterns", "SELECT p_partkey FROM part WHERE p_name LIKE '%widget%' AND p_name NOT ILIKE 'SMALL%' AND regexp_matches(p_brand, '#[13]') AND p_size BETWEEN 5 AND 40 AND p_type IN ('ECONOMY', 'STANDARD')")
def patterns(spark: SparkSession, d: str) -> DataFrame:
    keep = F.col("p_name").like("%widget%") & ~F.col("p_name").ilike("SMALL%") & F.col("p_brand").rlike("#[13]") & F.col("p_size").between(5, 40) & F.col("p_type").isin("ECONOMY", "STANDARD")
    return table(spark, d, "part").filter(keep).select("p_partkey")


@registry.query("fn_hashes", "SELECT n_nationkey, md5(n_name) AS m, sha256(n_name) AS s, md5(n_name || '-' || CAST(n_regionkey AS VARCHAR)) AS row_key FROM nation")
def hashes(spark: SparkSession, d: str) -> DataFrame:
    row_key = F.md5(F.concat_ws("-", "n_name", F.col("n_regionkey").cast("string")))
    return table(spark, d, "nation").select("n_nationkey", F.md5("n_name").alias("m"), F.sha2("n_name", 256).alias("s"), row_key.alias("row_key"))


@registry.query(
    "fn_dates",
    """
SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(o_orderdate AS DATE) + 10 AS later, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS BIGINT) AS days,
  CAST(CAST(o_orderdate AS DATE) + INTERVAL 2 MONTH AS DATE) AS two_months, last_day(CAST(o_orderdate AS DATE)) AS month_end, strftime(o_orderdate, '%Y/%m/%d') AS written,
  CAST(year(o_orderdate) AS BIGINT) AS y, CAST(quarter(o_orderdate) AS BIGINT) AS q, CAST(dayofyear(o_orderdate) AS BIGINT) AS doy, CAST(weekofyear(o_orderdate) AS BIGINT) AS week,
  CAST(strptime('31.12.1999', '%d.%m.%Y') AS TIMESTAMP) AS parsed FROM orders
""",
)
def dates(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey",
        F.trunc(day, "month").alias("month"),
        F.date_add(day, 10).alias("later"),
        F.datediff(F.lit("2002-01-01").cast("date"), day).cast("long").alias("days"),
        F.add_months(day, 2).alias("two_months"),
        F.last_day(day).alias("month_end"),
        F.date_format("o_orderdate", "yyyy/MM/dd").alias("written"),
        F.year(day).cast("long").alias("y"),
        F.quarter(day).cast("long").alias("q"),
        F.dayofyear(day).cast("long").alias("doy"),
        F.weekofyear(day).cast("long").alias("week"),
        F.to_timestamp_ntz(F.lit("31.12.1999"), F.lit("dd.MM.yyyy")).alias("parsed"),
    )


@registry.query(
    "fn_numbers",
    """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice / 7, 2) AS seventh, CAST(floor(l_quantity / 3) AS BIGINT) AS f, CAST(ceil(l_quantity / 3) AS BIGINT) AS c, abs(l_discount - 0.05) AS a,
  CASE WHEN l_linenumber = 1 THEN NULL ELSE round(l_quantity / (l_linenumber - 1), 4) END AS safe, round(sqrt(l_quantity), 6) AS root, round(ln(l_quantity), 6) AS log, round(power(l_discount, 2), 6) AS squared,
  l_partkey % 7 AS remainder, greatest(l_tax, l_discount) AS larger, least(l_tax, l_discount) AS smaller, CAST(sign(l_discount - 0.05) AS DOUBLE) AS direction FROM lineitem
""",
)
def numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.round(F.col("l_extendedprice") / 7, 2).alias("seventh"),
        F.floor(F.col("l_quantity") / 3).alias("f"),
        F.ceil(F.col("l_quantity") / 3).alias("c"),
        F.abs(F.col("l_discount") - 0.05).alias("a"),
        F.round(F.try_divide("l_quantity", F.col("l_linenumber") - 1), 4).alias("safe"),
        F.round(F.sqrt("l_quantity"), 6).alias("root"),
        F.round(F.ln("l_quantity"), 6).alias("log"),
        F.round(F.pow("l_discount", F.lit(2)), 6).alias("squared"),
        (F.col("l_partkey") % 7).alias("remainder"),
        F.greatest("l_tax", "l_discount").alias("larger"),
        F.least("l_tax", "l_discount").alias("smaller"),
        F.signum(F.col("l_discount") - 0.05).alias("direction"),
    )


@registry.query("fn_width_bucket", "SELECT p_partkey, CAST(CASE WHEN p_retailprice < 900 THEN 0 WHEN p_retailprice >= 2000 THEN 12 ELSE floor((p_retailprice - 900) / 100) + 1 END AS BIGINT) AS bucket FROM part")
def width_bucket(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.width_bucket("p_retailprice", F.lit(900.0), F.lit(2000.0), F.lit(11)).cast("long").alias("bucket"))


@registry.query(
    "fn_nulls",
    "SELECT n_nationkey, coalesce(nullif(n_regionkey, 0), -1) AS filled, CASE WHEN nullif(n_regionkey, 0) IS NULL THEN 'none' ELSE 'some' END AS kind, nullif(n_regionkey, 0) IS NOT DISTINCT FROM NULL AS same FROM nation",
)
def nulls(spark: SparkSession, d: str) -> DataFrame:
    k = F.nullif(F.col("n_regionkey"), F.lit(0))
    return table(spark, d, "nation").select("n_nationkey", F.coalesce(k, F.lit(-1)).alias("filled"), F.nvl2(k, F.lit("some"), F.lit("none")).alias("kind"), k.eqNullSafe(F.lit(None)).alias("same"))


@registry.query("fn_casts", "SELECT event_id, TRY_CAST(split_part(event_type, 'c', 2) AS INTEGER) IS NULL AS no_number, CAST(value AS INTEGER) AS rounded, CAST(CAST(value AS DECIMAL(10,1)) AS VARCHAR) AS shown FROM (SELECT event_id, event_type, floor(value) AS value FROM events) AS t")
def casts(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "events").select("event_id", "event_type", F.floor("value").cast("double").alias("value"))
    return df.select(
        "event_id",
        F.split_part("event_type", F.lit("c"), F.lit(2)).try_cast("int").isNull().alias("no_number"),
        F.col("value").cast("int").alias("rounded"),
        F.col("value").cast("decimal(10,1)").cast("string").alias("shown"),
    )


@registry.query(
    "fn_arrays",
    """
SELECT doc_id, CAST(len(w) AS BIGINT) AS n, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct, list_sort(list_distinct(w[1:5])) AS head, list_contains(w, 'the') AS has, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS letters,
  CAST(len(list_filter(w, lambda x: length(x) > 8)) AS BIGINT) AS long_words, CAST(list_position(w, 'the') AS BIGINT) AS place
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents) AS t
""",
)
def arrays(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1).alias("w"))
    letters = F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    place = F.array_position("w", "the")
    return df.select(
        "doc_id",
        F.size("w").cast("long").alias("n"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        F.array_sort(F.array_distinct(F.slice("w", 1, 5))).alias("head"),
        F.array_contains("w", "the").alias("has"),
        letters.alias("letters"),
        F.size(F.filter("w", lambda x: F.length(x) > 8)).cast("long").alias("long_words"),
        F.when(place > 0, place).alias("place"),
    )


@registry.query(
    "fn_array_sets",
    """
SELECT c_nationkey, list_sort(list_distinct(list_intersect(a, b))) AS both, list_sort(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x)))) AS only_a FROM (
  SELECT c_nationkey, list(c_mktsegment) FILTER (WHERE c_acctbal > 5000) AS a, list(c_mktsegment) FILTER (WHERE c_acctbal < 0) AS b FROM customer GROUP BY 1) AS t
WHERE a IS NOT NULL AND b IS NOT NULL
""",
)
def array_sets(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "customer").groupBy("c_nationkey").agg(
        F.collect_set(F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment"))).alias("a"), F.collect_set(F.when(F.col("c_acctbal") < 0, F.col("c_mktsegment"))).alias("b")
    )
    df = df.filter((F.size("a") > 0) & (F.size("b") > 0))
    return df.select("c_nationkey", F.array_sort(F.array_intersect("a", "b")).alias("both"), F.array_sort(F.array_except("a", "b")).alias("only_a"))


@registry.query("fn_explode", "SELECT item_id, CAST(i AS BIGINT) AS place, w[i] AS word FROM (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark) AS a) AS b")
def explode(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("i", "word"))
    return df.select("item_id", (F.col("i") + 1).cast("long").alias("place"), "word")


@registry.query(
    "fn_maps",
    """
SELECT user_id, list_sort(list(event_type)) AS kinds, CAST(max(n) FILTER (WHERE event_type = 'click') AS BIGINT) AS clicks, CAST(sum(n) FILTER (WHERE n > 2) AS BIGINT) AS frequent
FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) AS t GROUP BY 1
""",
)
def maps(spark: SparkSession, d: str) -> DataFrame:
    """Counts by type as one map for each user."""
    counts = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    df = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    frequent = F.map_filter("m", lambda k, v: v > 2)
    total = F.aggregate(F.map_values(frequent), F.lit(0).cast("long"), lambda a, x: a + x)
    return df.select("user_id", F.array_sort(F.map_keys("m")).alias("kinds"), F.try_element_at("m", F.lit("click")).alias("clicks"), F.when(F.size(frequent) > 0, total).alias("frequent"))


@registry.query("fn_json", "SELECT n_nationkey, CAST(json_extract(j, '$.name') AS VARCHAR) AS name, CAST(json_extract(j, '$.region') AS BIGINT) AS region FROM (SELECT n_nationkey, json_object('name', n_nationkey + 1, 'region', n_regionkey) AS j FROM nation) AS t")
def json_values(spark: SparkSession, d: str) -> DataFrame:
    j = F.to_json(F.struct((F.col("n_nationkey") + 1).alias("name"), F.col("n_regionkey").alias("region")))
    df = table(spark, d, "nation").select("n_nationkey", j.alias("j"))
    return df.select("n_nationkey", F.json_tuple("j", "name", "region").alias("name", "region")).select("n_nationkey", "name", F.col("region").cast("long").alias("region"))


@registry.query(
    "fn_urls",
    r"""
SELECT page_id, lower(regexp_extract(url, '://([^/?#]+)', 1)) AS host, regexp_extract(url, '://[^/?#]+([^?#]*)', 1) AS path, nullif(regexp_extract(url, '\?([^#]*)', 1), '') AS query FROM pages
""",
)
def urls(spark: SparkSession, d: str) -> DataFrame:
    part = lambda name: F.parse_url("url", F.lit(name))
    return table(spark, d, "pages").select("page_id", F.lower(part("HOST")).alias("host"), part("PATH").alias("path"), part("QUERY").alias("query"))


@registry.query("fn_xml", "SELECT n_nationkey, n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation")
def xml_values(spark: SparkSession, d: str) -> DataFrame:
    """A record as XML text and back by path; the text must be well formed."""
    text = F.concat(F.lit("<n><name>"), "n_name", F.lit("</name><region>"), F.col("n_regionkey").cast("string"), F.lit("</region></n>"))
    df = table(spark, d, "nation").select("n_nationkey", text.alias("x"))
    return df.select("n_nationkey", F.xpath_string("x", F.lit("n/name/text()")).alias("name"), F.xpath_long("x", F.lit("n/region")).alias("region"))


@registry.query(
    "fn_vectors",
    """
SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 5) AS norm, round(list_max(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS largest, CAST(len(embedding) AS BIGINT) AS size FROM embeddings
""",
)
def vectors(spark: SparkSession, d: str) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return table(spark, d, "embeddings").select("vec_id", F.round(norm, 5).alias("norm"), F.round(F.array_max(v), 5).alias("largest"), F.size("embedding").cast("long").alias("size"))
