"""Reports over document sources: counts, exact duplicates, shared passages, lines, unions with lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.plans.registry import Registry
from lakeloom.sources.tables import table

registry = Registry()


@registry.query(
    "d1_counts",
    "SELECT lang, source, CAST(count(*) AS BIGINT) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(max(n_chars) AS BIGINT) AS longest FROM documents GROUP BY 1, 2",
)
def counts(spark: SparkSession, d: str) -> DataFrame:
    """No text is read for it."""
    df = table(spark, d, "documents")
    return df.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))


@registry.query("d2_exact_duplicates", "SELECT md5(text) AS digest, CAST(count(*) AS BIGINT) AS copies, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Texts that occur again; digests are shuffled, not texts."""
    df = table(spark, d, "documents").select(F.md5("text").alias("digest"), "doc_id")
    return df.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first")).filter("copies > 1")


WORDS_SQL = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


@registry.query(
    "d4_benchmark_overlap",
    f"""
WITH b AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark), d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
bg AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS i FROM b) AS t),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d) AS t)
SELECT doc_id, item_id, CAST(count(*) AS BIGINT) AS shared FROM dg JOIN bg USING (g) GROUP BY 1, 2
""",
)
def benchmark_overlap(spark: SparkSession, d: str, n: int = 8) -> DataFrame:
    """Documents and benchmark items with a common run of eight words, compared by 64-bit hashes.

    Only hashes of runs leave the row they are made in. The benchmark's are few and may be broadcast
    by their measured size; then no document's runs are shuffled, only the matches.
    """

    def runs(name: str, key: str) -> DataFrame:
        df = table(spark, d, name).select(key, F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), 1).alias("_w"))
        starts = F.when(F.size("_w") >= n, F.sequence(F.lit(0), F.size("_w") - n)).otherwise(F.array().cast("array<int>"))
        each = F.array_distinct(F.transform(starts, lambda i: F.xxhash64(*(F.get("_w", i + k) for k in range(n)))))
        return df.select(key, F.explode(each).alias("g"))

    return runs("documents", "doc_id").join(runs("benchmark", "item_id"), "g").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("shared"))


@registry.query(
    "d5_repeated_lines",
    """
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(list_distinct(l)) AS BIGINT) AS n_distinct, len(list_distinct(l)) * 2 < len(l) AS mostly_repeated
FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) AS t
""",
)
def repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines and distinct lines of each document."""
    df = table(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    n, distinct = F.size("l").cast("long"), F.size(F.array_distinct("l")).cast("long")
    return df.select("doc_id", n.alias("n_lines"), distinct.alias("n_distinct"), (distinct * 2 < n).alias("mostly_repeated"))


@registry.query(
    "d5_length_filter",
    r"""
SELECT doc_id, CAST(n AS BIGINT) AS n_words, round(CAST(chars AS DOUBLE) / n, 6) AS mean_word FROM (
  SELECT doc_id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS chars FROM documents) AS t
WHERE n BETWEEN 50 AND 100000 AND chars BETWEEN 3 * n AND 10 * n
""",
)
def length_filter(spark: SparkSession, d: str) -> DataFrame:
    """Documents of a usual number and length of words; both are counted where the text is read."""
    n = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    chars = F.length(F.translate("text", " \t\n\x0b\x0c\r", ""))
    df = table(spark, d, "documents").select("doc_id", n.cast("long").alias("n_words"), chars.alias("chars"))
    df = df.filter(F.col("n_words").between(50, 100_000) & F.col("chars").between(3 * F.col("n_words"), 10 * F.col("n_words")))
    return df.select("doc_id", "n_words", F.round(F.col("chars").cast("double") / F.col("n_words"), 6).alias("mean_word"))


@registry.query(
    "d6_union_with_lineage",
    """
SELECT origin, lang, CAST(count(*) AS BIGINT) AS n, CAST(sum(chars) AS BIGINT) AS chars FROM (
  SELECT 'documents' AS origin, lang, CAST(length(text) AS BIGINT) AS chars FROM documents
  UNION ALL SELECT 'pages', NULL, CAST(length(html) AS BIGINT) FROM pages) AS t GROUP BY 1, 2
""",
)
def union_with_lineage(spark: SparkSession, d: str) -> DataFrame:
    """Several sources in one frame, by column name, with where each row comes from."""
    docs = table(spark, d, "documents").select(F.lit("documents").alias("origin"), "lang", F.length("text").cast("long").alias("chars"))
    pages = table(spark, d, "pages").select(F.lit("pages").alias("origin"), F.length("html").cast("long").alias("chars"))
    return docs.unionByName(pages, allowMissingColumns=True).groupBy("origin", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))
