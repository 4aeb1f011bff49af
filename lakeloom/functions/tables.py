"""User functions for what no expression covers: Arrow scalar, grouped aggregate, table function, whole batches.

They get and give Arrow batches, never single rows, and are kept out of queries that built-in
functions can express.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.plans.registry import Registry
from lakeloom.sources.tables import table

registry = Registry()


@F.arrow_udf(T.StringType())
def title_case(names: pa.Array) -> pa.Array:
    return pc.utf8_title(names)


@F.pandas_udf(T.DoubleType())
def trimmed_mean(values: pd.Series) -> float:
    """The mean without the least and the greatest value."""
    return float((values.sum() - values.min() - values.max()) / (len(values) - 2)) if len(values) > 2 else float(values.mean())


@F.udtf(returnType=T.StructType([T.StructField("word", T.StringType()), T.StructField("place", T.IntegerType())]))
class Words:
    def eval(self, text: str):
        for i, w in enumerate((text or "").split(" ")):
            yield w, i


@registry.query("udf_arrow_scalar", "SELECT c_custkey, upper(substr(lower(c_mktsegment), 1, 1)) || substr(lower(c_mktsegment), 2) AS segment FROM customer")
def arrow_scalar(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", title_case(F.lower("c_mktsegment")).alias("segment"))


@registry.query(
    "udf_grouped_aggregate",
    "SELECT c_nationkey, round(CASE WHEN count(*) > 2 THEN (sum(c_acctbal) - min(c_acctbal) - max(c_acctbal)) / (count(*) - 2) ELSE avg(c_acctbal) END, 4) AS mean FROM customer GROUP BY 1",
)
def grouped_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.round(trimmed_mean("c_acctbal"), 4).alias("mean"))


@registry.query("udf_table_function", "SELECT item_id, w[i] AS word, CAST(i - 1 AS INTEGER) AS place FROM (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark) AS a) AS b")
def table_function(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").lateralJoin(Words(F.col("text").outer())).select("item_id", "word", "place")


@registry.query("udf_map_batches", "SELECT vec_id, label, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings")
def map_batches(spark: SparkSession, d: str) -> DataFrame:
    """Whole Arrow batches: sums of vectors without a Python object for a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column("embedding")
            flat = pc.cast(vectors.flatten(), pa.float64())
            parents = pc.list_parent_indices(vectors)
            sums = pa.table({"p": parents, "x": flat}).group_by("p").aggregate([("x", "sum")]).sort_by("p")
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), sums.column("x_sum").combine_chunks()], names=["vec_id", "label", "total"])

    df = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    return df.mapInArrow(run, "vec_id long, label int, total double").withColumn("total", F.round("total", 4))


@F.arrow_udtf(returnType="word string, size int")
class Sized:
    """Words of the texts of a table's only column and their lengths, a batch at a time."""

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        words = pc.list_flatten(pc.utf8_split_whitespace(rows.column(0)))
        yield pa.table({"word": words, "size": pc.cast(pc.utf8_length(words), pa.int32())})


@registry.query("udf_arrow_table", "SELECT r_name AS word, CAST(length(r_name) AS INTEGER) AS size FROM (SELECT unnest(string_split(r_name, ' ')) AS r_name FROM region) AS t")
def arrow_table(spark: SparkSession, d: str) -> DataFrame:
    return Sized(table(spark, d, "region").select("r_name").asTable())


@registry.query("udf_pandas_batches", "SELECT o_orderkey, o_totalprice / 2 AS half FROM orders WHERE o_totalprice > 100000")
def pandas_batches(spark: SparkSession, d: str) -> DataFrame:
    """Whole pandas batches, of which any number of rows may come back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            dear = b[b["o_totalprice"] > 100_000]
            yield pd.DataFrame({"o_orderkey": dear["o_orderkey"], "half": dear["o_totalprice"] / 2})

    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").mapInPandas(run, "o_orderkey long, half double")
