"""Exact token counts of documents as a histogram of encoded lengths.

Documents are encoded whole; only (length, count) pairs are shuffled, after partial counts. From
the histogram, suffix sums give for every context limit L: documents and tokens longer than L,
and the tokens that remain when every document is cut at L. Quantiles come from the same sums.

Defined results: a null or empty text has length 0; repeated rows count each time; an empty table
gives an empty histogram.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import in_worker, keeps, small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern by which this public vocabulary splits a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPAN = 64  # lengths of one bucket of the two-level suffix sums

_encoders: dict[tuple[str, str], object] = {}
keeps("lengths", _encoders.clear)


def encoder(vocabulary: str = VOCABULARY, pattern: str = PATTERN):
    """The encoding of a rank file, loaded once in each worker."""
    in_worker("lengths")
    key = (vocabulary, pattern)
    if key not in _encoders:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        _encoders[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def token_lengths(df: DataFrame, column: str = "text", by: list[str] = (), vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """One row for each document: its ``by`` columns and n_tokens long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, pattern).encode_ordinary
        for b in batches:
            lengths = [0 if t is None else len(encode(t)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(lengths, pa.int64())], names=[*(f"b{i}" for i in range(len(by))), "n_tokens"])

    small_batches(df.sparkSession)
    kinds = [f"b{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(by)]
    inner = df.select(df[column].cast("string").alias("t"), *(df[c].alias(f"b{i}") for i, c in enumerate(by)))
    out = inner.mapInArrow(run, ", ".join([*kinds, "n_tokens long"]))
    return out.select(*(F.col(f"b{i}").alias(c) for i, c in enumerate(by)), "n_tokens")


def histogram(lengths: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by..., n_tokens, n_docs): counted in each task before the shuffle."""
    return lengths.groupBy(*by, "n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def limits(hist: DataFrame, by: list[str] = ()) -> DataFrame:
    """For each length L that occurs, taken as a context limit, the answers of the suffix sums.

    docs_total, tokens_total; docs_longer, tokens_longer (of documents longer than L);
    tokens_cut (total when every document is cut at L); share_within (documents of at most L
    tokens over all: L is the q-quantile for the smallest L with share_within >= q).

    Sums run over buckets of 64 lengths first, then within a bucket, so no task sees more
    than one bucket's lengths or one row for each bucket.
    """
    by = list(by)
    bucket = F.floor(F.col("n_tokens") / SPAN)
    hist = hist.withColumn("_bucket", bucket).withColumn("_tokens", F.col("n_tokens") * F.col("n_docs"))
    rows = hist.groupBy(*by, "_bucket").agg(F.sum("n_docs").alias("_d"), F.sum("_tokens").alias("_t"))
    after = Window.partitionBy(*by).orderBy(F.desc("_bucket"))
    above = after.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*by)
    zero = F.lit(0).cast("long")
    rows = rows.select(
        *by,
        "_bucket",
        F.coalesce(F.sum("_d").over(above), zero).alias("_d_above"),
        F.coalesce(F.sum("_t").over(above), zero).alias("_t_above"),
        F.sum("_d").over(every).alias("docs_total"),
        F.sum("_t").over(every).alias("tokens_total"),
    )
    names = {c: f"_r_{c}" for c in [*by, "_bucket"]}
    rows = rows.withColumnsRenamed(names)
    condition = F.lit(True)
    for c, r in names.items():
        condition = condition & F.col(c).eqNullSafe(F.col(r))
    joined = hist.join(rows, condition).drop(*names.values())
    within = Window.partitionBy(*by, "_bucket").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    longer: Column = F.coalesce(F.sum("n_docs").over(within), zero) + F.col("_d_above")
    tokens: Column = F.coalesce(F.sum("_tokens").over(within), zero) + F.col("_t_above")
    out = joined.withColumn("docs_longer", longer).withColumn("tokens_longer", tokens)
    return out.select(
        *by,
        "n_tokens",
        "n_docs",
        "docs_total",
        "tokens_total",
        "docs_longer",
        "tokens_longer",
        (F.col("tokens_total") - F.col("tokens_longer") + F.col("docs_longer") * F.col("n_tokens")).alias("tokens_cut"),
        ((F.col("docs_total") - F.col("docs_longer")) / F.col("docs_total")).alias("share_within"),
    )


def quantile(answers: DataFrame, q: float) -> DataFrame:
    """The smallest length that at least a share q of the documents don't exceed."""
    return answers.filter(F.col("share_within") >= q).agg(F.min("n_tokens").alias("n_tokens"))


def at_limits(answers: DataFrame, context: list[int]) -> DataFrame:
    """The answers for any context limits, whether or not they occur as lengths: n_tokens (the limit),
    docs_longer, tokens_longer, tokens_cut and share_within.

    A limit has the suffix sums of the greatest length that doesn't exceed it, or, below all lengths, those of all
    documents. One aggregation finds them for all limits; without documents there is no row.
    """
    totals = F.max(F.struct("docs_total", "tokens_total"))
    found = [F.max(F.when(F.col("n_tokens") <= c, F.struct("n_tokens", "docs_longer", "tokens_longer"))) for c in context]
    every = answers.agg(totals.alias("all"), *(f.alias(f"at{i}") for i, f in enumerate(found))).filter(F.col("all").isNotNull())
    each = [
        F.struct(
            F.lit(c).cast("long").alias("n_tokens"),
            F.coalesce(f"at{i}.docs_longer", "all.docs_total").alias("docs_longer"),
            F.coalesce(f"at{i}.tokens_longer", "all.tokens_total").alias("tokens_longer"),
        )
        for i, c in enumerate(context)
    ]
    rows = every.select("all", F.explode(F.array(*each)).alias("r")).select("all", "r.*")
    return rows.select(
        "n_tokens",
        "docs_longer",
        "tokens_longer",
        (F.col("all.tokens_total") - F.col("tokens_longer") + F.col("docs_longer") * F.col("n_tokens")).alias("tokens_cut"),
        ((F.col("all.docs_total") - F.col("docs_longer")) / F.col("all.docs_total")).alias("share_within"),
    )


def at_limit(hist: DataFrame, limit: int) -> DataFrame:
    """The truncated total at one limit, straight from the histogram; ``at_limits`` answers from the suffix sums."""
    return hist.agg(F.coalesce(F.sum(F.least(F.col("n_tokens"), F.lit(limit)) * F.col("n_docs")), F.lit(0)).cast("long").alias("tokens_cut"))
