"""Near duplicates by MinHash: signatures, banding, exact verification (Broder, "On the resemblance and
containment of documents", 1997).

A document is the set of 64-bit hashes of its runs of five words. Documents of one set are joined first and
go on as one. Of every other set, 150 minimum hashes are cut into 30 bands of five; two sets that agree
in a band are candidates, and the share of sets of similarity 0.8 that agree in none is 7 in a million.
Candidates are linked only if their exact similarity reaches the threshold, so no result is approximate
but for pairs that no band brings together.

The first pass over the texts leaves digests and bands only; a second one makes the sets of those that share a
band with another. Pairs of them first compare counts of their hashes by bins, which bound what two sets can
share; sets travel for the pairs that this bound leaves.

A band's bucket is never expanded into all its pairs. In each round some of its sets, the pivots, are
compared with the others that no link connects with them yet: one pivot at first, then sixteen
times as many in each round, in the buckets that still hold unconnected sets. So a bucket of one
family costs as many comparisons as it has members, and every pair of unconnected members of a bucket is compared in the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators.graph import components
from lakeloom.operators.index import tokens
from lakeloom.plans.registry import Registry
from lakeloom.sources.formats import removed, stored
from lakeloom.sources.tables import table

registry = Registry()

WORDS, PERCENT = 5, 80
BANDS, ROWS = 30, 5
#: By how many times the pivots of a bucket grow with each round.
GROWTH = 16


def shingles(df: DataFrame, id: str, text: str, n: int) -> DataFrame:
    """id, n_shingles, shingles (distinct, in order) and two hashes of them; fewer than n words are one shingle."""
    words = df.select(F.col(id).alias("id"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("_w"))
    runs = F.transform(F.sequence(F.lit(0), F.size("_w") - n), lambda i: F.xxhash64(*(F.get("_w", i + k) for k in range(n))))
    every = F.when(F.size("_w") >= n, runs).when(F.size("_w") > 0, F.array(F.xxhash64("_w"))).otherwise(F.array().cast("array<bigint>"))
    sets = words.select("id", F.array_sort(F.array_distinct(every)).alias("shingles"))
    return sets.select("id", F.size("shingles").cast("long").alias("n_shingles"), "shingles", F.xxhash64("shingles").alias("a"), F.xxhash64(F.lit(1), "shingles").alias("b"))


def signed(sets: DataFrame, bands: int, rows: int) -> DataFrame:
    """The other columns of sets, and a key for each band in place of shingles; of no use for empty sets."""
    seeds = np.random.default_rng(7).integers(0, 2**63, size=(2, bands * rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    rest = [c for c in sets.columns if c != "shingles"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column(len(rest))
            offsets = np.asarray(lists.offsets)
            filled = offsets[1:] > offsets[:-1]
            starts = offsets[:-1][filled] - offsets[0]
            hashes = np.asarray(lists.flatten()).view(np.uint64)
            keys = np.zeros((len(starts), bands), dtype=np.uint64)
            for j in range(bands * rows if len(starts) else 0):
                x = hashes * seeds[0, j] + seeds[1, j]
                x ^= x >> np.uint64(31)
                least = np.minimum.reduceat(x, starts)
                at = keys[:, j // rows]
                at ^= least + np.uint64(j)
                at *= np.uint64(0x9E3779B97F4A7C15)
                at ^= at >> np.uint64(29)
            every = np.zeros((b.num_rows, bands), dtype=np.uint64)
            every[filled] = keys
            of_rows = pa.ListArray.from_arrays(np.arange(0, every.size + 1, bands, dtype=np.int32), pa.array(every.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], of_rows], names=[*rest, "keys"])

    kinds = [f"{c} {sets.schema[c].dataType.simpleString()}" for c in rest]
    return sets.select(*rest, "shingles").mapInArrow(run, ", ".join([*kinds, "keys array<long>"]))


def banded(sets: DataFrame, bands: int, rows: int) -> DataFrame:
    """rep, n_shingles and a key for each band."""
    return signed(sets.select("rep", "n_shingles", "shingles"), bands, rows).select(F.explode("keys").alias("k"), "rep", "n_shingles")


def counted(sets: DataFrame) -> DataFrame:
    """rep, shingles and counts: how many of the set's hashes fall into each bin, a byte a bin.

    Bins are a power of two, two to four hashes each on average; counts are empty where one doesn't fit a byte.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            offsets = np.asarray(lists.offsets) - lists.offsets[0].as_py()
            hashes = np.asarray(lists.flatten())
            out = []
            for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                bins = 1 << max((high - low + 3) // 4 - 1, 0).bit_length()
                n = np.bincount(hashes[low:high] & (bins - 1), minlength=bins)
                out.append(n.astype(np.uint8).tobytes() if n.max() < 256 else b"")
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(out, pa.binary())], names=["rep", "shingles", "counts"])

    return sets.select("rep", "shingles").mapInArrow(run, f"rep {sets.schema['rep'].dataType.simpleString()}, shingles array<long>, counts binary")


def likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) but for those whose counts by bins rule out a similarity of so many hundredths."""
    one = sets.select(F.col("rep").alias("a"), F.col("counts").alias("_one"))
    two = sets.select(F.col("rep").alias("b"), F.col("counts").alias("_two"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stay = []
            for x, y in zip(b.column(2), b.column(3)):
                few, many = sorted((np.frombuffer(v.as_buffer(), np.uint8).astype(np.int64) for v in (x, y)), key=len)
                # A bin of few is every len(few)-th one of many; two sets share at most the lesser count of a bin.
                most = int(np.minimum(few, many.reshape(-1, len(few)).sum(axis=0)).sum()) if len(few) else None
                stay.append(most is None or most * 100 >= percent * (int(few.sum()) + int(many.sum()) - most))
            yield b.select(["a", "b"]).filter(pa.array(stay, pa.bool_()))

    kinds = pairs.select("a", "b").schema
    return pairs.join(one, "a").join(two, "b").select("a", "b", "_one", "_two").mapInArrow(run, kinds)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of sets whose exact similarity is at least so many hundredths."""
    one = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("_one"))
    two = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("_two"))
    shared = F.size(F.array_intersect("_one", "_two"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", shared.alias("_o"), (F.size("_one") + F.size("_two")).alias("_n"))
    return both.filter(F.col("_o") * 100 >= percent * (F.col("_n") - F.col("_o"))).select("a", "b")


def pivots_of(live: DataFrame, many: int, turn: int) -> DataFrame:
    """k and pivot: at most so many sets of each bucket, the least of each share of it; all of a small one.

    Shares are formed by a hash, and the least of one by an aggregation, so no task holds a bucket.
    """
    share = F.when(F.col("members") <= many, F.xxhash64("rep")).otherwise(F.pmod(F.xxhash64("rep", F.lit(turn)), F.lit(many)))
    least = live.groupBy("k", share.alias("_share")).agg(F.min(F.struct("rep", "n_shingles", "root")).alias("p"))
    return least.select("k", F.col("p.rep").alias("pivot"), F.col("p.n_shingles").alias("pivot_size"), F.col("p.root").alias("pivot_root"))


def near_classes(df: DataFrame, id: str = "doc_id", text: str = "text", n: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The id, n_shingles and component_id of every row: the least id of those that links connect it with.

    Ids are unique and not null. Texts without words are linked with nothing.
    """
    base = stored(signed(shingles(df, id, text, n), bands, rows), "digests")
    alike = base.filter("n_shingles > 0").groupBy("a", "b", "n_shingles").agg(F.min("id").alias("rep"))
    alike = stored(alike, "alike")
    distinct = base.join(alike.select(F.col("rep").alias("id")), "id", "left_semi")
    keys = stored(distinct.select(F.explode("keys").alias("k"), F.col("id").alias("rep"), "n_shingles"), "bands")
    shared = keys.groupBy("k").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    members = last = stored(keys.join(shared, "k"), "members")
    removed(keys)
    # Only sets that share a band are made and kept; texts are read again for them.
    some = stored(members.select(F.col("rep").alias(id)).distinct(), "shared")
    sets = stored(counted(shingles(df.join(some, id, "left_semi"), id, text, n).select(F.col("id").alias("rep"), "shingles")), "sets")
    links, roots, many, turn = None, None, 1, 0
    while True:
        root = F.col("rep").alias("root") if roots is None else F.coalesce("root", "rep").alias("root")
        live = (members if roots is None else members.join(roots.withColumnRenamed("node", "rep"), "rep", "left")).select("k", "rep", "n_shingles", "members", root)
        # Open: still unconnected, and not all of its sets have been pivots.
        open_ = live.groupBy("k").agg(F.min("root").alias("_low"), F.max("root").alias("_high"), F.max("members").alias("_members"))
        open_ = open_.filter((F.col("_low") < F.col("_high")) & (F.lit(turn == 0) | (F.col("_members") > many // GROWTH))).select("k")
        live = stored(live.join(open_, "k", "left_semi"), "live")
        if live.isEmpty():
            break
        small, large = F.least("n_shingles", "pivot_size"), F.greatest("n_shingles", "pivot_size")
        pairs = live.join(pivots_of(live, many, turn), "k").filter((F.col("root") != F.col("pivot_root")) & (small * 100 >= large * percent))
        pairs = pairs.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
        pairs = stored(likely(pairs, sets, percent), "likely")
        asked = stored(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "asked")
        found = stored(verified(pairs, sets.join(asked, "rep", "left_semi"), percent), "links")
        removed(pairs)
        removed(asked)
        links = found if links is None else links.union(found)
        roots = stored(components(links), "roots")
        removed(last)
        members, last = live.drop("root"), live
        many, turn = many * GROWTH, turn + 1
    named = alike if roots is None else alike.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("a", "b", "n_shingles", F.coalesce("root", "rep").alias("component") if roots is not None else F.col("rep").alias("component"))
    out = base.select("id", "n_shingles", "a", "b").join(named, ["a", "b", "n_shingles"], "left")
    return out.select(F.col("id").alias(id), "n_shingles", F.coalesce("component", "id").alias("component_id"))


@registry.query(
    "d3_near_duplicates",
    r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i, w FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS h FROM g),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN c cx ON cx.doc_id = x JOIN c cy ON cy.doc_id = y WHERE 100 * o >= 80 * (cx.n + cy.n - o)),
e AS (SELECT x AS a, y AS b FROM l UNION SELECT y, x FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id
""",
)
def near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """D3: every document with the least id of its near copies."""
    return near_classes(table(spark, d, "documents").select("doc_id", "text"))
