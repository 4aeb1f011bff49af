"""A stored inverted index: postings in blocks with the greatest weight of each, a dictionary of terms, documents without texts.

A block has one term's postings of the documents of one block number, a hash of the document's id. So a
frequent term has as many blocks as there are block numbers, which grow with the number of documents, and
a block stays about ``BLOCK`` postings long whatever the term. Buckets (folders, by a hash of the term) and
slices of block numbers grow with the bytes of text; a task builds one slice of one bucket, so the number of tasks
grows with the input, and no task has all postings of a term. Texts are read twice and their terms
travel once.

A search reads the buckets of its terms. Which blocks it reads there is decided from the blocks' weights
(``search.bm25``); words that begin alike are found in the sorted dictionary, and words at an edit distance
in ``deletions``, which has each term under what is left of its beginning when up to two letters are taken out
(hashes of it; the distance itself is checked in the end).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.sources.formats import scratch, version
from lakeloom.sources.tables import table

#: Documents of a block number; bytes of text for each bucket, and for each slice of a bucket.
BLOCK, BUCKET_BYTES, SLICE_BYTES = 1024, 32 << 20, 1 << 30
K1, B = 1.2, 0.75
#: Words that a task has in arrays at once, but for a longer text's.
WORDS = 1 << 19
#: Of a term's beginning of so many letters, up to so many are taken out.
BEGINNING, TAKEN = 6, 2
POSTINGS = "term string, block int, n int, most double, doc_ids array<long>, tfs array<int>, lengths array<int>, places array<array<int>>, bucket int"
TERMS = "term string, df long, cf long, most double"
DOCS = "doc_id long, length long, lang string, source string"


def tokens(text: Column) -> Column:
    """A term is a maximal run of letters and digits, lower-case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def weight(tf: Column, length: Column, mean: float) -> Column:
    """What a term's frequency in a document counts for, without its rarity (Robertson and Zaragoza 2009)."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(mean)))


def left_over(word: str) -> set[str]:
    """The word's beginning with up to ``TAKEN`` letters taken out. Words at an edit distance of at most that have one in
    common: an alignment leaves as many letters of one beginning unmatched as of the other, each of them an edit."""
    begin = word[:BEGINNING]
    return {"".join(c for i, c in enumerate(begin) if i not in out) for k in range(TAKEN + 1) for out in combinations(range(len(begin)), k)}


def _left_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        terms = b.column(0).to_pylist()
        pairs = [(t, x) for t in terms for x in sorted(left_over(t))]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in pairs], pa.string()), pa.array([x for _, x in pairs], pa.string())], names=["term", "rest"])


_ROWS = "term string, block int, doc_id long, tf int, length int, places array<int>"


def _cut(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with so many words (in the third column), whatever rows a batch has; a row is never cut."""
    for b in batches:
        ends = np.cumsum(np.asarray(b.column(2).value_lengths().fill_null(0)).astype(np.int64))
        begin = 0
        while begin < b.num_rows:
            upto = int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + words, side="right"))
            yield b.slice(begin, max(upto, begin + 1) - begin)
            begin = max(upto, begin + 1)


def _of_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From doc_id, block and words of documents: a row for each of a document's terms, with its places in order."""
    for b in _cut(batches, WORDS):
        lists = b.column(2)
        lengths = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        if not len(coded):
            continue
        of = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(of)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        codes = np.asarray(coded.indices).astype(np.int64)
        key = of * len(coded.dictionary) + codes
        order = np.argsort(key, kind="stable")
        begin = np.flatnonzero(np.diff(key[order], prepend=-1))
        first = order[begin]
        rows = pa.array(of[first])
        ends = np.append(begin, len(order))
        yield pa.RecordBatch.from_arrays(
            [
                coded.dictionary.take(pa.array(codes[first])),
                b.column(1).take(rows),
                b.column(0).take(rows),
                pa.array(np.diff(ends).astype(np.int32)),
                pa.array(lengths[of[first]].astype(np.int32)),
                pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(place[order].astype(np.int32))),
            ],
            names=["term", "block", "doc_id", "tf", "length", "places"],
        )


def _in_blocks(mean: float):
    """Rows in the order of term, block and document become a row for each block; a block that a batch may not end waits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for b in itertools.chain(batches, [None]):
            if b is None:
                rows, ended = waiting, True
            else:
                rows, ended = pa.Table.from_batches([b]), False
                if waiting is not None:
                    rows = pa.concat_tables([waiting, rows])
            if rows is None or not rows.num_rows:
                continue
            term, block = rows.column("term").combine_chunks(), np.asarray(rows.column("block"))
            new = np.asarray(pc.not_equal(term[1:], term[:-1])) | (block[1:] != block[:-1])
            begin = np.concatenate([[0], np.flatnonzero(new) + 1])
            if not ended:
                waiting, begin, stop = rows.slice(begin[-1]), begin[:-1], int(begin[-1])
                rows = rows.slice(0, stop)
            if not len(begin):
                continue
            tf, length = np.asarray(rows.column("tf")), np.asarray(rows.column("length"))
            ends = pa.array(np.append(begin, rows.num_rows).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.concat_arrays(rows.column(c).chunks)) for c in ("doc_id", "tf", "length", "places")]
            at = pa.array(begin)
            most = np.maximum.reduceat(tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean)), begin)
            n = np.diff(np.append(begin, rows.num_rows)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([term.take(at), pa.array(block[begin]), pa.array(n), pa.array(most), *lists, rows.column("bucket").combine_chunks().take(at)], names=["term", "block", "n", "most", "doc_ids", "tfs", "lengths", "places", "bucket"])

    return run


@dataclass(frozen=True)
class Index:
    """An index in a folder of Parquet tables."""

    spark: SparkSession
    path: str

    @classmethod
    def build(cls, docs: DataFrame, path: str, block: int = BLOCK, bucket_bytes: int = BUCKET_BYTES, slice_bytes: int = SLICE_BYTES) -> Index:
        """docs: doc_id (unique), text, lang and source."""
        spark = docs.sparkSession
        length = F.coalesce(F.size(tokens(F.col("text"))), F.lit(0))
        sized = docs.select("doc_id", length.cast("long").alias("length"), "lang", "source", F.octet_length("text").alias("bytes"))
        sized.write.parquet(f"{path}/docs")
        total = spark.read.schema(f"{DOCS}, bytes int").parquet(f"{path}/docs").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("mean"), F.sum(F.col("bytes").cast("long")).alias("bytes")).first()
        size = total.bytes or 0
        shape = {"blocks": max(1, -(-total.n_docs // block)), "buckets": min(4096, max(8, size // bucket_bytes)), "slices": min(1024, max(4, size // slice_bytes))}
        spark.range(1).select(F.lit(total.n_docs).cast("long").alias("n_docs"), F.lit(total.mean).cast("double").alias("mean"), *(F.lit(v).cast("int").alias(k) for k, v in shape.items())).write.parquet(f"{path}/totals")
        out = cls(spark, path)
        out._write_postings(docs, total.mean or 1.0, **shape)
        found = out._read("postings", POSTINGS).select("term", "n", "most", F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x).alias("cf"))
        terms = found.groupBy("term").agg(F.sum("n").alias("df"), F.sum("cf").alias("cf"), F.max("most").alias("most"))
        terms.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms")
        return out

    def _write_postings(self, docs: DataFrame, mean: float, blocks: int, buckets: int, slices: int) -> None:
        number = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")
        words = docs.select("doc_id", number.alias("block"), tokens(F.col("text")).alias("words")).mapInArrow(_of_documents, _ROWS)
        words = words.withColumns({"bucket": F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"), "slice": F.pmod("block", F.lit(slices))})
        words = words.repartition(buckets * slices, "bucket", "slice").sortWithinPartitions("term", "block", "doc_id")
        words.drop("slice").mapInArrow(_in_blocks(mean), POSTINGS).write.partitionBy("bucket").parquet(f"{self.path}/postings")

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _buckets(self, words: list[str]) -> list[int]:
        held = self._read("totals", "buckets int").select(F.array(*[F.pmod(F.xxhash64(F.lit(w)), F.col("buckets")).cast("int") for w in words]).alias("b")).first()
        return sorted(set(held.b))

    def blocks(self, terms: list[str]) -> DataFrame:
        """Blocks of some terms, from their buckets' folders."""
        return self._read("postings", POSTINGS).filter(F.col("bucket").isin(*self._buckets(terms)) & F.col("term").isin(*terms)).drop("bucket")

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """term, doc_id and tf."""
        found = self._read("postings", POSTINGS) if terms is None else self.blocks(terms)
        return found.select("term", F.inline(F.arrays_zip("doc_ids", "tfs"))).toDF("term", "doc_id", "tf")

    def occurrences(self, terms: list[str]) -> DataFrame:
        """term, doc_id and place."""
        found = self.blocks(terms).select("term", F.inline(F.arrays_zip("doc_ids", "places"))).toDF("term", "doc_id", "places")
        return found.select("term", "doc_id", F.explode("places").alias("place"))

    def terms(self) -> DataFrame:
        """The dictionary, sorted: term, df (documents), cf (occurrences) and most (the greatest weight)."""
        return self._read("terms", TERMS)

    def deletions(self) -> DataFrame:
        """term, and rest, the hash of a remainder, by bucket; built when it is first asked for."""
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/deletions/_SUCCESS")
        if not done.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(done):
            buckets = self.totals().first().buckets
            rest = self.terms().select("term").mapInArrow(_left_over, "term string, rest string").select("term", F.xxhash64("rest").alias("rest"))
            rest = rest.withColumn("bucket", F.pmod("rest", F.lit(buckets)).cast("int"))
            rest.repartition(buckets, "bucket").sortWithinPartitions("rest").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/deletions")
        return self._read("deletions", "term string, rest long, bucket int")

    def like(self, word: str, within: int) -> DataFrame:
        """Terms at an edit distance of at most ``within``, which is at most ``TAKEN``."""
        if not 0 <= within <= TAKEN:
            raise ValueError(f"an edit distance of 0 to {TAKEN} is indexed")
        rest = sorted(left_over(word))
        hashes = self.spark.range(1).select(F.array(*[F.xxhash64(F.lit(x)) for x in rest]).alias("h")).first().h
        found = self.deletions().filter(F.col("bucket").isin(*self._buckets(rest)) & F.col("rest").isin(*hashes))
        return found.select("term").distinct().filter(F.levenshtein("term", F.lit(word)) <= within)

    def docs(self) -> DataFrame:
        return self._read("docs", DOCS)

    def totals(self) -> DataFrame:
        """One row: the number of documents, their mean length, and the numbers of blocks, buckets and slices."""
        return self._read("totals", "n_docs long, mean double, blocks int, buckets int, slices int")


_built: dict[tuple, Index] = {}


def of_folder(spark: SparkSession, d: str) -> Index:
    """The index of a folder's documents, built when it is first asked for, or when a file of the table has changed."""
    key = (spark.sparkContext.applicationId, d, version(spark, f"{d}/documents.parquet"))
    if key not in _built:
        _built[key] = Index.build(table(spark, d, "documents").select("doc_id", "text", "lang", "source"), scratch(spark, "index"))
    return _built[key]
