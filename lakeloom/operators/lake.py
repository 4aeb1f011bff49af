"""Keyed tables with commits over plain files: upserts and deletes by key that rewrite only the files they may
concern, point reads, reading as of a commit, changes since one, compaction.

A table is a set of files, each sorted by key, with one row for each key; a deleted key keeps a row that
says from when on. Beside each folder of files lie their statistics: rows, the range of keys, and a Bloom filter of
the keys. A change reads the files whose range and filter may hold its keys, merges (the greatest ordering value
counts, of equals the change) and writes new files in their place; all others stay as they are.

A commit is a manifest that names the files added and removed; every tenth names all live files, so few
are read. It is written under another name and then renamed to its number, which fails if another
writer has that number; the loser starts over from the new state. So a reader meets whole manifests only, and what a
writer that died has left is never read. Renaming without overwriting is atomic in HDFS; on a local disk, writers of
one instant may not notice each other, and stores without such a rename need a lock around commits.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from lakeloom.plans.registry import Registry
from lakeloom.sources.formats import scratch, stored
from lakeloom.sources.tables import table

registry = Registry()

#: Rows of a file; keys that filters are asked for one by one; bits and hashes for each key of a filter.
FILE_ROWS, ASKED, BITS, HASHES = 1_000_000, 10_000, 10, 7
#: Of every so many commits one names all live files.
EVERY = 10


def bloom_places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each key's hash, by double hashing."""
    h = hashes.view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return ((h[:, None] + np.arange(HASHES, dtype=np.uint64)[None, :] * step[:, None]) % np.uint64(bits)).astype(np.int64)


def _filter(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The Bloom filter of a file's keys, of which no more than a batch is held; the group names the file and its rows."""
    bits = np.zeros(max(64, BITS * key[1].as_py()), dtype=bool)
    for b in batches:
        bits[bloom_places(np.asarray(b.column("hash")), len(bits)).ravel()] = True
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([np.packbits(bits).tobytes()], pa.binary()), pa.array([len(bits)], pa.int64())], names=["name", "bloom", "bits"])


def _may_hold(hashes: np.ndarray):
    """The files whose filter has the bits of any key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for bloom, bits in zip(b.column("bloom").to_pylist(), b.column("bits").to_pylist(), strict=True):
                known = np.unpackbits(np.frombuffer(bloom, dtype=np.uint8))
                keep.append(bool(known[bloom_places(hashes, bits)].all(axis=1).any()))
            yield b.select(["file"]).filter(pa.array(keep, pa.bool_()))

    return run


class Conflict(RuntimeError):
    """Another commit came in between."""


@dataclass(frozen=True)
class LakeTable:
    """A table of a schema in a folder; ``keys`` name a row and ``order`` says which of a key's rows is newer."""

    spark: SparkSession
    path: str
    schema: StructType
    keys: tuple[str, ...]
    order: str
    file_rows: int = FILE_ROWS

    # Manifests

    def _place(self, name: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _numbers(self) -> list[int]:
        files, place = self._place("commits")
        if not files.exists(place):
            return []
        names = [s.getPath().getName() for s in files.listStatus(place)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _manifest(self, number: int) -> dict | None:
        """A manifest; nothing for a file that is none, which no commit of this protocol leaves."""
        files, place = self._place(f"commits/{number:012d}.json")
        stream = files.open(place)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        except ValueError:
            return None
        finally:
            stream.close()

    def files(self, as_of: int | None = None) -> dict[str, int]:
        """Live files, with their rows, after a commit or now; reads manifests back to the last that names them all."""
        found: list[dict] = []
        for n in reversed([n for n in self._numbers() if as_of is None or n <= as_of]):
            if m := self._manifest(n):
                found.append(m)
                if "live" in m:
                    break
        live = dict(found[-1]["live"]) if found and "live" in found[-1] else {}
        for m in reversed(found):
            if "live" not in m:
                live = {f: n for f, n in live.items() if f not in set(m["removed"])} | m["added"]
        return live

    def _commit(self, number: int, kind: str, added: dict[str, int], removed: list[str]) -> int:
        manifest = {"number": number, "kind": kind, "added": added, "removed": removed}
        if number % EVERY == 0 or kind == "compact":
            manifest["live"] = {f: n for f, n in self.files().items() if f not in set(removed)} | added
        files, temporary = self._place(f"commits/.{uuid.uuid4().hex}")
        stream = files.create(temporary, False)
        try:
            stream.write(json.dumps(manifest).encode())
        finally:
            stream.close()
        _, place = self._place(f"commits/{number:012d}.json")
        jvm = self.spark._jvm
        keep = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        keep[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), self.spark._jsc.hadoopConfiguration()).rename(temporary, place, keep)
        except Py4JJavaError:
            files.delete(temporary, False)
            if files.exists(place):
                raise Conflict(f"another writer has commit {number}") from None
            raise
        return number

    # Rows

    @property
    def _stored(self) -> StructType:
        return StructType([*self.schema.fields, StructField("_deleted", BooleanType()), StructField("_commit", LongType())])

    def _key(self):
        return F.struct(*(F.col(k).cast(self.schema[k].dataType).alias(k) for k in self.keys))

    def _rows(self, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self._stored)
        return self.spark.read.schema(self._stored).parquet(*(f"{self.path}/{f}" for f in files))

    def _write(self, rows: DataFrame, about: int) -> dict[str, int]:
        """Writes files of about ``file_rows`` rows by ranges of keys, and their statistics."""
        folder = f"rows/{uuid.uuid4().hex}"
        parts = max(1, -(-about // self.file_rows))
        rows.repartitionByRange(parts, *self.keys).sortWithinPartitions(*self.keys).write.parquet(f"{self.path}/{folder}")
        back = self.spark.read.schema(self._stored).parquet(f"{self.path}/{folder}").select(F.col("_metadata.file_name").alias("name"), self._key().alias("key"))
        ranges = back.groupBy("name").agg(F.count(F.lit(1)).alias("rows"), F.min("key").alias("low"), F.max("key").alias("high"))
        hashes = back.select("name", F.xxhash64("key").alias("hash")).join(F.broadcast(ranges.select("name", "rows")), "name")  # a row for each file
        blooms = hashes.groupBy("name", "rows").applyInArrow(_filter, "name string, bloom binary, bits long")
        stats = ranges.join(blooms, "name").withColumn("file", F.concat(F.lit(f"{folder}/"), "name")).drop("name")
        stats.write.parquet(f"{self.path}/{folder}-stats")
        return {r.file: r.rows for r in self.spark.read.schema(stats.schema).parquet(f"{self.path}/{folder}-stats").select("file", "rows").collect()}

    def files_of(self, keys: DataFrame, live: dict[str, int] | None = None) -> list[str]:
        """The live files that may hold any of the keys: by their ranges, and by their filters if keys are not too many."""
        live = self.files() if live is None else live
        folders = sorted({f.rsplit("/", 1)[0] for f in live})
        asked = stored(keys.select(self._key().alias("key")).distinct(), "keys")
        ends = asked.agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count(F.lit(1)).alias("n")).first()
        if not folders or not ends.n:
            return []
        kind = StructType([StructField("low", asked.schema["key"].dataType), StructField("high", asked.schema["key"].dataType)])
        span = self.spark.createDataFrame([(ends.low, ends.high)], kind).toDF("_low", "_high")  # one row
        stats = self.spark.read.parquet(*(f"{self.path}/{f}-stats" for f in folders)).crossJoin(F.broadcast(span))
        stats = stats.filter(F.col("high") >= F.col("_low")).filter(F.col("low") <= F.col("_high"))
        if ends.n <= ASKED:
            hashes = np.array([r.h for r in asked.select(F.xxhash64("key").alias("h")).collect()], dtype=np.int64)
            stats = stats.select("file", "bloom", "bits").mapInArrow(_may_hold(hashes), "file string")
        return sorted(r.file for r in stats.select("file").collect() if r.file in live)

    def _change(self, rows: DataFrame, kind: str) -> int:
        """Merges rows into the files that may hold their keys, again if another commit comes in between."""
        value = F.struct(*self.schema.names, "_deleted")
        newest = F.max_by(value, F.struct(F.col(self.order).isNotNull(), self.order, F.xxhash64(*self.schema.names)))  # partial in each task
        casts = [F.col(n).cast(self.schema[n].dataType).alias(n) for n in self.schema.names]
        batch = rows.select(*casts, F.lit(kind == "delete").alias("_deleted"))
        batch = stored(batch.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys))).agg(newest.alias("v")).select("v.*"), "batch")
        while True:
            number = ([0] + self._numbers())[-1] + 1
            live = self.files()
            touched = self.files_of(batch, live)
            old = self._rows(touched).withColumn("_new", F.lit(0))
            both = old.unionByName(batch.withColumns({"_commit": F.lit(number).cast("long"), "_new": F.lit(1)}))
            value = F.struct(*self._stored.names)
            best = F.max_by(value, F.struct(F.col(self.order).isNotNull(), self.order, "_new"))
            merged = both.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys))).agg(best.alias("v")).select("v.*")
            added = self._write(merged, sum(live[f] for f in touched) + batch.count())
            try:
                return self._commit(number, kind, added, touched)
            except Conflict:
                continue

    def upsert(self, rows: DataFrame) -> int:
        """A commit of new or changed rows; a row older than the one that the table has changes nothing."""
        return self._change(rows.select(*self.schema.names), "upsert")

    def delete(self, rows: DataFrame) -> int:
        """A commit of rows whose keys go; their ordering value says from when on."""
        kept = (*self.keys, self.order)
        return self._change(rows.select(*(F.col(n) if n in kept else F.lit(None).alias(n) for n in self.schema.names)), "delete")

    def read(self, as_of: int | None = None) -> DataFrame:
        """The rows as they are, or as they were after a commit: a scan of the live files."""
        return self._rows(list(self.files(as_of))).filter(~F.col("_deleted")).select(*self.schema.names)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys, from the files that may hold them."""
        asked = keys.select(self._key().alias("_key")).distinct()
        found = self._rows(self.files_of(keys)).filter(~F.col("_deleted")).withColumn("_key", self._key())
        return found.join(asked, found["_key"].eqNullSafe(asked["_key"]), "left_semi").select(*self.schema.names)

    def changes(self, since: int) -> DataFrame:
        """Keys whose row is not the one after a commit: the row as it is now, or the key alone, with ``_deleted`` and ``_commit``.

        Only files that are not live at both are read.
        """
        then, now = self.files(since), self.files()
        new = self._rows([f for f in now if f not in then]).withColumn("_key", self._key())
        before = self._rows([f for f in then if f not in now]).select(self._key().alias("_was"), F.struct(*self.schema.names).alias("_row"), (~F.col("_deleted")).alias("_there"))
        both = new.join(before, F.col("_key").eqNullSafe(F.col("_was")), "left")
        there = F.coalesce("_there", F.lit(False))
        differs = F.when(F.col("_deleted"), there).otherwise(~there | ~F.struct(*self.schema.names).eqNullSafe(F.col("_row")))
        return both.filter(differs).select(*self.schema.names, "_deleted", "_commit")

    def compact(self) -> int:
        """Writes all live files anew, by ranges of keys; deleted keys keep their rows, so that later rows find them."""
        while True:
            number = ([0] + self._numbers())[-1] + 1
            live = self.files()
            added = self._write(self._rows(list(live)), sum(live.values()))
            try:
                return self._commit(number, "compact", added, list(live))
            except Conflict:
                continue


def _example(spark: SparkSession, d: str) -> LakeTable:
    """Orders up to 1998; then those from 1997 on at half their price; then pending ones deleted; then an outdated row."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_totalprice")
    schema = StructType([*orders.schema.fields, StructField("version", orders.schema["o_orderkey"].dataType)])
    out = LakeTable(spark, scratch(spark, "lake"), schema, ("o_orderkey",), "version")
    out.upsert(orders.filter("o_orderdate < TIMESTAMP_NTZ '1998-01-01 00:00:00'").withColumn("version", F.lit(1).cast("long")))
    out.upsert(orders.filter("o_orderdate >= TIMESTAMP_NTZ '1997-01-01 00:00:00'").withColumns({"o_totalprice": F.col("o_totalprice") / 2, "version": F.lit(2).cast("long")}))
    out.delete(orders.filter("o_orderstatus = 'P'").withColumn("version", F.lit(3).cast("long")))
    out.upsert(orders.filter("o_orderstatus = 'F'").withColumns({"o_totalprice": F.lit(-1.0), "version": F.lit(0).cast("long")}))  # too late
    return out


_NOW = "CASE WHEN o_orderdate >= TIMESTAMP '1997-01-01' THEN o_totalprice / 2 ELSE o_totalprice END AS o_totalprice"


@registry.query("k7_lake_table", f"SELECT o_orderkey, {_NOW} FROM orders WHERE o_orderstatus <> 'P'")
def lake_table(spark: SparkSession, d: str) -> DataFrame:
    """K7: the rows after four commits and a compaction."""
    lake = _example(spark, d)
    lake.compact()
    return lake.read().select("o_orderkey", "o_totalprice")


@registry.query("k8_as_of_commit", f"SELECT o_orderkey, {_NOW} FROM orders")
def as_of_commit(spark: SparkSession, d: str) -> DataFrame:
    """K8: the rows after the second commit."""
    return _example(spark, d).read(as_of=2).select("o_orderkey", "o_totalprice")


@registry.query(
    "k9_changes_since_commit",
    """
SELECT o_orderkey, o_orderstatus = 'P' AS deleted, CAST(CASE WHEN o_orderstatus = 'P' THEN 3 ELSE 2 END AS BIGINT) AS at FROM orders
WHERE CASE WHEN o_orderstatus = 'P' THEN o_orderdate < TIMESTAMP '1998-01-01' ELSE o_orderdate >= TIMESTAMP '1997-01-01' END
""",
)
def changes_since_commit(spark: SparkSession, d: str) -> DataFrame:
    """K9: an incremental pull of what differs from the first commit; outdated rows changed nothing, and keys that came and went are none."""
    return _example(spark, d).changes(since=1).select("o_orderkey", F.col("_deleted").alias("deleted"), F.col("_commit").alias("at"))


@registry.query("k10_lookup", f"SELECT o_orderkey, {_NOW} FROM orders WHERE o_orderstatus <> 'P' AND o_orderdate = (SELECT max(o_orderdate) FROM orders WHERE o_orderstatus = 'F')")
def looked_up(spark: SparkSession, d: str) -> DataFrame:
    """The rows of the orders of the last day that has a finished one, from the files that may hold them."""
    lake = _example(spark, d)
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    last = orders.filter("o_orderstatus = 'F'").agg(F.max("o_orderdate").alias("o_orderdate"))  # one row
    return lake.lookup(orders.join(F.broadcast(last), "o_orderdate")).select("o_orderkey", "o_totalprice")
