"""Nearest vectors by cosine over an inverted file: cells of k-means centres, a few cells probed, exact cosines.

Building fits the centres on a sample (the ``SAMPLE`` rows of the least hashes of their ids) and then stores every
vector, at unit length, in the folder of its nearest centre's cell. A cell is dealt into parts of about ``PART`` vectors, and the
queries that probe it into blocks, so that a task compares one part with one block however large the
cell; what it returns is at most k rows for each query. ``exact`` searches go on where probing ended: a
vector of a cell is at least as far from the query as the centre is, less the cell's radius, so only cells that this
leaves room for a better one are read.

Vectors that are null, of length zero, of another number of components than the centres, or hold a
component that is null or not finite have no direction and are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.plans.registry import Registry
from lakeloom.sources.formats import removed, scratch, stored, version
from lakeloom.sources.tables import table

registry = Registry()

SAMPLE, CELLS, PART, BLOCK = 100_000, 4096, 20_000, 2_000
#: Of the cells, the share that a search probes, and how many at least. The share suits vectors in no clusters, as in the test tables; clustered ones need less.
PROBED, LEAST = 0.6, 8
#: Numbers in an array of a task at once.
NUMBERS = 1 << 22
#: Cosines are compared after rounding to so many places.
PLACES = 6
SCHEMA = "id long, unit array<double>, part int, cell int"


def units(df: DataFrame, id: str, vector: str, size: int | None = None) -> DataFrame:
    """id and unit, the vector at length one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            lengths = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
            x = np.asarray(lists.flatten().fill_null(float("nan")))
            of = np.repeat(np.arange(len(lengths)), lengths)
            with np.errstate(all="ignore"):
                largest = np.zeros(len(lengths))
                np.maximum.at(largest, of, np.abs(x))
                scaled = x / largest[of]  # so that squares neither overflow nor vanish
                norm = np.sqrt(np.bincount(of, weights=scaled * scaled, minlength=len(lengths)))
                good = np.isfinite(norm) & (norm > 0) & (True if size is None else lengths == size)
                unit = (scaled / norm[of])[good[of]]
            offsets = np.concatenate([[0], np.cumsum(lengths[good])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good)), pa.ListArray.from_arrays(offsets, pa.array(unit))], names=["id", "unit"])

    return df.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "id long, unit array<double>")


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(-1, size)


def _cut(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def _in_cells(centres: np.ndarray, probes: int):
    """Each vector with its nearest cells and its distances from their centres."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _cut(batches, max(1, NUMBERS // max(1, len(centres), probes * centres.shape[1]))):
            x = _matrix(b.column(1), centres.shape[1])
            d = np.sqrt(np.maximum(1 - 2 * (x @ centres.T) + np.einsum("ij,ij->i", centres, centres), 0))
            cell = np.argsort(d, axis=1, kind="stable")[:, :probes]
            gap = np.take_along_axis(d, cell, axis=1)
            rows = pa.array(np.repeat(np.arange(len(x)), cell.shape[1]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(cell.ravel().astype(np.int32)), pa.array(gap.ravel())], names=["id", "unit", "cell", "gap"])

    return run


def _nearest(size: int, k: int):
    """The k best of a part of a cell for each query of a block."""

    def run(key: tuple, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        ids, out = np.asarray(vectors.column("id")), ([], [], [])
        if vectors.num_rows and queries.num_rows:
            held, asked, names = _matrix(vectors.column("unit"), size), _matrix(queries.column("unit"), size), queries.column("id").to_pylist()
            some = max(1, NUMBERS // len(held))
            for i in range(0, len(asked), some):
                cosines = np.round(asked[i : i + some] @ held.T, PLACES) + 0.0
                for q, row in zip(names[i : i + some], cosines, strict=True):
                    at = np.arange(len(row)) if len(row) <= k else np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k])
                    at = at[np.lexsort((ids[at], -row[at]))][:k]
                    out[0].extend([q] * len(at))
                    out[1].extend(ids[at].tolist())
                    out[2].extend(row[at].tolist())
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "id": pa.array(out[1], pa.int64()), "cosine": pa.array(out[2], pa.float64())})

    return run


@dataclass(frozen=True)
class VectorIndex:
    """An index in a folder. centres by cell; radius and rows of each cell."""

    spark: SparkSession
    path: str
    centres: np.ndarray = field(compare=False)
    radius: np.ndarray = field(compare=False)
    rows: np.ndarray = field(compare=False)
    part: int = PART

    @classmethod
    def build(cls, df: DataFrame, path: str, id: str = "vec_id", vector: str = "embedding", cells: int | None = None, sample: int = SAMPLE, part: int = PART) -> VectorIndex:
        """Cells are as many as the root of the number of rows, at most ``CELLS``; ids are whole numbers."""
        spark = df.sparkSession
        every = units(df, id, vector)
        first = every.orderBy(F.xxhash64("id"), "id").limit(sample)
        sizes = every.groupBy(F.size("unit").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
        if not sizes:
            return cls(spark, path, np.zeros((0, 0)), np.zeros(0), np.zeros(0, dtype=int), part)
        size = sizes[0].n
        cells = min(cells or min(CELLS, max(1, round(sizes[0].rows ** 0.5))), sizes[0].rows)
        points = stored(first.filter(F.size("unit") == size).select(array_to_vector("unit").alias("features")), "sample")
        centres = np.array(KMeans(k=cells, seed=1, maxIter=10).fit(points).clusterCenters()) if cells > 1 else np.zeros((1, size))
        removed(points)
        found = stored(every.filter(F.size("unit") == size).mapInArrow(_in_cells(centres, 1), "id long, unit array<double>, cell int, gap double"), "cells")
        told = found.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.max("gap").alias("radius")).collect()  # at most one row for each cell
        radius, rows = np.zeros(len(centres)), np.zeros(len(centres), dtype=np.int64)
        for r in told:
            radius[r.cell], rows[r.cell] = r.radius, r.rows
        parts = spark.createDataFrame([(r.cell, int(-(-r.rows // part))) for r in told], "cell int, parts int")
        dealt = found.join(F.broadcast(parts), "cell").select("id", "unit", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "cell")
        dealt.repartition("cell", "part").write.partitionBy("cell").parquet(path)
        removed(found)
        return cls(spark, path, centres, radius, rows, part)

    def vectors(self, cells: list[int]) -> DataFrame:
        """Vectors of some cells, from their folders."""
        out = self.spark.read.schema(SCHEMA).parquet(self.path)
        return out.filter(F.col("cell").isin(*cells))

    def _best(self, probing: DataFrame, k: int) -> DataFrame:
        """query_id, id and cosine: at most k rows for each query and part, of queries (id, unit, cell)."""
        size = self.centres.shape[1]
        asked = {r.cell: r.n for r in probing.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most one row for each cell
        rows = [(c, int(-(-self.rows[c] // self.part)), int(-(-n // BLOCK))) for c, n in asked.items() if self.rows[c]]
        shape = F.broadcast(self.spark.createDataFrame(rows, "cell int, parts int, blocks int"))
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = self.vectors([c for c, _, _ in rows]).join(shape.drop("parts"), "cell").select("id", "unit", "cell", "part", each("blocks").alias("block"))
        right = probing.join(shape, "cell").select("id", "unit", "cell", each("parts").alias("part"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
        keys = ["cell", "part", "block"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_nearest(size, k), "query_id long, id long, cosine double")

    def search(self, queries: DataFrame, k: int, id: str = "vec_id", vector: str = "embedding", probes: int | None = None, exact: bool = False) -> DataFrame:
        """query_id, rank (from 1), id and cosine of the k nearest vectors of each query; ties by id.

        ``exact`` also reads every cell that may hold a vector of a higher or equal cosine than the k-th found.
        """
        if not len(self.centres) or k < 1:
            return self.spark.createDataFrame([], "query_id long, rank int, id long, cosine double")
        probes = min(len(self.centres), probes or max(LEAST, round(len(self.centres) * PROBED)))
        asked = units(queries, id, vector, self.centres.shape[1])
        schema = "id long, unit array<double>, cell int, gap double"
        near = stored(asked.mapInArrow(_in_cells(self.centres, probes), schema), "probes")
        found = self._best(near.drop("gap"), k)
        if exact:
            found = stored(found, "found")
            least = self._ranked(found, k).groupBy("query_id").agg(F.min("cosine").alias("least"), F.count(F.lit(1)).alias("n"))
            radius = F.array(*(F.lit(float(x)) for x in self.radius))
            more = asked.mapInArrow(_in_cells(self.centres, len(self.centres)), schema).join(near.select("id", "cell"), ["id", "cell"], "left_anti")
            nearest = F.greatest(F.col("gap") - F.get(radius, F.col("cell")), F.lit(0.0))  # of what the cell may hold
            more = more.join(least.withColumnRenamed("query_id", "id"), "id", "left")
            more = more.filter(F.coalesce(F.col("n") < k, F.lit(True)) | (1 - nearest * nearest / 2 >= F.col("least") - 2 * 10.0**-PLACES))
            more = stored(more.select("id", "unit", "cell"), "more")
            if not more.isEmpty():
                found = found.unionByName(self._best(more, k))
        return self._ranked(found, k)

    @staticmethod
    def _ranked(found: DataFrame, k: int) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "cosine")


_built: dict[tuple, VectorIndex] = {}


def of_folder(spark: SparkSession, d: str) -> VectorIndex:
    """The index of a folder's embeddings, built when it is first asked for, or when a file of the table has changed."""
    key = (spark.sparkContext.applicationId, d, version(spark, f"{d}/embeddings.parquet"))
    if key not in _built:
        _built[key] = VectorIndex.build(table(spark, d, "embeddings").select("vec_id", "embedding"), scratch(spark, "vectors"))
    return _built[key]


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "embedding").filter("vec_id % 50 = 0")


_COSINES = """
WITH v AS (SELECT vec_id, embedding AS e, sqrt(list_sum([CAST(x AS DOUBLE) * x for x in embedding])) AS norm FROM embeddings),
c AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(v.e AS DOUBLE[])) / (q.norm * v.norm), 6) AS cosine FROM v q JOIN v ON q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS INTEGER) AS rank, vec_id, cosine FROM c
QUALIFY rank <= 10
"""


@registry.query("s8_nearest_vectors", _COSINES)
def nearest_vectors(spark: SparkSession, d: str) -> DataFrame:
    """For every fiftieth vector its ten nearest of all, exactly."""
    return of_folder(spark, d).search(_queries(spark, d), 10, exact=True).withColumnRenamed("id", "vec_id")


@registry.query("s8_probed_vectors")
def probed_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The same from a share of the cells; tests hold its recall against all vectors."""
    return of_folder(spark, d).search(_queries(spark, d), 10).withColumnRenamed("id", "vec_id")
