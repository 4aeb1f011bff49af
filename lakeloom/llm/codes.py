"""Vector code compression: product quantisation by delta-maintained Lloyd rounds in exact integers.

A vector is cut into equal parts; each part position has a codebook, and a vector's code has the index of
the nearest entry for each part. Each round writes the vectors with their assignments, and compares them
with the previous round's: only parts whose assignment changed add to the new entry's running sum and take
off the old one's. These additions are summed in each task; of them at most one row for each task and
cell of the model is shuffled. Assignments and sums lie in the shared folder, so a lost executor
costs its tasks and a lost round one pass.

Defined results: rows whose vector is null or empty, or holds a component that is null, not finite or of
2**19 or more in magnitude (whose squared distances no long would hold), are dropped; so are rows whose vector's length is not
that of the row of the least id among those whose length ``parts`` divides. Null ids come last; among equal ids
the vector's bytes decide. With fewer vectors than entries the codebooks are as short; a table without
vectors gives no rows. Equal rows get equal codes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.llm.common import dropped, written
from lakeloom.llm.vectors import Additions, Running, integer_vectors, matrix, means, squared

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Labels up to which their totals are sent to every task.
BROADCAST = 10_000


@dataclass
class Codebooks:
    """entries: by part, entry and component. changed: parts whose assignment changed, by round."""

    entries: np.ndarray
    changed: list[int]

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code and error of each vector; ties go to the lower index."""
    parts, _, width = books.shape
    codes = np.empty((len(x), parts), dtype=np.int64)
    error = np.zeros(len(x), dtype=np.int64)
    for p in range(parts):
        d = squared(x[:, p * width : (p + 1) * width], books[p])
        codes[:, p] = d.argmin(axis=1)
        error += d[np.arange(len(x)), codes[:, p]]
    return codes, error


def assigned(table: DataFrame, books: np.ndarray, kinds: str) -> DataFrame:
    """One pass: every vector with its code (two bytes for each part), then the task's additions to the running sums."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        added, names, types = Additions(parts * entries, width, counters=1), ["id", "label", "v", "code", "cell", "value"], None
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("v"), parts * width)
            codes, _ = nearest(x, books)
            known = b.column("code").null_count == 0
            if known:
                old = np.frombuffer(b"".join(b.column("code").to_pylist()), dtype="<u2").reshape(-1, parts).astype(np.int64)
            for p in range(parts):
                moved = np.flatnonzero(old[:, p] != codes[:, p]) if known else np.arange(len(x))
                mine = x[moved, p * width : (p + 1) * width]
                added.add(p * entries + codes[moved, p], mine)
                if known:
                    added.add(p * entries + old[moved, p], mine, -1)
                added.counters[0] += len(moved)
            rows, types, stored = b.num_rows, [b.column("id").type, b.column("label").type], codes.astype("<u2").tobytes()
            code = pa.array([stored[2 * parts * i : 2 * parts * (i + 1)] for i in range(rows)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), b.column("v"), code, pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int64())], names=names)
        if types:
            cells, values = added.cells()
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(cells), t) for t in (*types, pa.binary(), pa.binary())), pa.array(cells), pa.array(values)], names=names)

    return table.mapInArrow(run, f"{kinds}, v binary, code binary, cell long, value long")


def coded(table: DataFrame, books: np.ndarray, kinds: str) -> DataFrame:
    """Each vector's indexes, one for each part, and its error, without the vector."""
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, error = nearest(matrix(b.column("v"), parts * width), books)
            indexes = pa.ListArray.from_arrays(np.arange(0, codes.size + 1, parts, dtype=np.int32), pa.array(codes.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), indexes, pa.array(error)], names=["id", "label", "indexes", "error"])

    return table.select("id", "label", "v").mapInArrow(run, f"{kinds}, indexes array<int>, error long")


def compressed(df: DataFrame, id: str = "vec_id", column: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """id, label, indexes (of the entry of each part) and error of every kept vector, and the codebooks.

    The codebooks start as the parts of the vectors of the least ids. A round is one pass over the vectors.
    """
    kinds = f"id {df.schema[id].dataType.simpleString()}, label {df.schema[label].dataType.simpleString()}"
    table = written(integer_vectors(df, column, scale, {id: "id", label: "label"}), "vectors")
    order = [F.asc_nulls_last("id"), F.asc("v")]
    first = table.filter((F.octet_length("v") % (4 * parts)) == 0).orderBy(*order).limit(1).select(F.octet_length("v").alias("n")).collect()
    size = first[0].n // 4 if first else parts
    own = F.octet_length("v") == 4 * size
    seeds = [r.v for r in table.filter(own).orderBy(*order).limit(entries).select("v").collect()]
    books = np.frombuffer(b"".join(seeds), dtype="<i4").reshape(len(seeds), parts, size // parts).astype(np.int64).transpose(1, 0, 2).copy()
    if not seeds:
        return table.filter(own).select("id", "label", F.array().cast("array<int>").alias("indexes"), F.lit(0).cast("long").alias("error")), Codebooks(books, [])
    running = Running(parts * len(seeds), size // parts, counters=1)
    changed: list[int] = []
    current, before = table.filter(own).withColumn("code", F.lit(None).cast("binary")), table
    for _ in range(rounds):
        passed = written(assigned(current, books, kinds), "codes")
        dropped(before)
        before = passed
        sums, counters = running.merge(passed)
        changed.append(int(counters[0]) - sum(changed))
        books = means(books.reshape(-1, size // parts), sums).reshape(books.shape)
        current = passed.filter("cell IS NULL")
    out = written(coded(current, books, kinds), "coded")
    dropped(before)
    return out, Codebooks(books, changed)


def decoded(codes: DataFrame, books: Codebooks, scale: int = SCALE, column: str = "indexes") -> DataFrame:
    """The rows with vector, an array of doubles, put together from the entries that the code names."""
    entries = [[[v / scale for v in entry] for entry in part] for part in books.entries.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[v for p, i in enumerate(r) for v in entries[p][i]] for r in b.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, pa.list_(pa.float64()))], names=[*b.schema.names, "vector"])

    return codes.mapInArrow(run, T.StructType([*codes.schema.fields, T.StructField("vector", T.ArrayType(T.DoubleType()))]))


def with_label_errors(codes: DataFrame) -> DataFrame:
    """The rows with label_error: the error summed over equal labels, nulls together.

    Sums are formed in each task first. Few totals are sent to every task; more are joined by label, where large labels
    are split by the adaptive join.
    """
    totals = written(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "totals").withColumnRenamed("label", "_label")
    few = totals.limit(BROADCAST + 1).count() <= BROADCAST
    return codes.join(F.broadcast(totals) if few else totals, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, size: int = 64) -> str:
    """SQL for vectors of one length and unique ids."""
    width = size // parts
    c = [f"c{j}" for j in range(width)]
    distance = " + ".join(f"(x.{n} - b.{n}) * (x.{n} - b.{n})" for n in c)
    steps = [
        f"v AS (SELECT vec_id, label, [CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT) for x in embedding] AS e FROM embeddings WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)",
        f"x AS MATERIALIZED (SELECT vec_id, label, p, {', '.join(f'e[p * {width} + {j + 1}] AS {n}' for j, n in enumerate(c))} FROM v, range({parts}) t(p))",
        f"b0 AS MATERIALIZED (SELECT p, k, {', '.join(c)} FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM v QUALIFY k < {entries}) USING (vec_id))",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT x.vec_id, any_value(x.label) AS label, x.p, {', '.join(f'any_value(x.{n}) AS {n}' for n in c)}, min(({distance}) * {entries} + k) AS m FROM x JOIN b{r} b USING (p) GROUP BY x.vec_id, x.p)")
        if r < rounds:
            mean = ", ".join(f"coalesce(CAST((s.{n} - ((s.{n} % s.n) + s.n) % s.n) // s.n AS BIGINT), b.{n}) AS {n}" for n in c)
            sums = f"SELECT p, m % {entries} AS k, count(*) AS n, {', '.join(f'sum({n}) AS {n}' for n in c)} FROM a{r} GROUP BY ALL"
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT b.p, b.k, {mean} FROM b{r} b LEFT JOIN ({sums}) s USING (p, k))")
    return f"""WITH {", ".join(steps)},
per AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', m % {entries}), '' ORDER BY p) AS code, CAST(sum(m // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, k, j)) FROM (SELECT p, k, unnest([{", ".join(str(j) for j in range(width))}]) AS j, unnest([{", ".join(c)}]) AS c FROM b{rounds})) AS codebooks_sha256
FROM per"""
