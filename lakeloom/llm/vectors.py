"""What the operators on vectors share: vectors as exact integers, exact nearest centres, running integer sums.

Rows of a pass are either vectors or, where ``cell`` is not null, additions to a running sum. So one
pass over the vectors writes both the new state of each vector and what its changes add to the sums,
and only the additions, summed in each task, are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import dropped, written

#: Values of integer components stay below this, so that squared distances of thousands of them fit a long.
BOUND = 1 << 27


def integer_vectors(df: DataFrame, column: str, scale: int, keep: dict[str, str], size: int | None = None) -> DataFrame:
    """The kept columns under their new names, and v: floor(scale * x) of each component as little-endian int32.

    Dropped are rows whose vector is null, empty, of another length than ``size`` if that is given, or holds
    a component that is null, not finite or of a magnitude of 2**27 / scale or more.
    """
    names = list(keep.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(0)
            lengths = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
            flat = lists.flatten().cast(pa.float64())
            x = np.floor(np.asarray(flat.fill_null(float("nan"))) * scale)
            with np.errstate(invalid="ignore"):
                bad = ~(np.abs(x) < BOUND)
            wrong = np.bincount(np.repeat(np.arange(len(lengths)), lengths), weights=bad, minlength=len(lengths)) > 0
            good = (lengths > 0) & ~wrong & (True if size is None else lengths == size)
            v = np.where(bad, 0, x).astype("<i4").tobytes()
            ends = np.cumsum(lengths) * 4
            rows = np.flatnonzero(good)
            cut = [v[ends[i] - lengths[i] * 4 : ends[i]] for i in rows.tolist()]
            rest = b.select(range(1, b.num_columns)).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(cut, pa.binary())], names=[*names, "v"])

    kinds = [f"{n} {df.schema[c].dataType.simpleString()}" for c, n in keep.items()]
    return df.select(df[column].cast("array<double>").alias("x"), *(df[c].alias(n) for c, n in keep.items())).mapInArrow(run, ", ".join([*kinds, "v binary"]))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """The integer vectors of a column v, one in each row."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i4").reshape(-1, size).astype(np.int64)


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row to every centre."""
    if not len(x) or not len(centres):
        return np.zeros((len(x), len(centres)), dtype=np.int64)
    most = int(max(np.abs(x).max(), np.abs(centres).max()))
    if 4 * x.shape[1] * most * most < 1 << 53:  # then all sums are whole numbers that doubles hold
        a, c = x.astype(np.float64), centres.astype(np.float64)
        return (np.einsum("ij,ij->i", a, a)[:, None] - 2 * (a @ c.T) + np.einsum("ij,ij->i", c, c)[None, :]).astype(np.int64)
    out = np.empty((len(x), len(centres)), dtype=np.int64)
    for j, c in enumerate(centres):
        difference = x - c
        out[:, j] = np.einsum("ij,ij->i", difference, difference)
    return out


class Additions:
    """What a task adds to running sums: for each centre, the number and the component sums of its vectors."""

    def __init__(self, centres: int, size: int, counters: int = 0) -> None:
        self.centres, self.size = centres, size
        self.sums = np.zeros((centres, size + 1), dtype=np.int64)
        self.counters = np.zeros(counters, dtype=np.int64)

    def add(self, at: np.ndarray, x: np.ndarray, sign: int = 1) -> None:
        """Vectors x come to the centres ``at``, or leave them if sign is -1."""
        if not len(at):
            return
        self.sums[:, 0] += sign * np.bincount(at, minlength=self.centres)
        for j in range(self.size):  # doubles hold such sums of a batch exactly
            self.sums[:, j + 1] += sign * np.bincount(at, weights=x[:, j], minlength=self.centres).astype(np.int64)

    def cells(self) -> tuple[np.ndarray, np.ndarray]:
        """Cells that change, and by how much: a row of sums for each centre, then the counters."""
        flat = np.concatenate([self.sums.ravel(), self.counters])
        at = np.flatnonzero(flat)
        return at, flat[at]


class Running:
    """Running sums, kept as a table of (cell, value) that each round's additions are merged into."""

    def __init__(self, centres: int, size: int, counters: int = 0) -> None:
        self.centres, self.size, self.counters = centres, size, counters
        self.table: DataFrame | None = None

    def merge(self, passed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Adds the additions of a pass; gives the sums by centre (number first) and the counters."""
        new = passed.filter("cell IS NOT NULL").select("cell", "value")
        before = self.table
        self.table = written((new if before is None else before.union(new)).groupBy("cell").agg(F.sum("value").alias("value")), "sums")
        if before is not None:
            dropped(before)
        flat = np.zeros(self.centres * (self.size + 1) + self.counters, dtype=np.int64)
        for r in self.table.collect():  # at most one row for each cell of the model
            flat[r.cell] = r.value
        return flat[: self.centres * (self.size + 1)].reshape(self.centres, self.size + 1), flat[self.centres * (self.size + 1) :]


def means(centres: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Componentwise floor of sum / count; centres without vectors stay."""
    used = sums[:, 0] > 0
    out = centres.copy()
    out[used] = sums[used, 1:] // sums[used, :1]
    return out
