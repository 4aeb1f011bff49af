"""Centroid clustering in exact integers with adaptive distance bounds (Drake and Hamerly, "Accelerated k-means
with adaptive distance bounds", 2012).

Each vector keeps an upper bound of the distance to its centroid, lower bounds for its next few centroids,
and one lower bound for all that remain. When centroids move, bounds widen by how far they moved. While the
upper bound is below all others, the vector needs no distance; then, in turn, its own distance is computed,
those of the few stored centroids if the remainder bound rules out the rest, and all of them. Bounds are
doubles rounded outwards and must differ strictly, so every decision, ties included, is that of exact
integer distances.

State lies with the vectors in a table that each round writes to the shared folder; sums of centroids change
only by what vectors that moved add and take off, summed in each task.

Defined results: rows whose vector is null, of another length than ``size``, or holds a component
that is null, not finite or of 2**17 or more in magnitude (whose squared distances no long would hold), are dropped. A null id is hashed
as ``null``; among equal ids the vector's bytes decide. With fewer vectors than centroids there are as many centroids as
vectors; a table without vectors gives no rows. Equal vectors get equal clusters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import dropped, written
from lakeloom.llm.vectors import Additions, Running, integer_vectors, matrix, means, squared

CENTROIDS, ROUNDS, SCALE, SIZE, SALT = 8, 10, 1024, 64, "3:"
#: Centroids beside a vector's own that have a bound each.
NEAR = 3
_UP, _DOWN = 1 + 2.0**-50, 1 - 2.0**-50
#: How vectors were decided: by their bounds, after their own distance, by the stored centroids, by all.
KINDS = ("bounds", "own", "stored", "all")


@dataclass
class Clusters:
    """centroids, and for each round how many vectors were decided in which way and how many moved."""

    centroids: np.ndarray
    rounds: list[dict[str, int]]

    def digest(self, i: int) -> str:
        return hashlib.sha256(",".join(map(str, self.centroids[i].tolist())).encode()).hexdigest()


def state_type(near: int) -> np.dtype:
    return np.dtype([("own", "<i4"), ("upper", "<f8"), ("near", "<i4", (near,)), ("lower", "<f8", (near,)), ("rest", "<f8")])


def scanned(x: np.ndarray, centroids: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
    """State from all distances, and the squared distance to the own centroid."""
    d = squared(x, centroids)
    order = np.argsort(d, axis=1, kind="stable")  # ties by the smaller number
    sorted_d = np.take_along_axis(d, order, axis=1)
    out = np.zeros(len(x), dtype=state_type(near))
    out["own"], out["upper"] = order[:, 0], np.sqrt(sorted_d[:, 0]) * _UP
    out["near"], out["lower"] = order[:, 1 : near + 1], np.sqrt(sorted_d[:, 1 : near + 1]) * _DOWN
    out["rest"] = np.sqrt(sorted_d[:, near + 1]) * _DOWN if near + 1 < len(centroids) else np.inf
    return out, sorted_d[:, 0]


def moved_bounds(state: np.ndarray, moves: np.ndarray) -> None:
    """Widens the bounds, in place, by how far centroids moved."""
    state["upper"] = (state["upper"] + moves[state["own"]]) * _UP
    state["lower"] = np.maximum(state["lower"] - moves[state["near"]], 0) * _DOWN
    state["rest"] = np.maximum(state["rest"] - moves.max(initial=0), 0) * _DOWN


def reassigned(x: np.ndarray, state: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Brings state up to date with the centroids, in place; gives how each vector was decided (an index of KINDS).

    The second result is the exact squared distance to the own centroid where it was computed, else -1.
    """
    near = state["near"].shape[1]
    how, exact = np.zeros(len(x), dtype=np.int64), np.full(len(x), -1, dtype=np.int64)

    def least(rows: np.ndarray | slice) -> np.ndarray:
        return np.minimum(state["lower"][rows].min(axis=1, initial=np.inf), state["rest"][rows])

    open_ = np.flatnonzero(state["upper"] >= least(slice(None)))
    difference = x[open_] - centroids[state["own"][open_]]
    exact[open_] = np.einsum("ij,ij->i", difference, difference)
    state["upper"][open_] = np.sqrt(exact[open_]) * _UP
    how[open_] = 1
    open_ = open_[state["upper"][open_] >= least(open_)]
    few = state["upper"][open_] < state["rest"][open_]  # then the nearest is the own centroid or a stored one
    some, rest = open_[few], open_[~few]
    if len(some):
        which = np.concatenate([state["own"][some, None], state["near"][some]], axis=1)
        d = np.empty(which.shape, dtype=np.int64)
        d[:, 0] = exact[some]
        for j in range(1, near + 1):
            difference = x[some] - centroids[which[:, j]]
            d[:, j] = np.einsum("ij,ij->i", difference, difference)
        order = np.lexsort((which, d), axis=1)
        which, d = np.take_along_axis(which, order, axis=1), np.take_along_axis(d, order, axis=1)
        part = state[some]
        part["own"], part["upper"] = which[:, 0], np.sqrt(d[:, 0]) * _UP
        part["near"], part["lower"] = which[:, 1:], np.sqrt(d[:, 1:]) * _DOWN
        state[some], exact[some], how[some] = part, d[:, 0], 2
    if len(rest):
        state[rest], exact[rest] = scanned(x[rest], centroids, near)
        how[rest] = 3
    return how, exact


def assigned(table: DataFrame, centroids: np.ndarray, moves: np.ndarray | None, near: int, kinds: str, last: bool = False) -> DataFrame:
    """One pass: every vector with its new state, then the task's additions; the last pass gives distances instead."""
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        added, names, types = Additions(k, size, counters=len(KINDS) + 1), ["id", "v", "state", "cluster", "distance", "cell", "value"], None
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("v"), size)
            if moves is None:
                state, exact = scanned(x, centroids, near)
                how = np.full(len(x), 3)
                added.add(state["own"], x)
                changed = len(x)
            else:
                state = np.frombuffer(b"".join(b.column("state").to_pylist()), dtype=state_type(near)).copy()
                before = state["own"].copy()
                moved_bounds(state, moves)
                how, exact = reassigned(x, state, centroids)
                at = np.flatnonzero(before != state["own"])
                added.add(state["own"][at], x[at])
                added.add(before[at], x[at], -1)
                changed = len(at)
            added.counters += [*np.bincount(how, minlength=len(KINDS)), changed]
            if last and len(open_ := np.flatnonzero(exact < 0)):
                difference = x[open_] - centroids[state["own"][open_]]
                exact[open_] = np.einsum("ij,ij->i", difference, difference)
            rows, types = b.num_rows, b.column("id").type
            stored, width = state.tobytes(), state.dtype.itemsize
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("id"),
                    pa.nulls(rows, pa.binary()) if last else b.column("v"),
                    pa.nulls(rows, pa.binary()) if last else pa.array([stored[width * i : width * (i + 1)] for i in range(rows)], pa.binary()),
                    pa.array(state["own"].astype(np.int32)),
                    pa.array(exact) if last else pa.nulls(rows, pa.int64()),
                    pa.nulls(rows, pa.int64()),
                    pa.nulls(rows, pa.int64()),
                ],
                names=names,
            )
        if types is not None and not last:
            cells, values = added.cells()
            n = len(cells)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(n, t) for t in (types, pa.binary(), pa.binary(), pa.int32(), pa.int64())), pa.array(cells), pa.array(values)], names=names)

    return table.mapInArrow(run, f"{kinds}, v binary, state binary, cluster int, distance long, cell long, value long")


def clustered(df: DataFrame, id: str = "vec_id", column: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, size: int = SIZE, salt: str = SALT, near: int = NEAR) -> tuple[DataFrame, Clusters]:
    """id, cluster and squared distance of every kept vector, and the final centroids.

    Centroids start as the vectors of the least hashes of their ids, in that order; each round assigns the vectors and
    replaces each centroid that has any by the floor of their mean; then vectors are assigned once more.
    """
    kinds = f"id {df.schema[id].dataType.simpleString()}"
    table = written(integer_vectors(df, column, scale, {id: "id"}, size), "vectors")
    rank = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256)
    seeds = [r.v for r in table.orderBy(rank, "v").limit(k).select("v").collect()]
    centroids = np.frombuffer(b"".join(seeds), dtype="<i4").reshape(-1, size).astype(np.int64)
    near = max(0, min(near, len(seeds) - 1))
    running = Running(len(seeds), size, counters=len(KINDS) + 1)
    told: list[dict[str, int]] = []
    total = np.zeros(len(KINDS) + 1, dtype=np.int64)
    current, moves, before = table.withColumn("state", F.lit(None).cast("binary")), None, table
    for _ in range(rounds if seeds else 0):
        passed = written(assigned(current, centroids, moves, near, kinds), "clusters")
        dropped(before)
        before = passed
        sums, counters = running.merge(passed)
        told.append(dict(zip((*KINDS, "moved"), (counters - total).tolist(), strict=True)))
        total = counters
        new = means(centroids, sums)
        steps = new - centroids
        moves, centroids = np.sqrt(np.einsum("ij,ij->i", steps, steps)) * _UP, new
        current = passed.filter("cell IS NULL")
    if not seeds:
        return table.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), Clusters(centroids, told)
    out = written(assigned(current, centroids, moves, near, kinds, last=True).select("id", "cluster", "distance"), "clusters")
    dropped(before)
    return out, Clusters(centroids, told)


def with_inertia(clusters: DataFrame, model: Clusters) -> DataFrame:
    """The rows with cluster_inertia, inertia and centroid_sha256; there is one total for each centroid."""
    totals = {r.cluster: r.n for r in clusters.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    rows = [(i, totals.get(i, 0), sum(totals.values()), model.digest(i)) for i in range(len(model.centroids))]
    per = clusters.sparkSession.createDataFrame(rows, "_cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return clusters.join(F.broadcast(per), F.col("cluster") == F.col("_cluster")).drop("_cluster")


def oracle(k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, size: int = SIZE, salt: str = SALT) -> str:
    """SQL for unique ids."""
    steps = [
        f"v AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = {size} AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)",
        f"x AS MATERIALIZED (SELECT vec_id, unnest(range({size})) AS j, unnest([CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT) for x in embedding]) AS c FROM v)",
        f"m0 AS MATERIALIZED (SELECT k, j, c FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY sha256('{salt}' || vec_id)) - 1 AS k FROM v QUALIFY k < {k}) USING (vec_id))",
    ]
    for r in range(rounds + 1):
        distances = f"SELECT vec_id, k, sum((x.c - m.c) * (x.c - m.c)) AS d FROM x JOIN m{r} m USING (j) GROUP BY ALL"
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, CAST(min(d * {k} + k) % {k} AS BIGINT) AS k, CAST(min(d * {k} + k) // {k} AS BIGINT) AS d FROM ({distances}) GROUP BY vec_id)")
        if r < rounds:
            sums = f"SELECT k, j, count(*) AS n, sum(c) AS s FROM x JOIN a{r} USING (vec_id) GROUP BY ALL"
            steps.append(f"m{r + 1} AS MATERIALIZED (SELECT k, j, coalesce(CAST((s - ((s % n) + n) % n) // n AS BIGINT), m.c) AS c FROM m{r} m LEFT JOIN ({sums}) s USING (k, j))")
    return f"""WITH {", ".join(steps)},
h AS (SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY j)) AS centroid_sha256 FROM m{rounds} GROUP BY k)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN h USING (k)"""
