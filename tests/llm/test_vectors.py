import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import clusters, codes
from lakeloom.llm.queries import QUERIES
from lakeloom.llm.vectors import integer_vectors, matrix, squared

SCHEMA = "vec_id long, embedding array<double>, label int, id string, v string, code string, cell long, cluster string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", 1, "x") for r in rows], SCHEMA).repartition(3)


def kept(rows, scale, size=None):
    out = []
    for i, e, label in rows:
        if e is not None and e and all(x is not None and math.isfinite(x) and abs(math.floor(x * scale)) < 2**27 for x in e) and (size is None or len(e) == size):
            out.append((i, [math.floor(scale * x) for x in e], label))
    return out


def order(row):
    return (row[0] is None, row[0] or 0, np.array(row[1], dtype="<i4").tobytes())


def brute_codes(rows, parts=16, entries=64, rounds=2, scale=256):
    rows = kept(rows, scale)
    rows = [r for r in rows if len(r[1]) == next((len(x[1]) for x in sorted(rows, key=order) if len(x[1]) % parts == 0), -1)]
    if not rows:
        return [], [[]] * parts
    width = len(rows[0][1]) // parts
    cut = [[tuple(r[1][p * width : (p + 1) * width]) for p in range(parts)] for r in rows]
    seeds = sorted(range(len(rows)), key=lambda i: order(rows[i]))[:entries]
    books = [[cut[i][p] for i in seeds] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for turn in range(rounds + 1):
        found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
        if turn < rounds:
            for p in range(parts):
                for k in range(len(seeds)):
                    own = [c[p] for c, f in zip(cut, found, strict=True) if f[p][1] == k]
                    if own:
                        books[p][k] = tuple(sum(x) // len(own) for x in zip(*own, strict=True))
    return sorted(((r[0], tuple(k for _, k in f), sum(d for d, _ in f), r[2]) for r, f in zip(rows, found, strict=True)), key=repr), books


def brute_clusters(rows, k=8, rounds=10, scale=1024, size=64, salt="3:"):
    rows = kept(rows, scale, size)
    seeds = sorted(rows, key=lambda r: (hashlib.sha256(f"{salt}{'null' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], dtype="<i4").tobytes()))[:k]
    centres = [list(r[1]) for r in seeds]
    for turn in range(rounds + 1):
        found = [min((sum((a - b) ** 2 for a, b in zip(r[1], c, strict=True)), i) for i, c in enumerate(centres)) for r in rows]
        if turn < rounds:
            for i in range(len(centres)):
                own = [r[1] for r, f in zip(rows, found, strict=True) if f[1] == i]
                if own:
                    centres[i] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted(((r[0], i, d) for r, (d, i) in zip(rows, found, strict=True)), key=repr), centres


def some(seed, n, size, spread, ids=None):
    r = random.Random(seed)
    bases = [[r.gauss(0, 1) for _ in range(size)] for _ in range(5)]
    rows = []
    for i in range(n):
        base = r.choice(bases)
        rows.append((i if ids is None else r.choice(ids), [round(x + r.gauss(0, spread), 3) for x in base], r.choice([None, 1, 1, 1, 2])))
    return rows


ODD = [
    (1000, None, 1),
    (1001, [], 1),
    (1002, [float("nan")] * 64, 1),
    (1003, [float("inf")] + [0.0] * 63, 1),
    (1004, [None] + [0.0] * 63, 1),
    (1005, [0.5] * 63, None),
    (1006, [0.5] * 65, None),
    (1007, [1e30] + [0.0] * 63, 3),
    (None, [0.25] * 64, None),
    (None, [0.25] * 64, None),
    (7, [-0.0001] * 64, 5),
]


@pytest.mark.parametrize("rows", [some(1, 150, 64, 0.5) + ODD, some(2, 20, 64, 0.3, ids=[1, 2, None]), some(3, 1, 64, 1), ODD[:8], [], some(4, 90, 64, 0.0)])
def test_codes_against_brute_force(spark, rows):
    want, books = brute_codes(rows)
    out, model = codes.compressed(frame(spark, rows))
    assert sorted(((r.id, tuple(r.indexes), r.error, r.label) for r in out.collect()), key=repr) == want
    assert model.entries.tolist() == [[list(e) for e in part] for part in books]
    total = {}
    for _, _, e, label in want:
        total[label] = total.get(label, 0) + e
    both = codes.with_label_errors(out)
    assert {r.label: r.label_error for r in both.collect()} == total and both.count() == len(want)


def test_other_parts_and_entries(spark):
    rows = some(5, 80, 12, 0.4)
    for parts, entries in ((3, 300), (12, 5), (1, 4)):
        out, _ = codes.compressed(frame(spark, rows), parts=parts, entries=entries, rounds=3)
        assert sorted(((r.id, tuple(r.indexes), r.error, r.label) for r in out.collect()), key=repr) == brute_codes(rows, parts, entries, 3)[0]


def test_many_labels_join_without_a_broadcast(spark, monkeypatch):
    rows = some(6, 60, 16, 0.4)
    out, _ = codes.compressed(frame(spark, rows), entries=4)
    few = sorted(tuple(r) for r in codes.with_label_errors(out).select("id", "label_error").collect())
    monkeypatch.setattr(codes, "BROADCAST", 1)
    assert sorted(tuple(r) for r in codes.with_label_errors(out).select("id", "label_error").collect()) == few


def test_only_changed_parts_are_added(spark, small):
    out, model = codes.compressed(spark.read.parquet(f"{small}/embeddings.parquet"))
    assert model.changed[0] == 500 * 16 and 0 < model.changed[1] < 500 * 16 // 2
    vectors = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding")
    both = codes.decoded(out, model).join(vectors, F.col("id") == F.col("vec_id")).collect()
    assert len(both) == 500 and sum(np.square(np.subtract(r.vector, r.embedding)).sum() for r in both) < 500 * 0.6


@pytest.mark.parametrize("near", [0, 1, 3, 7, 20])
def test_clusters_against_brute_force(spark, near):
    rows = some(7, 160, 64, 0.7) + ODD
    want, centres = brute_clusters(rows, rounds=5)
    out, model = clusters.clustered(frame(spark, rows), near=near, rounds=5)
    assert sorted(((r.id, r.cluster, r.distance) for r in out.collect()), key=repr) == want
    assert model.centroids.tolist() == centres


@pytest.mark.parametrize(
    "rows",
    [
        [],
        ODD[:7],
        some(8, 3, 64, 1),
        some(9, 40, 64, 0.0),
        [(i, [float(i % 3 == j % 3) for j in range(64)], 0) for i in range(40)],
        [(i, [0.0] * 64, 0) for i in range(12)] + [(i, [(1 if i % 2 else -1) / 1024.0] * 64, 0) for i in range(12, 40)],
        [(i, [1e5 * (i % 7), -1e5] + [float(i)] * 62, 0) for i in range(50)],
    ],
)
def test_clusters_of_ties_copies_and_extremes(spark, rows):
    want, centres = brute_clusters(rows, rounds=3)
    out, model = clusters.clustered(frame(spark, rows), rounds=3)
    assert sorted(((r.id, r.cluster, r.distance) for r in out.collect()), key=repr) == want
    assert model.centroids.tolist() == centres
    both = clusters.with_inertia(out, model).collect()
    per = {}
    for _, i, d in want:
        per[i] = per.get(i, 0) + d
    assert all(r.cluster_inertia == per[r.cluster] and r.inertia == sum(per.values()) for r in both) and len(both) == len(want)


def test_bounds_spare_scans(spark):
    rows = some(11, 600, 64, 0.2)
    out, model = clusters.clustered(frame(spark, rows), k=12)
    assert sorted(((r.id, r.cluster, r.distance) for r in out.collect()), key=repr) == brute_clusters(rows, k=12)[0]
    assert model.rounds[0]["all"] == 600
    late = model.rounds[-3:]
    assert sum(r["bounds"] + r["own"] for r in late) > 10 * sum(r["all"] for r in late)
    assert all(sum(v for k, v in r.items() if k != "moved") == 600 for r in model.rounds)


def test_queries_on_the_smallest_tables(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    want, centres = brute_clusters(rows)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    got = QUERIES["op13_drake_clusters"](spark, small).collect()
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=repr) == want and all(r.centroid_sha256 == digest[r.cluster] for r in got)


def test_exact_distances_of_large_components():
    r = np.random.default_rng(1)
    for most in (10, 2**20, 2**27 - 1):
        x, c = r.integers(-most, most, (20, 64)), r.integers(-most, most, (5, 64))
        assert squared(x, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q, strict=True)) for q in c] for p in x]


def test_integer_vectors_keep_columns(spark):
    df = spark.createDataFrame([(1, [0.5, -0.001], "a"), (2, None, "b"), (3, [1.0], "c")], "k int, e array<float>, v string")
    rows = integer_vectors(df, "e", 1024, {"k": "k"}).orderBy("k").collect()
    assert [(r.k, np.frombuffer(r.v, "<i4").tolist()) for r in rows] == [(1, [512, -2]), (3, [1024])]
    assert matrix(pa.array([rows[0].v]), 2).tolist() == [[512, -2]]
