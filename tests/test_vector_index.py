"""The inverted file against all cosines: recall of probing, exactness, and what is read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.operators import vector_index as vi


def brute(vectors, queries, k):
    """vectors, queries: id -> vector, or None."""
    unit = {}
    for i, v in vectors.items():
        v = None if v is None or any(x is None for x in v) else np.array(v, dtype=float)
        if v is not None and np.isfinite(v).all() and np.abs(v).max(initial=0) > 0:
            v = v / np.abs(v).max()
            unit[i] = v / np.sqrt((v * v).sum())
    ids = sorted(unit)
    all_ = np.array([unit[i] for i in ids])
    out = []
    for q in queries:
        if q in unit:
            cosines = np.round(all_ @ unit[q], 6) + 0.0
            best = sorted(zip(-cosines, ids, strict=True))[:k]
            out += [(q, rank + 1, i, -c) for rank, (c, i) in enumerate(best)]
    return sorted(out)


def clustered(seed, n, size=16):
    r = np.random.default_rng(seed)
    bases = r.normal(size=(12, size))
    return {int(3 * i): (bases[r.integers(12)] + r.normal(size=size) * 0.3).tolist() for i in range(n)}


def frame(spark, vectors):
    return spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>").repartition(3)


def rows(df):
    return sorted((r.query_id, r["rank"], r.id, round(r.cosine, 6)) for r in df.collect())


@pytest.mark.parametrize("options", [{}, {"part": 7}, {"cells": 1}, {"cells": 40, "sample": 60}])
def test_exact_search_equals_all_cosines(spark, tmp_path, options):
    vectors = clustered(1, 300)
    vectors |= {100_000 + i: vectors[0] for i in range(15)}  # copies, whose ties go by id
    index = vi.VectorIndex.build(frame(spark, vectors), f"{tmp_path}/i", **options)
    queries = {i: v for i, v in vectors.items() if i % 50 == 0}
    want = [(q, r, i, round(c, 6)) for q, r, i, c in brute(vectors, queries, 10)]
    assert rows(index.search(frame(spark, queries), 10, exact=True, probes=1)) == want
    assert sorted(index.rows)[-1] > 0 and sum(index.rows) == len(vectors)


def test_odd_vectors(spark, tmp_path):
    vectors = clustered(2, 40, 4) | {900: None, 901: [], 902: [0.0] * 4, 903: [float("nan")] * 4, 904: [None] * 4, 905: [1.0] * 5, 906: [1e300] * 4, 907: [1e-300, 0.0, 0.0, 0.0], 908: [float("inf"), 0.0, 0.0, 0.0]}
    index = vi.VectorIndex.build(frame(spark, vectors), f"{tmp_path}/i")
    del vectors[905]
    assert rows(index.search(frame(spark, vectors), 3, exact=True)) == [(q, r, i, round(c, 6)) for q, r, i, c in brute(vectors, vectors, 3)]
    nothing = vi.VectorIndex.build(frame(spark, vectors).limit(0), f"{tmp_path}/j")
    assert nothing.search(frame(spark, vectors), 3).count() == 0
    assert rows(index.search(frame(spark, vectors).limit(0), 3, exact=True)) == [] and index.search(frame(spark, vectors), 0).count() == 0
    assert len(rows(index.search(frame(spark, {0: vectors[0]}), 1000, exact=True))) == 42  # fewer rows than asked for


def recall(spark, folder):
    df = vi.table(spark, folder, "embeddings").select("vec_id", "embedding")
    vectors = {r.vec_id: r.embedding for r in df.collect()}
    want = {(q, i) for q, _, i, _ in brute(vectors, [i for i in vectors if i % 50 == 0], 10)}
    got = {(r.query_id, r.vec_id) for r in vi.probed_vectors(spark, folder).collect()}
    return len(want & got) / len(want)


def test_recall_of_probing(spark, small, medium):
    found = recall(spark, small), recall(spark, medium)
    print(found)
    assert min(found) >= 0.9


def test_probing_reads_its_cells_only(spark, tmp_path):
    vectors = clustered(3, 400)
    index = vi.VectorIndex.build(frame(spark, vectors), f"{tmp_path}/i")
    some = index.vectors([1, 2])
    assert some.count() == index.rows[1] + index.rows[2]
    plan = index.search(frame(spark, {0: vectors[0]}), 5, probes=2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    files = {f.split("cell=")[1].split("/")[0] for f in some.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    assert files == {"1", "2"}


def test_a_task_compares_vectors_in_bounded_arrays(monkeypatch):
    import pyarrow as pa

    r = np.random.default_rng(4)
    centres, x = r.normal(size=(40, 8)), r.normal(size=(500, 8))
    lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 8).cast(pa.list_(pa.float64()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(500), pa.int64()), lists], names=["id", "unit"])
    near = lambda: [b for b in vi._in_cells(centres, 24)(iter([batch]))]
    best = lambda: vi._nearest(8, 3)((), pa.Table.from_batches([batch]), pa.Table.from_batches([batch.slice(0, 90)]))
    whole, found = pa.Table.from_batches(near()), best()
    monkeypatch.setattr(vi, "NUMBERS", 4_000, raising=False)
    assert max(len(b.column("unit").flatten()) for b in near()) <= 4_000
    cut = pa.Table.from_batches(near())
    assert cut.drop(["gap"]).equals(whole.drop(["gap"])) and np.allclose(cut["gap"], whole["gap"])
    assert best().drop(["cosine"]).equals(found.drop(["cosine"])) and np.allclose(best()["cosine"], found["cosine"])
