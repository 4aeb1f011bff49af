"""Keyed tables with commits: against a dictionary, and what a change or a read opens."""

import json
import random

import pytest

from lakeloom.operators import lake as lakes
from lakeloom.operators.lake import Conflict, LakeTable

SCHEMA = "k long, v string, t long"


def rows(spark, *r):
    return spark.createDataFrame(list(r), SCHEMA)


@pytest.fixture
def lake(spark, tmp_path):
    return LakeTable(spark, f"file://{tmp_path}/lake", rows(spark, (0, "", 0)).schema, ("k",), "t", file_rows=4)


def now(lake, as_of=None):
    return sorted((tuple(r) for r in lake.read(as_of).collect()), key=repr)


def changed(lake, since):
    return sorted(((r.k, r.v, r._deleted) for r in lake.changes(since).collect()), key=repr)


def test_commits_deletes_and_outdated_rows(spark, lake):
    assert now(lake) == [] and changed(lake, 0) == []
    assert lake.upsert(rows(spark, (1, "a", 1), (2, "b", 1))) == 1
    rows(spark, (9, "lost", 9)).write.parquet(f"{lake.path}/rows/of-a-writer-that-failed")
    assert lake.upsert(rows(spark, (1, "c", 2), (3, None, 1))) == 2 and lake.delete(rows(spark, (2, None, 2))) == 3
    assert lake.upsert(rows(spark, (1, "old", 1), (3, "tie", 1))) == 4
    assert now(lake) == [(1, "c", 2), (3, "tie", 1)]
    assert [r[0] for r in now(lake, 1)] == [1, 2]
    assert changed(lake, 3) == [(3, "tie", False)]  # the outdated row changed nothing
    assert lake.compact() == 5 and now(lake) == [(1, "c", 2), (3, "tie", 1)] and changed(lake, 4) == []
    assert lake.upsert(rows(spark, (2, "back", 3))) == 6 and [r[0] for r in now(lake)] == [1, 2, 3]
    assert changed(lake, 1) == [(1, "c", False), (2, "back", False), (3, "tie", False)]


def test_compaction_keeps_what_was_deleted(spark, lake):
    lake.upsert(rows(spark, (1, "a", 1)))
    lake.delete(rows(spark, (1, None, 3)))
    lake.compact()
    lake.upsert(rows(spark, (1, "stale", 2)))
    assert now(lake) == [] and changed(lake, 2) == [] and changed(lake, 1) == [(1, None, True)]


def test_a_key_that_came_and_went_is_no_change(spark, lake):
    lake.upsert(rows(spark, (1, "a", 1)))
    lake.upsert(rows(spark, (2, "b", 1)))
    lake.delete(rows(spark, (2, None, 2)))
    lake.upsert(rows(spark, (1, "x", 2)))
    lake.upsert(rows(spark, (1, "a", 3)))
    assert changed(lake, 1) == [(1, "a", False)]  # its ordering value differs


def test_what_dead_writers_leave_is_not_read(spark, lake, tmp_path):
    lake.upsert(rows(spark, (1, "a", 1)))
    folder = tmp_path / "lake" / "commits"
    (folder / ".half").write_text('{"number"')
    (folder / "000000000002.json").write_text("")
    assert now(lake) == [(1, "a", 1)]
    assert lake.upsert(rows(spark, (1, "b", 2))) == 3 and now(lake) == [(1, "b", 2)] and now(lake, 2) == [(1, "a", 1)]


def test_a_writer_that_loses_starts_over(spark, lake, monkeypatch):
    lake.upsert(rows(spark, (1, "a", 1)))
    with pytest.raises(Conflict):
        lake._commit(1, "upsert", {}, [])
    commit, other = LakeTable._commit, []

    def late(self, number, *rest):
        if not other:
            other.append(1)
            LakeTable.upsert(self, rows(spark, (1, "first", 5), (2, "first", 5)))
        return commit(self, number, *rest)

    monkeypatch.setattr(LakeTable, "_commit", late)
    assert lake.upsert(rows(spark, (1, "second", 4), (3, "second", 4))) == 3
    assert now(lake) == [(1, "first", 5), (2, "first", 5), (3, "second", 4)]


def test_changes_and_lookups_open_the_files_of_their_keys(spark, lake):
    lake.upsert(rows(spark, *((k, f"v{k}", 1) for k in range(0, 80, 2))))
    before = lake.files()
    assert len(before) == 10 and set(before.values()) == {4}
    found = lake.lookup(rows(spark, (14, "", 0), (15, "", 0)))
    assert [tuple(r) for r in found.collect()] == [(14, "v14", 1)] and len(found.inputFiles()) == 1
    assert lake.files_of(rows(spark, (200, "", 0))) == [] and lake.lookup(rows(spark)).count() == 0
    lake.upsert(rows(spark, (14, "new", 2), (15, "more", 2)))
    after = lake.files()
    assert sum(f not in after for f in before) <= 2 and sum(f in after for f in before) >= 8
    assert lake.lookup(rows(spark, (14, "", 0))).first().v == "new" and len(now(lake)) == 41
    told = lake.changes(1)
    assert len(told.inputFiles()) <= 4 and sorted(r.k for r in told.collect()) == [14, 15]


def test_filters_rule_out_files_whose_range_holds_the_key(spark, lake):
    for turn in range(3):  # ranges overlap
        lake.upsert(rows(spark, *((3 * k + turn, "x", 1) for k in range(4))))
    assert len(lake.files()) >= 1
    counts = [len(lake.files_of(rows(spark, (k, "", 0)))) for k in range(12)]
    assert min(counts) == 1 and sum(counts) <= 16
    assert lake.files_of(rows(spark, (100, "", 0))) == []


def test_many_keys_go_by_ranges_alone(spark, lake, monkeypatch):
    lake.upsert(rows(spark, *((k, "a", 1) for k in range(12))))
    monkeypatch.setattr(lakes, "ASKED", 1)
    lake.upsert(rows(spark, (2, "b", 2), (3, "b", 2)))
    assert [v for _, v, _ in sorted(now(lake))] == ["a", "a", "b", "b"] + ["a"] * 8


def test_against_a_dictionary(spark, tmp_path):
    """Random upserts, late rows, deletes, copies in a batch, null keys and ordering values, and compactions."""
    r = random.Random(4)
    lake = LakeTable(spark, f"file://{tmp_path}/lake", rows(spark, (0, "", 0)).schema, ("k",), "t", file_rows=5)
    state, seen = {}, {0: {}}
    age = lambda t: (t is not None, t or 0)
    for step in range(1, 15):
        kind = r.choice(["upsert", "upsert", "delete", "compact"])
        if kind == "compact" and step > 1:
            assert lake.compact() == step
        else:
            kind = "upsert" if kind == "compact" else kind
            batch = {k: (f"{step}-{k}", r.choice([None, *range(8)])) for k in r.sample([None, *range(15)], 4)}
            older = [(k, "x", None) for k, (_, t) in batch.items() if t is not None]
            assert getattr(lake, kind)(rows(spark, *((k, v, t) for k, (v, t) in batch.items()), *older)) == step
            for k, (v, t) in batch.items():
                if k not in state or age(t) >= age(state[k][1]):
                    state[k] = (None if kind == "delete" else v, t, kind == "delete")
        seen[step] = {k: (v, t) for k, (v, t, gone) in state.items() if not gone}
        assert now(lake) == sorted(((k, v, t) for k, (v, t) in seen[step].items()), key=repr)
    for since in (0, 4, 9, 13):
        assert now(lake, since) == sorted(((k, v, t) for k, (v, t) in seen[since].items()), key=repr)
        want = [(k, seen[14][k][0], False) for k in seen[14] if seen[14][k] != seen[since].get(k)] + [(k, None, True) for k in seen[since] if k not in seen[14]]
        assert changed(lake, since) == sorted(want, key=repr)
    manifests = [json.loads((tmp_path / "lake" / "commits" / f"{n:012d}.json").read_text()) for n in range(1, 15)]
    assert "live" in manifests[9]


def test_keys_of_several_columns(spark, tmp_path):
    schema = "a string, b date, t int, v double"
    make = lambda *x: spark.createDataFrame(list(x), "a string, b string, t int, v double").selectExpr("a", "CAST(b AS DATE) AS b", "t", "v")
    lake = LakeTable(spark, f"file://{tmp_path}/lake", spark.createDataFrame([], schema).schema, ("a", "b"), "t", file_rows=2)
    lake.upsert(make(("x", "2024-01-01", 1, 1.0), ("x", None, 1, 2.0), (None, "2024-01-01", 1, 3.0), ("y", "2024-01-01", 1, 4.0)))
    lake.upsert(make(("x", None, 2, 5.0), (None, "2024-01-01", 0, 6.0)))
    assert sorted(r.v for r in lake.read().collect()) == [1.0, 3.0, 4.0, 5.0]
    assert [r.v for r in lake.lookup(make(("x", None, 0, 0.0))).collect()] == [5.0]


def test_a_filter_takes_keys_in_batches():
    import numpy as np
    import pyarrow as pa

    hashes = np.random.default_rng(3).integers(-(2**63), 2**63, 1_000)
    batches = (pa.RecordBatch.from_arrays([pa.array(hashes[i : i + 100])], names=["hash"]) for i in range(0, 1_000, 100))
    (out,) = lakes._filter((pa.scalar("f"), pa.scalar(1_000)), batches)
    bits = np.zeros(10_000, dtype=bool)
    bits[lakes.bloom_places(hashes, 10_000).ravel()] = True
    assert out.to_pylist() == [{"name": "f", "bloom": np.packbits(bits).tobytes(), "bits": 10_000}]
