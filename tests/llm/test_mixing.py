import math
import re

import pytest
from pyspark.sql import functions as F

from lakeloom.llm import mixing
from lakeloom.llm.queries import QUERIES


def targets_by_rounds(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Shares by weight; what is above a cap goes round again among the others."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        out = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if out[s] > most * sizes[s]]
        if not over:
            return out | capped
        capped |= {s: most * sizes[s] for s in over}


def check(rows):
    sizes, taken, largest = {}, {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r.size)
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
    want = targets_by_rounds(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-6)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1
    return want


def test_targets_and_takes(spark, medium):
    rows = QUERIES["op9_mixing_curriculum"](spark, medium).collect()
    texts = spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text").collect()
    assert {r.doc_id: r.size for r in rows} == {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in texts}
    check(rows)
    assert sorted(rows) == sorted(QUERIES["op9_mixing_curriculum"](spark, medium).collect())


def test_one_source_with_most_rows_and_small_ones(spark):
    rows = [(i, "w " * (i % 9), "big" if i % 3 else f"s{i % 7}") for i in range(500)] + [(1000, "x", None), (1001, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    want = check(got)
    assert want[None] == 2.0


def test_training_order_follows_the_schedule(spark):
    """A source with a falling schedule comes early, one with a rising schedule late; all of a pass come before the next."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"))
    rows = mixing.mix(df).collect()
    mean = {s: sum(r.time_1 for r in rows if r.source == s and r.time_1 is not None) / sum(r.time_1 is not None for r in rows if r.source == s) for s in ("s0", "s1", "s2")}
    assert all(0 <= t <= 1 for r in rows for t in (r.time_1, r.time_2) if t is not None)
    assert all(r.time_2 > r.time_1 for r in rows if r.time_2 is not None)
    assert mean["s2"] > mean["s1"]


def test_times_invert_the_integral(spark):
    c = mixing.Curriculum()
    for i in range(3):
        q = spark.range(101).select((F.col("id") / 100).alias("q"))
        total = c.integrals(i)[-1]
        for r in q.select("q", c.times(i, F.col("q")).alias("t")).collect():
            area, at = 0.0, 0.0
            for k in range(1, len(c.knots)):
                a, b = c.knots[k - 1], c.knots[k]
                upto = min(max(r.t, a), b)
                rate = c.schedules[i][k - 1] + (c.schedules[i][k] - c.schedules[i][k - 1]) * (upto - a) / (b - a)
                area += (upto - a) * (c.schedules[i][k - 1] + rate) / 2
            assert abs(area / total - r.q) < 1e-9


def test_mix_gives_rows_in_order_with_all_columns(spark, messy, empty):
    out = mixing.curriculum(messy.filter("doc_id is not null").dropDuplicates(["doc_id"]))
    assert out.columns == messy.columns
    assert mixing.mix(messy).count() == 9
    assert mixing.mix(empty).count() == mixing.curriculum(empty).count() == 0


def test_rows_without_or_with_repeated_ids_have_places_of_their_own(spark):
    rows = [(None if i % 2 else i % 3, f"w{i} " * (1 + i % 4), ["a", "b", None][i % 3], "t", i) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, time string, _mix_time long").repartition(3)
    want = {}
    for r in mixing.mix(df).collect():
        want[r.source, r.size] = want.get((r.source, r.size), 0) + r.copies
    got = {}
    for r in mixing.curriculum(df).collect():
        got[r.source, len(r.text.split())] = got.get((r.source, len(r.text.split())), 0) + 1
    assert got == {k: v for k, v in want.items() if v}
    assert mixing.curriculum(df).columns == df.columns


def test_texts_are_read_once(spark, small):
    plan = QUERIES["op9_mixing_curriculum"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan


def test_wrong_schedules_are_refused():
    with pytest.raises(ValueError):
        mixing.Curriculum(schedules=((1.0, 1.0, 1.0),))
    with pytest.raises(ValueError):
        mixing.Curriculum(knots=(0.0, 0.7, 0.5))


def test_native_plan(spark, small):
    plan = QUERIES["op9_mixing_curriculum"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
