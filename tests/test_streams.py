"""Streams in parts of several files, rejected rows set apart, timers; and stored sketches."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lakeloom.operators.rollups import DailySketches
from lakeloom.streaming import events


def test_parts_have_as_many_files_as_their_rows_ask_for(spark, small):
    n = spark.read.parquet(f"{small}/events.parquet").count()
    df = events.stream(spark, small, ["event_id", "ts"], parts=2, file_rows=n // 9)
    path, files = events._written[next(k for k in events._written if k[1:3] and k[-1] == n // 9 and k[3] == 2)]
    assert files >= 3
    found = spark.read.parquet(path).select("event_id", F.input_file_name().alias("f"))
    assert found.select("f").distinct().count() == 2 * files and found.count() == n
    sizes = []
    events.drained(df, "append", lambda batch, k: sizes.append((batch.count(), batch.agg(F.max("ts")).first()[0])))
    assert len(sizes) == 2 and sum(s for s, _ in sizes) == n and sizes[0][1] < sizes[1][1]  # a micro-batch is a part


def test_rows_set_apart_are_those_that_the_engine_rejects(spark, small, tmp_path):
    """The engine's own windows, in update mode, end with the counts of what was on time."""
    df = events.stream(spark, small, ["ts", "event_id"], cuts=events.DAYS, latest_first=True)
    windows = df.withWatermark("ts", events.LATENESS).groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    engine = events.run(windows.select(F.col("w.start").alias("begins"), "n"), "update").groupBy("begins").agg(F.max("n").alias("n"))
    path = f"file://{tmp_path}/late"
    events.drained(events.stream(spark, small, ["ts", "event_id"], cuts=events.DAYS, latest_first=True), "append", events.split_late(path, "1 hour", events.LATENESS))
    got = events.reconciled(spark, path)
    assert sorted((r.begins, r.on_time) for r in got.collect() if r.on_time) == sorted((r.begins, r.n) for r in engine.collect())
    assert got.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{small}/events.parquet").count() and got.agg(F.sum("late")).first()[0] > 100


def test_a_batch_that_is_run_again_changes_nothing(spark, small, tmp_path):
    path = f"file://{tmp_path}/late"
    write = events.split_late(path, "1 hour", events.LATENESS)

    def twice(batch, number):
        write(batch, number)
        write(batch, number)

    events.drained(events.stream(spark, small, ["ts", "event_id"], cuts=events.DAYS, latest_first=True), "append", twice)
    assert events.reconciled(spark, path).agg(F.sum("n")).first()[0] == spark.read.parquet(f"{small}/events.parquet").count()


def test_timers_give_visits_out_over_several_batches(spark, tmp_path):
    """Visits that a part's end cuts are joined, those out of order merge, and each comes out once."""
    minute = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    times = {1: [0, 10, 400, 405, 2000, 2300, 2500, 5000], 2: [700, 1000, 1350, 1400], 3: [4999], 4: [0, 360, 719, 1079]}
    rows = [(i, minute(m), u) for i, (u, m) in enumerate((u, m) for u, ms in times.items() for m in ms)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted((r.user_id, (r.begins - minute(0)).total_seconds() / 60, (r.ends - minute(0)).total_seconds() / 60, r.n) for r in events.visits(spark, str(tmp_path)).collect())
    want = []
    for u, ms in times.items():
        runs = [[ms[0]]]
        for m in ms[1:]:
            if m - runs[-1][-1] >= 360:
                runs.append([])
            runs[-1].append(m)
        want += [(u, r[0], r[-1], len(r)) for r in runs]
    assert got == sorted(want)


def test_visits_come_out_before_the_last_batch(spark, small):
    given = []
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        df = events.stream(spark, small, ["ts", "user_id"], parts=3, closing="2 DAYS").withColumn("at", F.unix_micros("ts")).withWatermark("ts", events.LATENESS)
        out = df.groupBy("user_id").transformWithStateInPandas(events.Visits(6 * 3600 * 1_000_000), "user_id long, begin long, end long, n long", "Append", "eventTime")
        events.drained(out, "append", lambda batch, k: given.append(batch.count()))
    finally:
        spark.conf.set(key, before)
    assert sum(n > 0 for n in given) >= 3 and len(given) >= 4


def test_last_events_are_kept_by_user(spark, small):
    got = {r.user_id: r.event_id for r in events.upsert_sink(spark, small).collect()}
    want = {}
    for r in sorted(spark.read.parquet(f"{small}/events.parquet").collect(), key=lambda r: (r.ts, r.event_id)):
        want[r.user_id] = r.event_id
    assert got == want


def test_sketches_answer_for_any_days(spark, tmp_path):
    day = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(days=int(i))
    r = np.random.default_rng(1)
    rows = [(day(d), int(u), float(x)) for d, u, x in zip(r.integers(0, 10, 30_000), r.integers(0, 9_000, 30_000), r.normal(size=30_000), strict=True)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, u long, x double")
    sketches = DailySketches(spark, f"{tmp_path}/s").add(df.filter("hash(u) % 2 = 0"), "ts", "u", "x").add(df.filter("hash(u) % 2 <> 0"), "ts", "u", "x")
    for first, last in ((0, 9), (2, 2), (3, 7)):
        got = sketches.between(str(day(first).date()), str(day(last).date()), [0.1, 0.5, 0.9]).first()
        own = [(u, x) for t, u, x in rows if day(first) <= t <= day(last)]
        users, values = len({u for u, _ in own}), np.sort([x for _, x in own])
        assert got.n == len(own) and abs(got.users - users) <= 0.05 * users and abs(got.users_hll - users) <= 0.05 * users
        for q, x in zip((0.1, 0.5, 0.9), got.amounts, strict=True):
            assert abs(np.searchsorted(values, x) / len(values) - q) <= 0.02
    few = sketches.between("2024-01-03", "2024-01-03").first()
    assert few.users == len({u for t, u, _ in rows if t == day(2)})  # exact while a sketch holds every user
    plan = sketches.between("2024-01-03", "2024-01-03")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(day)" in plan
    assert sketches.between("2030-01-01", "2030-01-02").count() == 0


def test_a_users_visits_are_read_and_written_once_a_batch():
    calls, timers = [], set()

    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, value):
            calls.append("update")
            self.held = value

        def clear(self):
            self.held = None

    class Handle:
        def getValueState(self, name, schema):  # noqa: N802
            return Value()

        def registerTimer(self, at):  # noqa: N802
            timers.add(at)

        def deleteTimer(self, at):  # noqa: N802
            timers.discard(at)

    class Times:
        def getCurrentWatermarkInMs(self):  # noqa: N802
            return 1_000_000

        getExpiryTimeInMs = getCurrentWatermarkInMs  # noqa: N815

    visits = events.Visits(1_000_000)
    visits.init(Handle())
    at = np.arange(0, 1000) * 10_000_000  # each event is a visit of its own
    list(visits.handleInputRows((1,), iter([pd.DataFrame({"at": at[500:]}), pd.DataFrame({"at": at[:500] + 1})]), Times()))
    list(visits.handleInputRows((1,), iter([pd.DataFrame({"at": at + 2})]), Times()))
    assert len(calls) <= 4 and timers == {1001}
    over = pd.concat(visits.handleExpiredTimer((1,), Times(), Times()))
    assert len(over) == 100 and over["n"].tolist() == [2] * 100 and (over["end"] - over["begin"]).tolist() == [1] * 100
