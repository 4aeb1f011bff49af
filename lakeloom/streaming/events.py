"""Event-time processing, each as a transform that takes a batch or a stream alike.

``run`` drains a stream of the events table, part by part in order of time, into Parquet folders of its
batches, and is what the registered queries use, so results come from the streaming engine and
never pass the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lakeloom.operators.lake import LakeTable
from lakeloom.plans.registry import Registry
from lakeloom.sources.formats import scratch, version
from lakeloom.sources.tables import table

registry = Registry()

LATENESS = "2 hours"


#: Parts, and so micro-batches, that the registered queries read the events in; rows of one of a part's files.
PARTS, FILE_ROWS = 2, 1_000_000
_written: dict[tuple, tuple[str, int]] = {}


def stream(spark: SparkSession, d: str, columns: list[str], parts: int = PARTS, cuts: tuple[str, ...] = (), latest_first: bool = False, closing: str = "", file_rows: int = FILE_ROWS) -> DataFrame:
    """The events as a stream; ``ts`` becomes a zoned timestamp, as watermarks need one.

    The events are written as parts, one after the other in order of time, each a micro-batch: where late rows are dropped,
    no order of files may make rows late. A part has several files, as many as every other part, written by as many tasks.
    ``cuts`` are the days between parts, by default even shares; ``latest_first`` turns their order around; ``closing`` is how long after
    the last event one of user -1 follows in a part of its own. The parts are kept for other queries of the session.
    """
    source = table(spark, d, "events")
    key = (spark.sparkContext.applicationId, version(spark, f"{d}/events.parquet"), d, parts, cuts, latest_first, closing, file_rows)
    if key not in _written:
        _written[key] = _parts(source, parts, cuts, latest_first, closing, file_rows)
    path, files = _written[key]
    df = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", files).parquet(path)
    return df.withColumn("ts", F.col("ts").cast("timestamp")).select(*columns)


def _parts(source: DataFrame, parts: int, cuts: tuple[str, ...], latest_first: bool, closing: str, file_rows: int) -> tuple[str, int]:
    """A folder of the parts' files, and how many files a part has."""
    path = scratch(source.sparkSession, "event-files")
    at = F.unix_micros(F.col("ts").cast("timestamp")).cast("double")
    between = [F.unix_micros(F.lit(c).cast("timestamp")) for c in cuts] or source.select(at.alias("at")).approxQuantile("at", [k / parts for k in range(1, parts)], 0.01)
    number = sum((F.when(at > c, 1).otherwise(0) for c in between), F.lit(0))
    sizes = {r.k: r.n for r in source.groupBy(number.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each part
    files = max(1, min(sizes.values(), default=0) // file_rows)
    for k in sorted(sizes, reverse=latest_first):
        source.filter(number == k).repartition(files).write.mode("append").parquet(path)
    if not sizes:
        source.write.parquet(path)
    elif closing:
        last = source.agg((F.max("ts") + F.expr(f"INTERVAL {closing}")).alias("ts")).withColumn("user_id", F.lit(-1).cast("long"))  # one row
        last.select(*(F.col(c) if c in ("ts", "user_id") else F.lit(None).cast(source.schema[c].dataType).alias(c) for c in source.columns)).write.mode("append").parquet(path)
    return path, files


def drained(df: DataFrame, mode: str, write: Callable[[DataFrame, int], None]) -> list[int]:
    """The numbers of the batches that a stream gives until its input is used up; each is written as it comes."""
    done: list[int] = []

    def each(batch: DataFrame, number: int) -> None:
        write(batch, number)
        done.append(number)

    q = df.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", scratch(df.sparkSession, "stream")).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return sorted(set(done))


def run(df: DataFrame, mode: str) -> DataFrame:
    """Everything that the stream gives; in complete mode its last batch holds it all."""
    path = scratch(df.sparkSession, "batches")
    numbers = drained(df, mode, lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/v={n}"))
    if mode == "complete":
        numbers = numbers[-1:]
    folders = [f"{path}/v={n}" for n in numbers]
    return df.sparkSession.read.schema(df.schema).parquet(*folders) if folders else df.sparkSession.createDataFrame([], df.schema)


def tumbling(df: DataFrame, width: str = "1 hour") -> DataFrame:
    """Counts in windows side by side."""
    return df.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("begins"), "event_type", "n")


def sliding(df: DataFrame, width: str = "6 hours", step: str = "3 hours") -> DataFrame:
    """Counts in overlapping windows."""
    return df.groupBy(F.window("ts", width, step).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("begins"), "n")


def sessions(df: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """A user's events with no gap of that length."""
    s = df.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("s.start").cast("timestamp_ntz").alias("begins"), "n")


def distinct(df: DataFrame) -> DataFrame:
    """The first event of each id; state is kept only as long as duplicates may come."""
    return df.dropDuplicatesWithinWatermark(["event_id"]) if df.isStreaming else df.dropDuplicates(["event_id"])


def _batch(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@registry.query(
    "e1_tumbling",
    "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS begins, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2",
)
def tumbling_stream(spark: SparkSession, d: str) -> DataFrame:
    """In complete mode the last result holds every window."""
    df = tumbling(stream(spark, d, ["ts", "event_type"]).withWatermark("ts", LATENESS))
    return run(df, "complete")


@registry.query(
    "e2_sliding",
    """
SELECT begins, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT unnest([time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 3 HOUR]) AS begins FROM events) AS t GROUP BY 1
""",
)
def sliding_stream(spark: SparkSession, d: str) -> DataFrame:
    return run(sliding(stream(spark, d, ["ts"]).withWatermark("ts", LATENESS)), "complete")


@registry.query(
    "e3_sessions",
    """
SELECT user_id, min(ts) AS begins, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s
  FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) AS a) AS b GROUP BY user_id, s
""",
)
def session_stream(spark: SparkSession, d: str) -> DataFrame:
    return run(sessions(stream(spark, d, ["ts", "user_id"]).withWatermark("ts", LATENESS)), "complete")


@registry.query("e4_distinct", "SELECT event_id, user_id, ts FROM events")
def distinct_stream(spark: SparkSession, d: str) -> DataFrame:
    """Every event sent twice comes out once."""
    df = stream(spark, d, ["ts", "user_id", "event_id"])
    twice = df.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).withWatermark("ts", LATENESS)
    return run(distinct(twice), "append").select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@registry.query(
    "e5_interval_join",
    """
SELECT c.event_id AS click, p.event_id AS purchase FROM events c JOIN events p ON c.user_id = p.user_id AND p.ts > c.ts AND p.ts <= c.ts + INTERVAL 1 HOUR
WHERE c.event_type = 'click' AND p.event_type = 'purchase'
""",
)
def interval_join(spark: SparkSession, d: str) -> DataFrame:
    """E5: purchases within an hour of a click; watermarks on both sides bound what is kept."""
    clicks = stream(spark, d, ["ts", "user_id", "event_id", "event_type"]).filter("event_type = 'click'")
    clicks = clicks.select(F.col("event_id").alias("click"), F.col("user_id").alias("u1"), F.col("ts").alias("t1")).withWatermark("t1", LATENESS)
    bought = stream(spark, d, ["ts", "user_id", "event_id", "event_type"]).filter("event_type = 'purchase'")
    bought = bought.select(F.col("event_id").alias("purchase"), F.col("user_id").alias("u2"), F.col("ts").alias("t2")).withWatermark("t2", LATENESS)
    on = F.expr("u1 = u2 AND t2 > t1 AND t2 <= t1 + INTERVAL 1 HOUR")
    return run(clicks.join(bought, on).select("click", "purchase"), "append")


@registry.query("e6_stream_static", "SELECT event_id, c_mktsegment FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'purchase'")
def stream_static(spark: SparkSession, d: str) -> DataFrame:
    events = stream(spark, d, ["event_id", "user_id", "event_type"]).filter("event_type = 'purchase'")
    joined = events.join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("user_id") == F.col("c_custkey"))
    return run(joined.select("event_id", "c_mktsegment"), "append")


class Streaks(StatefulProcessor):
    """Per user, the longest run of one event type and the run at hand; the state is two values."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("run", "kind string, length long, longest long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kind, length, longest = self.state.get() if self.state.exists() else (None, 0, 0)
        every = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        for k in every["event_type"]:
            length = length + 1 if k == kind else 1
            kind, longest = k, max(longest, length)
        self.state.update((kind, length, longest))
        yield pd.DataFrame({"user_id": [key[0]], "longest": [longest]})

    def close(self) -> None:
        pass


@registry.query(
    "e7_stateful_streaks",
    """
SELECT user_id, CAST(max(n) AS BIGINT) AS longest FROM (SELECT user_id, g, count(*) AS n FROM (
  SELECT user_id, sum(CASE WHEN event_type = before THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT *, lag(event_type, 1, '') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) AS a) AS b GROUP BY 1, 2) AS c GROUP BY 1
""",
)
def streaks(spark: SparkSession, d: str) -> DataFrame:
    """A custom stateful operator; each batch gives a user's record so far, and the greatest is the last."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        df = stream(spark, d, ["ts", "user_id", "event_id", "event_type"])
        out = run(df.groupBy("user_id").transformWithStateInPandas(Streaks(), "user_id long, longest long", "Update", "none"), "update")
    finally:
        spark.conf.set(key, before)
    return out.groupBy("user_id").agg(F.max("longest").alias("longest"))


@registry.query(
    "e8_upsert_sink",
    "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) AS t WHERE r = 1",
)
def upsert_sink(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each user after all batches, in a keyed table of which a batch rewrites the files of its users.

    The ordering value is an event's time and id, so an event that comes late changes nothing, nor does a batch that is run again.
    """
    df = stream(spark, d, ["user_id", "ts", "event_id", "event_type"]).withColumn("version", F.struct("ts", "event_id"))
    lake = LakeTable(spark, scratch(spark, "last-events"), df.schema, ("user_id",), "version")
    drained(df, "append", lambda batch, number: lake.upsert(batch))
    return lake.read().select("user_id", "event_id", "event_type")


DAYS = ("2024-01-10", "2024-01-15")


@registry.query("e9_late_events", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-10'")
def late_events(spark: SparkSession, d: str) -> DataFrame:
    """The last days come first and move the watermark, which counts a batch later: the days of the
    second batch still pass, those of the third come too late and are dropped."""
    df = stream(spark, d, ["ts", "event_id"], cuts=DAYS, latest_first=True).withWatermark("ts", LATENESS)
    return run(distinct(df), "append").select("event_id")


def split_late(path: str, width: str, lateness: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that counts rows by window and sets those apart that the watermark rejects, in folders of each batch.

    The watermark is the greatest time of the batches before the last one, less the lateness, as the engine's own
    filter of late rows has it; a row is late if its window had ended by then. A batch that is run again writes the same folders again.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.agg(F.max("ts").alias("mark")).write.mode("overwrite").parquet(f"{path}/marks/v={number}")
        before = [f"{path}/marks/v={k}" for k in range(number - 1)]
        mark = spark.read.schema("mark timestamp").parquet(*before).agg(F.max("mark").alias("mark")).first().mark if before else None  # one row a batch
        rows = batch.withColumn("_w", F.window("ts", width))
        late = F.coalesce(F.col("_w.end") <= F.lit(mark).cast("timestamp") - F.expr(f"INTERVAL {lateness}"), F.lit(False))
        rows.filter(~late).groupBy(F.col("_w.start").alias("begins")).agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/windows/v={number}")
        rows.filter(late).select(F.col("_w.start").alias("begins"), *batch.columns).write.mode("overwrite").parquet(f"{path}/late/v={number}")

    return write


def reconciled(spark: SparkSession, path: str) -> DataFrame:
    """begins, on_time, late and n of every window: its counts with those of the rows set apart."""
    windows = spark.read.schema("begins timestamp, n long").parquet(f"{path}/windows").select("begins", F.col("n").alias("on_time"), F.lit(0).cast("long").alias("late"))
    late = spark.read.schema("begins timestamp").parquet(f"{path}/late").select("begins", F.lit(0).cast("long").alias("on_time"), F.lit(1).cast("long").alias("late"))
    both = windows.unionByName(late).groupBy("begins").agg(F.sum("on_time").alias("on_time"), F.sum("late").alias("late"))
    return both.withColumn("n", F.col("on_time") + F.col("late"))


@registry.query(
    "e10_late_reconciled",
    f"""
SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS begins, CAST(count(*) FILTER (ts > TIMESTAMP '{DAYS[0]}') AS BIGINT) AS on_time,
  CAST(count(*) FILTER (ts <= TIMESTAMP '{DAYS[0]}') AS BIGINT) AS late, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1
""",
)
def late_reconciled(spark: SparkSession, d: str) -> DataFrame:
    """Hours whose late events lie in a side table and are added to them in the end; as in ``e9``, the first days come last."""
    path = scratch(spark, "late")
    if not drained(stream(spark, d, ["ts", "event_id"], cuts=DAYS, latest_first=True), "append", split_late(path, "1 hour", LATENESS)):
        return spark.createDataFrame([], "begins timestamp_ntz, on_time long, late long, n long")
    return reconciled(spark, path).withColumn("begins", F.col("begins").cast("timestamp_ntz"))


class Visits(StatefulProcessor):
    """Per user, the open visits (their begins, ends and numbers of events, as one value) and a timer for the end of the first.

    Visits are merged as events come, in any order: two belong together if they are less than ``gap`` apart. When the
    watermark has passed a visit's end by the gap, nothing can join it, and it is given out and forgotten. A user's
    state is read and written once a batch and once a timer; it has a visit for each ``gap`` of time at most.
    """

    def __init__(self, gap: int) -> None:
        self.gap = gap  # microseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.visits = handle.getValueState("visits", "begins array<long>, ends array<long>, counts array<long>, timer long")

    def _due(self, end: int) -> int:
        return -(-(end + self.gap) // 1000)  # timers have milliseconds

    def _open(self) -> tuple[list[np.ndarray], int]:
        begins, ends, counts, timer = self.visits.get() if self.visits.exists() else ([], [], [], -1)
        return [np.asarray(x, dtype=np.int64) for x in (begins, ends, counts)], timer

    def _keep(self, visits: list[np.ndarray], timer: int) -> None:
        """Writes the state, with a timer for the first visit's end in place of the one before."""
        if not len(visits[0]):
            self.visits.clear()
            return
        due = self._due(int(visits[1][0]))
        if due != timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.visits.update((*(x.tolist() for x in visits), due))

    def _merged(self, visits: list[np.ndarray]) -> list[np.ndarray]:
        begins, ends, counts = (x[np.argsort(visits[0], kind="stable")] for x in visits)
        ends = np.maximum.accumulate(ends)
        first = np.flatnonzero(np.concatenate([[True], begins[1:] >= ends[:-1] + self.gap]))
        return [begins[first], ends[np.append(first[1:], len(ends)) - 1], np.add.reduceat(counts, first)]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        visits, timer = self._open()
        for part in rows:  # no more than a part of a key's rows is held
            at = part["at"].to_numpy(dtype=np.int64)
            visits = self._merged([np.concatenate([x, y]) for x, y in zip(visits, (at, at, np.ones_like(at)), strict=True)])
        self._keep(visits, timer)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        visits, _ = self._open()
        over = -(-(visits[1] + self.gap) // 1000) <= now
        self._keep([x[~over] for x in visits], -1)  # the timer at hand goes by itself
        if over.any():
            begins, ends, counts = (x[over] for x in visits)
            yield pd.DataFrame({"user_id": np.full(len(begins), key[0]), "begin": begins, "end": ends, "n": counts})

    def close(self) -> None:
        pass


@registry.query(
    "e11_visits_by_timers",
    """
SELECT user_id, min(ts) AS begins, max(ts) AS ends, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s
  FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) AS a) AS b GROUP BY user_id, s
""",
)
def visits(spark: SparkSession, d: str) -> DataFrame:
    """Visits that event-time timers give out over four micro-batches; an event two days on closes the last ones."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        df = stream(spark, d, ["ts", "user_id"], parts=3, closing="2 DAYS").withColumn("at", F.unix_micros("ts")).withWatermark("ts", LATENESS)
        grouped = df.groupBy("user_id").transformWithStateInPandas(Visits(6 * 3600 * 1_000_000), "user_id long, begin long, end long, n long", "Append", "eventTime")
        out = run(grouped, "append")
    finally:
        spark.conf.set(key, before)
    time = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return out.filter("user_id >= 0").select("user_id", time("begin").alias("begins"), time("end").alias("ends"), "n")
