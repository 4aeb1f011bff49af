"""Operators on small frames: nulls, ties, empties, and properties."""

import datetime as dt
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.operators.index import Index
from lakeloom.operators import joins, keyed, payloads, search, star, web, windows
from lakeloom.sources import formats
from lakeloom.streaming import events


def test_range_join_equals_the_inequality(spark):
    points = spark.range(200).select((F.col("id") * 1.5 - 50).alias("x"))
    ranges = spark.createDataFrame([(1, -20.0, 30.5), (2, 10.0, 10.0), (3, 100.0, 101.5), (4, 50.0, 40.0)], "r int, low double, high double")
    got = sorted((r.r, r.x) for r in joins.range_join(points, ranges, "x", "low", "high", 7.0).collect())
    want = sorted((r.r, r.x) for r in points.join(ranges, (F.col("x") >= F.col("low")) & (F.col("x") < F.col("high"))).collect())
    assert got == want and got


def test_range_join_gives_pairs_cell_by_cell(spark):
    """Points lie anywhere in their table; rows of one cell come together and in the same order of ranges, so that files of them stay small."""
    points = spark.range(600).select(F.col("id").alias("p"), (F.col("id") * 37 % 100).cast("double").alias("x"))
    ranges = spark.range(90).select(F.col("id").alias("r"), (F.col("id") * 7 % 90).cast("double").alias("low")).withColumn("high", F.col("low") + 8)
    rows = joins.range_join(points, ranges, "x", "low", "high", 8.0).select("p", "x", "r").collect()
    assert len(rows) == 6 * sum(low <= x < low + 8 for x in range(100) for low in range(90))
    runs = [(int(r.x), r.r) for r in rows]
    assert sum(a[0] != b[0] for a, b in zip(runs, runs[1:])) == len({c for c, _ in runs}) - 1
    assert sum(a != b for a, b in zip(runs, runs[1:])) == len(set(runs)) - 1
    lists = {}
    for r in rows:
        lists.setdefault(int(r.x), {}).setdefault(r.r, []).append(r.p)
    assert all(len({tuple(v) for v in of.values()}) == 1 for of in lists.values())


def test_salted_join_equals_the_join(spark):
    a = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 17).alias("k"), "id")
    b = spark.range(40).select((F.col("id") % 20).alias("k"), F.col("id").alias("other"))
    hot = spark.createDataFrame([(0,)], "k long")
    assert sorted(joins.salted_join(a, b, ["k"], hot, 4).collect()) == sorted(a.join(b, "k").collect())


def test_upsert_is_idempotent_and_history_closes(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    change = spark.createDataFrame([(2, "x"), (3, "y")], "k int, v string")
    once = keyed.upsert(base, change, ["k"])
    assert sorted(once.collect()) == sorted(keyed.upsert(once, change, ["k"]).collect()) == [(1, "a"), (2, "x"), (3, "y")]
    rows = spark.createDataFrame([(1, 1, 10), (1, 2, 10), (1, 3, 20)], "k int, id int, t int")
    h = {r.id: (r.valid_from, r.valid_to, r.is_current) for r in keyed.history(rows, ["k"], "t", "id").collect()}
    assert h == {1: (10, 10, False), 2: (10, 20, False), 3: (20, None, True)}
    assert keyed.delete(base, change, ["k"]).collect() == [(1, "a")]


def test_page_parsers_on_broken_markup(spark):
    html = '<title>A &amp; B</title><article><script>var t="</p>"</script><p>x &lt;y&gt; &amp;lt;<p>z<!-- no --></article>'
    df = spark.createDataFrame([(html,), (None,), ("",)], "h string")
    got = [tuple(r) for r in df.select(web.title(F.col("h")), web.article_text(F.col("h"))).collect()]
    assert got[0] == ("A &amp; B", "x <y> &lt; z")
    assert got[1] == (None, None) and got[2] == ("", "")


def test_canonical_addresses(spark):
    df = spark.createDataFrame([("http://M.Site.org/a/?x=1#y",), ("https://www.site.org",), (None,)], "u string")
    assert [r[0] for r in df.select(web.canonical(F.col("u"))).collect()] == ["https://site.org/a", "https://site.org", None]


def test_quarantine_tells_bad_payloads(spark):
    df = spark.createDataFrame([('{"a": 1}',), ('{"a": 1',), (None,), ("[]",)], "p string")
    assert [r.is_valid for r in payloads.quarantined(df, "p").collect()] == [True, False, False, True]


def test_bm25_orders_by_frequency_and_ties_by_id(spark, tmp_path):
    def built(docs):
        return Index.build(docs.withColumns({"lang": F.lit("en"), "source": F.lit("s")}), f"{tmp_path}/{len(list(tmp_path.iterdir()))}")

    df = spark.createDataFrame([(3, "cat dog"), (1, "cat cat dog"), (2, "cat dog"), (4, "bird"), (5, "")], "doc_id long, text string")
    assert [r.doc_id for r in search.bm25(built(df), ["cat"], 10).collect()] == [1, 2, 3]
    assert search.bm25(built(df.repartition(7)), ["cat"], 10).collect() == search.bm25(built(df.coalesce(1)), ["cat"], 10).collect()
    assert search.bm25(built(df), ["none"], 5).count() == 0


def test_groups_frame(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 1, 2), (1, 5, 4), (1, 9, 8)], "g int, o int, v int")
    got = [(r.v, r.s) for r in windows.over_peer_groups(df, ["g"], "o", 1, 0, F.col("v"), "s").orderBy("v").collect()]
    assert got == [(1, 3), (2, 3), (4, 7), (8, 12)]


def test_registry_refuses_unknown_sources(spark, small):
    with pytest.raises(ValueError):
        formats.read_sources(spark, small, ["web", "nowhere"])
    with pytest.raises(ValueError):
        formats.read_sources(spark, small, [])


def test_late_events_are_dropped_after_the_watermark_passes(spark, tmp_path):
    """Rows older than the watermark of the batch before have no effect."""
    base = dt.datetime(2024, 1, 1)
    for hours in [[0, 1], [30, 31], [60], [0, 90]]:  # the filter lags a batch behind the watermark
        rows = [(base + dt.timedelta(hours=h), "view") for h in hours]
        spark.createDataFrame(rows, "ts timestamp, event_type string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    df = spark.readStream.schema("ts timestamp, event_type string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = events.run(events.tumbling(df.withWatermark("ts", "2 hours")), "append")
    counts = {r.begins: r.n for r in out.collect()}
    assert counts.get(base) == 1 and counts[base + dt.timedelta(hours=30)] == 1


def test_events_in_files_out_of_order_are_not_late(spark, tmp_path):
    base, path = dt.datetime(2024, 1, 1), str(tmp_path / "events.parquet")
    for day in (9, 6, 3, 0):
        rows = [(10 * day + k, k % 2, base + dt.timedelta(days=day, minutes=k), ("click", "click", "purchase", "purchase")[k]) for k in range(4)]
        spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, event_type string").coalesce(1).write.mode("append").parquet(path)
    assert sorted(r.event_id for r in events.distinct_stream(spark, str(tmp_path)).collect()) == sorted(10 * d + k for d in (0, 3, 6, 9) for k in range(4))
    assert sorted(tuple(r) for r in events.interval_join(spark, str(tmp_path)).collect()) == sorted((10 * d + k, 10 * d + k + 2) for d in (0, 3, 6, 9) for k in (0, 1))


def test_stream_equals_batch(spark, small):
    batch = events.tumbling(spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
    assert sorted(batch.collect()) == sorted(events.tumbling_stream(spark, small).collect())


def test_filters_and_columns_reach_the_scan(spark, small):
    plan = keyed.changes_since(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThan(o_orderdate" in plan
    plan = star.star_revenue(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "l_tax" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("hint,node", [("broadcast", "BroadcastHashJoin"), ("merge", "SortMergeJoin"), ("shuffle_hash", "ShuffledHashJoin")])
def test_join_strategies_by_hint(spark, small, hint, node):
    orders = spark.read.parquet(f"{small}/orders.parquet")
    customer = spark.read.parquet(f"{small}/customer.parquet").hint(hint)
    df = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")
    assert node in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == orders.count()


def test_top_k_and_group_limits_stay_in_their_tasks(spark, small):
    assert "TakeOrderedAndProject" in star.top_suppliers(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in star.top_orders(spark, small)._jdf.queryExecution().executedPlan().toString()


def test_partition_filter_prunes_folders(spark, small):
    plan = formats.partitioned(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(o_orderstatus" in plan


def test_duplicate_query_names_are_refused():
    from lakeloom.plans.registry import Registry

    r = Registry()
    r.query("x")(lambda s, d: None)
    with pytest.raises(ValueError):
        r.query("x")(lambda s, d: None)


def test_count_min_sketch_never_counts_too_few(spark, small):
    from lakeloom.operators import aggregates

    users = np.array([-5, 2**40] + [r.user_id for r in spark.read.parquet(f"{small}/events.parquet").select("user_id").collect()])
    sketch = spark.createDataFrame([(int(u),) for u in users], "user_id long").agg(F.count_min_sketch("user_id", F.lit(0.01), F.lit(0.95), F.lit(7)).alias("s")).first().s
    asked = np.array([*np.unique(users), 10**9])
    for u, n in zip(asked, aggregates.count_estimates(bytes(sketch), asked), strict=True):
        assert (users == u).sum() <= n <= (users == u).sum() + 0.05 * len(users)


def test_an_empty_stream_gives_no_rows(spark, tmp_path):
    spark.createDataFrame([], "event_id long, user_id long, ts timestamp_ntz, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    for query in (events.tumbling_stream, events.upsert_sink, events.distinct_stream):
        assert query(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", ["s4_boolean", "s5_phrase", "s7_facets"])
def test_searches_read_the_buckets_of_their_terms_only(spark, small, name):
    plan = search.registry.queries[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan and re.search(r"PartitionFilters: \[[^\]]*bucket", plan)


def test_steps_run_in_order_and_again(spark):
    from lakeloom.plans.steps import run_steps

    tries = []

    def fragile(spark, df):
        tries.append(1)
        if len(tries) < 2:
            raise OSError("once")
        return df.filter("id > 1")

    steps = [("double", lambda spark, df: df.withColumn("id", F.col("id") * 2)), ("fragile", fragile)]
    assert [r.id for r in run_steps(spark, spark.range(3), steps, again=1).orderBy("id").collect()] == [2, 4]
    tries.clear()
    with pytest.raises(RuntimeError, match="fragile"):
        run_steps(spark, spark.range(3), steps)
    with pytest.raises(ValueError):
        run_steps(spark, spark.range(1), [steps[0], steps[0]])
