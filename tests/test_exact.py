"""Queries that sketches, histograms, limits or distances made differ from their SQL on larger or other tables."""

import numpy as np
import pytest
from compare import rows_of, rows_of_sql

from lakeloom.operators import aggregates, rollups
from lakeloom.plans import catalog


@pytest.fixture(scope="module")
def many_users(spark, tmp_path_factory):
    """Events of more users than sketches hold exactly."""
    path = str(tmp_path_factory.mktemp("many"))
    df = spark.range(0, 60_000, 1, 8).selectExpr("id AS event_id", "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(id % 10) AS ts", "(id * 7919) % 21001 AS user_id", "array('click', 'view')[id % 2] AS event_type", "CAST((id * 37) % 5003 AS DOUBLE) / 100 AS value", "'{}' AS props")
    df.write.parquet(f"{path}/events.parquet")
    return path


def same_as_sql(spark, name, path):
    import duckdb

    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{path}/events.parquet/*.parquet')")
        found = con.execute(catalog.ORACLES[name])
        names = [x[0] for x in found.description]
        want = sorted(map(repr, found.fetchall()))
    assert want and want == sorted(repr(tuple(r)) for r in catalog.QUERIES[name](spark, path).select(*names).collect())


def test_distinct_counts_and_quantiles_beyond_a_sketch_are_exact(spark, many_users, monkeypatch):
    monkeypatch.setattr(aggregates, "THETA", 6, raising=False)
    same_as_sql(spark, "agg_approximate", many_users)
    df = spark.createDataFrame([(g, float(x)) for g in (1, 2, None) for x in np.random.default_rng(1).permutation(5_000)], "g int, v double")
    for low, high in ((1_200.0, 1_300.0), (4_000.0, 4_100.0)):  # the quantile lies there, or doesn't
        ends = spark.createDataFrame([(g, low, high) for g in (1, 2, None)], "g int, low double, high double")
        assert {(r.g, r.quantile) for r in aggregates.exact_quantile(df, ends, ["g"], "v", 0.25).collect()} == {(g, 1249.0) for g in (1, 2, None)}


def test_counts_of_keys_that_share_all_cells_are_exact(spark, many_users):
    same_as_sql(spark, "agg_count_min", many_users)
    rows = [(g, v) for g in ("a", "b", None) for v in [*range(300), None] for _ in range(1 + (v or 0) % 3)]
    got = {(r.g, r.v): r.n for r in aggregates.exact_counts(spark.createDataFrame(rows, "g string, v long"), "g", "v", 0.05, 0.9).collect()}
    assert got == {k: rows.count(k) for k in set(rows)}


def test_histograms_of_many_tasks_have_a_bin_for_each_value(spark):
    import collections

    for values in (50, 500):  # fewer and more than bins
        rows = [("a", float(x)) for x in np.random.default_rng(2).integers(1, values + 1, 20_000)] + [("b", None), ("b", 1.0), ("c", 0.1 + 0.2), ("c", 0.3)]
        df = spark.createDataFrame(rows, "g string, v double").repartition(16)
        got = [((r.g, r.x), int(r.y)) for r in aggregates.value_counts(df, "g", "v").collect()]
        assert sorted(got, key=repr) == sorted(collections.Counter(rows).items(), key=repr)


def test_users_of_days_beyond_a_sketch_are_exact(spark, many_users, monkeypatch):
    monkeypatch.setattr(rollups, "THETA", 6)
    same_as_sql(spark, "agg_stored_sketches", many_users)


def test_the_limit_of_a_lateral_join_goes_by_its_order(spark, medium):
    plan = catalog.QUERIES["join_lateral"](spark, medium)._jdf.queryExecution().optimizedPlan().toString()
    assert "o_totalprice" in next(x for x in plan.splitlines() if "row_number" in x and "windowspecdefinition" in x).split("windowspecdefinition", 1)[1]
    assert rows_of(catalog.QUERIES["join_lateral"](spark, medium)) == rows_of_sql(catalog.ORACLES["join_lateral"], medium)


def test_sketches_are_not_formed_for_each_distinct_value(spark, small):
    plan = catalog.QUERIES["agg_sketches"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Aggregate(" in x and "keys=[event_type" in x and "event_id" in x.split("functions=")[0] and "sketch" in x]
    exact = {r.event_type: r["count(DISTINCT event_id)"] for r in spark.sql(f"SELECT event_type, count(DISTINCT event_id) FROM parquet.`{small}/events.parquet` GROUP BY 1").collect()}
    assert {r.event_type: r.exact for r in catalog.QUERIES["agg_sketches"](spark, small).collect()} == exact
