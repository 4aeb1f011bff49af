"""Every query of the library against its SQL, and the driver's contract."""

import pytest
from compare import rows_of, rows_of_sql

from lakeloom.plans import catalog


SELECTIVE = {"join_as_of", "join_self"}  # no rows on the smallest tables


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, small, medium, name):
    small = medium if name in SELECTIVE else small
    names, rows = rows_of(catalog.QUERIES[name](spark, small))
    other_names, other = rows_of_sql(catalog.ORACLES[name], small)
    assert names == other_names
    assert rows == other
    assert rows


def test_every_oracle_has_a_query():
    assert catalog.ORACLES.keys() <= catalog.QUERIES.keys()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert e.oracle_sql().keys() <= e.queries().keys()


def test_library_does_not_import_llm():
    import subprocess
    import sys

    code = "import sys; import lakeloom.plans.catalog; assert not [m for m in sys.modules if m.startswith('lakeloom.llm')]"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])


def test_sketches_are_close(spark, medium):
    for r in catalog.QUERIES["agg_sketches"](spark, medium).collect():
        assert abs(r.hll_plus - r.exact) <= 0.1 * r.exact
        assert abs(r.hll - r.exact) <= 0.1 * r.exact
        assert abs(r.theta - r.exact) <= 0.1 * r.exact
        assert abs(r.median - r.kll_median) <= 0.1 * abs(r.median) + 1


def test_samples_have_about_their_share(spark, medium):
    n = spark.read.parquet(f"{medium}/lineitem.parquet").count()
    assert 0.07 * n < catalog.QUERIES["sample_bernoulli"](spark, medium).count() < 0.13 * n
    assert {r.o_orderstatus for r in catalog.QUERIES["sample_stratified"](spark, medium).select("o_orderstatus").distinct().collect()} == {"F", "P"}


def test_split_parts_have_about_their_shares(spark, medium):
    from lakeloom.operators.sets import in_parts

    shares = [0.5, 0.3, 0.2]
    sizes = {r.part: r["count"] for r in in_parts(spark.read.parquet(f"{medium}/orders.parquet"), shares).groupBy("part").count().collect()}
    assert all(abs(sizes[i] / sum(sizes.values()) - shares[i]) < 0.1 * shares[i] for i in range(3))
