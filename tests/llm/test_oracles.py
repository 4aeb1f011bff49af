import pytest
from compare import rows_of, rows_of_sql

from lakeloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small, name):
    names, rows = rows_of(QUERIES[name](spark, small))
    other_names, other = rows_of_sql(ORACLES[name], small)
    assert names == other_names and rows == other and rows


def test_thirteen_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
