"""Every registered query that has SQL agrees with it; the others give rows."""

import pytest

from quarry.catalog import ORACLES, QUERIES
from tests.compare import connect, rows_of, rows_of_sql

SF = "/root/testdata/sf0.001"
#: Queries whose ids lie beyond the smallest tables there.
MAY_BE_EMPTY = {"a07_low_value", "t05_oversized"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    names, want = rows_of_sql(con, ORACLES[name])
    assert sorted(df.columns) == names
    assert rows_of(df) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).limit(1).count() >= (0 if name in MAY_BE_EMPTY else 1)
