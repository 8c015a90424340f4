"""Every catalogued query against its SQL on the smallest tables."""

import pytest

import compare
from kerbline.plans.catalog import CATALOG


@pytest.fixture(scope="module")
def con(small_sf):
    return compare.connect(small_sf)


@pytest.mark.parametrize("name", list(CATALOG))
def test_query_matches_sql(spark, small_sf, con, name):
    run, sql = CATALOG[name]
    got = compare.spark_rows(run(spark, small_sf))
    assert sql is not None
    assert compare.difference(got, compare.sql_rows(con, sql)) is None


def test_entry_is_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == [
        "pickup_borough", "dropoff_borough", "total_trips", "total_distance_miles", "total_revenue"
    ]
    assert set(entry.oracle_sql()) <= set(entry.queries())
