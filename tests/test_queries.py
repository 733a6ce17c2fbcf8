import pytest

import __spark_entry__ as entry
from fieldglass import parsed_queries, queries
from tests.compare import differences, duck


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(spark, con, sf_dir, name):
    assert differences(spark, con, sf_dir, queries.QUERIES[name], queries.ORACLES[name]) is None


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["scan_id", "device", "interface", "entry_count"] and df.count() > 0


def test_registry_of_queries():
    assert parsed_queries.Scans is queries.Scans
    assert set(entry.oracle_sql()) <= set(entry.queries())
