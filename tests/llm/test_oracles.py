import pytest

from fieldglass.llm import queries
from tests.compare import differences, duck


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_its_sql(spark, sf_dir, name):
    assert differences(spark, duck(sf_dir), sf_dir, queries.queries()[name], queries.oracle_sql()[name]) is None
