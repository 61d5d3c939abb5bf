import pytest
from compare import assert_equal, connection

from tellurion.plans import registry


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, sf_dir, con, name):
    assert_equal(spark, con, sf_dir, registry.QUERIES[name], registry.ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
