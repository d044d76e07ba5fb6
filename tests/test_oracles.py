import pytest

from ledgerloom.plans import registry
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_oracle(spark, sf_dir, name):
    assert_same(spark, sf_dir, registry.QUERIES[name], registry.ORACLE_SQL[name])


def test_every_oracle_has_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
