"""Every query against its oracle on the smallest tables."""

import pytest

from evidentia import registry
from tests.compare import connect, same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_oracle(spark, name):
    same(registry.queries()[name](spark, SF), connect(SF), registry.oracle_sql()[name])


def test_every_query_has_an_oracle():
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).take(1)
