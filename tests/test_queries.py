import os

import pytest
from helpers import SF, rows, sql_rows

from sedimenta.plans import registry

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, name):
    got = rows(registry.queries()[name](spark, SF).toPandas())
    if name in registry.oracles():
        want = sql_rows(registry.oracles()[name])
        assert got[0] == want[0]
        assert got[1] == want[1]


def test_every_oracle_has_a_query():
    assert set(registry.oracles()) <= set(registry.queries())
