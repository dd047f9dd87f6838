"""Every registered query of the engine against its DuckDB SQL."""

import pytest

from pelagos.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck, same):
    got = QUERIES[name](spark, sf).toPandas()
    if name in ORACLES:
        same(got, duck.execute(ORACLES[name]).df())
    else:
        assert len(got) > 0
