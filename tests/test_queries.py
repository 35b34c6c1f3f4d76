"""Every query of the reference's own operators against its DuckDB twin, at the smallest size."""

import oracle
import pytest
from conftest import SMALL

from panelforge.plans import registry


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SMALL)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_twin(spark, con, name):
    assert oracle.differ(registry.QUERIES[name](spark, SMALL), con, registry.ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SMALL).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
