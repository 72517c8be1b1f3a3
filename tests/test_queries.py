"""Every registered query of the engine against its SQL twin, on the smallest tables."""

from __future__ import annotations

import oracle
import pytest

from conftest import SF
from pairscope.plans import catalogue


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_twin(spark, duck, name):
    assert oracle.compare(spark, duck, catalogue.QUERIES[name], catalogue.ORACLES[name], SF) is None


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 2
    assert set(entry.oracle_sql()) <= set(entry.queries())
