"""Every query of the library against its SQL, over the smallest tables."""

from __future__ import annotations

import pytest

from lodestone.oracles import ORACLES
from lodestone.queries import QUERIES

from .compare import same
from .conftest import SF_DIR


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(name, spark, duck):
    same(QUERIES[name](spark, SF_DIR), duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_gives_rows(name, spark):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_oracles_name_queries():
    assert ORACLES.keys() <= QUERIES.keys()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
