"""Every registered query of the candle engine against its SQL."""

from __future__ import annotations

import pytest

from quillon.plans import corpus, files, market, validation
from tests.conftest import TESTDATA, assert_same

ALL = {name: x for registry in (market.REGISTRY, validation.REGISTRY, corpus.REGISTRY, files.REGISTRY) for name, x in registry.items()}


@pytest.mark.parametrize("name", sorted(n for n, (_, statement) in ALL.items() if statement))
def test_against_sql(spark, name):
    plan, statement = ALL[name]
    folder = f"{TESTDATA}/sf0.001"
    assert_same(plan(spark, folder), statement, folder)


@pytest.mark.parametrize("name", sorted(n for n, (_, statement) in ALL.items() if not statement))
def test_without_sql(spark, name):
    assert ALL[name][0](spark, f"{TESTDATA}/sf0.001").count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
