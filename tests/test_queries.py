"""Every catalog query against its SQL, on the two smaller sizes of the tables."""

from __future__ import annotations

import compare
import pytest

import __spark_entry__ as entry
from heliograph.plans import registry


FOLDERS = ("/root/testdata/sf0.001", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def ducks():
    return {at: compare.connect(at) for at in FOLDERS}


@pytest.mark.parametrize("at", FOLDERS)
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, ducks, name, at):
    got = registry.QUERIES[name](spark, at).toPandas()
    assert compare.difference(got, ducks[at].execute(registry.ORACLES[name]).fetchdf()) is None


def test_entry_and_names(spark):
    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
