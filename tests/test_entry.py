"""Every query of the core runs on the smallest tables and agrees with its SQL."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.oracle import differences

SMALL = "/root/testdata/sf0.001"
CORE = {name for m in entry.MODULES if not m.__name__.startswith("tidewell.llm") for name in m.QUERIES}
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, name):
    if name in entry.oracle_sql():
        mine, theirs, a, b = differences(spark, name, SMALL)
        assert (mine, a, b) == (theirs, [], [])
    else:
        assert entry.queries()[name](spark, SMALL).collect() is not None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
