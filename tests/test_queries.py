"""Every registered query against its SQL on the smallest tables."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as contract
from ledgerleaf.catalogue import QUERIES
from tests.compare import difference

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_sql(spark, name):
    assert difference(spark, SF_DIR, name) is None


@pytest.mark.parametrize("name", QUERIES)
def test_plan_stays_in_the_engine(spark, name):
    """No Python worker, no cross or nested-loop join, no single-partition shuffle of rows."""
    df = QUERIES[name].run(spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in ("Python", "CartesianProduct", "NestedLoop", "Exchange SinglePartition"):
        assert node not in plan


def test_contract(spark):
    assert set(QUERIES) <= set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0


def test_a_library_of_the_other_operators_may_be_missing():
    """Without one that only the training-data operators need, all queries of this catalogue are there."""
    code = (
        "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; "
        f"assert set({sorted(QUERIES)!r}) <= set(e.queries())"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, timeout=120).returncode == 0
