"""Every registered query against its SQL twin, at the smallest scale."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracles import duck, rows_of  # noqa: E402
from fleetpulse.plans.catalog import PLANS  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_a_twin():
    assert set(PLANS) <= set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["event_type", "day", "n", "p50", "p90", "p99", "p999"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    result = con.execute(ORACLES[name])
    assert got == rows_of([d[0] for d in result.description], result.fetchall())
