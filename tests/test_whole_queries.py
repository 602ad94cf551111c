"""Queries that put the whole job of their operator to use; their rows are compared with SQL in test_oracles.py."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fleetpulse.operators.filters import FIELD_MAP
from fleetpulse.plans.adapters import events, snapshots
from fleetpulse.plans.catalog import PLANS

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not present")


def test_the_written_table_is_read_back_whole(spark):
    rows = PLANS["write_samples_whole"](spark, SF).collect()
    want = snapshots(spark, SF).select(F.to_date("ts").cast("string"), "name").collect()
    assert len(rows) == len(want) and sorted((r.date, r.name) for r in rows) == sorted(map(tuple, want))
    assert len({r.date for r in rows}) > 20 and len({r.name for r in rows}) == 5


def test_every_pair_is_mapped(spark):
    rows = PLANS["field_map_whole"](spark, SF).collect()
    assert {(r.proto, r.field, r.metric) for r in rows} == {(p, f, m) for p, fields in FIELD_MAP.items() for m, f in fields.items()}
    assert len(rows) == 65 and sum(r.n for r in rows) < events(spark, SF).count()


def test_observed_gaps_come_from_the_connections(spark):
    rows = PLANS["entity_delta_scopes"](spark, SF).collect()
    hour4 = F.floor(F.unix_micros("ts") / (4 * 3_600_000_000))
    assert {(r.tick, r.inode) for r in rows} == {tuple(r) for r in events(spark, SF).select(hour4, "user_id").collect()}
    seen = {(r.host, r.tick) for r in rows}
    across = [r for r in rows if r.delta > 0 and (r.host, r.tick - 1) not in seen]
    assert across, "an increase since the newest dump of the host, with ticks without one between"
