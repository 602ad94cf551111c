"""Rows waiting in runs: what a timer reads, and that the runs' size makes no difference."""

import random

import numpy as np
import pandas as pd
import pytest

from fleetpulse.streaming.processors import Durations, Expiry, KeptChain, Pairs


class Value:
    def __init__(self):
        self.row = None

    def exists(self):
        return self.row is not None

    def get(self):
        return self.row

    def update(self, row):
        self.row = row

    def clear(self):
        self.row = None


class Map:
    def __init__(self):
        self.held, self.read = {}, []

    def keys(self):
        return iter(random.Random(len(self.held)).sample(sorted(self.held), len(self.held)))

    def getValue(self, key):
        self.read.append(key)
        return self.held[key]

    def updateValue(self, key, value):
        assert key not in self.held
        self.held[key] = value

    def removeKey(self, key):
        del self.held[key]


class Handle:
    """One key's state and timers, held here."""

    def __init__(self):
        self.timers = set()

    def getMapState(self, name, key, value):
        self.map = Map()
        return self.map

    def getValueState(self, name, value):
        return Value()

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.remove(ms)


class Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def play(machine, batches, delay_ms=2000):
    """Feed batches as Spark does: rows first, then the timers the watermark has passed."""
    handle, out, newest, mark = Handle(), [], 0, 0
    machine.init(handle)
    for frame in [*batches, None]:
        if frame is None:
            mark = 10**9
        else:
            out += list(machine.handleInputRows(("k",), iter([frame]), Watermark(mark)))
            newest = max(newest, int(frame["us"].max()) // 1000)
            mark = max(mark, newest - delay_ms)
        for _ in range(3):
            due = [ms for ms in handle.timers if ms <= mark]
            handle.timers -= set(due)
            for _ in due:
                out += list(machine.handleExpiredTimer(("k",), Watermark(mark), None))
        if frame is not None:
            assert all(us <= mark * 1000 for us, _ in handle.map.read), "no run is read before its time"
            assert all(us > mark * 1000 for us, _ in handle.map.held), "nothing passed is left"
            assert all(len(v[0]) <= machine.RUN for v in handle.map.held.values())
    assert not handle.map.held and len(handle.timers) <= 1
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame()


def table(seed, n=600):
    rnd, t, rows = random.Random(seed), 0, []
    for i in range(n):
        t += rnd.choice([0, 0, 500, 3000, 40_000])
        rows.append((t, i, rnd.randint(0, 1000), rnd.choice(["start", "end", "enter", "leave"]), rnd.choice(["x", None]), 1))
    arrived = sorted(rows, key=lambda r: r[0] + rnd.randint(0, 1_500_000))
    frame = pd.DataFrame(arrived, columns=["us", "tie", "value", "action", "state", "total"])
    return [frame.iloc[k:k + 60].reset_index(drop=True) for k in range(0, n, 60)]


@pytest.mark.parametrize("make", [lambda: KeptChain(["k"], 10_000), lambda: Expiry(["k"], 30_000), lambda: Durations(["k"]), lambda: Pairs(["k"], None)])
@pytest.mark.parametrize("run", [1, 7, 4096])
def test_runs_of_any_size_give_one_answer(make, run):
    for seed in range(3):
        batches = table(seed)
        whole = make()
        whole.RUN = 10**6
        want = play(whole, [pd.concat(batches, ignore_index=True)])
        machine = make()
        machine.RUN = run
        got = play(machine, batches)
        columns = sorted(want.columns)
        as_rows = lambda f: sorted(map(repr, f[columns].astype(object).where(f[columns].notna(), None).values.tolist()))
        assert len(want) and as_rows(got) == as_rows(want)


def test_a_timer_leaves_later_runs_unread():
    machine, handle = KeptChain(["k"], 1), Handle()
    machine.RUN = 10
    machine.init(handle)
    frame = pd.DataFrame({"us": np.arange(1000) * 1000, "tie": np.arange(1000), "value": np.arange(1000)})
    list(machine.handleInputRows(("k",), iter([frame]), Watermark(0)))
    out = pd.concat(list(machine.handleExpiredTimer(("k",), Watermark(54), None)))
    assert out["us"].tolist() == (np.arange(55) * 1000).tolist()
    assert len(handle.map.read) == 6 and len(handle.map.held) == 95
    assert 55 in handle.timers
