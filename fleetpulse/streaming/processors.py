"""State machines of the streaming operators: one small state per key.

Rows of a key wait in state until the watermark has passed them and are then
applied in (us, tie) order, so the micro-batch a row arrives in makes no
difference; a timer reads only what has passed, run by run. Rows behind the watermark never reach a processor: Spark drops and
counts them. State is what arrived within the delay, and the machine's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fleetpulse.operators.spacing import _next_kept


def _ordered(rows: Iterator[pd.DataFrame], columns: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(columns, kind="stable").reset_index(drop=True)


def _with_key(frame: pd.DataFrame, names: list[str], key: tuple) -> pd.DataFrame:
    for name, value in zip(names, key, strict=True):
        frame[name] = value
    return frame


def _passed_ms(us: int) -> int:
    """The first watermark that has passed a time."""
    return -(-us // 1000)


class InOrder(StatefulProcessor):
    """Hold rows until the watermark passes them, then advance one state in event-time order.

    ``advance`` gets the state (None at first) and the passed rows in order and gives the new
    state (None to drop it) and output. ``deadline`` names the time at which a state ends
    although no row comes, and ``lapse`` what that gives.

    Rows wait in runs: sorted pieces of a batch of at most ``RUN`` rows, each one entry of a map
    state under its first time. A timer reads the entries that begin before the watermark, one
    after another, and advances the state up to where the next one begins. So what a key holds
    beyond the watermark is not read, and no more than the runs of one instant are in memory at once.
    """

    RUN = 4096
    waits = "us bigint, tie bigint"
    keeps = "us bigint"

    def __init__(self, keys: list[str]):
        self.keys = keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = [field.split()[0] for field in self.waits.split(", ")]
        lists = ", ".join("{} array<{}>".format(*field.split()) for field in self.waits.split(", "))
        self.waiting = handle.getMapState("runs", "us bigint, serial bigint", lists)
        self.state = handle.getValueState("state", self.keeps)
        self.due = handle.getValueState("due", "ms bigint, serial bigint")

    def handleInputRows(self, key, rows, timerValues):
        due, serial = self._plan()
        old, earliest = due, None
        for frame in rows:
            if not len(frame):
                continue
            held = frame.sort_values(["us", "tie"], kind="stable")
            for at in range(0, len(held), self.RUN):
                serial += 1
                first = self._hold(held.iloc[at:at + self.RUN], serial)
                earliest = first if earliest is None else min(earliest, first)
            out = self.at_once(frame)
            if out is not None:
                yield _with_key(out, self.keys, key)
        if earliest is not None:
            due = _passed_ms(earliest) if due is None else min(due, _passed_ms(earliest))
            self._wake(old, due, serial)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        _, serial = self._plan()
        runs = sorted(self.waiting.keys())
        begun = [r for r in runs if r[0] <= passed]
        state = tuple(self.state.get()) if self.state.exists() else None
        ready, first_left = None, runs[len(begun)][0] if len(begun) < len(runs) else None
        for n, run in enumerate(begun):
            frame = pd.DataFrame(dict(zip(self.names, self.waiting.getValue(run), strict=True)))
            self.waiting.removeKey(run)
            later = frame[frame["us"] > passed]
            if len(later):
                serial += 1
                first = self._hold(later, serial)
                first_left = first if first_left is None else min(first_left, first)
            frame = frame[frame["us"] <= passed]
            ready = frame if ready is None or not len(ready) else pd.concat([ready, frame], ignore_index=True)
            until = begun[n + 1][0] if n + 1 < len(begun) else None
            now = ready if until is None else ready[ready["us"] < until]
            if len(now):
                ready = ready[ready["us"] >= until] if until is not None else None
                state, out = self.advance(state, now.sort_values(["us", "tie"], kind="stable").reset_index(drop=True))
                if out is not None and len(out):
                    yield _with_key(out, self.keys, key)
        end = None if state is None else self.deadline(state)
        if end is not None and end < passed:
            out = self.lapse(state)
            state = end = None
            if out is not None and len(out):
                yield _with_key(out, self.keys, key)
        if state is None:
            self.state.clear()
        else:
            self.state.update(state)
        wakes = [] if first_left is None else [_passed_ms(first_left)]
        wakes += [] if end is None else [end // 1000 + 1]
        if wakes:
            self._wake(None, min(wakes), serial)
        else:
            self.due.clear()

    def _plan(self) -> tuple[int | None, int]:
        """The time of the next timer and the number of the last run."""
        return tuple(self.due.get()) if self.due.exists() else (None, 0)

    def _hold(self, rows: pd.DataFrame, serial: int) -> int:
        """Store a sorted run; its first time."""
        first = int(rows["us"].iloc[0])
        self.waiting.updateValue((first, serial), tuple(rows[c].tolist() for c in self.names))
        return first

    def _wake(self, old: int | None, ms: int, serial: int) -> None:
        if old != ms:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(ms)
        self.due.update((ms, serial))

    def at_once(self, frame: pd.DataFrame) -> pd.DataFrame | None:
        return None

    def advance(self, state: tuple | None, rows: pd.DataFrame) -> tuple[tuple | None, pd.DataFrame | None]:
        raise NotImplementedError

    def deadline(self, state: tuple) -> int | None:
        return None

    def lapse(self, state: tuple) -> pd.DataFrame | None:
        return None

    def close(self) -> None:
        pass


class KeptChain(InOrder):
    """Counter readings at least a gap apart, with the reading kept before each."""

    waits = "us bigint, tie bigint, value bigint"
    keeps = "us bigint, value bigint"

    def __init__(self, keys: list[str], gap_us: int, forget_us: int | None = None):
        super().__init__(keys)
        self.gap, self.forget = gap_us, forget_us

    def advance(self, state, rows):
        t, v = rows["us"].to_numpy(np.int64), rows["value"].to_numpy(np.int64)
        following, i, chosen = _next_kept(t, v, self.gap), 0, []
        pt, pv = state or (None, None)
        if pt is not None:
            reach = np.flatnonzero((t - pt >= self.gap) | (v < pv))
            i = int(reach[0]) if len(reach) else len(t)
        while i < len(t):
            chosen.append(i)
            i = int(following[i])
        if not chosen:
            return state, None
        out = pd.DataFrame({"us": t[chosen], "value": v[chosen]})
        out["prev_us"] = pd.array([pt, *t[chosen[:-1]].tolist()], dtype="Int64")
        out["prev_value"] = pd.array([pv, *v[chosen[:-1]].tolist()], dtype="Int64")
        return (int(t[chosen[-1]]), int(v[chosen[-1]])), out

    def deadline(self, state):
        return None if self.forget is None else state[0] + self.forget


class Expiry(InOrder):
    """Pass readings on; when a series falls silent, one more row says so."""

    waits = "us bigint, tie bigint"
    keeps = "us bigint"

    def __init__(self, keys: list[str], stale_us: int):
        super().__init__(keys)
        self.stale = stale_us

    def _silent(self, times) -> pd.DataFrame:
        return pd.DataFrame({"us": np.asarray(times, np.int64) + self.stale, "total": 0, "expired": True})

    def at_once(self, frame):
        return pd.DataFrame({"us": frame["us"], "total": frame["total"], "expired": False})

    def advance(self, state, rows):
        times = rows["us"].to_numpy(np.int64)
        times = times if state is None else np.concatenate((state, times))
        return (int(times[-1]),), self._silent(times[:-1][np.diff(times) > self.stale])

    def deadline(self, state):
        return state[0] + self.stale

    def lapse(self, state):
        return self._silent(state)


class Durations(InOrder):
    """Time between an entry and the next leave, booked to the state named on entry."""

    waits = "us bigint, tie bigint, action string, state string"
    keeps = "us bigint, state string"

    def __init__(self, keys: list[str], forget_us: int | None = None):
        super().__init__(keys)
        self.forget = forget_us

    def advance(self, state, rows):
        done = []
        for us, action, name in zip(rows["us"].tolist(), rows["action"].tolist(), rows["state"].tolist(), strict=True):
            if action == "enter":
                state = (us, name)
            elif action == "leave":
                if state is not None:
                    done.append((state[1], state[0], us, max(us - state[0], 0)))
                state = None
        return state, pd.DataFrame(done, columns=["state", "entered_us", "left_us", "us"])

    def deadline(self, state):
        return None if self.forget is None else state[0] + self.forget


class Pairs(InOrder):
    """First pending start to the next end; a destroy, or silence, clears it."""

    waits = "us bigint, tie bigint, action string"
    keeps = "us bigint"

    def __init__(self, keys: list[str], timeout_us: int | None):
        super().__init__(keys)
        self.timeout = timeout_us

    def advance(self, state, rows):
        since, done = None if state is None else state[0], []
        for us, action in zip(rows["us"].tolist(), rows["action"].tolist(), strict=True):
            if since is not None and self.timeout is not None and us > since + self.timeout:
                since = None
            if action == "start":
                since = us if since is None else since
            elif action in ("end", "destroy"):
                if action == "end" and since is not None:
                    done.append((us, us - since))
                since = None
        return None if since is None else (since,), pd.DataFrame(done, columns=["end_us", "us"])

    def deadline(self, state):
        return None if self.timeout is None else state[0] + self.timeout


class ConfigHistory(StatefulProcessor):
    """Differences between a host's adjacent configuration snapshots."""

    def __init__(self, keys: list[str]):
        self.keys = keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("config", "key string", "value string")
        self.at = handle.getValueState("snapshot", "snapshot bigint")

    def handleInputRows(self, key, rows, timerValues):
        frame = _ordered(rows, ["snapshot"])
        known = {k[0]: v[0] for k, v in self.state.iterator()} if self.state.exists() else None
        last = self.at.get()[0] if self.at.exists() else None
        changes = []
        for snapshot, pairs in zip(frame["snapshot"].tolist(), frame["config"].tolist(), strict=True):
            if last is not None and snapshot <= last:
                continue
            fresh = {p["key"]: p["value"] for p in pairs}
            if known is not None:
                changes += [(snapshot, k, known[k], v) for k, v in fresh.items() if k in known and known[k] != v]
            known, last = fresh, snapshot
        held = {k[0]: v[0] for k, v in self.state.iterator()} if self.state.exists() else {}
        for gone in held.keys() - known.keys():
            self.state.removeKey((gone,))
        for k, v in known.items():
            if held.get(k) != v:
                self.state.updateValue((k,), (v,))
        self.at.update((last,))
        if changes:
            yield _with_key(pd.DataFrame(changes, columns=["snapshot", "key", "old_value", "new_value"]), self.keys, key)

    def close(self) -> None:
        pass
