"""Durations are accepted as seconds, ``timedelta`` or text such as ``"100 ms"``."""

from __future__ import annotations

from datetime import timedelta

_UNITS = {
    "us": 1, "microsecond": 1, "microseconds": 1,
    "ms": 1_000, "millisecond": 1_000, "milliseconds": 1_000,
    "s": 1_000_000, "second": 1_000_000, "seconds": 1_000_000,
    "m": 60_000_000, "min": 60_000_000, "minute": 60_000_000, "minutes": 60_000_000,
    "h": 3_600_000_000, "hour": 3_600_000_000, "hours": 3_600_000_000,
    "d": 86_400_000_000, "day": 86_400_000_000, "days": 86_400_000_000,
}


def micros(duration) -> int:
    """Whole microseconds in ``duration``."""
    if isinstance(duration, timedelta):
        return round(duration / timedelta(microseconds=1))
    if isinstance(duration, (int, float)):
        return round(duration * 1_000_000)
    amount = duration.strip().rstrip("abcdefghijklmnopqrstuvwxyz")
    unit = duration.strip()[len(amount):]
    if unit not in _UNITS or not amount.strip():
        raise ValueError(f"not a duration: {duration!r}")
    return round(float(amount) * _UNITS[unit])


def interval_text(duration) -> str:
    """The duration as a Spark interval literal (for watermarks and windows)."""
    return f"{micros(duration)} microseconds"
