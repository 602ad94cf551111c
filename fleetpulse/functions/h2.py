"""Log-linear ("H2") bucket arithmetic as pure column expressions.

A value keeps its ``g + 1`` leading bits; the bucket's inclusive upper bound is
the value with all lower bits set. The number ``p + 1`` of the value's bits gives a
mask ``2^(p+1) - 1``; shifted by ``g + 1`` it is exactly those lower bits, so the
bound needs no logarithm and stays in generated code. The bits are counted in one
step that names the value once: in a branch each repeat of it is worked out anew.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fleetpulse.schema import U64, u64

WINDOW_GROUPING, WINDOW_MAX_POWER = 7, 52
KERNEL_GROUPING, KERNEL_MAX_POWER = 3, 64


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _bits(v: Column) -> Column:
    """Binary digits of a LONG: 1 for zero, 64 for negative values."""
    return F.length(F.bin(v))


def _fill(v: Column, g: int) -> Column:
    """All bits below the value's ``g + 1`` leading ones."""
    mask = F.call_function("shiftrightunsigned", F.lit(-1).cast("bigint"), F.lit(64) - _bits(v))
    return F.shiftright(mask, g + 1)


def h2_clamp(value, max_power: int = WINDOW_MAX_POWER) -> Column:
    """Values beyond the grid count in its top bucket; none is dropped."""
    value = _col(value)
    if max_power >= 64:
        return F.least(value.cast(U64), u64(2**64 - 1))
    return F.least(value, F.lit(2**max_power - 1)).cast("bigint")


def is_clamped(value, max_power: int = WINDOW_MAX_POWER) -> Column:
    return _col(value) > (u64(2**64 - 1) if max_power >= 64 else F.lit(2**max_power - 1))


def h2_bound(value, g: int = WINDOW_GROUPING, n: int = WINDOW_MAX_POWER) -> Column:
    """Inclusive upper bound of the value's bucket (LONG; DECIMAL(20,0) when n is 64)."""
    v = h2_clamp(value, n)
    if n < 64:
        return v.bitwiseOR(_fill(v, g))
    low = F.least(v, u64(2**63 - 1)).cast("bigint")
    step = u64(2 ** (63 - g))
    top = (v - v % step + (step - 1)).cast(U64)
    return F.when(v > F.lit(2**63 - 1), top).otherwise(
        low.bitwiseOR(_fill(low, g)).cast(U64))


def h2_index(value, g: int = WINDOW_GROUPING, n: int = WINDOW_MAX_POWER) -> Column:
    """Position of the value's bucket in a dense array."""
    v = h2_clamp(value, n)
    if n >= 64:
        step = u64(2 ** (63 - g))
        above = (v - u64(2**63)).cast(U64)
        top = F.lit((64 - g) << g) + ((above - above % step) / step).cast("bigint")
        low = F.least(v, u64(2**63 - 1)).cast("bigint")
        return F.when(v > F.lit(2**63 - 1), top).otherwise(_long_index(low, g))
    return _long_index(v, g)


def _long_index(v: Column, g: int) -> Column:
    s = _bits(v) - F.lit(1 + g)
    octave = F.call_function("shiftright", v, s) - F.lit(2**g)
    return F.when(v < F.lit(2 ** (g + 1)), v).otherwise(
        (s + 1).cast("bigint") * F.lit(2**g) + octave)


def h2_bound_of_index(index, g: int = KERNEL_GROUPING, n: int = KERNEL_MAX_POWER) -> Column:
    """Inverse of :func:`h2_index`: the bucket's upper bound."""
    i = _col(index).cast("bigint")
    s = F.least(F.greatest(F.shiftright(i, g) - 1, F.lit(0)), F.lit(62 - g)).cast("int")
    within = i.bitwiseAND(F.lit(2**g - 1)) + F.lit(2**g)
    fill = F.call_function("shiftleft", F.lit(1).cast("bigint"), s) - F.lit(1)
    shifted = F.call_function("shiftleft", within, s).bitwiseOR(fill)
    bound = F.when(i < F.lit(2 ** (g + 1)), i).otherwise(shifted)
    if n < 64:
        return bound
    top_first = (64 - g) << g
    top = ((within + 1).cast(U64) * u64(2 ** (63 - g)) - u64(1)).cast(U64)
    return F.when(i >= F.lit(top_first), top).otherwise(bound.cast(U64))


def h2_bucket_total(g: int, n: int) -> int:
    return (n - g + 1) << g
