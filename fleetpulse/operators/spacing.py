"""Chains of rows at least a gap apart, for series of any length.

A kept row decides which later row is kept next (the first at least ``min_gap``
later, or the first whose value is lower: a reset), so membership is sequential.
Two facts keep it distributed and exact:

* a row that lies ``min_gap`` or more after its predecessor is kept whatever
  happened before it, so in ordinary data every row is decided by ``lag``, and
  one small row per chunk tells the next chunk how it ended;
* otherwise a chunk of a series is a function from the last kept row before it
  to the last kept row in it, and only rows within two gaps of the chunk's
  start can be that entry. Only such chunks, and their neighbours, go to
  Python: they evaluate the function in parallel, a tree composes the functions
  (:mod:`fleetpulse.operators.composition`), and a second pass replays each chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from fleetpulse.durations import micros
from fleetpulse.operators.chunks import CHUNK, DEFAULT_CHUNK, SEED, seeded
from fleetpulse.operators.composition import compose

_LONGS = ("__t", "__tie", "__v")


def _next_kept(t: np.ndarray, v: np.ndarray, gap: int) -> np.ndarray:
    """For every row, the position of the row kept after it (``len`` if none)."""
    n = len(t)
    later = np.searchsorted(t, t + gap, side="left")
    if gap <= 0:
        later = np.arange(1, n + 1)
    drops = np.flatnonzero(v[1:] < v[:-1]) + 1
    # Only rows with a decrease before their time-based successor can differ.
    first = np.searchsorted(drops, np.arange(n), side="right")
    last = np.searchsorted(drops, later, side="left")
    for i in np.flatnonzero(first < last):
        lower = drops[first[i]:last[i]]
        hit = lower[v[lower] < v[i]]
        if len(hit):
            later[i] = hit[0]
    return later


def _transitions(gap: int, columns: list[str]):
    # Longs with nulls would pass through doubles in pandas, so absence is a flag.
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__halo", "__t", "__tie"], ascending=[False, True, True], kind="stable")
        t, v = pdf["__t"].to_numpy(np.int64), pdf["__v"].to_numpy(np.int64)
        halo = int(pdf["__halo"].sum())
        if halo == len(pdf):
            return pd.DataFrame(columns=[*(f"{c}_out" for c in _LONGS), "__free", "__t_in", "__tie_in", "__before", *columns])
        sync = np.flatnonzero(pdf["__sync"].to_numpy(bool)[halo:])
        following = _next_kept(t, v, gap)
        # leave[i]: the last row of this chunk on the chain through i.
        leave = np.where(following < len(t), following, np.arange(len(t)))
        while True:
            further = leave[leave]
            if np.array_equal(further, leave):
                break
            leave = further
        entries = np.array([halo + sync[-1]]) if len(sync) else np.arange(halo)
        # Chains that start apart mostly meet within a chunk: then the entry makes no difference to its end.
        met = len(np.unique(leave[entries])) == 1
        entries = entries[:1] if met else entries
        out = pdf.iloc[leave[entries]][list(_LONGS)].rename(columns={c: f"{c}_out" for c in _LONGS})
        out["__free"] = met
        out["__t_in"] = t[entries]
        out["__tie_in"] = pdf["__tie"].to_numpy(np.int64)[entries]
        for c in ("__before", *columns):
            out[c] = pdf[c].iloc[-1]
        return out
    return run


def _replay(gap: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__t", "__tie"], kind="stable").reset_index(drop=True)
        t, v = pdf["__t"].to_numpy(np.int64), pdf["__v"].to_numpy(np.int64)
        following = _next_kept(t, v, gap)
        entered = bool(pdf["__entered"].iloc[0])
        i = 0
        if entered:
            pt, pv = int(pdf["__t_prev"].iloc[0]), int(pdf["__v_prev"].iloc[0])
            later = t - pt >= gap
            reach = np.flatnonzero(later | (v < pv))
            i = int(reach[0]) if len(reach) else len(t)
        kept = []
        while i < len(t):
            kept.append(i)
            i = int(following[i])
        out = pdf.iloc[kept].copy()
        if len(kept):
            before_t = [pt if entered else None, *t[kept[:-1]].tolist()]
            before_v = [pv if entered else None, *v[kept[:-1]].tolist()]
            out["__t_prev"] = pd.array(before_t, dtype="Int64")
            out["__v_prev"] = pd.array(before_v, dtype="Int64")
        return out
    return run


def kept_chain(df: DataFrame, keys: Sequence[str], ts: str, min_gap, value: str | None = None,
               tie: str | None = None, chunk=DEFAULT_CHUNK) -> DataFrame:
    """Kept rows with ``prev_us`` and ``prev_value``: the row kept before, null for the first.

    ``value`` (LONG) restarts the chain when it decreases; ``tie`` (LONG) orders
    rows of equal time. Returns keys, ``us``, ``tie``, ``value``, ``prev_us``, ``prev_value``.
    """
    keys = list(keys)
    gap = micros(min_gap)
    if micros(chunk) < 2 * gap:
        raise ValueError("chunk must span at least two gaps")
    rows = df.select(*keys, F.unix_micros(ts).alias("__t"),
                     (F.col(tie) if tie else F.lit(0)).cast("bigint").alias("__tie"),
                     (F.col(value) if value else F.lit(0)).cast("bigint").alias("__v"))
    order = ["__t", "__tie"] if tie else ["__t"]
    both, w = seeded(rows, keys, order, list(_LONGS), micros(chunk))
    lagged = both.select(
        "*", F.lag("__t").over(w).alias("__pt"), F.lag("__v").over(w).alias("__pv"),
        F.lead("__t").over(w).alias("__nt"))
    spaced = lagged.withColumn("__sync", F.coalesce(F.col("__t") - F.col("__pt") >= gap, F.lit(True)))
    opening = F.col("__pt").isNull()
    # A seed is sorted first in its chunk; how the row it copies was decided is known over there.
    after_seed = F.coalesce(F.lag(SEED).over(w), F.lit(False))
    spaced = (spaced.withColumns({"__edge": after_seed, "__before_sync": F.lag("__sync").over(w)})
              .where(~F.col(SEED))
              .withColumns({"__first": F.col("__edge") | opening, "__last": F.col("__nt").isNull(),
                            "__direct": F.col("__sync") & (opening | (~F.col("__edge") & F.coalesce("__before_sync", F.lit(False))))}))

    def out(frame):
        return frame.select(*keys, F.col("__t").alias("us"), F.col("__tie").alias("tie"), F.col("__v").alias("value"),
                            F.col("__pt").alias("prev_us"), F.col("__pv").alias("prev_value"))

    # One row per chunk: its first row, whether its last row is decided, whether any row is not.
    def of_first(c):
        return F.max(F.when(F.col("__first"), F.col(c))).alias(c)

    per_series = Window.partitionBy(*keys).orderBy(CHUNK)
    chunks = spaced.groupBy(*keys, CHUNK).agg(
        *[of_first(c) for c in (*_LONGS, "__pt", "__pv")],
        F.max(F.when(F.col("__first"), F.col("__sync").cast("int"))).alias("__opens"),
        F.max(F.when(F.col("__last"), F.col("__sync").cast("int"))).alias("__ends"),
        F.max((~F.col("__sync")).cast("int")).alias("__dense"))
    chunks = chunks.withColumns({
        "__before": F.coalesce(F.lag(CHUNK).over(per_series), F.lit(-(2**62))),
        "__before_ends": F.lag("__ends").over(per_series), "__after_opens": F.lead("__opens").over(per_series)})
    decided = (F.col("__opens") == 1) & (F.coalesce("__before_ends", F.lit(0)) == 1)
    involved = (F.col("__dense") == 1) | (F.coalesce("__before_ends", F.lit(1)) == 0) | (F.coalesce("__after_opens", F.lit(1)) == 0)
    direct = out(spaced.where("__direct")).unionByName(out(chunks.where(decided)))

    head = F.col("__last") | (F.col("__nt") - F.col("__t") < gap)
    needed = chunks.where(involved).select(*keys, CHUNK, "__before", decided.alias("__decided"))
    held = (spaced.where(~F.col("__direct") | head | F.col("__first"))
            .select(*keys, CHUNK, *_LONGS, "__sync", "__direct", "__first")
            .join(needed, [*keys, CHUNK])
            .withColumn("__direct", F.col("__direct") | (F.col("__first") & F.col("__decided")))
            .drop("__first", "__decided")
            # An explicit exchange of these few rows, read by both passes below.
            .repartition(*keys, CHUNK))
    width = micros(chunk)
    # An undecided first row lies within a gap of its predecessor, and that one
    # within a gap of the row kept last: the entry is at most two gaps back.
    into_next = F.col("__t") + 2 * gap > F.col(CHUNK) + width
    copies = F.when(into_next, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    haloed = held.select("*", F.explode(copies).alias("__halo")).withColumn(
        CHUNK, F.when(F.col("__halo"), F.col(CHUNK) + width).otherwise(F.col(CHUNK)))

    columns = [*keys, CHUNK]
    key_fields = [haloed.schema[c] for c in columns]

    def longs(*names):
        return [T.StructField(n, T.LongType()) for n in names]

    maps = haloed.groupBy(*columns).applyInPandas(
        _transitions(gap, columns),
        T.StructType([*longs("__t_out", "__tie_out", "__v_out"),
                      T.StructField("__free", T.BooleanType()), *longs("__t_in", "__tie_in", "__before"), *key_fields]))
    entries = compose(maps, keys, CHUNK, width).drop("__tie_prev")
    # Every group has an entry row. A left join adds no not-null filter below the
    # exchange of ``held``, so both passes read the same shuffle.
    joined = held.join(entries, columns, "left")
    replayed = joined.groupBy(*columns).applyInPandas(_replay(gap), joined.schema)
    rest = replayed.where(~F.col("__direct")).select(
        *keys, F.col("__t").alias("us"), F.col("__tie").alias("tie"), F.col("__v").alias("value"),
        F.col("__t_prev").alias("prev_us"), F.col("__v_prev").alias("prev_value"))
    return direct.unionByName(rest)


def spaced_times(df: DataFrame, keys: Sequence[str], ts: str, min_gap, chunk=DEFAULT_CHUNK) -> DataFrame:
    """keys and times of the rows kept when each must lie ``min_gap`` after the row kept before it."""
    return kept_chain(df, keys, ts, min_gap, chunk=chunk).select(*keys, F.timestamp_micros("us").alias(ts))


def spaced_rows(df: DataFrame, keys: Sequence[str], ts: str, min_gap, chunk=DEFAULT_CHUNK) -> DataFrame:
    """The rows of ``df`` kept when each must lie ``min_gap`` after the row kept before it."""
    return df.join(spaced_times(df, keys, ts, min_gap, chunk), [*keys, ts], "left_semi")
