"""Chunk functions composed along series of any length, as a tree.

A chunk of a series is a function from the row it is entered with to the row it is left
with, given by its value for each possible entry (one value if they are all equal). Up the
tree, ``FANOUT`` neighbouring functions are composed into one; down the tree, the entry of a
node gives that of each child. No group holds more than ``FANOUT`` children, so a series
of any length is many small tasks, in as many rounds as the tree has levels.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

FANOUT = 4096
#: Time that the top of a tree covers, half of it before 1970.
SPAN_US = 300 * 366 * 86_400_000_000
NODE = "__node"
_OUT = ["__t_out", "__tie_out", "__v_out"]
#: A function: one row per entry. ``__before`` is the chunk before the first of the node, ``__end`` its last.
FIELDS = [*_OUT, "__t_in", "__tie_in", "__before", "__end"]
_ENTRY = ["__t_prev", "__tie_prev", "__v_prev"]


def tree_levels(width: int, fanout: int = FANOUT) -> int:
    """Levels above the chunks until one group covers ``SPAN_US``."""
    levels, covered = 1, width * fanout
    while covered < SPAN_US:
        levels, covered = levels + 1, covered * fanout
    return levels


class _Child:
    """One child's function."""

    def __init__(self, part: pd.DataFrame):
        first = part.iloc[0]
        self.before, self.end, self.free = int(first["__before"]), int(first["__end"]), bool(first["__free"])
        outs = list(zip(*(part[c].tolist() for c in _OUT)))
        self.exit = outs[0]
        self.exits = dict(zip(zip(part["__t_in"].tolist(), part["__tie_in"].tolist()), outs))

    def leave(self, state: tuple | None) -> tuple:
        # A chunk whose neighbour is not its predecessor opens on a decided row, so its exit is free.
        return self.exit if self.free else self.exits[state[:2]]


def _children(pdf: pd.DataFrame, node: str) -> Iterator[tuple[int, _Child]]:
    for at, part in pdf.groupby(node, sort=True):
        yield at, _Child(part)


def _composed(node: str, columns: list[str]):
    """The function of a group of children."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        exits, before, end = None, None, None
        for _, child in _children(pdf, node):
            if exits is None:
                before, exits = child.before, {(0, 0): child.exit} if child.free else child.exits
            else:
                exits = {entry: child.leave(state) for entry, state in exits.items()}
            free = child.free or len(set(exits.values())) == 1
            if free:
                exits = {(0, 0): next(iter(exits.values()))}
            end = child.end
        out = pd.DataFrame(list(exits.values()), columns=_OUT)
        out["__t_in"] = [e[0] for e in exits]
        out["__tie_in"] = [e[1] for e in exits]
        out["__before"], out["__end"], out["__free"] = before, end, free
        for c in columns:
            out[c] = pdf[c].iloc[0]
        return out
    return run


def _entered(node: str, columns: list[str]):
    """The entry of each child, from that of their group."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        state = tuple(int(first[c]) for c in _ENTRY) if first["__entered"] == True else None  # noqa: E712  null is no entry
        keys, flags, states, end = [], [], [], None
        for _, part in pdf.groupby(node, sort=True):
            child = _Child(part)
            if end is not None and child.before != end:
                state = None
            keys.append([part[c].iloc[0] for c in columns])
            flags.append(state is not None)
            states.append(state or (0, 0, 0))
            state, end = tuple(int(v) for v in child.leave(state)), child.end
        out = pd.DataFrame(keys, columns=columns)
        out["__entered"] = np.array(flags, dtype=bool)
        for i, c in enumerate(_ENTRY):
            out[c] = np.array([s[i] for s in states], dtype=np.int64)
        return out
    return run


def compose(maps: DataFrame, keys: Sequence[str], chunk: str, width: int, fanout: int = FANOUT) -> DataFrame:
    """keys, ``chunk``, __entered, __t_prev, __tie_prev, __v_prev: the row each chunk is entered with.

    ``maps`` has keys, ``chunk``, ``__free`` and ``FIELDS`` but ``__end``, one row per entry; a chunk not directly
    after the one before it (``__before``) is entered with none.
    """
    keys, levels = list(keys), tree_levels(width, fanout)
    long = T.LongType()

    # Chunks are numbered by time from the start of the top's span, then groups of them.
    offset = fanout ** levels // 2
    start = maps.withColumns({"__end": F.col(chunk), NODE: F.floor(F.col(chunk) / F.lit(width)).cast("bigint") + F.lit(offset)}).drop(chunk)
    schema = T.StructType([*[start.schema[c] for c in keys], T.StructField(NODE, long), *[T.StructField(c, long) for c in FIELDS],
                           T.StructField("__free", T.BooleanType())])
    tree, parent = [], f"{NODE}_up"
    nodes = start.select(*schema.fieldNames())
    for level in range(levels):
        # Read by both passes over this level.
        held = nodes.withColumn(parent, F.floor(F.col(NODE) / F.lit(fanout)).cast("bigint")).repartition(*keys, parent)
        tree.append(held)
        if level + 1 < levels:
            up = T.StructType([*[schema[c] for c in keys], T.StructField(parent, long), *[T.StructField(c, long) for c in FIELDS],
                               T.StructField("__free", T.BooleanType())])
            nodes = held.groupBy(*keys, parent).applyInPandas(_composed(NODE, [*keys, parent]), up).withColumnRenamed(parent, NODE).select(*schema.fieldNames())
    found = T.StructType([*[schema[c] for c in keys], T.StructField(NODE, long), T.StructField("__entered", T.BooleanType()),
                          *[T.StructField(c, long) for c in _ENTRY]])
    entries = None
    for held in reversed(tree):
        if entries is None:
            rows = held.withColumns({"__entered": F.lit(None).cast("boolean"), **{c: F.lit(0).cast("bigint") for c in _ENTRY}})
        else:
            rows = held.join(entries.withColumnRenamed(NODE, parent), [*keys, parent], "left")
        entries = rows.groupBy(*keys, parent).applyInPandas(_entered(NODE, [*keys, NODE]), found)
    return entries.withColumn(chunk, (F.col(NODE) - F.lit(offset)) * F.lit(width)).drop(NODE)
