"""Embedding whitening from the covariance of distinct vectors weighted by their multiplicity.

Rows of one vector are grouped first; all later work is done once per distinct vector, with its number of
rows as its weight:

1. every entry c becomes the whole number floor(scale * c) + shift, and equal vectors are counted (the only shuffle of vectors),
2. each task adds up its weighted vectors exactly, as whole numbers, which gives n and the sums S,
3. each task multiplies its centred vectors, weighted (one GEMM a batch), and the upper triangles are summed over tasks,
4. the d x d covariance is decomposed on the driver; each distinct vector is projected once,
5. rows get the result of their vector by its 128-bit digest. Vectors with more than one row in ``SPLIT`` (at most SPLIT of
   them, so a broadcast of bounded size) are joined without a shuffle; no other vector has so many rows.

Only tables of d or d * d entries reach the driver.

Defined cases: rows whose vector is null, empty, or holds a null or non-finite entry are dropped. Vectors of several lengths are an
error that names the lengths. Entries are held within 2 ** 52 after scaling; sums beyond 64 bits are an error. Components whose eigenvalue is below 1e-12 of the trace
(fewer distinct vectors than dimensions, constant entries) are left out; an empty table, or equal vectors only, gives no rows. The
largest entry of each eigenvector is positive. Rows with null or equal ids keep their own result. Columns named
like the results are replaced. Nothing depends on a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import fresh, stored

SPLIT = 1000
LARGEST = float(1 << 52)
RESULTS = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
EXACT = pa.decimal128(38, 0)


def whole_entries(vector: Column, scale: int, shift: int) -> Column:
    """floor(scale * c) + shift of each entry, as longs."""
    return F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double") * F.lit(float(scale)), F.lit(LARGEST)), F.lit(-LARGEST))) + F.lit(shift).cast("long"))


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """(key, x, copies) of (key, x) rows."""
    return rows.groupBy("key", "x").agg(F.count("*").alias("copies"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = None, 0
    for batch in batches:
        if len(batch):
            x, weight = _matrix(batch.column(0)), batch.column(1).to_numpy()
            if int(np.abs(x).max()) * int(weight.sum()) >= 1 << 62:
                raise OverflowError("sums of entries beyond 64 bits")
            part = (x * weight[:, None]).sum(axis=0)
            total, n = (part, int(weight.sum())) if total is None else (total + part, n + int(weight.sum()))
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total), pa.array(np.full(len(total), n))], names=["i", "s", "n"])


def _products(mean: np.ndarray):
    """Upper triangle of the weighted centred products of a task's vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(mean), len(mean)))
        for batch in batches:
            centred = _matrix(batch.column(0)) - mean
            total += (centred * batch.column(1).to_numpy()[:, None]).T @ centred
        i, j = np.triu_indices(len(mean))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "v"])

    return run


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """Sum of (n * x - S) ** 2 per row, exact: in longs where these hold it, else in Python's whole numbers."""
    if n * int(np.abs(x).max(initial=0)) < 1 << 61:
        y = n * x - sums
        if int(np.abs(y).max(initial=0)) ** 2 * y.shape[1] < 1 << 63:
            return (y * y).sum(axis=1).tolist()
    return [int(v) for v in ((x.astype(object) * n - sums.astype(object)) ** 2).sum(axis=1)]


def _project(n: int, sums: np.ndarray, turn: np.ndarray):
    """Deviation and whitened components of each distinct vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean = sums / n
        for batch in batches:
            x = _matrix(batch.column(1))
            out = (x - mean) @ turn
            exact = [v if v < 10**38 else None for v in _deviations(x, n, sums)]
            white = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * turn.shape[1], pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(exact, EXACT), white], names=["key", "copies", "deviation", "white"])

    return run


def principal_axes(cov: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, without those of no variance."""
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:most]
    order = order[values[order] > 1e-12 * np.trace(cov)]
    vectors = vectors[:, order]
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))] if len(order) else np.ones(0)
    return values[order], vectors * np.where(largest < 0, -1.0, 1.0)


def whiten(rows: DataFrame, vector: str = "embedding", components: int = 8, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """``rows`` with a usable vector, times their components: component, n, deviation (decimal, exact; null beyond 38
    digits), whitened, explained and identity_error (the largest entry of the whitened covariance minus the identity)."""
    spark = rows.sparkSession
    carried = [c for c in rows.columns if c.lower() not in RESULTS]
    own_key, own_x = fresh(rows, "key", "x")
    rows = rows.where(usable(F.col(vector))).withColumn(own_x, whole_entries(F.col(vector), scale, shift))
    rows = rows.withColumn(own_key, F.unhex(F.md5(F.col(own_x).cast("string"))))
    distinct = stored(distinct_vectors(rows.select(F.col(own_key).alias("key"), F.col(own_x).alias("x"))), "distinct-vectors")
    lengths = [r[0] for r in distinct.select(F.size("x").alias("d")).distinct().limit(9).collect()]
    if len(lengths) > 1:
        raise ValueError(f"vectors of several lengths: {sorted(lengths)}")
    empty = spark.createDataFrame([], rows.select(*carried).schema).select(
        *carried, F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("decimal(38,0)").alias("deviation"),
        F.lit(0.0).alias("whitened"), F.lit(0.0).alias("explained"), F.lit(0.0).alias("identity_error"))
    if not lengths:
        return empty
    d = lengths[0]
    added = distinct.select("x", "copies").mapInArrow(_sums, "i int, s long, n long").groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("i").collect()
    n, sums = added[0]["n"], np.array([r["s"] for r in added], np.int64)
    cells = distinct.select("x", "copies").mapInArrow(_products(sums / n), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    cov = np.zeros((d, d))
    for i, j, v in cells:
        cov[i, j] = cov[j, i] = v / n
    values, axes = principal_axes(cov, components)
    if not len(values):
        return empty
    k = len(values)
    projected = stored(distinct.select("key", "x", "copies").mapInArrow(
        _project(n, sums, axes / np.sqrt(values)), "key binary, copies long, deviation decimal(38,0), white array<double>"), "whitened")
    weighted = lambda e: F.sum(F.col("copies") * e) / n
    entry = [F.col("white")[i] for i in range(k)]
    moments = projected.agg(*[weighted(entry[i]).alias(f"m{i}") for i in range(k)],
                            *[weighted(entry[i] * entry[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    error = max(abs(moments[f"c{i}_{j}"] - moments[f"m{i}"] * moments[f"m{j}"] - (i == j)) for i in range(k) for j in range(i, k))
    shares = F.array(*[F.lit(float(v / np.trace(cov))) for v in values])
    result = projected.select(F.col("key").alias(own_key), F.struct("deviation", "white").alias(own_x))
    frequent = result.where(F.col("copies") * SPLIT >= n)  # at most SPLIT vectors
    narrow = rows.drop(own_x)
    marked = narrow.join(F.broadcast(frequent), own_key, "left")
    hot = marked.where(F.col(own_x).isNotNull())
    rest = marked.where(F.col(own_x).isNull()).drop(own_x).join(result, own_key)
    every = hot.select(*carried, own_x).unionByName(rest.select(*carried, own_x))
    one = every.select(*carried, F.col(f"{own_x}.deviation").alias("deviation"), F.posexplode(f"{own_x}.white").alias("component", "whitened"))
    return one.select(*carried, (F.col("component") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                      F.element_at(shares, F.col("component") + 1).alias("explained"), F.lit(float(error)).alias("identity_error"))
