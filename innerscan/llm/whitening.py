"""Embedding whitening: exact integer vectors, their covariance by pairwise merges, and a second pass that verifies it.

A task reduces its rows to count, integer sums and centred scatter, as large
as the dimension squared whatever it has read; ``treeReduce`` merges these by
Chan's formula on the executors, so the driver merges a few of them (about
the cube root of the number of tasks) and decomposes the result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize, table

GRID, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Entries beyond this leave the range in which a batch's sums are exact 64-bit integers.
MAX_ENTRY = 2.0**40
#: Eigenvalues below this share of the largest are rounding, not variance.
RANK_TOLERANCE = 1e-12
TREE_DEPTH = 3
#: Sums of whitened coordinates are kept as integers of this fraction.
SUM_UNITS = 2**60


@dataclass
class Moments:
    """``n`` vectors: their sums (Python integers, exact, in units of 1 / ``units``) and the scatter around their mean."""

    n: int
    total: list[int]
    scatter: np.ndarray
    units: int = 1

    def merge(self, other: Moments) -> Moments:
        """Chan's pairwise formula; the difference of means is formed exactly before it is rounded."""
        if not self.n or not other.n:
            return self if self.n else other
        if len(self.total) != len(other.total):
            raise ValueError("vectors of different dimensions")
        n = self.n + other.n
        delta = np.array([(b * self.n - a * other.n) / (self.n * other.n * self.units) for a, b in zip(self.total, other.total)])
        scatter = self.scatter + other.scatter + np.outer(delta, delta) * (self.n * other.n / n)
        return Moments(n, [a + b for a, b in zip(self.total, other.total)], scatter, self.units)

    def covariance(self) -> np.ndarray:
        v = self.scatter / max(1, self.n)
        return (v + v.T) / 2


def moments_of(x: np.ndarray) -> Moments:
    """Of the integer rows of ``x``, centred before they are multiplied."""
    n, total = len(x), [int(v) for v in x.sum(axis=0)]
    # whole and fractional part of the mean apart, so that a large offset costs no digits
    whole = np.array([t // n for t in total], np.int64)
    part = np.array([(t % n) / n for t in total])
    centred = (x - whole).astype(np.float64) - part
    return Moments(n, total, centred.T @ centred)


def rows_of(column: pa.Array) -> np.ndarray:
    """An array column as a matrix, without a Python object for each number."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    lengths = column.value_lengths().to_numpy()
    if len(lengths) and (lengths != lengths[0]).any():
        raise ValueError("vectors of different dimensions")
    return flat.reshape(len(column), -1)


def tree_moments(df: DataFrame, of: Callable[[pa.RecordBatch], Moments], units: int = 1) -> Moments:
    """``of`` of every batch, merged within each task, then pairwise in levels on the executors."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Moments(0, [], np.zeros((0, 0)))
        for batch in batches:
            if batch.num_rows:
                out = out.merge(of(batch))
        if out.n:
            yield pa.RecordBatch.from_arrays([pa.array([out.n]), pa.array([[str(t) for t in out.total]]), pa.array([out.scatter.ravel().tolist()])], names=["n", "total", "scatter"])

    parts = df.mapInArrow(partial, "n bigint, total array<string>, scatter array<double>")
    # an empty state first, for tables without a row
    states = parts.rdd.mapPartitions(lambda rows: [Moments(0, [], np.zeros((0, 0))), *(Moments(r[0], [int(t) for t in r[1]], np.array(r[2]).reshape(len(r[1]), -1), units) for r in rows)])
    return states.treeReduce(Moments.merge, TREE_DEPTH)


def on_grid(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", grid: int = GRID, offset: int = OFFSET) -> DataFrame:
    """(vec_id, x): each entry c as floor(grid c) + offset; rows whose vector is null or holds a null or non-finite entry go."""
    v = F.col(vec_col).cast("array<double>")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(math.inf))
    kept = embeddings.select(F.col(id_col).alias("vec_id"), v.alias("__v")).where(F.col("__v").isNotNull() & F.forall("__v", finite))
    entry = lambda c: F.when(F.abs(c) <= MAX_ENTRY, F.floor(c * grid)).otherwise(F.raise_error(F.lit("an entry is too large for the grid")).cast("long")) + offset
    return kept.select("vec_id", F.transform("__v", entry).alias("x"))


@dataclass
class Whitening:
    """A fitted transformation: mean as n and S, components as columns, their eigenvalues and shares of the variance."""

    n: int
    total: list[int]
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole = np.array([t // self.n for t in self.total], np.int64)
        part = np.array([(t % self.n) / self.n for t in self.total])
        return (x - whole).astype(np.float64) - part

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sums of (n x - S)^2 over the dimensions, in 64-bit integers where these are proven wide enough, else in Python's."""
        total = np.array(self.total, object)
        bound = (self.n * max(int(x.max()), -int(x.min())) + max(map(abs, self.total))) if x.size else 0
        if bound * bound * x.shape[1] < 2**63:
            return ((self.n * x - total.astype(np.int64)) ** 2).sum(axis=1).tolist()
        centred = self.n * x.astype(object) - total
        return (centred * centred).sum(axis=1).tolist()


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """From a table (x) of distinct integer vectors; None if it has no row."""
    m = tree_moments(distinct.select("x"), lambda batch: moments_of(rows_of(batch.column(0))))
    if not m.n:
        return None
    v = m.covariance()
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = int((values[:components] > RANK_TOLERANCE * max(values[0], 0)).sum()) if len(values) and values[0] > 0 else 0
    trace = float(np.trace(v))
    return Whitening(m.n, m.total, vectors[:, :keep], values[:keep], values[:keep] / trace if trace > 0 else values[:keep])


def identity_error(distinct: DataFrame, w: Whitening) -> float:
    """The largest absolute entry of the covariance of the whitened fit list minus the identity, by a second pass over it."""

    def of(batch: pa.RecordBatch) -> Moments:
        y = w.whiten(rows_of(batch.column(0)))
        mean = y.mean(axis=0)
        return Moments(len(y), [int(t) for t in mean * len(y) * SUM_UNITS], (y - mean).T @ (y - mean), SUM_UNITS)

    m = tree_moments(distinct.select("x"), of, SUM_UNITS)
    return float(np.abs(m.covariance() - np.eye(len(w.values))).max())


def whitened(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of each usable row of ``embeddings``.

    Returns (vec_id, component, n, deviation, whitened, explained,
    identity_error), a row for each remaining row and component.  The fit list
    holds each distinct integer vector once, so copies, however many, count
    once in the fit; they are met by a group-by that sums before the shuffle,
    and each gets its own rows.  Components are numbered from 1 by falling
    eigenvalue; those whose eigenvalue is rounding only (fewer distinct
    vectors than dimensions) can't be scaled to variance 1 and are left out,
    so a table of equal vectors, or an empty one, gives no rows.  Rows with a
    null or non-finite entry are dropped; an empty vector counts as a vector
    of dimension 0 and has no component.  Vectors of different dimensions, and
    entries beyond 2^40, raise an error, and so does a deviation beyond 64
    bits.  A null id stays null; other columns are ignored.
    """
    spark = embeddings.sparkSession
    rows = on_grid(embeddings, id_col, vec_col)
    distinct = materialize(rows.select("x").distinct(), "distinct")
    w = fit(distinct, components)
    schema = "vec_id {}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double".format(rows.schema["vec_id"].dataType.simpleString())
    error = identity_error(distinct, w) if w is not None and len(w.values) else 0.0
    forget(distinct)
    if w is None or not len(w.values):
        return spark.createDataFrame([], schema)
    k = len(w.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, each = rows_of(batch.column(1)), np.arange(batch.num_rows).repeat(k)
            n = len(each)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows)),
                    pa.array(np.full(n, w.n, np.int64)),
                    pa.array(w.deviation(x), pa.int64()).take(pa.array(each)),
                    pa.array(w.whiten(x).ravel()),
                    pa.array(np.tile(w.explained, batch.num_rows)),
                    pa.array(np.full(n, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    """Contract digest of :func:`whitened` over the whole ``embeddings`` table."""
    return whitened(table(spark, sf_dir, "embeddings"))
