"""Exact top-k by inner product: an Arrow kernel for partial results, a window for the merge."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A block of queries is sent to every task; it holds so many bytes of vectors at most.
QUERY_BLOCK_BYTES = 32 << 20
#: Products that a task holds at a time, and rows of a batch's largest norms that it begins with.
PRODUCT, NORM_STEP = 1 << 22, 256
SALTS = 32
PARTIAL = "qid bigint, vec_id bigint, ip double"


def stack(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64) if len(column) else np.zeros((0, 0))


def query_blocks(queries: DataFrame, block_bytes: int = QUERY_BLOCK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) blocks of the query table, streamed so that the driver holds one block."""
    ids, rows, size = [], [], 0
    for r in queries.select("qid", "qv").toLocalIterator():
        ids.append(r[0])
        rows.append(r[1])
        size += 8 * len(r[1])
        if size >= block_bytes:
            yield np.array(ids, np.int64), np.array(rows, np.float64)
            ids, rows, size = [], [], 0
    if ids:
        yield np.array(ids, np.int64), np.array(rows, np.float64)


def best(ips: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k largest, ties by smaller id."""
    if len(ips) > 4 * k:
        cut = np.partition(ips, len(ips) - k)[len(ips) - k]
        near = np.flatnonzero(ips >= cut)
        return near[np.lexsort((ids[near], -ips[near]))[:k]]
    return np.lexsort((ids, -ips))[:k]


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column as a matrix of doubles, without a Python object for each."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


class Best:
    """The k best of each query so far: larger products first, ties by smaller id."""

    def __init__(self, n: int, k: int):
        self.ips, self.ids, self.k = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max), k

    def add(self, on: np.ndarray, ips: np.ndarray, ids: np.ndarray) -> None:
        """Offer the queries ``on`` the products ``ips`` (a row each) with the rows ``ids``."""
        least = self.ips[on, -1]
        if ips.shape[1] > 4 * self.k:
            least = np.maximum(least, np.partition(ips, -self.k, axis=1)[:, -self.k])
        new, item = np.nonzero(ips >= least[:, None])
        who = np.concatenate([np.repeat(np.arange(len(on)), self.k), new])
        ip, of = np.concatenate([self.ips[on].ravel(), ips[new, item]]), np.concatenate([self.ids[on].ravel(), ids[item]])
        order = np.lexsort((of, -ip, who))
        who, ip, of = who[order], ip[order], of[order]
        first = np.searchsorted(who, np.arange(len(on)))
        keep = (first[:, None] + np.arange(self.k)).ravel()
        self.ips[on], self.ids[on] = ip[keep].reshape(-1, self.k), of[keep].reshape(-1, self.k)


def scan_kernel(qids: np.ndarray, q: np.ndarray, k: int, prune: bool = False):
    """Partial top-k of a task's rows.

    Products are computed for so many rows at a time that they take
    ``PRODUCT`` doubles at most.  With ``prune`` rows come in descending norm
    and a query leaves a batch when its k-th best product is above what the
    norms that are left can give, ``norm |q|``; the result stays exact.
    """
    lengths = np.linalg.norm(q, axis=1) * (1 + 1e-12)
    step = max(1, PRODUCT // max(1, len(qids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, every = Best(len(qids), k), np.arange(len(qids))
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column(0).to_numpy(), matrix(batch.column(1))
            if prune:
                norm = np.linalg.norm(x, axis=1)
                order = np.argsort(-norm)
                ids, x, norm = ids[order], x[order], norm[order]
            at, take = 0, min(step, NORM_STEP) if prune else step
            while at < len(ids):
                on = every[top.ips[:, -1] <= norm[at] * lengths] if prune else every
                if not len(on):
                    break
                top.add(on, q[on] @ x[at : at + take].T, ids[at : at + take])
                at, take = at + take, min(step, 2 * take)
        i, j = np.nonzero(top.ips > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(qids[i]), pa.array(top.ids[i, j]), pa.array(top.ips[i, j])], names=["qid", "vec_id", "ip"])

    return run


def rank_by_ip(scored: DataFrame, k: int, keys: tuple = ("qid",), item: str = "vec_id") -> DataFrame:
    """The k best of each key with their rank from 1; ties go to the smaller id.

    In two levels: a first limit in salted groups spreads a query with very
    many candidates over tasks.
    """
    salted = scored.withColumn("__s", F.pmod(F.xxhash64(item), F.lit(SALTS)))
    order = [F.col("ip").desc(), F.col(item)]
    first = F.row_number().over(Window.partitionBy(*keys, "__s").orderBy(*order))
    part = salted.withColumn("rank", first).where(F.col("rank") <= k).drop("rank", "__s")
    return part.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def exact_topk(base: DataFrame, queries: DataFrame, k: int, prune: bool = False) -> DataFrame:
    """(qid, rank, vec_id, ip): for each query the k rows of the largest inner product.

    ``base`` (vec_id, embedding) is scanned once for each block of ``queries``
    (qid, qv); a task keeps k rows a query, so its result does not grow with
    its input, and only those are shuffled.  ``prune``: see :func:`scan_kernel`.
    """
    out = None
    for qids, q in query_blocks(queries):
        part = base.select("vec_id", "embedding").where("embedding is not null").mapInArrow(scan_kernel(qids, q, k, prune), PARTIAL)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return base.sparkSession.createDataFrame([], "qid bigint, rank int, vec_id bigint, ip double")
    return rank_by_ip(out, k).select("qid", "rank", "vec_id", "ip")


def trim(candidates: DataFrame, capacity: int, source: str = "src", item: str = "dst") -> DataFrame:
    """A bounded queue for each source: distinct items, the ``capacity`` best by inner product."""
    return rank_by_ip(candidates.dropDuplicates([source, item]), capacity, (source,), item)
