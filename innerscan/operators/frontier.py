"""Best-first search as joins: frontier, pool and what was met are tables, a round is one expansion and one anti-join.

For graphs of any size and edges of any kind: nothing is held in one task but
a query's pool.  A vector is fetched only when its norm and its sign hash,
two short columns, leave it a chance.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import angle_may_reach, hamming, inner_product, may_reach
from ..storage import written
from .topk import rank_by_ip


@dataclass
class Round:
    """Pool members expanded, vertices met for the first time and vectors fetched in a round."""

    expanded: int
    met: int
    fetched: int


@dataclass
class Walked:
    """``pool`` (qid, rank, vec_id, ip), best first; ``met`` (qid, vec_id, fetched); the rounds."""

    pool: DataFrame
    met: DataFrame
    rounds: list[Round]


def scored(candidates: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, vec_id, ip) of (qid, vec_id): here the vectors are fetched."""
    got = candidates.join(vectors.select("vec_id", "embedding"), "vec_id").join(queries.select("qid", "qv"), "qid")
    return got.select("qid", "vec_id", inner_product(F.col("embedding"), F.col("qv")).alias("ip"))


def frontier_walk(edges: DataFrame, marks: DataFrame, vectors: DataFrame, queries: DataFrame, starts: DataFrame, k: int, ef: int, norm_prune: bool = True, z: float | None = 3.0, bits: int = 64, max_rounds: int = 10_000) -> Walked:
    """Walks of unit queries (qid, qv, words) from ``starts`` (qid, vec_id) over ``edges`` (src, dst).

    ``marks`` (vec_id, norm, words) is what bounds need, ``vectors`` (vec_id,
    embedding) is read for what they leave.  A query's pool holds its k + ef
    best; each round expands all of it that is not expanded.  A vertex met
    once is not judged again: bounds only rise.  ``z=None`` and
    ``norm_prune=False`` fetch everything met.
    """
    pool_size = k + ef
    first = written(starts.select("qid", "vec_id").distinct())
    met = [first.withColumn("fetched", F.lit(True))]
    begun = scored(first, vectors, queries)
    pool = rank_by_ip(begun, pool_size).select("qid", "rank", "vec_id", "ip", F.lit(False).alias("done"))
    pool, left = observed(pool)
    rounds = [Round(0, first.count(), first.count())]
    while left and len(rounds) <= max_rounds:
        front = pool.where(~F.col("done")).select("qid", F.col("vec_id").alias("src"))
        before = met[0] if len(met) == 1 else union(met)
        new = front.join(edges, "src").select("qid", F.col("dst").alias("vec_id")).distinct().join(before.select("qid", "vec_id"), ["qid", "vec_id"], "left_anti")
        kth = pool.where(F.col("rank") == k).select("qid", F.col("ip").alias("kth"))
        bound = F.coalesce("kth", F.lit(float("-inf")))
        judged = new.join(marks.select("vec_id", "norm", F.col("words").alias("__w")), "vec_id").join(queries.select("qid", F.col("words").alias("__q")), "qid").join(kth, "qid", "left")
        keep = F.lit(True)
        if norm_prune:
            keep = keep & may_reach(F.col("norm"), bound)
        if z is not None:
            keep = keep & angle_may_reach(hamming(F.col("__w"), F.col("__q")), F.col("norm"), bound, z, bits)
        seen = Observation()
        judged = written(judged.select("qid", "vec_id", keep.alias("fetched")).observe(seen, F.count("*").alias("met"), F.coalesce(F.sum(F.col("fetched").cast("long")), F.lit(0)).alias("fetched")))
        met.append(judged)
        rounds.append(Round(left, seen.get["met"], seen.get["fetched"]))
        fresh = scored(judged.where("fetched"), vectors, queries).withColumn("done", F.lit(False))
        both = pool.select("qid", "vec_id", "ip", F.lit(True).alias("done")).unionByName(fresh)
        w = Window.partitionBy("qid").orderBy(F.col("ip").desc(), "vec_id")
        pool, left = observed(both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= pool_size).select("qid", "rank", "vec_id", "ip", "done"))
    return Walked(pool.select("qid", "rank", "vec_id", "ip"), union(met), rounds)


def observed(pool: DataFrame) -> tuple[DataFrame, int]:
    """The pool, written, and how many of its members are not expanded."""
    seen = Observation()
    out = written(pool.observe(seen, F.coalesce(F.sum((~F.col("done")).cast("long")), F.lit(0)).alias("left")))
    return out, seen.get["left"]


def union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
