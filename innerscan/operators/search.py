"""Approximate search: seeds by hash, best-first search in the graph, pruning by norm and angle, a wave for each chunk.

An index holds a shard as one row, so a wave reads a chunk's shards where
they lie and joins them with one row that holds the queries still alive: no
embedding is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import EPS, as_double, cosine_table, norm
from ..storage import written
from .srp import pack, projections
from .topk import QUERY_BLOCK_BYTES, exact_topk, rank_by_ip
from .walk import Shard

FOUND = "qid bigint, chunk int, shard int, cost bigint, ids array<bigint>, ips array<double>"
SHARDS_AT_ONCE = 64
RESULT = "qid bigint, rank int, vec_id bigint, ip double"


@dataclass
class Wave:
    """What a wave did: queries that were alive, groups (query, shard) entered and products computed."""

    block: int
    chunk: int
    queries: int
    groups: int
    products: int


@dataclass
class Trace:
    """Filled by :func:`search`: its waves, and (qid, chunk) of the groups of queries that each wave searched."""

    waves: list[Wave] = field(default_factory=list)
    entered: DataFrame | None = None


def unit_queries(queries: DataFrame) -> DataFrame:
    """(qid, qv, length): vectors of length 1 and their own lengths; a zero vector stays zero, a null one is left out."""
    q = queries.select("qid", as_double(F.col("qv")).alias("__v")).where("__v is not null").withColumn("length", norm(F.col("__v")))
    return q.select("qid", F.transform("__v", lambda x: x / (F.col("length") + F.lit(EPS))).alias("qv"), "length")


def searcher(k, ef, search_min, ub, entry, norm_prune, z, step, p):
    """The kernel of a wave: shards joined with the row of queries (qids, qvs, floors, starts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield one(batch, i)

    def one(batch: pa.RecordBatch, i: int) -> pa.RecordBatch:
        g, asked = Shard.unpacked(batch, i), batch.column("asked")[i].values
        qids, floors = (asked.field(f).to_numpy(zero_copy_only=False) for f in ("qid", "floor"))
        q = asked.field("qv").flatten().to_numpy(zero_copy_only=False).reshape(len(qids), -1)
        also = asked.field("starts")
        words = pack(q, projections(q.shape[1], p.tables, p.bits, p.seed), p.tables, p.bits)
        cos = None if z is None else np.array(cosine_table(p.tables * p.bits, z))
        found, costs = [], []
        for at in range(0, len(qids), g.block()):
            on = slice(at, at + g.block())
            if g.n < search_min:
                f = g.scan(q[on], k)
            else:
                starts = [np.zeros(1, np.int64)] * len(q[on]) if entry == "top" else g.seeds(words[on], ub)
                for j in range(len(starts)):
                    if also[at + j].is_valid and len(also[at + j].values):
                        more = g.places(also[at + j].values.to_numpy())
                        starts[j] = np.concatenate([starts[j], more[~np.isin(more, starts[j])]])
                if entry == "lsh":
                    f = g.walk(q[on], None, starts, k, max(map(len, starts)), step=0)
                else:
                    f = g.walk(q[on], words[on], starts, k, ef, floors[on], norm_prune, cos, step)
            f = g.best(f, k)
            found.append((f.query + at, g.ids[f.member], f.ip))
            costs.append(f.cost)
        who, ids, ips = (np.concatenate(c) for c in zip(*found))
        offsets = np.searchsorted(who, np.arange(len(qids) + 1)).astype(np.int32)
        same = lambda name: pa.array(np.full(len(qids), batch.column(name)[i].as_py(), np.int32))
        columns = [pa.array(qids), same("chunk"), same("shard"), pa.array(np.concatenate(costs).astype(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.ListArray.from_arrays(offsets, pa.array(ips))]
        return pa.RecordBatch.from_arrays(columns, names=["qid", "chunk", "shard", "cost", "ids", "ips"])

    return run


def alive(queries: DataFrame, best: DataFrame | None, k: int, max_norm: float | None) -> DataFrame:
    """(qid, qv, floor): the queries that a chunk of this largest norm can still improve, with their k-th best product so far."""
    if best is None:
        return queries.select("qid", "qv", F.lit(float("-inf")).alias("floor"))
    kth = best.where(F.col("rank") == k).select("qid", F.col("ip").alias("floor"))
    out = queries.join(kth, "qid", "left").select("qid", "qv", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    return out if max_norm is None else out.where(F.col("floor") <= F.lit(max_norm))


def search(
    index,
    queries: DataFrame,
    k: int,
    ef: int = 50,
    search_min: int = 400,
    ub: int = 200,
    entry: str = "srp",
    norm_prune: bool = True,
    z: float | None = 3.0,
    stop_by_norm: bool = True,
    with_cost: bool = False,
    normal_edges: bool = False,
    step: int = 1,
    trace: Trace | None = None,
    block_bytes: int = QUERY_BLOCK_BYTES,
) -> DataFrame:
    """(qid, rank, vec_id, ip) of queries (qid, qv) of any length in an :class:`~innerscan.plans.index.Index`.

    Queries are searched as unit vectors, for which bounds by norm hold, and
    products are multiplied back.  Chunks are taken in order of their largest
    norm, a wave each; a query is in a wave if the chunk's largest norm can
    still reach its k-th best product, which every wave raises and which
    prunes within the next.  ``entry`` is "srp" (hash seeds), "top" (the
    largest norm of the shard) or "lsh" (seeds only, no graph).  Shards
    smaller than ``search_min`` are scanned.  With ``norm_prune=False`` and
    ``z=None`` nothing is pruned.  With ``normal_edges`` (and an index built
    with them) a wave also begins at what a query's results in earlier chunks
    are linked with in this one.  ``with_cost`` adds the products computed for
    a query and the shards entered; ``trace`` receives the waves.

    The queries of a block, ``block_bytes`` of vectors at most, are one row,
    which is broadcast.
    """
    spark = index.spark
    units = written(unit_queries(queries))
    size = units.agg(F.count("*").alias("n"), F.max(F.size("qv")).alias("dim")).first()
    blocks = max(1, -(-size["n"] * 8 * (size["dim"] or 1) // block_bytes))
    kernel = searcher(k, ef, search_min, ub, entry, norm_prune, z, step, index.params)
    chunks = index.chunks() if size["n"] else []
    ranked, entered = [], []
    for b in range(blocks):
        mine = units.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b) if blocks > 1 else units
        n = size["n"] if blocks == 1 else mine.count()
        best = state = None
        for c in chunks:
            if state and stop_by_norm and state["full"] == n and state["low"] > c["max_norm"]:
                break
            counts = Observation()  # taken as the wave is written
            got = wave(index, alive(mine, best, k, c["max_norm"] if stop_by_norm else None), best, c["chunk"], kernel, normal_edges)
            out = written(got.observe(counts, F.count("*").alias("groups"), F.sum("cost").alias("products")))
            if trace is not None:
                trace.waves.append(Wave(b, c["chunk"], counts.get["groups"] // max(1, c["shards"]), counts.get["groups"], counts.get["products"] or 0))
            entered.append(out)
            new = out.select("qid", F.explode(F.arrays_zip("ids", "ips")).alias("r")).select("qid", F.col("r.ids").alias("vec_id"), F.col("r.ips").alias("ip"))
            both = new if best is None else best.select("qid", "vec_id", "ip").unionByName(new)
            # a few shards give a query few candidates, which one level ranks
            kept = rank_by_ip(both, k) if c["shards"] > SHARDS_AT_ONCE else both.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("ip").desc(), "vec_id"))).where(F.col("rank") <= k)
            full = F.col("rank") == k
            seen = Observation()
            best = written(kept.select("qid", "rank", "vec_id", "ip").observe(seen, F.count(F.when(full, 1)).alias("full"), F.min(F.when(full, F.col("ip"))).alias("low")))
            state = seen.get
        if best is not None:
            ranked.append(best)
    if not ranked:
        return spark.createDataFrame([], RESULT + (", cost bigint, groups bigint" if with_cost else ""))
    union = lambda tables: tables[0] if len(tables) == 1 else tables[0].unionByName(union(tables[1:]))
    if trace is not None:
        trace.entered = union(entered).select("qid", "chunk", "shard", "cost")
    result = union(ranked).join(units.select("qid", "length"), "qid").select("qid", "rank", "vec_id", (F.col("ip") * F.col("length")).alias("ip"))
    if not with_cost:
        return result
    costs = union(entered).groupBy("qid").agg(F.sum("cost").alias("cost"), F.count("*").alias("groups"))
    return result.join(costs, "qid")


def wave(index, queries: DataFrame, best: DataFrame | None, chunk: int, kernel, normal_edges: bool) -> DataFrame:
    """(qid, chunk, shard, cost, ids, ips) of the queries (qid, qv, floor) in one chunk; shards are read in place, only queries move."""
    c = F.lit(chunk).cast("int")
    if normal_edges and best is not None:
        to = index.links.where((F.col("dst_chunk") == c)).join(best.select("qid", F.col("vec_id").alias("src")), "src")
        queries = queries.join(to.groupBy("qid").agg(F.collect_set("dst").alias("starts")), "qid", "left")
    else:
        queries = queries.withColumn("starts", F.lit(None).cast("array<bigint>"))
    asked = queries.agg(F.collect_list(F.struct("qid", "qv", "floor", "starts")).alias("asked")).where(F.size("asked") > 0).withColumn("chunk", c)
    shards = index.shards.where(F.col("chunk") == c)
    return shards.join(F.broadcast(asked), "chunk").mapInArrow(kernel, FOUND)


def norm_pruned_topk(base: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact top-k in one scan that skips what norms rule out.

    Each batch of rows is taken in descending norm, in pieces that double;
    the k-th best product tightens from piece to piece and from batch to
    batch, and a query leaves a batch as soon as its remaining norms cannot
    reach it.  No chunk table, no shuffle of embeddings; where files are
    sorted by norm, later batches are left at their first row.
    """
    return exact_topk(base, queries, k, prune=True)


def lsh_topk(seeds: DataFrame, base: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Top-k among the hash candidates only."""
    from ..functions.vectors import inner_product

    got = seeds.join(base.select("vec_id", "embedding"), "vec_id").join(queries.select("qid", "qv"), "qid")
    scored = got.select("qid", "vec_id", inner_product(F.col("embedding"), F.col("qv")).alias("ip"))
    return rank_by_ip(scored, k).select("qid", "rank", "vec_id", "ip")
