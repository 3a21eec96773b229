"""Building, saving and opening a search index.

An index is a folder: ``shards`` has one row and one file for each shard, a
folder for each chunk, so a search reads a chunk's shards where they lie;
``stats`` has a short row for each shard; ``links`` has the edges between
chunks, by the chunk that they start in.
"""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import as_double, squared_norm
from ..operators import graph, partition, srp
from ..operators.metrics import peak_memory
from ..operators.topk import matrix
from ..operators.walk import PACKED, GraphParams, Shard, build_shard, products
from ..storage import hadoop, new_path, temporary, written

RECORD = "chunk int, shard int, pos int, vec_id bigint, norm double, words array<int>, nbrs array<bigint>"
#: Members of a shard that are taken apart together.
RECORDS = 4_096


@dataclass
class IndexParams:
    ratio: float = 0.85
    min_size: int = 32
    build_min: int = 256
    width: int = 10
    degree: int = 24
    max_degree: int = 48
    rounds: int = 1
    ef_build: int = 80
    step_build: int = 8
    links: int = 32
    normal_edges: bool = False
    tables: int = srp.TABLES
    bits: int = srp.BITS
    seed: int = srp.SEED
    shard_rows: int = 50_000

    def graph(self) -> GraphParams:
        return GraphParams(self.build_min, self.width, self.degree, self.max_degree, self.rounds, self.ef_build, self.step_build)


@dataclass
class Index:
    """An index at ``path``; ``stats`` (chunk, shard, n, max_norm) is short, the other tables are read when they are used."""

    spark: SparkSession
    path: str
    params: IndexParams

    @property
    def shards(self) -> DataFrame:
        return self.spark.read.schema(PACKED).parquet(f"{self.path}/shards")

    @property
    def stats(self) -> DataFrame:
        return self.spark.read.schema("chunk int, shard int, n int, max_norm double").parquet(f"{self.path}/stats")

    @property
    def links(self) -> DataFrame:
        """(src_chunk, src, dst_chunk, dst)."""
        return self.spark.read.schema("src_chunk int, src bigint, dst_chunk int, dst bigint").parquet(f"{self.path}/links")

    def chunks(self) -> list:
        """(chunk, max_norm, n, shards) of each chunk in order; their number grows with the logarithm of the base."""
        by = self.stats.groupBy("chunk").agg(F.max("max_norm").alias("max_norm"), F.sum("n").alias("n"), F.count("*").alias("shards"))
        return by.orderBy("chunk").collect()

    def records(self) -> DataFrame:
        """(chunk, shard, pos, vec_id, norm, words, nbrs): a row for each member, without its vector.

        A kernel takes a shard's row apart: exploding it would carry the
        shard's arrays along with each member.
        """
        tables = self.params.tables

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    get = lambda name: batch.column(name)[i].values.to_numpy(zero_copy_only=False)  # noqa: E731, B023
                    ids, norms, words, offsets, nbrs = map(get, ("ids", "norms", "words", "offsets", "nbrs"))
                    for at in range(0, len(ids), RECORDS):
                        on, n = slice(at, at + RECORDS), len(ids[at : at + RECORDS])
                        own = offsets[at : at + n + 1]
                        same = lambda name: pa.array(np.full(n, batch.column(name)[i].as_py(), np.int32))  # noqa: E731, B023
                        lists = pa.ListArray.from_arrays((own - own[0]).astype(np.int32), pa.array(ids[nbrs[own[0] : own[-1]]]))
                        w = pa.ListArray.from_arrays(np.arange(0, (n + 1) * tables, tables, dtype=np.int32), pa.array(words[at * tables : (at + n) * tables]))
                        columns = [same("chunk"), same("shard"), pa.array(np.arange(at, at + n, dtype=np.int32)), pa.array(ids[on]), pa.array(norms[on]), w, lists]
                        yield pa.RecordBatch.from_arrays(columns, names=["chunk", "shard", "pos", "vec_id", "norm", "words", "nbrs"])

        return self.shards.select("chunk", "shard", "ids", "norms", "words", "offsets", "nbrs").mapInArrow(run, RECORD)

    def edges(self) -> DataFrame:
        """(src, dst) within shards."""
        return self.records().select(F.col("vec_id").alias("src"), F.explode("nbrs").alias("dst"))

    def scored_edges(self) -> DataFrame:
        """(src, dst, ip) within shards, scored where the vectors lie."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    g = Shard.unpacked(batch, i)
                    for at in range(0, g.n, RECORDS):
                        own = g.offsets[at : at + RECORDS + 1]
                        src, dst = at + np.repeat(np.arange(len(own) - 1), np.diff(own)), g.nbrs[own[0] : own[-1]]
                        yield pa.RecordBatch.from_arrays([pa.array(g.ids[src]), pa.array(g.ids[dst]), pa.array(products(g.x, src, g.x, dst))], names=["src", "dst", "ip"])

        return self.shards.mapInArrow(run, "src bigint, dst bigint, ip double")


def table_exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


def checked(base: DataFrame, dim: int | None) -> tuple[DataFrame, int]:
    """(vec_id, embedding) as doubles, null vectors left out, and their dimension."""
    base = base.select("vec_id", as_double(F.col("embedding")).alias("embedding")).where("embedding is not null")
    if dim is None:
        first = base.select(F.size("embedding")).first()
        dim = first[0] if first else 0
    if base.where(F.size("embedding") != dim).limit(1).count():
        raise ValueError(f"vectors of a dimension other than {dim}")
    return base, dim


def chunk_of(starts: Sequence, sq_norm, vec_id):
    """A row's chunk, from the (sq_norm, vec_id) that each chunk begins with in descending order of norms."""
    after = lambda s: (sq_norm < s["sq_norm"]) | ((sq_norm == s["sq_norm"]) & (vec_id >= s["vec_id"]))
    return reduce(lambda out, s: F.when(after(s[1]), s[0]).otherwise(out), enumerate(starts), F.lit(0)).cast("int")


def build_index(base: DataFrame, p: IndexParams = IndexParams(), path: str | None = None, dim: int | None = None) -> Index:
    """Build an index of (vec_id, embedding) at ``path`` (a new folder if None).

    Chunks by norm; chunks above ``shard_rows`` are cut into shards by a hash
    of the id.  A chunk follows from a row's norm and id, so vectors are dealt
    once, to their shards, and one kernel a shard hashes, scores and refines
    with the vectors at hand.  ``normal_edges`` adds links between chunks,
    both ways.
    """
    spark = base.sparkSession
    path = path or new_path(spark, "index")
    base, dim = checked(base, dim)
    proj, tables, bits, params = srp.projections(dim, p.tables, p.bits, p.seed), p.tables, p.bits, p.graph()
    with temporary(spark):
        order = written(partition.by_norm(base))
        bounds = partition.chunk_bounds(order, p.ratio, p.min_size)
        starts = order.where(F.col("gpos").isin([s for s, _ in bounds])).orderBy("gpos").collect()
        placed = base.withColumn("sq_norm", squared_norm(F.col("embedding")))
        placed = placed.withColumn("chunk", chunk_of(starts, F.col("sq_norm"), F.col("vec_id")))
        shards = F.array(*[F.lit(-(-(e - s) // p.shard_rows)) for s, e in bounds] or [F.lit(1)])
        placed = placed.withColumn("shard", F.pmod(F.xxhash64("vec_id"), shards[F.col("chunk")]).cast("int"))

        def kernel(key, rows):
            x = matrix(rows.column("embedding").combine_chunks())
            return build_shard(rows.column("vec_id").to_numpy(), x, proj, tables, bits, params).packed(key[0].as_py(), key[1].as_py())

        packed = placed.select("chunk", "shard", "vec_id", "embedding").groupBy("chunk", "shard").applyInArrow(kernel, PACKED)
        packed.write.mode("overwrite").option("maxRecordsPerFile", 1).partitionBy("chunk").parquet(f"{path}/shards")
        out = Index(spark, path, p)
        out.shards.select("chunk", "shard", "n", "max_norm").coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
        if p.normal_edges:
            chunk_links(out, base, dim).write.mode("overwrite").partitionBy("src_chunk").parquet(f"{path}/links")
    spark.createDataFrame([(repr(sorted(asdict(p).items())),)], "params string").coalesce(1).write.mode("overwrite").parquet(f"{path}/params")
    return out


def chunk_links(index: Index, base: DataFrame, dim: int) -> DataFrame:
    """Edges between chunks, both ways: candidates of near hashes and their neighbours, the best of each pair of chunks."""
    p = index.params
    records = written(index.records().select("chunk", "vec_id", "norm", "words"))
    sizes = records.groupBy("chunk").agg(F.count("*").alias("n"))
    order = [F.col("norm").desc(), F.col("vec_id").asc()]
    chunks = partition.positions(records.select("chunk", "vec_id", "norm"), ["chunk"], order, "pos").withColumn("pos", F.col("pos").cast("int"))
    hashes = records.select("vec_id", *[F.col("words")[t].alias(f"h{t}") for t in range(p.tables)])
    tables = srp.hash_tables(hashes, chunks, p.tables)
    cross = graph.cross_chunk_join(tables, partition.chunk_pairs(sizes, p.links), base, p.width)
    edges = written(graph.expand_cross_edges(cross, index.edges(), chunks, base, p.links).select("src", "block2", "dst", "block1"))
    there = edges.select(F.col("block2").alias("src_chunk"), "src", F.col("block1").alias("dst_chunk"), "dst")
    back = edges.select(F.col("block1").alias("src_chunk"), F.col("dst").alias("src"), F.col("block2").alias("dst_chunk"), F.col("src").alias("dst"))
    return there.union(back).distinct()


def load_index(spark: SparkSession, path: str) -> Index:
    """The index saved at ``path``, with the parameters that it was built with."""
    import ast

    return Index(spark, path, IndexParams(**dict(ast.literal_eval(spark.read.parquet(f"{path}/params").first()[0]))))


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of the files below ``path``."""
    fs, p = hadoop(spark, path)
    return fs.getContentSummary(p).getLength()


def version(base: DataFrame) -> str:
    """Names a table's state without reading it: its plan's files with their sizes and times.

    Rows that are not from files, or go through code, have none: see :func:`fingerprint`.
    """
    spark, out = base.sparkSession, []
    for name in sorted(base.inputFiles()):
        fs, p = hadoop(spark, name)
        status = fs.getFileStatus(p)
        out.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return f"{len(out)}-{hash_text(' '.join(out) + base._jdf.queryExecution().optimizedPlan().canonicalized().toString())}" if out else ""


def hash_text(text: str) -> str:
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()


def build_or_load(spark: SparkSession, base: DataFrame, path: str, p: IndexParams = IndexParams(), info: str | None = None, by: str = "content") -> Index:
    """The index at ``path`` if it is complete there, of the same rows and parameters; else it is built and saved.

    ``by`` says how rows are recognised: "content" reads and hashes them all,
    "files" compares the files that they come from and the plan, and reads
    nothing.  ``info`` is a table that gets a row (path, seconds, bytes,
    memory_mb) for each build.  What an index was made of is kept beside it,
    at ``path``.about.
    """
    mark = version(base) if by == "files" else ""
    of, about = f"{mark or fingerprint(base)} {p}", f"{path}.about"
    if not (table_exists(spark, f"{path}/shards") and table_exists(spark, about) and spark.read.parquet(about).first()[0] == of):
        began = time.perf_counter()
        build_index(base, p, path)
        spark.createDataFrame([(of,)], "made_of string").coalesce(1).write.mode("overwrite").parquet(about)
        if info:
            row = [(path, time.perf_counter() - began, size_of(spark, path), peak_memory(spark))]
            spark.createDataFrame(row, "path string, seconds double, bytes long, memory_mb double").write.mode("append").parquet(info)
    return load_index(spark, path)


def fingerprint(base: DataFrame) -> str:
    """Identifies a table's content regardless of its order; names cached ground truth."""
    h = base.agg(F.count("*").alias("n"), F.sum(F.xxhash64("vec_id", "embedding").cast("decimal(38,0)")).alias("h")).first()
    return f"{h['n']}-{h['h']}"


def cached_truth(spark: SparkSession, base: DataFrame, queries: DataFrame, k: int, folder: str) -> DataFrame:
    """Ground truth from ``folder`` if it was made of the same rows, queries and k; else computed and kept."""
    from ..operators.topk import exact_topk

    mark = fingerprint(base), fingerprint(queries.select(F.col("qid").alias("vec_id"), F.col("qv").alias("embedding")))
    path = f"{folder}/truth-{mark[0]}-{mark[1]}-{k}"
    if not table_exists(spark, path):
        exact_topk(base, queries, k).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


__all__ = ["Index", "IndexParams", "build_index", "build_or_load", "cached_truth", "fingerprint", "load_index", "table_exists", "version"]
