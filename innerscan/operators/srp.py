"""Sign random projections: hashes, sorted tables and window searches in them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import written
from .partition import positions
from .topk import matrix

TABLES, BITS, SEED = 4, 16, 42
LEVELS = 17
TOP = 65535
#: Hash values of a stretch of a window.
STRETCH = 256


def projections(dim: int, tables: int = TABLES, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """Seeded Gaussian vectors, a row for each bit."""
    if not (1 <= tables <= 4 and 1 <= bits <= 16):
        raise ValueError("at most 4 tables of 16 bits")
    return np.random.default_rng(seed).standard_normal((tables * bits, dim))


def pack(x: np.ndarray, proj: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """One word for each table; bit l is set if the projection is positive."""
    signs = (x @ proj.T > 0).reshape(len(x), tables, bits)
    return (signs * (1 << np.arange(bits))).sum(axis=2)


def srp_hash(df: DataFrame, dim: int, id_col: str = "vec_id", vec_col: str = "embedding", tables: int = TABLES, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """(id, h0, h1, ...): the words as integers of 0 to 65535."""
    proj = projections(dim, tables, bits, seed)
    names = [f"h{i}" for i in range(tables)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pack(matrix(batch.column(1)), proj, tables, bits) if batch.num_rows else np.zeros((0, tables), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(words[:, i].astype(np.int32)) for i in range(tables)]], names=[id_col, *names])

    return df.select(F.col(id_col).cast("long"), vec_col).mapInArrow(run, f"{id_col} bigint, " + ", ".join(f"{n} int" for n in names))


def hash_tables(hashes: DataFrame, chunks: DataFrame, tables: int = TABLES) -> DataFrame:
    """(chunk, tbl, h, pos, vec_id, slot): each chunk's entries of each table in order of (h, pos)."""
    words = F.array(*[F.col(f"h{i}") for i in range(tables)])
    long = hashes.join(chunks.select("vec_id", "chunk", "pos"), "vec_id").select("vec_id", "chunk", "pos", F.posexplode(words).alias("tbl", "h"))
    return positions(long, ["chunk", "tbl"], [F.col("h"), F.col("pos")], "slot").withColumn("slot", F.col("slot").cast("int"))


def window_level(h, hq):
    """The least level at which an aligned, doubling window around ``hq`` takes in ``h``: -1 for equal hashes.

    At level t it is [floor(hq / 2^t) 2^t, that + 2^t], the right end included
    and at most 65535.
    """
    level = F.lit(LEVELS)
    for t in reversed(range(LEVELS)):
        low = F.shiftright(hq, t) * F.lit(1 << t)
        level = F.when((h >= low) & (h <= F.least(low + F.lit(1 << t), F.lit(TOP))), t).otherwise(level)
    return F.when(h == hq, -1).otherwise(level)


def power(level):
    return F.call_function("shiftleft", F.lit(1), level)


def low_end(hq, level):
    """Where the aligned block of 2^level hash values begins that ``hq`` is in."""
    return F.call_function("shiftright", hq, level) * power(level)


def windows(query_hashes: DataFrame) -> DataFrame:
    """(qid, tbl, hq, level, low, high): the 18 windows around each word of a query, from equal hashes (-1) to everything."""
    n_tables = len([c for c in query_hashes.columns if c.startswith("h")])
    q = query_hashes.select("qid", F.posexplode(F.array(*[F.col(f"h{i}") for i in range(n_tables)])).alias("tbl", "hq"))
    q = q.withColumn("level", F.explode(F.sequence(F.lit(-1), F.lit(LEVELS - 1))))
    t = F.greatest("level", F.lit(0))
    low = F.when(F.col("level") < 0, F.col("hq")).otherwise(low_end(F.col("hq"), t))
    high = F.when(F.col("level") < 0, F.col("hq")).otherwise(F.least(low_end(F.col("hq"), t) + power(t), F.lit(TOP)))
    return q.withColumns({"low": low, "high": high})


def block_counts(tables: DataFrame) -> DataFrame:
    """(chunk, tbl, size, low, n): entries in each aligned block of 2^size hash values that has one, of which a table has 2^17 at most."""
    by_hash = tables.groupBy("chunk", "tbl", "h").agg(F.count("*").alias("n"))
    levels = by_hash.withColumn("size", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))))
    return levels.groupBy("chunk", "tbl", "size", low_end(F.col("h"), F.col("size")).alias("low")).agg(F.sum("n").alias("n"))


def window_counts(blocks: DataFrame, query_hashes: DataFrame) -> DataFrame:
    """(qid, chunk, level, upto): how many entries of all tables each window holds, where it holds more than the one before.

    Windows are aligned blocks of hash values and the value after; they meet
    the counts of :func:`block_counts` by equality, so neither the work nor
    the result is queries times entries.
    """
    asked = windows(query_hashes)
    parts = asked.select("qid", "tbl", "level", F.explode(F.array(
        F.struct(F.greatest("level", F.lit(0)).alias("size"), F.col("low").alias("low")),
        F.when((F.col("level") >= 0) & (F.col("high") == F.col("low") + power(F.greatest("level", F.lit(0)))), F.struct(F.lit(0).alias("size"), F.col("high").alias("low"))),
    )).alias("p")).where("p is not null").select("qid", "tbl", "level", "p.*")
    upto = parts.join(blocks, ["tbl", "size", "low"]).groupBy("qid", "chunk", "level").agg(F.sum("n").alias("upto"))
    before = F.lag("upto").over(Window.partitionBy("qid", "chunk").orderBy("level"))
    return upto.withColumn("__b", F.coalesce(before, F.lit(0))).where(F.col("upto") > F.col("__b")).drop("__b")


def srp_seeds(tables: DataFrame, query_hashes: DataFrame, ub: int, blocks: DataFrame | None = None) -> DataFrame:
    """(qid, chunk, vec_id): candidates by hash, in each chunk from the smallest window that has ``ub`` entries.

    With ``blocks``, counts that were saved with the tables, entries are read
    only where a window is: the stretches asked for, of which there are at
    most 256, are a literal filter that skips row groups of sorted tables.

    At most ub + 1 entries are kept, in the order of (table, hash, position);
    an entry in several tables counts in each for the window's size, once for
    the candidates.  Only entries near a query's window meet it: windows are
    cut into stretches of ``STRETCH`` hash values, and those are joined.
    """
    counts = window_counts(block_counts(tables) if blocks is None else blocks, query_hashes)
    stop = counts.groupBy("qid", "chunk").agg(F.coalesce(F.min(F.when(F.col("upto") >= ub, F.col("level"))), F.max("level")).alias("level"))
    asked = windows(query_hashes).join(stop, ["qid", "level"]).select("qid", "chunk", "tbl", "low", "high")
    asked = asked.withColumn("part", F.explode(F.sequence(F.floor(F.col("low") / STRETCH), F.floor(F.col("high") / STRETCH))))
    if blocks is not None:
        asked = written(asked)
        parts = [r[0] for r in asked.select("part").distinct().collect()]
        tables = tables.where(F.col("part").isin(parts))
    else:
        tables = tables.withColumn("part", F.floor(F.col("h") / STRETCH))
    near = tables.join(asked, ["chunk", "tbl", "part"]).where(F.col("h").between(F.col("low"), F.col("high")))
    near = near.groupBy("qid", "chunk", "vec_id").agg(F.min(F.struct("tbl", "h", "pos")).alias("at"))
    order = Window.partitionBy("qid", "chunk").orderBy("at.tbl", "at.h", "at.pos")
    return near.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= ub + 1).select("qid", "chunk", "vec_id")


def entry_point(tables: DataFrame, query_hashes: DataFrame) -> DataFrame:
    """(qid, vec_id): in the first chunk's first table the last entry below or at the query's hash, else the first."""
    t = tables.where((F.col("chunk") == 0) & (F.col("tbl") == 0))
    entry = F.struct("slot", "vec_id")
    levels = t.withColumn("size", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))))
    blocks = levels.groupBy("size", low_end(F.col("h"), F.col("size")).alias("low")).agg(F.max(entry).alias("at"))
    # the values up to hq are the aligned blocks that the bits of hq + 1 name
    bits = F.filter(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda b: F.call_function("shiftright", F.col("hq") + 1, b) % 2 == 1)
    asked = query_hashes.select("qid", F.col("h0").alias("hq")).withColumn("size", F.explode(bits))
    asked = asked.withColumn("low", low_end(F.col("hq") + 1, F.col("size") + 1))
    found = asked.join(blocks, ["size", "low"]).groupBy("qid").agg(F.max("at")["vec_id"].alias("__found"))
    first = t.agg(F.min(entry)["vec_id"].alias("__first"))
    return query_hashes.select("qid").join(found, "qid", "left").join(F.broadcast(first), F.lit(True)).select("qid", F.coalesce("__found", "__first").alias("vec_id")).where("vec_id is not null")


def save_projections(spark: SparkSession, proj: np.ndarray, path: str) -> None:
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(proj)]
    spark.createDataFrame(rows, "proj int, a array<double>").write.mode("overwrite").parquet(path)


def load_projections(spark: SparkSession, path: str) -> np.ndarray:
    """The projections saved at ``path``, in their order."""
    return np.array([r["a"] for r in spark.read.parquet(path).orderBy("proj").collect()], np.float64)


def save_tables(tables: DataFrame, path: str, group_bytes: int = 8 << 20) -> None:
    """Hash tables, a folder for each chunk and table, in order of hashes and in row groups of ``group_bytes``; and their block counts."""
    kept = tables.select("chunk", "tbl", "h", "pos", "vec_id", "slot", F.floor(F.col("h") / STRETCH).alias("part"))
    ordered = kept.repartitionByRange(F.col("chunk"), F.col("tbl"), F.col("h"), F.col("pos")).sortWithinPartitions("chunk", "tbl", "h", "pos")
    ordered.write.mode("overwrite").option("parquet.block.size", group_bytes).partitionBy("chunk", "tbl").parquet(f"{path}/tables")
    block_counts(tables).write.mode("overwrite").parquet(f"{path}/blocks")


def load_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(tables, blocks): what :func:`srp_seeds` takes; vectors are neither read nor hashed."""
    tables = spark.read.schema("h int, pos int, vec_id bigint, slot int, part bigint, chunk int, tbl int").parquet(f"{path}/tables")
    return tables, spark.read.parquet(f"{path}/blocks")
