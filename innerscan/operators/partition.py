"""Partitioning by descending norm."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import squared_norm
from ..storage import written


def with_norms(base: DataFrame) -> DataFrame:
    return base.withColumn("sq_norm", squared_norm(F.col("embedding"))).withColumn("norm", F.sqrt("sq_norm"))


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """Add the 0-based position of each row among those of its keys, in a total order.

    A range sort, written once, and prefix counts of its partitions; so keys
    that hold everything are spread over tasks, and a lost executor changes
    nothing.
    """
    ranged = written(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("__p", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(*keys, "__p").agg(F.count("*").alias("__n")).withColumn("__b", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    rn = F.row_number().over(Window.partitionBy("__p", *keys).orderBy(*order))
    return ranged.withColumn("__r", rn).join(counts.drop("__n"), ["__p", *keys]).withColumn(out, F.col("__b") + F.col("__r") - 1).drop("__p", "__r", "__b")


def with_earlier(df: DataFrame, keys: Sequence[str], pos: str, width: int, item: Column, out: str, bucket: int = 8_192) -> DataFrame:
    """Add the list of ``item`` of the ``width`` rows before each by ``pos``, positions without gaps among the keys.

    Positions are cut into buckets; each gets the last ``width`` rows of the
    one before along, so no key is handled by one task.
    """
    size = max(bucket, 4 * width)
    own = F.floor(F.col(pos) / size)
    near = df.withColumn("__bucket", F.explode(F.array_distinct(F.array(own, F.floor((F.col(pos) + width) / size)))))
    w = Window.partitionBy(*keys, "__bucket").orderBy(pos).rowsBetween(-width, -1)
    return near.withColumn(out, F.collect_list(item).over(w)).where(F.col("__bucket") == own).drop("__bucket")


def by_norm(base: DataFrame) -> DataFrame:
    """(vec_id, sq_norm, gpos): position in the order of descending norm, ties by id; embeddings are not moved."""
    ids = base.select("vec_id", squared_norm(F.col("embedding")).alias("sq_norm"))
    return positions(ids, [], [F.col("sq_norm").desc(), F.col("vec_id").asc()], "gpos").select("vec_id", "sq_norm", "gpos")


def chunk_bounds(positions: DataFrame, ratio: float = 0.85, min_size: int = 32) -> list[tuple[int, int]]:
    """[start, stop) of each chunk in norm order.

    A chunk with start s and least size m ends at the first position from
    s + m whose squared norm is below ``ratio`` times the start's, if more
    than m rows are left, else it takes the rest; m doubles.  So there are
    about log2(n / min_size) chunks at most, found by two small aggregates each.
    """
    n, out, s, m = positions.count(), [], 0, min_size
    while s < n:
        top = positions.where(F.col("gpos") == s).first()["sq_norm"]
        low = positions.where((F.col("gpos") > s) & (F.col("sq_norm") < F.lit(ratio) * F.lit(top))).agg(F.min("gpos")).first()[0]
        b = n if low is None else max(s + m, low)
        b = b if b < n and n - b > m else n
        out.append((s, b))
        s, m = b, 2 * m
    return out


def norm_chunks(base: DataFrame, ratio: float = 0.85, min_size: int = 32) -> DataFrame:
    """(vec_id, sq_norm, chunk, pos) with ``pos`` the position in the chunk."""
    placed = written(by_norm(base))
    bounds = chunk_bounds(placed, ratio, min_size)
    chunk, start = F.lit(0), F.lit(0)
    for i, (s, _) in enumerate(bounds):
        chunk = F.when(F.col("gpos") >= s, i).otherwise(chunk)
        start = F.when(F.col("gpos") >= s, s).otherwise(start)
    return placed.select("vec_id", "sq_norm", chunk.cast("int").alias("chunk"), (F.col("gpos") - start).cast("int").alias("pos"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("chunk").agg(F.count("*").alias("n"), F.max("sq_norm").alias("max_sq_norm"))


def chunk_pairs(stats: DataFrame, links: int = 32) -> DataFrame:
    """(block1, block2, s): a chunk with the chunks 1, 2, 4, ... after it and the links between them, halving."""
    n = stats.count()
    rows = []
    for i in range(n):
        step, s = 1, links
        while i + step < n:
            rows.append((i, i + step, max(1, s)))
            step, s = 2 * step, s // 2
    return stats.sparkSession.createDataFrame(rows, "block1 int, block2 int, s int")


def norm_range(base: DataFrame) -> DataFrame:
    sq = base.select(squared_norm(F.col("embedding")).alias("x"))
    return sq.agg(F.max("x").alias("max_sq_norm"), F.min("x").alias("min_sq_norm"), (F.max("x") / F.min("x")).alias("norm_range"))
