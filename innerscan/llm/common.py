"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import math
import weakref
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import delete, new_path

#: ASCII white space, as used by every word and line rule here.
WS_CHARS = " \t\n\x0b\f\r"
WS_REGEX = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_LONG = -(2**63)
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Where the tables of :func:`materialize` are.
WRITTEN: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
#: Rows that are broadcast at most; beyond it tables are joined by a shuffle.
FEW_ROWS = 200_000


def materialize(df: DataFrame, name: str = "t", partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    Cuts the lineage, computes an expensive input once though several jobs
    read it, and survives the loss of executors.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    WRITTEN[out] = path
    return out


def steady_heap() -> None:
    """Let this process keep what numpy frees, up to 16 MB: paging temporaries in anew costs more than computing them."""
    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (OSError, AttributeError):  # no such C library: slower, otherwise the same
        return
    for option in (-1, -3):  # trim and map from this size on
        mallopt(option, 16 << 20)


def forget(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that only written results still stem from."""
    for df in tables:
        if path := WRITTEN.pop(df, None):
            delete(df.sparkSession, path)


def few(df: DataFrame, rows: int = FEW_ROWS) -> DataFrame:
    """``df``, a written table of narrow rows, marked for broadcasting if it is proven to have ``rows`` at most."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Inside, the files of a query's shuffles are deleted when it ends, not when the driver's garbage is collected.

    For steps that write tables: a query that is run again would compute its shuffles anew.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before or "false")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character left alone."""
    return F.translate(c, UPPER, UPPER.lower())


def ws_strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def split_words(c: Column) -> Column:
    """Array of the maximal runs of non-white-space; null or blank: empty array."""
    t = ws_strip(F.coalesce(c, F.lit("")))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WS_REGEX))


def word_count(c: Column) -> Column:
    t = ws_strip(F.coalesce(c, F.lit("")))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, WS_REGEX))).cast("long")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def range_bounds(df: DataFrame, col: str, buckets: int) -> list:
    """Ascending distinct existing values of a numeric column that cut it into about equal parts.

    At most ``buckets`` values reach the driver.  The first is the minimum.
    """
    cuts = [i / buckets for i in range(1, buckets)]
    row = df.agg(
        F.min(col).alias("lo"),
        (F.percentile_approx(col, cuts, max(10_000, 20 * buckets)) if cuts else F.lit(None)).alias("cuts"),
    ).first()
    if row is None or row["lo"] is None:
        return []
    return sorted({row["lo"], *(row["cuts"] or [])})


def bucket_of(c: Column, bounds: list) -> Column:
    """Index of the last bound at or below the value; looked up in two levels, so with 2 sqrt(n) comparisons."""
    if len(bounds) <= 1:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    lits = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    top = F.greatest(F.size(F.filter(lits([p[0] for p in parts]), lambda b: b <= c)), F.lit(1))
    inner = F.size(F.filter(F.element_at(F.array(*map(lits, parts)), top), lambda b: b <= c))
    return (top - 1) * F.lit(step) + F.greatest(inner, F.lit(1)) - 1


def global_rank(df: DataFrame, order: Sequence[Column], rank: str) -> DataFrame:
    """Add the 0-based rank in a total order, by a range sort and prefix counts of its partitions."""
    part = "__part"
    ranged = materialize(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranked")
    before = ranged.groupBy(part).agg(F.count("*").alias("__n"))
    w = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    before = before.select(part, F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))
    inner = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return (
        ranged.withColumn("__rn", inner)
        .join(before, part)
        .withColumn(rank, F.col("__before") + F.col("__rn") - 1)
        .drop(part, "__rn", "__before")
    )


def whole_rows(df: DataFrame) -> DataFrame:
    """All columns as one, ``__row``, so that no name clashes with a helper's."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"))


def unwrapped(df: DataFrame, columns: Sequence[str], **replaced: Column) -> DataFrame:
    """The columns of ``__row`` again, some replaced."""
    return df.select(*[(replaced[c] if c in replaced else F.col("__row")[c]).alias(c) for c in columns])
