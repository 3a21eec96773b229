"""A table of vectors kept in order of descending norm, and exact search that reads its first files and what these leave.

Norms are a column of the files, whose statistics let a literal bound skip
row groups and files before they are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import as_double, norm
from ..operators.partition import with_norms
from ..operators.topk import exact_topk, rank_by_ip
from ..storage import written

SCHEMA = "vec_id bigint, embedding array<double>, norm double"
FIRST_ROWS = 50_000


@dataclass
class Read:
    """A wave's norms, [low, high), and the rows of the files that hold some of them."""

    low: float
    high: float
    rows: int


def save_by_norm(base: DataFrame, path: str, file_rows: int = 500_000, group_bytes: int = 8 << 20) -> None:
    """Write (vec_id, embedding, norm) in order of descending norm, ``file_rows`` about a file, in row groups of ``group_bytes``; and each file's norms."""
    rows = with_norms(base.where("embedding is not null")).select("vec_id", as_double(F.col("embedding")).alias("embedding"), "norm")
    n = base.count()
    ordered = rows.repartitionByRange(max(1, -(-n // file_rows)), F.col("norm").desc(), "vec_id").sortWithinPartitions(F.col("norm").desc(), "vec_id")
    ordered.write.mode("overwrite").option("parquet.block.size", group_bytes).parquet(f"{path}/vectors")
    files = open_by_norm(base.sparkSession, path).groupBy(F.input_file_name().alias("file"))
    files.agg(F.count("*").alias("n"), F.max("norm").alias("high"), F.min("norm").alias("low")).write.mode("overwrite").parquet(f"{path}/files")


def open_by_norm(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(f"{path}/vectors")


def between(rows: DataFrame, low: float, high: float) -> DataFrame:
    """Rows of norms in [low, high), bounds that the scan itself applies."""
    return rows.where((F.col("norm") >= F.lit(low)) & (F.col("norm") < F.lit(high)))


def sorted_topk(spark: SparkSession, path: str, queries: DataFrame, k: int, first_rows: int = FIRST_ROWS, trace: list[Read] | None = None) -> DataFrame:
    """Exact (qid, rank, vec_id, ip) of queries of any length over a table of :func:`save_by_norm`.

    The largest norms, ``first_rows`` of them or a file, are searched first;
    the least norm that can still improve some query, the smallest of their
    k-th best products by their lengths, bounds what is read from there on.
    Waves double, and each bound is a literal of its scan.  A query with
    fewer than k results, of length zero, or whose k-th best product is not
    positive, needs every row.
    """
    files = spark.read.schema("file string, n bigint, high double, low double").parquet(f"{path}/files").orderBy(F.col("high").desc()).collect()
    rows = open_by_norm(spark, path)
    lengths = queries.select("qid", norm(F.col("qv")).alias("length"))
    high, best, at, take = float("inf"), None, 0, first_rows
    floor = 0.0
    while at < len(files) and (best is None or floor <= files[at]["high"]):
        upto, got = at, 0
        while upto < len(files) and (got < take or upto == at):
            got, upto = got + files[upto]["n"], upto + 1
        # norms that two files share are read in the later wave
        low = max(files[upto]["high"] * (1 + 1e-15) if upto < len(files) else 0.0, floor)
        if trace is not None:
            trace.append(Read(low, high, sum(f["n"] for f in files if f["high"] >= low and f["low"] < high)))
        part = between(rows, low, high)
        new = exact_topk(part, queries, k).select("qid", "vec_id", "ip")
        best = written(rank_by_ip(new if best is None else best.select("qid", "vec_id", "ip").unionByName(new), k).select("qid", "rank", "vec_id", "ip"))
        high, at, take = low, upto, 2 * take
        kth = lengths.join(best.where(F.col("rank") == k), "qid", "left")
        # just below the bound, so that rounding never hides an equal product of a smaller id
        need = F.coalesce(F.when(F.col("length") > 0, F.try_divide(F.col("ip"), F.col("length"))), F.lit(0.0)) * (1 - 1e-9)
        floor = max(0.0, kth.agg(F.min(need)).first()[0] or 0.0)
    if best is None:
        return spark.createDataFrame([], "qid bigint, rank int, vec_id bigint, ip double")
    return best
