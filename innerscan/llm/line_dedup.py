"""Line dedup against levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import session_dir
from .common import MIN_LONG, ascii_lower, bucket_of, delete, few, materialize, range_bounds, shuffle_partitions, table, unwrapped, whole_rows, ws_strip

SEED = 0x5EED


def line_key(line):
    """What makes two lines the same: ASCII white space stripped at both ends, A-Z lower-cased."""
    return ascii_lower(ws_strip(line))


class LineRuns:
    """An index of line hashes in sorted runs, merged level by level.

    A run is a table (h1, h2, n, top) bucketed and sorted by its 128-bit key:
    the documents that hold a line and the largest id among them.  Buckets
    line up, so a batch is compared with a run, and runs are merged, by a
    merge join without a shuffle.  A level that reaches ``fanout`` runs is
    merged into one run of the next level, so a key is rewritten a
    logarithmic number of times.  Runs lie in the folder that executors share.
    """

    def __init__(self, spark: SparkSession, buckets: int, fanout: int = 2):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.folder, self.levels, self.written = f"{session_dir(spark)}/{uuid.uuid4().hex}", [], []

    def _write(self, df: DataFrame) -> str:
        name = f"run_{uuid.uuid4().hex}"
        self.written.append(name)
        df = df.select("h1", "h2", "n", "top").repartition(self.buckets, "h1", "h2")
        (
            df.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").format("parquet")
            .option("path", f"{self.folder}/{name}").saveAsTable(name)
        )
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(n) for level in self.levels for n in level]

    def _merged(self, names: list[str]) -> DataFrame:
        out = self.spark.table(names[0])
        for n in names[1:]:
            other = self.spark.table(n).select("h1", "h2", F.col("n").alias("n_"), F.col("top").alias("top_"))
            out = out.join(other, ["h1", "h2"], "full_outer").select(
                "h1", "h2", (F.coalesce("n", F.lit(0)) + F.coalesce("n_", F.lit(0))).alias("n"),
                F.greatest("top", "top_").alias("top"),
            )
        return out

    def add(self, keys: DataFrame, known: int | None = None) -> None:
        """Add a batch's (h1, h2, top) rows as a run.

        ``known``: keys of which a run already has so many documents are left
        out by an anti-join with each run; what is known of them stands.
        """
        new = keys.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("top").alias("top"))
        if known is not None:
            for run in self.runs():
                new = new.join(run.where(F.col("n") >= known).select("h1", "h2"), ["h1", "h2"], "left_anti")
        level, name = 0, self._write(new)
        while True:
            if len(self.levels) == level:
                self.levels.append([])
            self.levels[level].append(name)
            if len(self.levels[level]) < self.fanout:
                return
            name, self.levels[level] = self._write(self._merged(self.levels[level])), []
            level += 1

    def compact(self) -> DataFrame:
        """All runs merged."""
        names = [n for level in self.levels for n in level]
        return self._merged(names)

    def drop(self) -> None:
        """Let go of all runs, with their files."""
        for name in self.written:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(self.spark, self.folder)
        self.written, self.levels = [], []


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 40,
    min_docs: int = 5,
    batches: int = 4,
) -> DataFrame:
    """Drop lines that many documents repeat, but for the document of the largest id.

    Returns the columns of ``docs`` with ``text_col`` replaced, and ``n_lines``
    (before), ``n_dropped``.  A line whose key has at least ``min_chars`` code
    points and is found in at least ``min_docs`` documents stays only in the
    document with the largest id that holds it.

    Documents come in batches of descending ids, so a key's first batch has
    its largest id; a batch's keys that the index already knows from
    ``min_docs`` documents are left out by a merge anti-join, the rest becomes
    a new sorted run.  A line's documents are counted by partial aggregates:
    a line that a third of all documents hold is one row a task.

    The index keeps 128-bit hashes; what is dropped is told by line numbers,
    so a text of very many lines costs no more a line than a short one.  Keys
    to drop are broadcast where they are few; otherwise both sides of the join
    are shuffled, and a very common key's rows are split by Spark's skew join.

    Null or empty text is one empty line and stays as it is (null becomes the
    empty text).  Repeated rows count as documents each; rows that share an id
    share the decision.  A null id counts as the smallest.  An empty table
    gives an empty result.  Columns of ``docs`` named n_lines or n_dropped are
    replaced.
    """
    spark = docs.sparkSession
    own = lambda c: F.coalesce(c.cast("long"), F.lit(MIN_LONG))
    lines = lambda c: F.split(F.coalesce(c, F.lit("")), "\n", -1)
    bounds = range_bounds(docs.select(own(F.col(id_col)).alias("top")), "top", batches)
    found = F.transform(lines(F.col(text_col)), lambda x: F.when(F.length(x) >= min_chars, line_key(x)))
    hashed = F.transform(found, lambda k, i: F.when(F.length(k) >= min_chars, F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(SEED), k).alias("h2"), i.alias("at"))))
    read = docs.select(own(F.col(id_col)).alias("top"), F.xxhash64(text_col).alias("th"), F.sort_array(F.array_compact(hashed)).alias("keys"))
    same = lambda x, y: (x["h1"] == y["h1"]) & (x["h2"] == y["h2"])
    marked = F.transform("keys", lambda x, i: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"), x["at"].alias("at"), ((i == 0) | ~same(x, F.get("keys", i - 1))).alias("first")))
    # the outer form, as explode's own filter would be pushed below and compute the keys anew for each of them
    keys = read.withColumn("keys", F.when(F.size("keys") > 0, marked)).select("top", "th", F.explode_outer("keys").alias("k")).where("k is not null").select("top", "th", "k.*")
    keys = materialize(keys.withColumn("batch", bucket_of(F.col("top"), bounds)), "line_keys")
    index = LineRuns(spark, shuffle_partitions(spark))
    for b in reversed(range(max(1, len(bounds)))):
        index.add(keys.where((F.col("batch") == b) & F.col("first")).select("h1", "h2", "top"), known=min_docs)
    common = materialize(index.compact().where(F.col("n") >= min_docs).select("h1", "h2", F.col("top").alias("keeper")), "common")
    index.drop()
    drops = (
        keys.join(few(common), ["h1", "h2"])
        .where(F.col("top") < F.col("keeper"))
        .groupBy(F.col("top").alias("__id"), F.col("th").alias("__th"))
        .agg(F.collect_set("at").alias("__drops"))
    )
    text = F.col("__row")[text_col]
    joined = whole_rows(docs).withColumn("__own", own(F.col("__row")[id_col])).withColumn("__own_th", F.xxhash64(text))
    joined = joined.join(drops, (F.col("__own") == F.col("__id")) & (F.col("__own_th") == F.col("__th")), "left").withColumn("__lines", lines(text))
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__drops")
    kept = joined.withColumn("__kept", F.when(F.col("__drops").isNull(), F.col("__lines")).otherwise(F.transform(left, lambda i: F.get("__lines", i))))
    done = kept.select(
        "__row",
        F.array_join("__kept", "\n").alias("__text"),
        F.size("__lines").cast("long").alias("__n"),
        (F.size("__lines") - F.size("__kept")).cast("long").alias("__dropped"),
    )
    columns = [*[c for c in docs.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped"]
    return unwrapped(done, columns, **{text_col: F.col("__text"), "n_lines": F.col("__n"), "n_dropped": F.col("__dropped")})


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest of :func:`dedup_lines` over the whole ``documents`` table."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
