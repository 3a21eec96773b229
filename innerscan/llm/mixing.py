"""Mixing sources to target weights by hash-random keys and distributed prefix sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import global_rank, materialize, table, unwrapped, whole_rows, word_count, ws_strip

#: Documents of one source that one bucket of keys holds at about.
BUCKET_ROWS = 50_000
KEY_DIGITS = 6
#: Where a word begins after white space.
WORD_STARTS = r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"


def targets(sources: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """Add ``weight`` and ``target`` to a table (key, source, source_size).

    Sources in code point order, null last, weigh ``weights``, repeated.  They
    share the total by weight; a target above ``max_epochs`` times its source
    stops there and the excess is shared again until none is above.  Each
    round is one aggregate of the source table, of which three numbers reach
    the driver.
    """
    w = F.array(*[F.lit(int(x)).cast("long") for x in weights])
    ranked = global_rank(sources, [F.col("source").asc_nulls_last()], "ordinal")
    ranked = materialize(
        ranked.withColumn("weight", F.element_at(w, (F.col("ordinal") % len(weights) + 1).cast("int"))), "sources"
    )
    cap = F.col("source_size") * max_epochs
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        above = F.lit(False) if capped < 0 else F.col("weight") * F.lit(level) > cap
        row = ranked.agg(
            F.sum(F.when(above, 1).otherwise(0)).alias("n"),
            F.sum(F.when(above, cap).otherwise(0)).alias("cap"),
            F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("w"),
        ).first()
        if (row["n"] or 0) <= capped or not row["w"]:
            break
        capped, level = row["n"], float(total - row["cap"]) / float(row["w"])
    share = F.col("weight") * F.lit(level)
    return ranked.withColumn("target", F.when(share > cap, cap.cast("double")).otherwise(share))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (1, 2, 3),
    max_epochs: int = 3,
    seed: int = 7,
) -> DataFrame:
    """How many words the mix takes of each document.

    Returns (doc_id, source, size, source_size, target, taken), a row for each
    row of ``docs``.  A document's key is a hash of its id and ``seed``; keys
    order the documents of a source; running sums of their words, cut into
    buckets of keys so that a source of any size is spread over many tasks,
    decide.  A budget of several times the source repeats it for whole epochs;
    the document at the cut gives as many words as are left, so that the
    words taken of a source are its target, rounded.

    Null text or a text of white space only has size 0 and takes 0.  A null
    source is a source of its own, the last.  Repeated rows count each; rows
    with equal ids are ordered by size.  An empty table gives an empty result.
    Other columns of ``docs`` are ignored.
    """
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")
    )
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    sized = materialize(
        sized.withColumn("key", digest).withColumn(
            "sid", F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source")))
        ),
        "sized",
    )
    sources = sized.groupBy("sid").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = materialize(targets(sources, weights, max_epochs), "targets")
    largest = sources.agg(F.max("n")).first()[0] or 0
    buckets = 256
    while buckets * BUCKET_ROWS < largest and buckets < 16**KEY_DIGITS:
        buckets *= 2
    head = F.conv(F.substring("key", 1, KEY_DIGITS), 16, 10).cast("long")
    keyed = sized.withColumn("bucket", F.floor(head * buckets / 16**KEY_DIGITS).cast("long"))
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy("sid", "bucket")
        .agg(F.sum("size").alias("words"))
        .withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .drop("words")
        .join(sources.select("sid", "source_size", "target"), "sid")
    )
    inner = Window.partitionBy("sid", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    run = keyed.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(offsets, ["sid", "bucket"])
    budget = F.least(F.round("target").cast("long"), F.col("source_size") * max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    left = budget - whole * F.col("source_size") - F.col("before") - F.col("inner")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(left, F.col("size")))
    return run.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``docs``, once for each epoch that takes them whole.

    The document at a source's cut comes with its first words only.  A
    document of size 0 is kept once, for it takes nothing from the budget.
    Ids are taken as unique; rows of one id get the largest count among them.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    plan = mix(docs, **options).groupBy("doc_id").agg(F.max("size").alias("__size"), F.max("taken").alias("__taken"))
    plan = plan.withColumnRenamed("doc_id", "__id")
    cut = F.when(F.col("__size") > 0, F.col("__taken") % F.col("__size")).otherwise(0).cast("int")
    whole = F.when(F.col("__size") > 0, F.floor(F.col("__taken") / F.col("__size"))).otherwise(1).cast("int")
    copies = F.concat(
        F.array_repeat(F.lit(-1), whole),
        F.when(cut > 0, F.array(cut)).otherwise(F.array().cast("array<int>")),
    )
    whole_text = F.col("__row")[text_col]
    words = F.split(whole_text, WORD_STARTS)
    lead = F.when(ws_strip(words[0]) == "", 1).otherwise(0)
    head = F.array_join(F.slice(words, F.lit(1), F.col("__copy") + lead), "")
    text = F.when(F.col("__copy") < 0, whole_text).otherwise(head)
    kept = whole_rows(docs).join(plan, F.col("__row")[id_col].eqNullSafe(F.col("__id"))).withColumn("__copy", F.explode(copies))
    return unwrapped(kept, docs.columns, **{text_col: text})


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    """Contract digest of :func:`mix` over the whole ``documents`` table."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
