"""Filter interaction audit: what each of five filters removes under every order of them, from a histogram of failure masks.

A document's failures are one five-bit mask.  The masks of a part are counted
in at most 32 cells, and every figure of every order is a sum over cells, so
the documents are read once whatever the number of orders.
"""

from __future__ import annotations

import json
import math
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MIN_LONG, materialize, split_words, table

FILTERS = "ABCDE"
CELLS = 1 << len(FILTERS)
COUNTS = ("n", "good", "toxic")
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT, MARKS = 100, 80, 10, r"[#$%&*|]"


def bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def text_failures(text: Column) -> dict[str, Column]:
    """Failures that a document's own text decides, by filter; ``text`` is not null."""
    words = split_words(text)
    # one array of words for both filters
    counted = F.transform(F.array(words), lambda w: F.struct(F.size(w).cast("long").alias("all"), F.size(F.array_distinct(w)).cast("long").alias("distinct")))[0]
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    return {
        "A": counted["all"] < MIN_WORDS,
        "B": 100 * counted["distinct"] < MIN_DISTINCT_PERCENT * counted["all"],
        "C": 100 * upper > MAX_UPPER_PERCENT * F.length(text).cast("long"),
        "D": F.rlike(text, F.lit(MARKS)),
    }


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, mask) of each row of ``docs``; bit i of ``mask`` is set if filter i of ABCDE fails.

    Equal texts are found by their SHA-256, so the group-by of texts moves 32
    bytes a document, summed before the shuffle; a text that a third of the
    rows share is one sum, and its join with the rows is skewed only in rows
    of a few bytes, which Spark splits.  Filter E fails where a smaller id has
    the text; a null id counts as the smallest.  Null text is empty and fails
    A, and E if an earlier document is empty as well.  Rows that repeat an id
    and its text don't fail E for each other.  A null part is ''.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    failed = text_failures(F.col("__text"))
    own = sum((F.when(c, bit(name)).otherwise(0) for name, c in failed.items()), F.lit(0))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("__text"))
    judged = rows.select("doc_id", "part", own.alias("__own"), F.unhex(F.sha2("__text", 256)).alias("__key"))
    order = F.coalesce(F.col("doc_id"), F.lit(MIN_LONG))
    firsts = judged.groupBy("__key").agg(F.min(order).alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    # written, so that the join deals both sides itself and may split a key that a third of the rows have
    firsts = materialize(firsts, "firsts")
    mask = F.col("__own") + F.when(order > F.col("__first"), bit("E")).otherwise(0)
    return judged.join(firsts, "__key", "left").select("doc_id", "part", mask.cast("int").alias("mask"))


def mask_cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): the mask histogram of each part.

    ``labels`` (doc_id, quality, toxic) may hold several rows of an id, of
    which any decides; a document without a label counts in ``n`` only.
    """
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    met = masks.join(known.withColumnRenamed("doc_id", "__id"), F.col("doc_id") == F.col("__id"), "left")
    return met.groupBy("part", "mask").agg(F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in COUNTS[1:]])


def orders() -> Column:
    """All orders of the filters, one literal array of (filter_order, step, before, own): the masks of the filters before a step and of its own."""
    steps = []
    for order in map("".join, permutations(FILTERS)):
        for i, name in enumerate(order):
            steps.append({"filter_order": order, "step": i + 1, "before": sum(map(bit, order[:i])), "own": bit(name)})
    return F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,before:int,own:int>>")


def audit(cells: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, from (part, mask, n, good, toxic).

    Returns (part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley).  ``shapley`` is the filter's removals
    summed over all orders: a document that fails m filters is removed by each
    of them in 120 / m orders.  A part of no document has no rows.
    """
    at = lambda c, m: F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)).cast("long")
    wide = cells.groupBy("part").agg(*[F.array(*[at(c, m) for m in range(CELLS)]).alias(c) for c in COUNTS])
    row = wide.withColumn("at", F.explode(orders())).select("part", "at.*", *COUNTS)
    masks = F.array(*[F.lit(m) for m in range(CELLS)])
    has, hit = (lambda m: m.bitwiseAND(F.col("own")) != 0), (lambda m: m.bitwiseAND(F.col("before")) != 0)
    total = lambda c, keep: F.aggregate(F.filter(masks, keep), F.lit(0).cast("long"), lambda s, m: s + F.col(c)[m])
    here = lambda m: has(m) & ~hit(m)
    share = F.array(*[F.lit(math.factorial(len(FILTERS)) // max(1, m.bit_count())).cast("long") for m in range(CELLS)])
    return row.select(
        "part", "filter_order", "step",
        total("n", lambda m: ~has(m) & ~hit(m)).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m: has(m) & hit(m)).alias("redundant"),
        F.element_at("n", F.col("own") + 1).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        F.aggregate(F.filter(masks, has), F.lit(0).cast("long"), lambda s, m: s + F.col("n")[m] * share[m]).alias("shapley"),
    )


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    """The audit of the whole ``documents`` table by ``lang``."""
    masks = failure_masks(table(spark, sf_dir, "documents"))
    return audit(mask_cells(masks, table(spark, sf_dir, "labels")))
