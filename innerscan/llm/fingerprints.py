"""Bottom-k sketches of hashed word shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import MIN_LONG, bucket_of, range_bounds, shuffle_partitions, split_words, table

K = 128
SHINGLE = 5


def with_sketch(df: DataFrame, text_col: str, out: str, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Add the sorted ``k`` smallest distinct hashes of the text's word shingles.

    Words are runs of non-white-space, lower-cased.  Fewer than ``shingle``
    words are one shingle; null, empty and blank texts have none, so an empty
    sketch.  Texts of any length are read whole.
    """
    hw, n = F.col("__hw"), F.size("__hw")
    rolled = F.transform(F.sequence(F.lit(1), n - (shingle - 1)), lambda i: F.xxhash64(*[F.element_at(hw, i + j) for j in range(shingle)]))
    short = F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.aggregate(hw, F.lit(SHINGLE).cast("long"), lambda a, x: F.xxhash64(a, x))))
    all_ = F.when(n >= shingle, rolled).otherwise(short)
    return (
        df.withColumn("__hw", F.transform(split_words(F.lower(F.col(text_col))), lambda w: F.xxhash64(w)))
        .withColumn(out, F.slice(F.sort_array(F.array_distinct(all_)), 1, k))
        .drop("__hw")
    )


def merge_sketches(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts taken together; null counts as empty."""
    empty = F.array().cast("array<bigint>")
    return F.slice(F.sort_array(F.array_union(F.coalesce(a, empty), F.coalesce(b, empty))), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard index; exact for sets of up to ``k`` shingles. Two empty sketches: 1, one: 0."""
    both = merge_sketches(a, b, k)
    common = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, 1.0).otherwise(common / F.size(both))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    kth = (F.element_at(a, k).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / kth)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has; an empty ``a`` is contained in any: 1."""
    r = resemblance(a, b, k)
    common = r * (distinct_shingles(merge_sketches(a, b, k), k))
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), common / distinct_shingles(a, k)))


def encode(a: Column) -> Column:
    """A sketch as text: 16 hex digits a hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def decode(c: Column) -> Column:
    """The sketch that :func:`encode` wrote."""
    n = (F.length(c) / 16).cast("int")
    half = lambda i, o: F.conv(F.substr(c, i * 16 + 1 + o, F.lit(8)), 16, 10).cast("long")
    one = lambda i: F.shiftleft(half(i, 0), 32).bitwiseOR(half(i, 8))
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), one))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document with an edited text: its last quarter replaced by the next document's beginning.

    Returns (doc_id, text, edited, wrap, bucket) where the rows of wrap 1 are
    copies of the document that follows a bucket's last; documents are
    ordered by id (null first), equal ids by their text's hash, and the first
    follows the last.  Ids are cut into ranges of about equal numbers; a
    range's first document is copied to the range before, so one shuffle and
    one sort within ranges find every next document.

    Null text is empty; an empty text stays as it is, and so does one of fewer
    than four characters.  Repeated rows are documents each, and follow each
    other.  A single document follows itself.  An empty table gives an empty
    result; columns other than id and text are ignored, whatever their names.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("__at", F.coalesce(F.col("doc_id").cast("long"), F.lit(MIN_LONG)))
    bounds = range_bounds(base.select("__at"), "__at", max(64, 4 * shuffle_partitions(spark)))
    n = max(1, len(bounds))
    bucket = bucket_of(F.col("__at"), bounds).cast("int")
    here = F.struct(F.lit(0).alias("wrap"), F.col("__b").alias("bucket"))
    before = F.struct(F.lit(1).alias("wrap"), F.pmod(F.col("__b") - 1, F.lit(n)).cast("int").alias("bucket"))
    starts = F.array(*[F.lit(x).cast("long") for x in bounds or [0]])
    dealt = base.withColumn("__b", bucket).withColumn("__first", F.element_at(starts, F.col("__b") + 1) == F.col("__at"))
    dealt = dealt.withColumn("__to", F.explode(F.when(F.col("__first"), F.array(here, before)).otherwise(F.array(here))))
    dealt = dealt.select("doc_id", "text", "__at", "__to.wrap", "__to.bucket")
    w = order()
    nxt = F.lead("text").over(w)
    chars = F.length("text")
    m = F.floor(chars / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), chars - m), F.substr(F.coalesce(F.col("__next"), F.lit("")), F.lit(1), m))
    return dealt.withColumn("__next", nxt).withColumn("edited", edited).drop("__next")


def order():
    return Window.partitionBy("bucket").orderBy("wrap", "__at", F.xxhash64("text"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text of ``documents`` and of its edited text."""
    pairs = edited_pairs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    both = with_sketch(with_sketch(pairs, "text", "__fp"), "edited", "__efp")
    both = both.withColumn("__nfp", F.lead("__fp").over(order())).where(F.col("wrap") == 0)
    return both.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        encode(F.col("__fp")).alias("fingerprint"),
        encode(F.col("__efp")).alias("edited_fingerprint"),
        resemblance(F.col("__fp"), F.col("__efp")).alias("near_edited"),
        resemblance(F.col("__fp"), F.col("__nfp")).alias("near_next"),
        distinct_shingles(F.col("__fp")).alias("n_shingles"),
        containment(F.col("__fp"), F.col("__efp")).alias("contained_in_edited"),
    )
