"""Severity of toxicity by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: Labelled rows that a model is fitted on at most, the smallest by a hash of their id.
MAX_LABELLED = 20_000
#: Standard errors that a feature's log odds are above 0 by at least, and the log odds.
MIN_Z, MIN_ODDS = 3.0, 2.0
PUNCTUATION = ".,;:!?\"'()[]{}<>«»¡¿…-_*/\\|#$%&"
CACHE_WORDS = 400_000
SCORED = "doc_id bigint, severity double, grade int, p_toxic double, evidence bigint"


def features(word: str) -> tuple[str, ...]:
    """A word, lower-cased and without punctuation at its ends, and its beginnings of three to seven characters."""
    w = word.strip(PUNCTUATION)
    if not w:
        return ()
    return (w, *[f"{n}:{w[:n]}" for n in range(3, 8) if len(w) >= n])


def words(text: str | None) -> Counter:
    return Counter((text or "").lower().split())


def feature_rows(docs: DataFrame) -> DataFrame:
    """(feature, bad0, good0, bad1, good1): in how many texts of either fold and label each feature is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            count: Counter = Counter()
            for fold, toxic, text in zip(pdf["fold"], pdf["toxic"], pdf["text"]):
                count.update((2 * int(fold) + 1 - int(toxic), f) for f in {f for w in words(text) for f in features(w)})
            rows = [(t, f, n) for (t, f), n in count.items()]
            yield pd.DataFrame(rows, columns=["side", "feature", "docs"])

    out = docs.select("fold", "toxic", "text").mapInPandas(run, "side int, feature string, docs bigint")
    sides = ("bad0", "good0", "bad1", "good1")
    return out.groupBy("feature").agg(*[F.sum(F.when(F.col("side") == i, F.col("docs")).otherwise(0)).alias(s) for i, s in enumerate(sides)])


class Model:
    """P(grade > k) = sigmoid(w x - theta_k), theta ascending, w shared by all thresholds; x is log(1 + count)."""

    def __init__(self, names: list[str], weights: np.ndarray, thetas: np.ndarray):
        self.index, self.weights, self.thetas = {n: i for i, n in enumerate(names)}, weights, thetas
        self.kept: dict[str, tuple[int, ...]] = {}

    def counts(self, text: str | None) -> dict[int, int]:
        out: dict[int, int] = {}
        kept, index = self.kept, self.index
        for w, n in words(text).items():
            hit = kept.get(w)
            if hit is None:
                if len(kept) > CACHE_WORDS:
                    kept.clear()
                hit = kept[w] = tuple(index[f] for f in features(w) if f in index)
            for i in hit:
                out[i] = out.get(i, 0) + n
        return out

    def above(self, counts: dict[int, int]) -> np.ndarray:
        s = sum(self.weights[i] * np.log1p(n) for i, n in counts.items())
        return 1 / (1 + np.exp(-np.clip(s - self.thetas, -500, 500)))


def fit_ordinal(rows: list[dict[int, int]], grades: np.ndarray, n_features: int, levels: int, rounds: int = 400, rate: float = 0.1, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds by Adam on the mean log loss of all threshold questions."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([i for r in rows for i in r], np.int64)
    val = np.log1p(np.array([n for r in rows for n in r.values()], float))
    w, first, gaps = np.zeros(n_features), 1.0, np.zeros(levels - 2)
    target = (grades[:, None] > np.arange(levels - 1)).astype(float)
    share = target[:, 0].mean()
    weigh = np.where(grades > 0, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6))[:, None] / len(rows) / (levels - 1)
    m = v = np.zeros(n_features + levels - 1)
    for step in range(1, rounds + 1):
        thetas = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        s = np.bincount(at, w[col] * val, len(rows))
        err = (1 / (1 + np.exp(-np.clip(s[:, None] - thetas, -500, 500))) - target) * weigh
        g_w = np.bincount(col, err.sum(axis=1)[at] * val, n_features) + l2 * w
        g_t = -err.sum(axis=0)
        g_gap = np.array([g_t[j + 1 :].sum() * np.exp(gaps[j]) for j in range(levels - 2)])
        g = np.concatenate([g_w, [g_t.sum()], g_gap])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, first, gaps = w - move[:n_features], first - move[n_features], gaps - move[n_features + 1 :]
    return w, first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit a model on at most ``max_labelled`` labelled documents, equal texts once.

    ``labels`` has columns doc_id and toxic.  Features are all that the labels
    show to stand for toxic texts, tested by their log odds.  The bound is on
    rows, not on bytes: what the driver gathers, the features picked and each
    labelled text's counts of them, is at most the distinct words and word
    beginnings of ``max_labelled`` texts, so very long labelled texts call for
    a smaller number.

    Labels know toxic and clean, no grades.  Grade 0 is a document labelled
    clean.  Toxic ones get grade 2 if they hold at least as many features as
    the median of toxic documents, else 1, where the features are those that
    the other half of the sample selects, so a document's grade does not come
    from what its own label made a feature.

    Rows with a null id, text or label are left out; rows labelled twice are
    toxic if either label says so, and equal texts likewise.  Other columns
    are ignored.  Without a labelled toxic and a labelled clean row, as with empty
    tables, every document gets severity 0.
    """
    spark = docs.sparkSession
    l = labels.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    l = l.groupBy("__id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("__id"), "__id").limit(max_labelled)
    sample = F.broadcast(l).join(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).dropna(), "__id")
    sample = sample.withColumn("__h", F.sha2("text", 256)).groupBy("__h").agg(F.min("__id").alias("doc_id"), F.max("toxic").alias("toxic"), F.first("text").alias("text"))
    sample = sample.withColumn("fold", F.pmod(F.xxhash64("__h"), F.lit(2)).cast("int"))
    sample = materialize(sample.repartition(max(8, spark.sparkContext.defaultParallelism), "doc_id"), "labelled")
    totals = {(r["fold"], r["toxic"]): r["count"] for r in sample.groupBy("fold", "toxic").count().collect()}
    bad, good = ([totals.get((fold, toxic), 0) for fold in (0, 1)] for toxic in (1, 0))
    if not sum(bad) or not sum(good):
        return Model([], np.zeros(0), np.array([50.0, 60.0]))

    def stands(b, g, n_bad: int, n_good: int):
        odds = F.log((b + 0.5) / (n_bad + 1.0)) - F.log((g + 0.5) / (n_good + 1.0))
        return (odds > MIN_ODDS) & (odds > MIN_Z * F.sqrt(1 / (b + 0.5) + 1 / (g + 0.5)))

    col = F.col
    flags = [stands(col("bad0") + col("bad1"), col("good0") + col("good1"), sum(bad), sum(good)), *[stands(col(f"bad{i}"), col(f"good{i}"), bad[i], good[i]) for i in (0, 1)]]
    picked = feature_rows(sample).select("feature", *[f.alias(n) for f, n in zip(flags, ("all", "by0", "by1"))]).where("all or by0 or by1").orderBy("feature").collect()
    names = [r["feature"] for r in picked if r["all"]]
    index = Model(names, np.zeros(len(names)), np.array([50.0, 60.0]))
    others = [Model([r["feature"] for r in picked if r[n]], np.zeros(0), np.zeros(0)) for n in ("by1", "by0")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [index.counts(t) for t in pdf["text"]]
            found = [float(sum(others[f].counts(t).values())) for f, t in zip(pdf["fold"], pdf["text"])]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "found": found, "i": [list(g) for g in got], "n": [list(g.values()) for g in got]})

    rows = sample.select("doc_id", "toxic", "fold", "text").mapInPandas(run, "doc_id bigint, toxic int, found double, i array<int>, n array<int>").orderBy("doc_id").collect()
    counts = [dict(zip(r["i"], r["n"])) for r in rows]
    found, toxic = np.array([r["found"] for r in rows]), np.array([r["toxic"] for r in rows])
    grades = np.where(toxic == 0, 0, np.where(found >= np.median(found[toxic == 1]), 2, 1))
    w, thetas = fit_ordinal(counts, grades, len(names), 3)
    return Model(names, w, thetas)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, severity, grade, p_toxic, evidence) of every whole text, a row for each row of ``docs``.

    ``severity`` is the expected grade, ``grade`` the likeliest (of equal ones
    the lowest), ``evidence`` the occurrences of the model's features.  Null
    or empty text has no feature and is judged by the thresholds alone; null ids
    stay.  Texts are read whole.  Repeated rows are scored each, and alike.
    Other columns are ignored, whatever their names; an empty table gives an
    empty result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("severity", pa.float64()), ("grade", pa.int32()), ("p_toxic", pa.float64()), ("evidence", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above, evidence = np.zeros((batch.num_rows, len(model.thetas))), np.zeros(batch.num_rows, np.int64)
            for i in range(batch.num_rows):
                counts = model.counts(batch.column(1)[i].as_py())
                above[i], evidence[i] = model.above(counts), sum(counts.values())
            each = np.concatenate([np.ones((len(above), 1)), above], axis=1) - np.concatenate([above, np.zeros((len(above), 1))], axis=1)
            columns = [batch.column(0).cast(pa.int64()), above.sum(axis=1), each.argmax(axis=1).astype(np.int32), above[:, 0], evidence]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=schema)

    return docs.select(id_col, text_col).mapInArrow(run, SCORED)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose probability of any grade above 0 is below ``threshold``; all columns stay.

    Each row is judged by its whole text alone, so repeated rows stay or go
    together.  Null or empty text has no evidence and is judged by the
    thresholds; an empty table stays empty.
    """
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            keep = [model.above(model.counts(t.as_py()))[0] < threshold for t in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of every document, by a model fitted on the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.withColumn("toxic", F.col("p_toxic") >= 0.5)
