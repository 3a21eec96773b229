"""MinHash near-dedup by fast similarity sketching, banding and exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MIN_LONG, few, materialize, steady_heap, table, unwrapped, whole_rows

SHINGLE = 5
BANDS, ROWS = 30, 6
#: Two sets are linked if 100 * common >= PERCENT * all.
PERCENT = 85
#: Members and set elements of a block of a candidate group at most, at about; groups of up to SPREAD small blocks are cut into those.
BLOCK_MEMBERS, BLOCK_ELEMENTS = 2_000, 1_500_000
SMALL_MEMBERS, SMALL_ELEMENTS, SPREAD = 200, 150_000, 12
CACHE_WORDS = 400_000

U = np.uint64
GOLDEN, M1, M2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


MASK = 2**64 - 1


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * M1
    x = (x ^ (x >> U(27))) * M2
    return x ^ (x >> U(31))


class WordHashes(dict):
    """64-bit hashes of words, kept as they are met; emptied when it has grown too large."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: str | None, hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a whole text; A-Z lower-cased, ASCII white space between words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, U)
    w = mix64(np.array(list(map(hashes.__getitem__, words)), U))
    k = min(size, len(w))
    h = np.zeros(len(w) - k + 1, U)
    for j in range(k):
        h = h * GOLDEN + w[j : len(w) - k + 1 + j]
    return np.unique(mix64(h + U(k)))


def sketch(elements: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketch of ``t`` coordinates.

    In round i < t every element falls into a hashed bin with a value in
    [i, i + 1); in round t + j all go to bin j; a bin keeps its least value.
    Rounds stop when every bin is filled, so a large set takes one or two and
    no coordinate stays empty. Two sketches agree in a coordinate with the
    sets' Jaccard index as the probability.
    """
    out = np.full(t, np.iinfo(U).max, U)
    for i in range(2 * t):
        h = mix64(elements + U((int(GOLDEN) * (i + 1)) & MASK))
        value = (h & U(0xFFFFFFFF)) | (U(i) << U(32))
        if i < t:
            np.minimum.at(out, ((h >> U(32)) % U(t)).astype(np.int64), value)
        else:
            out[i - t] = min(out[i - t], value.min())
        if (out != np.iinfo(U).max).all():
            break
    return out


def band_keys(s: np.ndarray, bands: int, rows: int) -> np.ndarray:
    h = np.arange(1, bands + 1, dtype=U) * GOLDEN
    for column in s.reshape(bands, rows).T:
        h = mix64(h * M1 + column)
    return h.view(np.int64)


def digest(elements: np.ndarray) -> bytes:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, bands: int, rows: int, shingle: int) -> DataFrame:
    """(doc_id, n_shingles, digest, bands) of (doc_id, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady_heap()
        hashes = WordHashes()
        for batch in batches:
            n, d, b = [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), hashes, shingle)
                n.append(len(s))
                d.append(digest(s))
                b.append(band_keys(sketch(s, bands * rows), bands, rows) if len(s) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(d, pa.binary()), pa.array(b, pa.list_(pa.int64()))], schema=schema)

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>")


def sets_of(docs: DataFrame, shingle: int) -> DataFrame:
    """(cid, sg, blocks, found, elements): the full sets of the picked texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady_heap()
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(t.as_py(), hashes, shingle) for t in batch.column(4)]
            keep = pa.array([digest(s) == d.as_py() for s, d in zip(sets, batch.column(3))], pa.bool_())
            out = pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([s.tobytes() for s in sets], pa.binary())], names=["cid", "sg", "blocks", "elements"])
            yield out.filter(keep)

    return docs.select("cid", "sg", "blocks", "digest", "text").mapInArrow(run, "cid bigint, sg bigint, blocks int, elements binary")


def links(ids: np.ndarray, side: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Exact links that join the members of a group: each joins two parts not joined before.

    ``side``: only pairs of different sides are judged, unless all are equal.
    Members are in order of their sets' sizes, so those of a possible partner
    are a range; one pass over the range's elements counts all intersections.
    """
    order = np.lexsort((ids, [len(s) for s in sets]))
    ids, side, sets = ids[order], side[order], [sets[i] for i in order]
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    local = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark, part, out = np.zeros(local.max() + 1, np.int32), np.arange(len(ids)), []
    crossing = len(np.unique(side)) > 1
    stops = np.searchsorted(sizes, sizes * 100 // percent, "right")
    for i in range(len(ids) - 1):
        a, b = i + 1, stops[i]
        if b <= a:
            continue
        open_ = part[a:b] != part[i]
        if crossing:
            open_ &= side[a:b] != side[i]
        if not open_.any():
            continue
        a, b = a + int(open_.argmax()), b - int(open_[::-1].argmax())
        open_ = open_[a - i - 1 : b - i - 1]
        own = local[starts[i] : ends[i]]
        mark[own] = 1
        if open_.mean() > 0.3:
            common = np.add.reduceat(mark[local[starts[a] : ends[b - 1]]], starts[a:b] - starts[a])
            hit = open_ & (100 * common >= percent * (sizes[i] + sizes[a:b] - common))
            near = a + np.flatnonzero(hit)
        else:
            near = [j for j in a + np.flatnonzero(open_) if (c := mark[local[starts[j] : ends[j]]].sum()) * 100 >= percent * (sizes[i] + sizes[j] - c)]
        mark[own] = 0
        for j in near:
            if part[j] != part[i]:
                part[part == part[j]] = part[i]
                out.append((int(ids[i]), int(ids[j])))
    return out


def verified(members: DataFrame, percent: int) -> DataFrame:
    """(a, b) exact links of candidate groups; a group of several blocks is judged by pairs of blocks."""
    here = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    dealt = members.withColumn("here", here).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("lo", F.least("here", "other")).withColumn("hi", F.greatest("here", "other"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(e, U) for e in pdf["elements"]]
        crossing = pdf["lo"].iloc[0] != pdf["hi"].iloc[0]
        side = pdf["here"].to_numpy() if crossing else np.zeros(len(pdf), np.int64)
        found = links(pdf["cid"].to_numpy(), side, sets, percent) if len(pdf) > 1 else []
        return pd.DataFrame(found, columns=["a", "b"]).astype(np.int64)

    return dealt.select("sg", "lo", "hi", "here", "cid", "elements").groupBy("sg", "lo", "hi").applyInPandas(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of (a, b) is connected with.

    Rounds of hooking every node to its smallest neighbour, pointer jumping,
    and contracting the edges; their number grows with the logarithm of the
    component's size.  All tables are written, none is collected.
    """
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while True:
        both = e.union(e.select("b", "a"))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("parent"))
        parent = materialize(parent, "parents")
        while True:
            up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("up"))
            jumped = materialize(parent.join(up, "parent").select("node", F.col("up").alias("parent"), (F.col("up") != F.col("parent")).alias("moved")), "parents")
            parent = jumped.drop("moved")
            if not jumped.where("moved").limit(1).count():
                break
        if labels is None:
            labels = parent.withColumnRenamed("parent", "component")
        else:
            new = parent.select(F.col("node").alias("component"), F.col("parent").alias("new"))
            labels = materialize(labels.join(new, "component", "left").select("node", F.coalesce("new", "component").alias("component")), "labels")
        pa_, pb = parent.select(F.col("node").alias("a"), F.col("parent").alias("x")), parent.select(F.col("node").alias("b"), F.col("parent").alias("y"))
        rest = e.join(pa_, "a").join(pb, "b").where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
        e = materialize(rest, "edges")
        if not e.limit(1).count():
            return labels


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE
) -> DataFrame:
    """Components of near-duplicate documents.

    Returns (doc_id, n_shingles, component_id, kept) a row for each row of
    ``docs``.  Two texts are linked if their sets of ``shingle``-word shingles
    have a Jaccard index of ``percent`` / 100 or more, judged on full sets.

    1. Equal sets are one class, named by its smallest id.
    2. Classes that share a band of their sketches are candidates.  A bucket
       of any size gives one edge for each member, to its smallest; connected
       buckets are a candidate group.  At an index of 0.85 a pair is missed
       with a probability of 7e-7 (30 bands of 6).
    3. Each group's sets meet in one task, or in one for each pair of blocks
       if the group is large, which counts all intersections exactly.
    4. Components of the links.

    Null, empty and blank texts have an empty set and are linked with nothing.
    With fewer words than a shingle the whole sequence is one.  Repeated rows are of one
    class.  A null id counts as the smallest; its component_id is null.
    Other columns are ignored; an empty table gives an empty result.
    """
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(MIN_LONG)).alias("doc_id"), F.col(text_col).alias("text"))
    sk = materialize(sketches(base, bands, rows, shingle), "sketches")
    some = sk.where("n_shingles > 0")
    classes = some.groupBy("digest").agg(F.min("doc_id").alias("cid"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n"))
    classes = materialize(classes, "classes")
    keys = classes.select("cid", F.explode("bands").alias("key"))
    hubs = keys.groupBy("key").agg(F.min("cid").alias("hub"), F.count("*").alias("c")).where("c > 1").select("key", "hub")
    groups = components(keys.join(hubs, "key").where("cid <> hub").select(F.col("cid").alias("a"), F.col("hub").alias("b")))
    picked = groups.select(F.col("node").alias("cid"), F.col("component").alias("sg")).join(classes.select("cid", "digest", "n"), "cid")
    picked = materialize(picked, "picked")
    parts = lambda members, elements: F.greatest(F.ceil(F.count("*") / members), F.ceil(F.sum("n") / elements))
    blocks = F.greatest(parts(BLOCK_MEMBERS, BLOCK_ELEMENTS), F.least(F.lit(SPREAD), parts(SMALL_MEMBERS, SMALL_ELEMENTS))).cast("int")
    sizes = picked.groupBy("sg").agg(blocks.alias("blocks"))
    picked = materialize(picked.join(sizes, "sg").select("cid", "sg", "blocks", "digest"), "placed")
    texts = base.join(few(picked), base["doc_id"] == F.col("cid"))
    found = components(verified(sets_of(texts, shingle), percent))
    joined = classes.join(found, classes["cid"] == found["node"], "left").select("digest", F.coalesce("component", "cid").alias("component_id"))
    out = sk.select("doc_id", "n_shingles", "digest").join(joined, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    null_if = lambda c: F.when(c != MIN_LONG, c)
    return out.select(null_if(F.col("doc_id")).alias("doc_id"), "n_shingles", null_if(component).alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One document of each component: the rows of ``docs`` with its smallest id, all columns kept.

    A document is an id: rows that repeat an id stay together if theirs is
    the smallest.  Ids are to be distinct where only one row is wanted.
    """
    kept = near_duplicates(docs, id_col=id_col, **options).where("kept").select(F.col("doc_id").alias("__kept")).distinct()
    return unwrapped(whole_rows(docs).join(kept, F.col("__row")[id_col].eqNullSafe(F.col("__kept")), "left_semi"), docs.columns)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
