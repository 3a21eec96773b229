"""Exact substring dedup with run-length indexes of repeated passages.

The corpus is not indexed as one: anchors, chosen by content, deal its
repeated parts over small collections that share a 26-byte string.  Each
collection is repetitive; its run-compressed Burrows-Wheeler transform is
built in one task, and its passages are streamed through it.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MIN_LONG, few, forget, materialize, new_path, shuffle_partitions, shuffles_deleted, steady_heap, table
from .near_dedup import U, mix64

LENGTH = 50
#: An anchor is the least hash of the KEY-byte strings in a LENGTH-byte string; WINDOW of them.
KEY = 26
WINDOW = LENGTH - KEY + 1
HALF = WINDOW // 2
#: Keys that one task compares, and contexts that one index holds, at about; it never holds more than twice as many.
BUCKET_KEYS, INDEX_CONTEXTS = 1_000_000, 10_000
#: The filter of repeated keys is broadcast; it never has more bits than 2 to this power (32 MB).
FILTER_BITS = 28
#: Above this share of set bits the filter passes too much and repeated keys are joined exactly.
FULL = 0.05
FLUSH_KEYS, FLUSH_ROWS, KNOWN_CONTEXTS = 1_000_000, 20_000, 200_000


def slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """Running minimum or maximum of ``width`` neighbours, by doubling."""
    done, out = 1, x
    while 2 * done <= width:
        out = f(out[:-done], out[done:])
        done *= 2
    return f(out[: len(out) - (width - done)], out[width - done :]) if done < width else out


def anchors(texts: list[bytes], out: list[list[tuple[int, int]]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(texts, positions, keys, sides): every LENGTH-byte string of a text has the anchor that its content chooses, wherever it stands.

    Strings that start in one of a text's ranges ``out`` choose none.  ``sides``
    are, for each anchor, hashes of its key with the HALF bytes before it and
    with the HALF + 1 after it, 0 where they are not there: a string around an
    anchor holds the one or the other.  Texts are read as one array; strings
    that lie in two of them choose none.
    """
    b, lengths = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts], np.int64)
    if len(b) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U), np.zeros((0, 2), U)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    base, h = 0x9E3779B97F4A7C15, {1: b.astype(U) + U(1)}
    power = lambda k: U(pow(base, k, 2**64))
    for k in (1, 2, 4, 8):
        h[2 * k] = h[k][:-k] * power(k) + h[k][k:]
    n = len(b) - KEY + 1
    key = h[16][:n] * power(8)
    key += h[8][16 : 16 + n]
    key *= power(2)
    key += h[2][24 : 24 + n]
    key = mix64(key)
    order = (key >> U(32)).astype(np.uint32)  # equal upper halves are anchors all of them
    least = slide(order, WINDOW, np.minimum)
    across = (ends[:-1, None] - np.arange(1, LENGTH)).ravel()
    least[across[(across >= 0) & (across < len(least))]] = 0
    for i, known in enumerate(out or ()):
        for start, stop in known:
            least[starts[i] + start : starts[i] + stop] = 0
    pad = np.zeros(WINDOW - 1, np.uint32)
    at = np.flatnonzero(slide(np.concatenate([pad, least, pad]), WINDOW, np.maximum) == order)
    own, near, sides = np.searchsorted(ends, at, "right"), key[at], np.zeros((len(at), 2), U)
    left, right = at - starts[own] >= HALF, at + KEY + HALF + 1 <= ends[own]
    a = at[left] - HALF
    sides[left, 0] = mix64((near[left] ^ h[8][a]) * U(base) + h[4][a + 8])
    a = at[right] + KEY
    sides[right, 1] = mix64((near[right] + h[8][a]) * U(base) + h[4][a + 8] * U(257) + h[1][a + 12])
    return own, at - starts[own], near, sides


def portions(texts, size: int = 1 << 16) -> Iterator[range]:
    """Ranges of row numbers with about ``size`` bytes of text."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= size:
            yield range(start, i + 1)
            start, held = i + 1, 0
    if start < len(texts):
        yield range(start, len(texts))


def passes(bitmap: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    slot = (keys >> U(64 - bits)).astype(np.int64)
    return (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def octets(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def units(data: bytes) -> Iterator[tuple[int, int]]:
    """[start, stop) of parts such that every LENGTH-byte string lies in exactly one, judged by its first line break.

    Even parts are the lines; odd ones are a line break with the bytes around
    it that strings with it as their first can have.
    """
    at = 0
    while True:
        p = data.find(b"\n", at)
        if p < 0:
            yield at, len(data)
            return
        yield at, p
        yield max(at, p - LENGTH + 1), min(len(data), p + LENGTH)
        at = p + 1


def unit_rows(base: DataFrame) -> DataFrame:
    """(doc_id, th, unit, no): the hashed parts of at least LENGTH bytes of each text."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("unit", pa.binary()), ("no", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1_000) for i in range(0, batch.num_rows, 1_000)):
                row, unit, no = [], [], []
                for i in range(part.num_rows):
                    data = octets(part.column(2)[i].as_py())
                    for j, (a, b) in enumerate(units(data)):
                        if b - a >= LENGTH:
                            row.append(i)
                            unit.append(hashlib.blake2b(data[a:b], digest_size=16).digest())
                            no.append(j)
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(unit, pa.binary()), pa.array(no, pa.int32())], schema=schema)

    return base.select("doc_id", "th", "text").mapInArrow(run, "doc_id bigint, th bigint, unit binary, no int")


def known_parts(data: bytes, later: list[int] | None) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(spans, ranges of string starts) of the parts whose numbers are in ``later``."""
    if not later:
        return [], []
    want = set(later)
    spans = [x for j, x in enumerate(units(data)) if j in want]
    return spans, [(a, b - LENGTH + 1) for a, b in spans]


def repeated_filter(base: DataFrame, buckets: int, bits: int, known=None) -> np.ndarray:
    """A bit for each prefix of ``bits`` bits of the keys that several documents hold.

    With ``known``, a broadcast filter of keys, the sides of the anchors that
    pass it take the place of keys.

    A batch sends each key once, with a mark if two of its documents hold it;
    buckets of keys are compared, and each returns its part of the bits.
    """
    shift = 64 - int(np.log2(buckets))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        steady_heap()
        held, size = [], 0
        before = None if known is None else np.frombuffer(known.value, np.uint8)

        def flush():
            keys, count = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.flatnonzero(np.diff(keys >> U(shift))) + 1
            parts, marks = np.split(keys, cuts), np.split(count > 1, cuts)
            table_ = {
                "bucket": pa.array([int(p[0] >> U(shift)) for p in parts], pa.int32()),
                "keys": pa.array([p.tobytes() for p in parts], pa.binary()),
                "marks": pa.array([np.packbits(m).tobytes() for m in marks], pa.binary()),
            }
            return pa.RecordBatch.from_arrays(list(table_.values()), names=list(table_))

        for batch in batches:
            texts, later = [octets(t) for t in batch.column(0).to_pylist()], batch.column(1).to_pylist()
            for part in portions(texts):
                some = [texts[i] for i in part]
                own, _, keys, sides = anchors(some, [known_parts(t, later[i])[1] for t, i in zip(some, part)])
                if before is not None:
                    on = passes(before, keys, bits)
                    own, keys = np.repeat(own[on], 2), sides[on].ravel()
                order = np.lexsort((keys, own))
                own, keys = own[order], keys[order]
                once = np.ones(len(keys), bool)
                once[1:] = (keys[1:] != keys[:-1]) | (own[1:] != own[:-1])
                keys = keys[once & (keys > 0)]
                if len(keys):
                    held.append(keys)
                    size += len(keys)
                if size >= FLUSH_KEYS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.frombuffer(k, U) for k in pdf["keys"]])
        marks = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=len(k) // 8) for k, m in zip(pdf["keys"], pdf["marks"])])
        order = np.argsort(keys, kind="stable")
        keys, marks = keys[order], marks[order]
        many = marks.astype(bool)
        many[1:] |= keys[1:] == keys[:-1]
        own = np.zeros((1 << bits) // buckets, bool)
        bucket = int(pdf["bucket"].iloc[0])
        own[(keys[many] >> U(64 - bits)).astype(np.int64) - bucket * len(own)] = True
        return pd.DataFrame({"bucket": [bucket], "bits": [np.packbits(own, bitorder="little").tobytes()]})

    sent = base.select("text", "later").mapInArrow(emit, "bucket int, keys binary, marks binary")
    out = np.zeros((1 << bits) // 8, np.uint8)
    part = len(out) // buckets
    filters = materialize(sent.groupBy("bucket").applyInPandas(meet, "bucket int, bits binary"), "filter")
    for row in filters.toLocalIterator():
        out[row["bucket"] * part : (row["bucket"] + 1) * part] = np.frombuffer(row["bits"], np.uint8)
    forget(filters)
    return out


OCCURRENCE = "doc_id bigint, th bigint, at int, key bigint, h bigint, n int, left int, context binary"


def occurrences(base: DataFrame, sent, bits: int) -> DataFrame:
    """The anchors that pass both filters, with up to WINDOW - 1 bytes to either side as their context.

    (key, h) names a context.  Its bytes come in rows of their own, one for
    each task that meets it or a few, with the smallest and largest id there
    in the places of doc_id and th.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("at", pa.int32()), ("key", pa.int64()), ("h", pa.int64()), ("n", pa.int32()), ("left", pa.int32()), ("context", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        steady_heap()
        by_key, by_side = (np.frombuffer(x, np.uint8) for x in sent.value)
        rows: list = []
        met: list = []
        n_rows, n_met, n_once = 0, 0, 0

        def flush(*columns):
            return pa.RecordBatch.from_arrays([pa.nulls(len(columns[0]), f.type) if c is None else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        def once(met):
            """The contexts (smallest id, largest, key, h, left, bytes) once each, as they come: those of neighbours overlap and are written smaller together."""
            d0, last, k, h, left, c = (np.concatenate(x) for x in zip(*met))
            order = np.lexsort((h, k))
            first = np.flatnonzero(np.concatenate([[True], (np.diff(k[order]) != 0) | (np.diff(h[order]) != 0)]))
            by = np.argsort(order[first])
            at = order[first][by]
            return np.minimum.reduceat(d0[order], first)[by], np.maximum.reduceat(last[order], first)[by], k[at], h[at], left[at], c[at]

        def contexts(met):
            for i in range(0, len(met[0]), FLUSH_ROWS):
                d0, last, k, h, left, c = (x[i : i + FLUSH_ROWS] for x in met)
                yield flush(d0, last, np.full(len(k), -1), k, h, np.fromiter(map(len, c), np.int32, len(c)), left, c.tolist())

        for batch in batches:
            ids, ths = (batch.column(i).to_numpy() for i in range(2))
            texts, later = [octets(t) for t in batch.column(2).to_pylist()], batch.column(3).to_pylist()
            for part in portions(texts):
                some = [texts[i] for i in part]
                own, at, keys, sides = anchors(some, [known_parts(t, later[i])[1] for t, i in zip(some, part)])
                both = [passes(by_side, s, bits) & (s > 0) for s in sides.T]
                pick = np.flatnonzero(passes(by_key, keys, bits) & (both[0] | both[1]))
                if not len(pick):
                    continue
                own, p, k = own[pick] + part.start, at[pick], keys[pick].view(np.int64)
                start = np.maximum(0, p - WINDOW + 1)
                left, c = p - start, np.empty(len(pick), object)
                c[:] = [texts[i][a:b] for i, a, b in zip(own.tolist(), start.tolist(), (p + LENGTH).tolist())]
                h = (np.fromiter(map(xxhash.xxh64_intdigest, c, left.tolist()), U, len(c)) ^ U(1 << 63)).view(np.int64)
                rows.append((ids[own], ths[own], start, k, h, np.fromiter(map(len, c), np.int64, len(c))))
                met.append((ids[own], ids[own], k, h, left, c))
                n_rows, n_met = n_rows + len(k), n_met + len(k)
                if n_rows >= FLUSH_ROWS:
                    yield flush(*map(np.concatenate, zip(*rows)), None, None)
                    rows, n_rows = [], 0
                if n_met >= n_once + KNOWN_CONTEXTS // 2:
                    met = [once(met)]
                    n_once = n_met = len(met[0][0])
                    if n_met >= KNOWN_CONTEXTS:
                        yield from contexts(met[0])
                        met, n_once, n_met = [], 0, 0
        if rows:
            yield flush(*map(np.concatenate, zip(*rows)), None, None)
        if met:
            yield from contexts(once(met))

    return base.select("doc_id", "th", "text", "later").mapInArrow(run, OCCURRENCE)


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of a collection of byte strings.

    Symbols are bytes plus one, 0 ends a string.  ``starts``, ``chars`` and
    ``lf_base`` describe the runs; ``samples`` are the text positions at run
    starts.  Rows are steps of the sorted suffixes; ``run`` tells each row's run.
    """

    def __init__(self, texts: list[bytes], depth: int = LENGTH):
        lengths = np.array([len(t) for t in texts])
        self.ends = np.cumsum(lengths + 1) - 1
        sym = np.zeros(int(self.ends[-1]) + 1, np.int64)
        inside = np.ones(len(sym), bool)
        inside[self.ends] = False
        sym[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
        n = len(sym)
        code = np.zeros(n, np.int64)
        for j in range(7):
            code[: n - j] |= sym[j:] << (9 * (6 - j))
        rank, ranks, k = np.unique(code, return_inverse=True)[1], {}, 7
        while True:
            ranks[k] = rank
            if int(rank.max()) == n - 1:
                break
            after = np.zeros(n, np.int64)
            after[: n - k] = rank[k:] + 1
            rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1]
            k *= 2
        sa = np.empty(n, np.int64)
        sa[rank] = np.arange(n)
        bwt = sym[sa - 1]
        self.starts = np.concatenate([[0], np.flatnonzero(np.diff(bwt)) + 1])
        self.chars = bwt[self.starts]
        self.samples = sa[self.starts]
        size = np.diff(np.append(self.starts, n))
        self.run = np.repeat(np.arange(len(size), dtype=np.int32), size)
        order = np.argsort(self.chars, kind="stable")
        self.lf_base = np.empty(len(order), np.int64)
        self.lf_base[order] = np.cumsum(size[order]) - size[order]
        self.end_rows = rank[self.ends]
        self.rows = n
        half = ranks.get(28)
        if half is None:  # all suffixes differ within fewer symbols
            self.groups = np.arange(n)
        else:
            padded = np.append(half, np.full(depth, -1))
            a, b = half[sa], padded[sa + depth - 28]
            self.groups = np.concatenate([[0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))])
        self.owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths + 1)[sa]

    def lf(self, rows: np.ndarray) -> np.ndarray:
        """Rows of the suffixes one symbol longer to the left."""
        run = self.run[rows]
        return self.lf_base[run] + rows - self.starts[run]

    def least(self, values: np.ndarray) -> np.ndarray:
        """For each group of suffixes that share their first ``depth`` symbols the least value of their strings."""
        first = np.concatenate([[0], np.flatnonzero(np.diff(self.groups)) + 1])
        return np.minimum.reduceat(values[self.owner], first)


def earlier_windows(texts: list[bytes], owners: np.ndarray) -> np.ndarray:
    """Bit o of each text: its LENGTH bytes from o also start in a text of a smaller owner.

    All texts stream backwards through the index in step; at each step of at
    least LENGTH symbols the row's group of equal beginnings tells the
    smallest owner.
    """
    index = RunLengthIndex(texts)
    least, rows = index.least(owners), index.end_rows
    lengths, out = np.array([len(t) for t in texts]), np.zeros(len(texts), np.int64)
    for step in range(1, int(lengths.max()) + 1):
        rows = index.lf(rows)
        if step >= LENGTH:
            on = np.flatnonzero((lengths >= step) & (least[index.groups[rows]] < owners))
            out[on] |= np.int64(1) << (lengths[on] - step)
    return out


def alike_windows(texts: list[bytes], left: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """The same for texts that share a key at ``left``, for the strings that hold it: place by place, in little memory.

    Equal strings have their anchors at equal places, so those that start as
    far before the key are sorted together.
    """
    lengths, out = np.array([len(t) for t in texts]), np.zeros(len(texts), np.int64)
    for before in range(WINDOW):
        at = left - before
        on = np.flatnonzero((at >= 0) & (at + LENGTH <= lengths))
        if len(on) > 1:
            strings = np.array([texts[i][at[i] : at[i] + LENGTH] for i in on], f"S{LENGTH}")
            group = np.unique(strings, return_inverse=True)[1]
            least = np.full(group.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, group, owners[on])
            hit = on[least[group] < owners[on]]
            out[hit] |= np.int64(1) << at[hit]
    return out


def sides(contexts: DataFrame) -> DataFrame:
    """Add ``group``: the contexts to compare with each other share one.

    For most that is their key.  Keys with more than INDEX_CONTEXTS rows are
    cut before they are dealt: by the key with the HALF bytes before it, and
    again by the key with the HALF + 1 after it, as any string of LENGTH bytes
    around a key holds one of these whole.
    """
    hot = materialize(contexts.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > INDEX_CONTEXTS).select("key", F.lit(True).alias("hot")), "hot")
    length = F.octet_length("context")
    before = F.when(F.col("left") >= HALF, F.xxhash64(F.lit(0), F.substring("context", F.col("left") - HALF + 1, F.lit(HALF + KEY))))
    after = F.when(length >= F.col("left") + KEY + HALF + 1, F.xxhash64(F.lit(1), F.substring("context", F.col("left") + 1, F.lit(KEY + HALF + 1))))
    groups = F.when(F.col("hot"), F.array_compact(F.array(before, after))).otherwise(F.array(F.xxhash64("key")))
    return contexts.join(few(hot), "key", "left").withColumn("group", F.explode(groups)).drop("hot")


def judged(contexts: DataFrame) -> DataFrame:
    """(key, h, d0, lo, hi): of each context the span, in its first document, that earlier documents hold; null if there is none.

    ``contexts`` (key, h, d0, last, left, context, group, bucket) are compared
    within a group.  Strings of LENGTH bytes around one key overlap, so what
    is held is one span.  Contexts without one that one document only has are
    left out.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.groupby(["group", "key", "h"], sort=True).agg(d0=("d0", "min"), last=("last", "max"), left=("left", "first"), context=("context", "first")).reset_index()
        texts, left, d0, keys = pdf["context"].tolist(), pdf["left"].to_numpy(), pdf["d0"].to_numpy(), pdf["group"].tolist()
        sides = [
            [t[i - HALF : i + KEY] if i >= HALF else None for t, i in zip(texts, left)],
            [t[i : i + KEY + HALF + 1] if len(t) >= i + KEY + HALF + 1 else None for t, i in zip(texts, left)],
        ]
        masks = np.zeros(len(texts), np.int64)
        # a string of LENGTH bytes around an anchor holds half of the bytes beside it on one side at least
        counts = [Counter(s) for s in sides]
        alike = [np.array([x is not None and c[x] > 1 for x in s], bool) for s, c in zip(sides, counts)]
        near = np.flatnonzero(alike[0] | alike[1])
        if len(near) > 2 * INDEX_CONTEXTS:  # cut by shared sides; those that too many share are compared without an index
            chunks = []
            for s, a, shared in zip(sides, alike, counts):
                order = sorted(np.flatnonzero(a).tolist(), key=lambda i: (keys[i], s[i]))
                chunk: list = []
                for j, i in enumerate(order):
                    if (len(chunk) >= INDEX_CONTEXTS or shared[s[i]] > INDEX_CONTEXTS or shared[s[order[j - 1]]] > INDEX_CONTEXTS) and s[i] != s[order[j - 1]]:
                        chunks.append(chunk)
                        chunk = []
                    chunk.append(i)
                chunks.append(chunk)
        else:
            chunks = [near.tolist()]
        for chunk in chunks:
            if len(chunk) > 1:
                at = np.array(chunk)
                some = [texts[i] for i in chunk]
                masks[at] |= earlier_windows(some, d0[at]) if len(chunk) <= 2 * INDEX_CONTEXTS else alike_windows(some, left[at], d0[at])
        lo = [(m & -m).bit_length() - 1 if m else None for m in masks.tolist()]
        hi = [m.bit_length() - 1 + LENGTH if m else None for m in masks.tolist()]
        out = pdf[["key", "h", "d0"]].assign(lo=pd.array(lo, "Int32"), hi=pd.array(hi, "Int32"))
        return out[(pdf["last"] > pdf["d0"]) | (masks != 0)]

    found = contexts.groupBy("bucket").applyInPandas(run, "key bigint, h bigint, d0 bigint, lo int, hi int")
    return found.groupBy("key", "h").agg(F.min("d0").alias("d0"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, text, later, starts, ends): each row of ``docs`` with what earlier documents hold.

    A byte is held if a 50-byte string over it also starts in a document with
    a smaller id.  Strings are bytes of UTF-8 and lie within one document.
    ``later`` are the numbers of the parts (lines, and line breaks with their
    surroundings) that an earlier document has whole; ``starts`` and ``ends``
    are byte spans found in the other parts, which may overlap.

    1. Parts are hashed; a part is judged once, in the first document with it.
    2. Strings of these parts choose anchors; filters keep anchors whose key,
       and whose key with half of what is beside it, several documents have.
    3. Contexts of anchors are compared, by key, in run-length indexes.

    Null text is empty; texts of any length are read whole.  Rows with one id
    do not count as earlier than each other.  A null id counts as the
    smallest.  Other columns are ignored; an empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    with shuffles_deleted(spark):
        base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(MIN_LONG)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        base = base.withColumn("th", F.xxhash64("text"))
        parts = materialize(unit_rows(base), "parts")
        # written, so that the join is planned for itself: a unit that very many documents have is split or broadcast
        first = materialize(parts.groupBy("unit").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("last")).where("d0 < last").select("unit", "d0"), "first")
        later = parts.join(few(first), "unit").where("doc_id > d0").groupBy("doc_id", "th").agg(F.collect_set("no").alias("later"))
        later = materialize(later, "later")
        forget(parts, first)
        # the texts lie in buckets by document from here on, so they are not shuffled again
        n, name = shuffle_partitions(spark), f"texts_{uuid.uuid4().hex}"
        joined = base.repartition(n, "doc_id", "th").join(later, ["doc_id", "th"], "left")
        joined.write.bucketBy(n, "doc_id", "th").format("parquet").option("path", new_path(spark, "texts")).saveAsTable(name)
        base = spark.table(name)
        forget(later)
        total = (base.agg(F.sum(F.octet_length("text"))).first()[0] or 0) * 2 // (WINDOW + 1)
        buckets = 16
        while buckets * BUCKET_KEYS < total and buckets < 1 << 20:
            buckets *= 2
        bits = 20
        while bits < FILTER_BITS and (1 << bits) < 16 * total:
            bits += 1
        by_key = repeated_filter(base, buckets, bits)
        by_side = repeated_filter(base, buckets, bits, spark.sparkContext.broadcast(by_key.tobytes()))
        sent = spark.sparkContext.broadcast((by_key.tobytes(), by_side.tobytes()))
        rows = materialize(occurrences(base, sent, bits), "occurrences")
        occ, contexts = rows.where("context is null"), rows.where("context is not null")
        contexts = contexts.select("key", "h", F.col("doc_id").alias("d0"), F.col("th").alias("last"), "left", "context")
        if np.unpackbits(by_side).mean() > FULL:
            many = contexts.groupBy("key").agg(F.min("d0").alias("a"), F.max("last").alias("b")).where("a < b").select("key")
            contexts = contexts.join(many, "key", "left_semi")
        nb = max(64, contexts.count() // INDEX_CONTEXTS)
        found = materialize(judged(sides(contexts).withColumn("bucket", F.pmod("group", F.lit(nb)).cast("int"))), "found")
        later_one = F.col("doc_id") > F.col("d0")
        # a row of a few numbers for each context is the hashed side, so neither side is sorted
        hit = occ.select("key", "h", "doc_id", "th", "at", "n").join(found.hint("shuffle_hash"), ["key", "h"]).where(later_one | F.col("lo").isNotNull())
        start, end = F.when(later_one, F.col("at")).otherwise(F.col("at") + F.col("lo")), F.when(later_one, F.col("at") + F.col("n")).otherwise(F.col("at") + F.col("hi"))
        spans = hit.groupBy("doc_id", "th").agg(F.collect_list(start).alias("starts"), F.collect_list(end).alias("ends"))
        spans = materialize(spans, "spans")
        forget(rows, found)
    return base.join(spans, ["doc_id", "th"], "left").select("doc_id", "th", "text", "later", "starts", "ends")


def cover(n: int, starts, ends) -> np.ndarray:
    """Whether each of ``n`` bytes is in a span."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, np.asarray(starts, np.int64), 1)
    np.add.at(step, np.asarray(ends, np.int64), -1)
    return np.cumsum(step[:-1]) > 0


DEDUPED = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of each row, ``kept`` the remaining bytes; see :func:`removals`."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                for d, t, later, s, e in zip(*(part.column(i) for i in range(5))):
                    data = octets(t.as_py())
                    known = np.array(known_parts(data, later.as_py())[0], np.int64).reshape(-1, 2)
                    more = (s.values.to_numpy(), e.values.to_numpy()) if s.is_valid else ((), ())
                    gone = cover(len(data), np.concatenate([known[:, 0], more[0]]), np.concatenate([known[:, 1], more[1]]))
                    doc_id = d.as_py()
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                    runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                    rows.append((None if doc_id == MIN_LONG else doc_id, len(data), int(gone.sum()), runs, kept))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return removals(docs, id_col, text_col).select("doc_id", "text", "later", "starts", "ends").mapInArrow(run, DEDUPED)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
