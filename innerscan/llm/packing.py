"""Best-fit packing by linear grouping, planned on a histogram of lengths."""

from __future__ import annotations

import base64
import os
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, table

CAPACITY = 2048
#: Lengths above a share of the capacity are large and are packed by configurations; the plan with fewer sequences stands.
LARGE = (1 / 3, 1 / 2)
GROUPS = 48
#: Rows of the plan that are broadcast at most; the plan grows with the capacity, not with the documents.
BROADCAST_ROWS = 500_000

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids of a text as little-endian unsigned 32-bit bytes.

    The vocabulary's ranks give the same ids several times faster through a
    second library, if they lie beside the file; a text that holds a special
    token, or that the second library refuses, goes through the first.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.fast = None
        ranks = path.removesuffix(".json") + ".tiktoken"
        if ranks != path and os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    def __call__(self, text: str) -> bytes:
        ids = None
        if self.fast is not None and not any(s in text for s in self.special):
            try:
                ids = self.fast.encode_ordinary(text)
            except BaseException as e:  # what its regular expressions refuse comes as a panic, no Exception
                if isinstance(e, KeyboardInterrupt | SystemExit | MemoryError):
                    raise
        if ids is None:
            ids = self.tok.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()


def cut(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids; the first piece takes what is over."""
    n, start, piece = len(ids) // 4, 0, 0
    length = n if n <= capacity else n % capacity or capacity
    while start < n:
        yield piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])
        start, piece, length = start + length, piece + 1, capacity


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Token counts and checksums of each document's pieces."""
    path = vocabulary or default_vocabulary()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = Encoder(path)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            rows: list = [[] for _ in range(5)]
            for i in range(batch.num_rows):
                doc_id = ids[i].as_py()
                for part in cut(encode(texts[i].as_py() or "") + b"\0\0\0\0", capacity):
                    for column, v in zip(rows, (doc_id, *part)):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)

    return docs.mapInArrow(run, PIECES)


def best_configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[tuple[int, ...], float]]:
    """Fractional optimum of the cutting-stock program over few sizes, by column generation.

    Columns say how many items of each size one sequence takes.  The simplex
    basis starts with one size a column; an unbounded knapsack over the duals
    prices new columns.
    """
    k = len(sizes)
    cols = [tuple(capacity // s if i == j else 0 for i in range(k)) for j, s in enumerate(sizes)]
    basis, cost = np.array(cols, float).T, np.ones(k)
    x = np.array(demand, float) / np.diag(basis)
    inv = np.linalg.inv(basis)
    for step in range(40 * k):
        y = cost @ inv
        col = knapsack(sizes, y, capacity)
        surplus = int(np.argmin(y))
        if y @ col > 1 + 1e-9:
            c = 1.0
        elif y[surplus] < -1e-9:
            col, c = np.zeros(k), 0.0
            col[surplus] = -1
        else:
            break
        d = inv @ col
        ok = d > 1e-9
        if not ok.any():
            break
        ratio = np.where(ok, np.divide(x, d, out=np.full(k, np.inf), where=ok), np.inf)
        out = int(np.argmin(ratio))
        move = ratio[out]
        x = x - move * d
        x[out] = move
        inv[out] /= d[out]
        for r in range(k):
            if r != out:
                inv[r] -= d[r] * inv[out]
        cols[out], cost[out] = tuple(int(v) for v in col), c
        if step % 50 == 49:
            inv = np.linalg.inv(np.array(cols, float).T)
            x = inv @ np.array(demand, float)
    return [(c, v) for c, v, w in zip(cols, x, cost) if w > 0 and v > 1e-9]


def knapsack(sizes: list[int], y: np.ndarray, capacity: int) -> np.ndarray:
    """Best unbounded knapsack of values ``y``: item counts."""
    value = np.zeros(capacity + 1)
    counts = np.zeros((capacity + 1, len(sizes)), np.int16)
    for i, s in enumerate(sizes):
        if y[i] <= 1e-12:
            continue
        for at in range(s, capacity + 1, s):  # each block of s depends on the one before it only
            stop = min(at + s, capacity + 1)
            with_ = value[at - s : stop - s] + y[i]
            better = np.flatnonzero(with_ > value[at:stop] + 1e-12)
            if len(better):
                value[at + better] = with_[better]
                counts[at + better] = counts[at - s + better]
                counts[at + better, i] += 1
    return counts[int(np.argmax(value))].astype(float)


class Planner:
    """Turns counts of lengths into slots: which documents of a length, by rank, go where.

    A slot (length, first rank, documents, first sequence, offset) places that
    many documents of the length, one in each of as many sequences.
    """

    def __init__(self, counts: dict[int, int], capacity: int, large: float = LARGE[0], groups: int = GROUPS):
        self.counts, self.capacity = dict(counts), capacity
        self.slots: list[tuple[int, int, int, int, int]] = []
        self.used: dict[int, int] = defaultdict(int)
        self.sequences = 0
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.rooms: list[int] = []
        self.configured([s for s in sorted(counts, reverse=True) if s > large * capacity], groups)
        self.best_fit()

    def place(self, length: int, n: int, first: int, offset: int) -> None:
        self.slots.append((length, self.used[length], n, first, offset))
        self.used[length] += n

    def add_open(self, room: int, first: int, n: int) -> None:
        if n and room:
            if not self.open[room]:
                insort(self.rooms, room)
            self.open[room].append((first, n))

    def configured(self, lengths: list[int], groups: int) -> None:
        """Linear grouping: groups of equal cardinality, rounded up to their largest, packed by whole configurations.

        With few pieces there are fewer groups, of two pieces at least.  Real
        documents then take the places, the largest of a group first;
        what a rounded-down optimum leaves over goes to best fit.
        """
        total = sum(self.counts[s] for s in lengths)
        if not total:
            return
        groups = max(1, min(groups, total // 2))
        members: list[list[list[int]]] = [[]]
        filled, share = 0, total / groups
        for s in lengths:
            n = self.counts[s]
            while n:
                take = min(n, max(1, round(share * len(members)) - filled))
                members[-1].append([s, take])
                filled, n = filled + take, n - take
                if filled >= round(share * len(members)) and len(members) < groups:
                    members.append([])
        members = [m for m in members if m]
        merged: list[list[list[int]]] = []
        for m in members:  # a length that fills several groups is one size
            if merged and merged[-1][0][0] == m[0][0]:
                merged[-1] += m
            else:
                merged.append(m)
        sizes, demand = [m[0][0] for m in merged], [sum(n for _, n in m) for m in merged]
        for config, times in sorted(best_configurations(sizes, demand, self.capacity), key=lambda c: -c[1]):
            times = int(times + 1e-6)
            times = min([times, *(sum(n for _, n in merged[g]) // a for g, a in enumerate(config) if a)])
            if times:
                self.fill([merged[g] for g, a in enumerate(config) for _ in range(a)], times)

    def fill(self, groups: list[list[list[int]]], times: int) -> None:
        """``times`` sequences with one document of each listed group."""
        runs: list[list[list[int]]] = []
        for g in groups:
            need, got = times, []
            while need:
                take = min(need, g[0][1])
                got.append([g[0][0], take])
                g[0][1] -= take
                need -= take
                if not g[0][1]:
                    g.pop(0)
            runs.append(got)
        while times:
            n, first, offset = min(r[0][1] for r in runs), self.sequences, 0
            for r in runs:
                self.place(r[0][0], n, first, offset)
                offset += r[0][0]
                r[0][1] -= n
                if not r[0][1]:
                    r.pop(0)
            self.sequences, times = self.sequences + n, times - n
            self.add_open(self.capacity - offset, first, n)

    def best_fit(self) -> None:
        """The rest, in descending length, each into the fullest sequence with room."""
        for length in sorted(self.counts, reverse=True):
            left = self.counts[length] - self.used[length]
            while left:
                at = bisect_left(self.rooms, length)
                if at == len(self.rooms):
                    each = self.capacity // length
                    new = -(-left // each)
                    self.add_open(self.capacity, self.sequences, new)
                    self.sequences += new
                    continue
                room = self.rooms[at]
                first, n = self.open[room].pop()
                if not self.open[room]:
                    self.rooms.pop(at)
                each, offset = room // length, self.capacity - room
                full = min(n, left // each)
                for j in range(each if full else 0):
                    self.place(length, full, first, offset + j * length)
                self.add_open(room - each * length, first, full)
                left -= full * each
                if full < n and left:  # the last sequence takes what is left
                    for j in range(left):
                        self.place(length, 1, first + full, offset + j * length)
                    self.add_open(room - left * length, first + full, 1)
                    left, full = 0, full + 1
                self.add_open(room, first + full, n - full)
        assert all(self.used[s] == n for s, n in self.counts.items())


def plan_slots(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    return min((Planner(counts, capacity, share) for share in LARGE), key=lambda p: p.sequences).slots


def ranked(parts: DataFrame, rows: int) -> DataFrame:
    """Rank of each piece among those of its length, from prefix counts of hashed buckets."""
    buckets = max(16, rows // 50_000)
    keyed = parts.withColumn("__b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy("length", "__b").agg(F.count("*").alias("n")).select("length", "__b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__o"))
    rn = F.row_number().over(Window.partitionBy("length", "__b").orderBy("doc_id", "piece", "start", "ids_crc32"))
    return keyed.withColumn("__r", rn).join(offsets, ["length", "__b"]).withColumn("__rank", F.col("__o") + F.col("__r") - 1).drop("__b", "__o", "__r")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Pack documents into sequences of at most ``capacity`` tokens.

    Returns for each piece (doc_id, piece, start, length, ids_crc32,
    sequence_id, offset).  A document is its tokens and id 0; only one longer
    than the capacity is cut.  The driver sees how many pieces each length
    has, so ``capacity`` numbers at most, and plans with them; pieces find
    their slot by length and rank.

    Null or empty text is the id 0 alone.  Repeated rows are packed each.  An
    empty table gives an empty result.  Other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    parts = materialize(pieces(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), capacity, vocabulary), "pieces")
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = plan_slots(counts, capacity)
    plan = spark.createDataFrame(slots, "length bigint, __first bigint, __n bigint, __sequence bigint, offset bigint")
    plan = F.broadcast(plan) if len(slots) <= BROADCAST_ROWS else plan.hint("merge")
    met = ranked(parts, sum(counts.values())).join(plan, "length").where((F.col("__rank") >= F.col("__first")) & (F.col("__rank") < F.col("__first") + F.col("__n")))
    return met.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("__sequence") + F.col("__rank") - F.col("__first")).alias("sequence_id"), "offset")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
