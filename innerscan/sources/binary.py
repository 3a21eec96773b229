"""Binary vector files: batch sources and sinks for Spark's DataFrame reader and writer.

``dense``: a header (element bytes, rows, dimension; unsigned 32-bit) and
float32 rows.  ``fbin``: a header (rows, dimension) and float32 rows.
``vecs``: each row a dimension and 4-byte elements.  ``truth``: a header
(queries, k), ids, then inner products.  Records of fixed length are split
into byte ranges, so a file of any size is read by many tasks.

Writing never passes vectors through the driver: rows get their place from a
range sort and prefix counts and are packed into blocks; on a mount that all
share, each task writes its blocks at their offsets in one file.  Where a path
names another scheme, a folder with a file for each block takes the place of
the file; it is written and read by Spark, so any store of Hadoop's will do.

Single files are opened through pyarrow's file systems when a path names a
scheme, else as local files of the shared mount.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.partition import positions
from ..storage import hadoop, temporary

PART_BYTES = 64 << 20
HEADERS = {"dense": 12, "fbin": 8, "vecs": 0}


def open_in(path: str):
    if "://" in path or path.startswith("file:"):
        from pyarrow import fs

        f, p = fs.FileSystem.from_uri(path)
        return f.open_input_file(p)
    return open(path, "rb")


def file_size(path: str) -> int:
    if "://" in path or path.startswith("file:"):
        from pyarrow import fs

        f, p = fs.FileSystem.from_uri(path)
        return f.get_file_info(p).size
    return os.path.getsize(path)


def layout(path: str, kind: str) -> tuple[int, int, int, int]:
    """(rows, dimension, bytes before the first row, bytes a row)."""
    with open_in(path) as f:
        if kind == "dense":
            width, n, dim = struct.unpack("<3I", f.read(12))
            if width != 4:
                raise ValueError(f"{path}: elements of {width} bytes; 4 are expected")
            head, row = 12, 4 * dim
        elif kind == "fbin":
            n, dim = struct.unpack("<2I", f.read(8))
            head, row = 8, 4 * dim
        else:
            first = f.read(4)
            dim = struct.unpack("<I", first)[0] if len(first) == 4 else 0
            head, row = 0, 4 * dim + 4
            n = file_size(path) // row
    if file_size(path) < head + n * row:
        raise ValueError(f"{path}: shorter than its header says")
    return n, dim, head, row


class Rows(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class VectorReader(DataSourceReader):
    def __init__(self, path: str, kind: str, element: str, limit: int | None):
        self.path, self.kind, self.element = path, kind, element
        self.n, self.dim, self.head, self.row = layout(path, kind)
        self.n = self.n if limit is None else min(limit, self.n)

    def partitions(self) -> list[Rows]:
        step = max(1, PART_BYTES // max(1, self.row))
        return [Rows(i, min(self.n, i + step)) for i in range(0, self.n, step)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator:
        import pyarrow as pa

        at, kind = partition.start, np.dtype("<f4" if self.element == "float" else "<i4")
        with open_in(self.path) as f:
            f.seek(self.head + at * self.row)
            while at < partition.stop:
                m = min(4096, partition.stop - at)
                raw = np.frombuffer(f.read(m * self.row), kind).reshape(m, self.row // 4)
                if self.kind == "vecs":
                    if not (raw[:, 0].view("<u4") == self.dim).all():
                        raise ValueError(f"{self.path}: rows of different lengths; read it as 'ragged'")
                    raw = raw[:, 1:]
                lists = pa.ListArray.from_arrays(np.arange(0, raw.size + 1, self.dim, dtype=np.int32), pa.array(raw.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + m, dtype=np.int64)), lists], names=["vec_id", "embedding"])
                at += m


class RaggedReader(DataSourceReader):
    """Rows of different lengths can't be found by offset: one task reads the file."""

    def __init__(self, path: str, element: str):
        self.path, self.element = path, element

    def read(self, partition) -> Iterator:
        kind, i = np.dtype("<f4" if self.element == "float" else "<i4"), 0
        with open_in(self.path) as f:
            while len(head := f.read(4)) == 4:
                row = np.frombuffer(f.read(4 * struct.unpack("<I", head)[0]), kind)
                yield (i, row.tolist())
                i += 1


class TruthReader(DataSourceReader):
    """Stretches of a ground truth file: ids and products lie in two sections."""

    def __init__(self, path: str):
        self.path = path
        with open_in(path) as f:
            self.nq, self.k = struct.unpack("<2i", f.read(8))
        if file_size(path) < 8 + 8 * self.nq * self.k:
            raise ValueError(f"{path}: shorter than its header says")

    def partitions(self) -> list[Rows]:
        n, step = self.nq * self.k, PART_BYTES // 8
        return [Rows(i, min(n, i + step)) for i in range(0, n, step)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator:
        import pyarrow as pa

        n, m = self.nq * self.k, partition.stop - partition.start
        with open_in(self.path) as f:
            f.seek(8 + 4 * partition.start)
            ids = np.frombuffer(f.read(4 * m), "<i4").astype(np.int64)
            f.seek(8 + 4 * n + 4 * partition.start)
            ips = np.frombuffer(f.read(4 * m), "<f4").astype(np.float64)
        at = np.arange(partition.start, partition.stop)
        yield pa.RecordBatch.from_arrays([pa.array(at // self.k), pa.array((at % self.k + 1).astype(np.int32)), pa.array(ids), pa.array(ips)], names=["qid", "rank", "vec_id", "ip"])


class VectorFile(DataSource):
    """``spark.read.format("vectorfile").option("kind", "fbin").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "vectorfile"

    def schema(self) -> str:
        if self.options.get("kind") == "truth":
            return "qid bigint, rank int, vec_id bigint, ip double"
        return f"vec_id bigint, embedding array<{self.options.get('element', 'float')}>"

    def reader(self, schema):
        kind, element = self.options.get("kind", "dense"), self.options.get("element", "float")
        if kind == "truth":
            return TruthReader(self.options["path"])
        if kind == "ragged":
            return RaggedReader(self.options["path"], element)
        limit = self.options.get("limit")
        return VectorReader(self.options["path"], kind, element, int(limit) if limit else None)


def is_mount(path: str) -> bool:
    """Whether a path names a file of a mount that all share, not another store."""
    return urlsplit(path).scheme in ("", "file")


def local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def read_vectors(spark: SparkSession, path: str, kind: str = "dense", **options) -> DataFrame:
    """Vectors of a binary file, or of a folder of blocks, as (vec_id, embedding); ``kind`` is dense, fbin, vecs or ragged."""
    fs, p = hadoop(spark, f"{path}/header")
    if fs.exists(p):
        return read_blocks(spark, path, options.get("limit"))
    spark.dataSource.register(VectorFile)
    return spark.read.format("vectorfile").option("kind", kind).options(**options).load(path)


def read_blocks(spark: SparkSession, path: str, limit=None) -> DataFrame:
    """A folder of :func:`write_vectors`: each file is one block, whose number is in its folder's name."""
    import pyarrow as pa

    head = spark.read.parquet(f"{path}/header").first()
    step, dim, element, prefix = head["block_rows"], head["dim"], head["element"], head["kind"] == "vecs"
    dtype = "<f4" if element == "float" else "<i4"

    def run(batches):
        for batch in batches:
            for block, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = np.frombuffer(content.as_buffer(), dtype, (content.as_buffer().size - 1) // 4)
                raw = raw.reshape(-1, dim + prefix)[:, int(prefix) :]
                at = block * step
                lists = pa.ListArray.from_arrays(np.arange(0, raw.size + 1, dim, dtype=np.int32) if dim else np.zeros(len(raw) + 1, np.int32), pa.array(raw.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(raw), dtype=np.int64)), lists], names=["vec_id", "embedding"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(f"{path}/blocks")
    numbered = files.select(F.regexp_extract("path", r"block=(\d+)", 1).cast("long").alias("block"), "content")
    out = numbered.mapInArrow(run, f"vec_id bigint, embedding array<{element}>")
    return out if limit is None else out.where(F.col("vec_id") < int(limit))


def write_vectors(df: DataFrame, path: str, kind: str = "dense", element: str = "float", block_bytes: int = PART_BYTES) -> None:
    """Write (vec_id, embedding) in order of vec_id: to one file of a shared mount, or elsewhere to a folder of blocks.

    A block is ``block_bytes`` at most and is all that a task holds; the
    driver learns how many rows and bytes each has.  Rows of different lengths
    are allowed for "ragged" on a mount; null vectors are left out.
    """
    spark = df.sparkSession
    code, prefix = np.dtype("<f4" if element == "float" else "<i4"), kind in ("vecs", "ragged")
    rows = df.select("vec_id", "embedding").where("embedding is not null")
    dims = rows.agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high")).first()
    n, dim = dims["n"], dims["high"] or 0
    if kind != "ragged" and n and dims["low"] != dim:
        raise ValueError("rows of different lengths")
    step = max(1, block_bytes // max(1, 4 * dim + 4 * prefix))
    with temporary(spark):
        placed = positions(rows, [], [F.col("vec_id")], "pos").withColumn("block", F.floor(F.col("pos") / step))

        def pack(key, table):
            import pyarrow as pa

            table = table.sort_by("pos")
            values = table.column("embedding").combine_chunks()
            flat = values.flatten().to_numpy(zero_copy_only=False).astype(code)
            if prefix:
                lengths = values.value_lengths().to_numpy().astype("<u4")
                at = np.cumsum(lengths.astype(np.int64)) - lengths
                flat = np.insert(flat.view("<u4"), at, lengths)
            return pa.table({"block": pa.array([key[0].as_py()]), "data": pa.array([flat.tobytes()], pa.binary())})

        blocks = placed.select("block", "pos", "embedding").groupBy("block").applyInArrow(pack, "block bigint, data binary")
        if is_mount(path):
            sizes = placed.groupBy("block").agg(F.sum(F.size("embedding") * 4 + (4 if prefix else 0)).alias("bytes")).orderBy("block").collect()
            head = struct.pack("<3I", 4, n, dim) if kind == "dense" else struct.pack("<2I", n, dim) if kind == "fbin" else b""
            write_at(blocks, local(path), head, [r["bytes"] for r in sizes])
        elif kind == "ragged":
            raise ValueError("rows of different lengths are written to mounts only")
        else:
            # raw bytes as text; the line end that text files have is left off when they are read
            blocks.select("block", F.col("data").cast("string").alias("value")).write.mode("overwrite").partitionBy("block").text(f"{path}/blocks")
            spark.createDataFrame([(kind, element, n, dim, step)], "kind string, element string, n bigint, dim int, block_rows bigint").coalesce(1).write.mode("overwrite").parquet(f"{path}/header")


def write_at(blocks: DataFrame, path: str, head: bytes, sizes: list[int]) -> None:
    """Write (block, data) at their offsets in a new file of a shared mount; a task that is repeated writes the same bytes to the same place."""
    offsets = np.concatenate([[len(head)], len(head) + np.cumsum(sizes, dtype=np.int64)]) if sizes else np.array([len(head)])
    new = f"{path}.{uuid.uuid4().hex}"

    def put(batches):
        with open(new, "r+b") as f:
            for batch in batches:
                for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                    f.seek(int(offsets[block]))
                    f.write(data.as_buffer())
                yield batch.select([0])

    with open(new, "wb") as f:
        f.write(head)
        f.truncate(int(offsets[-1]))
    try:
        blocks.mapInArrow(put, "block bigint").agg(F.count("*")).collect()
        os.replace(new, path)
    finally:
        if os.path.exists(new):
            os.remove(new)


def detect_kind(path: str) -> str:
    """By the name's ending: fbin; fvecs or ivecs; else dense."""
    if path.endswith(".fbin"):
        return "fbin"
    return "vecs" if path.endswith(("fvecs", "ivecs")) else "dense"


def prefix_sample(df: DataFrame, level: int, n: int | None = None) -> DataFrame:
    """The first n // 10**level rows by id: what a level of down-sampling keeps."""
    n = df.count() if n is None else n
    return df.where(F.col("vec_id") < n // 10**level)


def hold_out(df: DataFrame, queries: int) -> tuple[DataFrame, DataFrame]:
    """(queries, base): the first ``queries`` ids are queries and the rest the base."""
    return df.where(F.col("vec_id") < queries), df.where(F.col("vec_id") >= queries)


def write_truth(truth: DataFrame, path: str, k: int, block_rows: int = PART_BYTES // 8) -> None:
    """Write (qid, rank, vec_id, ip), ``k`` rows a query, as a ground truth file of a shared mount: a section of ids, one of products."""
    import pyarrow as pa

    with temporary(truth.sparkSession):
        placed = positions(truth.select("qid", "rank", "vec_id", "ip"), [], [F.col("qid"), F.col("rank")], "pos").withColumn("block", F.floor(F.col("pos") / block_rows))
        n = placed.count()
        if n % k:
            raise ValueError(f"not {k} rows for each query")

        def pack(key, table):
            table = table.sort_by("pos")
            ids, ips = table.column("vec_id").to_numpy().astype("<i4").tobytes(), table.column("ip").to_numpy().astype("<f4").tobytes()
            return pa.table({"block": pa.array([2 * key[0].as_py(), 2 * key[0].as_py() + 1]), "data": pa.array([ids, ips], pa.binary())})

        # blocks 0, 2, ... are the ids and 1, 3, ... the products; the file has all ids first
        blocks = placed.select("block", "pos", "vec_id", "ip").groupBy("block").applyInArrow(pack, "block bigint, data binary")
        parts = -(-n // block_rows)
        blocks = blocks.select(F.when(F.col("block") % 2 == 0, F.col("block") / 2).otherwise((F.col("block") - 1) / 2 + parts).cast("long").alias("block"), "data")
        rows = [min(block_rows, n - i * block_rows) for i in range(parts)]
        write_at(blocks, local(path), struct.pack("<2i", n // k, k), [4 * r for r in rows + rows])


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(VectorFile)
    return spark.read.format("vectorfile").option("kind", "truth").load(path)
