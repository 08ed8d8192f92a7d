"""Working tables in the shared folder, and documents packed into blocks."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
import pyarrow.ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chapterflow.sources.stages import shared_folder

BLOCK_SCHEMA = "block bigint, ids array<bigint>, sizes array<bigint>, payload binary, rest binary"


class Scratch:
    """Tables of one operator call, in a new folder below ``spark.checkpoint.dir``.

    A written table survives lost executors and cuts the lineage; a dropped
    one frees its files and the shuffle files of the jobs that made it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.names: list[str] = []

    def store(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}"
        self.names.append(name)
        df.write.mode("overwrite").parquet(path)
        gc.collect()  # the driver's handles of finished plans; the JVM then lets go of their shuffle files
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            self.names = [x for x in self.names if x != name]

    def keep(self, *names: str) -> None:
        """Drops all tables but these."""
        self.drop(*(x for x in self.names if x not in names))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, whatever other columns there are; a null text is empty."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def blocks(docs: DataFrame, block_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Documents packed by the scanning tasks into compressed blocks.

    A block holds whole documents, up to ``block_bytes`` of text or one longer
    document, so later steps move few compressed rows and meet corpus-wide
    facts block by block. Rows keep their order; null and repeated ids stay;
    a null text is empty. ``carry`` adds the whole rows but for the text, for
    ``restored``. Store the result before using it twice.
    """
    others = [c for c in docs.columns if c != text_col] if carry else []

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, part, count = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId(), 0
        ids: list = []
        parts: list[bytes] = []
        rows: list[pa.RecordBatch] = []
        held = 0

        def row() -> pa.RecordBatch:
            nonlocal ids, parts, rows, held, count
            count += 1
            out = pa.record_batch(
                {
                    "block": pa.array([(part << 32) | count], pa.int64()),
                    "ids": pa.array([ids], pa.list_(pa.int64())),
                    "sizes": pa.array([[len(x) for x in parts]], pa.list_(pa.int64())),
                    "payload": pa.array([squeeze.compress(b"".join(parts))], pa.binary()),
                    "rest": pa.array([_packed(rows) if others else None], pa.binary()),
                }
            )
            ids, parts, rows, held = [], [], [], 0
            return out

        for batch in batches:
            begun = 0
            for at, (i, text) in enumerate(zip(batch.column(0), batch.column(1), strict=True)):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                if ids and held + len(data) > block_bytes:
                    rows.append(batch.slice(begun, at - begun))
                    begun = at
                    yield row()
                ids.append(i.as_py())
                parts.append(data)
                held += len(data)
            rows.append(batch.slice(begun))
        if ids:
            yield row()

    def _packed(rows: list[pa.RecordBatch]) -> bytes:
        table = pa.Table.from_batches(rows).drop_columns(["_id", "_text"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table.combine_chunks())
        return sink.getvalue().to_pybytes()

    return docs.select(F.col(id_col).cast("bigint").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *others).mapInArrow(pack, BLOCK_SCHEMA)


def restored(rest: bytes, names: list[str], text_col: str, texts: pa.Array) -> pa.Table:
    """The rows of a block made with ``carry``, with new texts, in the order of ``names``."""
    table = pa.ipc.open_stream(rest).read_all()
    return table.append_column(text_col, texts).select(names)


def unpack(ids: pa.Scalar, sizes: pa.Scalar, payload: pa.Scalar) -> tuple[list, np.ndarray, bytes]:
    """Ids, byte sizes and the joined UTF-8 texts of a block."""
    sizes = sizes.values.to_numpy(zero_copy_only=False).astype(np.int64)
    data = zstandard.ZstdDecompressor().decompress(payload.as_py(), max_output_size=max(1, int(sizes.sum())))
    return ids.as_py(), sizes, data


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, np.ndarray, bytes]]:
    """(block, ids, sizes, data) of every row of batches of blocks."""
    for b in batches:
        for k, i, s, p in zip(*(b.column(c) for c in ("block", "ids", "sizes", "payload")), strict=True):
            yield (k.as_py(), *unpack(i, s, p))


def planes(values: np.ndarray) -> bytes:
    """Integers byte plane by byte plane, compressed: small or sorted and differenced ones take few bytes."""
    bytes_of = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(bytes_of.T).tobytes())


def unplaned(data: bytes, dtype: type) -> np.ndarray:
    """What ``planes`` packed."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def lowered(data: bytes) -> bytes:
    """A-Z in lower case; other bytes stay."""
    return data.translate(_LOWER)


_LOWER = bytes(range(256)).lower()


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """One table for each run of rows with equal integer keys; rows must be sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        values = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in keys])
        cuts = [0, *(np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            key = tuple(values[:, lo].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def stars(batches: Iterator[pa.RecordBatch], key: str, node: str) -> Iterator[pa.RecordBatch]:
    """(a, b): every row's node and the first node of its key, where they differ.

    Rows come sorted by key and node; one row is kept between batches, so a
    key may have any number of rows.
    """
    last_key = first_node = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k, v = batch.column(key).to_numpy(), batch.column(node).to_numpy()
        new = np.concatenate([[last_key is None or k[0] != last_key], k[1:] != k[:-1]])
        at = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
        first = np.where(at >= 0, v[np.maximum(at, 0)], first_node if first_node is not None else 0)
        last_key, first_node = k[-1], first[-1]
        differ = first != v
        pairs = np.unique(np.stack([v[differ], first[differ]], axis=1), axis=0)
        yield pa.record_batch({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})
