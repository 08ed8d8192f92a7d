"""Token ids as Arrow files of equal-length sequences.

The id stream of a range of documents, in ascending id order, fills rows of
``fixed_size_list<uint16 or uint32>[length]`` with a mask of the same length;
the last row of a file is padded with zeros where the mask is false. Every
record batch but the last has the same number of rows, so a position leads to
its batch by division, and in a memory-mapped file a sequence, mask or slice
is a view of the file. A second file lists the documents: id, start within the
file, number of ids.

Files are written by Arrow's own file systems, so the folder can be a shared
mount or any store they know. A file has a name of its own for every attempt
of a task; the manifest, a Parquet table committed by Spark, names those of
the attempts that counted, so a lost executor leaves at most an unnamed file.

Defined cases: a null text is empty (its end id alone); equal ids are ordered
by text, null ids come first; an empty table gives a manifest without rows;
other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chapterflow.llm.common import texts
from chapterflow.llm.fragments import Words, tokenizer

MANIFEST = "part int, ids_file string, docs_file string, n_docs bigint, n_ids bigint"
#: Bytes of texts whose words are looked up together.
TOGETHER = 1 << 17
DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a folder or file, and its path there.

    A scheme that Arrow does not know is an error, also with a single slash:
    it must never be taken for a folder of the machine.
    """
    uri = re.sub("^s3[an]:", "s3:", uri)
    scheme = re.match("([A-Za-z][A-Za-z0-9+.-]*):", uri)
    if scheme is None:
        return fs.LocalFileSystem(), uri
    if scheme[1].lower() == "file":
        return fs.LocalFileSystem(), "/" + re.sub("^file:/*", "", uri, flags=re.IGNORECASE)
    return fs.FileSystem.from_uri(uri if "://" in uri else re.sub(":/*", ":///", uri, count=1))


@lru_cache(maxsize=2)
def _memo(path: str, width: str) -> Words:
    """One memo of words for all tasks of a process."""
    return Words(path, np.dtype(width))


def _together(column: pa.Array) -> Iterator[list[bytes]]:
    """The texts of a column, as many at a time as are looked up together."""
    held: list[bytes] = []
    size = 0
    for t in column:
        held.append(t.as_buffer().to_pybytes())
        size += len(held[-1])
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def ids_schema(width: np.dtype, length: int, batch_rows: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(width), length)), ("mask", pa.list_(pa.bool_(), length))], {"batch_rows": str(batch_rows)})


class SequenceWriter:
    """Appends ids of documents; holds one record batch at most."""

    def __init__(self, uri: str, width: np.dtype, length: int, batch_rows: int):
        place, path = _place(uri)
        self.schema, self.width, self.length, self.step = ids_schema(width, length, batch_rows), width, length, length * batch_rows
        self.sink = place.open_output_stream(path)
        self.out = ipc.new_file(self.sink, self.schema)
        self.held, self.size = [], 0

    def append(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.step:
            joined = np.concatenate(self.held)
            full = self.size // self.step * self.step
            for at in range(0, full, self.step):
                self._write(joined[at : at + self.step], self.step)
            self.held, self.size = [joined[full:]], self.size - full

    def _write(self, ids: np.ndarray, used: int) -> None:
        columns = [
            pa.FixedSizeListArray.from_arrays(pa.array(ids), type=self.schema.field("ids").type),
            pa.FixedSizeListArray.from_arrays(pa.array(np.arange(len(ids)) < used), type=self.schema.field("mask").type),
        ]
        self.out.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        if self.size:
            rows = -(-self.size // self.length)
            self._write(np.concatenate([*self.held, np.zeros(rows * self.length - self.size, self.width)]), self.size)
        self.out.close()
        self.sink.close()


class SequenceFile:
    """Random access to a written file, without copies where it can be memory-mapped."""

    def __init__(self, uri: str):
        place, path = _place(uri)
        self.source = pa.memory_map(path) if isinstance(place, fs.LocalFileSystem) else place.open_input_file(path)
        self.file = ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        self.rows = int(self.file.schema.metadata[b"batch_rows"])
        self.step = self.length * self.rows

    def batch(self, k: int, column: str = "ids") -> np.ndarray:
        """All values of record batch k in a row; ids are a view."""
        values = self.file.get_batch(k).column(column).values
        return values.to_numpy(zero_copy_only=column == "ids")

    def sequence(self, k: int) -> np.ndarray:
        """Sequence k: a view."""
        return self.batch(k // self.rows)[k % self.rows * self.length :][: self.length]

    def mask(self, k: int) -> np.ndarray:
        """True where sequence k holds an id, not padding."""
        return self.batch(k // self.rows, "mask")[k % self.rows * self.length :][: self.length]

    def slice(self, start: int, n: int) -> np.ndarray:
        """n ids from a position on: a view unless they cross record batches."""
        found = []
        while n > 0:
            found.append(self.batch(start // self.step)[start % self.step :][:n])
            start, n = start + len(found[-1]), n - len(found[-1])
        return found[0] if len(found) == 1 else np.concatenate(found)

    def close(self) -> None:
        self.source.close()


def write_sequences(
    docs: DataFrame, path: str, folder: str, length: int = 2048, end_id: int = 2, batch_rows: int = 128, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode all texts and write them below ``folder``; returns the manifest, one row a file.

    A task writes the documents of one range of ids. Ids take 16 bits where
    the vocabulary allows. Each document ends with ``end_id``.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.dtype(np.uint16 if tokenizer(path).get_vocab_size() <= 1 << 16 else np.uint32)
        memo, end = _memo(path, width.str), np.array([end_id], width).tobytes()
        part, tail = TaskContext.get().partitionId(), uuid.uuid4().hex
        names = [f"{folder}/{part:06d}-{tail}{x}.arrow" for x in ("", "-docs")]
        ids_out = docs_out = None
        start = n_docs = 0
        for b in batches:
            if ids_out is None:
                place, at = _place(folder)
                place.create_dir(at, recursive=True)
                ids_out = SequenceWriter(names[0], width, length, batch_rows)
                place, at = _place(names[1])
                docs_sink = place.open_output_stream(at)
                docs_out = ipc.new_file(docs_sink, DOCS)
            sizes = []
            for some in _together(b.column("text")):
                for data in memo.joined([t.split() for t in some]):
                    ids = np.frombuffer(data + end, width)
                    ids_out.append(ids)
                    sizes.append(len(ids))
            starts = start + np.cumsum([0, *sizes])
            docs_out.write_batch(pa.record_batch([b.column("doc_id"), pa.array(starts[:-1], pa.int64()), pa.array(sizes, pa.int64())], schema=DOCS))
            start, n_docs = int(starts[-1]), n_docs + len(sizes)
        if ids_out is not None:
            ids_out.close()
            docs_out.close()
            docs_sink.close()
            yield pa.record_batch([pa.array([x], t) for x, t in zip((part, *names, n_docs, start), (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["part", "ids_file", "docs_file", "n_docs", "n_ids"])

    ordered = texts(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids) of every document, from the files.

    start: ids of all documents before it. ids: little-endian unsigned 32-bit
    integers. Every file is a task; only a row of counts for each file meets
    in one place, for the running total.
    """
    manifest = read_manifest(spark, folder)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids = SequenceFile(row["ids_file"])
                place, at = _place(row["docs_file"])
                with place.open_input_file(at) as source:
                    reader = ipc.open_file(source)
                    for k in range(reader.num_record_batches):
                        docs = reader.get_batch(k)
                        for at in range(0, docs.num_rows, 256):
                            some = docs.slice(at, 256)
                            out = [ids.slice(*x).astype("<u4").tobytes() for x in zip(some.column(1).to_pylist(), some.column(2).to_pylist(), strict=True)]
                            starts = some.column(1).to_numpy() + row["before"]
                            yield pa.record_batch([some.column(0), pa.array(starts, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "start", "ids"])
                ids.close()

    n = max(1, manifest.count())
    return files.select("ids_file", "docs_file", "before").repartition(n).mapInArrow(run, "doc_id bigint, start bigint, ids binary")
