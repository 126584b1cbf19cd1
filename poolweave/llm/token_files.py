"""Token ids in Arrow files of equal-length sequences.

Documents are dealt by doc_id into ranges; each task encodes its range and writes one Arrow file (the stream of record
batches with the footer that gives random access). A file holds batches of fixed-size lists: `ids` (unsigned 16 bit,
or 32 where the vocabulary needs it) and `mask` (false only behind the last id of a file). Every value sits at a known
place, so a memory map gives any sequence without a copy. A second, small Arrow file beside it has for each document
its doc_id, first position in the file and count. The global position of a file is the sum of the ids of all files
before it: a second pass over one row for each file.

Defined results: a null text is an empty one (the end id alone); empty tables write no files and give no rows; repeated
doc_ids keep one entry per row, in any order among themselves; rows without doc_id come first. Extra columns are ignored.
"""

from __future__ import annotations

import posixpath
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import chunk_count, new_path, read, scratch, table
from .tokens import default_path, encoder, groups

SEQUENCE = 2048
ROWS_PER_BATCH = 256
END_ID = 0
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI (file, hdfs, s3, gs ... whatever pyarrow knows), and the path there."""
    return pafs.FileSystem.from_uri(path)


class SequenceWriter:
    """Appends ids and writes full batches of fixed-size lists; the last sequence is padded and masked."""

    def __init__(self, sink, kind: pa.DataType, length: int) -> None:
        self.length, self.kind, self.total = length, kind, 0
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = pa.ipc.new_file(sink, self.schema)
        self.held: list[bytes] = []
        self.size = 0

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.size += len(ids)
        width = self.kind.bit_width // 8
        if self.size >= (step := width * self.length * ROWS_PER_BATCH):
            data = b"".join(self.held)
            whole = len(data) // step * step
            for at in range(0, whole, step):
                self.batch(data[at : at + step], step // width)
            self.held, self.size = [data[whole:]], len(data) - whole

    def batch(self, data: bytes, n: int) -> None:
        """n: how many of the ids in data are real."""
        width = self.kind.bit_width // 8
        count = len(data) // width
        ids = pa.Array.from_buffers(self.kind, count, [None, pa.py_buffer(data)])
        mask = pa.array(np.arange(count) < n)
        lists = [pa.FixedSizeListArray.from_arrays(x, self.length) for x in (ids, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.total += n

    def close(self) -> int:
        data, width = b"".join(self.held), self.kind.bit_width // 8
        if n := len(data) // width:
            self.batch(data + bytes(-n % self.length * width), n)
        self.out.close()
        return self.total


def write_sequences(docs: DataFrame, path: str, tokenizer: str, end: int = END_ID, length: int = SEQUENCE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write docs under path in ascending key order. Returns a row per file: file, part (its order), n_tokens, n_docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, writer = encoder(tokenizer), None
        fs, base = opened(path)
        index: list[pa.RecordBatch] = []
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        at = 0
        for b in batches:
            if writer is None and b.num_rows:
                fs.create_dir(base, recursive=True)
                sink = fs.open_output_stream(posixpath.join(base, f"{name}.arrow"))
                writer = SequenceWriter(sink, pa.uint16() if coder.type.itemsize == 2 else pa.uint32(), length)
            texts, counts = b.column(1).to_pylist(), []
            for i, j in groups(texts):
                for ids in coder.with_end(texts[i:j], end):
                    writer.add(ids)
                    counts.append(len(ids) // coder.type.itemsize)
            n = np.array(counts, np.int64)
            index.append(pa.RecordBatch.from_arrays([b.column(0), pa.array(at + np.cumsum(n) - n), pa.array(n)], schema=INDEX))
            at += int(n.sum())
        if writer is not None:
            total = writer.close()
            sink.close()
            with fs.open_output_stream(posixpath.join(base, f"{name}.index")) as f, pa.ipc.new_file(f, INDEX) as out:
                for x in index:
                    out.write_batch(x)
            yield pa.RecordBatch.from_pydict({"file": [name], "part": [part], "n_tokens": [total], "n_docs": [sum(x.num_rows for x in index)]})

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts = max(chunk_count(rows, target=16 << 20), 1)
    # rows of one doc_id (or of none) may be many: a hash of the text lets a range end among them
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(parts, F.col("doc_id"), tie).sortWithinPartitions("doc_id", tie)
    # written, not just planned: a file counts only if the row that names it was committed
    return table(ordered.mapInArrow(run, "file string, part long, n_tokens long, n_docs long"), "files")


def file_starts(files: DataFrame, step: int = 1000) -> DataFrame:
    """files with `base`: the ids of all files before. Prefix sums within each `step` files, and over their totals: nothing
    comes to the driver, and the one window over everything has a row for each step."""
    rows = files.withColumn("step", F.floor(F.col("part") / step))
    until = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    before = lambda by: F.coalesce(F.sum("n_tokens").over(until(by)), F.lit(0).cast("long"))
    steps = rows.groupBy("step").agg(F.sum("n_tokens").alias("n_tokens")).select("step", before(Window.orderBy("step")).alias("start"))
    inner = rows.withColumn("inner", before(Window.partitionBy("step").orderBy("part", "file")))
    return inner.join(steps, "step").select("file", "part", "n_tokens", "n_docs", (F.col("start") + F.col("inner")).alias("base"))


class SequenceReader:
    """Random access to one file of sequences."""

    def __init__(self, source: pa.NativeFile) -> None:
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size
        self.at, self.ids = -1, None

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence i, as views of the file's own memory where it is mapped."""
        b = self.file.get_batch(i // ROWS_PER_BATCH)
        k = i % ROWS_PER_BATCH
        return tuple(b.column(c)[k].values.to_numpy(zero_copy_only=c == 0) for c in (0, 1))

    def slice(self, start: int, count: int) -> np.ndarray:
        """Ids from start on, across sequences and batches."""
        per, out = self.length * ROWS_PER_BATCH, []
        while count > 0:
            k, at = divmod(start, per)
            if k != self.at:
                self.at, self.ids = k, self.file.get_batch(k).column(0).flatten().to_numpy(zero_copy_only=True)
            out.append(got := self.ids[at : at + count])
            if not len(got):
                raise ValueError("the file ends before its index does")
            start, count = start + len(got), count - len(got)
        return np.concatenate(out) if out else np.empty(0, np.uint16)


def read_documents(files: DataFrame, folder: str) -> DataFrame:
    """A row per document, read back from the files: doc_id, start (global), n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(folder)
        for b in batches:
            for r in b.to_pylist():
                with fs.open_input_file(posixpath.join(root, f"{r['file']}.index")) as f:
                    index = pa.ipc.open_file(f).read_all()
                path = posixpath.join(root, f"{r['file']}.arrow")
                with pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path) as f:
                    reader = SequenceReader(f)
                    for x in index.to_batches(max_chunksize=10_000):
                        crc = [zlib.crc32(reader.slice(s, n).astype("<u4").tobytes()) for s, n in zip(x.column(1).to_pylist(), x.column(2).to_pylist(), strict=True)]
                        start = pa.array(x.column(1).to_numpy() + r["base"])
                        yield pa.RecordBatch.from_arrays([x.column(0), start, x.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, files.count())
    return files.repartition(n, "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark) as work:  # the query's result is what it read back: the files themselves go
        path = new_path(spark, "sequences")
        files = write_sequences(read(spark, sf_dir, "documents"), path, default_path())
        return work.result(read_documents(file_starts(files), path), "read_back")
