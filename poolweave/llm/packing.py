"""Packing by concatenating and cutting.

Pass 1 encodes each document where it lies and writes its ids with its place: part (the task) and the ids of that part
before it. Pass 2 adds the ids of all parts before (one total for each part, summed up on Spark), which
gives a global position, and cuts at every multiple of the sequence length. A piece that a cut ends carries on at
offset 0 of the next sequence. No text and no id is shuffled; sequences have no padding but the last one's.

Defined results: a null text is an empty one (the end id alone, a piece of length 1); an empty table gives no pieces;
repeated rows are packed each for itself; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read, scratch, table
from .token_files import file_starts
from .tokens import default_path, encoder, groups

LENGTH = 2048
END_ID = 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encoded(docs: DataFrame, tokenizer: str, end: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Written once: doc_id, part, before (ids of that part before the document), ids (packed little-endian)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, at, part = encoder(tokenizer), 0, TaskContext.get().partitionId()
        for b in batches:
            texts, keys = b.column(1).to_pylist(), b.column(0)
            for i, j in groups(texts):
                ids = coder.with_end(texts[i:j], end)
                n = np.array([len(x) // coder.type.itemsize for x in ids], np.int64)
                yield pa.RecordBatch.from_arrays([keys.slice(i, j - i), pa.array([part] * (j - i), pa.int64()), pa.array(at + np.cumsum(n) - n), pa.array(n), pa.array(ids, pa.binary())], names=["doc_id", "part", "before", "n", "ids"])
                at += int(n.sum())

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return table(rows.mapInArrow(run, "doc_id long, part long, before long, n long, ids binary"), "encoded")


def part_starts(ids: DataFrame) -> DataFrame:
    """part, base: the global position of each part's first id, by prefix sums on Spark. A row for each task that encoded."""
    rows = ids.groupBy("part").agg(F.sum("n").alias("n_tokens")).select("part", F.col("part").alias("file"), "n_tokens", F.lit(0).alias("n_docs"))
    return table(file_starts(rows).select("part", "base"), "starts")


def pieces(ids: DataFrame, length: int = LENGTH) -> DataFrame:
    """The pieces of all documents: see PIECES. Starts are a written table, whose size Spark knows: it is broadcast where it is
    small, and joined otherwise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for doc, base, before, n, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at, width = base + before, len(data) // n
                values = np.frombuffer(data, f"<u{width}").astype("<u4")
                done = 0
                while done < n:
                    sequence, offset = divmod(at + done, length)
                    size = min(n - done, length - offset)
                    rows.append((doc, done, size, zlib.crc32(values[done : done + size].tobytes()), n, sequence, offset))
                    done += size
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return ids.join(part_starts(ids), "part").select("doc_id", "base", "before", "n", "ids").mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end: int = END_ID) -> DataFrame:
    with scratch(docs.sparkSession) as work:
        return work.result(pieces(encoded(docs, tokenizer or default_path(), end), length), "pieces")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
