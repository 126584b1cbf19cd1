"""Helpers that every training-data operator uses: shared tables, word splitting, 64-bit hashing."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one chunk (one Python task's worth of documents) should hold.
CHUNK_BYTES = 16 << 20


_OWN: dict[str, str] = {}
_OPEN = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, local mode gets a temporary
    folder of its own; on a cluster each machine would see another one, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = f"file://{tempfile.mkdtemp(prefix='poolweave-')}"
        found = _OWN[app]
    return found.rstrip("/")


class Scratch:
    """What is written inside `with scratch(spark) as work` goes at its end, but for work.result(...): an operator leaves
    nothing but its result, also when it fails. Scratches nest: an inner result belongs to the outer one."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths, self.names = spark, [], []

    def __enter__(self) -> Scratch:
        _OPEN.all = [*getattr(_OPEN, "all", []), self]
        return self

    def __exit__(self, *_: object) -> None:
        _OPEN.all = _OPEN.all[:-1]
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        for path in self.paths:
            delete(self.spark, path)

    def result(self, df: DataFrame, name: str) -> DataFrame:
        inner, _OPEN.all = _OPEN.all, _OPEN.all[: _OPEN.all.index(self)]
        try:
            return table(df, name)
        finally:
            _OPEN.all = inner


scratch = Scratch


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def new_path(spark: SparkSession, name: str, catalogue: bool = False) -> str:
    """A path of its own in the shared folder; catalogue: also the name of a table in the catalogue."""
    own = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{own}"
    if now := getattr(_OPEN, "all", []):
        now[-1].paths.append(path)
        now[-1].names += [own] if catalogue else []
    return path


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, computed once."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunk_count(docs: DataFrame, text: str = "text", target: int = CHUNK_BYTES) -> int:
    """How many chunks of about target bytes the texts make."""
    total = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    return max(1, -(-int(total) // target))


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted, without repeats; by sorting, which for long integers is several times faster than np.unique alone."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def lower_ascii(data: bytes) -> bytes:
    """A-Z to a-z, nothing else (bytes.lower does just that)."""
    return data.lower()
