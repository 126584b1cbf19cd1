"""Written steps: what cuts lineage behind a solver, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_OPEN = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, local mode takes a temporary folder, and a cluster is told."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = _OWN.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.gettempdir()}/poolweave-{uuid.uuid4().hex}")
    return folder.rstrip("/")


class Steps:
    """What is kept inside `with Steps(spark) as steps` goes at its end, but for steps.result(...); Steps nest."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __enter__(self) -> Steps:
        _OPEN.all = [*getattr(_OPEN, "all", []), self]
        return self

    def __exit__(self, *_: object) -> None:
        _OPEN.all = _OPEN.all[:-1]
        for path in self.paths:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def result(self, df: DataFrame) -> DataFrame:
        inner, _OPEN.all = _OPEN.all, _OPEN.all[: _OPEN.all.index(self)]
        try:
            return kept(df)
        finally:
            _OPEN.all = inner


def kept(df: DataFrame) -> DataFrame:
    """df written and read back: computed once, and a lost executor costs a task."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/step-{uuid.uuid4().hex}"
    if now := getattr(_OPEN, "all", []):
        now[-1].paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
