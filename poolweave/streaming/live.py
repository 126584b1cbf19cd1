"""Read counts kept up to date while reads still arrive: site frequencies and pair linkage are sums, so a stream of
calls only adds to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_frequency(calls: DataFrame) -> DataFrame:
    """pool, site, n, freq of a stream of calls (pool, site, allele); update or complete output."""
    return calls.groupBy("pool", "site").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("allele") != 0).cast("double")).alias("freq"))


def live_linkage(reads: DataFrame) -> DataFrame:
    """pool, l1, l2, n, p11 of a stream of whole reads (pool, calls array<struct(site, allele)>)."""
    left = reads.select("pool", "calls", F.explode("calls").alias("a"))
    both = left.select("pool", "a", F.explode(F.filter("calls", lambda b: b["site"] > F.col("a.site"))).alias("b"))
    return both.groupBy("pool", F.col("a.site").alias("l1"), F.col("b.site").alias("l2")).agg(F.count(F.lit(1)).alias("n"), F.avg(((F.col("a.allele") == 1) & (F.col("b.allele") == 1)).cast("double")).alias("p11"))


def windowed_depth(calls: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window, pool, site, n: depth by event time, late calls up to `late` counted. calls: ts, pool, site."""
    return calls.withWatermark("ts", late).groupBy(F.window("ts", width), "pool", "site").agg(F.count(F.lit(1)).alias("n"))
