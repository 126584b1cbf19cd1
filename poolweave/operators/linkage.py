"""Linkage between sites: from reads that cover both, or from frequencies over pools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_pairs(calls: DataFrame) -> DataFrame:
    """pool, l1, l2, both: a row for each read and pair of its sites, l1 < l2; both = 1 if it has 1 at both.

    A read's calls meet in one array (as many as sites), which is then paired with itself: one shuffle, no self-join.
    """
    by = calls.groupBy("pool", "read_id").agg(F.array_sort(F.collect_list(F.struct("site", "allele"))).alias("x")).where(F.size("x") > 1)
    left = by.select("pool", "x", F.explode("x").alias("a"))
    right = left.select("pool", "a", F.explode(F.filter("x", lambda b: b["site"] > F.col("a.site"))).alias("b"))
    return right.select("pool", F.col("a.site").alias("l1"), F.col("b.site").alias("l2"), ((F.col("a.allele") == 1) & (F.col("b.allele") == 1)).cast("double").alias("both"))


def pair_linkage(calls: DataFrame) -> DataFrame:
    """pool, l1, l2, n, p11: share of 1-1 among reads that cover both; pairs that no read covers have no row."""
    return read_pairs(calls).groupBy("pool", "l1", "l2").agg(F.count(F.lit(1)).alias("n"), F.avg("both").alias("p11"))


def pooled_linkage(linkage: DataFrame, pools: int | None = None) -> DataFrame:
    """l1, l2, p11, n_pools: mean over the pools that cover the pair. With pools: only pairs that all so many cover."""
    out = linkage.groupBy("l1", "l2").agg(F.avg("p11").alias("p11"), F.count(F.lit(1)).alias("n_pools"))
    return out if pools is None else out.where(F.col("n_pools") == pools)


def frequency_covariance(freq: DataFrame) -> DataFrame:
    """l1, l2, cov: population covariance over pools of the frequencies of two sites."""
    by = freq.groupBy("pool").agg(F.array_sort(F.collect_list(F.struct("site", "freq"))).alias("x"))  # a pool's sites: one array, paired with itself
    left = by.select("x", F.explode("x").alias("a"))
    both = left.select("a", F.explode(F.filter("x", lambda b: b["site"] > F.col("a.site"))).alias("b"))
    return both.groupBy(F.col("a.site").alias("l1"), F.col("b.site").alias("l2")).agg(F.covar_pop("a.freq", "b.freq").alias("cov"))
