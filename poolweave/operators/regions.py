"""Gaps in the linkage of drafts, and the two-level plan of regions that follows from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PlanLimits:
    min_level_1: int = 10
    max_level_1: int = 16
    last_level_1: int = 3
    min_level_2: int = 10
    max_level_2: int = 16


def gap_support(drafts: DataFrame, weighted: bool = False) -> DataFrame:
    """pool (null: all pools), k, gap_count, n_drafts, support: copies without the link between sites k and k + 1 over
    draft rows, by pool and over all. drafts: pool, links (string of - and ?), n. weighted: over copies instead, so that
    support is a share."""
    rows = drafts.select("pool", "n", F.posexplode(F.split("links", "")).alias("k", "link")).where("link <> ''")
    both = rows.groupingSets([["pool", "k"], ["k"]], "pool", "k").agg(F.sum(F.when(F.col("link") == "?", F.col("n")).otherwise(0)).alias("gap_count"), F.count(F.lit(1)).alias("n_drafts"), F.sum("n").alias("copies"))
    return both.select("pool", F.col("k").cast("long").alias("k"), "gap_count", "n_drafts", (F.col("gap_count") / F.col("copies" if weighted else "n_drafts")).alias("support"))


def cutoffs(least: float = 0.5, step: float = 0.1) -> list[float]:
    out, x = [], 1.0
    while x >= least:
        out.append(x)
        x -= step
    return out


def gap_levels(support: DataFrame, sites: int, levels: list[float]) -> DataFrame:
    """cutoff, n_gaps, mean_size: for each cutoff how many gaps some pool, or all together, support that much."""
    best = support.groupBy("k").agg(F.max("support").alias("support"))
    rows = best.select("k", "support", F.explode(F.array(*map(F.lit, levels))).alias("cutoff"))
    return rows.groupBy("cutoff").agg(F.sum((F.col("support") >= F.col("cutoff")).cast("long")).alias("n_gaps")).withColumn("mean_size", F.lit(float(sites)) / (F.col("n_gaps") + 1))


def selected_gaps(support: DataFrame, sites: int, limits: PlanLimits, levels: list[float]) -> list[int]:
    """Gaps at the highest cutoff that makes regions no longer than wanted on average (else at the lowest). A row for
    each gap reaches the driver, as many as sites."""
    best = support.groupBy("k").agg(F.max("support").alias("support")).collect()
    chosen: list[int] = []
    for c in levels:
        chosen = sorted(r["k"] for r in best if r["support"] >= c)
        if sites / (len(chosen) + 1) <= limits.max_level_1:
            break
    return sorted({*chosen, sites - 1})


def plan(gaps: list[int], sites: int, limits: PlanLimits = PlanLimits()) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Ranges of sites, inclusive: level 1 cuts at gaps between min and max length; level 2 straddles the cuts.

    A cut at gap k begins the next region with site k. The sweep stops near the end; a last region that came out longer
    than the maximum is split. Level 2 has a region for each cut: it ends in the middle of the next region of level 1,
    within the limits of its length (the longest has one site more), and the last one in the middle between its begin and
    the end of all. Where regions stretched to the least length have reached the last site, no more follow.
    """
    cuts: list[int] = []
    start = 0
    for k in gaps:
        while k - start > limits.max_level_1:
            start += limits.max_level_1
            cuts.append(start)
        if k - start >= limits.min_level_1:
            start = k
            cuts.append(start)
        if cuts and sites - 1 - cuts[-1] <= limits.last_level_1:
            break
    if cuts and sites - 1 - cuts[-1] <= limits.last_level_1:
        cuts.pop()
    edges = [0, *cuts, sites]
    one: list[tuple[int, int]] = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        while b - a > limits.max_level_1:
            one.append((a, a + limits.max_level_1 - 1))
            a += limits.max_level_1
        one.append((a, b - 1))
    two: list[tuple[int, int]] = []
    begin = (one[0][1] - one[0][0]) // 2
    for i, (a, b) in enumerate(one[1:], 1):
        if begin >= sites - 1:
            break
        middle = (a + b) // 2
        end = begin + min(max(middle - begin, limits.min_level_2 - 1), limits.max_level_2 if middle - begin >= limits.max_level_2 else limits.max_level_2 - 1)
        two.append((begin, min((sites + begin) // 2 if i == len(one) - 1 else end, sites - 1)))
        begin = two[-1][1] + 1
    return one, two


def region_table(spark, levels: tuple[list[tuple[int, int]], list[tuple[int, int]]]) -> DataFrame:
    """level, region, first_site, last_site."""
    rows = [(level + 1, i, a, b) for level, ranges in enumerate(levels) for i, (a, b) in enumerate(ranges)]
    return spark.createDataFrame(rows, "level long, region long, first_site long, last_site long")

