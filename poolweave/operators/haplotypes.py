"""Tables of haplotypes: hap (string of 0 and 1), freq; hap by pool. Sets are small (a region's, a pool's); windows over
them hold as many rows as there are haplotypes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_FREQ, MIN_KEEP, MAX_KEEP, TOP_TIES, RANDOM_PICKS = 0.05, 3, 50, 5, 10


def encoded(haps: DataFrame) -> DataFrame:
    """hap, freq, site, code (double)."""
    return haps.select("*", F.posexplode(F.split("hap", "")).alias("site", "allele")).where("allele <> ''").select(*haps.columns, F.col("site").cast("long").alias("site"), F.col("allele").cast("double").alias("code"))


def mean_haplotype(haps: DataFrame) -> DataFrame:
    """site, mu."""
    return encoded(haps).groupBy("site").agg(F.sum(F.col("code") * F.col("freq")).alias("mu"))


def covariance(haps: DataFrame) -> DataFrame:
    """l1, l2, sigma = E[ab] - E[a]E[b], both orders and the diagonal. Sites of a haplotype pair within its own string."""
    codes = haps.select("freq", F.transform(F.filter(F.split("hap", ""), lambda a: a != ""), lambda a: a.cast("double")).alias("h"))
    left = codes.select("freq", "h", F.posexplode("h").alias("l1", "a"))
    both = left.select("freq", F.col("l1").cast("long").alias("l1"), "a", F.posexplode("h").alias("l2", "b"))
    eta = both.groupBy("l1", F.col("l2").cast("long").alias("l2")).agg(F.sum(F.col("a") * F.col("b") * F.col("freq")).alias("eta"))
    mu = mean_haplotype(haps)
    return eta.join(mu.select(F.col("site").alias("l1"), F.col("mu").alias("m1")), "l1").join(mu.select(F.col("site").alias("l2"), F.col("mu").alias("m2")), "l2").select("l1", "l2", (F.col("eta") - F.col("m1") * F.col("m2")).alias("sigma"))


def enumerated(spark, sites: int) -> DataFrame:
    """All 2 ** sites haplotypes, equally frequent. sites <= 20."""
    if sites > 20:
        raise ValueError(f"{sites} sites make too many haplotypes; split the region first")
    return spark.range(1 << sites).select(F.lpad(F.bin("id"), sites, "0").alias("hap"), F.lit(1.0 / (1 << sites)).alias("freq"))


def projected(haps: DataFrame, first: int, last: int) -> DataFrame:
    """hap, freq of the region of sites first..last."""
    return haps.groupBy(F.substring("hap", first + 1, last - first + 1).alias("hap")).agg(F.sum("freq").alias("freq"))


def renormalised(haps: DataFrame, *by: str) -> DataFrame:
    return haps.withColumn("freq", F.col("freq") / F.sum("freq").over(Window.partitionBy(*by)))


def pruned(haps: DataFrame, least: float, *by: str) -> DataFrame:
    """Haplotypes of at least that frequency, made to sum to 1 again; least 0 changes nothing."""
    return renormalised(haps.where(F.col("freq") >= least), *by) if least > 0 else haps


def top_with_ties(haps: DataFrame, k: int, *by: str) -> DataFrame:
    """All haplotypes at least as frequent as the k-th."""
    return haps.withColumn("place", F.rank().over(Window.partitionBy(*by).orderBy(F.desc("freq")))).where(F.col("place") <= k).drop("place")


def drawn(seed: int) -> Column:
    """Where a haplotype stands in the random order of that seed; the same wherever it is computed."""
    return F.md5(F.concat_ws(":", "hap", F.lit(str(seed))).cast("binary"))


def random_subset(haps: DataFrame, k: int, *by: str, seed: int = 1) -> DataFrame:
    """k of the haplotypes of each group, all subsets being as likely: those first in the random order. Every task keeps k
    of a group before anything is shuffled (the filter on the row number limits the groups), so a set may be of any size."""
    order = Window.partitionBy(*by).orderBy(drawn(seed), "hap")
    return haps.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= k).drop("turn")


def adaptive(haps: DataFrame, least: float = MIN_FREQ, min_keep: int = MIN_KEEP, max_keep: int = MAX_KEEP, top: int = TOP_TIES, picks: int | None = RANDOM_PICKS, share: float | None = None, seed: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """Drop rare haplotypes; if fewer than min_keep would stay, keep the top ones with ties; if more than max_keep, a
    seeded random choice of `picks` (or of `share` of them, then equally frequent). Renormalised in any case."""
    w = Window.partitionBy(*by)
    rows = haps.withColumn("often", F.sum((F.col("freq") >= least).cast("int")).over(w)).withColumn("place", F.rank().over(w.orderBy(F.desc("freq"))))
    chance = F.row_number().over(w.orderBy(F.desc(F.col("freq") >= least), drawn(seed), "hap"))
    rows = rows.withColumn("turn", chance)
    limit = F.lit(picks) if share is None else F.ceil(F.col("often") * share)
    stays = F.when(F.col("often") < min_keep, F.col("place") <= top).when(F.col("often") > max_keep, (F.col("freq") >= least) & (F.col("turn") <= limit)).otherwise(F.col("freq") >= least)
    rows = rows.where(stays)
    if share is not None:
        rows = rows.withColumn("freq", F.when(F.col("often") > max_keep, 1.0).otherwise(F.col("freq")))
    return renormalised(rows.drop("often", "place", "turn"), *by)


def pool_shares(drafts: DataFrame) -> DataFrame:
    """pool, hap, freq: a draft's share of its pool."""
    return drafts.select("pool", "hap", (F.col("n") / F.sum("n").over(Window.partitionBy("pool"))).alias("freq"))


def merged_pools(shares: DataFrame, pools: DataFrame) -> DataFrame:
    """hap, pool, freq with every haplotype in every pool (0 where absent), and mean_freq over all pools. The product of
    distinct haplotypes and pools is the result itself."""
    n = pools.agg(F.count(F.lit(1)).alias("n_pools"))
    names = shares.groupBy("hap").agg(F.sum("freq").alias("total"))
    grid = names.crossJoin(F.broadcast(pools)).crossJoin(F.broadcast(n))
    return grid.join(shares, ["hap", "pool"], "left").select("hap", "pool", F.coalesce("freq", F.lit(0.0)).alias("freq"), (F.col("total") / F.col("n_pools")).alias("mean_freq"))


def first_seen(drafts: DataFrame) -> DataFrame:
    """hap, hap_id: numbered in the order in which pools, then haplotypes, bring them up."""
    seen = drafts.groupBy("hap").agg(F.min("pool").alias("pool"))
    # numbered within pools, behind the haplotypes of all pools before: only pools, few, meet in one task
    before = Window.orderBy("pool").rowsBetween(Window.unboundedPreceding, -1)
    starts = seen.groupBy("pool").agg(F.count(F.lit(1)).alias("n")).select("pool", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("start"))
    at = F.row_number().over(Window.partitionBy("pool").orderBy("hap")) - 1
    return seen.withColumn("at", at).join(F.broadcast(starts), "pool").select("hap", (F.col("start") + F.col("at")).cast("long").alias("hap_id"))


def dosage(haps: DataFrame, fragments: int = 1000) -> DataFrame:
    """A row for each of floor(freq * fragments) copies: hap, copy."""
    n = F.floor(F.col("freq") * fragments)
    return haps.where(n > 0).select(*(c for c in haps.columns if c != "freq"), F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("copy"))


def wildcard(calls: DataFrame, sites: int) -> DataFrame:
    """pool, read_id, hap: one character for each site, '*' where the read says nothing; and the share that it says."""
    by = calls.groupBy("pool", "read_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("site"), F.col("allele").cast("string")))).alias("m"))
    text = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(sites - 1).cast("long")), lambda k: F.coalesce(F.element_at("m", k), F.lit("*"))), "")
    return by.select("pool", "read_id", text.alias("hap"), (F.size("m") / F.lit(float(sites))).alias("known"))
