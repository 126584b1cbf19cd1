"""From calls to haplotypes and their frequencies within and across pools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import colouring, em, frequency, haplotypes, linkage, regions, regression
from ..sources.params import Parameters
from ..sources.steps import Steps, kept

def plan_limits(p: Parameters) -> regions.PlanLimits:
    return regions.PlanLimits(p.level_1_min, p.level_1_max, p.level_1_last, p.level_2_min, p.level_2_max)


def pool_drafts(calls: DataFrame, sites: int, cap: int = frequency.COPY_CAP, most_unknown: int = 0) -> DataFrame:
    """pool, hap, links, n: complete drafts of each pool by colouring its reads."""
    colours = colouring.colour_ranges(frequency.fragments(calls, cap))
    return colouring.draft_haplotypes(colouring.consensus(colours, sites), most_unknown)


def region_haplotypes(calls: DataFrame, drafts: DataFrame, plan: DataFrame, p: Parameters) -> DataFrame:
    """level, region, hap, freq: EM for each region, pruned; regions where it breaks down are regressed on drafts' slices."""
    freq = frequency.site_frequency(calls)
    limits = em.EmLimits(p.per_pool, p.em_rounds, p.em_tolerance, p.em_least)
    solved = kept(em.solved_regions(freq, plan, limits))
    failed = solved.groupBy("level", "region").agg(F.max(F.isnan("freq").cast("int")).alias("bad")).where("bad = 1").drop("bad").join(plan, ["level", "region"])
    good = solved.join(failed.select("level", "region"), ["level", "region"], "left_anti")
    good = haplotypes.adaptive(good, p.regional_freq_min, p.min_keep, p.max_keep, p.top_ties, p.random_picks, by=("level", "region"))
    failed = kept(failed.select("level", "region", "first_site", "last_site"))
    return good.unionByName(regional_lasso(calls, drafts, failed, p)) if failed.limit(1).count() else good


def regional_lasso(calls: DataFrame, drafts: DataFrame, broken: DataFrame, p: Parameters) -> DataFrame:
    """level, region, hap, freq: drafts' slices regressed on frequencies and linkage, both means over pools, by the same
    ladder as a pool's; pruned by the rule for regional regressions (K2). A pair of sites needs a pool that covers it.

    broken: level, region, first_site, last_site. All regions are fitted in one pass, each as a pool of its own with its own
    haplotypes, over sites counted from its first.
    """
    own = (F.col("level") * (1 << 32) + F.col("region")).alias("pool")
    ranges = kept(broken.select(own, "first_site", "last_site"))
    mean = frequency.site_frequency(calls).groupBy("site").agg(F.avg("freq").alias("freq"))
    pairs = linkage.pooled_linkage(linkage.pair_linkage(calls)).select("l1", "l2", "p11")
    at = lambda c: (F.col(c) - F.col("first_site")).alias(c)
    inside = lambda c: F.col(c).between(F.col("first_site"), F.col("last_site"))
    freq = kept(mean.join(ranges, inside("site")).select("pool", at("site"), "freq"))
    linked = kept(pairs.join(ranges, inside("l1") & inside("l2")).select("pool", at("l1"), at("l2"), "p11"))
    cut = F.substring("hap", (F.col("first_site") + 1).cast("int"), (F.col("last_site") - F.col("first_site") + 1).cast("int"))
    haps = kept(drafts.select("hap").distinct().crossJoin(ranges).select("pool", cut.alias("hap")).distinct())  # a slice of each draft for each region
    found = fitted(haps, freq, linked, p).select(F.floor(F.col("pool") / (1 << 32)).alias("level"), (F.col("pool") % (1 << 32)).alias("region"), "hap", "freq")
    rows = haplotypes.renormalised(found, "level", "region")
    return haplotypes.adaptive(rows, p.regional_freq_min, p.min_keep, p.max_keep, p.top_ties, None, p.random_share, by=("level", "region"))


def linked_regions(region_haps: DataFrame, plan: DataFrame, sites: int, p: Parameters) -> DataFrame:
    """hap, freq over all sites: copies of regional haplotypes, coloured like reads of one pool."""
    copies = region_haps.withColumn("n", F.floor(F.col("freq") * p.fragments)).where("n > 0").join(F.broadcast(plan), ["level", "region"])
    span, last = F.sequence(F.col("first_site"), F.col("last_site")), F.col("last_site")
    mask = frequency.bit_words(span, last)
    bits = frequency.bit_words(F.filter(span, lambda k: F.substring(F.col("hap"), (k - F.col("first_site") + 1).cast("int"), F.lit(1)) == "1"), last)
    nodes = copies.select(F.lit(0).cast("long").alias("pool"), F.concat_ws(":", "first_site", "hap").alias("genotype"), mask.alias("mask"), bits.alias("bits"), "n")
    nodes = nodes.groupBy("pool", "genotype", "mask", "bits").agg(F.sum("n").alias("n"))
    drafts = colouring.draft_haplotypes(colouring.consensus(colouring.colour_ranges(nodes), sites))
    return haplotypes.pool_shares(drafts).select("hap", "freq")


def fitted(haps: DataFrame, freq: DataFrame, pairs: DataFrame, p: Parameters) -> DataFrame:
    """pool, hap, freq: coefficients of each pool's regression on all of haps; none below 0."""
    rows = regression.design(haps, freq, pairs, regression.Weights(p.weight_one, p.weight_site, p.weight_pair))
    found = regression.pool_frequencies(rows, haps, regression.Ladder(p.penalty, p.penalty_step, p.least_r2, least=p.local_freq_min))
    return found.select("pool", "hap", F.greatest("freq", F.lit(0.0)).alias("freq"))


def pool_lasso(haps: DataFrame, calls: DataFrame, p: Parameters) -> DataFrame:
    """pool, hap, freq: each pool's regression on the candidate haplotypes, rare ones dropped, made to sum to 1."""
    return haplotypes.pruned(fitted(haps, frequency.site_frequency(calls), linkage.pair_linkage(calls), p), p.local_freq_min, "pool")


def pieces(calls: DataFrame, sites: int, p: Parameters = Parameters()) -> tuple[DataFrame, tuple[list, list], DataFrame]:
    """Drafts of each pool, the plan of regions, and the candidate haplotypes of all pools' regressions (hap, freq).

    Long genomes go by regions (a plan from the gaps of the drafts); those of one region at most, and those whose regional
    haplotypes contradict each other so much that none goes through all regions, by the merged drafts. Every haplotype
    found is a candidate, however rare.
    """
    drafts = kept(pool_drafts(calls, sites))
    gaps = regions.selected_gaps(regions.gap_support(drafts, p.weighted_gaps), sites, plan_limits(p), regions.cutoffs(max(p.in_pool_gap_min, p.all_pool_gap_min), p.gap_step))
    one, two = regions.plan(gaps, sites, plan_limits(p))
    found = None
    if len(one) > 1:
        plan = regions.region_table(calls.sparkSession, (one, two))
        found = kept(linked_regions(region_haplotypes(calls, drafts, plan, p), plan, sites, p))
    if found is None or not found.limit(1).count():
        found = haplotypes.merged_pools(haplotypes.pool_shares(drafts), calls.select("pool").distinct()).groupBy("hap").agg(F.max("mean_freq").alias("freq"))
    return drafts, (one, two), kept(found.select("hap", "freq"))


def reconstruct(calls: DataFrame, sites: int, p: Parameters = Parameters()) -> DataFrame:
    """hap, pool, freq, mean_freq: every haplotype found in any pool, in every pool."""
    with Steps(calls.sparkSession) as steps:
        calls = kept(calls)
        _, _, candidates = pieces(calls, sites, p)
        return steps.result(haplotypes.merged_pools(kept(pool_lasso(candidates, calls, p)), calls.select("pool").distinct()))
