"""Allele frequencies and genotype counts from calls (pool, read_id, site, allele)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Copies of one genotype that a pool keeps at most.
COPY_CAP = 32877
#: Sites in one long of a bit mask.
WORD = 63


def bit_words(places: Column, last: Column) -> Column:
    """Sites as bits of an array of longs: site k is bit k % WORD of word k div WORD. last: the last site to have room for."""
    one = F.lit(1).cast("long")
    word = lambda w: F.aggregate(F.filter(places, lambda k: F.floor(k / WORD) == w), F.lit(0).cast("long"), lambda s, k: s.bitwiseOR(F.call_function("shiftleft", one, (k % WORD).cast("int"))))
    return F.transform(F.sequence(F.lit(0).cast("long"), F.floor(last / WORD)), word)


def has_bit(words: Column, k: Column) -> Column:
    """Whether site k is in words; sites beyond them are not."""
    return F.coalesce(F.getbit(F.get(words, F.floor(k / WORD).cast("int")), (k % WORD).cast("int")), F.lit(0)) == 1


def neighbours(words: Column) -> Column:
    """Words with bit k where sites k and k + 1 are both there."""
    top = F.lit(1 << (WORD - 1)).cast("long")
    carry = lambda w, i: F.when((w.bitwiseAND(top) != 0) & (F.coalesce(F.get(words, i + 1), F.lit(0)).bitwiseAND(F.lit(1)) == 1), top).otherwise(F.lit(0).cast("long"))
    return F.transform(words, lambda w, i: w.bitwiseAND(F.shiftright(w, 1)).bitwiseOR(carry(w, i)))


def site_frequency(calls: DataFrame) -> DataFrame:
    """pool, site, n, freq: share of covering reads with the alternate allele."""
    return calls.groupBy("pool", "site").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("allele") != 0).cast("double")).alias("freq"))


def global_frequency(freq: DataFrame) -> DataFrame:
    """site, freq: mean over the pools."""
    return freq.groupBy("site").agg(F.avg("freq").alias("freq"))


def depth_frequency(ref: Column, alt: Column) -> Column:
    """From allele depths; 0 where nothing covers."""
    return F.when(ref + alt > 0, alt / (ref + alt)).otherwise(F.lit(0.0))


def allele_depths(calls: DataFrame) -> DataFrame:
    """pool, site, ref, alt."""
    return calls.groupBy("pool", "site").agg(F.sum((F.col("allele") == 0).cast("long")).alias("ref"), F.sum((F.col("allele") != 0).cast("long")).alias("alt"))


def genotypes(calls: DataFrame) -> DataFrame:
    """pool, read_id, genotype ('100=0;300=1;' by position), mask and bits (bit_words of its sites, and of those with the
    alternate allele), n_calls."""
    by = calls.groupBy("pool", "read_id").agg(F.array_sort(F.collect_list(F.struct("site", "allele"))).alias("x"))
    token = F.transform("x", lambda c: F.concat(((c["site"] + 1) * 100).cast("string"), F.lit("="), c["allele"].cast("string"), F.lit(";")))
    last = F.element_at("x", -1)["site"]
    mask, bits = (bit_words(F.transform(x, lambda c: c["site"]), last) for x in (F.col("x"), F.filter("x", lambda c: c["allele"] != 0)))
    return by.select("pool", "read_id", F.array_join(token, "").alias("genotype"), mask.alias("mask"), bits.alias("bits"), F.size("x").cast("long").alias("n_calls"))


def fragments(calls: DataFrame, cap: int = COPY_CAP) -> DataFrame:
    """pool, genotype, mask, bits, n (copies, at most cap): what colouring works on."""
    return genotypes(calls).groupBy("pool", "genotype", "mask", "bits").agg(F.least(F.count(F.lit(1)), F.lit(cap).cast("long")).alias("n"))


def fixed_sites(freq: DataFrame) -> DataFrame:
    """Sites that no pool has at frequency 0."""
    return freq.groupBy("site").agg(F.every(F.col("freq") != 0).alias("ok")).where("ok").select("site")
