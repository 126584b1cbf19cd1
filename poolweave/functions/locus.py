"""Locus keys: chromosome;start;end;allele0:allele1..."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(key: Column) -> Column:
    """struct(chr, start, end, alleles, is_region)."""
    part = F.split(key, ";")
    start, end = (F.get(part, i).cast("int") for i in (1, 2))
    return F.struct(F.get(part, 0).cast("int").alias("chr"), start.alias("start"), end.alias("end"), F.split(F.get(part, 3), ":").alias("alleles"), (start != end).alias("is_region"))


def formatted(chromosome: Column, start: Column, end: Column, alleles: Column) -> Column:
    return F.concat_ws(";", chromosome.cast("string"), start.cast("string"), end.cast("string"), F.array_join(alleles, ":"))


def coding(alleles: Column) -> Column:
    """Map allele -> 0.0, 1.0, ... in the listed order."""
    return F.map_from_arrays(alleles, F.transform(F.sequence(F.lit(0), F.size(alleles) - 1), lambda i: i.cast("double")))


def hamming(a: Column, b: Column) -> Column:
    """Places at which two strings of one length differ; null for different lengths."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.when(F.length(a) == F.length(b), F.aggregate(pairs, F.lit(0), lambda s, x: s + x))


def hamming_matrix(alleles: Column) -> Column:
    return F.transform(alleles, lambda a: F.transform(alleles, lambda b: hamming(a, b)))
