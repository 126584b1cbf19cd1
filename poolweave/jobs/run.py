"""Whole runs from files to files.

    python -m poolweave.jobs.run reads PROPERTIES PREFIX        alignments and variants to reads and site frequencies
    python -m poolweave.jobs.run haplotypes PROPERTIES PREFIX   reads and site frequencies to haplotypes

Options: --frequencies depths takes site frequencies from the variants' allele depths instead of the reads; --truth FILE keeps
the variants alone that a file of known site frequencies has in all pools; --list FILE names the files of alignments or
reads, one for each pool from 0 on; --weighted-gaps counts gaps by copies.

Files have the names that follow from the prefix, in the folders that the properties name. Reads are a folder with a folder
for each pool; reads of other programs, a file for each pool numbered in its name, are taken as well.
"""

from __future__ import annotations

import sys
from argparse import ArgumentParser
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frequency, haplotypes, reads
from ..operators.colouring import draft_line
from ..sources import files, params
from ..sources.steps import Steps
from . import reconstruct as whole


def pool_of(file: Column, suffix: str) -> Column:
    """Number of the pool in .../prefix_p3.vef, or in the name of a folder, pool=3."""
    name = F.regexp_extract(file, r"(?:_p(\d+)" + suffix.replace(".", r"\.") + r"|/pool=(\d+)/)", 0)
    return F.regexp_extract(name, r"\d+", 0).try_cast("long")


def with_pool(spark: SparkSession, rows: DataFrame, files_of: DataFrame | None, suffix: str) -> DataFrame:
    """rows (file and anything else) with pool: by a list of paths (as many as pools), or else by the names of the files."""
    if files_of is None:
        return rows.withColumn("pool", pool_of(F.col("file"), suffix))
    return rows.withColumn("file", files.plain_path(F.col("file"))).join(files_of, "file")


def several_chromosomes(sites: DataFrame) -> list[str]:
    """The chromosomes of sites in order, if there are several; they are few. Sites may name none."""
    if "chr" not in sites.columns:
        return []
    names = sorted(r["chr"] for r in sites.select("chr").distinct().collect())
    return names if len(names) > 1 else []


def calls_of_files(spark: SparkSession, folder: str, prefix: str, sites: DataFrame, paths: str | None = None) -> DataFrame:
    """pool, read_id, site, allele from read text, at known sites; the first of repeated calls of a read counts."""
    own = f"{folder}/{prefix}_reads"
    found, named = files.listed(spark, paths) if paths else (own if files.exists(spark, own) else f"{folder}/{prefix}_p*.vef", None)
    rows = with_pool(spark, files.reads(spark, found), named, ".vef").select("pool", "read_id", F.posexplode("calls").alias("ord", "c"))
    if several_chromosomes(sites):
        rows = rows.withColumn("chr", F.split("read_id", r"\|")[0])  # as reads_of_alignments names them
    else:
        sites = sites.drop("chr")
    at = reads.place(rows)[:-1]
    # names of reads are only told apart within their pool
    calls = rows.select("pool", *at, F.concat_ws(":", "pool", "read_id").alias("read_id"), "ord", F.col("c.pos").alias("pos"), F.col("c.allele").try_cast("long").alias("allele")).where("allele IS NOT NULL")
    return reads.site_calls(calls.groupBy("pool", *at, "read_id", "pos").agg(F.min_by("allele", "ord").alias("allele")), sites)


def haplotypes_of_files(spark: SparkSession, p: params.Parameters, prefix: str, paths: str | None = None) -> DataFrame:
    """Read the reads and site frequencies of a run; write drafts, plan, candidates, and both files of the result."""
    work, out = p.work_dir.rstrip("/"), p.output_dir.rstrip("/")
    sites = whole.kept(files.site_index(spark, f"{work}/{prefix}_vars.intra_freq.txt"))
    count = sites.count()
    calls = whole.kept(calls_of_files(spark, work, prefix, sites, paths))
    drafts, (one, two), candidates = whole.pieces(calls, count, p)
    line = draft_line(F.col("hap"), F.col("links"), F.col("n")).alias("value")
    drafts.select("pool", line).write.mode("overwrite").partitionBy("pool").text(f"{work}/{prefix}_drafts")
    files.write_lines(files.plan_lines(whole.regions.region_table(spark, (one, two))), f"{work}/{prefix}_dc_plan.txt")
    text = F.col("freq").cast("string").alias("value")
    ids = haplotypes.first_seen(candidates.select(F.lit(0).alias("pool"), "hap"))
    if len(one) > 1:
        files.write_matrix(files.inter_cells(candidates.join(ids, "hap").select("hap_id", "hap", text), sites), f"{out}/{prefix}_gc.inter_freq_vars.txt")
    shares = whole.kept(whole.pool_lasso(candidates, calls, p))
    found = haplotypes.merged_pools(shares, calls.select("pool").distinct())
    found = whole.kept(found.join(haplotypes.first_seen(shares.where("freq > 0")), "hap"))
    files.write_haplotypes(found, sites, f"{out}/{prefix}.inter_freq_vars.txt", f"{out}/{prefix}.intra_freq.txt")
    return found


def known_sites(spark: SparkSession, variants: DataFrame, truth: str) -> DataFrame:
    """variants at the sites that a file of site frequencies has above 0 in every pool."""
    at = reads.place(variants)
    key = F.struct(*(F.col("at.chr").cast("string").alias("chr") if c == "chr" else F.col("at.start").cast("long").alias("pos") for c in at))
    given = files.site_frequencies(spark, truth).select(key.alias("site"), "freq")
    return variants.join(frequency.fixed_sites(given).select(*(f"site.{c}" for c in at)), at, "left_semi")


def depth_frequencies(cells: DataFrame, variants: DataFrame, places: DataFrame) -> DataFrame:
    """pool, site, freq from the allele depths of the record that counts at each position."""
    at = reads.place(cells, variants)
    first = cells.join(variants.select(*at, F.col("record").alias("first")), at).where("record = first")
    freq = frequency.depth_frequency(F.col("ref_depth"), F.col("alt_depth"))
    return first.join(places.select("site", *at), at).select(F.col("pool").cast("long").alias("pool"), "site", freq.cast("double").alias("freq"))


def reads_of_alignments(spark: SparkSession, p: params.Parameters, prefix: str, frequencies: str = "reads", truth: str | None = None, paths: str | None = None) -> DataFrame:
    """Read alignments (one file for each pool) and variants; write reads, mates linked, and site frequencies: shares of the
    reads, or (depths) of the variants' allele depths."""
    if frequencies not in ("reads", "depths"):
        raise ValueError(f"frequencies of {frequencies}: they come from reads or depths")
    source, work = (p.input_dir or p.work_dir).rstrip("/"), p.work_dir.rstrip("/")
    cells = whole.kept(files.variants(spark, f"{source}/{prefix}.vcf"))
    names = several_chromosomes(cells)
    if names:  # keys number chromosomes from 0, in order
        number = F.create_map(*(F.lit(x) for k, c in enumerate(names) for x in (c, str(k))))
        cells = cells.withColumn("chr", number[F.col("chr")])
    else:
        cells = cells.drop("chr")
    variants = reads.first_variants(cells, "record")
    variants = whole.kept(known_sites(spark, variants, truth) if truth else variants)
    found, named = files.listed(spark, paths) if paths else (f"{source}/{prefix}_p*.srt.sam", None)
    sam = with_pool(spark, files.alignments(spark, found), named, ".srt.sam")
    # a read of several chromosomes is one in each: its name begins with the chromosome's number
    sam = sam.withColumn("chr", number[F.col("chr")]).where("chr IS NOT NULL").withColumn("read_id", F.concat_ws("|", "chr", "read_id")) if names else sam.drop("chr")
    calls = whole.kept(reads.base_calls(sam, variants, "record"))
    sites = variants.select(*reads.place(variants), F.concat(F.col("chr") if names else F.lit("0"), F.lit(";"), F.col("pos"), F.lit(";"), F.col("pos"), F.lit(";0:1")).alias("locus"))
    places = reads.numbered(sites)
    linked = reads.linked_mates(calls.withColumn("ord", F.col("pos")))
    line = reads.read_line(F.col("read_id"), F.col("calls"), F.col("spans"))
    files.write_pools(linked.select("pool", F.col("read_id").alias("name"), line.alias("line")), f"{work}/{prefix}_reads")
    freq = depth_frequencies(cells, variants, places) if frequencies == "depths" else frequency.site_frequency(reads.site_calls(calls, places))
    files.write_lines(files.freq_lines(freq.select("pool", "site", F.col("freq").cast("string").alias("value")), places), f"{work}/{prefix}_vars.intra_freq.txt")
    return freq


def main(arguments: list[str]) -> None:
    parser = ArgumentParser(prog="poolweave.jobs.run")
    parser.add_argument("what", choices=("reads", "haplotypes"))
    parser.add_argument("properties")
    parser.add_argument("prefix")
    parser.add_argument("--frequencies", choices=("reads", "depths"), default="reads")
    parser.add_argument("--truth")
    parser.add_argument("--list")
    parser.add_argument("--weighted-gaps", action="store_true")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName(f"poolweave {given.what}").getOrCreate()
    p = replace(params.load(given.properties), weighted_gaps=given.weighted_gaps)
    with Steps(spark):
        if given.what == "reads":
            reads_of_alignments(spark, p, given.prefix, given.frequencies, given.truth, given.list)
        else:
            haplotypes_of_files(spark, p, given.prefix, given.list)


if __name__ == "__main__":
    main(sys.argv[1:])
