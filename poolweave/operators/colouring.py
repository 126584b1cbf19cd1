"""Conflict graph of fragments and its colouring, one component at a time; colours become draft haplotypes.

Fragments are the distinct genotypes of a pool with their number of copies, as bit masks (arrays of longs, so of any
number of sites). Two conflict if they share a site and differ there. The nodes of a site that both alleles have are one
component, whatever else they hold: all of one allele conflict with all of the other. So components follow from the sites
that reads hold together, which are few, and nodes without such a site have no conflict at all. Choosing the next node is
sequential within a component, which is one group of applyInPandas. Copies are a number there, and colours are ranges: a
range of colours that the same nodes have is one row, so what a group holds is bounded by its distinct genotypes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.steps import Steps, kept
from .frequency import WORD, has_bit, neighbours

COLOURS = "pool long, genotype string, mask array<long>, bits array<long>, colour long"
#: The fragment has the colours colour to colour + n - 1.
RANGES = f"{COLOURS}, n long"
#: Longs of a posting list.
WORDS = 16
#: Sites of a node whose subsets are counted.
SHORT = 10
#: Posting lists that all tasks get whole (some 400 bytes each).
FEW = 1 << 15
#: More colours than there are.
OPEN_END = 1 << 62


def stacked(words: pd.Series) -> np.ndarray:
    """Arrays of longs as rows of one matrix, short ones filled up with zeros."""
    out = np.zeros((len(words), max(map(len, words), default=1)), np.int64)
    for row, w in zip(out, words, strict=True):
        row[: len(w)] = w
    return out


def site_alleles(fragments: DataFrame, *keep: str) -> DataFrame:
    """keep, site, allele: a row for each site of a fragment."""
    places = F.filter(F.sequence(F.lit(0), F.size("mask") * WORD - 1), lambda k: has_bit(F.col("mask"), k))
    cells = F.transform(places, lambda k: F.struct(k.alias("site"), has_bit(F.col("bits"), k).cast("int").alias("allele")))
    return fragments.select(*keep, F.explode(cells).alias("c")).select(*keep, "c.site", "c.allele")


def degrees(fragments: DataFrame) -> DataFrame:
    """pool, genotype, degree: with how many distinct genotypes of its pool one conflicts.

    Nodes of up to SHORT sites are counted among each other by subset_conflicts, in proportion to their number. Pairs with a
    node of more sites, which has too many subsets, go by posting lists, that is by the square of the nodes.
    """
    with Steps(fragments.sparkSession) as steps:
        held = F.aggregate("mask", F.lit(0), lambda s, w: s + F.bit_count(w))
        nodes = kept(fragments.select("pool", "genotype", "mask", "bits", held.alias("held")))
        short, long = nodes.where(F.col("held") <= SHORT), nodes.where(F.col("held") > SHORT)
        found = subset_conflicts(short).unionAll(nodes.select("pool", "genotype", F.lit(0).cast("long").alias("degree")))
        if long.limit(1).count():
            found = found.unionAll(counted_conflicts(long, short)).unionAll(counted_conflicts(nodes, long))
        return steps.result(found.groupBy("pool", "genotype").agg(F.sum("degree").alias("degree")))


def subset_conflicts(nodes: DataFrame) -> DataFrame:
    """pool, genotype, degree of the nodes that conflict with any, among nodes of up to SHORT sites.

    A node has its alleles at each subset of its sites. Those that conflict with a node have the other allele at one of its
    sites at least: the nodes with the other allele at one site, less those with it at two, and so on (inclusion and
    exclusion). So each node sends its subsets twice, once to be counted by their alleles, once to look up the others.

    Spark takes both sides of that join for as small as the file of the nodes, which a node's subsets multiply by up to
    2 ** SHORT, and would collect one of them on the driver; so the join is a merge, whatever their size seems to be. Nodes
    are dealt to all tasks first, as the little that they are read from would be a few tasks.
    """
    text = lambda k, v: F.concat(k.cast("string"), F.when(has_bit(F.col("bits"), k) == v, "b").otherwise("a"))
    places = F.filter(F.sequence(F.lit(0), F.size("mask") * WORD - 1), lambda k: has_bit(F.col("mask"), k))
    cells = F.transform(places, lambda k: F.struct(text(k, F.lit(True)).alias("own"), text(k, F.lit(False)).alias("other")))
    sets = F.sequence(F.lit(0).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), F.size("cells")) - 1)
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = nodes.repartition(tasks, "pool", "genotype").select("pool", "genotype", cells.alias("cells")).select("pool", "genotype", "cells", F.explode(sets).alias("set"))
    # subset number set has the cells of its bits
    of = lambda c: F.concat_ws("", *(F.when(F.getbit("set", F.lit(k)) == 1, F.get("cells", k)[c]) for k in range(SHORT)))
    held = each.where("set > 0")
    counts = held.groupBy("pool", of("own").alias("alleles")).agg(F.count(F.lit(1)).alias("n"))
    signed = counts.withColumn("n", F.when(F.length(F.translate("alleles", "0123456789", "")) % 2 == 1, F.col("n")).otherwise(-F.col("n")))
    asked = held.select("pool", "genotype", of("other").alias("alleles"))
    return asked.join(signed.hint("merge"), ["alleles", "pool"]).groupBy("pool", "genotype").agg(F.sum("n").alias("degree"))


def counted_conflicts(nodes: DataFrame, asking: DataFrame | None = None) -> DataFrame:
    """pool, genotype, degree of asking (of nodes themselves, where it is not given): with how many of nodes each conflicts.

    The nodes of a pool are dealt into blocks by a hash. For each block, site and allele the nodes that have it there are the
    bits of a few longs (a posting list); those that conflict with a node are the union of the lists of the other allele at its
    sites, and their number is a count of bits. Edges are neither written nor held. Nodes stay where their hash puts them, so
    a pool is as many tasks as there are; lists are a bit for each site of a node. They are counted to say how they join, as the
    size of their file says little: most words of a rare allele's list are null.
    """
    sizes = F.broadcast(nodes.groupBy("pool").agg(F.ceil(F.count(F.lit(1)) / (60 * WORDS)).alias("blocks")))
    places = nodes.select("pool", "genotype", "mask", "bits").join(sizes, "pool").withColumn("block", F.pmod(F.xxhash64("genotype"), F.col("blocks")))
    at = F.row_number().over(Window.partitionBy("pool", "block").orderBy("genotype")) - 1
    placed = site_alleles(places.withColumn("at", at), "pool", "block", "at").withColumn("part", F.floor(F.col("at") / (64 * WORDS)))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))
    word = (F.floor(F.col("at") / 64) % WORDS).cast("int")
    names = [f"w{k}" for k in range(WORDS)]
    lists = placed.groupBy("pool", "block", "site", "allele", "part").agg(*(F.bit_or(F.when(word == k, bit)).alias(c) for k, c in enumerate(names)))
    lists = kept(lists.withColumn("allele", 1 - F.col("allele")))
    lists = lists.hint("broadcast" if lists.count() <= FEW else "merge")
    own = site_alleles(nodes if asking is None else asking, "pool", "genotype")
    mine = own.repartition("pool", "genotype").join(sizes, "pool").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = mine.join(lists, ["pool", "block", "site", "allele"], "left").groupBy("pool", "genotype", "block", "part").agg(*(F.coalesce(F.bit_or(c), F.lit(0).cast("long")).alias(c) for c in names))
    hits = sum((F.bit_count(c).cast("long") for c in names[1:]), F.bit_count(names[0]).cast("long"))
    return met.groupBy("pool", "genotype").agg(F.sum(hits).alias("degree"))


def site_components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """pool, site, component (its smallest site). edges: pool, a, b: sites of one component; a site may stand by itself (a = b).

    Labels fall to the smallest of the neighbours' labels, then to that label's own, until none changes. Sites are few beside
    reads; every round is a written table all the same.
    """
    both = kept(edges.select("pool", "a", "b").union(edges.select("pool", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = kept(both.groupBy("pool", F.col("a").alias("site")).agg(F.least(F.min("b"), F.min("a")).alias("component")))
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("site", "b"), ["pool", "b"]).groupBy("pool", F.col("a").alias("site")).agg(F.min("component").alias("near"))
        hooked = labels.join(near, ["pool", "site"]).select("pool", "site", F.col("component").alias("old"), F.least("component", "near").alias("near"))
        jump = labels.select("pool", F.col("site").alias("near"), F.col("component").alias("far"))
        new = kept(hooked.join(jump, ["pool", "near"]).select("pool", "site", F.least("near", "far").alias("component"), "old"))
        labels = new.select("pool", "site", "component")
        if not new.where("component <> old").limit(1).count():
            return labels
    raise RuntimeError("components did not settle")


def with_component(fragments: DataFrame) -> DataFrame:
    """fragments with component: the smallest site of their component of the conflict graph, null for those without conflict."""
    words = fragments.select("pool", F.posexplode(F.arrays_zip("mask", "bits")).alias("w", "x")).select("pool", "w", F.col("x.bits").alias("ones"), F.col("x.mask").bitwiseAND(F.bitwise_not(F.col("x.bits"))).alias("zeros"))
    mixed = words.groupBy("pool", "w").agg(F.bit_or("ones").bitwiseAND(F.bit_or("zeros")).alias("m")).groupBy("pool").agg(F.map_from_entries(F.collect_list(F.struct("w", "m"))).alias("mixed"))
    # of each fragment the sites that both alleles have; there are far fewer such sets than fragments
    own = F.transform("mask", lambda w, k: w.bitwiseAND(F.element_at("mixed", k)))
    met = kept(fragments.join(mixed, "pool").withColumn("own", own).drop("mixed"))
    sites = F.filter(F.sequence(F.lit(0), F.size("own") * WORD - 1), lambda k: has_bit(F.col("own"), k))
    sets = met.where(F.exists("own", lambda w: w != 0)).select("pool", "own").distinct().withColumn("s", sites)
    sets = kept(sets)
    edges = sets.select("pool", F.get("s", 0).alias("a"), F.explode("s").alias("b")).distinct()
    first = sets.select("pool", "own", F.get("s", 0).alias("site")).join(site_components(edges), ["pool", "site"]).drop("site")
    return met.join(first, ["pool", "own"], "left").drop("own")


def added(planes: list[int], nodes: int, times: int) -> None:
    """Counters of all nodes, bit by bit (plane k holds bit k of each): times more for the nodes that are set."""
    for j in range(times.bit_length()):
        if times >> j & 1:
            carry, k = nodes, j
            while carry:
                planes += [0] * (k + 1 - len(planes))
                planes[k], carry = planes[k] ^ carry, planes[k] & carry
                k += 1


def coloured_ranges(mask: np.ndarray, bits: np.ndarray, copies: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Colours of each node as ranges, in two arrays (first ones, how many), as many as it has copies: most distinct neighbour colours first, lowest
    index on ties, lowest colours that no neighbour has. mask, bits: nodes by words.

    Sets of nodes are bits: the posting lists of sites and alleles, and the planes of the counters of saturation, from which
    the next node is read plane by plane. Colours that so far have the same nodes are one range, which is cut when a node
    takes a part of it. Of a range only the alleles that its nodes hold are kept: they have no conflict, so a node is near
    the range exactly if it differs from those alleles, and what is held grows with nodes and ranges, not with their product.
    """
    n = len(mask)
    lists: list[np.ndarray] = []
    opposite: list[list[int]] = [[] for _ in range(n)]
    place: dict[tuple[int, int], int] = {}
    for w in range(mask.shape[1]):
        for k in range(WORD):
            held = (mask[:, w] >> k & 1).astype(bool)
            ones = held & (bits[:, w] >> k & 1).astype(bool)
            if ones.any() and not ones[held].all():
                place[w, k] = len(lists)
                for i in np.flatnonzero(held).tolist():
                    opposite[i].append(len(lists) + (0 if ones[i] else 1))
                lists += [np.packbits(held & ~ones, bitorder="little"), np.packbits(ones, bitorder="little")]
    wide = -(-n // 8)
    posting = np.stack(lists) if lists else np.zeros((1, wide), np.uint8)
    words = mask.shape[1]
    taken, alleles = np.zeros((64, words), np.int64), np.zeros((64, words), np.int64)
    starts, sizes, rows = np.zeros(64, np.int64), np.zeros(64, np.int64), 1
    sizes[0] = OPEN_END

    def near(r: int) -> np.ndarray:
        """The nodes in conflict with range r, as bits."""
        at = [place[w, k] + (0 if int(alleles[r, w]) >> k & 1 else 1) for w, k in place if int(taken[r, w]) >> k & 1]
        return np.bitwise_or.reduce(posting[at], axis=0) if at else np.zeros(wide, np.uint8)

    planes: list[int] = []
    left = (1 << n) - 1
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for _ in range(n):
        best = left
        for plane in reversed(planes):
            best = best & plane or best
        i = (best & -best).bit_length() - 1
        left ^= 1 << i
        mine = np.bitwise_or.reduce(posting[opposite[i]], axis=0) if opposite[i] else np.zeros(wide, np.uint8)
        free = np.flatnonzero(~(taken[:rows] & mask[i] & (alleles[:rows] ^ bits[i])).any(axis=1))
        need = int(copies[i])
        while need:
            at = int(starts[free].argmin())
            r = int(free[at])
            take = min(need, int(sizes[r]))
            if take < sizes[r]:
                if rows == len(taken):
                    taken, alleles, starts, sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (taken, alleles, starts, sizes))
                taken[rows], alleles[rows], starts[rows], sizes[rows] = taken[r], alleles[r], starts[r] + take, sizes[r] - take
                sizes[r] = take
                rows += 1
            out[i].append((int(starts[r]), take))
            added(planes, int.from_bytes((mine & ~near(r)).tobytes(), "little"), take)
            taken[r] |= mask[i]
            alleles[r] |= bits[i]
            need -= take
            if need:
                free = np.delete(free, at)
    cuts = np.sort(starts[:rows])
    return [pieces(each, cuts) for each in out]


def pieces(ranges: list[tuple[int, int]], cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges cut where later nodes took a part of them. All starts of ranges are among the cuts."""
    first = [cuts[np.searchsorted(cuts, a) : np.searchsorted(cuts, a + size)] for a, size in ranges]
    sizes = [np.diff(x, append=a + size) for x, (a, size) in zip(first, ranges, strict=True)]
    return (np.concatenate(first), np.concatenate(sizes)) if first else (np.empty(0, np.int64), np.empty(0, np.int64))


def coloured_nodes(mask: np.ndarray, bits: np.ndarray, copies: np.ndarray) -> list[np.ndarray]:
    """All colours of each node."""
    return [np.concatenate([np.arange(a, a + size) for a, size in zip(*each, strict=True)] or [np.empty(0, np.int64)]) for each in coloured_ranges(mask, bits, copies)]


def colour_ranges(fragments: DataFrame) -> DataFrame:
    """See RANGES. Two ranges of a pool are the same or have no colour in common. Nodes are taken in the order of their
    genotype, so results repeat; that of one component does not depend on others."""
    with Steps(fragments.sparkSession) as steps:
        return steps.result(component_ranges(kept(with_component(kept(fragments)))))


def component_ranges(nodes: DataFrame) -> DataFrame:
    """RANGES of nodes with their component. A node leaves Python as one row, and becomes one for each of its ranges in Spark."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("genotype", kind="stable").reset_index(drop=True)
        found = coloured_ranges(stacked(rows["mask"]), stacked(rows["bits"]), rows["n"].to_numpy(np.int64))
        return rows[["pool", "genotype", "mask", "bits"]].assign(first=[a for a, _ in found], size=[size for _, size in found])

    columns = ("pool", "genotype", "mask", "bits", "n")
    linked = nodes.where("component IS NOT NULL").groupBy("pool", "component").applyInPandas(run, "pool long, genotype string, mask array<long>, bits array<long>, first array<long>, size array<long>")
    linked = linked.select("pool", "genotype", "mask", "bits", F.explode(F.arrays_zip("first", "size")).alias("x")).select("pool", "genotype", "mask", "bits", F.col("x.first").alias("colour"), F.col("x.size").alias("n"))
    alone = nodes.where("component IS NULL").select(*columns).withColumn("colour", F.lit(0).cast("long")).select("pool", "genotype", "mask", "bits", "colour", "n")
    ranges = kept(linked.unionAll(alone.where("n > 0")))
    # ranges of different components are cut at each other's ends
    ends = ranges.select("pool", F.explode(F.array(F.col("colour"), F.col("colour") + F.col("n"))).alias("c")).groupBy("pool").agg(F.array_sort(F.collect_set("c")).alias("ends"))
    long = ranges.where("n > 1").join(ends, "pool")
    last = F.col("colour") + F.col("n")
    cuts = F.filter("ends", lambda c: (c >= F.col("colour")) & (c <= last))
    parts = long.withColumn("cuts", cuts).select("pool", "genotype", "mask", "bits", F.explode(F.zip_with(F.slice("cuts", 1, F.size("cuts") - 1), F.slice("cuts", 2, F.size("cuts") - 1), lambda a, b: F.struct(a.alias("colour"), (b - a).alias("n")))).alias("x"))
    return ranges.where("n = 1").unionAll(parts.select("pool", "genotype", "mask", "bits", "x.colour", "x.n"))


def coloured(fragments: DataFrame) -> DataFrame:
    """See COLOURS: a row for each copy."""
    ranges = colour_ranges(fragments)
    return ranges.select("pool", "genotype", "mask", "bits", F.explode(F.sequence(F.col("colour"), F.col("colour") + F.col("n") - 1)).alias("colour"))


def consensus(colours: DataFrame, sites: int) -> DataFrame:
    """pool, colour, n, hap, links of COLOURS or RANGES (n colours from colour on are alike). A colour has no conflict, so the union of its fragments gives each site one allele;
    '-' links neighbours that some fragment holds both of, '?' the others."""
    places = F.sequence(F.lit(0), F.lit(sites - 1))
    alike = F.col("n") if "n" in colours.columns else F.lit(1).cast("long")
    words = colours.select("pool", "colour", alike.alias("n"), F.posexplode(F.arrays_zip("mask", "bits", neighbours(F.col("mask")).alias("pairs"))).alias("word", "x"))
    merged = words.groupBy("pool", "colour", "n", "word").agg(*(F.bit_or(f"x.{c}").alias(c) for c in ("mask", "bits", "pairs")))
    by = merged.groupBy("pool", "colour", "n").agg(F.array_sort(F.collect_list(F.struct("word", "mask", "bits", "pairs"))).alias("x"))
    of = lambda c: F.transform("x", lambda w: w[c])
    hap = F.array_join(F.transform(places, lambda k: F.when(~has_bit(F.col("mask"), k), "*").when(has_bit(F.col("bits"), k), "1").otherwise("0")), "")
    links = F.array_join(F.transform(F.slice(places, 1, sites - 1), lambda k: F.when(has_bit(F.col("pairs"), k), "-").otherwise("?")), "")
    return by.select("pool", "colour", "n", of("mask").alias("mask"), of("bits").alias("bits"), of("pairs").alias("pairs")).select("pool", "colour", "n", hap.alias("hap"), links.alias("links"))


def draft_haplotypes(consensuses: DataFrame, most_unknown: int = 0) -> DataFrame:
    """pool, hap, links, n: complete colours counted by allele string, with the links of the last colour."""
    unknown = F.length(F.regexp_replace("hap", "[^*]", ""))
    return consensuses.where(unknown <= most_unknown).groupBy("pool", "hap").agg(F.sum("n").alias("n"), F.max_by("links", "colour").alias("links"))


def draft_line(hap: Column, links: Column, n: Column) -> Column:
    """Alleles and links in turn, a tab, the count."""
    body = F.array_join(F.zip_with(F.split(hap, ""), F.split(links, ""), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.concat_ws("\t", body, n.cast("string"))
