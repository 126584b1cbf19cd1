"""Registered queries of the haplotype operators, each with SQL that gives the same rows.

Queries run on the bridge of sources/bridge.py, over whole tables. Doubles are rounded on both sides, as sums run in
different orders. Queries named *_check state a property that must hold, as rows whose right values are known.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import algebra, locus
from ..operators import colouring, em, frequency, haplotypes, linkage, reads, regions, regression
from ..sources import bridge, files
from ..sources.bridge import CALLS_SQL, HAPS_SQL, POOLS, SITES
from . import reconstruct as whole

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
MAF_SQL = f"{CALLS_SQL}, maf AS (SELECT pool, site, count(*) AS n, avg(CAST(allele AS DOUBLE)) AS freq FROM calls GROUP BY pool, site)"
LD_SQL = f"""{CALLS_SQL}, ld AS (SELECT a.pool AS pool, a.site AS l1, b.site AS l2, count(*) AS n,
  avg(CASE WHEN a.allele = 1 AND b.allele = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p11
  FROM calls a JOIN calls b ON a.read_id = b.read_id AND a.site < b.site GROUP BY ALL)"""
GENO_SQL = f"""{CALLS_SQL}, reads AS (SELECT pool, read_id, string_agg((100 * (site + 1)) || '=' || allele || ';', '' ORDER BY site) AS genotype,
  CAST(sum(1 << site) AS BIGINT) AS mask, CAST(sum(allele << site) AS BIGINT) AS bits FROM calls GROUP BY pool, read_id),
geno AS (SELECT pool, genotype, mask, bits, count(*) AS copies FROM reads GROUP BY ALL)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r9(c: Column | str) -> Column:
    return F.round(c, 9)


@query(f"WITH {LD_SQL} SELECT pool, l1, l2, n, round(p11, 9) AS p11 FROM ld")
def ld_pairs_pool(spark: SparkSession, d: str) -> DataFrame:
    return linkage.pair_linkage(bridge.calls(spark, d)).select("pool", "l1", "l2", "n", r9("p11").alias("p11"))


@query(f"WITH {LD_SQL} SELECT l1, l2, count(*) AS n_pools, round(avg(p11), 9) AS p11 FROM ld GROUP BY l1, l2")
def ld_pairs_multi(spark: SparkSession, d: str) -> DataFrame:
    return linkage.pooled_linkage(linkage.pair_linkage(bridge.calls(spark, d))).select("l1", "l2", "n_pools", r9("p11").alias("p11"))


@query(f"WITH {LD_SQL} SELECT l1, l2, count(*) AS n_pools, round(avg(p11), 9) AS p11 FROM ld GROUP BY l1, l2 HAVING count(*) = 8")
def ld_pairs_strict(spark: SparkSession, d: str) -> DataFrame:
    return linkage.pooled_linkage(linkage.pair_linkage(bridge.calls(spark, d)), POOLS).select("l1", "l2", "n_pools", r9("p11").alias("p11"))


@query(f"WITH {MAF_SQL} SELECT a.site AS l1, b.site AS l2, round(covar_pop(a.freq, b.freq), 9) AS cov FROM maf a JOIN maf b ON a.pool = b.pool AND a.site < b.site GROUP BY 1, 2")
def ld_cov_stat(spark: SparkSession, d: str) -> DataFrame:
    return linkage.frequency_covariance(frequency.site_frequency(bridge.calls(spark, d))).select("l1", "l2", r9("cov").alias("cov"))


@query(f"WITH {MAF_SQL} SELECT pool, site, n, round(freq, 9) AS freq FROM maf")
def maf_pool(spark: SparkSession, d: str) -> DataFrame:
    return frequency.site_frequency(bridge.calls(spark, d)).withColumn("freq", r9("freq"))


@query(f"WITH {MAF_SQL} SELECT site, round(avg(freq), 9) AS freq FROM maf GROUP BY site")
def maf_global(spark: SparkSession, d: str) -> DataFrame:
    return frequency.global_frequency(frequency.site_frequency(bridge.calls(spark, d))).withColumn("freq", r9("freq"))


@query(f"""WITH {CALLS_SQL}, c AS (SELECT pool, 100 * (site + 1) AS pos, count(*) FILTER (allele = 0) AS ref_depth, count(*) FILTER (allele = 1) AS alt_depth FROM calls GROUP BY ALL)
SELECT pool, pos, ref_depth, alt_depth, round(CASE WHEN ref_depth + alt_depth > 0 THEN alt_depth / (ref_depth + alt_depth) ELSE 0.0 END, 9) AS freq FROM c""")
def vcf_ad_freq(spark: SparkSession, d: str) -> DataFrame:
    """Depths written as variant text (samples in the header's order), read back by their place in it."""
    depth = frequency.allele_depths(bridge.calls(spark, d))
    cell = F.concat_ws(":", F.lit("./."), F.concat_ws(",", F.col("ref").cast("string"), F.col("alt").cast("string")), (F.col("ref") + F.col("alt")).cast("string"), F.lit("0"), F.lit("."))
    line = depth.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("pool", cell.alias("cell")))).alias("c"))
    line = line.select(F.concat_ws("\t", F.lit("1"), bridge.position(F.col("site")).cast("string"), F.lit("."), F.lit("A"), F.lit("T"), F.lit("."), F.lit("."), F.lit("."), F.lit("GT:AD:DP:GQ:PL"), F.array_join(F.transform("c", lambda x: x["cell"]), "\t")).alias("line"), F.transform("c", lambda x: x["pool"]).alias("header"))
    c = F.split("line", "\t")
    cells = line.select(F.get(c, 1).cast("long").alias("pos"), F.get(c, 3).alias("ref"), F.get(c, 4).alias("alt"), F.get(c, 8).alias("format"), "header", F.posexplode(F.slice(c, 10, 10_000)).alias("i", "cell"))
    found = files.depths(cells.withColumn("pool", F.get("header", F.col("i"))))
    return found.select("pool", "pos", "ref_depth", "alt_depth", r9(frequency.depth_frequency(F.col("ref_depth"), F.col("alt_depth"))).alias("freq"))


@query(f"WITH {CALLS_SQL} SELECT pool, read_id, 100 * (site + 1) AS pos, CAST(allele AS VARCHAR) AS allele FROM calls")
def vef_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Calls written as read text and parsed back."""
    by = bridge.calls(spark, d).groupBy("pool", "read_id").agg(F.array_sort(F.collect_list(F.struct(bridge.position(F.col("site")).alias("pos"), "allele"))).alias("calls"))
    spans = F.array(F.struct(F.array_min("calls.pos").alias("start"), F.array_max("calls.pos").alias("end")))
    text = by.select("pool", reads.read_line(F.col("read_id"), F.col("calls"), spans).alias("line"))
    back = text.select("pool", reads.parsed_line(F.col("line")).alias("r"))
    return back.select("pool", F.col("r.read_id").cast("long").alias("read_id"), F.explode("r.calls").alias("c")).select("pool", "read_id", "c.pos", "c.allele")


@query("""WITH p AS (SELECT p_partkey, (p_partkey * 2654435761) % 4096 AS x, (p_partkey * 40503) % 4096 AS y FROM part)
SELECT p_partkey, p_partkey % 5 || ';' || p_partkey * 10 || ';' || (p_partkey * 10 + p_partkey % 3) || ';' || lpad(bin(x), 12, '0') || ':' || lpad(bin(y), 12, '0') AS key,
  CAST(p_partkey % 5 AS INTEGER) AS chr, CAST(p_partkey * 10 AS INTEGER) AS "start", CAST(p_partkey * 10 + p_partkey % 3 AS INTEGER) AS "end", p_partkey % 3 <> 0 AS is_region,
  CAST(bit_count(xor(x, y)) AS INTEGER) AS distance FROM p""")
def locus_parse(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    alleles = F.array(*(F.lpad(F.bin((k * m) % 4096), 12, "0") for m in (2654435761, 40503)))
    keys = bridge.table(spark, d, "part").select("p_partkey", locus.formatted(k % 5, k * 10, k * 10 + k % 3, alleles).alias("key"))
    rows = keys.withColumn("x", locus.parsed(F.col("key")))
    back = locus.formatted(F.col("x.chr"), F.col("x.start"), F.col("x.end"), F.col("x.alleles"))
    return rows.select("p_partkey", back.alias("key"), "x.chr", "x.start", "x.end", "x.is_region", locus.hamming_matrix(F.col("x.alleles"))[0][1].alias("distance"))


@query(f"WITH {HAPS_SQL} SELECT hap, round(freq, 9) AS freq, CAST(s AS BIGINT) AS site, CAST(substr(hap, CAST(s + 1 AS INTEGER), 1) AS DOUBLE) AS code FROM haps, range(12) t(s)")
def allele_encode(spark: SparkSession, d: str) -> DataFrame:
    return haplotypes.encoded(bridge.haps(spark, d)).withColumn("freq", r9("freq"))


@query("""WITH raw AS (SELECT l_orderkey % 8 AS pool, l_orderkey AS read_id, 100 * (l_partkey % 12 + 1) AS pos, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS allele,
    min(l_linenumber) OVER (PARTITION BY l_orderkey, l_linenumber % 2) AS rec,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS ord FROM lineitem),
one AS (SELECT *, row_number() OVER (PARTITION BY read_id, pos ORDER BY rec, ord) AS rn FROM raw),
spans AS (SELECT read_id, rec, min(pos) AS s, max(pos) AS e FROM raw GROUP BY ALL),
st AS (SELECT read_id, string_agg(s || chr(9) || e, chr(9) ORDER BY s, e) AS t FROM spans GROUP BY read_id)
SELECT CAST(pool AS BIGINT) AS pool, o.read_id, o.read_id || ':' || chr(9) || string_agg(pos || '=' || allele || ';', '' ORDER BY pos) || chr(9) || '//' || chr(9) || any_value(st.t) AS line
FROM one o JOIN st ON st.read_id = o.read_id WHERE rn = 1 GROUP BY pool, o.read_id""")
def pair_link(spark: SparkSession, d: str) -> DataFrame:
    raw = bridge.raw_calls(spark, d)
    by = Window.partitionBy("read_id")
    rows = raw.select("pool", "read_id", bridge.position(F.col("site")).alias("pos"), "allele", F.min("l_linenumber").over(Window.partitionBy("read_id", "mate")).alias("record"), F.row_number().over(by.orderBy(*bridge.ORDER)).alias("ord"))
    return reads.linked_mates(rows).select("pool", "read_id", reads.read_line(F.col("read_id"), F.col("calls"), F.col("spans")).alias("line"))


@query(f"WITH {GENO_SQL} SELECT pool, genotype, least(copies, 32877) AS n, least(copies, 5) AS n_capped_at_5 FROM geno")
def genotype_counts(spark: SparkSession, d: str) -> DataFrame:
    return frequency.fragments(bridge.calls(spark, d)).select("pool", "genotype", "n", F.least("n", F.lit(5).cast("long")).alias("n_capped_at_5"))


REGIONS = ((1, 0, 0, 3), (1, 1, 4, 7), (1, 2, 8, 11), (2, 0, 2, 5), (2, 1, 6, 9))
REGIONS_SQL = "regions(level, region, a, b) AS (VALUES " + ", ".join(map(str, REGIONS)) + ")"
PROJECT_SQL = f"{HAPS_SQL}, {REGIONS_SQL}, slices AS (SELECT CAST(level AS BIGINT) AS level, CAST(region AS BIGINT) AS region, substr(hap, a + 1, b - a + 1) AS hap, sum(freq) AS freq FROM haps, regions GROUP BY ALL)"


def slices(spark: SparkSession, d: str) -> DataFrame:
    haps, out = bridge.haps(spark, d), None
    for level, region, a, b in REGIONS:
        part = haplotypes.projected(haps, a, b).select(F.lit(level).cast("long").alias("level"), F.lit(region).cast("long").alias("region"), "hap", "freq")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {PROJECT_SQL} SELECT level, region, hap, round(freq, 9) AS freq FROM slices")
def hap_project(spark: SparkSession, d: str) -> DataFrame:
    return slices(spark, d).withColumn("freq", r9("freq"))


@query(f"WITH {PROJECT_SQL} SELECT level, region, hap, unnest(range(1, CAST(floor(round(freq, 9) * 1000) AS BIGINT) + 1)) AS copy FROM slices")
def fragment_dosage(spark: SparkSession, d: str) -> DataFrame:
    return haplotypes.dosage(slices(spark, d).withColumn("freq", r9("freq")))


@query(f"""WITH {GENO_SQL} SELECT a.pool, a.genotype, CAST(sum(CASE WHEN (a.mask & b.mask & xor(a.bits, b.bits)) <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS degree
FROM geno a JOIN geno b ON a.pool = b.pool GROUP BY a.pool, a.genotype""")
def conflict_edges(spark: SparkSession, d: str) -> DataFrame:
    return colouring.degrees(frequency.fragments(bridge.calls(spark, d)))


COLOUR_SQL = f"""WITH RECURSIVE {GENO_SQL}, nodes AS (SELECT pool, mask, bits, CAST(least(copies, 32877) AS INTEGER) AS n, row_number() OVER (PARTITION BY pool ORDER BY genotype) AS id FROM geno),
most AS (SELECT CAST(max(n) AS INTEGER) AS width FROM (SELECT sum(n) AS n FROM nodes GROUP BY pool)),
dsatur(pool, id, near, colours) USING KEY (pool, id) AS (SELECT pool, id, bitstring('0', width), NULL::INTEGER[] FROM nodes, most
  UNION (WITH pick AS (SELECT d.pool, d.id, x.mask, x.bits, CASE WHEN x.n = 1 THEN [bit_position('0'::BIT, d.near) - 1] ELSE list_filter(range(bit_length(d.near)), lambda c: get_bit(d.near, CAST(c AS INTEGER)) = 0)[1 : x.n] END::INTEGER[] AS colours
      FROM (SELECT pool, arg_min(id, (-bit_count(near)) * 1000000000 + id) AS id FROM recurring.dsatur WHERE colours IS NULL GROUP BY pool) b JOIN recurring.dsatur d USING (pool, id) JOIN nodes x USING (pool, id)),
    own AS (SELECT pool, id, mask, bits AS b, colours, list_reduce(list_prepend(bitstring('0', width), list_transform(colours, lambda c: set_bit(bitstring('0', width), c, 1))), lambda a, b: a | b) AS taken FROM pick, most)
    SELECT pool, id, bitstring('0', 1), colours FROM own
    UNION ALL SELECT d.pool, d.id, d.near | p.taken, NULL FROM own p JOIN nodes x ON x.pool = p.pool AND (x.mask & p.mask & xor(x.bits, p.b)) <> 0
      JOIN recurring.dsatur d ON d.pool = x.pool AND d.id = x.id WHERE d.colours IS NULL)),
each AS (SELECT pool, id, unnest(colours) AS colour FROM dsatur),
merged AS (SELECT pool, colour, bit_or(mask) AS mask, bit_or(bits) AS bits, bit_or(mask & (mask >> 1)) AS pairs FROM each JOIN nodes USING (pool, id) GROUP BY pool, colour),
texts AS (SELECT pool, colour, array_to_string(list_transform(range(12), lambda k: CASE WHEN (mask >> CAST(k AS INTEGER)) & 1 = 0 THEN '*' WHEN (bits >> CAST(k AS INTEGER)) & 1 = 1 THEN '1' ELSE '0' END), '') AS hap,
  array_to_string(list_transform(range(11), lambda k: CASE WHEN (pairs >> CAST(k AS INTEGER)) & 1 = 1 THEN '-' ELSE '?' END), '') AS links FROM merged)
SELECT pool, hap, arg_max(links, colour) AS links, count(*) AS n,
  array_to_string(list_transform(range(1, 12), lambda i: substr(hap, i, 1) || substr(arg_max(links, colour), i, 1)), '') || substr(hap, 12, 1) || chr(9) || count(*) AS line FROM texts GROUP BY pool, hap"""


@query(f"WITH {GENO_SQL} SELECT pool, CAST(sum(least(copies, 32877)) AS BIGINT) AS copies, CAST(0 AS BIGINT) AS conflicts, CAST(0 AS BIGINT) AS repeated FROM geno GROUP BY pool")
def colour_check(spark: SparkSession, d: str) -> DataFrame:
    """In no colour do fragments differ at a site, and none holds one genotype twice."""
    colours = colouring.coloured(frequency.fragments(bridge.calls(spark, d)))
    ones, zeros = F.bit_or(F.col("bits")[0]), F.bit_or(F.col("mask")[0].bitwiseAND(F.bitwise_not(F.col("bits")[0])))  # 12 sites lie in the first word
    by = colours.groupBy("pool", "colour").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("genotype").alias("kinds"), (ones.bitwiseAND(zeros) != 0).cast("long").alias("bad"))
    return by.groupBy("pool").agg(F.sum("n").alias("copies"), F.sum("bad").alias("conflicts"), F.sum(F.col("n") - F.col("kinds")).alias("repeated"))


@query(COLOUR_SQL)
def colour_haps(spark: SparkSession, d: str) -> DataFrame:
    """Drafts from the colours of each pool's reads; the SQL colours node by node too, all pools at once."""
    drafts = whole.pool_drafts(bridge.calls(spark, d), SITES, most_unknown=SITES)
    return drafts.select("pool", "hap", "links", "n", colouring.draft_line(F.col("hap"), F.col("links"), F.col("n")).alias("line"))


def geno_links(spark: SparkSession, d: str) -> DataFrame:
    """Distinct genotypes as drafts: a link where one holds both neighbours."""
    rows = frequency.fragments(bridge.calls(spark, d))
    links = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(SITES - 2)), lambda k: F.when(frequency.has_bit(F.col("pairs"), k), "-").otherwise("?")), "")
    return rows.select("pool", "n", frequency.neighbours(F.col("mask")).alias("pairs")).select("pool", links.alias("links"), "n")


GAP_SQL = f"""{GENO_SQL}, gaps AS (SELECT pool, CAST(k AS BIGINT) AS k, CAST(sum(CASE WHEN (mask >> CAST(k AS INTEGER)) & 3 = 3 THEN 0 ELSE least(copies, 32877) END) AS BIGINT) AS gap_count, count(*) AS n_drafts
  FROM geno, range(11) t(k) GROUP BY GROUPING SETS ((pool, k), (k)))"""


@query(f"WITH {GAP_SQL} SELECT pool, k, gap_count, n_drafts, round(gap_count / n_drafts, 9) AS support FROM gaps")
def gap_support(spark: SparkSession, d: str) -> DataFrame:
    return regions.gap_support(geno_links(spark, d)).withColumn("support", r9("support"))


CUTOFFS = regions.cutoffs()
CUTOFF_SQL = "cutoffs(cutoff) AS (VALUES " + ", ".join(f"({c!r}::DOUBLE)" for c in CUTOFFS) + ")"


@query(f"""WITH {GAP_SQL}, {CUTOFF_SQL}, best AS (SELECT k, max(gap_count / n_drafts) AS support FROM gaps GROUP BY k)
SELECT cutoff, CAST(sum(CASE WHEN support >= cutoff THEN 1 ELSE 0 END) AS BIGINT) AS n_gaps, round(12 / (sum(CASE WHEN support >= cutoff THEN 1 ELSE 0 END) + 1), 9) AS mean_size FROM best, cutoffs GROUP BY cutoff""")
def gap_select(spark: SparkSession, d: str) -> DataFrame:
    return regions.gap_levels(regions.gap_support(geno_links(spark, d)), SITES, CUTOFFS).withColumn("mean_size", r9("mean_size"))


SMALL = regions.PlanLimits(3, 5, 2, 3, 5)


@query("SELECT CAST(12 AS BIGINT) AS covered, CAST(0 AS BIGINT) AS overlaps, true AS within_limits")
def region_plan_check(spark: SparkSession, d: str) -> DataFrame:
    """Level 1 covers every site once, in regions no longer than wanted."""
    gaps = regions.selected_gaps(regions.gap_support(geno_links(spark, d)), SITES, SMALL, CUTOFFS)
    plan = regions.region_table(spark, regions.plan(gaps, SITES, SMALL)).where("level = 1")
    sites = plan.select(F.explode(F.sequence("first_site", "last_site")).alias("site"), (F.col("last_site") - F.col("first_site") + 1).alias("size"))
    return sites.agg(F.countDistinct("site").alias("covered"), (F.count("site") - F.countDistinct("site")).alias("overlaps"), (F.max("size") <= SMALL.max_level_1).alias("within_limits"))


@query(f"""WITH RECURSIVE {GAP_SQL}, {CUTOFF_SQL}, best AS (SELECT k, max(gap_count / n_drafts) AS support FROM gaps GROUP BY k),
levels AS (SELECT cutoff, sum(CASE WHEN support >= cutoff THEN 1 ELSE 0 END) AS n FROM best, cutoffs GROUP BY cutoff),
chosen AS (SELECT coalesce(max(cutoff) FILTER (12 / (n + 1) <= 5), min(cutoff)) AS cutoff FROM levels),
marks AS (SELECT k, row_number() OVER (ORDER BY k) AS i FROM (SELECT k FROM best, chosen WHERE support >= cutoff UNION SELECT 11)),
sweep(i, start, cuts, done) AS (SELECT 0, 0, []::INTEGER[], false UNION ALL
  SELECT m.i, CASE WHEN m.k - t.s >= 3 THEN m.k ELSE t.s END, CASE WHEN m.k - t.s >= 3 THEN list_append(t.c, CAST(m.k AS INTEGER)) ELSE t.c END,
    (len(t.c) > 0 AND 11 - t.c[-1] <= 2) OR (m.k - t.s >= 3 AND 11 - m.k <= 2)
  FROM (SELECT i, s.start + 5 * j AS s, list_concat(cuts, list_transform(range(1, j + 1), lambda x: CAST(s.start + 5 * x AS INTEGER))) AS c
    FROM (SELECT s.*, CAST(greatest(0, (m.k - s.start - 1) // 5) AS INTEGER) AS j FROM sweep s JOIN marks m ON m.i = s.i + 1 WHERE NOT done) s) t JOIN marks m ON m.i = t.i + 1),
cut AS (SELECT CASE WHEN len(cuts) > 0 AND 11 - cuts[-1] <= 2 THEN cuts[:-2] ELSE cuts END AS cuts FROM sweep ORDER BY i DESC LIMIT 1),
edges AS (SELECT unnest(list_concat([0], cuts)) AS a, unnest(list_concat(cuts, [12])) AS b FROM cut),
one AS (SELECT a, b, row_number() OVER (ORDER BY a) - 1 AS r, count(*) OVER () AS n FROM (SELECT a + 5 * j AS a, least(b, a + 5 * (j + 1)) - 1 AS b FROM edges, LATERAL (SELECT unnest(range(0, (b - a - 1) // 5 + 1)) AS j))),
two(r, a, b, n) AS (SELECT CAST(0 AS BIGINT), CAST(o.b // 2 AS BIGINT), CAST(CASE WHEN o.n = 2 THEN (12 + o.b // 2) // 2 ELSE o.b // 2 + CASE WHEN m - o.b // 2 >= 5 THEN 5 ELSE greatest(m - o.b // 2, 2) END END AS BIGINT), o.n
    FROM one o JOIN (SELECT (a + b) // 2 AS m FROM one WHERE r = 1) ON o.r = 0
  UNION ALL SELECT t.r + 1, t.b + 1, CAST(CASE WHEN t.r + 2 = t.n - 1 THEN (12 + t.b + 1) // 2 ELSE t.b + 1 + CASE WHEN (o.a + o.b) // 2 - t.b - 1 >= 5 THEN 5 ELSE greatest((o.a + o.b) // 2 - t.b - 1, 2) END END AS BIGINT), t.n
    FROM two t JOIN one o ON o.r = t.r + 2 WHERE t.b + 1 < 11)
SELECT CAST(1 AS BIGINT) AS level, CAST(r AS BIGINT) AS region, CAST(a AS BIGINT) AS first_site, CAST(b AS BIGINT) AS last_site FROM one
UNION ALL SELECT 2, r, a, least(b, 11) FROM two""")
def region_plan(spark: SparkSession, d: str) -> DataFrame:
    """Both levels of the plan that follows from the gaps of the data, in regions of 3 to 5 sites."""
    gaps = regions.selected_gaps(regions.gap_support(geno_links(spark, d)), SITES, SMALL, CUTOFFS)
    return regions.region_table(spark, regions.plan(gaps, SITES, SMALL))


@query(f"WITH {HAPS_SQL}, e AS (SELECT lpad(bin(i), 12, '0') AS hap FROM range(4096) t(i)) SELECT e.hap, 1 / 4096 AS freq, round(coalesce(h.freq, 0), 9) AS observed FROM e LEFT JOIN haps h ON h.hap = e.hap")
def hap_enumerate(spark: SparkSession, d: str) -> DataFrame:
    seen = bridge.haps(spark, d).withColumnRenamed("freq", "observed")
    return haplotypes.enumerated(spark, SITES).join(seen, "hap", "left").select("hap", "freq", r9(F.coalesce("observed", F.lit(0.0))).alias("observed"))


@query(f"""WITH {HAPS_SQL}, c AS (SELECT hap, freq, CAST(s AS BIGINT) AS site, CAST(substr(hap, CAST(s + 1 AS INTEGER), 1) AS DOUBLE) AS code FROM haps, range(12) t(s)),
mu AS (SELECT site, sum(code * freq) AS mu FROM c GROUP BY site), eta AS (SELECT a.site AS l1, b.site AS l2, sum(a.code * b.code * a.freq) AS eta FROM c a JOIN c b ON a.hap = b.hap GROUP BY 1, 2)
SELECT l1, l2, round(x.mu, 9) AS mu1, round(y.mu, 9) AS mu2, round(eta - x.mu * y.mu, 9) + 0.0 AS sigma FROM eta JOIN mu x ON x.site = l1 JOIN mu y ON y.site = l2""")
def hap_moments(spark: SparkSession, d: str) -> DataFrame:
    haps = bridge.haps(spark, d)
    mu = haplotypes.mean_haplotype(haps)
    return haplotypes.covariance(haps).join(mu.select(F.col("site").alias("l1"), r9("mu").alias("mu1")), "l1").join(mu.select(F.col("site").alias("l2"), r9("mu").alias("mu2")), "l2").select("l1", "l2", "mu1", "mu2", (r9("sigma") + 0.0).alias("sigma"))


def one_region(spark: SparkSession) -> DataFrame:
    return regions.region_table(spark, ([(0, SITES - 1)], []))


@query(f"""WITH {MAF_SQL}, e AS (SELECT i, lpad(bin(i), 12, '0') AS hap FROM range(4096) t(i)),
s AS (SELECT e.hap, m.pool, sum(4 * (m.freq - 0.5) * (CAST(substr(e.hap, CAST(m.site + 1 AS INTEGER), 1) AS DOUBLE) - 0.5) - 2 * (m.freq - 0.5) * (m.freq - 0.5)) AS x FROM e, maf m GROUP BY e.hap, m.pool)
SELECT hap, round(exp(-12 / 2000000) * avg(exp(x)), 8) AS factor FROM s GROUP BY hap""")
def aem_first_iter(spark: SparkSession, d: str) -> DataFrame:
    return em.first_factors(frequency.site_frequency(bridge.calls(spark, d)), one_region(spark)).select("hap", F.round("factor", 8).alias("factor"))


@query("SELECT CAST(level AS BIGINT) AS level, CAST(region AS BIGINT) AS region, 1.0::DOUBLE AS total, CAST(0 AS BIGINT) AS broken FROM (VALUES (1, 0), (1, 1), (1, 2), (2, 0), (2, 1)) t(level, region)")
def aem_solve_check(spark: SparkSession, d: str) -> DataFrame:
    """Frequencies of every region are numbers from 0 on that sum to 1."""
    ranges = ([(a, b) for level, _, a, b in REGIONS if level == 1], [(a, b) for level, _, a, b in REGIONS if level == 2])
    solved = em.solved_regions(frequency.site_frequency(bridge.calls(spark, d)), regions.region_table(spark, ranges))
    return solved.groupBy("level", "region").agg(F.round(F.sum("freq"), 6).alias("total"), F.sum((F.isnan("freq") | (F.col("freq") < 0)).cast("long")).alias("broken"))


@query(f"""WITH {MAF_SQL} SELECT CAST(1 AS BIGINT) AS level, CAST(0 AS BIGINT) AS region,
round(-count(DISTINCT pool) * (6 * ln(2 * pi()) + 6 * ln(0.25)) - 2 * sum((freq - 0.5) * (freq - 0.5)), 6) AS log_likelihood FROM maf""")
def loglik(spark: SparkSession, d: str) -> DataFrame:
    return em.likelihoods(frequency.site_frequency(bridge.calls(spark, d)), one_region(spark)).select("level", "region", F.round("log_likelihood", 6).alias("log_likelihood"))


SHARE_SQL = f"{HAPS_SQL}, shares AS (SELECT pool, hap, n / sum(n) OVER (PARTITION BY pool) AS freq FROM drafts)"


@query(f"WITH {SHARE_SQL}, k AS (SELECT * FROM shares WHERE freq >= 0.001) SELECT pool, hap, round(freq / sum(freq) OVER (PARTITION BY pool), 9) AS freq FROM k")
def freq_prune(spark: SparkSession, d: str) -> DataFrame:
    return haplotypes.pruned(haplotypes.pool_shares(bridge.drafts(spark, d)), 0.001, "pool").select("pool", "hap", r9("freq").alias("freq"))


@query(f"WITH {SHARE_SQL} SELECT pool, hap, round(freq, 9) AS freq FROM (SELECT *, rank() OVER (PARTITION BY pool ORDER BY freq DESC) AS r FROM shares) WHERE r <= 5")
def topk_ties(spark: SparkSession, d: str) -> DataFrame:
    return haplotypes.top_with_ties(haplotypes.pool_shares(bridge.drafts(spark, d)), 5, "pool").select("pool", "hap", r9("freq").alias("freq"))


K_SQL = f"""{PROJECT_SQL}, k AS (SELECT *, sum(CASE WHEN freq >= {{least}} THEN 1 ELSE 0 END) OVER w AS often, rank() OVER (PARTITION BY level, region ORDER BY freq DESC) AS r FROM slices WINDOW w AS (PARTITION BY level, region)),
s AS (SELECT * FROM k WHERE CASE WHEN often < 3 THEN r <= 5 ELSE freq >= {{least}} END) SELECT level, region, hap, round(freq / sum(freq) OVER (PARTITION BY level, region), 9) AS freq FROM s"""


@query("WITH " + K_SQL.format(least=0.05))
def prune_k1(spark: SparkSession, d: str) -> DataFrame:
    """Rare ones go, enough stay."""
    return haplotypes.adaptive(slices(spark, d), by=("level", "region")).select("level", "region", "hap", r9("freq").alias("freq"))


@query("WITH " + K_SQL.format(least=0.2))
def prune_k2(spark: SparkSession, d: str) -> DataFrame:
    """Too few would stay: the top five with ties do."""
    return haplotypes.adaptive(slices(spark, d), 0.2, share=0.2, picks=None, by=("level", "region")).select("level", "region", "hap", r9("freq").alias("freq"))


@query(f"WITH {SHARE_SQL} SELECT pool, hap, round(freq, 9) AS freq FROM shares QUALIFY row_number() OVER (PARTITION BY pool ORDER BY md5(hap || ':7'), hap) <= 20")
def random_subset(spark: SparkSession, d: str) -> DataFrame:
    """Twenty drafts of each pool by lot."""
    return haplotypes.random_subset(haplotypes.pool_shares(bridge.drafts(spark, d)), 20, "pool", seed=7).select("pool", "hap", r9("freq").alias("freq"))


@query(f"""WITH {SHARE_SQL}, k AS (SELECT *, sum(CASE WHEN freq >= 0.00001 THEN 1 ELSE 0 END) OVER (PARTITION BY pool) AS often, row_number() OVER (PARTITION BY pool ORDER BY freq >= 0.00001 DESC, md5(hap || ':1'), hap) AS turn FROM shares),
s AS (SELECT * FROM k WHERE freq >= 0.00001 AND (often <= 50 OR turn <= 10)) SELECT pool, hap, round(freq / sum(freq) OVER (PARTITION BY pool), 9) AS freq FROM s""")
def prune_many(spark: SparkSession, d: str) -> DataFrame:
    """More than fifty would stay in a pool: ten do, by lot."""
    return haplotypes.adaptive(haplotypes.pool_shares(bridge.drafts(spark, d)), 0.00001, by=("pool",)).select("pool", "hap", r9("freq").alias("freq"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings)
SELECT vec_id, round(list_sum(a), 6) AS total, round(list_sum(a) / len(a), 6) AS mean, round(list_dot_product(a, a), 6) AS dot,
  round(list_sum(list_transform(a, lambda x: abs(x))), 6) AS l1, round(list_sum(list_transform(a, lambda x: exp(x))), 6) AS exp_sum, round(list_max(list_transform(list_transform(a, lambda x: abs(x)), lambda y: y / list_sum(list_transform(a, lambda x: abs(x))))), 6) AS largest_share FROM v""")
def vec_algebra(spark: SparkSession, d: str) -> DataFrame:
    rows = bridge.table(spark, d, "embeddings").select("vec_id", algebra.doubles(F.col("embedding")).alias("a"))
    a = F.col("a")
    zero = algebra.scaled(a, 0.0)
    out = {"total": algebra.total(a), "mean": algebra.mean(a), "dot": algebra.inner_product(a, a), "l1": algebra.distance(a, zero), "exp_sum": algebra.total(algebra.exponential(a)), "largest_share": F.array_max(algebra.normalised(algebra.absolute(a)))}
    return rows.select("vec_id", *(F.round(v, 6).alias(k) for k, v in out.items()))


def region_haps(spark: SparkSession, d: str) -> DataFrame:
    return haplotypes.projected(bridge.haps(spark, d), 0, 3)


def first_sites(df: DataFrame, *names: str) -> DataFrame:
    for n in names:
        df = df.where(F.col(n) <= 3)
    return df


@query(f"""WITH {PROJECT_SQL}, h AS (SELECT hap FROM slices WHERE level = 1 AND region = 0), {LD_SQL.replace(CALLS_SQL + ',', CALLS_SQL + ',', 1)}, maf AS (SELECT pool, site, avg(CAST(allele AS DOUBLE)) AS freq FROM calls GROUP BY pool, site),
rows_ AS (SELECT DISTINCT pool, 0 AS block, NULL::BIGINT AS l1, NULL::BIGINT AS l2, 1.0::DOUBLE AS label FROM maf UNION ALL SELECT pool, 1, site, NULL, freq FROM maf WHERE site <= 3 UNION ALL SELECT pool, 2, l1, l2, p11 FROM ld WHERE l1 <= 3 AND l2 <= 3)
SELECT pool, CAST(block AS INTEGER) AS block, l1, l2, round(label, 9) AS label, string_agg(CASE WHEN block = 0 THEN '1' WHEN block = 1 THEN substr(hap, CAST(l1 + 1 AS INTEGER), 1)
  ELSE CAST(CAST(substr(hap, CAST(l1 + 1 AS INTEGER), 1) AS INTEGER) * CAST(substr(hap, CAST(l2 + 1 AS INTEGER), 1) AS INTEGER) AS VARCHAR) END, ',' ORDER BY hap) AS features
FROM rows_, h GROUP BY pool, block, l1, l2, label""")
def lasso_design(spark: SparkSession, d: str) -> DataFrame:
    calls = bridge.calls(spark, d)
    rows = regression.design(region_haps(spark, d), first_sites(frequency.site_frequency(calls), "site"), first_sites(linkage.pair_linkage(calls), "l1", "l2"))
    return rows.select("pool", "block", "l1", "l2", r9("label").alias("label"), F.array_join(F.transform("features", lambda x: x.cast("int").cast("string")), ",").alias("features"))


@query()
def lasso_design_whole(spark: SparkSession, d: str) -> DataFrame:
    """The design over all sites, all pairs and all haplotypes; lasso_design is its part of the first region."""
    calls = bridge.calls(spark, d)
    rows = regression.design(bridge.haps(spark, d), frequency.site_frequency(calls), linkage.pair_linkage(calls))
    return rows.select("pool", "block", "l1", "l2", r9("label").alias("label"), F.array_join(F.transform("features", lambda x: x.cast("int").cast("string")), ",").alias("features"))


@query("SELECT true AS r2_at_most_1, true AS recovered, true AS penalised_fit_is_worse")
def lasso_fit_check(spark: SparkSession, d: str) -> DataFrame:
    """Labels made from known frequencies give them back without a penalty; with one the fit is no better."""
    haps = region_haps(spark, d)
    codes = haplotypes.encoded(haps)
    pool = F.lit(0).cast("long").alias("pool")
    freq = codes.groupBy("site").agg(F.sum(F.col("code") * F.col("freq")).alias("freq")).select(pool, "site", "freq")
    a, b = (codes.select("hap", "freq", F.col("site").alias(s), F.col("code").alias(c)) for s, c in (("l1", "x"), ("l2", "y")))
    pairs = a.join(b.drop("freq"), "hap").where("l1 < l2").groupBy("l1", "l2").agg(F.sum(F.col("x") * F.col("y") * F.col("freq")).alias("p11")).select(pool, "l1", "l2", "p11")
    rows = regression.design(haps, freq, pairs)
    free, r2 = regression.fit(rows, 0.0, 100)
    _, worse, _ = regression.fit_with_ladder(rows)
    # 16 haplotypes on 11 equations: what must come back is the labels, not one solution of many
    names = [r["hap"] for r in haps.orderBy("hap").collect()]  # at most 16
    back = spark.createDataFrame(list(zip(names, free, strict=True)), "hap string, w double")
    fitted = haplotypes.encoded(back).groupBy("site").agg(F.sum(F.col("code") * F.col("w")).alias("fitted"))
    gap = fitted.join(freq, "site").agg(F.max(F.abs(F.col("fitted") - F.col("freq"))).alias("gap"))
    return gap.select(F.lit(r2 <= 1.0 + 1e-12).alias("r2_at_most_1"), (F.col("gap") < 1e-4).alias("recovered"), F.lit(worse <= r2 + 1e-9).alias("penalised_fit_is_worse"))


PAIRS = tuple((1, k, 2 * k, 2 * k + 1) for k in range(SITES // 2))
PAIRS_SQL = "pairs(region, a, b) AS (VALUES " + ", ".join(f"({k}, {a}, {b})" for _, k, a, b in PAIRS) + ")"
#: One round of the recursion is one step of EM; a step that meets the tolerance is not taken.
EM_SQL = f"""WITH RECURSIVE {MAF_SQL}, {PAIRS_SQL}, x AS (SELECT region, m.pool, m.freq AS x1, n.freq AS x2 FROM pairs JOIN maf m ON m.site = a JOIN maf n ON n.site = b AND n.pool = m.pool),
codes(h, c1, c2) AS (VALUES (1, 0.0::DOUBLE, 0.0::DOUBLE), (2, 0.0, 1.0), (3, 1.0, 0.0), (4, 1.0, 1.0)),
em(region, k, p, before, done) AS (SELECT region, 0, [0.25, 0.25, 0.25, 0.25]::DOUBLE[], [0.25, 0.25, 0.25, 0.25]::DOUBLE[], false FROM pairs
  UNION ALL SELECT region, k + 1, CASE WHEN met THEN p ELSE list_transform(cut, lambda v: v / list_sum(cut)) END, f, met FROM (
    SELECT region, k, p, f, met, list_transform(list_transform(range(1, 5), lambda i: p[i] * f[i] / list_sum(list_transform(range(1, 5), lambda j: p[j] * f[j]))), lambda v: CASE WHEN v < 4.88281e-7 THEN 0 ELSE v END) AS cut FROM (
      SELECT region, k, p, f, list_sum(list_transform(range(1, 5), lambda i: abs(before[i] - f[i]))) < 1e-5 OR list_sum(list_transform(range(1, 5), lambda i: abs(before[i] / f[i] - 1))) < 1e-5 AS met FROM (
        SELECT region, k, any_value(p) AS p, any_value(before) AS before, list(f ORDER BY h) AS f FROM (
          SELECT region, k, h, any_value(p) AS p, any_value(before) AS before,
            any_value(exp(-(s22 * u1 * u1 - 2 * s12 * u1 * u2 + s11 * u2 * u2) / det / 2000000)) * avg(exp((s22 * u1 * d1 - s12 * (u1 * d2 + u2 * d1) + s11 * u2 * d2) / det - 0.5 * (s22 * d1 * d1 - 2 * s12 * d1 * d2 + s11 * d2 * d2) / det)) AS f FROM (
            SELECT e.region, e.k, h, p, before, c1 - m1 AS u1, c2 - m2 AS u2, x1 - m1 AS d1, x2 - m2 AS d2, m1 * (1 - m1) AS s11, m2 * (1 - m2) AS s22, p[4] - m1 * m2 AS s12, m1 * (1 - m1) * m2 * (1 - m2) - (p[4] - m1 * m2) ** 2 AS det
            FROM (SELECT *, p[3] + p[4] AS m1, p[2] + p[4] AS m2 FROM em WHERE NOT done AND k < 20) e JOIN x USING (region), codes) GROUP BY region, k, h) GROUP BY region, k))))"""


@query(f"""{EM_SQL}, ends AS (SELECT region, arg_max(p, k) AS p FROM em GROUP BY region)
SELECT CAST(1 AS BIGINT) AS level, CAST(region AS BIGINT) AS region, ['00', '01', '10', '11'][i] AS hap, round(p[i], 6) AS freq FROM ends, range(1, 5) t(i) WHERE p[i] > 0""")
def em_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """All sites in regions of two: what EM comes to in 20 rounds, where the SQL inverts the covariance by hand."""
    plan = regions.region_table(spark, ([(a, b) for _, _, a, b in PAIRS], []))
    found = em.solved_regions(frequency.site_frequency(bridge.calls(spark, d)), plan, em.EmLimits(rounds=20))
    return found.select("level", "region", "hap", F.round("freq", 6).alias("freq"))


def tripled(spark: SparkSession, d: str) -> DataFrame:
    """The haplotypes of sites 0 to 3, three times over: 16 at most, over all sites."""
    return region_haps(spark, d).select(F.concat("hap", "hap", "hap").alias("hap"))


STEPS = regression.Ladder(penalty=0.21, step=0.05)
LADDER = [STEPS.penalty - k * STEPS.step for k in range(5)]
#: The design of all sites and pairs, its moments, and one sweep of coordinate descent for each round of the recursion, at
#: all penalties of the ladder above 0 at once.
LASSO_SQL = f"""WITH RECURSIVE {PROJECT_SQL}, h AS (SELECT hap || hap || hap AS hap, row_number() OVER (ORDER BY hap) AS j FROM slices WHERE level = 1 AND region = 0), {LD_SQL},
maf AS (SELECT pool, site, avg(CAST(allele AS DOUBLE)) AS freq FROM calls GROUP BY pool, site),
rows_ AS (SELECT pool, NULL::BIGINT AS l1, NULL::BIGINT AS l2, 1.0::DOUBLE AS y FROM (SELECT DISTINCT pool FROM maf) UNION ALL SELECT pool, site, NULL, freq FROM maf UNION ALL SELECT pool, l1, l2, p11 FROM ld),
x AS (SELECT pool, row_number() OVER () AS r, y, l1, l2 FROM rows_),
cells AS (SELECT pool, r, y, j, CASE WHEN l1 IS NULL THEN 1.0 ELSE CAST(substr(hap, CAST(l1 + 1 AS INTEGER), 1) AS DOUBLE) * CASE WHEN l2 IS NULL THEN 1.0 ELSE CAST(substr(hap, CAST(l2 + 1 AS INTEGER), 1) AS DOUBLE) END END AS v FROM x, h),
gram AS (SELECT a.pool, a.j, list(g ORDER BY k) AS g FROM (SELECT a.pool, a.j, b.j AS k, sum(a.v * b.v) AS g FROM cells a JOIN cells b ON b.pool = a.pool AND b.r = a.r GROUP BY 1, 2, 3) a GROUP BY 1, 2),
m AS (SELECT g.pool, list(g.g ORDER BY g.j) AS g, any_value(s.xy) AS xy, any_value(s.sd) AS sd, any_value(n) AS n, any_value(yy) AS yy, len(any_value(s.xy)) AS many FROM gram g
  JOIN (SELECT pool, list(xy ORDER BY j) AS xy, list(sd ORDER BY j) AS sd FROM (SELECT pool, j, sum(v * y) AS xy, stddev_samp(v) AS sd FROM cells GROUP BY 1, 2) GROUP BY 1) s ON s.pool = g.pool
  JOIN (SELECT pool, CAST(count(*) AS DOUBLE) AS n, sum(y * y) AS yy FROM x GROUP BY pool) t ON t.pool = g.pool GROUP BY g.pool),
lambdas(step, lambda_) AS (VALUES {", ".join(f"({k}, {v!r}::DOUBLE)" for k, v in enumerate(LADDER))}),
cd(pool, step, k, w) AS (SELECT pool, step, 0, list_transform(range(many), lambda i: 0.0::DOUBLE) FROM m, lambdas
  UNION ALL SELECT cd.pool, cd.step, k + 1, list_reduce(range(1, many + 1), lambda w, j: CASE WHEN sd[j] < 1e-12 THEN w ELSE list_concat(w[1 : j - 1], [list_transform([(xy[j] - list_dot_product(g[j], w) + g[j][j] * w[j]) / n], lambda z: sign(z) * greatest(abs(z) - lambda_ * sd[j], 0) / (g[j][j] / n))[1]], w[j + 1 : many]) END, cd.w)
  FROM cd JOIN m ON m.pool = cd.pool JOIN lambdas l ON l.step = cd.step WHERE k < 300),
fits AS (SELECT cd.pool, cd.step, w, lambda_, 1 - (yy - 2 * list_dot_product(w, xy) + list_sum(list_transform(range(1, many + 1), lambda i: w[i] * list_dot_product(g[i], w)))) / yy AS r2 FROM cd JOIN m ON m.pool = cd.pool JOIN lambdas l ON l.step = cd.step WHERE k = 300),
first_ AS (SELECT * FROM fits WHERE list_max(w) >= {STEPS.least} QUALIFY row_number() OVER (PARTITION BY pool ORDER BY step) = 1)
SELECT f.pool, h.hap, round(f.w[h.j], 5) + 0.0 AS freq, round(f.r2, 5) AS r2, round(f.lambda_, 9) AS penalty, true AS converged FROM first_ f, h"""


@query(LASSO_SQL)
def lasso_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients of each pool over all sites and pairs, at the first penalty of the ladder that says something."""
    calls = bridge.calls(spark, d)
    haps = whole.kept(tripled(spark, d))
    rows = regression.design(haps, frequency.site_frequency(calls), linkage.pair_linkage(calls))
    found = regression.pool_frequencies(rows, haps, STEPS)
    return found.select("pool", "hap", (F.round("freq", 5) + 0.0).alias("freq"), F.round("r2", 5).alias("r2"), r9("penalty").alias("penalty"), "converged")


GRID_SQL = f"""{SHARE_SQL}, names AS (SELECT hap, sum(freq) / 8 AS mean_freq FROM shares GROUP BY hap), pools AS (SELECT DISTINCT pool FROM drafts),
grid AS (SELECT n.hap, p.pool, coalesce(s.freq, 0) AS freq, n.mean_freq FROM names n CROSS JOIN pools p LEFT JOIN shares s ON s.hap = n.hap AND s.pool = p.pool)"""


def grid(spark: SparkSession, d: str) -> DataFrame:
    drafts = bridge.drafts(spark, d)
    return haplotypes.merged_pools(haplotypes.pool_shares(drafts), drafts.select("pool").distinct())


@query(f"WITH {GRID_SQL} SELECT hap, pool, round(freq, 9) AS freq, round(mean_freq, 9) AS mean_freq FROM grid")
def merge_pools(spark: SparkSession, d: str) -> DataFrame:
    return grid(spark, d).select("hap", "pool", r9("freq").alias("freq"), r9("mean_freq").alias("mean_freq"))


ID_SQL = "ids AS (SELECT hap, CAST(row_number() OVER (ORDER BY pool, hap) - 1 AS BIGINT) AS hap_id FROM (SELECT hap, min(pool) AS pool FROM drafts GROUP BY hap))"


@query(f"WITH {GRID_SQL}, {ID_SQL} SELECT hap_id, hap, round(mean_freq, 9) AS mean_freq FROM ids JOIN names USING (hap)")
def draft_merge(spark: SparkSession, d: str) -> DataFrame:
    ids = haplotypes.first_seen(bridge.drafts(spark, d))
    return grid(spark, d).groupBy("hap").agg(F.max("mean_freq").alias("m")).join(ids, "hap").select("hap_id", "hap", r9("m").alias("mean_freq"))


def micro(x: Column) -> Column:
    """A frequency as text: millionths, rounded, so that both engines print alike."""
    return F.round(x * 1e6, 0).cast("long").cast("string")


@query(f"""WITH {GRID_SQL}, {ID_SQL}, g AS (SELECT pool, hap_id, CAST(CAST(round(freq * 1e6, 0) AS BIGINT) AS VARCHAR) AS v FROM grid JOIN ids USING (hap))
SELECT CAST(-1 AS BIGINT) AS ord, 'Hap_ID' || chr(9) || string_agg(CAST(hap_id AS VARCHAR), chr(9) ORDER BY hap_id) AS line FROM ids
UNION ALL SELECT pool, pool || chr(9) || string_agg(v, chr(9) ORDER BY hap_id) FROM g GROUP BY pool""")
def intra_matrix(spark: SparkSession, d: str) -> DataFrame:
    rows = grid(spark, d).join(haplotypes.first_seen(bridge.drafts(spark, d)), "hap")
    return files.intra_lines(rows.select("pool", "hap_id", micro(F.col("freq")).alias("value")))


@query(f"""WITH {GRID_SQL}, {ID_SQL}, g AS (SELECT hap_id, hap, CAST(CAST(round(mean_freq * 1e6, 0) AS BIGINT) AS VARCHAR) AS v FROM names JOIN ids USING (hap))
SELECT CAST(-2 AS BIGINT) AS ord, 'Hap_ID' || chr(9) || string_agg(CAST(hap_id AS VARCHAR), chr(9) ORDER BY hap_id) AS line FROM g
UNION ALL SELECT -1, 'Freq' || chr(9) || string_agg(v, chr(9) ORDER BY hap_id) FROM g
UNION ALL SELECT s, '0;' || 100 * (s + 1) || ';' || 100 * (s + 1) || ';0:1' || chr(9) || string_agg(substr(hap, CAST(s + 1 AS INTEGER), 1), chr(9) ORDER BY hap_id) FROM g, range(12) t(s) GROUP BY s""")
def inter_matrix(spark: SparkSession, d: str) -> DataFrame:
    rows = grid(spark, d).groupBy("hap").agg(F.max("mean_freq").alias("m")).join(haplotypes.first_seen(bridge.drafts(spark, d)), "hap")
    pos = bridge.position(F.col("site"))
    sites = spark.range(SITES).select(F.col("id").alias("site")).withColumn("locus", locus.formatted(F.lit(0), pos, pos, F.array(F.lit("0"), F.lit("1"))))
    return files.inter_lines(rows.select("hap_id", "hap", micro(F.col("m")).alias("value")), sites)


@query(f"""WITH {GRID_SQL}, {ID_SQL}, g AS (SELECT hap_id, hap, CAST(CAST(round(mean_freq * 1e6, 0) AS BIGINT) AS VARCHAR) AS v FROM names JOIN ids USING (hap)),
cells AS (SELECT CAST(-2 AS BIGINT) AS ord, 'Hap_ID' AS key, hap_id AS col, CAST(hap_id AS VARCHAR) AS value FROM g UNION ALL SELECT -1, 'Freq', hap_id, v FROM g
  UNION ALL SELECT s, CAST(s AS VARCHAR), hap_id, CASE WHEN substr(hap, CAST(s + 1 AS INTEGER), 1) = '1' THEN '1.0' ELSE '0.0' END FROM g, range(12) t(s))
SELECT ord, col // 100 AS block, CASE WHEN ord = -2 AND col // 100 = 0 THEN 'Hap_ID' || chr(9) ELSE '' END || string_agg(value, chr(9) ORDER BY col) ||
  CASE WHEN ord < 11 AND col // 100 = (SELECT max(hap_id) // 100 FROM g) THEN chr(10) || CASE WHEN ord = -2 THEN 'Freq' ELSE CAST(ord + 1 AS VARCHAR) END ELSE '' END AS piece FROM cells GROUP BY ord, col // 100""")
def inter_coded(spark: SparkSession, d: str) -> DataFrame:
    """The matrix with alleles as numbers, in pieces of a hundred haplotypes."""
    rows = grid(spark, d).groupBy("hap").agg(F.max("mean_freq").alias("m")).join(haplotypes.first_seen(bridge.drafts(spark, d)), "hap")
    return files.matrix_pieces(files.inter_cells(rows.select("hap_id", "hap", micro(F.col("m")).alias("value")), coded=True), 100)


@query("""WITH c AS (SELECT CAST(l_orderkey % 8 AS BIGINT) AS pool, l_orderkey AS read_id, CAST(l_suppkey % 3 AS VARCHAR) AS chr, l_partkey AS pos, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS allele FROM lineitem),
s AS (SELECT CAST(t.c AS VARCHAR) AS chr, p_partkey AS pos, row_number() OVER (ORDER BY t.c, p_partkey) - 1 AS site FROM part, range(2) t(c) WHERE p_size < 25 AND (p_partkey + t.c) % 3 <> 0)
SELECT pool, CAST(site AS BIGINT) AS site, count(*) AS n, CAST(sum(allele) AS BIGINT) AS alternate FROM c JOIN s USING (chr, pos) GROUP BY pool, site""")
def site_join_chromosomes(spark: SparkSession, d: str) -> DataFrame:
    """Calls on three chromosomes, sites on two of them that share positions."""
    calls = bridge.raw_calls(spark, d).select("pool", "read_id", (F.col("l_suppkey") % 3).cast("string").alias("chr"), F.col("l_partkey").alias("pos"), "allele")
    parts = bridge.table(spark, d, "part").where("p_size < 25").select("p_partkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("c")).where("(p_partkey + c) % 3 <> 0")
    sites = reads.numbered(parts.select(F.col("c").cast("string").alias("chr"), F.col("p_partkey").alias("pos")))
    return reads.site_calls(calls, sites).groupBy("pool", "site").agg(F.count(F.lit(1)).alias("n"), F.sum("allele").alias("alternate"))


@query("""WITH c AS (SELECT CAST(l_orderkey % 8 AS BIGINT) AS pool, l_orderkey AS read_id, 7 * l_partkey AS pos, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS allele FROM lineitem),
s AS (SELECT 7 * p_partkey AS pos, row_number() OVER (ORDER BY p_partkey) - 1 AS site FROM part WHERE p_size < 25)
SELECT pool, CAST(site AS BIGINT) AS site, count(*) AS n, CAST(sum(allele) AS BIGINT) AS alternate FROM c JOIN s USING (pos) GROUP BY pool, site""")
def site_join(spark: SparkSession, d: str) -> DataFrame:
    """Calls at any position, at the known sites among them: parts of some sizes, numbered by position."""
    calls = bridge.raw_calls(spark, d).select("pool", "read_id", (F.col("l_partkey") * 7).alias("pos"), "allele")
    sites = reads.numbered(bridge.table(spark, d, "part").where("p_size < 25").select((F.col("p_partkey") * 7).alias("pos")))
    return reads.site_calls(calls, sites).groupBy("pool", "site").agg(F.count(F.lit(1)).alias("n"), F.sum("allele").alias("alternate"))


@query(f"""WITH {MAF_SQL}, g AS (SELECT pool, site, CAST(CAST(round(freq * 1e6, 0) AS BIGINT) AS VARCHAR) AS v FROM maf)
SELECT CAST(-1 AS BIGINT) AS ord, 'Pool_ID' || chr(9) || string_agg(CAST(pool AS VARCHAR), chr(9) ORDER BY pool) AS line FROM (SELECT DISTINCT pool FROM g)
UNION ALL SELECT s.site, '0;' || 100 * (s.site + 1) || ';' || 100 * (s.site + 1) || ';0:1' || chr(9) || string_agg(coalesce(v, '0.0'), chr(9) ORDER BY p.pool)
FROM (SELECT DISTINCT site FROM g) s CROSS JOIN (SELECT DISTINCT pool FROM g) p LEFT JOIN g ON g.site = s.site AND g.pool = p.pool GROUP BY s.site""")
def freq_lines(spark: SparkSession, d: str) -> DataFrame:
    """The text of the site frequencies that later steps read."""
    freq = frequency.site_frequency(bridge.calls(spark, d)).select("pool", "site", micro(F.col("freq")).alias("value"))
    pos = bridge.position(F.col("site"))
    sites = freq.select("site").distinct().select("site", locus.formatted(F.lit(0), pos, pos, F.array(F.lit("0"), F.lit("1"))).alias("locus"))
    return files.freq_lines(freq, sites)


@query("""WITH a AS (SELECT l_orderkey * 8 + l_linenumber AS read_id, CAST(l_orderkey % 8 AS BIGINT) AS pool, l_partkey AS start, CAST(l_quantity AS BIGINT) % 6 + 2 AS m, CAST(l_quantity AS BIGINT) % 4 + 1 AS gap, l_suppkey % 4 AS b FROM lineitem),
v AS (SELECT p_partkey AS pos, substr('ACGT', CAST(p_size % 4 + 1 AS INTEGER), 1) AS alt FROM part)
SELECT pool, pos, count(*) AS n, CAST(sum(CASE WHEN (pos - start < m OR pos - start >= m + gap) AND alt = substr('ACGT', CAST(b + 1 AS INTEGER), 1) THEN 1 ELSE 0 END) AS BIGINT) AS alternate
FROM a JOIN v ON pos BETWEEN start AND start + 2 * m + gap - 1 GROUP BY pool, pos""")
def base_calls(spark: SparkSession, d: str) -> DataFrame:
    """Alignments made from line items (one base throughout, a deletion in the middle), called at every part as a site."""
    q = F.col("l_quantity").cast("long")
    m, gap = q % 6 + 2, q % 4 + 1
    base = F.substring(F.lit("ACGT"), (F.col("l_suppkey") % 4 + 1).cast("int"), F.lit(1))
    sam = bridge.table(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("read_id"), (F.col("l_orderkey") % POOLS).alias("pool"), F.lit(99).alias("flag"), F.col("l_partkey").alias("pos"), F.concat(m.cast("string"), F.lit("M"), gap.cast("string"), F.lit("D"), m.cast("string"), F.lit("M")).alias("cigar"), F.repeat(base, (2 * m).cast("int")).alias("seq"))
    variants = bridge.table(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.substring(F.lit("ACGT"), (F.col("p_size") % 4 + 1).cast("int"), F.lit(1)).alias("alt"), F.lit(1).alias("code"))
    return reads.base_calls(sam, variants).groupBy("pool", "pos").agg(F.count(F.lit(1)).alias("n"), F.sum("allele").alias("alternate"))


@query("""WITH a AS (SELECT CAST(l_orderkey % 8 AS BIGINT) AS pool, l_partkey AS start, CAST(l_quantity AS BIGINT) % 6 + 2 AS m, CAST(l_quantity AS BIGINT) % 4 + 1 AS gap, CAST(l_quantity AS BIGINT) % 2 + 1 AS more, substr('ACGT', CAST(l_suppkey % 4 + 1 AS INTEGER), 1) AS base FROM lineitem),
v AS (SELECT p_partkey AS pos, repeat(substr('ACGT', CAST(p_size % 4 + 1 AS INTEGER), 1), CASE WHEN p_size % 3 = 0 THEN 2 ELSE 1 END) AS alt FROM part)
SELECT pool, pos, count(*) AS n, CAST(sum(CASE WHEN NOT (pos - start >= 2 * m AND pos - start < 2 * m + gap) AND alt = repeat(base, CASE WHEN pos - start = m - 1 THEN 1 + more ELSE 1 END) THEN 1 ELSE 0 END) AS BIGINT) AS alternate
FROM a JOIN v ON pos BETWEEN start AND start + 3 * m + gap - 1 GROUP BY pool, pos""")
def base_calls_indels(spark: SparkSession, d: str) -> DataFrame:
    """Alignments with clipped ends, an insertion and a deletion; some variants are insertions."""
    q = F.col("l_quantity").cast("long")
    m, gap, more, clip = q % 6 + 2, q % 4 + 1, q % 2 + 1, q % 3 + 1
    base = F.substring(F.lit("ACGT"), (F.col("l_suppkey") % 4 + 1).cast("int"), F.lit(1))
    cigar = F.concat(*(x for n, op in ((clip, "S"), (m, "M"), (more, "I"), (m, "M"), (gap, "D"), (m, "M"), (clip, "H")) for x in (n.cast("string"), F.lit(op))))
    seq = F.concat(F.repeat(F.lit("N"), clip.cast("int")), F.repeat(base, (3 * m + more).cast("int")))
    sam = bridge.table(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("read_id"), (F.col("l_orderkey") % POOLS).alias("pool"), F.lit(99).alias("flag"), F.col("l_partkey").alias("pos"), cigar.alias("cigar"), seq.alias("seq"))
    alt = F.repeat(F.substring(F.lit("ACGT"), (F.col("p_size") % 4 + 1).cast("int"), F.lit(1)), F.when(F.col("p_size") % 3 == 0, 2).otherwise(1))
    variants = bridge.table(spark, d, "part").select(F.col("p_partkey").alias("pos"), alt.alias("alt"), F.lit(1).alias("code"))
    return reads.base_calls(sam, variants).groupBy("pool", "pos").agg(F.count(F.lit(1)).alias("n"), F.sum("allele").alias("alternate"))


@query(f"""WITH {CALLS_SQL}, ids AS (SELECT DISTINCT pool, read_id FROM calls)
SELECT i.pool, i.read_id, string_agg(coalesce(CAST(c.allele AS VARCHAR), '*'), '' ORDER BY s) AS hap, round(count(c.allele) / 12, 9) AS known
FROM ids i CROSS JOIN range(12) t(s) LEFT JOIN calls c ON c.read_id = i.read_id AND c.site = s GROUP BY i.pool, i.read_id""")
def wildcard_merge(spark: SparkSession, d: str) -> DataFrame:
    return haplotypes.wildcard(bridge.calls(spark, d), SITES).withColumn("known", r9("known"))


@query(f"""WITH {CALLS_SQL} SELECT CAST(-1 AS BIGINT) AS ord, 'Hap_ID' || chr(9) || 'Prop_Recon' AS line
UNION ALL SELECT read_id, read_id || chr(9) || CAST(round(count(*) / 12 * 1e6, 0) AS BIGINT) FROM calls GROUP BY read_id""")
def proportion_lines(spark: SparkSession, d: str) -> DataFrame:
    """What share of its sites each read says, as text."""
    rows = haplotypes.wildcard(bridge.calls(spark, d), SITES)
    return files.proportion_lines(rows.select(F.col("read_id").alias("hap_id"), micro(F.col("known")).alias("value")))


CIGAR_SQL = """q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
ops AS (SELECT q.*, i, op, len FROM q, LATERAL (VALUES (0, 'S', q % 5 + 1), (1, 'M', q % 7 + 3), (2, 'I', q % 3 + 1), (3, 'M', q % 11 + 4), (4, 'D', q % 4 + 1), (5, 'M', q % 6 + 2)) t(i, op, len))"""


@query(f"""WITH {CIGAR_SQL}, runs AS (SELECT o.*, coalesce(sum(CASE WHEN op IN ('M', 'D') THEN len ELSE 0 END) OVER w, 0) AS r, coalesce(sum(CASE WHEN op IN ('M', 'I', 'S') THEN len ELSE 0 END) OVER w, 0) AS p
  FROM (SELECT DISTINCT q, i, op, len FROM ops) o WINDOW w AS (PARTITION BY q ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT CAST(n.cigars AS BIGINT) AS cigars, runs.q, runs.i AS place, op, CAST(len AS BIGINT) AS len, CAST(r AS BIGINT) AS ref_offset, CAST(p AS BIGINT) AS query_offset
FROM runs JOIN (SELECT q, count(*) AS cigars FROM q GROUP BY q) n ON n.q = runs.q""")
def cigar_walk(spark: SparkSession, d: str) -> DataFrame:
    """CIGAR texts made from quantities, walked row by row and summed up by text."""
    q = F.col("l_quantity").cast("long").alias("q")
    parts = ((5, 1, "S"), (7, 3, "M"), (3, 1, "I"), (11, 4, "M"), (4, 1, "D"), (6, 2, "M"))
    rows = bridge.table(spark, d, "lineitem").select(q).withColumn("cigar", F.concat(*(x for m, a, op in parts for x in ((F.col("q") % m + a).cast("string"), F.lit(op)))))
    walk = rows.select("q", F.posexplode(reads.walked(reads.cigar_ops(F.col("cigar")))).alias("place", "o"))
    return walk.groupBy("q", "place", F.col("o.op").alias("op"), F.col("o.len").alias("len"), F.col("o.ref").alias("ref_offset"), F.col("o.query").alias("query_offset")).agg(F.count(F.lit(1)).alias("cigars"))


@query("""SELECT CAST(l_orderkey % 8 AS BIGINT) AS pool, count(*) AS alignments, count(*) FILTER (l_suppkey % 256 <= 163 AND l_linenumber <> 7) AS usable FROM lineitem GROUP BY 1""")
def sam_filter(spark: SparkSession, d: str) -> DataFrame:
    """Alignments whose flag comes from the supplier and that have no CIGAR on line 7."""
    sam = bridge.table(spark, d, "lineitem").select((F.col("l_orderkey") % POOLS).alias("pool"), (F.col("l_suppkey") % 256).alias("flag"), F.when(F.col("l_linenumber") == 7, "*").otherwise("10M").alias("cigar"))
    ok = reads.usable(sam).groupBy("pool").agg(F.count(F.lit(1)).alias("usable"))
    return sam.groupBy("pool").agg(F.count(F.lit(1)).alias("alignments")).join(ok, "pool")


@query(f"""WITH {CALLS_SQL}, spans AS (SELECT pool, read_id, min(site) AS a, max(site) AS b FROM calls GROUP BY ALL)
SELECT s.pool, s.read_id, CAST(100 * (t.k + 1) AS BIGINT) AS pos, coalesce(c.allele, 0) AS allele FROM spans s JOIN range(12) t(k) ON t.k BETWEEN s.a AND s.b LEFT JOIN calls c ON c.read_id = s.read_id AND c.site = t.k""")
def span_join(spark: SparkSession, d: str) -> DataFrame:
    """Sites within each read's span, with the call there or the reference."""
    calls = bridge.calls(spark, d).withColumn("pos", bridge.position(F.col("site")))
    spans = calls.groupBy("pool", "read_id").agg(F.min("pos").alias("start"), F.max("pos").alias("end"))
    return reads.emitted(reads.sites_in_span(spans, calls.select("pos").distinct()), calls)


@query("""WITH c AS (SELECT l_partkey AS site, l_orderkey % 8 AS pool, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS hit FROM lineitem GROUP BY 1, 2)
SELECT site FROM c GROUP BY site HAVING bool_and(hit = 1)""")
def truth_sites(spark: SparkSession, d: str) -> DataFrame:
    """Every part is a site here: those with the alternate allele in all pools that cover them."""
    calls = bridge.raw_calls(spark, d).select("pool", F.col("l_partkey").alias("site"), "allele")
    return frequency.fixed_sites(frequency.site_frequency(calls))


@query(f"WITH {CALLS_SQL} SELECT DISTINCT pool, 1.0::DOUBLE AS total, true AS mean_agrees FROM calls")
def reconstruct_check(spark: SparkSession, d: str) -> DataFrame:
    """End to end: frequencies in every pool sum to 1, and the global ones are their mean."""
    found = whole.kept(whole.reconstruct(bridge.calls(spark, d), SITES))
    means = found.groupBy("hap").agg(F.avg("freq").alias("m"), F.max("mean_freq").alias("g"))
    agree = means.agg((F.max(F.abs(F.col("m") - F.col("g"))) < 1e-9).alias("mean_agrees"))
    return found.groupBy("pool").agg(F.round(F.sum("freq"), 6).alias("total")).crossJoin(F.broadcast(agree))


@query()
def reconstruction(spark: SparkSession, d: str) -> DataFrame:
    """Haplotypes and their frequencies in each pool and over all."""
    return whole.reconstruct(bridge.calls(spark, d), SITES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconstruction(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
