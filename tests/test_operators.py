"""Operators on small inputs with known answers, planted truth, text formats, streaming."""

import itertools
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from poolweave.functions import algebra, locus
from poolweave.jobs import reconstruct
from poolweave.operators import colouring, em, frequency, haplotypes, linkage, reads, regions, regression
from poolweave.sources import files, params
from poolweave.streaming import live

SITES = 12


def planted(pools=4, reads_per_pool=400, seed=5):
    """Calls of error-free reads over 2 to 12 neighbouring sites, four haplotypes in known shares."""
    r = np.random.default_rng(seed)
    haps = np.array([[0, 1] * 6, [1, 0] * 6, [0, 0, 1, 1] * 3, [1] * 12])
    mix = np.array([[0.5, 0.5, 0, 0], [0.25, 0.25, 0.5, 0], [0, 0.2, 0.3, 0.5], [0.25] * 4])[:pools]
    rows = []
    for p in range(pools):
        for i in range(reads_per_pool):
            h = haps[r.choice(4, p=mix[p])]
            size = int(r.integers(2, SITES + 1))
            a = int(r.integers(0, SITES - size + 1))
            rows += [(p, p * 10_000 + i, s, int(h[s])) for s in range(a, a + size)]
    return haps, mix, rows


@pytest.fixture(scope="module")
def truth(spark):
    haps, mix, rows = planted()
    return haps, mix, spark.createDataFrame(rows, "pool long, read_id long, site long, allele long").cache()


def test_frequencies_follow_the_mixture(truth):
    haps, mix, calls = truth
    for r in frequency.site_frequency(calls).collect():
        assert abs(r.freq - mix[r.pool] @ haps[:, r.site]) < 0.12


def test_linkage_follows_the_mixture(truth):
    haps, mix, calls = truth
    for r in linkage.pair_linkage(calls).collect():
        assert abs(r.p11 - mix[r.pool] @ (haps[:, r.l1] * haps[:, r.l2])) < 0.2


def test_reconstruction_finds_planted_haplotypes(truth):
    haps, mix, calls = truth
    found = reconstruct.reconstruct(calls, SITES).toPandas()
    shares = found.pivot(index="pool", columns="hap", values="freq")
    assert np.allclose(shares.sum(axis=1), 1)
    planted_ones = {"".join(map(str, h)) for h in haps}
    top = found.drop_duplicates("hap").nlargest(4, "mean_freq")["hap"]
    assert len(planted_ones & set(top)) >= 3


def test_every_draft_is_a_candidate(spark, truth, monkeypatch):
    """Of 500 drafts also the rarest one."""
    own = "111111000000"
    many = [format(i, "012b") for i in range(500) if format(i, "012b") != own]
    drafts = spark.createDataFrame([(p, h, "", 10_000) for h in many for p in (0, 1)] + [(3, own, "", 1), (3, "0" * 12, "", 10**6)], "pool long, hap string, links string, n long")
    monkeypatch.setattr(reconstruct, "pool_drafts", lambda calls, sites: drafts)
    seen = []
    monkeypatch.setattr(reconstruct, "pool_lasso", lambda haps, calls, p: seen.append({r.hap for r in haps.collect()}) or spark.createDataFrame([(0, own, 1.0)], "pool long, hap string, freq double"))
    reconstruct.reconstruct(truth[2], SITES)
    assert own in seen[0] and seen[0] >= set(many)


def test_a_region_without_em_is_regressed(spark, monkeypatch):
    names, copies = ("010101010101", "101010101010", "001100110011"), ((5, 3, 2), (1, 3, 6))
    rows = [(p, p * 100 + 20 * i + j, s, int(h[s])) for p, each in enumerate(copies) for i, (h, n) in enumerate(zip(names, each, strict=True)) for j in range(n) for s in range(SITES)]
    calls = spark.createDataFrame(rows, "pool long, read_id long, site long, allele long")
    # drafts' counts are far from the shares: only a regression can find these
    drafts = spark.createDataFrame([(0, h, "", n) for h, n in zip(names, (1, 1, 998), strict=True)], "pool long, hap string, links string, n long")
    plan = regions.region_table(spark, ([(0, 5), (6, 11)], []))
    broken = spark.createDataFrame([(1, k, "0" * 6, float("nan")) for k in (0, 1)], "level long, region long, hap string, freq double")
    monkeypatch.setattr(em, "solved_regions", lambda *a: broken)
    found = reconstruct.region_haplotypes(calls, drafts, plan, params.Parameters(penalty=0.0)).toPandas()
    for k in (0, 1):
        got = found[found.region == k].set_index("hap")["freq"]
        assert sorted(got.index) == sorted(h[6 * k : 6 * k + 6] for h in names)
        assert all(abs(got[h[6 * k : 6 * k + 6]] - share) < 0.02 for h, share in zip(names, (0.3, 0.3, 0.4), strict=True))


def test_colouring_memory_grows_with_nodes_and_ranges():
    """No bits of nodes by ranges, and no object for each range of a node."""
    r = np.random.default_rng(3)
    nodes = np.unique([(m, int(r.integers(0, 4096)) & m) for m in r.integers(1, 4096, 1_500).tolist()], axis=0)
    copies = (1 + r.pareto(1.0, len(nodes)) * 10).astype(np.int64).clip(1, 32_877)
    tracemalloc.start()
    found = colouring.coloured_ranges(nodes[:, :1].copy(), nodes[:, 1:].copy(), copies)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    ranges = sum(len(a) for a, _ in found)
    assert sum(int(size.sum()) for _, size in found) == copies.sum() and peak < 48 * ranges + 1_000 * len(nodes)


def test_colouring_is_valid_and_counts_copies():
    r = np.random.default_rng(1)
    mask, bits = r.integers(1, 64, (60, 2)), r.integers(0, 64, (60, 2))
    mask[:, 1] &= 3
    bits &= mask
    copies = r.integers(1, 5, 60)
    colours = colouring.coloured_nodes(mask, bits, copies)
    assert [len(set(c)) for c in colours] == copies.tolist()
    for i, j in itertools.combinations(range(60), 2):
        if (mask[i] & mask[j] & (bits[i] ^ bits[j])).any():
            assert not set(colours[i]) & set(colours[j])


def test_consensus_and_draft_text(spark):
    rows = [(0, "a", [0b0011], [0b0001], 0), (0, "b", [0b1100], [0b0100], 0), (0, "c", [0b1111], [0b0101], 1), (0, "d", [0b0111], [0], 2)]
    out = colouring.consensus(spark.createDataFrame(rows, colouring.COLOURS), 4)
    drafts = colouring.draft_haplotypes(out).collect()
    assert [(d.hap, d.links, d.n) for d in drafts] == [("1010", "---", 2)]
    line = out.where("colour = 0").select(colouring.draft_line(F.col("hap"), F.col("links"), F.lit(12))).first()[0]
    assert line == "1-0?1-0\t12"


def test_plan_by_hand():
    """Gaps 4, 9, 12 of 20 sites: level 1 cuts at 12, level 2 straddles the cut."""
    one, two = regions.plan([4, 9, 12, 19], 20, regions.PlanLimits(10, 16, 3, 10, 16))
    assert one == [(0, 11), (12, 19)] and two == [(5, 12)]


@pytest.mark.parametrize("sites,gaps", [(60, [2, 5, 12, 59]), (5, [4]), (100, [*range(0, 100, 7), 99]), (40, [39])])
def test_plan_covers_every_site_once(sites, gaps):
    limits = regions.PlanLimits()
    one, two = regions.plan(gaps, sites, limits)
    assert [s for a, b in one for s in range(a, b + 1)] == list(range(sites))
    assert all(b - a + 1 <= limits.max_level_1 for a, b in one)
    assert all(0 <= a <= b < sites for a, b in two) and (len(one) > 1 or not two)


def test_em_finds_moments():
    haps = em.all_haplotypes(4)
    r = np.random.default_rng(2)
    p = r.dirichlet(np.ones(16))
    mu, sigma = em.moments(haps, p)
    assert np.allclose(mu, (haps * p[:, None]).sum(0)) and np.allclose(sigma, np.cov(haps.T, aweights=p, ddof=0))
    x = np.clip(mu + r.normal(0, 0.1, (8, 4)), 0, 1)
    found = em.solve(haps, x)
    assert np.isfinite(found).all() and abs(found.sum() - 1) < 1e-9 and (found >= 0).all()
    with pytest.raises(ValueError):
        em.all_haplotypes(21)


def test_lasso_recovers_weights(spark):
    haps = spark.createDataFrame([(h,) for h in ("0011", "0101", "1110")], "hap string")
    w = {"0011": 0.5, "0101": 0.3, "1110": 0.2}
    freq = [(0, s, sum(v * int(h[s]) for h, v in w.items())) for s in range(4)]
    pairs = [(0, a, b, sum(v * int(h[a]) * int(h[b]) for h, v in w.items())) for a in range(4) for b in range(a + 1, 4)]
    rows = regression.design(haps, spark.createDataFrame(freq, "pool long, site long, freq double"), spark.createDataFrame(pairs, "pool long, l1 long, l2 long, p11 double"))
    found, r2 = regression.fit(rows, 0.0, 100)
    assert np.allclose(found, [w[h] for h in sorted(w)], atol=1e-3) and r2 > 0.999
    coefficients, _, penalty = regression.fit_with_ladder(rows, regression.Ladder(penalty=5.0, step=2.0))
    assert penalty < 5.0 and max(coefficients) > 0


def test_pruning(spark):
    haps = spark.createDataFrame([(f"h{i:02d}", f) for i, f in enumerate([0.3, 0.2, 0.2, 0.1, 0.05, 0.05, 0.05, 0.05])], "hap string, freq double")
    assert haplotypes.pruned(haps, 0.0).count() == 8 and haplotypes.pruned(haps, 0.1).count() == 4
    assert haplotypes.top_with_ties(haps, 2).count() == 3
    few = haplotypes.adaptive(haps, 0.25).collect()
    assert len(few) == 8 and abs(sum(r.freq for r in few) - 1) < 1e-9  # the fifth place is shared by four
    many = haplotypes.adaptive(haps, 0.01, max_keep=4, picks=3)
    assert many.count() == 3 and many.collect() == haplotypes.adaptive(haps, 0.01, max_keep=4, picks=3).collect()


def test_cigar_and_base_calls(spark):
    ops = spark.createDataFrame([("2S3M1I2M2D3M1S",), ("5M1N",), ("*",)], "c string").select(reads.walked(reads.cigar_ops(F.col("c"))).alias("w")).collect()
    assert [(o.op, o.len, o.ref, o.query) for o in ops[0].w] == [("S", 2, 0, 0), ("M", 3, 0, 2), ("I", 1, 3, 5), ("M", 2, 3, 6), ("D", 2, 5, 8), ("M", 3, 7, 8), ("S", 1, 10, 11)]
    assert ops[1].w is None and ops[2].w is None
    sam = spark.createDataFrame([(0, "r1", 99, 100, "2S3M1I2M2D3M1S", "xxACGTAACCGx"), (0, "r2", 200, 100, "5M", "AAAAA"), (0, "r3", 0, 100, "*", "A")], "pool long, read_id string, flag int, pos long, cigar string, seq string")
    variants = spark.createDataFrame([(101, "C", 1), (102, "GT", 1), (103, "A", 1), (105, "T", 1), (107, "A", 2), (300, "A", 1)], "pos long, alt string, code int")
    assert {(r.pos, r.allele) for r in reads.base_calls(sam, variants).collect()} == {(101, 1), (102, 1), (103, 1), (105, 0), (107, 0)}


def test_mates_link_by_exact_position(spark):
    rows = [(0, 1, 0, 50, 1, 0), (0, 1, 0, 150, 0, 1), (0, 1, 1, 150, 1, 0), (0, 1, 1, 250, 1, 1)]
    r = reads.linked_mates(spark.createDataFrame(rows, "pool long, read_id long, record long, pos long, allele long, ord long")).first()
    assert [(c.pos, c.allele) for c in r.calls] == [(50, 1), (150, 0), (250, 1)] and [(s.start, s.end) for s in r.spans] == [(50, 150), (150, 250)]


def test_range_join_by_blocks(spark):
    spans = spark.createDataFrame([(0, 1, 5, 20_500), (0, 2, 30_000, 30_001)], "pool long, read_id long, start long, end long")
    sites = spark.createDataFrame([(5,), (9_999,), (20_500,), (20_501,), (30_001,)], "pos long")
    assert {tuple(r) for r in reads.sites_in_span(spans, sites).collect()} == {(0, 1, 5), (0, 1, 9_999), (0, 1, 20_500), (0, 2, 30_001)}


def test_range_join_compares_spans_with_near_sites_only(spark):
    """Sites at every position: what spans are compared with follows from their length, not from the number of sites."""
    sites = spark.range(20_000).select(F.col("id").alias("pos"))
    for add, most in ((0, 2 * 128), (5_000, 2 * 8_192), (19_000, 20_000)):
        end = F.col("id") * 97 + F.col("id") % 20 + add
        spans = spark.range(100).select(F.lit(0).cast("long").alias("pool"), F.col("id").alias("read_id"), (F.col("id") * 97).alias("start"), end.alias("end"))
        assert reads.inside(spans, sites).count() == sum(min(97 * k + k % 20 + add, 19_999) - 97 * k + 1 for k in range(100))
        assert reads.near(spans, sites).count() <= 100 * most


def test_base_calls_with_several_alternatives(spark):
    """Several variants of a site, insertions behind one base, a deletion, a sequence that ends early, and none at all."""
    sam = spark.createDataFrame([(0, "a", 99, 10, "2M1I1M2D2M", "ACTGA"), (0, "b", 99, 12, "3M", "*"), (0, "c", 99, 11, "1M2I1I1M", "CGGTA")], "pool long, read_id string, flag int, pos long, cigar string, seq string")
    variants = spark.createDataFrame([(11, "CT", 1), (11, "CGG", 2), (12, "G", 1), (12, "A", 2), (13, "-", 1), (15, "A", 1), (16, "A", 1)], "pos long, alt string, code int")
    got = sorted((r.read_id, r.pos, r.allele) for r in reads.base_calls(sam, variants).collect())
    assert got == [("a", 11, 1), ("a", 12, 1), ("a", 13, 0), ("a", 15, 1), ("a", 16, 0), ("b", 12, 0), ("b", 13, 0), ("c", 11, 2), ("c", 12, 2)]


def test_matrix_with_trailing_tab(spark, tmp_path):
    (tmp_path / "f.txt").write_text("Pool_ID\t0\t1\t\n0;100;100;0:1\t0.5\t0.25\n0;200;210;0:1:2\t0\t1")
    out = files.site_frequencies(spark, str(tmp_path / "f.txt")).collect()
    assert {(r.at.start, r.at.is_region, r.pool, r.freq) for r in out} == {(100, False, "0", 0.5), (100, False, "1", 0.25), (200, True, "0", 0.0), (200, True, "1", 1.0)}


def test_formats_round_trip(spark, tmp_path):
    path = lambda n: str(tmp_path / n)
    drafts = spark.createDataFrame([("0011", "-?-", 12), ("1", "", 3)], "hap string, links string, n long")
    files.write_drafts(drafts, path("drafts"))
    assert {(r.hap, r.links, r.n) for r in files.drafts(spark, path("drafts")).collect()} == {("0011", "-?-", 12), ("1", "", 3)}
    haps = spark.createDataFrame([(0, "01", "0.75"), (1, "10", "0.25")], "hap_id long, hap string, value string")
    files.write_lines(files.inter_lines(haps), path("inter"))
    back = files.haplotype_set(spark, path("inter")).collect()
    assert {(r.hap_id, r.locus, r.allele, r.freq) for r in back} == {("0", "0", "0", 0.75), ("0", "1", "1", 0.75), ("1", "0", "1", 0.25), ("1", "1", "0", 0.25)}
    read = spark.createDataFrame([(7, [(100, 1), (300, 0)], [(90, 310)])], "read_id long, calls array<struct<pos:long,allele:long>>, spans array<struct<start:long,end:long>>")
    files.write_reads(read, path("reads"))
    assert (tmp_path / "reads").is_dir() and [(c.pos, c.allele) for c in files.reads(spark, path("reads")).first().calls] == [(100, "1"), (300, "0")]
    plan = regions.region_table(spark, ([(0, 9), (10, 19)], [(5, 14)]))
    assert [r.line for r in files.plan_lines(plan).orderBy("ord").collect()] == ["Level_I", "0:9\t10:19", "Level_II", "5:14"]
    files.write_libsvm(spark.createDataFrame([(0.5, [1.0, 0.0, 1.0])], "label double, features array<double>"), path("svm"))
    assert spark.read.text(path("svm")).first()[0] == "0.5 1:1.0 3:1.0"


def test_variant_and_alignment_text(spark, tmp_path):
    (tmp_path / "v.vcf").write_text('##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t3\t1\n1\t100\t.\tA\tT,G\t.\t.\t.\tGT:AD:DP\t0:7,3:10\t.:.:.\n')
    out = {(r.pos, r.pool, r.ref_depth, r.alt_depth) for r in files.variants(spark, str(tmp_path / "v.vcf")).collect()}
    assert out == {(100, "3", 7, 3), (100, "1", 0, 0)}
    assert reads.first_variants(files.variants(spark, str(tmp_path / "v.vcf"))).first().alt == "T"
    (tmp_path / "a.sam").write_text("@HD\n@PG\tPN:x\nr:1\t99\tc\t100\t60\t5M\t=\t1\t1\tACGTA\tIIIII\n")
    r = files.alignments(spark, str(tmp_path / "a.sam")).first()
    assert (r.read_id, r.flag, r.pos, r.cigar, r.seq) == ("r1", 99, 100, "5M", "ACGTA")


def test_parameters():
    p = params.parse("# c\nFragments = 500\nLambda_Penalty=0.1\nUnknown = x\nEst_Ind_PerPool = 1e6\n")
    assert (p.fragments, p.penalty, p.per_pool, p.level_1_max) == (500, 0.1, 1_000_000, 16)
    with pytest.raises(ValueError):
        params.parse("Fragments = many")


def test_algebra(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 5.0], [[1.0, 2.0], [3.0, 4.0]], [float("nan"), 1.0, 3.0])], "a array<double>, b array<double>, m array<array<double>>, n array<double>")
    a, b = F.col("a"), F.col("b")
    r = df.select(algebra.inner_product(a, b), algebra.distance(a, b), algebra.quadratic_form(a, F.col("m")), algebra.diagonal(F.col("m")), algebra.normalised_with_nan(F.col("n"), 0.2), algebra.floor_and_normalise(b, 0.5), algebra.inner_product(a, F.col("n"))).first()
    assert r[0] == 13 and r[1] == 5 and r[2] == 27 and r[3] == [1, 4] and np.allclose(r[4], [0.2, 0.2, 0.6]) and r[5] == [0, 1] and r[6] is None
    mu, sigma = np.array([0.5, 0.5]), np.eye(2)
    assert np.isclose(algebra.log_likelihood(mu, sigma, np.array([[0.5, 0.5]])), -np.log(2 * np.pi))
    assert algebra.in_span(np.diag([1.0, 0.0]), np.array([[2.0, 0.0]])) and not algebra.in_span(np.diag([1.0, 0.0]), np.array([[0.0, 1.0]]))


def test_locus(spark):
    df = spark.createDataFrame([("0;100;103;0011:0110",)], "k string").select(locus.parsed(F.col("k")).alias("x"))
    r = df.select("x.*", locus.hamming_matrix(F.col("x.alleles")).alias("d"), locus.coding(F.col("x.alleles")).alias("c")).first()
    assert (r.chr, r.start, r.end, r.is_region, r.d, r.c) == (0, 100, 103, True, [[0, 2], [2, 0]], {"0011": 0.0, "0110": 1.0})


def test_live_counts_equal_batch(spark, truth, tmp_path):
    _, _, calls = truth
    calls.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    q = live.live_frequency(stream).writeStream.outputMode("complete").format("memory").queryName("live").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.pool, r.site, r.n, round(r.freq, 9)) for r in spark.table("live").collect()} == {(r.pool, r.site, r.n, round(r.freq, 9)) for r in frequency.site_frequency(calls).collect()}


def test_masks_beyond_one_word(spark):
    """Opposite reads over sites 0 and 64 are told apart, and sites 62 and 63, in two words, are neighbours."""
    rows = [(0, 1, 0, 1), (0, 1, 64, 0), (0, 2, 0, 0), (0, 2, 64, 1), (0, 3, 62, 1), (0, 3, 63, 1), (0, 4, 63, 0), (0, 4, 64, 1)]
    found = frequency.fragments(spark.createDataFrame(rows, "pool long, read_id long, site long, allele long"))
    by = {r.genotype: (r["mask"], r["bits"]) for r in found.collect()}
    assert by["100=1;6500=0;"] == ([1, 2], [1, 0]) and by["100=0;6500=1;"] == ([1, 2], [0, 2])
    degree = {r.genotype: r.degree for r in colouring.degrees(found).collect()}
    assert degree == {"100=1;6500=0;": 2, "100=0;6500=1;": 1, "6300=1;6400=1;": 1, "6400=0;6500=1;": 2}
    line = colouring.consensus(found.where("genotype = '6300=1;6400=1;'").withColumn("colour", F.lit(0).cast("long")), 80).first()
    assert line.hap == "*" * 62 + "11" + "*" * 16 and line.links == "?" * 62 + "-" + "?" * 16


def plain_colours(reads_, copies):
    """The colouring rule in plain Python: reads_ are dicts of site and allele, in the order of their genotypes."""
    near = [[j for j, b in enumerate(reads_) if any(b.get(s, v) != v for s, v in a.items())] for a in reads_]
    out, left = {}, set(range(len(reads_)))
    while left:
        taken = {i: {c for j in near[i] for c in out.get(j, ())} for i in left}
        i = min(left, key=lambda i: (-len(taken[i]), i))
        out[i], c = [], 0
        while len(out[i]) < copies[i]:
            out[i] += [] if c in taken[i] else [c]
            c += 1
        left.remove(i)
    return out


def test_colouring_against_plain_python(spark, truth):
    _, _, calls = truth
    found = frequency.fragments(calls.where("pool = 1 AND site < 7")).toPandas().sort_values("genotype").reset_index(drop=True)
    parsed = [{int(t.split("=")[0]): int(t.split("=")[1]) for t in g.split(";") if t} for g in found["genotype"]]
    want = plain_colours(parsed, found["n"].tolist())
    got = colouring.coloured(spark.createDataFrame(found)).toPandas().groupby("genotype")["colour"].apply(sorted)
    assert {found["genotype"][i]: c for i, c in want.items()} == got.to_dict()


def plain_em(x, rounds=150):
    """The iteration in plain loops over haplotypes, pools and sites (two sites, covariance inverted by hand)."""
    haps, p, before = [(0, 0), (0, 1), (1, 0), (1, 1)], [0.25] * 4, [0.25] * 4
    for _ in range(rounds):
        mu = [sum(p[h] * haps[h][i] for h in range(4)) for i in (0, 1)]
        s = [[sum(p[h] * haps[h][i] * haps[h][j] for h in range(4)) - mu[i] * mu[j] for j in (0, 1)] for i in (0, 1)]
        det = s[0][0] * s[1][1] - s[0][1] * s[1][0]
        inv = [[s[1][1] / det, -s[0][1] / det], [-s[1][0] / det, s[0][0] / det]]
        form = lambda a, b, inv=inv: sum(a[i] * inv[i][j] * b[j] for i in (0, 1) for j in (0, 1))
        factor = []
        for h in haps:
            own = [h[i] - mu[i] for i in (0, 1)]
            pools = [np.exp(form(own, d) - 0.5 * form(d, d)) for d in ([row[i] - mu[i] for i in (0, 1)] for row in x)]
            factor.append(np.exp(-form(own, own) / 2_000_000) * sum(pools) / len(pools))
        if sum(abs(a - b) for a, b in zip(before, factor, strict=True)) < 1e-5 or sum(abs(a / b - 1) for a, b in zip(before, factor, strict=True)) < 1e-5:
            break
        p = [a * f for a, f in zip(p, factor, strict=True)]
        p = [a / sum(p) if a / sum(p) >= 4.88281e-7 else 0.0 for a in p]
        p, before = [a / sum(p) for a in p], factor
    return p


def test_em_against_plain_loops(spark):
    r = np.random.default_rng(4)
    for k in range(3):
        x = np.clip([0.4, 0.55] + r.normal(0, 0.12, (6, 2)), 0.02, 0.98)
        freq = spark.createDataFrame([(p, s, float(x[p, s])) for p in range(6) for s in range(2)], "pool long, site long, freq double")
        got = {q.hap: q.freq for q in em.solved_regions(freq, regions.region_table(spark, ([(0, 1)], []))).collect()}
        want = dict(zip(("00", "01", "10", "11"), plain_em(x.tolist()), strict=True))
        assert all(abs(got.get(h, 0.0) - f) < 1e-8 for h, f in want.items()), k


def test_a_site_that_no_pool_covers_keeps_its_place(spark):
    freq = spark.createDataFrame([(p, s, 0.3 + 0.1 * p + 0.05 * s) for p in range(3) for s in (3, 5) if (p, s) != (1, 5)], "pool long, site long, freq double")
    plan = regions.region_table(spark, ([(3, 5), (6, 7)], []))
    found = em.first_factors(freq, plan).toPandas()
    assert set(found[found.region == 0]["hap"].map(len)) == {3} and set(found[found.region == 1]["hap"].map(len)) == {2}
    x = em.matrix(em.region_groups(freq, plan).where("region = 0").toPandas())
    assert np.allclose(x[:, 1], 0) and np.isclose(x[1, 2], (x[0, 2] + x[2, 2]) / 2)


def test_all_pools_lasso_is_the_optimum_of_one(spark):
    r = np.random.default_rng(6)
    haps = spark.createDataFrame([(format(i, "04b"),) for i in r.permutation(16)[:7].tolist()], "hap string")
    names = sorted(h.hap for h in haps.collect())
    freq, pairs = [], []
    for p in range(3):
        w = r.dirichlet(np.ones(7))
        freq += [(p, s, float(sum(v * int(h[s]) for v, h in zip(w, names, strict=True)))) for s in range(4)]
        pairs += [(p, a, b, float(sum(v * int(h[a]) * int(h[b]) for v, h in zip(w, names, strict=True)))) for a in range(4) for b in range(a + 1, 4)]
    rows = regression.design(haps, spark.createDataFrame(freq, "pool long, site long, freq double"), spark.createDataFrame(pairs, "pool long, l1 long, l2 long, p11 double"))
    got = regression.pool_frequencies(rows, haps, regression.Ladder(penalty=0.02)).toPandas()
    for p in range(3):
        one, r2 = regression.fit(rows.where(F.col("pool") == p), 0.02, 500)
        mine = got[got.pool == p].set_index("hap")["freq"]
        assert np.allclose([mine[h] for h in names], one, atol=2e-3) and abs(got[got.pool == p]["r2"].iloc[0] - r2) < 1e-3


def test_eighty_sites_are_reconstructed(spark):
    """A planted mixture over more sites than one word holds, by regions of both levels."""
    r, sites = np.random.default_rng(8), 80
    haps = r.integers(0, 2, (3, sites))
    mix = np.array([[0.6, 0.4, 0.0], [0.2, 0.3, 0.5], [0.0, 0.5, 0.5]])
    rows = []
    for p in range(3):
        for i in range(260):
            h, a = haps[r.choice(3, p=mix[p])], int(r.integers(-12, sites - 4))
            rows += [(p, p * 1000 + i, s, int(h[s])) for s in range(max(a, 0), min(a + 24, sites))]
    calls = spark.createDataFrame(rows, "pool long, read_id long, site long, allele long")
    limits = params.Parameters(level_1_min=5, level_1_max=8, level_2_min=5, level_2_max=8, em_rounds=60)
    found = reconstruct.reconstruct(calls, sites, limits).toPandas()
    assert set(found["hap"].map(len)) == {sites}
    shares = found.pivot(index="pool", columns="hap", values="freq")
    assert np.allclose(shares.sum(axis=1), 1)
    top = set(found.drop_duplicates("hap").nlargest(3, "mean_freq")["hap"])
    assert top == {"".join(map(str, h)) for h in haps}


def test_a_run_from_files_to_files(spark, tmp_path):
    """Alignments and variants to reads and frequencies, those to haplotypes, and every file read back."""
    from poolweave.jobs import run

    haps, mix, _ = planted()
    pos = [100 + 10 * s for s in range(SITES)]
    r = np.random.default_rng(3)
    (tmp_path / "x.vcf").write_text("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + "\t".join(map(str, range(4))) + "\n" + "".join(f"1\t{p}\t.\tA\tT\t.\t.\t.\tGT:AD\t" + "\t".join(["0:1,1"] * 4) + "\n" for p in pos))
    for p in range(4):
        lines = ["@HD\tVN:1\n"]
        for i in range(150):
            h = haps[r.choice(4, p=mix[p])]
            a = int(r.integers(0, SITES - 3))
            for mate, (first, last) in enumerate(((a, min(a + 4, SITES)), (min(a + 3, SITES - 1), SITES))):
                start, size = pos[first] - 2, pos[last - 1] - pos[first] + 5
                seq = ["A"] * size
                for s in range(first, last):
                    seq[pos[s] - start] = "T" if h[s] else "A"
                lines.append(f"r{i}\t{99 if mate == 0 else 147}\tc\t{start}\t60\t{size}M\t=\t1\t1\t{''.join(seq)}\t{'I' * size}\n")
        (tmp_path / f"x_p{p}.srt.sam").write_text("".join(lines))
    (tmp_path / "run.properties").write_text(f"Intermediate_Dir = {tmp_path}/\nOutput_Dir = {tmp_path}/out/\nLambda_Penalty = 0.02\n")
    p = params.load(str(tmp_path / "run.properties"))
    freq = run.reads_of_alignments(spark, p, "x")
    table = {(int(x["pool"]), x["at"]["start"]): x.freq for x in files.site_frequencies(spark, f"{tmp_path}/x_vars.intra_freq.txt").collect()}
    assert table == {(x.pool, pos[x.site]): x.freq for x in freq.collect()} and len(table) == 4 * SITES
    found = run.haplotypes_of_files(spark, p, "x").toPandas()
    assert np.allclose(found.groupby("pool")["freq"].sum(), 1)
    planted_ones = {"".join(map(str, h)) for h in haps}
    assert len(planted_ones & set(found.drop_duplicates("hap").nlargest(4, "mean_freq")["hap"])) >= 3
    back = files.haplotype_set(spark, f"{tmp_path}/out/x.inter_freq_vars.txt", f"{tmp_path}/out/x.intra_freq.txt").toPandas()
    assert set(back["locus"]) == {f"0;{x};{x};0:1" for x in pos}
    by = {(row.hap_id, row.pool): (row.freq, row.mean_freq) for row in found.itertuples()}
    assert {(int(x.hap_id), int(x.pool)): (x.in_pool, x.freq) for x in back.itertuples()} == by
    assert files.drafts(spark, f"{tmp_path}/x_drafts").count() and "Level_I" in [x.line for x in files.lines(spark, f"{tmp_path}/x_dc_plan.txt").collect()]


def test_matrices_of_one_folder_keep_their_headers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Pool_ID\t0\t1\n0;100;100;0:1\t0.5\t0.25\n")
    (tmp_path / "b.txt").write_text("Pool_ID\t7\n0;300;300;0:1\t1.0\n")
    assert {(r.key, r.column, r.value) for r in files.matrix(spark, str(tmp_path)).collect()} == {("0;100;100;0:1", "0", "0.5"), ("0;100;100;0:1", "1", "0.25"), ("0;300;300;0:1", "7", "1.0")}
    (tmp_path / "list").write_text(f"{tmp_path}/a.txt\n{tmp_path}/b.txt\n")
    assert files.matrix(spark, files.path_list(spark, f"{tmp_path}/list")).count() == 3
    assert [(r.site, r.pos) for r in files.site_index(spark, f"{tmp_path}/a.txt").collect()] == [(0, 100)]
    files.write_libsvm(spark.createDataFrame([(0.5, [1.0, 0.0, 2.5])], "label double, features array<double>"), f"{tmp_path}/svm")
    assert tuple(files.libsvm(spark, f"{tmp_path}/svm", 3).first()) == (0.5, [1.0, 0.0, 2.5])
    calls = spark.createDataFrame([(0, 1, 100, 1), (0, 1, 555, 0)], "pool long, read_id long, pos long, allele long")
    assert [tuple(r) for r in reads.site_calls(calls, files.site_index(spark, f"{tmp_path}/a.txt")).collect()] == [(0, 1, 0, 1)]


def test_first_variant_of_a_position_is_the_first_record(spark):
    df = spark.createDataFrame([(2, 100, "C"), (1, 100, "G,T"), (3, 200, "T")], "record long, pos long, alt string")
    assert {(r.pos, r.alt) for r in reads.first_variants(df).collect()} == {(100, "G"), (200, "T")}
    assert {(r.pos, r.alt) for r in reads.first_variants(df.drop("record")).collect()} == {(100, "C"), (200, "T")}


def test_gap_support_of_copies(spark):
    drafts = spark.createDataFrame([(0, "?-", 3), (0, "-?", 1)], "pool long, links string, n long")
    plain = {(r.pool, r.k): r.support for r in regions.gap_support(drafts).collect()}
    assert plain[0, 0] == 1.5 and plain[None, 1] == 0.5
    assert {(r.pool, r.k): r.support for r in regions.gap_support(drafts, weighted=True).collect()}[0, 0] == 0.75
