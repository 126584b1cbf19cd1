"""Runs by depths, lists and known sites; reads of all pools in one job; mates of a stream; subsets by lot."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import SITES, planted

from poolweave.jobs import run
from poolweave.operators import haplotypes, reads
from poolweave.sources import files, params
from poolweave.streaming import mates

POS = [100 + 10 * s for s in range(SITES)]


@pytest.fixture
def made(tmp_path):
    """Alignments of three pools under names that tell no pool, and variants whose depths differ from the reads."""
    haps, mix, _ = planted(3)
    r = np.random.default_rng(3)
    depth = lambda p, s: (10 + p, 3 * (s % 4))
    cells = ["\t".join("0:{},{}".format(*depth(p, s)) for p in range(3)) for s in range(SITES)]
    head = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t0\t1\t2\n"
    again = f"1\t{POS[2]}\t.\tA\tG\t.\t.\t.\tGT:AD\t" + "\t".join(["0:1,99"] * 3) + "\n"  # a later record of a position says nothing
    (tmp_path / "x.vcf").write_text(head + "".join(f"1\t{p}\t.\tA\tT\t.\t.\t.\tGT:AD\t{c}\n" for p, c in zip(POS, cells, strict=True)) + again)
    names = []
    for p in range(3):
        lines = []
        for i in range(120):
            h = haps[r.choice(4, p=mix[p])]
            a = int(r.integers(0, SITES - 5))
            seq = ["A"] * 63
            for s in range(a, a + 6):
                seq[POS[s] - POS[a] + 2] = "T" if h[s] else "A"
            lines.append(f"r{i}\t99\tc\t{POS[a] - 2}\t60\t63M\t=\t1\t1\t{''.join(seq)}\t{'I' * 63}\n")
        names.append(tmp_path / f"sample{chr(99 - p)}.sam")
        names[-1].write_text("".join(lines))
    (tmp_path / "list").write_text("\n".join(map(str, names)) + "\n")
    (tmp_path / "known.txt").write_text("Pool_ID\t0\t1\n" + "".join(f"0;{p};{p};0:1\t{0.5 if k % 3 else 0.0}\t0.25\n" for k, p in enumerate(POS)))
    return params.Parameters(work_dir=str(tmp_path), output_dir=f"{tmp_path}/out", penalty=0.02), tmp_path, depth


def test_frequencies_of_depths(spark, made):
    p, folder, depth = made
    run.reads_of_alignments(spark, p, "x", "depths", paths=f"{folder}/list")
    got = {(int(r["pool"]), r["at"]["start"]): r.freq for r in files.site_frequencies(spark, f"{folder}/x_vars.intra_freq.txt").collect()}
    want = {(k, pos): depth(k, s)[1] / sum(depth(k, s)) for k in range(3) for s, pos in enumerate(POS)}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-12 for k, v in want.items())
    with pytest.raises(ValueError):
        run.reads_of_alignments(spark, p, "x", "guesses")


def test_known_sites_and_a_list_of_files(spark, made):
    p, folder, _ = made
    freq = run.reads_of_alignments(spark, p, "x", truth=f"{folder}/known.txt", paths=f"{folder}/list").collect()
    assert {r.site for r in freq} == set(range(8)) and {r.pool for r in freq} == {0, 1, 2}  # of 12 sites four have a pool at 0
    text = files.lines(spark, f"{folder}/x_reads").select(run.pool_of(F.col("file"), ".vef").alias("pool")).groupBy("pool").count()
    assert {r.pool for r in text.collect()} == {0, 1, 2}


def test_reads_of_all_pools_are_one_job(spark, made):
    p, folder, _ = made
    rows = spark.createDataFrame([(k % 50, f"r{k}", f"r{k}:\t100={k % 2};\t//\t90\t110") for k in range(300)], "pool long, name string, line string")
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("pools", "")
    files.write_pools(rows, f"{folder}/many_reads")
    spark.sparkContext.setJobGroup("", "")
    assert len(jobs.getJobIdsForGroup("pools")) <= 2  # the shuffle of adaptive execution, and the write
    sites = spark.createDataFrame([(0, 100)], "site long, pos long")
    back = run.calls_of_files(spark, str(folder), "many", sites).collect()
    assert {(r.pool, r.read_id, r.allele) for r in back} == {(k % 50, f"{k % 50}:r{k}", k % 2) for k in range(300)}


def test_from_files_to_haplotypes_by_lists(spark, made):
    p, folder, _ = made
    run.reads_of_alignments(spark, p, "x", paths=f"{folder}/list")
    found = run.haplotypes_of_files(spark, p, "x").toPandas()
    assert np.allclose(found.groupby("pool")["freq"].sum(), 1)
    for k in range(3):
        (folder / f"named{k}.vef").write_text("\n".join(r["line"] for r in files.lines(spark, f"{folder}/x_reads/pool={k}").collect()))
    (folder / "reads").write_text("".join(f"{folder}/named{k}.vef\n" for k in range(3)))
    again = run.haplotypes_of_files(spark, p, "x", f"{folder}/reads").toPandas()
    key = ["pool", "hap"]
    assert np.allclose(found.sort_values(key)["freq"], again.sort_values(key)["freq"])


def test_mates_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    """Second mates a batch later; one that comes behind the watermark is left out."""
    r = np.random.default_rng(9)
    at = lambda minute: dt.datetime(2024, 1, 1, 12) + dt.timedelta(minutes=minute)
    schema = "ts timestamp, pool long, read_id string, record long, pos long, allele long, ord long"
    batches = [[], [], []]
    for i in range(40):
        for mate, batch in enumerate((batches[0], batches[1])):
            first = int(r.integers(0, 8)) + 3 * mate
            batch += [(at(i % 5 + 6 * mate), i % 2, f"r{i // 2}", mate, 100 * s, int(r.integers(0, 2)), k) for k, s in enumerate(range(first, first + 4))]
    batches[1].append((at(60), 1, "last", 0, 100, 1, 0))
    batches[2] += [(at(1), 0, "r0", 2, 9900, 1, 0), (at(200), 1, "end", 0, 100, 1, 0)]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    seen = tmp_path / "in"
    seen.mkdir()
    stream = spark.readStream.schema(schema).parquet(str(seen))
    q = mates.live_mates(stream).writeStream.outputMode("append").format("memory").queryName("linked").start()
    try:
        for k in range(3):
            part = next((tmp_path / f"part{k}").glob("*.parquet"))
            part.rename(seen / f"{k}.parquet")
            q.processAllAvailable()
        got = {(x.pool, x.read_id): ([tuple(c) for c in x.calls], [tuple(s) for s in x.spans]) for x in spark.table("linked").collect()}
    finally:
        q.stop()
    batch = reads.linked_mates(spark.createDataFrame([x for b in batches[:2] for x in b], schema)).collect()
    want = {(x.pool, x.read_id): ([tuple(c) for c in x.calls], [tuple(s) for s in x.spans]) for x in batch}
    assert got == want and len(got) == 41


def test_subsets_by_lot(spark, capsys):
    rows = spark.createDataFrame([(p, format(i, "08b"), 1.0) for p in range(3) for i in range(200)], "pool long, hap string, freq double")
    some = haplotypes.random_subset(rows, 30, "pool", seed=1)
    assert some.groupBy("pool").count().where("count = 30").count() == 3
    other = {r.hap for r in haplotypes.random_subset(rows, 30, "pool", seed=2).where("pool = 0").collect()}
    assert len(other & {r.hap for r in some.where("pool = 0").collect()}) < 15
    some.explain()
    assert "WindowGroupLimit" in capsys.readouterr().out


def test_matrices_in_pieces_are_the_lines(spark, tmp_path):
    """Whatever the width of a piece, the file is what whole lines make."""
    haps = spark.createDataFrame([(k, format(k * 7 % 32, "05b"), f"0.{k}") for k in range(23)], "hap_id long, hap string, value string")
    sites = spark.createDataFrame([(s, f"0;{s};{s};0:1") for s in range(5)], "site long, locus string")
    shares = spark.createDataFrame([(p, k, f"{p}.{k}") for p in (2, 10) for k in range(23)], "pool long, hap_id long, value string")
    for cells, rows in ((files.inter_cells(haps, sites), files.inter_lines(haps, sites)), (files.intra_cells(shares), files.intra_lines(shares))):
        want = "\n".join(r.line for r in rows.orderBy("ord").collect())
        for size in (1, 4, 23, 100):
            pieces = files.matrix_pieces(cells, size).orderBy("ord", "block").collect()
            assert "\t".join(p.piece for p in pieces) == want
            assert max(p.piece.count("\t") for p in pieces) <= size
        files.write_matrix(cells, str(tmp_path / "m"), 4)
        assert [x.line.rstrip("\t") for x in files.lines(spark, str(tmp_path / "m")).orderBy("ord").collect()] == want.split("\n")
    coded = {(r["ord"], r["col"]): r["value"] for r in files.inter_cells(haps, coded=True).where("ord >= 0").collect()}
    assert coded == {(s, k): f"{c}.0" for k in range(23) for s, c in enumerate(format(k * 7 % 32, "05b"))}


def test_two_chromosomes_share_positions(spark, tmp_path):
    """Reads and variants of two chromosomes at the same positions are kept apart from the alignments to the frequencies."""
    (tmp_path / "x.vcf").write_text("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t0\nchr1\t100\t.\tA\tT\t.\t.\t.\tGT:AD\t0:3,1\nchr1\t103\t.\tA\tT\t.\t.\t.\tGT:AD\t0:1,1\nchr2\t100\t.\tA\tC\t.\t.\t.\tGT:AD\t0:1,3\n")
    sam = [f"r{i}\t99\tchr{c}\t98\t60\t8M\t=\t1\t1\tAA{b}AAAAA\t{'I' * 8}\n" for c, b, n in (("1", "T", 3), ("1", "A", 1), ("2", "C", 2), ("2", "T", 2), ("9", "T", 5)) for i in range(n)]
    (tmp_path / "x_p0.srt.sam").write_text("".join(f"{k}{line}" for k, line in enumerate(sam)))
    p = params.Parameters(work_dir=str(tmp_path), output_dir=f"{tmp_path}/out")
    freq = {r.site: r.freq for r in run.reads_of_alignments(spark, p, "x").collect()}
    assert freq == {0: 0.75, 1: 0.0, 2: 0.5}
    sites = files.site_index(spark, f"{tmp_path}/x_vars.intra_freq.txt")
    assert [(r.site, r.chr, r.pos) for r in sites.orderBy("site").collect()] == [(0, "0", 100), (1, "0", 103), (2, "1", 100)]
    calls = run.calls_of_files(spark, str(tmp_path), "x", sites).groupBy("site").agg(F.avg("allele").alias("f"), F.count("*").alias("n")).collect()
    assert {r.site: (r.f, r.n) for r in calls} == {0: (0.75, 4), 1: (0.0, 4), 2: (0.5, 4)}
    depths = {r.site: r.freq for r in run.reads_of_alignments(spark, p, "x", "depths").collect()}
    assert depths == {0: 0.25, 1: 0.5, 2: 0.75}


def test_proportions_of_reads(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"0.{k}") for k in range(12)], "hap_id long, value string").repartition(4)
    files.write_proportions(rows, str(tmp_path / "p"))
    text = "".join(f.read_text() for f in sorted((tmp_path / "p").glob("part-*")))
    assert text == "Hap_ID\tProp_Recon\n" + "".join(f"{k}\t0.{k}\n" for k in range(12))


def test_the_command_line(spark, made):
    _, folder, _ = made
    (folder / "run.properties").write_text(f"Intermediate_Dir = {folder}/\nOutput_Dir = {folder}/out/\nLambda_Penalty = 0.02\n")
    run.main(["reads", f"{folder}/run.properties", "x", "--frequencies", "depths", "--truth", f"{folder}/known.txt", "--list", f"{folder}/list"])
    assert files.site_index(spark, f"{folder}/x_vars.intra_freq.txt").count() == 8
    run.main(["haplotypes", f"{folder}/run.properties", "x", "--weighted-gaps"])
    assert {r.pool for r in files.haplotype_set(spark, f"{folder}/out/x.inter_freq_vars.txt", f"{folder}/out/x.intra_freq.txt").select("pool").distinct().collect()} == {"0", "1", "2"}
    with pytest.raises(SystemExit):
        run.main(["nothing", "x", "y"])
