"""Readers and writers of the text formats: matrices, reads, drafts, variants, alignments, plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.locus import parsed
from ..operators.colouring import draft_line
from ..operators.reads import parsed_line, read_line


Path = str | list[str]


def lines(spark: SparkSession, path: Path) -> DataFrame:
    """line, file, ord (orders the lines of a file); carriage returns dropped."""
    return spark.read.text(path).select(F.regexp_replace("value", "\r", "").alias("line"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ord"))


def path_list(spark: SparkSession, path: str) -> list[str]:
    """The paths that a list names, one in a line: as many as pools."""
    return [r["line"].strip() for r in lines(spark, path).orderBy("ord").collect() if r["line"].strip()]


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def plain_path(path: Column) -> Column:
    """A path without what only says that it is a local file."""
    return F.regexp_replace(path, "^file:/+", "/")


def listed(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """The paths of a list, and file (as plain_path has it), pool: the first is pool 0."""
    names = path_list(spark, path)
    rows = spark.createDataFrame(list(enumerate(names)), "pool long, name string")
    return names, rows.select(plain_path(F.col("name")).alias("file"), "pool")


def matrix(spark: SparkSession, path: Path) -> DataFrame:
    """file, ord, key, column, value of tab-separated matrices, each with its own header; empty names behind a trailing tab
    are dropped.

    Comment lines start with #. Long form: one row for each cell.
    """
    rows = lines(spark, path).where(~F.col("line").startswith("#") & (F.col("line") != ""))
    cells = rows.select("file", "ord", F.split("line", "\t").alias("c"))
    top = F.get("c", 0).isin("Pool_ID", "Hap_ID")
    header = cells.where(top).select("file", F.posexplode("c").alias("i", "column")).where("i > 0 AND column <> ''")
    body = cells.where(~top).select("file", "ord", F.get("c", 0).alias("key"), F.posexplode("c").alias("i", "value")).where("i > 0")
    return body.join(header, ["file", "i"]).select("file", "ord", "key", "column", "value")


def site_index(spark: SparkSession, path: Path) -> DataFrame:
    """site (numbered from 0 in the order of the lines), chr, pos, locus of a file of site frequencies. Sites, few beside reads,
    are numbered in one window."""
    rows = lines(spark, path).where(~F.col("line").startswith("#") & ~F.col("line").startswith("Pool_ID") & (F.col("line") != ""))
    rows = rows.select("ord", F.get(F.split("line", "\t"), 0).alias("locus"))
    return rows.select((F.row_number().over(Window.orderBy("ord")) - 1).cast("long").alias("site"), F.get(F.split("locus", ";"), 0).alias("chr"), F.get(F.split("locus", ";"), 1).cast("long").alias("pos"), "locus")


def site_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """locus, pool, freq, and the locus taken apart."""
    return matrix(spark, path).select(F.col("key").alias("locus"), F.col("column").alias("pool"), F.col("value").cast("double").alias("freq"), parsed(F.col("key")).alias("at"))


def haplotype_set(spark: SparkSession, inter: str, intra: str | None = None) -> DataFrame:
    """hap_id, freq, locus, allele from an inter file; with an intra file also pool and in_pool."""
    cells = matrix(spark, inter)
    freq = cells.where("key = 'Freq'").select(F.col("column").alias("hap_id"), F.col("value").cast("double").alias("freq"))
    alleles = cells.where("key <> 'Freq'").select(F.col("column").alias("hap_id"), F.col("key").alias("locus"), F.col("value").alias("allele"))
    out = alleles.join(freq, "hap_id")
    if intra is None:
        return out
    shares = matrix(spark, intra).select(F.col("key").alias("pool"), F.col("column").alias("hap_id"), F.col("value").cast("double").alias("in_pool"))
    return out.join(shares, "hap_id")


def reads(spark: SparkSession, path: Path) -> DataFrame:
    """file, read_id, calls of read text that holds any call."""
    rows = lines(spark, path).select("file", parsed_line(F.col("line")).alias("r")).where(F.col("r.calls").isNotNull())
    return rows.select("file", "r.read_id", "r.calls")


def drafts(spark: SparkSession, path: Path) -> DataFrame:
    """file, hap, links, n of draft text: alleles and links in turn, a tab, the count."""
    part = F.split("line", "\t")
    body = F.get(part, 0)
    rows = lines(spark, path).where(~F.col("line").startswith("#") & F.col("line").contains("\t"))
    return rows.select("file", F.regexp_replace(body, "[-?]", "").alias("hap"), F.regexp_replace(body, "[^-?]", "").alias("links"), F.get(part, 1).cast("long").alias("n"))


def variants(spark: SparkSession, path: Path) -> DataFrame:
    """record (orders the lines), chr, pos, ref, alt, pool, ref_depth, alt_depth from variant text: samples are named by pool in
    the header line of their file."""
    rows = lines(spark, path)
    header = rows.where(F.col("line").startswith("#CHROM")).select("file", F.posexplode(F.split("line", "\t")).alias("i", "pool")).where("i >= 9")
    body = rows.where(~F.col("line").startswith("#") & (F.col("line") != "")).select("file", "ord", F.split("line", "\t").alias("c"))
    cells = body.select("file", F.col("ord").alias("record"), F.get("c", 0).alias("chr"), F.get("c", 1).cast("long").alias("pos"), F.get("c", 3).alias("ref"), F.get("c", 4).alias("alt"), F.get("c", 8).alias("format"), F.posexplode("c").alias("i", "cell")).where("i >= 9")
    return depths(cells.join(header, ["file", "i"]))


def depths(cells: DataFrame) -> DataFrame:
    """Allele depths (the AD field) of sample cells: pos, ref, alt, format, pool, cell."""
    place = F.array_position(F.split("format", ":"), "AD").cast("int")
    ad = F.split(F.get(F.split("cell", ":"), place - 1), ",")
    return cells.select(*(c for c in ("record", "chr") if c in cells.columns), "pos", "ref", "alt", "pool", F.coalesce(F.get(ad, 0).try_cast("long"), F.lit(0).cast("long")).alias("ref_depth"), F.coalesce(F.get(ad, 1).try_cast("long"), F.lit(0).cast("long")).alias("alt_depth"))


def alignments(spark: SparkSession, path: Path) -> DataFrame:
    """file, record (orders the lines), read_id, flag, chr, pos, cigar, seq; header lines start with @."""
    part = F.split("line", "\t")
    rows = lines(spark, path).where(~F.col("line").startswith("@") & (F.size(part) >= 11))
    return rows.select("file", F.col("ord").alias("record"), F.translate(F.get(part, 0), ":", "").alias("read_id"), F.get(part, 1).cast("int").alias("flag"), F.get(part, 2).alias("chr"), F.get(part, 3).cast("long").alias("pos"), F.get(part, 5).alias("cigar"), F.get(part, 9).alias("seq"))


def row_line(key: Column, ordered: Column) -> Column:
    return F.concat_ws("\t", key, F.array_join(F.transform(F.array_sort(ordered), lambda c: c["value"]), "\t"))


def intra_lines(shares: DataFrame) -> DataFrame:
    """ord, line: header, then a line for each pool. shares: pool, hap_id, value (text); every haplotype in every pool."""
    header = shares.agg(F.array_sort(F.collect_set("hap_id")).alias("h")).select(F.lit(-1).cast("long").alias("ord"), F.concat_ws("\t", F.lit("Hap_ID"), F.array_join(F.transform("h", lambda x: x.cast("string")), "\t")).alias("line"))
    body = shares.groupBy("pool").agg(F.collect_list(F.struct("hap_id", "value")).alias("c")).select(F.col("pool").cast("long").alias("ord"), row_line(F.col("pool").cast("string"), F.col("c")).alias("line"))
    return header.unionAll(body)


def inter_lines(haps: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """ord, line: header, frequencies, then a line of alleles for each site. haps: hap_id, hap, value (text of freq).
    sites: site, locus; without them a line begins with the number of its site, else with its locus key."""
    many = haps.select("hap_id", "value", F.filter(F.split("hap", ""), lambda a: a != "").alias("a"))
    top = haps.agg(F.array_sort(F.collect_list(F.struct("hap_id", "value"))).alias("h"))
    header = top.select(F.lit(-2).cast("long").alias("ord"), F.concat_ws("\t", F.lit("Hap_ID"), F.array_join(F.transform("h", lambda x: x["hap_id"].cast("string")), "\t")).alias("line"))
    freq = top.select(F.lit(-1).cast("long").alias("ord"), F.concat_ws("\t", F.lit("Freq"), F.array_join(F.transform("h", lambda x: x["value"]), "\t")).alias("line"))
    cells = many.select("hap_id", F.posexplode("a").alias("site", "value"))
    rows = cells.groupBy(F.col("site").cast("long").alias("site")).agg(F.collect_list(F.struct("hap_id", "value")).alias("c"))
    rows = rows.withColumn("locus", F.col("site").cast("string")) if sites is None else rows.join(sites.select("site", "locus"), "site")
    body = rows.select(F.col("site").alias("ord"), row_line(F.col("locus"), F.col("c")).alias("line"))
    return header.unionAll(freq).unionAll(body)


def freq_lines(freq: DataFrame, sites: DataFrame) -> DataFrame:
    """ord, line: header, then a line of the pools' frequencies for each site. freq: pool, site, value (text); 0.0 where a
    pool does not cover a site. sites: site, locus."""
    pools = freq.agg(F.array_sort(F.collect_set("pool")).alias("p"))
    header = pools.select(F.lit(-1).cast("long").alias("ord"), F.concat_ws("\t", F.lit("Pool_ID"), F.array_join(F.transform("p", lambda x: x.cast("string")), "\t")).alias("line"))
    cells = freq.groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("pool", "value"))).alias("m"))
    rows = sites.select("site", "locus").join(cells, "site", "left").crossJoin(F.broadcast(pools))  # one row
    values = F.transform("p", lambda x: F.coalesce(F.try_element_at("m", x), F.lit("0.0")))
    return header.unionAll(rows.select(F.col("site").alias("ord"), F.concat_ws("\t", "locus", F.array_join(values, "\t")).alias("line")))


#: Values of a line of a matrix that one row holds.
PIECE = 4096


def inter_cells(haps: DataFrame, sites: DataFrame | None = None, coded: bool = False) -> DataFrame:
    """ord, key, col, value: the cells of the lines that inter_lines makes; with coded, alleles are numbers (0.0, 1.0)."""
    top = haps.select(F.explode(F.array(F.struct(F.lit(-2).cast("long").alias("ord"), F.lit("Hap_ID").alias("key"), F.col("hap_id").cast("string").alias("value")), F.struct(F.lit(-1).cast("long").alias("ord"), F.lit("Freq").alias("key"), F.col("value")))).alias("x"), F.col("hap_id").alias("col"))
    allele = F.col("allele").cast("double").cast("string") if coded else F.col("allele")
    cells = haps.select("hap_id", F.posexplode(F.filter(F.split("hap", ""), lambda a: a != "")).alias("site", "allele")).select(F.col("site").cast("long").alias("ord"), F.col("hap_id").alias("col"), allele.alias("value"))
    keys = cells.withColumn("key", F.col("ord").cast("string")) if sites is None else cells.join(sites.select(F.col("site").alias("ord"), F.col("locus").alias("key")), "ord")
    return top.select("x.ord", "x.key", "col", "x.value").unionByName(keys)


def intra_cells(shares: DataFrame) -> DataFrame:
    """ord, key, col, value: the cells of the lines that intra_lines makes."""
    header = shares.select("hap_id").distinct().select(F.lit(-1).cast("long").alias("ord"), F.lit("Hap_ID").alias("key"), F.col("hap_id").alias("col"), F.col("hap_id").cast("string").alias("value"))
    return header.unionByName(shares.select(F.col("pool").cast("long").alias("ord"), F.col("pool").cast("string").alias("key"), F.col("hap_id").alias("col"), "value"))


def matrix_pieces(cells: DataFrame, size: int = PIECE) -> DataFrame:
    """ord, block, piece: a matrix as pieces of at most size columns of a line. Pieces joined by tabs are the text: the last one
    of a line also holds its end and the key of the next line, so that every border lies between two values."""
    at = F.floor(F.col("col") / size).alias("block")
    text = cells.groupBy("ord", at).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda c: c["value"]), "\t").alias("text"))
    # lines are as many as sites or pools: their keys meet in one window
    lines_ = cells.groupBy("ord", "key").agg(F.floor(F.max("col") / size).alias("last"), F.floor(F.min("col") / size).alias("first"))
    every = Window.orderBy("ord")
    lines_ = lines_.select("ord", "first", "last", F.when(F.row_number().over(every) == 1, F.col("key")).alias("own"), F.lead("key").over(every).alias("next"))
    own = F.when(F.col("own").isNotNull() & (F.col("block") == F.col("first")), F.concat("own", F.lit("\t"))).otherwise("")
    following = F.when(F.col("next").isNotNull() & (F.col("block") == F.col("last")), F.concat(F.lit("\n"), "next")).otherwise("")
    return text.join(lines_, "ord").select("ord", "block", F.concat(own, "text", following).alias("piece"))


def write_matrix(cells: DataFrame, path: str, size: int = PIECE) -> None:
    """One text file; no row is longer than a piece. A tab follows the last value, as readers allow."""
    matrix_pieces(cells, size).orderBy("ord", "block").select("piece").coalesce(1).write.mode("overwrite").option("lineSep", "\t").text(path)


def write_haplotypes(found: DataFrame, sites: DataFrame, inter: str, intra: str) -> None:
    """Both files of a haplotype set. found: hap_id, hap, pool, freq, mean_freq, every haplotype in every pool."""
    text = lambda c: F.col(c).cast("string").alias("value")
    write_matrix(inter_cells(found.select("hap_id", "hap", "mean_freq").distinct().select("hap_id", "hap", text("mean_freq")), sites), inter)
    write_matrix(intra_cells(found.select("pool", "hap_id", text("freq"))), intra)


def write_lines(rows: DataFrame, path: str) -> None:
    """ord, line as one text file in that order: matrices have as many lines as sites or pools."""
    rows.orderBy("ord").select("line").coalesce(1).write.mode("overwrite").text(path)


def proportion_lines(rows: DataFrame) -> DataFrame:
    """ord, line: header, then a line for each haplotype. rows: hap_id, value (text of the share of its sites that is known)."""
    header = rows.sparkSession.createDataFrame([(-1, "Hap_ID\tProp_Recon")], "ord long, line string")
    return header.unionAll(rows.select(F.col("hap_id").cast("long").alias("ord"), F.concat_ws("\t", F.col("hap_id").cast("string"), "value").alias("line")))


def write_proportions(rows: DataFrame, path: str) -> None:
    """One line for each haplotype of a read, so as many files as that takes, in order."""
    proportion_lines(rows).orderBy("ord").select("line").write.mode("overwrite").text(path)


def write_reads(rows: DataFrame, path: str) -> None:
    """read_id, calls, spans, as many files as partitions."""
    rows.select(read_line(F.col("read_id"), F.col("calls"), F.col("spans"))).write.mode("overwrite").text(path)


def write_pools(rows: DataFrame, path: str, salts: int = 8) -> None:
    """pool, name and line of text, as one folder of a folder for each pool: one job, whatever the pools. A pool is written
    by salts tasks at most."""
    dealt = rows.repartition("pool", F.pmod(F.xxhash64("name"), F.lit(salts)))
    dealt.select("pool", "line").write.mode("overwrite").partitionBy("pool").text(path)


def write_drafts(rows: DataFrame, path: str) -> None:
    rows.select(draft_line(F.col("hap"), F.col("links"), F.col("n"))).write.mode("overwrite").text(path)


def plan_lines(regions: DataFrame) -> DataFrame:
    """ord, line: a title and the ranges of each level."""
    by = regions.groupBy("level").agg(F.array_sort(F.collect_list(F.struct("region", F.concat_ws(":", "first_site", "last_site").alias("r")))).alias("c"))
    title = F.when(F.col("level") == 1, "Level_I").otherwise("Level_II")
    return by.select((F.col("level") * 2).alias("ord"), title.alias("line")).unionAll(by.select((F.col("level") * 2 + 1).alias("ord"), F.array_join(F.transform("c", lambda x: x["r"]), "\t").alias("line")))


def write_libsvm(rows: DataFrame, path: str) -> None:
    """label, features (array) in libsvm text."""
    cells = F.filter(F.transform("features", lambda x, i: F.when(x != 0, F.concat((i + 1).cast("string"), F.lit(":"), x.cast("string")))), lambda x: x.isNotNull())
    rows.select(F.concat_ws(" ", F.col("label").cast("string"), F.array_join(cells, " "))).write.mode("overwrite").text(path)


def libsvm(spark: SparkSession, path: Path, size: int) -> DataFrame:
    """label, features (array of that size) from libsvm text."""
    part = F.split("line", " ")
    cells = F.map_from_entries(F.transform(F.filter(F.slice(part, 2, 1 << 30), lambda t: t != ""), lambda t: F.struct(F.split(t, ":")[0].cast("int").alias("i"), F.split(t, ":")[1].cast("double").alias("x"))))
    rows = lines(spark, path).where("line <> ''").select(F.get(part, 0).cast("double").alias("label"), cells.alias("m"))
    return rows.select("label", F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("features"))
