"""From alignments to allele calls: filters, CIGAR walk, variant lookup, mate linking, read text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_FLAG = 163
CIGAR = r"^(\d+[MIDSH])+$"
#: Blocks of a range join: bits of the least size, bits from one size to the next, and how many there are (16 to 2^31).
LADDER = (4, 3, 10)


def usable(sam: DataFrame) -> DataFrame:
    """Alignments with a flag up to MAX_FLAG and a CIGAR."""
    return sam.where((F.col("flag") <= MAX_FLAG) & (F.col("cigar") != "*"))


def cigar_ops(cigar: Column) -> Column:
    """array<struct(len, op)>; null if the text holds anything but the operations M, I, D, S, H."""
    parts = F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDSH])"), F.lit(1))
    ops = F.transform(parts, lambda p: F.struct(F.left(p, F.length(p) - 1).cast("long").alias("len"), F.right(p, F.lit(1)).alias("op")))
    return F.when(cigar.rlike(CIGAR), ops)


def walked(ops: Column) -> Column:
    """array<struct(op, len, ref, query)>: where each operation starts in reference and read, from 0.

    M moves both, I and S the read, D the reference, H neither.
    """
    start = F.struct(F.lit(0).cast("long").alias("ref"), F.lit(0).cast("long").alias("query"), F.array().cast("array<struct<op:string,len:bigint,ref:bigint,query:bigint>>").alias("out"))

    def step(s: Column, o: Column) -> Column:
        ref = s["ref"] + F.when(o["op"].isin("M", "D"), o["len"]).otherwise(0)
        query = s["query"] + F.when(o["op"].isin("M", "I", "S"), o["len"]).otherwise(0)
        here = F.struct(o["op"].alias("op"), o["len"].alias("len"), s["ref"].alias("ref"), s["query"].alias("query"))
        return F.struct(ref.alias("ref"), query.alias("query"), F.concat(s["out"], F.array(here)).alias("out"))

    return F.aggregate(ops, start, step, lambda s: s["out"])


def place(*tables: DataFrame) -> list[str]:
    """What tells a position: chr and pos, where all tables name chromosomes, or else pos alone."""
    return ["chr", "pos"] if all("chr" in t.columns for t in tables) else ["pos"]


def inside(spans: DataFrame, sites: DataFrame) -> DataFrame:
    """spans (start, end and anything else) with each site (pos and anything else) inside them."""
    return near(spans, sites).where(F.col("pos").between(F.col("start"), F.col("end")))


def near(spans: DataFrame, sites: DataFrame) -> DataFrame:
    """spans with each site in their blocks of positions (of a chromosome, where both have chr), once. A span meets blocks of the least size of LADDER that is not below its
    length, so it lies in one or two and what it is compared with grows with its own length, however dense the sites are.
    A site is a row for each size; Spark broadcasts them where they are few."""
    by = place(spans, sites)[:-1]
    sites = sites if by else sites.drop("chr")
    first, step, sizes = LADDER
    spark = spans.sparkSession
    # bits of the length, up to the next size; beyond the largest a span lies in more than two
    bits = F.length(F.bin(F.greatest(F.col("end") - F.col("start"), F.lit((1 << first) - 1))))
    size = F.least(F.ceil((bits - first) / step) * step + first, F.lit(first + step * (sizes - 1))).cast("int")
    block = lambda c: F.call_function("shiftright", F.col(c).cast("long"), F.col("size"))
    blocks = spans.withColumn("size", size).withColumn("block", F.explode(F.sequence(block("start"), block("end"))))
    ladder = spark.range(sizes).select((F.col("id") * step + first).cast("int").alias("size"))
    places = sites.crossJoin(F.broadcast(ladder)).withColumn("block", block("pos"))
    return blocks.join(places, [*by, "size", "block"]).drop("size", "block")


def sites_in_span(spans: DataFrame, sites: DataFrame) -> DataFrame:
    """spans (pool, read_id, start, end) with each site's pos inside them."""
    return inside(spans, sites.select("pos").distinct()).select("pool", "read_id", "pos")


def emitted(covered: DataFrame, calls: DataFrame) -> DataFrame:
    """covered (pool, read_id, pos) with the allele called there, 0 where none was."""
    return covered.join(calls.select("pool", "read_id", "pos", "allele"), ["pool", "read_id", "pos"], "left").select("pool", "read_id", "pos", F.coalesce("allele", F.lit(0).cast("long")).alias("allele"))


def base_calls(sam: DataFrame, variants: DataFrame, *keep: str) -> DataFrame:
    """pool, read_id, pos, allele, start and end of the alignment, and columns to keep, for every variant site in its span.

    sam: pool, read_id, flag, pos, cigar, seq; variants: pos, alt, code; chr, where both have it, comes back too. Only sites are exploded, never bases: an
    alignment is walked once, into a text with a letter for each reference position ('-' where it is deleted) and the few
    insertions; for each site the letter (and what is inserted behind it) is cut out and looked up among the site's variants.
    """
    at_ = place(sam, variants)
    keep = (*keep, *at_[:-1])
    rows = usable(sam).where(F.col("cigar").rlike(CIGAR)).withColumn("walk", walked(cigar_ops(F.col("cigar"))))
    part = lambda o: F.substring(F.col("seq"), (o["query"] + 1).cast("int"), o["len"].cast("int"))
    # a sequence that ends too early leaves blanks, which are no bases
    letters = F.transform("walk", lambda o: F.when(o["op"] == "M", F.rpad(part(o), o["len"].cast("int"), F.lit(" "))).when(o["op"] == "D", F.repeat(F.lit("-"), o["len"].cast("int"))).otherwise(""))
    # an insertion hangs on the base before it
    inserts = F.transform(F.filter("walk", lambda o: o["op"] == "I"), lambda o: F.struct((o["ref"] - 1).alias("at"), part(o).alias("text")))
    ref = F.aggregate("walk", F.lit(0).cast("long"), lambda s, o: s + F.when(o["op"].isin("M", "D"), o["len"]).otherwise(0))
    # exploded, as what a generator yields is worked out once for an alignment and not again behind the join, for each site
    once = F.explode(F.array(F.struct(F.array_join(letters, "").alias("letters"), inserts.alias("inserts"), (F.col("pos") + ref - 1).alias("end"))))
    spans = rows.select("pool", "read_id", *keep, F.col("pos").alias("start"), once.alias("x")).select("pool", "read_id", *keep, "start", "x.end", "x.letters", "x.inserts")
    sites = variants.groupBy(*at_).agg(F.collect_list(F.struct(F.col("alt").alias("seen"), F.col("code").cast("long").alias("code"))).alias("alts"))
    offset = F.col("pos") - F.col("start")
    letter = F.substring("letters", (offset + 1).cast("int"), F.lit(1))
    extra = F.when(F.size("inserts") > 0, F.coalesce(F.get(F.filter("inserts", lambda x: x["at"] == offset), 0)["text"], F.lit(""))).otherwise("")
    seen = inside(spans, sites).select("pool", "read_id", *keep, "start", "end", "pos", F.when(letter != "-", F.concat(F.rtrim(letter), extra)).alias("seen"), "alts")
    hit = seen.withColumn("hit", F.explode_outer(F.filter("alts", lambda a: a["seen"] == F.col("seen"))))
    return hit.select("pool", "read_id", *keep, "start", "end", "pos", F.coalesce("hit.code", F.lit(0).cast("long")).alias("allele"))


def numbered(sites: DataFrame) -> DataFrame:
    """sites (pos, chr where there are several, and anything else) with site: their number by position. Sites, few beside
    reads, meet in one window."""
    return sites.withColumn("site", (F.row_number().over(Window.orderBy(*place(sites))) - 1).cast("long"))


def site_calls(calls: DataFrame, sites: DataFrame) -> DataFrame:
    """calls (pool, read_id, pos, allele) at known sites (site, pos), by number of site; calls elsewhere go. Both may have chr."""
    at = place(calls, sites)
    return calls.join(sites.select("site", *at), at).select("pool", "read_id", "site", "allele")


def linked_mates(records: DataFrame) -> DataFrame:
    """pool, read_id, pos, allele, and spans: the records of one name become one read.

    records: pool, read_id, record (its place in the file), pos, allele, ord (place in the record). At each position the
    earliest record, then the first call, stays: an aggregate by (read, position), then one by read for the order. A
    record's span is that of its start and end, where it has them, else of its calls.
    """
    first = F.min(F.struct("record", "ord", "allele")).alias("x")
    calls = records.groupBy("pool", "read_id", "pos").agg(first).select("pool", "read_id", "pos", F.col("x.allele").alias("allele"))
    ends = ("start", "end") if "start" in records.columns else ("pos", "pos")
    spans = records.groupBy("pool", "read_id", "record").agg(F.min(ends[0]).alias("start"), F.max(ends[1]).alias("end"))
    text = calls.groupBy("pool", "read_id").agg(F.array_sort(F.collect_list(F.struct("pos", "allele"))).alias("calls"))
    ranges = spans.groupBy("pool", "read_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    return text.join(ranges, ["pool", "read_id"])


def read_line(name: Column, calls: Column, spans: Column) -> Column:
    """Text of one read: name, calls, //, and start and end of each span, by tabs."""
    token = F.transform(calls, lambda c: F.concat(c["pos"].cast("string"), F.lit("="), c["allele"].cast("string"), F.lit(";")))
    ends = F.transform(spans, lambda s: F.concat_ws("\t", s["start"].cast("string"), s["end"].cast("string")))
    return F.concat_ws("\t", F.concat(name.cast("string"), F.lit(":")), F.array_join(token, ""), F.lit("//"), F.array_join(ends, "\t"))


def parsed_line(line: Column) -> Column:
    """struct(read_id, calls array<struct(pos, allele)>) of such a text; calls are null where the line holds none."""
    part = F.split(line, "\t")
    tokens = F.filter(F.split(F.get(part, 1), ";"), lambda t: t.contains("="))
    calls = F.transform(tokens, lambda t: F.struct(F.split(t, "=")[0].cast("long").alias("pos"), F.split(t, "=")[1].alias("allele")))
    return F.struct(F.rtrim(F.get(part, 0), F.lit(":")).alias("read_id"), F.when(F.get(part, 1).contains("="), calls).alias("calls"))


def first_variants(vcf: DataFrame, *keep: str) -> DataFrame:
    """pos (and chr, where there is one), alt, code of the first alternative at each position, and columns of its record to
    keep; others count as the reference. Where several records have a position, the first in the file counts (column record,
    where there is one), or else the least text."""
    alt = F.get(F.split(F.regexp_replace("alt", '"', ""), ","), 0)
    order = F.struct(*(F.col(c) for c in ("record",) if c in vcf.columns), alt.alias("alt"))
    return vcf.groupBy(*place(vcf)).agg(F.min(order).alias("x")).select(*place(vcf), "x.alt", F.lit(1).cast("long").alias("code"), *(f"x.{c}" for c in keep))
