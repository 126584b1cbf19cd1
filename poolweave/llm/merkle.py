"""Merkle manifest of a dataset: a tree of the rows of each source, a tree over the sources, and a proof for each row.

Rows get their place in their source by one range sort (by source, doc_id, leaf); ARITY ** DEPTH neighbours are a block. A
block is one row that keeps each level of its part of the tree as one hex string: fixed-width substrings of a level, hashed,
are the string of the next, and the substrings beside a node are its siblings. Block roots are the nodes of the next tier,
in blocks again, until each source has one node; the sources' nodes are then the leaves of one more tree. Siblings come
back down the same way: each block hands what lies above it to its nodes, so a row meets its own path in its block. A hot
source is many blocks, dealt by (source, block). DataFrame functions only; no text is shuffled, only digests.

Defined results: a null column's field is `-`; a null or empty text is a leaf like any other; rows of one doc_id are ordered
by their leaf (equal rows are interchangeable), null doc_ids come first; null sources are a source of their own, before
all others; an empty table gives no rows; extra columns are ignored. A row with a null doc_id is not tampered with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import read, scratch, table

ARITY = 3
#: Levels of the tree within one block: 243 leaves, 15,552 bytes of hex.
DEPTH = 5
#: Bytes of a digest in hex.
WIDTH = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def field(x: Column) -> Column:
    """A value with its length in bytes before it, or `-`."""
    text = x.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(row: dict[str, Column]) -> Column:
    return sha(F.concat(*(field(row[c]) for c in FIELDS)))


def leaves(docs: DataFrame) -> DataFrame:
    """g (the source; empty if null), doc_id, digest, other: the leaf after tampering, where it is another one."""
    row = {c: F.col(f"`{c}`") for c in FIELDS}
    text = row["text"].cast("string")
    hit = (F.crc32(row["doc_id"].cast("string").cast("binary")) % 2 == 0) & F.contains(text, F.lit("\n"))
    other = F.when(hit, leaf(row | {"text": F.replace(text, F.lit("\n"), F.lit(""))}))
    source = F.coalesce(F.concat(F.lit("s"), row["source"].cast("string")), F.lit(""))
    return docs.select(source.alias("g"), row["doc_id"].cast("long").alias("doc_id"), leaf(row).alias("digest"), other.alias("other"))


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """rows with pos, the place in their g from 0, and n, the size of g. One range sort; what is added up over it is a row
    for each g in each sorted partition."""
    order = ("g", *order, "salt")  # many equal rows go to several tasks
    ordered = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = table(ordered.drop("salt").withColumn("id", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("id", 33)  # the id is the partition, then the place in it
    stats = ordered.groupBy("g", part.alias("part")).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("here"))
    by = Window.partitionBy("g")
    before = F.coalesce(F.sum("here").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    starts = stats.select("g", "part", (before - F.col("first")).alias("shift"), F.sum("here").over(by).alias("n"))
    return ordered.withColumn("part", part).join(starts, ["g", "part"]).withColumn("pos", F.col("id") + F.col("shift")).drop("id", "part", "shift")


def nodes_of(level: Column) -> Column:
    return (F.octet_length(level) / WIDTH).cast("int")


def cut(level: Column, start: Column, size: Column) -> Column:
    """Nodes of a level from start (from 0), as many as there are up to size."""
    return F.substring(level, start * WIDTH + 1, size * WIDTH)


def parents(level: Column) -> Column:
    runs = F.sequence(F.lit(0), F.ceil(nodes_of(level) / ARITY).cast("int") - 1)
    return F.array_join(F.transform(runs, lambda i: F.sha2(cut(level, i * ARITY, F.lit(ARITY)), 256)), "").cast("binary")


def blocks(nodes: DataFrame, depth: int, *payload: str) -> DataFrame:
    """g, block, n, rows (array: pos, digest, payload), levels (hex, from the leaves up to one node). nodes: g, pos, n, digest.

    All blocks of a g of several go through depth levels, a single one until one node is left.
    """
    size = ARITY**depth
    rows = F.array_sort(F.collect_list(F.struct("pos", "digest", *payload))).alias("rows")
    out = nodes.groupBy("g", F.floor(F.col("pos") / size).alias("block")).agg(F.first("n").alias("n"), rows)
    many = F.col("n") > size
    first = F.array(F.array_join(F.transform("rows", lambda r: r["digest"]), "").cast("binary"))
    grown = lambda s, _: F.when(many | (nodes_of(s[F.size(s) - 1]) > 1), F.concat(s, F.array(parents(s[F.size(s) - 1])))).otherwise(s)
    return out.withColumn("levels", F.aggregate(F.sequence(F.lit(1), F.lit(depth)), first, grown))


def siblings(levels: Column, place: Column) -> Column:
    """array<struct(l, r)>: what stands left and right of the node's own ancestor in its run, level by level."""

    def beside(level: Column, k: Column) -> Column:
        own = F.floor(place / F.pow(F.lit(float(ARITY)), k)).cast("int")
        inside = F.pmod(own, F.lit(ARITY))
        return F.struct(cut(level, own - inside, inside).alias("l"), cut(level, own + 1, F.lit(ARITY - 1) - inside).alias("r"))

    return F.transform(F.slice(levels, 1, F.size(levels) - 1), beside)


def tiers(nodes: DataFrame, depth: int, *payload: str) -> list[DataFrame]:
    """The written blocks of each tier, from the leaves up, until every g is one node (the last level of its one block)."""
    out = [table(blocks(nodes, depth, *payload), "blocks")]
    size = ARITY**depth
    most = out[0].agg(F.max("n")).first()[0] or 0
    while most > size:
        top = F.col("levels")[F.size("levels") - 1].cast("string")
        up = out[-1].select("g", F.col("block").alias("pos"), F.ceil(F.col("n") / size).alias("n"), top.alias("digest"))
        out.append(table(blocks(up, depth), "blocks"))
        most = -(-most // size)
    return out


def roots(top: DataFrame) -> DataFrame:
    return top.select("g", F.col("levels")[F.size("levels") - 1].cast("string").alias("digest"))


def opened(block_rows: DataFrame, above: DataFrame, size: int, *more: str) -> DataFrame:
    """A row for each node of the blocks: g, pos, what its struct has, path (its siblings up to the top), and more columns of
    above. above: g, block, path of the block's own root."""
    met = block_rows.join(above, ["g", "block"]).select("g", "block", "levels", F.col("path").alias("up"), *more, "rows")
    path = lambda r: F.concat(siblings(F.col("levels"), (r["pos"] - F.col("block") * size).cast("int")), F.col("up"))
    each = F.transform("rows", lambda r: F.struct(r.alias("row"), path(r).alias("path")))
    return met.select("g", *more, F.explode(each).alias("x")).select("g", *more, "x.row.*", "x.path")


def above_of(built: list[DataFrame], above: DataFrame, size: int, *more: str) -> DataFrame:
    """above (of the one block of each g in the last tier) carried down to the blocks of the first."""
    for t in reversed(built[1:]):
        above = opened(t, above, size, *more).select("g", F.col("pos").alias("block"), "path", *more)
    return above


def folded(path: Column, start: Column) -> Column:
    return F.aggregate(path, start, lambda h, s: F.sha2(F.concat(s["l"], h.cast("binary"), s["r"]), 256))


def manifest(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; also source and path, the siblings of the row from its
    own run up to the root: what its holder needs to prove that it is in the dataset."""
    size = ARITY**depth
    with scratch(docs.sparkSession) as work:
        built = tiers(placed(leaves(docs), "doc_id", "digest"), depth, "doc_id", "other")
        # the sources' tree: g is one for all, the name orders it
        subroots = table(roots(built[-1]).withColumnRenamed("g", "name").withColumn("g", F.lit("")), "subroots")
        over = tiers(placed(subroots, "name"), depth, "name")
        root = roots(over[-1]).select(F.col("digest").alias("root"))  # one row
        start = over[-1].select("g", "block", F.array().cast("array<struct<l:binary,r:binary>>").alias("path")).crossJoin(F.broadcast(root))
        sources = opened(over[0], above_of(over, start, size, "root"), size, "root")
        top = sources.select(F.col("name").alias("g"), F.lit(0).cast("long").alias("block"), "path", F.col("digest").alias("subroot"), "root")
        rows = opened(built[0], above_of(built, top, size, "subroot", "root"), size, "subroot", "root")
        proof = F.aggregate("path", F.lit(b"").cast("binary"), lambda s, p: F.concat(s, p["l"], p["r"]))
        out = rows.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"), folded(F.col("path"), F.coalesce("other", "digest")).alias("folded_root"), F.when(F.col("g") != "", F.substring("g", 2, 1 << 30)).alias("source"), "path")
        return work.result(out.withColumn("verified", F.col("folded_root") == F.col("root")), "manifest")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(read(spark, sf_dir, "documents")).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


#: One round of the tree's recursion is one level of all sources, then one of the tree over them.
SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, source, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head, text,
  list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS crc FROM documents),
leaves AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
  CASE WHEN xor(crc, 4294967295) % 2 = 0 AND text IS NOT NULL THEN sha256(head || strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), '')) END AS other FROM t),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM leaves),
tree(k, s, pos, h) AS (SELECT 0, s, pos, leaf FROM placed
  UNION ALL SELECT k + 1, s, p, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT k, s, pos, h, pos // 3 AS p, max(pos) OVER (PARTITION BY s) AS last FROM tree) WHERE last > 0 GROUP BY k, s, p),
subroots AS (SELECT s, arg_max(h, k) AS h, max(k) AS k FROM tree GROUP BY s),
over_(k, pos, h) AS (SELECT 0, s, h FROM subroots
  UNION ALL SELECT k + 1, p, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT k, pos, h, pos // 3 AS p, max(pos) OVER () AS last FROM over_) WHERE last > 0 GROUP BY k, p),
root AS (SELECT arg_max(h, k) AS h, max(k) AS k FROM over_),
steps AS (SELECT p.doc_id, p.pos AS id, p.s, i AS step, tr.k AS level,
    coalesce(string_agg(tr.h, '' ORDER BY tr.pos) FILTER (tr.pos < p.pos // CAST(3 ** i AS BIGINT)), '') AS l, coalesce(string_agg(tr.h, '' ORDER BY tr.pos) FILTER (tr.pos > p.pos // CAST(3 ** i AS BIGINT)), '') AS r
  FROM placed p JOIN subroots u USING (s) JOIN range(40) g(i) ON i < u.k JOIN tree tr ON tr.s = p.s AND tr.k = i AND tr.pos // 3 = p.pos // CAST(3 ** (i + 1) AS BIGINT) GROUP BY ALL),
high AS (SELECT u.s, i AS step, coalesce(string_agg(o.h, '' ORDER BY o.pos) FILTER (o.pos < u.s // CAST(3 ** i AS BIGINT)), '') AS l, coalesce(string_agg(o.h, '' ORDER BY o.pos) FILTER (o.pos > u.s // CAST(3 ** i AS BIGINT)), '') AS r
  FROM subroots u, root, range(40) g(i) JOIN over_ o ON o.k = i AND o.pos // 3 = u.s // CAST(3 ** (i + 1) AS BIGINT) WHERE i < root.k GROUP BY ALL),
paths AS (SELECT s, id, list(struct_pack(l := l, r := r) ORDER BY step) AS path FROM (SELECT s, id, step, l, r FROM steps UNION ALL SELECT p.s, p.pos, 1000 + h.step, h.l, h.r FROM placed p JOIN high h USING (s)) GROUP BY s, id),
joined AS (SELECT p.doc_id, p.leaf, u.h AS subroot, root.h AS root, coalesce(q.path, []) AS path, coalesce(p.other, p.leaf) AS start FROM placed p JOIN subroots u USING (s) CROSS JOIN root LEFT JOIN paths q ON q.s = p.s AND q.id = p.pos),
folds(doc_id, leaf, subroot, root, path, i, h) AS (SELECT doc_id, leaf, subroot, root, path, 0, start FROM joined
  UNION ALL SELECT doc_id, leaf, subroot, root, path, i + 1, sha256(path[i + 1].l || h || path[i + 1].r) FROM folds WHERE i < len(path))
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x.l || x.r), '')) AS proof_sha256, h AS folded_root, h = root AS verified FROM folds WHERE i = len(path)
"""
