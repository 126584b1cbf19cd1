"""N-gram Jaccard join by prefix filters under several global orders.

A document is its set of word 5-grams. Two sets of Jaccard similarity t or more share a token within their prefixes
(the first n - ceil(t n) + 1 tokens) under any global order of tokens, so a candidate pair must do so under every
order. Order 1 is by how many documents hold a token, rare ones first (counted over the whole corpus, see chunks.py):
tokens of one document only can match nothing and fill most prefixes, so nearly all documents end there. The other
orders put those tokens first too and go on by independent hashes; a pair whose prefixes miss each other under one of
them is dropped before its sets are compared. What passes all orders is verified exactly.

Equal sets are one class, represented by their smallest doc_id. Links are wanted up to components, so rounds of hubs
(each document against one representative of its token lists) join large groups of near copies first; afterwards every
pair of documents of different components that passes the filters is verified: no link between components is lost.
What is left on a token's list in that last round are documents that may not link at all (pages of one template). A
list of more than LONG of them is not paired: its documents meet by that token and one of their prefix under the second
order together, so only pairs that pass both orders are ever made.

Defined results: documents without words (null, empty, blank) have n_shingles 0, no links and themselves as component;
with fewer than five words the whole sequence is the one shingle; rows repeated under one doc_id count as one document
(the union of their links; the largest n_shingles is reported); rows without doc_id are left out of the links and
come back one by one with null component; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import answers, chunked, count_bits, counted
from .graph import components
from .shared import distinct, lower_ascii, mix, read, scratch, table, utf8

N = 5
PERCENT = 80
ORDERS = 3
HUB_ROUNDS = 2
#: Documents of different components on the list of one token, beyond which they meet by two tokens of two orders.
LONG = 64
SALT = np.uint64(0x9E3779B97F4A7C15)


def tokens(texts: list[str | None], n: int = N) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each whole text."""
    ids: dict[bytes, int] = {}
    each = []
    for t in texts:
        words = lower_ascii(utf8(t)).split()
        for w in words:
            if w not in ids:
                ids[w] = len(ids)
        each.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, ids), np.uint64, len(ids))
    out = []
    for x in each:
        h, size = hashes[x], min(n, len(x))
        code = np.full(max(0, len(x) - size + 1) if size else 0, size, np.uint64)
        for k in range(size):
            code = mix(code + h[k : len(h) - size + 1 + k])
        out.append(distinct(code))
    return out


def short(x: np.ndarray, bits: int) -> np.ndarray:
    """What is counted over the corpus: the upper bits of a token."""
    return x >> np.uint64(64 - bits)


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def count_keys(rows: pa.Table, bits: int) -> tuple[np.ndarray, np.ndarray]:
    each = tokens(rows.column("text").to_pylist())
    return np.unique(np.concatenate([short(x, bits) for x in each]), return_counts=True)


DOCS = "doc_id long, n_shingles long, h1 long, h2 long, weight double, skipped long, prefix array<long>, second array<long>, others binary, tokens binary"


def documents(rows: pa.Table, found: pa.Table, bits: int) -> pa.Table:
    """A row per document. prefix, others and tokens are empty where the prefix holds no token of another document.

    skipped: tokens that order 1 puts before prefix; weight: how common the document's tokens are (mean log count).
    """
    out: list[tuple] = []
    ids, each = rows.column("doc_id").to_pylist(), tokens(rows.column("text").to_pylist())
    if each:
        keys, df = distinct(np.concatenate([short(x, bits) for x in each])), answers(found)
    for doc, x in zip(ids, each, strict=True):
        n = len(x)
        if not n:
            out.append((doc, 0, 0, 0, 0.0, 0, [], [], b"", b""))
            continue
        h1, h2 = (int(np.add.reduce(mix(x ^ s)).astype(np.int64)) for s in (np.uint64(0), SALT))
        count = df[np.searchsorted(keys, short(x, bits))]
        shared = x[count > 1]
        left = prefix_size(n) - (n - len(shared))  # places of the prefix that tokens of one document leave
        if left <= 0 or doc is None:
            out.append((doc, n, h1, h2, 0.0, 0, [], [], b"", b""))
            continue
        first = shared[np.lexsort((shared, count[count > 1]))][:left]
        others = [np.sort(shared[np.argsort(mix(shared ^ np.uint64(k)), kind="stable")][:left]) for k in range(1, ORDERS)]
        out.append((doc, n, h1, h2, float(np.log(count.astype(float)).mean()), n - len(shared), first.astype(np.int64).tolist(), others[0].astype(np.int64).tolist(), np.concatenate(others[1:]).astype("<u8").tobytes(), x.astype("<u8").tobytes()))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary())
    cols = [pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 10, kinds, strict=True)]
    return pa.table(dict(zip(("doc_id", "n_shingles", "h1", "h2", "weight", "skipped", "prefix", "second", "others", "tokens"), cols, strict=True)))


def meet(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays without repeats."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def linked(a: bytes, b: bytes, more_a: bytes, more_b: bytes, percent: int = PERCENT) -> bool:
    """Filters of the orders beyond the second, then the exact test."""
    others = [np.frombuffer(x, "<u8").reshape(ORDERS - 2, -1) for x in (more_a, more_b)]
    if not all(meet(p, q) for p, q in zip(*others, strict=True)):
        return False
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    both = meet(x, y)
    return 100 * both >= percent * (len(x) + len(y) - both)


def verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """pairs (a, b) that link. Sets meet by two joins on doc_id; the second order is looked at first, then the rest where
    the sets meet."""
    sets = docs.select("doc_id", "second", "others", "tokens").where("octet_length(tokens) > 0")
    left = sets.select(F.col("doc_id").alias("a"), F.col("second").alias("a_second"), F.col("others").alias("a_more"), F.col("tokens").alias("a_set"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("second").alias("b_second"), F.col("others").alias("b_more"), F.col("tokens").alias("b_set"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(i) for i in range(2, 6)]
            keep = [linked(*(c[i].as_py() for c in cols)) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    met = pairs.join(left, "a").join(right, "b").where(F.arrays_overlap("a_second", "b_second"))
    return met.select("a", "b", "a_set", "b_set", "a_more", "b_more").mapInArrow(run, "a long, b long")


def may_link(n: str, place: str, other_n: str, other_place: str) -> Column:
    """Whether two documents can link whose first common token under order 1 stands at these places: their lengths fit,
    and even if all tokens behind it were common it would be enough. True for some token of every pair that links."""
    a, b = F.col(n), F.col(other_n)
    return (a * 100 >= b * PERCENT) & (b * 100 >= a * PERCENT) & (F.least(a - F.col(place), b - F.col(other_place)) * (100 + PERCENT) >= (a + b) * PERCENT)


def labelled(lists: DataFrame, comps: DataFrame | None) -> DataFrame:
    """lists with comp: a document's component so far."""
    if comps is None:
        return lists.withColumn("comp", F.col("doc_id"))
    return lists.join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("component", "doc_id")).drop("component")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, rep) of all documents with shingles, and the rows of docs that represent their class of equal sets."""
    full = docs.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = table(full.groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("rep")), "classes")
    members = full.select("doc_id", "n_shingles", "h1", "h2").join(reps, ["n_shingles", "h1", "h2"]).select("doc_id", "rep")
    return members, docs.join(reps.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")


def candidates(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that share a token under order 1 and, on crowded lists, one under order 2."""
    second = docs.select("doc_id", F.explode("second").alias("token_2"))
    few = rows.where("NOT crowded").withColumn("token_2", F.lit(0).cast("long"))
    both = table(few.unionByName(rows.where("crowded").join(second, "doc_id")), "lists")
    other = both.select("token", "token_2", F.col("doc_id").alias("b"), F.col("n").alias("b_n"), F.col("place").alias("b_place"), F.col("comp").alias("b_comp"))
    met = both.join(other, ["token", "token_2"]).where((F.col("comp") < F.col("b_comp")) & may_link("n", "place", "b_n", "b_place"))
    return met.select(F.col("doc_id").alias("a"), "b").distinct()


def links(docs: DataFrame, long: int = LONG) -> DataFrame:
    """Links (a, b) between representatives, enough to give all components."""
    lists = docs.where("size(prefix) > 0").select("doc_id", F.col("n_shingles").alias("n"), "weight", "skipped", F.posexplode("prefix").alias("at", "token"))
    lists = table(lists.select("doc_id", "n", "weight", (F.col("skipped") + F.col("at")).alias("place"), "token"), "lists")
    # a token on one list only (its other documents have it beyond their prefix, or are equal sets) makes no candidate
    several = table(lists.groupBy("token").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1").select("token"), "several")
    lists = table(lists.join(several, "token"), "lists")
    found: DataFrame | None = None
    comps: DataFrame | None = None
    turn = 0
    while turn <= HUB_ROUNDS:
        rows = table(labelled(lists, comps), "labelled") if comps is not None else labelled(lists, None)
        if turn < HUB_ROUNDS:
            # the hub of a token's list: first the document of the most common tokens (edits make rare ones), then others
            order = -F.col("weight") if turn == 0 else F.xxhash64("doc_id", F.lit(turn))
            hub = F.struct(order.alias("o"), F.col("doc_id").alias("hub"), F.col("n").alias("hub_n"), F.col("place").alias("hub_place"), F.col("comp").alias("hub_comp"))
            hubs = table(rows.groupBy("token").agg(F.min(hub).alias("x")).select("token", F.col("x.o").cast("double").alias("o"), "x.hub", "x.hub_n", "x.hub_place", "x.hub_comp"), "hubs")
            near = rows.join(hubs, "token").where((F.col("comp") != F.col("hub_comp")) & may_link("n", "place", "hub_n", "hub_place"))
            counted = near.groupBy("doc_id", "hub").agg(F.count(F.lit(1)).alias("shared"), F.min("o").alias("o"))
            best = F.struct(-F.col("o"), "shared", "hub") if turn == 0 else F.struct("shared", "hub")
            pairs = counted.groupBy("doc_id").agg(F.max_by("hub", best).alias("a")).select("a", F.col("doc_id").alias("b"))
        else:
            mixed = rows.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("members")).where("low < high").select("token", (F.col("members") > long).alias("crowded"))
            left = table(rows.join(table(mixed, "mixed"), "token"), "open")
            pairs = candidates(left, docs)
        new = table(verify(table(pairs, "pairs"), docs), "links")
        found = new if found is None else found.unionAll(new)
        if turn < HUB_ROUNDS and new.limit(1).count():
            comps = components(found)
            turn += 1
        else:
            turn = max(turn + 1, HUB_ROUNDS)  # hubs that join nothing more leave the rest to the last round
    return found


def join_classes(rows: DataFrame, long: int = LONG) -> DataFrame:
    """doc_id, n_shingles, component_id for each document."""
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with scratch(rows.sparkSession) as work:
        dealt, n = chunked(rows)
        bits = count_bits(n)
        found = counted(dealt, n, lambda part: count_keys(part, bits), bits)
        docs = table(dealt.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(lambda a, b: documents(a, b, bits), DOCS), "sets")
        members, reps = classes(docs)
        members = table(members, "members")
        found = links(table(reps, "representatives"), long)
        # a repeated doc_id may be in several classes: their links are its own
        same = members.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        final = components(found.unionAll(same))
        named = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles")).join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        nameless = docs.where("doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        return work.result(named.unionAll(nameless), "joined")


def keep_one(docs: DataFrame) -> DataFrame:
    """Of docs, one document of each component: its smallest doc_id. A document is a doc_id: where several rows stand
    under one that stays, they all do. Rows without doc_id stay."""
    with scratch(docs.sparkSession) as work:
        dropped = work.result(join_classes(docs).where("component_id <> doc_id").select("doc_id"), "copies")
    return docs.join(dropped, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_classes(read(spark, sf_dir, "documents"))
