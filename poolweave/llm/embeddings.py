"""Near-duplicate vectors by randomised-rotation binary codes.

Equal vectors are one node with a number of copies. A node's unit vector is rotated at random into CODE_BITS dimensions; the
signs are its code, and the inner product of the rotated vector with its code is stored as the code's correction factor.
Bands of code bits are hash tables: nodes that share a band meet. Where they meet, the code of one, decoded and divided by its
factor, times the vector of the other is an unbiased estimate of their cosine, with a confidence bound that follows from the
factor. Pairs whose bound lies below the threshold are done; the others are computed again, exactly, in double precision.

A pair of cosine >= THRESHOLD shares a band with a probability of at least RECALL (at the threshold itself; closer pairs more
often): each bit is equal with probability 1 - angle / pi. Bits of a band grow with the logarithm of the nodes, so that
about CROWD unlike nodes meet in a bucket whatever their number, and tables follow from bits and RECALL. A pair that meets in
several tables counts in the first. What leaves a bucket is, for each node, its number of links and one edge to a node of its
component there; never the pairs. A bucket of more than PIECE nodes is dealt into pieces, and each pair of pieces is a task's
work: no bucket is capped.

Defined results: vectors that are null, empty, all zeros, or hold nulls or non-finite components link with nothing, nor do vectors
of different lengths; rows of one vec_id are vectors of their own (a component's id is its smallest vec_id, nulls apart; a
component of null ids alone has a null id and is not kept); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .shared import read, scratch, table

THRESHOLD = 0.95
RECALL = 0.995
CODE_BITS = 256
#: Unlike nodes that a bucket should hold, and nodes of a bucket that one task compares with each other.
CROWD = 64
PIECE = 2048
#: Nodes whose buckets one group of a task holds, about.
GROUP = 8_000
#: Standard deviations of an estimate's error that count as possible.
SURE = 5.0


def bands(nodes: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a band, and how many bands."""
    bits = min(62, max(6, math.ceil(math.log2(max(nodes, 1) / CROWD))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


@lru_cache(maxsize=8)
def rotation(size: int, bits: int = CODE_BITS) -> np.ndarray:
    """size x d, d >= size: the first rows of a random rotation of d dimensions, the same for all workers."""
    d = max(bits, -(-size // 64) * 64)
    q, r = np.linalg.qr(np.random.default_rng(size).standard_normal((d, size)))
    return (q * np.sign(np.diag(r))).T


@lru_cache(maxsize=8)
def band_bits(d: int, bits: int, count: int) -> np.ndarray:
    """Which code bits make each band: different ones as long as there are any."""
    r, each = np.random.default_rng(bits), d // bits
    drawn = [r.permutation(d)[: each * bits].reshape(each, bits) for _ in range(-(-count // each))]
    return np.concatenate(drawn)[:count]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, whatever their size."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs (0 or 1) of the rotated unit vectors, and correction factors."""
    turned = unit(x) @ rotation(x.shape[1])
    signs = (turned >= 0).astype(np.uint8)
    return signs, np.abs(turned).sum(axis=1) / math.sqrt(turned.shape[1])


def band_keys(signs: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Nodes x bands: the bits of each band as one number."""
    weights = 1 << np.arange(which.shape[1], dtype=np.int64)
    return np.stack([signs[:, w].astype(np.int64) @ weights for w in which], axis=1)


def decoded(signs: np.ndarray, factors: np.ndarray, size: int) -> np.ndarray:
    """For each code the vector whose inner product with any other unit vector is the estimate."""
    d = signs.shape[1]
    return (signs * 2.0 - 1.0) @ rotation(size).T / (math.sqrt(d) * factors[:, None])


def bound(factors: np.ndarray, d: int, cosine: float) -> np.ndarray:
    """How far an estimate may lie below a cosine: the part of the code's error that can show, which is that along what the
    other vector has beside this one."""
    return SURE * np.sqrt((1 - factors**2) / factors**2 * (1 - cosine**2) / (d - 1))


def candidates(signs: np.ndarray, factors: np.ndarray, x: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (of left by right) that may have a cosine of threshold or more, by the estimates of either side's code."""
    size, d = x.shape[1], signs.shape[1]
    one = decoded(signs[left], factors[left], size) @ x[right].T
    two = (decoded(signs[right], factors[right], size) @ x[left].T).T
    may = (one >= threshold - bound(factors[left], d, threshold)[:, None]) | (two >= threshold - bound(factors[right], d, threshold)[None, :])
    a, b = np.nonzero(may)
    return left[a], right[b]


def linked(x: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs have the cosine, in double precision."""
    return np.concatenate([np.einsum("ij,ij->i", x[a[i : i + 65536]], x[b[i : i + 65536]]) >= threshold for i in range(0, len(a), 65536)] or [np.empty(0, bool)])


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that links reach."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def valid(vector: str = "embedding") -> Column:
    """Numbers throughout, not all 0."""
    fine = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """node (a number of its own), first (smallest vec_id), copies, k1, k2 (hashes), vector of all valid vectors."""
    one = rows.where(valid()).groupBy("k1", "k2").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("vector"))
    return table(one.select(F.monotonically_increasing_id().alias("node"), "first", "copies", "k1", "k2", "vector"), "nodes")


MET = "place int, part int, key long, node long, copies long, size int, code binary, factor double, vector binary"


def met(nodes: DataFrame, bits: int, count: int, parts: int) -> DataFrame:
    """MET: every node once for each table, with its key there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.list_value_length(batch.column(2)).to_numpy()
            for size in np.unique(lengths).tolist():
                rows = batch.filter(pa.array(lengths == size))
                x = rows.column(2).flatten().to_numpy().astype(np.float64).reshape(rows.num_rows, size)
                signs, factors = codes(x)
                keys = band_keys(signs, band_bits(signs.shape[1], bits, count))
                packed = [r.tobytes() for r in np.packbits(signs, axis=1)]
                exact = x.astype(np.float32)
                raw = exact if (exact == x).all() else x  # single precision travels as such
                same = {"node": rows.column(0), "copies": rows.column(1), "size": pa.array([size] * len(x), pa.int32()), "code": pa.array(packed, pa.binary()), "factor": pa.array(factors), "vector": pa.array([r.tobytes() for r in raw], pa.binary())}
                for t in range(count):
                    key = keys[:, t]
                    part = (key ^ (key >> 7) ^ size) % parts
                    cols = {"place": pa.array([t] * len(x), pa.int32()), "part": pa.array(part.astype(np.int32)), "key": pa.array(key)} | same
                    yield pa.RecordBatch.from_pydict({c.split()[0]: cols[c.split()[0]] for c in MET.split(", ")})

    return nodes.select("node", "copies", "vector").mapInArrow(run, MET)


FOUND = "node long, other long, n long"


def compared(rows: pa.Table, bits: int, count: int, threshold: float) -> pa.Table:
    """FOUND: for each node of a group its links (copies of the other side count) and a node of its component; links that an
    earlier table has are its own."""
    size, mark = rows.column("size").to_numpy(), rows.column("side").to_numpy()
    here = rows.column("place")[0].as_py()
    nodes, copies = rows.column("node").to_numpy(), rows.column("copies").to_numpy()
    out_a, out_b = [], []
    for s in np.unique(size).tolist():
        of = np.flatnonzero(size == s)
        part = rows.take(pa.array(of))
        signs = np.unpackbits(np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(len(of), -1), axis=1)
        raw = part.column("vector").to_pylist()
        x = unit(np.stack([np.frombuffer(v, "<f4" if len(v) == 4 * s else "<f8").astype(np.float64) for v in raw]))
        factors, key, side = part.column("factor").to_numpy(), part.column("key").to_numpy(), mark[of]
        keys = band_keys(signs, band_bits(signs.shape[1], bits, count)[: here + 1])
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        for bucket in np.split(order, cuts):
            left, right = bucket[side[bucket] != 1], bucket[side[bucket] != 0]  # a whole piece (-1) is on both sides
            if len(left) and len(right) and len(bucket) > 1:
                a, b = candidates(signs, factors, x, left, right, threshold)
                once = (side[a] != -1) | (a < b)
                a, b = a[once], b[once]
                first = ~(keys[a, :here] == keys[b, :here]).any(axis=1)
                a, b = a[first], b[first]
                good = linked(x, a, b, threshold)
                out_a.append(of[a[good]])
                out_b.append(of[b[good]])
    a, b = (np.concatenate(o or [np.empty(0, np.int64)]) for o in (out_a, out_b))
    links = np.zeros(len(nodes), np.int64)
    np.add.at(links, a, copies[b])
    np.add.at(links, b, copies[a])
    root = forest(len(nodes), a, b)
    kept = links > 0
    return pa.table({"node": pa.array(nodes[kept]), "other": pa.array(nodes[root][kept]), "n": pa.array(links[kept])})


def links(nodes: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, piece: int = PIECE) -> DataFrame:
    """FOUND of all tables."""
    many = nodes.count()
    bits, count = bands(many, threshold, recall)
    rows = met(nodes, bits, count, max(1, -(-many // GROUP)))
    bucket = ["place", "size", "key"]
    # crowded buckets, by what the keys alone say: at most a row for each `piece` entries of the tables
    crowded = table(rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > piece).select(*bucket, F.ceil(F.col("held") / piece).alias("pieces")), "crowded")
    rows = rows.join(F.broadcast(crowded), bucket, "left") if crowded.count() <= 10_000 else rows.join(crowded, bucket, "left")
    own = F.pmod(F.xxhash64("node"), F.col("pieces"))
    # a piece meets each other one in a group of its own: side 0 is the lower piece, 1 the higher, -1 a whole piece (or bucket)
    other = F.explode(F.when(F.col("pieces").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    rows = rows.withColumn("own", F.coalesce(own, F.lit(-1))).withColumn("with", other)
    side = F.when(F.col("own") == F.col("with"), -1).when(F.col("own") < F.col("with"), 0).otherwise(1)
    crowd = F.when(F.col("pieces").isNotNull(), F.xxhash64("size", "key", F.least("own", "with"), F.greatest("own", "with")))
    rows = rows.withColumn("side", side.cast("int")).withColumn("crowd", F.coalesce(crowd, F.lit(0))).drop("pieces", "own", "with")
    return table(rows.groupBy("place", "part", "crowd").applyInArrow(lambda t: compared(t, bits, count, threshold), FOUND), "links")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, piece: int = PIECE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding)."""
    with scratch(vectors.sparkSession) as work:
        keys = (F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(1), "embedding").alias("k2"))  # two seeds
        rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").select("*", *keys)
        nodes = distinct_vectors(rows)
        found = links(nodes, threshold, recall, piece)
        degree = found.groupBy("node").agg(F.sum("n").alias("n"))
        group = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
        joined = nodes.join(degree, "node", "left").join(group, "node", "left").select("k1", "k2", "first", "copies", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "node").alias("component"))
        joined = table(joined, "joined")
        lowest = joined.groupBy("component").agg(F.min("first").alias("component_id"))
        each = joined.join(lowest, "component").select("k1", "k2", (F.col("n") + F.col("copies") - 1).alias("n"), "component_id")
        ok = rows.withColumn("ok", valid()).select("vec_id", F.when(F.col("ok"), F.col("k1")).alias("k1"), F.when(F.col("ok"), F.col("k2")).alias("k2"), "ok")
        out = ok.join(each, ["k1", "k2"], "left").select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), F.when(F.col("ok"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
        return work.result(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))), "embeddings")


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))


#: All pairs: for small tables only.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings),
u AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS l FROM v WHERE x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_dot_product(a.x, b.x) / (a.l * b.l) >= 0.95),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b),
c AS (SELECT a, min(b) AS low FROM reach GROUP BY a), d AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(d.n, 0) AS n_links, least(vec_id, coalesce(c.low, vec_id)) AS component_id, vec_id <= coalesce(c.low, vec_id) AS kept FROM v LEFT JOIN c ON c.a = vec_id LEFT JOIN d ON d.a = vec_id
"""
