"""Corpus-wide totals of keys that are far too many to shuffle one by one (shingles, byte windows, words).

Documents are dealt into chunks by a hash. Each chunk sends each of its different keys once, with its own count, packed
into one row for each part of the key space; a part adds up and sends every chunk its totals, in the order in which
the chunk sent its keys. The chunk's documents and its totals then meet again. A key that a third of all documents
hold is one entry for each chunk, never one for each document, so no task grows with a hot key.

A chunk cuts its keys into FAN parts at most, whatever the corpus, so the rows sent grow with the chunks and not with
their square. Beyond FAN chunks a part would outgrow a task; there, groups of FAN chunks add up first, each group cuts
every part once more, and answers come back the same way.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import chunk_count, new_path, table

CHUNK = 8 << 20
#: Parts of the key space that a chunk sends to at most, and chunks that a part hears directly; a power of two.
FAN = 1024
#: keys (sorted, unique, uint64) and counts of a chunk's documents.
Keys = Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]
#: From the keys of a part and their totals to what is answered for each key, and a summary of the part.
Final = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, bytes]]


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as byte planes without those that are all zero (first byte: how many), or, where that is much
    shorter, seven bits to a byte, the high bit saying that the number goes on (first byte: 0)."""
    return pack_each(values, np.zeros(1, np.int64), np.array([len(values)]))[0] if len(values) else b"\1"


def pack_each(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """pack of each piece of values; pieces are not empty and follow each other without gaps."""
    if not len(starts):
        return []
    x = np.ascontiguousarray(values).astype("<u8")
    most = np.maximum.reduceat(x, starts)
    size = np.ones(len(x), np.uint8)
    for k in range(1, 10):
        if int(most.max()) >> 7 * k:
            size += x >= np.uint64(1 << 7 * k)
    seven = np.add.reduceat(size, starts, dtype=np.int64)
    planes = np.array([max(1, (m.bit_length() + 7) // 8) for m in most.tolist()])
    short = (planes > 2) & (4 * seven < 3 * planes * (ends - starts))
    some = np.repeat(short, ends - starts)
    every = seven_bits(x[some], size[some])
    cuts = np.cumsum(seven * short)
    out, octets = [], x.view(np.uint8).reshape(-1, 8)
    for a, b, p, n, z, own in zip(starts.tolist(), ends.tolist(), planes.tolist(), seven.tolist(), cuts.tolist(), short.tolist(), strict=True):
        out.append(b"\0" + every[z - n : z].tobytes() if own else bytes([p]) + octets[a:b, :p].T.tobytes())
    return out


def seven_bits(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """x, seven bits to a byte; size: bytes of each."""
    at = np.cumsum(size, dtype=np.int64)
    out, at = np.zeros(int(at[-1]) if len(at) else 0, np.uint8), at - size
    while len(x):
        more = x >= np.uint64(128)
        out[at] = (x.astype(np.uint8) & np.uint8(127)) | (more.view(np.uint8) << np.uint8(7))
        on = np.flatnonzero(more)
        x, at = x[on] >> np.uint64(7), at[on] + 1
    return out


def unpack(data: bytes, count: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8, offset=1)
    if data[0] == 1:
        return raw.astype("<u8")
    if data[0]:
        out = np.zeros((count, 8), np.uint8)
        if count:
            out[:, : data[0]] = raw.reshape(-1, count).T
        return out.view("<u8").ravel()
    at = np.concatenate([[0], np.flatnonzero(raw < 128)[:-1] + 1])
    found = (raw[at] & np.uint8(127)).astype(np.uint64)
    on = np.flatnonzero(raw[at] >= 128)
    at, k = at[on] + 1, 7
    while len(on):
        byte = raw[at]
        found[on] |= (byte & np.uint8(127)).astype(np.uint64) << np.uint64(k)
        more = np.flatnonzero(byte >= 128)
        on, at, k = on[more], at[more] + 1, k + 7
    return found


def unpack_each(data: list[bytes], counts: list[int]) -> list[np.ndarray]:
    """unpack of each; numbers of seven bits to a byte end to end."""
    out = [unpack(d, n) if d[0] else None for d, n in zip(data, counts, strict=True)]
    if seven := [k for k, x in enumerate(out) if x is None]:
        ends = np.cumsum([counts[k] for k in seven])
        every = unpack(b"\0" + b"".join(memoryview(data[k])[1:] for k in seven), int(ends[-1]))
        for k, x in zip(seven, np.split(every, ends[:-1]), strict=True):
            out[k] = x
    return out


def dealt(rows: DataFrame, text: str = "text") -> tuple[DataFrame, int, int]:
    """rows with `chunk`, by a hash of all columns; into how many parts keys go (one for CHUNK bytes of text), and how
    many buckets hold the chunks. Small tables make chunks of an eighth, as many as there are partitions to work on them."""
    spark = rows.sparkSession
    least, most = int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))
    small = chunk_count(rows, text, CHUNK // 8)
    parts = -(-small // 8)
    n = max(parts, min(least, small))
    buckets = min(most, max(least, -(-n // 2)))
    return rows.withColumn("chunk", F.pmod(F.xxhash64(*(f"`{c}`" for c in rows.columns)), F.lit(n))), parts, buckets


def bucketed(rows: DataFrame, buckets: int, there: bool = False) -> DataFrame:
    """rows written once, bucketed by chunk: later passes read them as they lie, however often they come back. there: the
    rows of a bucket are together already, so they need not be shuffled."""
    spark = rows.sparkSession
    path = new_path(spark, "chunks", catalogue=True)
    name = path.rpartition("/")[2]
    rows = rows if there else rows.repartition(buckets, "chunk")
    rows.write.option("compression", "zstd").option("path", path).bucketBy(buckets, "chunk").sortBy("chunk").saveAsTable(name)
    return spark.table(name)


def chunked(rows: DataFrame, text: str = "text") -> tuple[DataFrame, int]:
    """rows with `chunk`, bucketed by it, and the number of parts."""
    found, parts, buckets = dealt(rows, text)
    return bucketed(found, buckets), parts


#: checks: of each key a second hash of what it stands for (32 bits each), or nothing.
SENT = "block long, chunk long, n long, keys binary, counts binary, checks binary"


def bits_for(n: int) -> int:
    return max(1, (n - 1).bit_length())


def count_bits(parts: int) -> int:
    """Bits of keys of which only counts matter: 256 places for each byte of the corpus, so that few keys that occur once
    share theirs with another, however large the corpus is."""
    return min(64, max(44, bits_for(parts) + (CHUNK - 1).bit_length() + 8))


def low_bits(parts: int, bits: int) -> int:
    """A part (block) is a value of the bits above these."""
    return bits - bits_for(min(parts, FAN))


def message(chunk: int, found: np.ndarray, counts: np.ndarray, low: int, checks: np.ndarray | None = None) -> pa.Table:
    """What a chunk sends: SENT, a row for each block. found: sorted, unique."""
    block = found >> np.uint64(low)
    starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(found) else np.empty(0, np.int64)
    ends = np.append(starts[1:], len(found)) if len(starts) else starts
    steps = np.diff(found, prepend=np.zeros(1, found.dtype))
    steps[starts] = found[starts] - (block[starts] << np.uint64(low))
    packed, weights = pack_each(steps, starts, ends), pack_each(counts, starts, ends)
    second = [b"" if checks is None else checks[a:b].astype("<u4").tobytes() for a, b in zip(starts, ends, strict=True)]
    return pa.table({"block": pa.array(block[starts].astype(np.int64)), "chunk": pa.array([chunk] * len(starts), pa.int64()), "n": pa.array((ends - starts).astype(np.int64)), "keys": pa.array(packed, pa.binary()), "counts": pa.array(weights, pa.binary()), "checks": pa.array(second, pa.binary())})


ANSWER = "chunk long, block long, n long, answer binary"


@dataclass
class Gathered:
    """What was sent to one block: its keys, their totals and checks, the place among them of each key sent, and keys in each row."""

    keys: np.ndarray
    total: np.ndarray
    checks: np.ndarray | None
    inverse: np.ndarray
    n: list[int]
    counts: np.ndarray


@dataclass
class Shards:
    """SON partitioning: senders make `count` shards by their number. least: how often a shard must have a key for it to be
    locally frequent, its share (of all weights) of the support."""

    count: int
    least: np.ndarray

    @classmethod
    def of(cls, chunks: DataFrame, parts: int, count: int, weight: str, support: int) -> Shards:
        """chunks: chunk and its weight. Beyond FAN parts groups of chunks are the senders, as in totals."""
        sender = F.col("chunk") if parts <= FAN else F.pmod(F.xxhash64("chunk"), F.lit(-(-parts // FAN)))
        rows = chunks.groupBy(F.pmod(sender, F.lit(count)).alias("shard")).agg(F.sum(weight).alias("w")).collect()  # count rows at most
        every = max(1, sum(r["w"] for r in rows))
        least = np.ones(count, np.int64)
        for r in rows:
            least[r["shard"]] = max(1, -(-support * r["w"] // every))
        return cls(count, least)

    def candidates(self, senders: np.ndarray, got: Gathered) -> np.ndarray:
        """Totals of the keys that are locally frequent in some shard, 0 for others."""
        shard = np.repeat(senders % self.count, got.n)
        each, at = np.unique(got.inverse.astype(np.int64) * self.count + shard, return_inverse=True)
        often = np.bincount(at, got.counts, len(each)) >= self.least[each % self.count]
        out = np.zeros_like(got.total)
        hit = each[often] // self.count
        out[hit] = got.total[hit]
        return out


def gathered(rows: pa.Table, low: int, lowest: bool) -> Gathered:
    """Keys that came with different checks stand for different things: their total is 0, and with lowest, counts are 1 at
    least, so that 0 says so."""
    n = rows.column("n").to_pylist()
    base = np.uint64(rows.column("block")[0].as_py()) << np.uint64(low)
    each = [base + np.cumsum(x) for x in unpack_each(rows.column("keys").to_pylist(), n)]
    found, inverse = np.unique(np.concatenate(each), return_inverse=True)
    counts = np.concatenate(unpack_each(rows.column("counts").to_pylist(), n))
    if lowest:
        total = np.full(len(found), np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(total, inverse, counts)
    else:
        total = np.bincount(inverse, counts, len(found)).astype(np.uint64)
    checks = None
    if second := b"".join(rows.column("checks").to_pylist()):
        sent = np.frombuffer(second, "<u4")
        checks = np.zeros(len(found), "<u4")
        checks[inverse] = sent
        total[inverse[checks[inverse] != sent]] = 0
    return Gathered(found, total, checks, inverse, n, counts)


def answered(rows: pa.Table, values: np.ndarray, got: Gathered, sparse: bool = False) -> pa.Table:
    """sparse: without the zeros, so that what is answered has no place among what was sent but its order."""
    cuts = np.cumsum([0, *got.n])
    each = [values[got.inverse[a:b]] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    each = [x[x > 0] for x in each] if sparse else each
    return pa.table({"chunk": rows.column("chunk"), "block": rows.column("block"), "n": pa.array([len(x) for x in each], pa.int64()), "answer": pa.array([pack(x) for x in each], pa.binary())})


def added(rows: pa.Table, low: int, lowest: bool = False, final: Final | None = None, shards: Shards | None = None, sparse: bool = False) -> pa.Table:
    """ANSWER to all that was sent to one block."""
    got = gathered(rows, low, lowest)
    if shards is not None:
        got.total = shards.candidates(rows.column("chunk").to_numpy(), got)
    if final is None:
        return answered(rows, got.total, got)
    values, summary = final(got.keys, got.total)
    more = pa.table({"chunk": pa.array([-1], pa.int64()), "block": rows.column("block")[:1], "n": pa.array([len(got.keys)], pa.int64()), "answer": pa.array([summary], pa.binary())})
    return pa.concat_tables([answered(rows, values, got, sparse), more])


def merged(rows: pa.Table, low: int, fine: int, lowest: bool) -> pa.Table:
    """SENT by a group of chunks: what they sent to one block, added up and cut into finer blocks."""
    got = gathered(rows, low, lowest)
    return message(rows.column("team")[0].as_py(), got.keys, got.total, fine, got.checks)


def forwarded(rows: pa.Table, back: pa.Table, low: int, lowest: bool, sparse: bool = False) -> pa.Table:
    """ANSWER to the chunks of a group, from what came back to the group for one block."""
    return answered(rows, answers(back), gathered(rows, low, lowest), sparse)


def totals(sent: DataFrame, parts: int, bits: int, lowest: bool = False, final: Final | None = None, shards: Shards | None = None, sparse: bool = False) -> DataFrame:
    """chunk, block, n, answer: packed totals (or the lowest values, or what final makes of them) of the keys below
    2 ** bits that the chunk sent to the block, in their order.

    With final, one more row for each part that is added up: chunk -1, and its summary. With shards, 0 for keys that are
    locally frequent in none. With final and sparse, zeros are not answered.
    """
    low, fan = low_bits(parts, bits), FAN
    if parts <= fan:
        return sent.groupBy("block").applyInArrow(lambda t: added(t, low, lowest, final, shards, sparse), ANSWER)
    teams = -(-parts // fan)
    finer = bits_for(teams)
    sent = table(sent.withColumn("team", F.pmod(F.xxhash64("chunk"), F.lit(teams))), "messages")
    up = sent.groupBy("team", "block").applyInArrow(lambda t: merged(t, low, low - finer, lowest), SENT)
    far = table(up.groupBy("block").applyInArrow(lambda t: added(t, low - finer, lowest, final, shards), ANSWER), "totals")
    back = far.where("chunk >= 0").withColumn("part", F.shiftright("block", finer))
    down = sent.groupBy("team", "block").cogroup(back.groupBy("chunk", "part")).applyInArrow(lambda a, b: forwarded(a, b, low, lowest, sparse), ANSWER)
    return down.unionAll(far.where("chunk = -1"))


def counted(rows: DataFrame, parts: int, keys: Keys, bits: int) -> DataFrame:
    """totals of the keys (below 2 ** bits) of every chunk of rows."""
    low = low_bits(parts, bits)

    def send(part: pa.Table) -> pa.Table:
        return message(part.column("chunk")[0].as_py(), *keys(part), low)

    return totals(rows.groupBy("chunk").applyInArrow(send, SENT), parts, bits)


def answers(rows: pa.Table) -> np.ndarray:
    """All totals of one chunk, aligned with its sorted keys."""
    found = sorted(zip(rows.column("block").to_pylist(), rows.column("n").to_pylist(), rows.column("answer").to_pylist(), strict=True))
    return np.concatenate(unpack_each([a for *_, a in found], [n for _, n, _ in found])) if found else np.empty(0, np.uint64)
