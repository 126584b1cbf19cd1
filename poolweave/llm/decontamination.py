"""Benchmark decontamination: rare n-gram seeds join passages to benchmark items, Smith-Waterman aligns them over words.

Texts are lower-cased, cut at white space and stripped of marks; a word is its 64-bit hash from there on. This is done
once: pass 1 writes each text's words as places among the different words of some texts, with these words and their counts.
Pass 2 counts over the whole corpus how often each word of the benchmark occurs. From these counts follow the seeds: the n-grams of
each item that chance alone would hardly make (the corpus size times the product of their words' frequencies), and the
rarest few of an item that has too few such. A planted item does not make its own n-grams common this way, however
often it was planted. Pass 3 cuts passages out of the documents: a filter of fixed size, made of the seeds, says for
each n-gram whether it may be a seed and how far its item may reach; overlapping reaches are one passage. Passages,
few beside the corpus, then join the table of seeds by n-gram (salted, as a planted item may be in a third of all
documents), and each pair of passage and item with a common seed is aligned. All passes over texts are narrow; the
benchmark is a table throughout, of any size, and neither it nor its words or seeds are collected or broadcast by hand.

Defined results: null and blank texts match nothing, as items or as documents; items without item_id match like others;
equal items match alike; an empty benchmark or corpus gives no rows; repeated documents are judged each for itself;
documents without doc_id too; extra columns are ignored by `matches` and carried by `clean`.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import pack, unpack
from .shared import mix, read, scratch, table, utf8

N = 4
#: A seed is rare if chance alone gives it at most so many times in the corpus; each item keeps LEAST_SEEDS in any case.
MAX_EXPECTED, LEAST_SEEDS = 10.0, 3
#: A match counts up to MATCH, by how rare the word is: words of a share of RARE or less count in full.
MATCH, MISMATCH, GAP = 2.0, -1.0, -1.0
RARE = 1e-3
#: Of the best possible alignment score of the item.
MIN_SCORE = 0.35
MARKS = "\"'`.,;:!?()[]{}<>*#%&$|-_=+/\\~^«»„“”‘’…–—"
#: Bits of the filter of benchmark words; entries of each of the two filters of seeds; salts of a seed.
WORD_BITS, SEED_BITS, SALTS = 24, 22, 16
#: Pieces of a filter that are added up each by a task of its own.
SLICES = 64
CACHE_WORDS = 500_000
#: Texts whose words are kept together.
TEXTS = 512


class Words(dict):
    """The 64-bit id of a token (0: nothing but marks), worked out once for each different one."""

    def __missing__(self, token: str) -> int:
        word = token.strip(MARKS)
        out = self[token] = (xxhash.xxh64_intdigest(utf8(word)) or 1) if word else 0
        return out

    def of(self, text: str | None) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        tokens = (text or "").lower().split()
        ids = np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))
        return ids[ids > 0]


def align(item: np.ndarray, passage: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, int, int, int]:
    """Best local alignment of two word-id arrays with linear gap costs: score, matched words, begin, end in passage.
    weight: what a match of each of the item's words counts.

    Row by row; gaps along the passage come from a running maximum, since a gap of k costs k times GAP.
    """
    m, at = len(passage), np.arange(len(passage) + 1)
    weight = np.full(len(item), MATCH) if weight is None else weight
    row = np.zeros(m + 1)
    start = at.copy()
    hits = np.zeros(m + 1, np.int64)
    best = (0.0, 0, 0, 0)
    for w, gain in zip(item, weight, strict=True):
        same = passage == w
        diagonal = row[:-1] + np.where(same, gain, MISMATCH)
        up = row[1:] + GAP
        take = diagonal >= up
        new = np.zeros(m + 1)
        new[1:] = np.maximum(np.where(take, diagonal, up), 0)
        begin, got = at.copy(), np.zeros(m + 1, np.int64)
        begin[1:] = np.where(new[1:] > 0, np.where(take, start[:-1], start[1:]), at[1:])
        got[1:] = np.where(new[1:] > 0, np.where(take, hits[:-1] + same, hits[1:]), 0)
        lead = new - GAP * at
        top = np.maximum.accumulate(lead)
        source = np.maximum.accumulate(np.where(lead == top, at, 0))
        side = top + GAP * at
        use = side > new
        row = np.where(use, side, new)
        start, hits = np.where(use, begin[source], begin), np.where(use, got[source], got)
        if row.max() > best[0] + 1e-9:
            k = int(row.argmax())
            best = (float(row[k]), int(hits[k]), int(start[k]), k)
    return best


#: Odd factors, one for each place in a window.
FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def codes_of(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit code for each window of n words; windows of another length have other codes."""
    out = np.full(max(0, len(ids) - n + 1), n, np.uint64)
    for k in range(n):
        out += ids[k : len(ids) - n + 1 + k] * np.uint64(FACTORS[k])
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def slices(filled: np.ndarray) -> pa.RecordBatch:
    """An array of bytes as the SLICES pieces of it that hold anything: columns slice and f."""
    each = filled.reshape(SLICES, -1)
    some = np.flatnonzero(each.any(axis=1))
    return pa.RecordBatch.from_arrays([pa.array(some), pa.array([each[k].tobytes() for k in some.tolist()], pa.binary())], names=["slice", "f"])


def merged_filters(parts: DataFrame, join: np.ufunc, size: int) -> np.ndarray:
    """One array of size bytes out of many that came in slices: a task adds up one slice, and each slice reaches the driver
    once, so `size` bytes at most, into however many parts the benchmark was cut."""

    def add(rows: pa.Table) -> pa.Table:
        out = None
        for x in rows.column("f"):
            own = np.frombuffer(x.as_py(), np.uint8)
            out = own.copy() if out is None else join(out, own)
        return pa.table({"slice": rows.column("slice")[:1], "f": pa.array([out.tobytes()], pa.binary())})

    found = np.zeros((SLICES, size // SLICES), np.uint8)
    for r in parts.groupBy("slice").applyInArrow(add, "slice long, f binary").collect():
        found[r["slice"]] = np.frombuffer(r["f"], np.uint8)
    return found.ravel()


def benchmark_items(benchmark: DataFrame, key: str, text: str) -> DataFrame:
    """k, item_id, words of each item that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, at = Words(), TaskContext.get().partitionId(), 0
        for b in batches:
            each = [words.of(t) for t in b.column(1).to_pylist()]
            keep = pa.array([len(x) > 0 for x in each])
            ids = pa.array([(part << 40) + at + i for i in range(len(each))], pa.int64())
            at += len(each)
            yield pa.RecordBatch.from_arrays([ids, b.column(0), pa.array([signed(x) for x in each], pa.list_(pa.int64()))], names=["k", "item_id", "words"]).filter(keep)

    rows = benchmark.select(F.col(f"`{key}`").cast("long").alias("item_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return table(rows.mapInArrow(run, "k long, item_id long, words array<long>"), "items")


#: Some texts: their keys, how many words each has, their different words and how often each occurs, and all texts' words end
#: to end as places among these.
CODED = "keys array<array<long>>, sizes array<long>, n long, words binary, counts binary, places binary"


def coded_texts(texts: list[str | None], cache: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word ids (some may be there twice), the words of all texts as places among them, and how many each text has."""
    ids: dict[str, int] = defaultdict()
    ids.default_factory = ids.__len__
    each = [np.empty(0, np.int32)]
    for t in texts:
        tokens = (t or "").lower().split()
        each.append(np.fromiter(map(ids.__getitem__, tokens), np.int32, len(tokens)))
    if len(cache) > CACHE_WORDS:
        cache.clear()
    words = np.fromiter(map(cache.__getitem__, ids), np.uint64, len(ids))
    places = np.concatenate(each)
    kept = words[places] > 0
    before = np.concatenate([[0], np.cumsum(kept)])
    return words, places[kept], np.diff(before[np.cumsum([len(x) for x in each])])


def coded(rows: DataFrame) -> DataFrame:
    """CODED of rows (text, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Words()
        for b in (x.slice(i, TEXTS) for x in batches for i in range(0, x.num_rows, TEXTS)):
            words, places, sizes = coded_texts(b.column(0).to_pylist(), cache)
            counts, longs = np.bincount(places, minlength=len(words)), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([
                pa.array([b.column(1).to_pylist()], pa.list_(longs)), pa.array([sizes], longs), pa.array([len(places)], pa.int64()),
                pa.array([words.tobytes()], pa.binary()), pa.array([pack(counts)], pa.binary()), pa.array([pack(places)], pa.binary()),
            ], names=[x.split()[0] for x in CODED.split(", ")])

    return table(rows.select("text", "key").mapInArrow(run, CODED), "coded")


def word_counts(texts: DataFrame, items: DataFrame) -> DataFrame:
    """word, n over the whole corpus (CODED), of all words of the benchmark (and few others that the filter lets through);
    word 0: all words."""
    size, shift = 1 << (WORD_BITS - 3), np.uint64(64 - WORD_BITS)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(8 * size, bool)
        for b in batches:
            out[b.column(0).flatten().to_numpy().view(np.uint64) >> shift] = True
        yield slices(np.packbits(out))

    found = merged_filters(items.select("words").mapInArrow(bits, "slice long, f binary"), np.bitwise_or, size)
    held = texts.sparkSession.sparkContext.broadcast(found)  # 2 MB, whatever the benchmark

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = np.unpackbits(held.value).astype(bool), 0
        for b in batches:
            for words, counts in zip(b.column(0), b.column(1), strict=True):
                ids = np.frombuffer(words.as_py(), "<u8")
                n = unpack(counts.as_py(), len(ids)).astype(np.int64)
                total += int(n.sum())
                own = np.flatnonzero(known[ids >> shift] & (n > 0))
                yield pa.RecordBatch.from_arrays([pa.array(signed(ids[own])), pa.array(n[own])], names=["word", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([total], pa.int64())], names=["word", "n"])

    return table(texts.select("words", "counts").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "word_counts")


def weighted_items(items: DataFrame, counts: DataFrame) -> DataFrame:
    """k, item_id, words, weights (what a match of each word counts), codes and places of the item's seeds, n (words in a
    seed)."""
    total = counts.where("word = 0").agg(F.sum("n").alias("n")).first()["n"] or 1
    each = items.select("k", F.posexplode("words").alias("place", "word")).join(counts.where("word <> 0"), "word", "left")
    each = each.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("place", F.coalesce("n", F.lit(0).cast("long")).alias("n")))).alias("x"))
    rows = items.join(each.select("k", F.col("x.n").alias("counts")), "k").select("k", "item_id", "words", "counts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            weights, codes, places, sizes = [], [], [], []
            for w, c in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, share = np.array(w, np.int64).view(np.uint64), (np.array(c, float) + 0.5) / total
                weights.append(MATCH * np.clip(np.log(np.minimum(share, 1.0)) / np.log(RARE), 0.05, 1.0))
                n = min(N, len(x))
                expected = np.exp(np.log(share)[np.arange(len(x) - n + 1)[:, None] + np.arange(n)].sum(axis=1)) * total
                rare = np.union1d(np.flatnonzero(expected <= MAX_EXPECTED), np.argsort(expected, kind="stable")[:LEAST_SEEDS])
                codes.append(signed(codes_of(x, n)[rare]))
                places.append(rare)
                sizes.append(n)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(weights, pa.list_(pa.float64())), pa.array(codes, longs), pa.array(places, longs), pa.array(sizes, pa.int64())], names=["k", "item_id", "words", "weights", "codes", "places", "n"])

    return table(rows.mapInArrow(run, "k long, item_id long, words array<long>, weights array<double>, codes array<long>, places array<long>, n long"), "weighted")


def slots(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entry of a code in each of the two filters."""
    mask = np.uint64((1 << SEED_BITS) - 1)
    return codes & mask, ((codes >> np.uint64(32)) & mask) + np.uint64(1 << SEED_BITS)


def seed_filter(items: DataFrame) -> np.ndarray:
    """Two arrays of 2 ** SEED_BITS bytes: 0, or the bit length of the longest item with a seed at that entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(2 << SEED_BITS, np.uint8)
        for b in batches:
            for codes, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for at in slots(np.array(codes, np.int64).view(np.uint64)):
                    out[at] = np.maximum(out[at], len(words).bit_length())
        yield slices(out)

    return merged_filters(items.select("codes", "words").mapInArrow(run, "slice long, f binary"), np.maximum, 2 << SEED_BITS)


PASSAGES = "passage long, row long, key array<long>, begin long, words array<long>, codes array<long>, at array<long>"


def passages(texts: DataFrame, items: DataFrame) -> DataFrame:
    """PASSAGES of CODED texts (row: a number for each text): words from `begin` on, and the codes that may be seeds."""
    seed_sizes = [r["n"] for r in items.select("n").distinct().collect()]  # at most N
    held = texts.sparkSession.sparkContext.broadcast(seed_filter(items))  # 8 MB, whatever the benchmark

    def hits(ids: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Text, place, code and reach of all windows that may be seeds; texts are looked at end to end."""
        out = []
        for n in seed_sizes:
            own = codes_of(ids, n)
            at = np.flatnonzero(held.value[slots(own)[0]])
            own = own[at]
            far = np.minimum(*(held.value[s] for s in slots(own)))
            text = np.searchsorted(ends, at, "right")
            ok = np.flatnonzero((far > 0) & (at + n <= ends[np.minimum(text, len(ends) - 1)]))
            out.append((text[ok], at[ok] - starts[text[ok]], own[ok], np.int64(3) << far[ok].astype(np.int64) >> 1))
        return tuple(map(np.concatenate, zip(*out, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, row = TaskContext.get().partitionId(), 0, 0
        longs = pa.list_(pa.int64())
        kinds = (pa.int64(), pa.int64(), longs, pa.int64(), longs, longs, longs)
        for r in (x.slice(i, 1) for x in batches for i in range(x.num_rows)):
            sizes, words = r.column(1).flatten().to_numpy(), np.frombuffer(r.column(3)[0].as_py(), "<u8")
            ids = words[unpack(r.column(4)[0].as_py(), r.column(2)[0].as_py())]
            ends = np.cumsum(sizes)
            starts = ends - sizes
            text, place, code, far = hits(ids, ends, starts) if seed_sizes else (np.empty(0, np.int64),) * 4
            order = np.lexsort((place - far, text))
            text, place, code, far = text[order], place[order], code[order], far[order]
            low, high = np.maximum(place - far, 0), np.minimum(place + far + N, sizes[text])
            out: list[tuple] = []
            for k in np.unique(text).tolist():
                own = slice(*np.searchsorted(text, [k, k + 1]))
                begins, ends_ = low[own], np.maximum.accumulate(high[own])
                new = np.flatnonzero(np.concatenate([[True], begins[1:] > ends_[:-1]]))
                for a, z in zip(new.tolist(), [*new[1:].tolist(), len(begins)], strict=True):
                    begin, end = int(begins[a]), int(ends_[z - 1])
                    out.append(((part << 40) + count, (part << 40) + row + k, r.column(0)[0][k].as_py(), begin, signed(ids[starts[k] + begin : starts[k] + end]), signed(code[own][a:z]), place[own][a:z] - begin))
                    count += 1
            row += len(sizes)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], names=[x.split()[0] for x in PASSAGES.split(", ")])

    return table(texts.select("keys", "sizes", "n", "words", "places").mapInArrow(run, PASSAGES), "passages")


def best_alignment(item: np.ndarray, weight: np.ndarray, words: np.ndarray, places: list[int], ats: list[int]) -> tuple[float, float, int, int, int]:
    """Score, identity, seeds, begin and end of the best alignment of an item around one cluster of its seeds."""
    best, clusters = (-1.0, 0.0, 0, 0, 0), []
    for begin, at in sorted((at - place, at) for at, place in zip(ats, places, strict=True)):
        low, high = max(0, min(begin, at) - len(item) // 2), min(len(words), max(begin, at) + len(item) + len(item) // 2 + N)
        if clusters and low <= clusters[-1][1]:
            clusters[-1] = [clusters[-1][0], max(clusters[-1][1], high), clusters[-1][2] + 1]
        else:
            clusters.append([low, high, 1])
    for low, high, n in clusters:
        score, matched, begin, end = align(item, words[low:high], weight)
        best = max(best, (score / weight.sum(), matched / len(item), n, low + begin, low + end), key=lambda x: x[0])
    return best


def aligned(rows: DataFrame, benchmark: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """row, key, item_id, score, identity, n_seeds, begin_word, end_word: the best alignment of each row (text, key) with
    each item_id, where it reaches MIN_SCORE."""
    items = benchmark_items(benchmark, item_key, item_text)
    texts = coded(rows)
    items = weighted_items(items, word_counts(texts, items))
    found = passages(texts, items)
    seeds = items.select("k", F.explode(F.arrays_zip("codes", "places")).alias("s")).select("k", F.col("s.codes").alias("code"), F.col("s.places").alias("place"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    codes = found.select("passage", F.explode(F.arrays_zip("codes", "at")).alias("s")).select("passage", F.col("s.codes").alias("code"), F.col("s.at").alias("at"), F.pmod(F.xxhash64("passage"), F.lit(SALTS)).cast("int").alias("salt"))
    pairs = codes.join(seeds, ["code", "salt"]).groupBy("passage", "k").agg(F.collect_list("place").alias("places"), F.collect_list("at").alias("ats"))
    pairs = table(pairs, "pairs")
    met = pairs.join(found.select("passage", "row", "key", "begin", F.col("words").alias("own")), "passage").join(items.select("k", "item_id", "words", "weights"), "k")
    schema = "row long, key array<long>, item_id long, score double, identity double, n_seeds long, begin_word long, end_word long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                item, own = np.array(r["words"], np.int64), np.array(r["own"], np.int64)
                score, identity, n, begin, end = best_alignment(item, np.array(r["weights"]), own, r["places"], r["ats"])
                if score >= MIN_SCORE:
                    out.append((r["row"], r["key"], r["item_id"], score, identity, n, r["begin"] + begin, r["begin"] + end))
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 8, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    each = met.select("row", "key", "begin", "own", "places", "ats", "item_id", "words", "weights").mapInArrow(run, schema)
    best = F.max(F.struct("score", "identity", "n_seeds", F.col("begin_word").alias("b"), F.col("end_word").alias("e"), "key")).alias("x")
    return each.groupBy("row", "item_id").agg(best).select("row", "x.key", "item_id", "x.score", "x.identity", "x.n_seeds", F.col("x.b").alias("begin_word"), F.col("x.e").alias("end_word"))


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and item that align: doc_id, item_id, score, identity, n_seeds, begin_word, end_word."""
    rows = docs.select(F.col(f"`{text}`").cast("string").alias("text"), F.array(F.col(f"`{key}`").cast("long")).alias("key"))
    with scratch(docs.sparkSession) as work:
        found = aligned(rows, benchmark, item_key, item_text)
        return work.result(found.select(F.col("key")[0].alias("doc_id"), "item_id", "score", "identity", "n_seeds", "begin_word", "end_word"), "matches")


def digest(text: Column) -> Column:
    """128 bits of a text."""
    return F.array(F.xxhash64(text), F.xxhash64(F.lit(1), text))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that align with no item. The verdict is the text's: rows of one text share it,
    whatever their doc_id."""
    of = F.col(f"`{text}`").cast("string")
    with scratch(docs.sparkSession) as work:
        found = aligned(docs.select(of.alias("text"), digest(of).alias("key")), benchmark, item_key, item_text)
        leaks = work.result(found.select("key").distinct(), "leaks")
    # texts are shuffled only where leaks are too many for Spark to broadcast them
    return docs.join(leaks, digest(of) == leaks["key"], "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
