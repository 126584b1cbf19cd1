"""Class-based n-gram language model (Brown classes) by distributed exchange clustering.

Every word of the training part gets a class of its own by exchange: a word moves to the class that the classes beside
it make most likely, with its own counts taken out of its present class. A sweep is one pass over the corpus: chunks
count how often class follows class, and for each of their words how often which class stands beside it, counts of a word meet in one block, the block
chooses, and the word's class goes back to the chunks that hold it. Class bigrams, of fixed size, are all that is
gathered on the driver and sent to every task. Clustering goes from coarse to fine: the CLASSES most frequent words
start as a class each; every sweep takes in GROWTH times as many words, down to those seen once; then sweeps go on over
all words until a sweep adds less than GAIN to what a class says about the next one (nats a token: the likelihood, but for
a constant); it is bounded, so this ends without a limit on sweeps, and a sweep that would lower it is not taken. In a
sweep, half of the words that have a class may move, so that words which attract each other do not change places for ever;
of the other half, chunks send the class alone, as what stands beside them decides nothing.

The probability of a word is that of its class after the class before, interpolated with the class alone, times that of
the word in its class, smoothed as the base model is: each class keeps DELTA for a word it has not seen. An unknown
word has no class; its probability is summed over all classes, and the word behind it is judged by its class alone.

Texts are split once: a chunk's words are kept as places in its sorted list of words, and later passes read these.

Defined results: a null or blank text is the end token alone; a table without training rows scores every text by
smoothing only; repeated rows are scored (and counted) each; rows without doc_id are held out of nothing: their
remainder is undefined, so they train like others; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import SENT, answers, bucketed, dealt, low_bits, message, pack, totals, unpack
from .shared import Scratch, lower_ascii, read, scratch, table, utf8

FOLDS = 10
DELTA = 0.1
CLASSES = 64
#: Weight of the class bigram against the class alone.
BIGRAM = 0.95
GROWTH, GAIN = 12, 0.01
END = b"\n"  # no word can be this; the end token
#: A key of a sweep is a word's hash and a slot: a class to its left, a class to its right, or the class it has now.
WIDTH = np.uint64(8)
SIDES, SLOTS = 2 * CLASSES, 3 * CLASSES + 1


def words_of(text: str | None) -> list[bytes]:
    return [*lower_ascii(utf8(text)).split(), END]


def chunk_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted 64-bit keys of the chunk's words, all texts' words end to end as places among them, and each text's count."""
    ids: dict[bytes, int] = defaultdict()
    ids.default_factory = ids.__len__
    each = []
    for t in texts:
        words = words_of(t)
        each.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
    keys = np.fromiter(map(xxhash.xxh64_intdigest, ids), np.uint64, len(ids))
    found, place = np.unique(keys, return_inverse=True)
    return found, place[np.concatenate(each)], np.array([len(x) for x in each], np.int64)


#: One row for each chunk: its documents, their words, and the words' counts (in the chunk, later in the corpus).
CHUNKS = "chunk long, n_docs long, n_words long, n_tokens long, ids binary, valid binary, held binary, sizes binary, places binary, words binary, counts binary"
END_KEY = np.uint64(xxhash.xxh64_intdigest(END))


def encoded(rows: pa.Table) -> pa.Table:
    """CHUNKS of one chunk of documents; counts: in its own training texts."""
    ids, held = rows.column("doc_id").to_pylist(), np.array(rows.column("held_out").to_pylist(), bool)
    keys, places, sizes = chunk_words(rows.column("text").to_pylist())
    counts = np.bincount(places[np.repeat(~held, sizes)], minlength=len(keys))
    row = {
        "chunk": rows.column("chunk")[0].as_py(), "n_docs": len(ids), "n_words": len(keys), "n_tokens": len(places),
        "ids": np.array([0 if x is None else x for x in ids], "<i8").tobytes(), "valid": np.array([x is not None for x in ids], np.uint8).tobytes(),
        "held": held.astype(np.uint8).tobytes(), "sizes": pack(sizes), "places": pack(places), "words": pack(np.diff(keys, prepend=np.uint64(0))), "counts": pack(counts),
    }
    return pa.Table.from_pylist([row], schema=pa.schema([(n, pa.int64() if t == "long" else pa.binary()) for n, t in (x.split() for x in CHUNKS.split(", "))]))


class Chunk:
    """A row of CHUNKS unpacked."""

    def __init__(self, row: dict) -> None:
        self.chunk = row["chunk"]
        self.keys = np.cumsum(unpack(row["words"], row["n_words"]), dtype=np.uint64)
        self.counts = unpack(row["counts"], row["n_words"]).astype(np.int64)
        self.places = unpack(row["places"], row["n_tokens"]).astype(np.int64)
        self.sizes = unpack(row["sizes"], row["n_docs"]).astype(np.int64)
        self.ids, self.valid, self.held = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["valid"], np.uint8) > 0, np.frombuffer(row["held"], np.uint8) > 0

    def lefts(self) -> np.ndarray:
        """The word before each word; the end token stands before each text."""
        out = np.empty_like(self.places)
        out[1:] = self.places[:-1]
        out[np.cumsum(self.sizes) - self.sizes] = np.searchsorted(self.keys, END_KEY)
        return out

    def training(self) -> tuple[np.ndarray, np.ndarray]:
        """Words of the training texts, and the words before them."""
        own = np.repeat(~self.held, self.sizes)
        return self.places[own], self.lefts()[own]

    def trained(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of a value for each of the chunk's words: those of the training texts' words, and of the words before them."""
        own, x = np.repeat(~self.held, self.sizes), values[self.places]
        before = np.empty_like(x)
        before[1:] = x[:-1]
        before[np.cumsum(self.sizes) - self.sizes] = values[np.searchsorted(self.keys, END_KEY)]
        return x[own], before[own]

    def words(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words occur `least` times in the corpus, their hashes (sorted, less WIDTH bits), and the place of each."""
        some = self.counts >= least
        return some, *np.unique(self.keys[some] >> WIDTH, return_inverse=True)

    def classes(self, found: pa.Table, least: int) -> np.ndarray:
        """Each word's class by the answers to a sweep that took words of `least` occurrences; -1 where it has none."""
        some, words, at = self.words(least)
        states = answers(found)
        states = states[states > 0].astype(np.int64) - 1
        if len(states) != len(words):
            raise ValueError(f"{len(states)} classes for {len(words)} words")
        cls = np.full(len(self.keys), -1, np.int64)
        cls[some] = states[at]
        return cls

    def anchored(self, anchors: np.ndarray) -> np.ndarray:
        """Classes of the first sweep: one for each of the most frequent words. anchors: sorted keys."""
        at = np.minimum(np.searchsorted(anchors, self.keys), len(anchors) - 1)
        return np.where(anchors[at] == self.keys, at, -1)


def class_pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How often class follows class, as one vector; words without a class count nowhere."""
    ok = (left >= 0) & (right >= 0)
    return np.bincount(left[ok].astype(np.int64) * CLASSES + right[ok], minlength=CLASSES * CLASSES)


def may_move(words: np.ndarray, turn: int) -> np.ndarray:
    """Which words that have a class may move in this sweep. words: hashes less WIDTH bits."""
    return ((words >> np.uint64(13)) ^ np.uint64(turn)) & np.uint64(1) == 0


def neighbours(c: Chunk, cls: np.ndarray, least: int, low: int, turn: int) -> pa.Table:
    """SENT: for each word of `least` occurrences its own class, and of those that may move (or have none) how often which
    class stands beside them."""
    some, words, at = c.words(least)
    state = np.zeros(len(words), np.int64)
    state[at] = cls[some] + 1
    asks = may_move(words, turn) | (state == 0)
    kind = np.int32 if len(words) * SLOTS < 1 << 31 else np.int64
    place = np.full(len(c.keys), -1, kind)
    place[some] = np.where(asks[at], at * SLOTS, -1)
    (x, before), (class_x, class_before) = c.trained(place), c.trained(cls.astype(np.int8))
    keys = []
    for own, beside, side in ((x, class_before, 0), (before, class_x, CLASSES)):
        ok = (own >= 0) & (beside >= 0)
        keys.append(own[ok] + beside[ok] + kind(side))
    keys.append((np.arange(len(words)) * SLOTS + SIDES + state).astype(kind))
    every = np.concatenate(keys)
    if len(words) * SLOTS < 1 << 24:
        counts = np.bincount(every, minlength=0)
        pairs = np.flatnonzero(counts)
        counts = counts[pairs]
    else:
        pairs, counts = np.unique(every, return_counts=True)
    word, slot = np.divmod(pairs, kind(SLOTS))
    return message(c.chunk, (words[word] << WIDTH) | slot.astype(np.uint64), counts, low)


#: What a chunk sends in a sweep, and in a row of its own how often class follows class in it.
ASKED = f"{SENT}, bigrams binary"


def asked(c: Chunk, cls: np.ndarray, least: int, low: int, turn: int) -> pa.Table:
    """ASKED of a chunk, by the classes before the sweep."""
    sent, (right, left) = neighbours(c, cls, least, low, turn), c.trained(cls.astype(np.int8))
    sent = sent.append_column("bigrams", pa.nulls(sent.num_rows, pa.binary()))
    own = {"block": -1, "chunk": c.chunk, "n": 0, "keys": b"", "counts": b"", "checks": b"", "bigrams": pack(class_pairs(left, right))}
    return pa.concat_tables([sent, pa.Table.from_pylist([own], schema=sent.schema)])


def added_up(vectors: DataFrame, size: int) -> np.ndarray:
    """Sum of packed vectors (column v, and part to spread them by); 64 rows at most reach the driver."""

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(size, np.uint64)
        for v in rows.column("v"):
            total += unpack(v.as_py(), size)
        return pa.table({"v": pa.array([pack(total)], pa.binary())})

    rows = vectors.select("v", F.pmod(F.xxhash64("part"), F.lit(64)).alias("salt")).groupBy("salt").applyInArrow(add, "v binary").collect()
    return sum((unpack(bytes(r["v"]), size) for r in rows), np.zeros(size, np.uint64)).astype(np.int64)


def chosen(keys: np.ndarray, counts: np.ndarray, both: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of a block (keys are sorted): class before (-1: none) and after, tokens that tell of it, and which of keys
    tells a word's present class.

    A move gains, to first order, the sum over neighbours of the logarithm of class pairs against what the two classes
    would give by chance; its own tokens do not speak for the class that a word is in.
    """
    word, slot = keys >> WIDTH, (keys & np.uint64((1 << int(WIDTH)) - 1)).astype(np.int64)
    state = slot >= SIDES
    new_word = np.ones(len(word), bool)
    new_word[1:] = word[1:] != word[:-1]
    found, at = word[new_word], np.cumsum(new_word) - 1
    old = np.full(len(found), -1, np.int64)
    old[at[state]] = slot[state] - SIDES - 1
    from_, to = both.sum(axis=1), both.sum(axis=0)
    log, log_from, log_to = np.log(both + DELTA), np.log(from_ + DELTA * CLASSES), np.log(to + DELTA * CLASSES)
    new, mass = old.copy(), np.zeros(len(found), np.int64)
    may = (old < 0) | may_move(found, turn)
    which, some = np.flatnonzero(may), may[at] & ~state
    row, slot, counts = (np.cumsum(may) - 1)[at[some]], slot[some], counts[some]
    for a in range(0, len(which), 4096):
        own = which[a : a + 4096]
        part = slice(*np.searchsorted(row, [a, a + len(own)]))
        seen = np.zeros((len(own), SIDES))
        seen[row[part] - a, slot[part]] = counts[part]
        left, right = seen[:, :CLASSES], seen[:, CLASSES:]
        n_left, n_right = left.sum(axis=1), right.sum(axis=1)
        gain = right @ log.T + left @ log - np.outer(n_right, log_from) - np.outer(n_left, log_to)
        gain[:, from_ + to == 0] = -np.inf
        k = np.flatnonzero(old[own] >= 0)
        o, r, l = old[own[k]], right[k], left[k]  # noqa: E741
        less = lambda x, y: np.log(np.maximum(x - y, 0) + DELTA)
        gain[k, o] = (r * less(both[o], r)).sum(axis=1) + (l * less(both[:, o].T, l)).sum(axis=1)
        gain[k, o] -= n_right[k] * np.log(np.maximum(from_[o] - n_right[k], 0) + DELTA * CLASSES) + n_left[k] * np.log(np.maximum(to[o] - n_left[k], 0) + DELTA * CLASSES)
        new[own], mass[own] = gain.argmax(axis=1), n_left
    return old, new, mass, state


def counts_summary(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The counts, and of their block: tokens and words in training, words by the bit length of their count, and its most frequent words."""
    size = np.zeros(len(counts), np.int64)
    for k in range(64):
        size += counts >= np.uint64(1 << k)
    top = np.argsort(counts, kind="stable")[::-1][:CLASSES]
    numbers = np.concatenate([[int(counts.sum()), int((counts > 0).sum())], np.bincount(size, minlength=65)]).astype("<u8")
    return counts, np.concatenate([numbers, keys[top], counts[top]]).astype("<u8").tobytes()


@dataclass(frozen=True)
class Vocabulary:
    """tokens and words of the training part; sizes[k]: words of at least 2 ** k occurrences; anchors: keys, sorted."""

    tokens: int
    words: int
    sizes: np.ndarray
    anchors: np.ndarray

    def steps(self) -> list[int]:
        """Least counts of words that sweeps take in: GROWTH times as many words each time, at last all."""
        out, k = [], CLASSES
        for bit in range(63, 0, -1):
            if self.sizes[bit] >= GROWTH * k:
                out.append(1 << bit)
                k = int(self.sizes[bit])
        return [*out, 1]


def vocabulary(found: DataFrame) -> Vocabulary:
    """From the blocks' summaries, added up on Spark: a few numbers and CLASSES words reach the driver."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                v = np.frombuffer(x.as_py(), "<u8").astype(np.int64)
                top = v[67:].reshape(2, -1)
                what = np.concatenate([np.arange(67), np.full(top.shape[1], 67)])
                yield pa.RecordBatch.from_arrays([pa.array(what), pa.array(np.concatenate([np.zeros(67, np.int64), top[0]])), pa.array(np.concatenate([v[:67], top[1]]))], names=["what", "key", "n"])

    numbers = found.where("chunk = -1").select("answer").mapInArrow(rows, "what long, key long, n long")
    sums = {r["what"]: r["n"] for r in numbers.where("what < 67").groupBy("what").agg(F.sum("n").alias("n")).collect()}
    top = numbers.where("what = 67 AND n > 0").orderBy(F.desc("n"), "key").limit(CLASSES).collect()
    by_size = np.array([sums.get(2 + k, 0) for k in range(1, 65)])  # by bit length 1 to 64
    return Vocabulary(sums.get(0, 0), sums.get(1, 0), np.cumsum(by_size[::-1])[::-1], np.sort(np.array([r["key"] for r in top], np.int64).astype(np.uint64)))


@dataclass(frozen=True)
class Model:
    """moves[c, d]: probability of class d after c (row CLASSES: after an unknown word); mass and kinds: tokens and words
    of each class; total and words: of the training part."""

    moves: np.ndarray
    mass: np.ndarray
    kinds: np.ndarray
    total: int
    words: int


def model_of(both: np.ndarray, mass: np.ndarray, kinds: np.ndarray, total: int, words: int) -> Model:
    both = both.reshape(CLASSES, CLASSES).astype(float)
    alone = (both.sum(axis=0) + DELTA) / (both.sum() + DELTA * CLASSES)
    after = both / np.maximum(both.sum(axis=1, keepdims=True), 1)
    weight = np.where(both.sum(axis=1, keepdims=True) > 0, BIGRAM, 0.0)
    return Model(np.vstack([weight * after + (1 - weight) * alone, alone]), mass, kinds, total, words)


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_chunk(c: Chunk, cls: np.ndarray, model: Model) -> pa.Table:
    """Both scores of a chunk's texts."""
    base = np.log10((c.counts + DELTA) / (model.total + DELTA * (model.words + 1)))
    size = model.mass + DELTA * (model.kinds + 1)
    known = c.counts > 0
    word = (c.counts + DELTA) / size[cls]
    unknown = model.moves @ (DELTA / size)
    left, x = c.lefts(), c.places
    after = np.where(known[left], cls[left], CLASSES)
    p = np.log10(np.where(known[x], model.moves[after, cls[x]] * word[x], unknown[after]))
    starts = np.cumsum(c.sizes) - c.sizes
    return pa.table({
        "doc_id": pa.array(c.ids, mask=~c.valid), "held_out": pa.array(c.held), "n_tokens": pa.array(c.sizes), "n_known": pa.array(np.add.reduceat(known[x].astype(np.int64), starts)),
        "train_tokens": pa.array(np.full(len(starts), model.total)), "base_score": pa.array(np.add.reduceat(base[x], starts)), "score": pa.array(np.add.reduceat(p, starts)),
    })


def remainder(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(FOLDS), F.lit(-1))


def counted_chunks(rows: DataFrame) -> tuple[DataFrame, Vocabulary, int]:
    """The corpus as CHUNKS with counts over the corpus (two tables bucketed alike), its vocabulary, and the number of parts."""
    found, n, buckets = dealt(rows)
    own = bucketed(found.repartition(buckets, "chunk").groupBy("chunk").applyInArrow(encoded, CHUNKS), buckets, there=True)
    low = low_bits(n, 64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                keys = np.cumsum(unpack(r["words"], r["n_words"]), dtype=np.uint64)
                yield from message(r["chunk"], keys, unpack(r["counts"], r["n_words"]), low).to_batches()

    def settle(back: pa.Table) -> pa.Table:
        return pa.table({"chunk": back.column("chunk")[:1], "counts": pa.array([pack(answers(back))], pa.binary())})

    sums = table(totals(own.select("chunk", "n_words", "words", "counts").mapInArrow(send, SENT), n, 64, final=counts_summary), "counts")
    counts = bucketed(sums.where("chunk >= 0").groupBy("chunk").applyInArrow(settle, "chunk long, counts binary"), buckets)
    return own.drop("counts").join(counts, "chunk"), vocabulary(sums), n


def sweep(work: Scratch, sent: DataFrame, n: int, turn: int, both: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """One exchange sweep: classes as answers to what the chunks sent (SENT), as a result of work, and how many words each has.
    both: bigrams of the classes before."""
    both = both.reshape(CLASSES, CLASSES).astype(float)

    def final(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, bytes]:
        _, new, _, state = chosen(keys, counts, both, turn)
        out = np.zeros(len(keys), np.uint64)
        out[state] = new + 1
        return out, pack(np.bincount(new, minlength=CLASSES))

    out = work.result(totals(sent, n, 64, final=final, sparse=True), "classes")
    return out.where("chunk >= 0"), added_up(out.where("chunk = -1").select(F.col("answer").alias("v"), F.col("block").alias("part")), CLASSES)


def classed(chunks: DataFrame, found: DataFrame | None, least: int, anchors: np.ndarray, make: Callable[[Chunk, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """What make makes of each chunk and its words' classes: those of the answers found, or of anchors where there are none yet."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                c = Chunk(r)
                yield from make(c, c.anchored(anchors)).to_batches()

    def later(left: pa.Table, right: pa.Table) -> pa.Table:
        c = Chunk(left.to_pylist()[0])
        return make(c, c.classes(right, least))

    return chunks.mapInArrow(first, schema) if found is None else chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(later, schema)


def information(both: np.ndarray) -> float:
    """What a class says about the next one: mutual information in nats a token."""
    pairs = both.reshape(CLASSES, CLASSES).astype(float)
    ends = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
    total = pairs.sum()
    return (ends(pairs) - ends(pairs.sum(axis=0)) - ends(pairs.sum(axis=1)) + ends(total)) / max(1.0, total)


def bigrams(chunks: DataFrame, found: DataFrame | None, least: int, anchors: np.ndarray) -> np.ndarray:
    """How often class follows class, in all training texts."""

    def pairs(c: Chunk, cls: np.ndarray) -> pa.Table:
        right, left = c.trained(cls.astype(np.int8))
        return pa.table({"v": pa.array([pack(class_pairs(left, right))], pa.binary()), "part": pa.array([c.chunk], pa.int64())})

    return added_up(classed(chunks, found, least, anchors, pairs, "v binary, part long"), CLASSES * CLASSES)


def clustered(chunks: DataFrame, n: int, words: Vocabulary, gain: float = GAIN) -> tuple[DataFrame, np.ndarray]:
    """Answers with every training word's class, and the mass and number of words of each class.

    One pass over the chunks counts the bigrams of the classes that a sweep left and what chunks send in the next, which is
    kept until its end; what they send after the last sweep is not used."""
    steps, low = words.steps(), low_bits(n, 64)
    found, kinds, before, best = None, None, 1, None
    for turn in count():
        least = steps[turn] if turn < len(steps) else 1
        with scratch(chunks.sparkSession) as work:
            make = lambda c, cls, least=least, turn=turn: asked(c, cls, least, low, turn)
            sent = table(classed(chunks, found, before, words.anchors, make, ASKED), "asked")
            both = added_up(sent.where("bigrams IS NOT NULL").select(F.col("bigrams").alias("v"), F.col("chunk").alias("part")), CLASSES * CLASSES)
            if turn >= len(steps):  # every word has a class
                more = np.inf if best is None else information(both) - information(best[2])
                if more > 0:
                    best = found, kinds, both
                if more < gain:
                    break
            found, kinds = sweep(work, sent.where("bigrams IS NULL").drop("bigrams"), n, turn, both)
        before = least
    found, kinds, both = best
    return found, np.concatenate([both.reshape(CLASSES, CLASSES).sum(axis=0), kinds])  # each token follows one that has a class


def score(docs: DataFrame) -> DataFrame:
    """See SCHEMA; a row for every document."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", remainder(F.col("doc_id")) == 0)
    with scratch(spark) as work:
        chunks, words, n = counted_chunks(rows)
        if words.words:
            found, sums = clustered(chunks, n, words)
            both = bigrams(chunks, found, 1, words.anchors)
        else:
            found, sums = spark.createDataFrame([], "chunk long, block long, n long, answer binary"), np.zeros(2 * CLASSES, np.int64)
            both = np.zeros(CLASSES * CLASSES, np.int64)
        model = model_of(both, sums[:CLASSES], sums[CLASSES:], words.tokens, words.words)  # of fixed size

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            c = Chunk(left.to_pylist()[0])
            return score_chunk(c, c.classes(right, 1), model)

        met = chunks.groupBy("chunk").cogroup(found.groupBy("chunk"))
        return work.result(met.applyInArrow(run, SCHEMA), "scores")


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"))
