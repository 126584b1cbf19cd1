"""Toxicity by subword-bag embeddings.

A word is the mean of the vectors of its hashed character n-grams and of itself; a stretch of text is the mean of its
words; a linear softmax on that mean gives the probability. Vectors and softmax are trained jointly in numpy on a
bounded sample of labelled documents, so a misspelling never seen shares most of its n-grams with the word it bends.
A document's label says that something in it is toxic, not where: training first takes whole documents, then for each
document the window of WINDOW words that scores highest (multiple-instance learning). N-grams of fewer than LEAST_DOCS
training documents have no vector. A document's score is that of its highest window, over all windows of the whole text,
every word at its place. As the softmax is linear, a word's part in it is one number; scoring is a lookup and a running mean.

Defined results: a null or blank text has no window and gets the score of the bias alone; without labels of both kinds
every score is the share of label 1 (0 where there are no labels); repeated rows are scored each for itself; rows
without doc_id count as not held out and are never used to learn.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import mix, read, utf8

BUCKETS, DIM = 1 << 17, 8
SIZES = (3, 4, 5)
WINDOW = 8
LEAST_DOCS = 3
FOLDS = 5
#: The sample to learn from: so many labelled documents of each kind at most, none longer than MAX_BYTES.
SAMPLE_TOXIC, SAMPLE_CLEAN, MAX_BYTES = 800, 1600, 8_000
WHOLE_STEPS, WINDOW_STEPS, RATE, DECAY, SEED = 24, 96, 0.08, 1e-4, 7
CACHE_WORDS = 500_000
MARKS = "\"'`.,;:!?()[]{}<>*#%&$|-_=+/\\~^«»„“”‘’…–—"


def words_of(text: str | None) -> list[str]:
    """All words of a text in their order, without the marks around them; what is marks alone is no word."""
    return [w for x in (text or "").lower().split() if (w := x.strip(MARKS))]


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all words, one after another, and the index of the word that each belongs to."""
    data = [b"<" + utf8(w) + b">" for w in words]
    sizes = np.array([len(x) for x in data], np.int64)
    letters = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(data)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(letters))  # letters from here to the word's end
    buckets, owners = [], []
    code = np.zeros(len(letters), np.uint64)
    for n in range(1, max(SIZES) + 1):
        size = len(letters) - n + 1
        if size <= 0:
            break
        code = code[:size] * np.uint64(1_000_003) + letters[n - 1 :]
        if n in SIZES:
            ok = left[:size] >= n
            buckets.append(mix(code[ok] + np.uint64(n << 56)) % np.uint64(BUCKETS))
            owners.append(owner[:size][ok])
    whole = np.array([hash_bytes(x) for x in data], np.uint64)
    buckets.append(mix(whole) % np.uint64(BUCKETS))
    owners.append(np.arange(len(data)))
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


def hash_bytes(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data)


@dataclass
class Model:
    """grams: each bucket's part in the log odds; bias."""

    grams: np.ndarray
    bias: float

    def words(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.empty(0)
        buckets, owners = subwords(words)
        total = np.bincount(owners, self.grams[buckets], len(words))
        return total / np.bincount(owners, minlength=len(words))


def best_window(values: np.ndarray, width: int = WINDOW) -> tuple[float, int, int]:
    """Highest mean of a window, and its bounds; the whole where the text is shorter."""
    if len(values) <= width:
        return (float(values.mean()) if len(values) else 0.0), 0, len(values)
    sums = np.concatenate([[0.0], np.cumsum(values)])
    means = (sums[width:] - sums[:-width]) / width
    k = int(means.argmax())
    return float(means[k]), k, k + width


def grams_of(parts: list[np.ndarray], buckets: np.ndarray, owners: np.ndarray, per_word: np.ndarray, step: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A sparse map from buckets to texts: text, bucket, and weight of the bucket's vector in the text's mean.

    parts: word ids of each text; buckets, owners: n-grams with a vector, by word; per_word: all n-grams of each word.
    Texts are taken step by step, as the n-grams of all of them are many times what is left after summing up.
    """
    count = np.bincount(owners, minlength=len(per_word))
    first = np.cumsum(count) - count
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(parts), step):
        some = parts[at : at + step]
        size = np.array([len(p) for p in some])
        words, text = np.concatenate(some), np.repeat(np.arange(at, at + len(some)), size)
        n = count[words]
        place = np.repeat(first[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        share = 1.0 / (np.repeat(size, size) * per_word[words])
        pair, inverse = np.unique(np.repeat(text, n) * np.int64(BUCKETS) + buckets[place], return_inverse=True)
        out.append(((pair // BUCKETS).astype(np.int32), (pair % BUCKETS).astype(np.int32), np.bincount(inverse, np.repeat(share, n), len(pair))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def train(texts: list[str | None], labels: list[int]) -> Model:
    """Joint training of vectors and softmax by full-batch Adam."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(BUCKETS), float(np.log(max(share, 1e-9)) - np.log(max(1 - share, 1e-9))))
    docs = [words_of(t) for t in texts]
    ids: dict[str, int] = {}
    docs_ids = [np.array([ids.setdefault(w, len(ids)) for w in d], np.int64) for d in docs]
    names, found = list(ids), []
    for at in range(0, len(names), 10_000):
        b, o = subwords(names[at : at + 10_000])
        order = np.argsort(o, kind="stable")
        found.append((b[order].astype(np.int32), (o[order] + at).astype(np.int32)))
    buckets, owners = (np.concatenate(x) for x in zip(*found, strict=True))
    del names, found
    per_word = np.bincount(owners, minlength=len(ids)).astype(float)
    held_by = np.bincount(np.concatenate([np.unique(d) for d in docs_ids]), minlength=len(ids))
    common = np.bincount(buckets, held_by[owners], BUCKETS) >= LEAST_DOCS  # by words, so at least by so many uses
    live = common[buckets]
    buckets, owners = buckets[live], owners[live]
    rng = np.random.default_rng(SEED)
    vectors = np.where(common[:, None], rng.normal(0, 0.1, (BUCKETS, DIM)), 0.0)
    out = rng.normal(0, 0.1, (DIM, 2))
    bias = np.array([0.0, np.log(y.mean()) - np.log(1 - y.mean())])
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (vectors, out, bias)]
    onehot = np.stack([1 - y, y], axis=1)
    for step in range(WHOLE_STEPS + WINDOW_STEPS):
        if step == 0 or step >= WHOLE_STEPS and (step - WHOLE_STEPS) % 8 == 0:
            parts = docs_ids
            if step >= WHOLE_STEPS:
                grams = vectors @ (out[:, 1] - out[:, 0])
                value = np.bincount(owners, grams[buckets], len(ids)) / per_word
                parts = [d[slice(*best_window(value[d])[1:])] for d in docs_ids]
            pair_doc, pair_bucket, weight = grams_of(parts, buckets, owners, per_word)
        mean = np.stack([np.bincount(pair_doc, weight * vectors[pair_bucket, k], len(y)) for k in range(DIM)], axis=1)
        logits = mean @ out + bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        error = (p - onehot) / len(y)
        back = error @ out.T
        g_vectors = np.stack([np.bincount(pair_bucket, weight * back[pair_doc, k], BUCKETS) for k in range(DIM)], axis=1)
        for (m, v), value, g in zip(state, (vectors, out, bias), (g_vectors, mean.T @ error, error.sum(axis=0)), strict=True):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            value -= RATE * DECAY * value if value.ndim == 2 else 0
            value -= RATE * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(v / (1 - 0.99 ** (step + 1))) + 1e-8)
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32).astype(float), float(bias[1] - bias[0]))


def remainder(key: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % F.lit(folds), F.lit(-1))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """From a bounded sample of labelled rows outside the held-out fold, chosen by a hash of doc_id."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (remainder(F.col("doc_id")) != 0))
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y"))
    # a few times the sample: some of these documents may be too long or missing
    chosen = [rows.where(f"y = {y}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(3 * n) for y, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))]
    sample = chosen[0].unionAll(chosen[1])  # at most 3 * (SAMPLE_TOXIC + SAMPLE_CLEAN) rows, whatever the input
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull() & (F.octet_length("text") <= MAX_BYTES))
    joined = texts.join(F.broadcast(sample), "doc_id")
    found = [joined.where(f"y = {y}").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(n).collect() for y, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))]
    both = [r for part in found for r in part]
    return train([r["text"] for r in both], [r["y"] for r in both])


class Scorer:
    """A worker's word scores by lookup; of tokens that are marks alone, not a number."""

    def __init__(self, model: Model) -> None:
        self.model, self.seen = model, {}

    def scores(self, texts: list[str | None]) -> list[float]:
        docs = [(t or "").lower().split() for t in texts]
        if len(self.seen) > CACHE_WORDS:
            self.seen.clear()
        new = list({w for d in docs for w in d if w not in self.seen})
        for at in range(0, len(new), 20_000):
            part = [(x, w) for x in new[at : at + 20_000] if (w := x.strip(MARKS))]
            self.seen.update(dict.fromkeys(new[at : at + 20_000], np.nan))
            self.seen.update(zip([x for x, _ in part], self.model.words([w for _, w in part]).tolist(), strict=True))
        get, out = self.seen.__getitem__, []
        for d in docs:
            values = np.fromiter(map(get, d), float, len(d))
            x = best_window(values[~np.isnan(values)])[0] + self.model.bias
            out.append(float(1 / (1 + np.exp(-min(max(x, -40.0), 40.0)))))
        return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; one narrow pass. The model's size is fixed (1 MB)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scorer.scores(part.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, fit(docs, read(spark, sf_dir, "labels")))
