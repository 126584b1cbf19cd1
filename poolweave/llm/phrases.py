"""Phrase collocation mining by SON partitioning: what is frequent in the corpus is locally frequent in some shard.

Texts become chunks of word ids where they lie, and chunks make SHARDS shards. A phrase of f occurrences has, in at least one
shard, as large a share of f as the shard has of all words; so each shard is mined completely at that lowered support, its
locally frequent phrases are united over the shards, and all candidates are counted over the whole corpus. That is done
length by length: a chunk sends every phrase both of whose shorter parts are candidates, with its count; where the counts
of a phrase meet, they are added up by shard (is it locally frequent in any?) and over all of them (its exact count, as
every chunk that has a candidate's parts sends it). Candidates are closed under taking parts, so nothing is lost, and the
support does not sink to 1 as the corpus grows, since the shards stay few while their chunks grow in number.

A chunk that holds a phrase holds its parts, so it knows all counts that the score needs, and, since a longer phrase as
frequent as the phrase surrounds each of its occurrences, whether a longer one drops it. It scores its phrases by itself;
only its best `top` of each lang leave it, among which are all of the corpus's best that it holds.

Phrases and words are compared by 64-bit hashes, those of a lang apart from all others.

Defined results: a null text is empty, a null lang is `und`; a lang without frequent phrases gives no rows; repeated rows
count each; a document is never cut, so a chunk holds at least one whole document; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import CHUNK, SENT, Shards, answers, bucketed, low_bits, message, totals
from .shared import chunk_count, mix, read, scratch, table, utf8

SUPPORT = 100
LONGEST = 5
TOP = 2000
SHARDS = 16
#: Parts in which the best phrases of a lang are looked for first.
SALTS = 64
BITS = 64
#: Ends of pieces become \n, tabs a space, A-Z small letters.
BYTES = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
TOKENS = "chunk long, n_words long, langs array<binary>, lang_words binary, words binary, ids binary"


@dataclass
class Tokens:
    """A chunk: its langs, its different (lang, word) pairs, and the places in them of its words, -1 between pieces."""

    langs: list[bytes]
    lang_of: np.ndarray
    words: list[bytes]
    ids: np.ndarray


def tokens(texts: list[str | None], langs: list[str | None]) -> Tokens:
    by: dict[bytes, list[bytes]] = {}
    for text, lang in zip(texts, langs, strict=True):
        by.setdefault(b"und" if lang is None else utf8(lang), []).append(utf8(text).translate(BYTES))
    words: list[bytes] = []
    ids, lang_of = [], []
    for k, each in enumerate(by.values()):
        known: dict[bytes, int] = {b"\n": -1}
        base = len(words)
        split = filter(None, b"\n".join([b"", *each, b""]).replace(b"\n", b" \n ").split(b" "))
        found = np.array([known.setdefault(w, len(known) - 1) for w in split], np.int64)
        ids.append(np.where(found < 0, -1, found + base))
        words += list(known)[1:]
        lang_of.append(np.full(len(known) - 1, k, np.int64))
    return Tokens(list(by), np.concatenate(lang_of or [np.empty(0, np.int64)]), words, np.concatenate(ids or [np.empty(0, np.int64)]))


def tokenized(docs: DataFrame, size: int) -> DataFrame:
    """TOKENS: documents in chunks of about size bytes, made where they lie; no text is shuffled."""

    def chunk(texts: list, langs: list, number: int) -> pa.RecordBatch:
        t = tokens(texts, langs)
        # shards are told by the low bits: they are sets of partitions
        row = [(number << 31) + TaskContext.get().partitionId(), int((t.ids >= 0).sum()), t.langs, t.lang_of.astype("<i4").tobytes(), b"\n".join(t.words), t.ids.astype("<i4").tobytes()]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in TOKENS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, langs, held, number = [], [], 0, 0
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                texts.append(text)
                langs.append(lang)
                held += len(text or "")
                if held >= size:
                    yield chunk(texts, langs, number)
                    texts, langs, held, number = [], [], 0, number + 1
        if texts:
            yield chunk(texts, langs, number)

    return docs.select(*(F.col(c).cast("string").alias(c) for c in ("text", "lang"))).mapInArrow(run, TOKENS)


def untabled(rows: pa.Table) -> Tokens:
    langs, lang_of, words, ids = (rows.column(c)[0].as_py() for c in ("langs", "lang_words", "words", "ids"))
    return Tokens(langs, np.frombuffer(lang_of, "<i4").astype(np.int64), words.split(b"\n") if words else [], np.frombuffer(ids, "<i4").astype(np.int64))


@dataclass
class Level:
    """Phrases of one length: where each starts (places of ids), the place of its key among the chunk's sorted keys, those
    keys and how often the chunk has them."""

    at: np.ndarray
    inverse: np.ndarray
    keys: np.ndarray
    counts: np.ndarray


STEP = np.uint64(0x9E3779B97F4A7C15)


class Mined:
    """A chunk and what it knows so far: total[m][p] is the count of the phrase of m words at place p, 0 if no candidate."""

    def __init__(self, t: Tokens) -> None:
        self.t = t
        seeds = [xxhash.xxh64_intdigest(x) for x in t.langs]
        self.lang_keys = np.array([xxhash.xxh64_intdigest(x, 1) for x in t.langs], np.uint64)
        self.hashes = np.array([xxhash.xxh64_intdigest(w, seeds[k]) for w, k in zip(t.words, t.lang_of.tolist(), strict=True)], np.uint64)
        self.levels: list[Level] = []
        self.total: list[np.ndarray] = []
        self.n: np.ndarray | None = None

    def words(self) -> Level:
        """The first level: all words, and for each lang one more key, which stands for all its words."""
        at = np.flatnonzero(self.t.ids >= 0)
        count = np.bincount(self.t.ids[at], minlength=len(self.hashes))
        every = np.bincount(self.t.lang_of, count, len(self.lang_keys)).astype(np.int64)
        keys, inverse = np.unique(np.concatenate([self.hashes, self.lang_keys]), return_inverse=True)
        return Level(at, inverse[self.t.ids[at]], keys, np.bincount(inverse, np.concatenate([count, every]), len(keys)).astype(np.int64))

    def longer(self) -> Level:
        """Phrases one word longer than the last level's, both of whose parts are candidates."""
        m, last = len(self.levels), self.total[-1]
        at = np.flatnonzero((last[:-1] > 0) & (last[1:] > 0))
        key = self.hashes[self.t.ids[at]]
        for k in range(1, m + 1):
            key = mix(key * STEP + self.hashes[self.t.ids[at + k]])
        keys, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        return Level(at, inverse, keys, counts)

    def learn(self, level: Level, found: np.ndarray) -> None:
        """found: the corpus's counts of the level's keys."""
        total = np.zeros(len(self.t.ids), np.int64)
        total[level.at] = found.astype(np.int64)[level.inverse]
        if not self.levels:
            self.n = found.astype(np.int64)[np.searchsorted(level.keys, self.lang_keys)]
        self.levels.append(level)
        self.total.append(total)

    def next(self) -> Level:
        return self.longer() if self.levels else self.words()


def known(rows: pa.Table, found: pa.Table) -> Mined:
    """A chunk with all that came back to it: ANSWER rows with the length they are for."""
    mined = Mined(untabled(rows))
    length = found.column("length").to_numpy()
    for m in sorted(set(length.tolist())):
        mined.learn(mined.next(), answers(found.filter(pa.array(length == m))))
    return mined


def scored(mined: Mined, support: int, top: int | None) -> list[tuple]:
    """lang, phrase, a, l, r, n, score of the chunk's phrases that stay, of each lang its best."""
    t, out = mined.t, {}
    for m in range(2, len(mined.levels) + 1):
        level, total = mined.levels[m - 1], mined.total[m - 1]
        places = level.at[np.unique(level.inverse, return_index=True)[1]]
        places = places[total[places] >= support]
        if m < len(mined.levels):
            more = mined.total[m]
            before = np.where(places > 0, more[places - 1], 0)
            places = places[(more[places] < total[places]) & (before < total[places])]
        for p in places.tolist():
            a, k = int(total[p]), int(t.lang_of[t.ids[p]])
            n = int(mined.n[k])
            cuts = [(1000 * a * n // (left * right), c, left, right) for c in range(1, m) for left, right in [(int(mined.total[c - 1][p]), int(mined.total[m - c - 1][p + c]))]]
            score, _, left, right = min(cuts)
            out.setdefault(k, []).append((-score, -a, b" ".join(t.words[i] for i in t.ids[p : p + m].tolist()), left, right, n))
    return [(t.langs[k].decode("utf-8", "replace"), w.decode("utf-8", "replace"), -a, left, right, n, -s) for k, rows in out.items() for s, a, w, left, right, n in sorted(rows)[:top]]


PHRASES = "lang string, phrase string, a long, l long, r long, n long, score long"


def collocations(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, top: int | None = None, shards: int = SHARDS, size: int = CHUNK) -> DataFrame:
    """PHRASES of every lang that are frequent and not dropped; with top, at least the best ones of each lang."""
    with scratch(docs.sparkSession) as work:
        spark = docs.sparkSession
        parts = chunk_count(docs, "text", size)
        least, most = int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))
        chunks = bucketed(tokenized(docs, size), min(most, max(least, -(-parts // 2))))
        low = low_bits(parts, BITS)
        share = Shards.of(chunks, parts, shards, "n_words", support)
        found: DataFrame | None = None
        for m in range(1, longest + 1):
            if found is None:
                sent = chunks.groupBy("chunk").applyInArrow(lambda t: sent_by(Mined(untabled(t)), t, low), SENT)
            else:
                sent = chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(lambda t, f: sent_by(known(t, f), t, low), SENT)
            new = table(totals(sent, parts, BITS, shards=share).withColumn("length", F.lit(m)), "totals")
            found = new if found is None else found.unionAll(new)

        def last(t: pa.Table, f: pa.Table) -> pa.Table:
            rows = scored(known(t, f), support, top)
            names, kinds = zip(*(c.split() for c in PHRASES.split(", ")), strict=True)
            types = {"string": pa.string(), "long": pa.int64()}
            return pa.table([pa.array([r[i] for r in rows], types[k]) for i, k in enumerate(kinds)], names=list(names))

        every = chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(last, PHRASES)
        rest = ("a", "l", "r", "n", "score")
        one = every.groupBy("lang", "phrase").agg(*(F.max(c).alias(c) for c in rest))  # chunks agree
        return work.result(one, "collocations")


def sent_by(mined: Mined, rows: pa.Table, low: int) -> pa.Table:
    level = mined.next()
    return message(rows.column("chunk")[0].as_py(), level.keys, level.counts, low)


def ranked(found: DataFrame, top: int) -> DataFrame:
    """The best of each lang, with their rank; of each of SALTS parts of a lang first."""
    order: list[Column] = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    some = found.withColumn("place", F.row_number().over(part)).where(F.col("place") <= top).drop("place")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(collocations(read(spark, sf_dir, "documents"), top=TOP), TOP).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS id, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
words AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM pieces),
grams AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))) AS phrase FROM words, range(1, 6) t(m) WHERE len(w) >= m),
f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 100),
part AS (SELECT c.lang, c.m, c.phrase, c.a, k, array_to_string(w[1 : k], ' ') AS x, array_to_string(w[k + 1 : c.m], ' ') AS y FROM c, range(1, 5) t(k) WHERE k < c.m),
cut AS (SELECT p.lang, p.m, p.phrase, p.a, k, x.f AS l, y.f AS r, n.n, CAST((1000::HUGEINT * p.a * n.n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM part p JOIN f x ON x.lang = p.lang AND x.phrase = p.x JOIN f y ON y.lang = p.lang AND y.phrase = p.y JOIN n ON n.lang = p.lang),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
dropped AS (SELECT DISTINCT s.lang, s.phrase FROM (SELECT lang, a, unnest([array_to_string(w[1 : m - 1], ' '), array_to_string(w[2 : m], ' ')]) AS phrase FROM c WHERE m > 2) b JOIN c s ON s.lang = b.lang AND s.phrase = b.phrase AND s.a <= b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best b
WHERE NOT EXISTS (SELECT 1 FROM dropped d WHERE d.lang = b.lang AND d.phrase = b.phrase) QUALIFY rank <= 2000
"""
