"""Phrase mining against counting every phrase in plain Python."""

import random
import re
from collections import Counter

import pytest

from poolweave.llm import chunks, phrases

SCHEMA = "text string, lang string, doc_id long, phrase string, chunk long, n long, rank string"


def plain(rows, support, top, longest=5):
    counts, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            counts.update((lang, tuple(w[i : i + m])) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    found = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= support}
    dropped = {(lang, w[i : i + m]) for (lang, w), a in found.items() for m in range(2, len(w)) for i in range(len(w) - m + 1) if a >= counts[lang, w[i : i + m]]}
    rows = []
    for (lang, w), a in found.items():
        if (lang, w) not in dropped:
            cuts = [(1000 * a * n[lang] // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            rows.append((lang, -score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]]))
    out, rank = [], Counter()
    for lang, score, a, phrase, left, right in sorted(rows):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return out


def rows():
    """Repeated words and phrases in two langs, a long text, nulls, blanks, odd white space, a hot line in a third of all rows."""
    r = random.Random(3)
    fixed = ["new york", "a b a b a", "x x x x x x", "in the end of it", "Été à la", "one\x0btwo three"]
    out = []
    for i in range(400):
        words = [r.choice(fixed) if r.random() < 0.3 else f"w{min(int(r.paretovariate(0.8)), 60)}" for _ in range(r.randrange(40))]
        text = "".join(w.upper() + r.choice([" ", " ", "  ", "\t", ". ", ",", "\n"]) if r.random() < 0.1 else w + r.choice([" ", " ", " ", ". "]) for w in words)
        out.append((text, ["en", "de", None, "und", "line\nend"][i % 5 if i % 7 else 0]))
    out += [("the same line here, again", "en")] * 200
    return out + [(None, "en"), ("", None), (" \n\t", "fr"), (None, None), (" ".join(f"w{r.randrange(30)}" for _ in range(20_000)), "en"), ("x " * 5000, "es")]


@pytest.mark.parametrize(("size", "shards", "support"), [(1 << 20, 16, 100), (2000, 3, 10), (500, 16, 20)])
def test_phrases_equal_plain_counts(spark, size, shards, support):
    given = rows()
    docs = spark.createDataFrame([(*r, 1, "clash", 2, 3, "clash") for r in given], SCHEMA).repartition(5)
    found = phrases.ranked(phrases.collocations(docs, support, top=50, shards=shards, size=size), 50)
    assert sorted(tuple(r) for r in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == sorted(plain(given, support, 50))


def test_groups_of_chunks_add_up_first(spark, monkeypatch):
    monkeypatch.setattr(chunks, "FAN", 2)
    given = rows()[:250]
    docs = spark.createDataFrame([(*r, 1, "", 2, 3, "") for r in given], SCHEMA).repartition(3)
    found = phrases.collocations(docs, 5, size=2000)  # all of them, no top
    assert sorted((r["lang"], r["phrase"], r["a"], r["score"]) for r in found.collect()) == sorted((x[0], x[2], x[3], x[7]) for x in plain(given, 5, 10**9))


def test_shards_keep_what_is_frequent_anywhere(spark):
    """The support of a shard is its share; a key of one shard alone is a candidate by that shard."""
    share = chunks.Shards.of(spark.createDataFrame([(0, 70), (1, 20), (5, 10)], "chunk long, w long"), 1, 4, "w", 10)
    assert share.least.tolist() == [7, 3, 1, 1]


def test_no_rows(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
