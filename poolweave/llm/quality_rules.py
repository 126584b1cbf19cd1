"""Quality rules by weak supervision.

Each rule looks at one measurement of a document and votes good (2), junk (0) or abstains (1). The votes of all
documents are counted by pattern (at most 3^rules rows, whatever the input), expectation-maximisation over those
counts estimates how each rule votes on good and on junk documents, and the posterior probability of "good" given a
document's votes decides - not an all-must-pass chain.

Defined results: a null or blank text has no words and fails the base rules; an empty table gives an empty result;
repeated rows are judged each for itself; other columns of the input are carried only by `keep_good`, unchanged.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import read, scratch, table, utf8

SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
EXTRA = "n_lines long, n_upper_words long, n_distinct_words long, n_bare_words long, n_marks long, n_stutters long"

#: Each rule: measurement of a row as a Column, junk at or beyond, good below (or, for falling ones, the reverse).
RULES: dict[str, tuple[str, float, float]] = {
    # name: (SQL expression, junk from, good up to)
    "symbols_per_word": ("n_symbols / n_words", 0.25, 0.02),
    "repeat_share": ("n_repeat_words / n_words", 0.25, 0.05),
    "dup_line_share": ("n_dup_lines / greatest(n_lines, 1)", 0.3, 0.0),
    "upper_share": ("n_upper_words / n_words", 0.5, 0.1),
    "bare_share": ("n_bare_words / n_words", 0.15, 0.03),
    "marks_per_word": ("n_marks / n_words", 0.4, 0.05),
    "stutter_share": ("n_stutters / n_words", 0.2, 0.01),
    "sameness": ("1 - ln(n_distinct_words) / ln(n_words + 1)", 0.35, 0.2),
    "mean_length": ("abs(ln(word_chars / n_words) - ln(5.5))", 1.1, 0.6),
    "shortness": ("1 / n_words", 1 / 12, 1 / 40),
}
VOTES = len(RULES)
#: What a rule's accuracy is held to when it votes junk: at least so many to one.
LEAST_ODDS = 3.0


def repeated_words(words: list[bytes], first: dict[bytes, int], window: int = WINDOW) -> int:
    """Words inside windows of `window` (a power of two) words that occur at least twice, overlaps counted once."""
    if len(words) <= window:
        return 0
    codes = np.fromiter(map(first.__getitem__, words), np.int64, len(words))
    width, names = 1, len(first)
    while width < window:
        left, right = codes[:-width], codes[width:]
        found, codes = np.unique(left * np.int64(names) + right, return_inverse=True)
        names, width = len(found), width * 2
        if names == len(codes):
            return 0
    hot = np.bincount(codes, minlength=names)[codes] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(hot)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """All measurements of one whole text, in the order of MEASURES then EXTRA."""
    text = text or ""
    words = utf8(text).split()
    counts = Counter(words)
    first = {w: i for i, w in enumerate(counts)}
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    upper = bare = 0
    for w, n in counts.items():
        if w.isupper():
            upper += n if len(w) > 1 else 0
        elif not w.isalnum() and w.isascii() and not any(map(bytes.isalnum, (w[i : i + 1] for i in range(len(w))))):
            bare += n
    return (
        len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words, first),
        len(lines), upper, len(counts), bare, text.count("!") + text.count("?"), sum(map(eq, words, words[1:])),
    )


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of docs as c0, c1, ... and the row's measurements in one struct, m; one narrow pass, no shuffle."""
    names = [x.split()[0] for x in f"{MEASURES}, {EXTRA}".split(", ")]
    kind = T.StructType([T.StructField(n, T.LongType()) for n in names])
    schema = T.StructType([*(T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)), T.StructField("m", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measure(x) for x in b.column(b.num_columns - 1).to_pylist()]
            cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.StructArray.from_arrays(cols, names=names)], names=[*b.schema.names[:-1], "m"])

    carried = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    return docs.select(*carried, F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, schema)


def base_failed() -> Column:
    return F.expr(f"m.n_words < {MIN_WORDS} OR 100 * m.n_repeat_words > {MAX_REPEAT_PERCENT} * m.n_words")


def vote(k: int) -> Column:
    """Rule k's vote on a row: 0 junk, 1 abstains, 2 good."""
    sql, junk, good = list(RULES.values())[k]
    for field in (x.split()[0] for x in f"{MEASURES}, {EXTRA}".split(", ")):
        sql = re.sub(rf"(?<![\w.]){field}\b", f"m.{field}", sql)
    value = F.expr(f"CASE WHEN m.n_words > 0 THEN {sql} ELSE 1e9 END")
    return F.when(value >= junk, 0).when(value <= good, 2).otherwise(1)


def pattern() -> Column:
    """All votes of a row, one base-3 digit for each rule, as one long."""
    total: Column = F.lit(0).cast("long")
    for k in range(VOTES):
        total = total + vote(k) * F.lit(3**k)
    return total


@dataclass(frozen=True)
class VoteModel:
    """prior: log odds of good; weights[rule][vote]: log likelihood ratio of good against junk."""

    prior: float
    weights: tuple[tuple[float, ...], ...]

    def log_odds(self) -> Column:
        total: Column = F.lit(self.prior)
        for k, w in enumerate(self.weights):
            total = total + F.element_at(F.array(*map(F.lit, w)), vote(k) + 1)
        return total


def expectation_maximisation(patterns: list[tuple[int, int]], rounds: int = 50, smooth: float = 1.0) -> VoteModel:
    """Fit on (pattern, documents) counts. Starts from: good unless some rule votes junk, which fixes which class is which."""
    digits = np.array([[p // 3**k % 3 for k in range(VOTES)] for p, _ in patterns], np.int64).reshape(-1, VOTES)
    count = np.array([n for _, n in patterns], float)
    good = np.where((digits == 0).any(axis=1), 0.05, 0.95)
    prior, weights = 0.0, np.zeros((VOTES, 3))
    for _ in range(rounds if len(patterns) else 0):
        a, b = count * good, count * (1 - good)
        prior = float(np.log(a.sum() + smooth) - np.log(b.sum() + smooth))
        for k in range(VOTES):
            pa_, pb = (np.bincount(digits[:, k], x, minlength=3) + smooth for x in (a, b))
            weights[k] = np.log(pa_ / pa_.sum()) - np.log(pb / pb.sum())
            # the rules keep their meaning: a junk vote is at least LEAST_ODDS to 1 for junk, a good vote never speaks for junk
            weights[k, 0], weights[k, 2] = min(weights[k, 0], -np.log(LEAST_ODDS)), max(weights[k, 2], 0.0)
        odds = prior + weights[np.arange(VOTES), digits].sum(axis=1)
        good = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
    return VoteModel(round(prior, 9), tuple(tuple(round(float(x), 9) for x in w) for w in weights))


def fit(rows: DataFrame) -> VoteModel:
    """rows: as measured() gives them. Counts of all rows that pass the base rules, by vote pattern, reach the driver: at most 3^rules of them."""
    found = rows.where(~base_failed()).groupBy(pattern().alias("pattern")).count().collect()
    return expectation_maximisation(sorted((r["pattern"], r["count"]) for r in found))


def judged(rows: DataFrame, model: VoteModel) -> DataFrame:
    """rows as measured() gives them, with p (posterior of good) and failed (a base rule)."""
    return rows.withColumns({"p": 1 / (1 + F.exp(-model.log_odds())), "failed": base_failed()})


def quality_scores(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, measurements, votes' posterior, base_failed and kept."""
    with scratch(docs.sparkSession) as work:
        rows = table(measured(docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")), text).drop("c1"), "quality")
        out = judged(rows, fit(rows))
        out = out.select(F.col("c0").alias(key), *(f"m.{x.split()[0]}" for x in MEASURES.split(", ")), F.col("failed").alias("base_failed"), (~F.col("failed") & (F.col("p") >= 0.5)).alias("kept"), F.col("p").alias("posterior"))
        return work.result(out, "scores")


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that the rules keep. Two narrow passes (fit, filter); texts are never shuffled."""
    model = fit(measured(docs.select(F.col(f"`{text}`")), text))
    out = judged(measured(docs, text), model).where(~F.col("failed") & (F.col("p") >= 0.5))
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read(spark, sf_dir, "documents"))
