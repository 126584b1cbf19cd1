"""Haplotype frequencies of a pool by L1-penalised regression on site frequencies and linkage."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Weights:
    one: float = 1.0
    site: float = 1.0
    pair: float = 1.0


@dataclass(frozen=True)
class Ladder:
    penalty: float = 0.25
    step: float = 0.04
    least_r2: float = 0.0
    iterations: int = 10
    least: float = 0.005  # a fit all of whose coefficients lie below says nothing either


def design(haps: DataFrame, freq: DataFrame, linkage: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """pool, block (0 one, 1 site, 2 pair), l1, l2, label, features (array over haps in the order of their string).

    haps: hap, or pool, hap where each pool has its own; freq: pool, site, freq; linkage: pool, l1, l2, p11 (uncovered pairs have no row). Haplotypes of one
    configuration are one row, from which each site or pair reads its features; how it travels is left to Spark, by its size.
    """
    by = [c for c in ("pool",) if c in haps.columns]
    every = haps.groupBy(*by).agg(F.array_sort(F.collect_set("hap")).alias("haps"))
    bit = lambda h, l: F.substring(h, (l + 1).cast("int"), F.lit(1)).cast("double")
    ones = freq.select("pool").distinct().select("pool", F.lit(0).alias("block"), F.lit(None).cast("long").alias("l1"), F.lit(None).cast("long").alias("l2"), F.lit(1.0).alias("label"))
    sites = freq.select("pool", F.lit(1).alias("block"), F.col("site").alias("l1"), F.lit(None).cast("long").alias("l2"), F.col("freq").alias("label"))
    pairs = linkage.where(F.col("p11").isNotNull()).select("pool", F.lit(2).alias("block"), "l1", "l2", F.col("p11").alias("label"))
    rows = ones.unionByName(sites).unionByName(pairs)
    rows = rows.join(every, by) if by else rows.crossJoin(every)
    weight = F.when(F.col("block") == 0, weights.one).when(F.col("block") == 1, weights.site).otherwise(weights.pair)
    value = F.transform("haps", lambda h: F.when(F.col("block") == 0, 1.0).when(F.col("block") == 1, bit(h, F.col("l1"))).otherwise(bit(h, F.col("l1")) * bit(h, F.col("l2"))) * weight)
    return rows.select("pool", "block", "l1", "l2", (F.col("label") * weight).alias("label"), value.alias("features"))


def fit(rows: DataFrame, penalty: float, iterations: int) -> tuple[list[float], float]:
    """Coefficients and r2 of one lasso without intercept."""
    data = rows.select("label", array_to_vector("features").alias("features"))
    model = LinearRegression(regParam=penalty, elasticNetParam=1.0, fitIntercept=False, maxIter=iterations).fit(data)
    return [float(x) for x in model.coefficients.toArray()], float(model.summary.r2)


def fit_with_ladder(rows: DataFrame, ladder: Ladder = Ladder()) -> tuple[list[float], float, float]:
    """Coefficients, r2 and penalty: the penalty falls by steps while the fit explains nothing, down to 0."""
    rows = rows.persist()
    try:
        penalty = ladder.penalty
        while True:
            found, r2 = fit(rows, penalty, ladder.iterations)
            if r2 != ladder.least_r2 and max(found, default=0.0) >= ladder.least or penalty <= 0:
                return found, r2, penalty
            penalty = max(0.0, penalty - ladder.step)
    finally:
        rows.unpersist()


@dataclass
class Moments:
    """What a fit needs of a design: the number of rows, X'X, X'y, y'y and the sums of X's columns. They add up over parts."""

    n: int
    gram: np.ndarray
    xy: np.ndarray
    yy: float
    sums: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray) -> Moments:
        return cls(len(y), x.T @ x, x.T @ y, float(y @ y), x.sum(axis=0))

    def packed(self) -> tuple[int, bytes, bytes, float, bytes]:
        return self.n, self.gram.tobytes(), self.xy.tobytes(), self.yy, self.sums.tobytes()

    @classmethod
    def added(cls, rows: pa.Table) -> Moments:
        """The sum of packed ones."""
        numbers = lambda c: sum(np.frombuffer(v) for v in rows.column(c).to_pylist())
        xy = numbers("xy")
        return cls(sum(rows.column("n").to_pylist()), numbers("gram").reshape(len(xy), len(xy)), xy, sum(rows.column("yy").to_pylist()), numbers("sums"))


@dataclass
class Fit:
    weights: np.ndarray
    r2: float
    converged: bool


def descended(m: Moments, penalty: float, start: np.ndarray | None = None, rounds: int = 10_000, tolerance: float = 1e-9) -> Fit:
    """The optimum that `fit` goes for, by coordinate descent on the moments alone: least squares over twice the rows, plus the
    penalty times each coefficient's size times its feature's deviation. Also r2, through the origin.

    A sweep over all coordinates finds the active ones, which are then swept until they settle; that it moves nothing
    more ends it. start: weights to begin from, those of a larger penalty.
    """
    n, size = m.n, np.diag(m.gram) / m.n
    spread = np.sqrt(np.maximum(np.diag(m.gram) - m.sums**2 / n, 0) / (n - 1)) if n > 1 else np.zeros(len(size))
    spread[spread < 1e-12] = 0
    price = penalty * spread
    live = np.flatnonzero((size > 0) & ((price > 0) | (penalty == 0)))  # without deviation a feature has no coefficient
    w = np.zeros(len(size)) if start is None else start.copy()
    slope = (m.xy - m.gram @ w) / n
    some, whole, converged = live, True, False
    for _ in range(rounds):
        most = 0.0
        for j in some:
            gain = slope[j] + size[j] * w[j]
            new = np.sign(gain) * max(abs(gain) - price[j], 0.0) / size[j]
            if new != w[j]:
                slope -= m.gram[j] * ((new - w[j]) / n)
                most, w[j] = max(most, abs(new - w[j])), new
        if most < tolerance:
            if whole:
                converged = True
                break
            some, whole = live, True
        elif whole:
            some, whole = live[w[live] != 0], False
    rest = m.yy - 2 * float(w @ m.xy) + float(w @ m.gram @ w)
    return Fit(w, 1.0 - rest / max(m.yy, 1e-300), converged)


def lasso(x: np.ndarray, y: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    found = descended(Moments.of(x, y), penalty)
    return found.weights, found.r2


def down_the_ladder(m: Moments, ladder: Ladder) -> tuple[Fit, float]:
    """The first fit that says something, as the penalty falls by steps down to 0, each from where the last one ended."""
    penalty, start = ladder.penalty, None
    while True:
        found = descended(m, penalty, start)
        if found.r2 != ladder.least_r2 and max(found.weights, default=0.0) >= ladder.least or penalty <= 0:
            return found, penalty
        penalty, start = max(0.0, penalty - ladder.step), found.weights


MOMENTS = "pool long, n long, gram binary, xy binary, yy double, sums binary"
#: Rows of a design that one task turns into moments.
SLICE = 1024


def design_moments(rows: DataFrame) -> DataFrame:
    """MOMENTS of each pool's design: slices of rows are added up where they lie, then the slices."""

    def table(pool: int, m: Moments) -> pa.Table:
        kinds = {"pool": pa.int64(), "n": pa.int64(), "gram": pa.binary(), "xy": pa.binary(), "yy": pa.float64(), "sums": pa.binary()}
        return pa.table({c: pa.array([v], k) for (c, k), v in zip(kinds.items(), (pool, *m.packed()), strict=True)})

    def part(t: pa.Table) -> pa.Table:
        x = np.stack(t.column("features").to_numpy(zero_copy_only=False)).astype(float)
        return table(t.column("pool")[0].as_py(), Moments.of(x, t.column("label").to_numpy().astype(float)))

    def total(t: pa.Table) -> pa.Table:
        return table(t.column("pool")[0].as_py(), Moments.added(t))

    # rows of a pool are numbered by their sites: so many slices that one holds about SLICE rows of all pairs
    sliced = rows.withColumn("slice", F.when(F.col("block") == 2, F.floor((F.col("l1") * (F.col("l1") + F.col("l2"))) / SLICE)).otherwise(F.lit(-1).cast("long")))
    return sliced.groupBy("pool", "slice").applyInArrow(part, MOMENTS).groupBy("pool").applyInArrow(total, MOMENTS)


def pool_frequencies(rows: DataFrame, haps: DataFrame, ladder: Ladder = Ladder()) -> DataFrame:
    """pool, hap, freq, r2, penalty, converged: a fit for each pool, all pools at once, from the moments of its design (features by
    features, whatever its rows). haps: as in design, the haplotypes that the features are in order of.

    A pool of which even the fit without penalty says nothing has all haplotypes alike.
    """

    def run(t: pa.Table) -> pa.Table:
        found, penalty = down_the_ladder(Moments.added(t), ladder)
        many = len(found.weights)
        said = max(found.weights, default=0.0) >= ladder.least
        freq = found.weights if said else np.ones(many)
        return pa.table({"pool": pa.array([t.column("pool")[0].as_py()] * many, pa.int64()), "place": pa.array(range(many), pa.int32()), "freq": pa.array(freq), "r2": pa.array([found.r2] * many, pa.float64()), "penalty": pa.array([float(penalty)] * many), "converged": pa.array([found.converged] * many)})

    by = [c for c in ("pool",) if c in haps.columns]
    names = haps.groupBy(*by).agg(F.array_sort(F.collect_set("hap")).alias("h")).select(*by, F.posexplode("h").alias("place", "hap"))
    fits = design_moments(rows).groupBy("pool").applyInArrow(run, "pool long, place int, freq double, r2 double, penalty double, converged boolean")
    return fits.join(names, [*by, "place"]).select("pool", "hap", "freq", "r2", "penalty", "converged")
