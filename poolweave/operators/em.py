"""Approximate expectation-maximisation over the haplotypes of a region: pools' site frequencies as draws from a
multivariate normal whose mean and covariance the haplotype frequencies give.

A region is one group: its haplotypes are enumerated inside (2 ** sites, at most 2 ** 20), so what is shuffled is the
site frequencies alone, a row for each pool and site.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.algebra import log_likelihood, pseudo_inverse

MAX_SITES = 20


@dataclass(frozen=True)
class EmLimits:
    per_pool: float = 1_000_000
    rounds: int = 150
    tolerance: float = 1e-5
    least: float = 4.88281e-7


#: Numbers that one block of haplotypes by pools (or by sites) may hold.
HELD = 1 << 20


def all_haplotypes(sites: int) -> np.ndarray:
    if sites > MAX_SITES:
        raise ValueError(f"a region of {sites} sites; at most {MAX_SITES} can be enumerated")
    return ((np.arange(1 << sites)[:, None] >> np.arange(sites - 1, -1, -1)) & 1).astype(np.uint8)


def blocks(haps: np.ndarray, width: int) -> Iterator[slice]:
    """Places of haplotypes, so many at a time that width numbers for each are HELD at most."""
    step = max(1, HELD // max(1, width))
    return (slice(a, a + step) for a in range(0, len(haps), step))


def moments(haps: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the haplotypes, added up block by block."""
    sites = haps.shape[1]
    mu, both = np.zeros(sites), np.zeros((sites, sites))
    for at in blocks(haps, sites):
        h = haps[at].astype(float)
        mu += p[at] @ h
        both += (h * p[at, None]).T @ h
    return mu, both - np.outer(mu, mu)


def importance(haps: np.ndarray, p: np.ndarray, x: np.ndarray, per_pool: float) -> np.ndarray:
    """The factor by which each haplotype's frequency changes. x: pools by sites. The part without the haplotype is
    computed once; haplotypes by pools are held in blocks, so memory is that of the haplotypes, however many pools there are."""
    mu, sigma = moments(haps, p)
    inverse = pseudo_inverse(sigma)
    out = np.zeros(len(haps))
    for some in blocks(x, x.shape[1]):  # running sums over blocks of pools, too
        d = x[some] - mu
        alone, turned = 0.5 * np.einsum("pi,ij,pj->p", d, inverse, d), inverse @ d.T
        for at in blocks(haps, max(len(d), haps.shape[1])):
            out[at] += np.exp((haps[at] - mu) @ turned - alone).sum(axis=1)
    for at in blocks(haps, haps.shape[1]):
        h = haps[at] - mu
        out[at] *= np.exp(-np.einsum("hi,ij,hj->h", h, inverse, h) / (2 * per_pool)) / len(x)
    return out


def solve(haps: np.ndarray, x: np.ndarray, limits: EmLimits = EmLimits()) -> np.ndarray:
    """Frequencies of haps; NaN if the iteration breaks down. A step that meets the tolerance is not taken."""
    p = np.full(len(haps), 1.0 / len(haps))
    before = p.copy()
    with np.errstate(all="ignore"):
        for _ in range(limits.rounds):
            factor = importance(haps, p, x, limits.per_pool)
            if np.abs(before - factor).sum() < limits.tolerance or np.abs(before / factor - 1).sum() < limits.tolerance:
                break
            p = p * factor
            p /= p.sum()
            p[p < limits.least] = 0
            p /= p.sum()
            before = factor
            if np.isnan(p).any():
                break
    return p


def region_groups(freq: DataFrame, regions: DataFrame) -> DataFrame:
    """level, region, its ends, pool, site, freq of the sites in each region; regions are few (a broadcast of one row each)."""
    from pyspark.sql import functions as F

    inside = freq.join(F.broadcast(regions), (F.col("site") >= F.col("first_site")) & (F.col("site") <= F.col("last_site"))).select("level", "region", "first_site", "last_site", "pool", "site", "freq")
    # a region that no read covers is a region all the same
    bare = regions.select("level", "region", "first_site", "last_site", *(F.lit(None).cast(dict(freq.dtypes)[c]).alias(c) for c in ("pool", "site", "freq")))
    return inside.unionByName(bare)


def matrix(rows: pd.DataFrame) -> np.ndarray:
    """Pools by all sites of the region, covered or not. Where a pool does not cover a site it says nothing: the mean of the
    others stands in (0 at a site that none covers)."""
    first, last = int(rows["first_site"].iloc[0]), int(rows["last_site"].iloc[0])
    x = rows.dropna(subset=["pool"]).pivot(index="pool", columns="site", values="freq").sort_index().reindex(columns=range(first, last + 1)).astype(float)
    return x.fillna(x.mean()).fillna(0.0).to_numpy(float) if len(x) else np.zeros((1, last - first + 1))


def solved_regions(freq: DataFrame, regions: DataFrame, limits: EmLimits = EmLimits()) -> DataFrame:
    """level, region, hap, freq for each region; freq null where the iteration broke down."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = matrix(rows)
        haps = all_haplotypes(x.shape[1])
        p = solve(haps, x, limits)
        keep = (p > 0) | np.isnan(p)
        return pd.DataFrame({"level": rows["level"].iloc[0], "region": rows["region"].iloc[0], "hap": ["".join(map(str, h)) for h in haps[keep]], "freq": p[keep]})

    return region_groups(freq, regions).groupBy("level", "region").applyInPandas(run, "level long, region long, hap string, freq double")


def first_factors(freq: DataFrame, regions: DataFrame, per_pool: float = EmLimits.per_pool) -> DataFrame:
    """level, region, hap, factor of the first iteration, from equal frequencies."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = matrix(rows)
        haps = all_haplotypes(x.shape[1])
        factor = importance(haps, np.full(len(haps), 1.0 / len(haps)), x, per_pool)
        return pd.DataFrame({"level": rows["level"].iloc[0], "region": rows["region"].iloc[0], "hap": ["".join(map(str, h)) for h in haps], "factor": factor})

    return region_groups(freq, regions).groupBy("level", "region").applyInPandas(run, "level long, region long, hap string, factor double")


def likelihoods(freq: DataFrame, regions: DataFrame) -> DataFrame:
    """level, region, log_likelihood of the pools under equal haplotype frequencies."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = matrix(rows)
        haps = all_haplotypes(x.shape[1])
        mu, sigma = moments(haps, np.full(len(haps), 1.0 / len(haps)))
        return pd.DataFrame({"level": [rows["level"].iloc[0]], "region": [rows["region"].iloc[0]], "log_likelihood": [log_likelihood(mu, sigma, x)]})

    return region_groups(freq, regions).groupBy("level", "region").applyInPandas(run, "level long, region long, log_likelihood double")
