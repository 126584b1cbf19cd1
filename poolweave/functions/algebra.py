"""Vector arithmetic on array columns, and its numpy counterparts where a solver needs them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def same_size(a: Column, b: Column, value: Column) -> Column:
    """value where both arrays have the same length, else null (zip_with would pad the shorter one)."""
    return F.when(F.size(a) == F.size(b), value)


def add(a: Column, b: Column) -> Column:
    return same_size(a, b, F.zip_with(a, b, lambda x, y: x + y))


def minus(a: Column, b: Column) -> Column:
    return same_size(a, b, F.zip_with(a, b, lambda x, y: x - y))


def times(a: Column, b: Column) -> Column:
    return same_size(a, b, F.zip_with(a, b, lambda x, y: x * y))


def scaled(a: Column, by: Column | float) -> Column:
    by = by if isinstance(by, Column) else F.lit(by)
    return F.transform(a, lambda x: x * by)


def shifted(a: Column, by: Column | float) -> Column:
    by = by if isinstance(by, Column) else F.lit(by)
    return F.transform(a, lambda x: x + by)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def inner_product(a: Column, b: Column) -> Column:
    return total(times(a, b))


def distance(a: Column, b: Column) -> Column:
    """L1."""
    return total(absolute(minus(a, b)))


def absolute(a: Column) -> Column:
    return F.transform(a, F.abs)


def exponential(a: Column) -> Column:
    return F.transform(a, F.exp)


def normalised(a: Column) -> Column:
    s = total(a)
    return F.transform(a, lambda x: x / s)


def normalised_with_nan(a: Column, share: float) -> Column:
    """NaN entries split `share` among them, the others the rest; all NaN gives the uniform distribution."""
    n_nan = F.size(F.filter(a, F.isnan))
    rest = total(F.filter(a, lambda x: ~F.isnan(x)))
    return F.when(n_nan == F.size(a), F.transform(a, lambda x: 1.0 / F.size(a))).when(n_nan == 0, F.transform(a, lambda x: x / rest)).otherwise(F.transform(a, lambda x: F.when(F.isnan(x), F.lit(share) / n_nan).otherwise(x / rest * (1 - share))))


def floor_and_normalise(a: Column, least: float) -> Column:
    """Normalise, zero what lies below least, normalise again."""
    return normalised(F.transform(normalised(a), lambda x: F.when(x < least, 0.0).otherwise(x)))


def diagonal(m: Column) -> Column:
    return F.transform(m, lambda row, i: F.get(row, i))


def quadratic_form(x: Column, m: Column) -> Column:
    return total(F.zip_with(x, m, lambda v, row: v * inner_product(row, x)))


def joined(a: Column, separator: str = "") -> Column:
    return F.array_join(a, separator)


# numpy


def pseudo_inverse(sigma: np.ndarray) -> np.ndarray:
    return np.linalg.pinv(sigma, hermitian=True)


def log_likelihood(mu: np.ndarray, sigma: np.ndarray, rows: np.ndarray) -> float:
    """Of rows under a multivariate normal of possibly deficient rank: determinant over the singular values that
    the pseudo-inverse keeps."""
    values = np.linalg.eigvalsh(sigma)
    kept = values[np.abs(values) > 1e-12 * max(1.0, np.abs(values).max())]
    d = rows - mu
    constant = -0.5 * (len(kept) * np.log(2 * np.pi) + np.log(np.abs(kept)).sum())
    return float(len(rows) * constant - 0.5 * np.einsum("pi,ij,pj->", d, pseudo_inverse(sigma), d))


def in_span(sigma: np.ndarray, rows: np.ndarray, tolerance: float = 1e-3) -> bool:
    """Whether every row is a combination of sigma's columns, up to tolerance."""
    solved = np.linalg.lstsq(sigma, rows.T, rcond=None)[0]
    return bool((np.abs(sigma @ solved - rows.T).sum(axis=0) <= tolerance).all())
