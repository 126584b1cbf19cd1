"""Near-duplicate vectors against all pairs in numpy; the codes' estimates against true inner products."""

import numpy as np
import pytest

from poolweave.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, node long, n long, k1 string, part int"
INF, NAN = float("inf"), float("nan")


def plain(rows, threshold=0.95):
    """rows: (vec_id, vector)."""
    ok = [i for i, (_, v) in enumerate(rows) if v and all(c is not None and np.isfinite(np.float32(c)) for c in v) and any(np.float32(c) for c in v)]
    near = {i: [] for i in range(len(rows))}
    for size in {len(rows[i][1]) for i in ok}:
        of = [i for i in ok if len(rows[i][1]) == size]
        x = np.array([rows[i][1] for i in of], np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        for a, b in zip(*np.nonzero(x @ x.T >= threshold), strict=True):
            if a != b:
                near[of[a]].append(of[b])
    out, seen = [], {}
    for i in range(len(rows)):
        if i not in seen:
            group, todo = {i}, [i]
            while todo:
                todo = [j for k in todo for j in near[k] if j not in group and not group.add(j)]
            low = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
            seen |= dict.fromkeys(group, low)
        out.append((rows[i][0], len(near[i]), seen[i], rows[i][0] is not None and rows[i][0] == seen[i]))
    return out


def vectors(size=64, n=300):
    """Random ones, near copies of some, a dense group of a third of all rows, a chain, exact copies, and what links with nothing."""
    r = np.random.default_rng(5)
    x = r.standard_normal((n, size))
    near = x[:40] + 0.1 * r.standard_normal((40, size))
    dense = x[50] + 0.12 * r.standard_normal((n // 2, size))
    steps = np.cumsum(0.15 * r.standard_normal((30, size)), axis=0) + x[60]
    rows = [(i * 3 % 9973, [float(np.float32(c)) for c in v]) for i, v in enumerate([*x, *near, *dense, *steps])]
    rows += [(9000 + i, rows[70][1]) for i in range(60)] + [(9100, [2 * c for c in rows[70][1]])]
    rows += [(9200, None), (9201, []), (9202, [0.0] * size), (9203, [None, *rows[0][1][1:]]), (9204, [NAN, *rows[0][1][1:]]), (9205, [INF] * size), (9206, rows[0][1][: size // 2]), (None, rows[0][1]), (None, rows[3][1]), (9, rows[5][1]), (9, rows[5][1])]
    return rows


def found(spark, rows, **options):
    made = spark.createDataFrame([(k, v, 1, 2, 3, "clash", 4) for k, v in rows], SCHEMA).repartition(3)
    return [tuple(r) for r in embeddings.near_duplicates(made, **options).select("vec_id", "n_links", "component_id", "kept").collect()]


@pytest.mark.parametrize("piece", [2048, 16])
def test_links_equal_all_pairs(spark, piece):
    """Planted copies are all found; pairs just above the threshold may be missed, one in 200 of them at most on average."""
    rows = vectors()
    got, want = sorted(found(spark, rows, recall=0.999999, piece=piece), key=str), sorted(plain(rows), key=str)
    assert got == want


def test_recall_at_the_threshold(spark):
    """Pairs of a cosine just above the threshold, the hardest: 0.97 are found at least, and nothing else is."""
    r = np.random.default_rng(1)
    rows = []
    for i in range(600):
        a, b = np.linalg.qr(r.standard_normal((64, 2)))[0].T
        rows += [(2 * i, a.tolist()), (2 * i + 1, (0.951 * a + np.sqrt(1 - 0.951**2) * b).tolist()), (10_000 + i, (0.945 * a - np.sqrt(1 - 0.945**2) * b).tolist())]
    got = found(spark, rows)
    links = sum(r[1] for r in got)
    assert 0.97 * 1200 <= links <= 1200 and all(r[1] == 0 for r in got if r[0] >= 10_000)


def test_nothing(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None)]) == [(1, 0, 1, True)]


def test_estimates_are_unbiased_and_bounded():
    r = np.random.default_rng(2)
    a = embeddings.unit(r.standard_normal((4000, 64)))
    b = embeddings.unit(0.95 * a + np.sqrt(1 - 0.95**2) / 8 * r.standard_normal((4000, 64)))
    signs, factors = embeddings.codes(a)
    true = (a * b).sum(axis=1)
    error = (embeddings.decoded(signs, factors, 64) * b).sum(axis=1) - true
    assert abs(error.mean()) < 4 * error.std() / np.sqrt(4000)
    assert (error > -embeddings.bound(factors, 256, 0.93)).all()
    assert error.std() < 0.02  # far below the gap to vectors that are not near


def test_bands_grow_with_the_logarithm():
    sizes = [embeddings.bands(10**k) for k in (3, 6, 9)]
    assert [b for b, _ in sizes] == [6, 14, 24] and sizes[2][1] < 80
    which = embeddings.band_bits(256, *embeddings.bands(10**5))
    assert len(np.unique(which)) == which.size
