"""Colouring by components, posting lists, moments of designs and EM in blocks, against plain ways of the same."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import planted, plain_colours

from poolweave.operators import colouring, em, frequency, regression
from poolweave.sources.steps import Steps, kept

CALLS = "pool long, read_id long, site long, allele long"


@pytest.fixture(scope="module")
def islands(spark):
    """Two pools; reads over three stretches of sites with nothing between them, the second word among them, many copies of
    some, and reads of a site that has one allele only."""
    r = np.random.default_rng(3)
    rows = []
    for pool, (first, wide) in itertools.product((0, 1), ((0, 5), (10, 4), (61, 6))):
        for i in range(70):
            size, a = int(r.integers(1, wide + 1)), 0
            a = int(r.integers(first, first + wide - size + 1))
            rows += [(pool, pool * 1000 + first * 10_000 + i, s, int(r.integers(0, 2))) for s in range(a, a + size)]
    rows += [(0, 900 + i, 40, 1) for i in range(9)]
    rows += [(0, 2000 + i, s, s % 2) for i in range(40) for s in (0, 1)]
    return spark.createDataFrame(rows, CALLS).cache()


def pool_of(found, pool):
    rows = found.where(F.col("pool") == pool).toPandas().sort_values("genotype").reset_index(drop=True)
    return rows, [{int(t.split("=")[0]): int(t.split("=")[1]) for t in g.split(";") if t} for g in rows["genotype"]]


def test_colours_of_components_are_those_of_the_pool(spark, islands):
    found = kept(frequency.fragments(islands))
    ranges = colouring.colour_ranges(found).cache()
    parts = colouring.with_component(found)
    assert parts.where("component IS NOT NULL").select("pool", "component").distinct().count() == 6
    assert {r.genotype for r in parts.where("component IS NULL").collect()} == {"4100=1;"}
    for pool in (0, 1):
        rows, parsed = pool_of(found, pool)
        want = plain_colours(parsed, rows["n"].tolist())
        got = colouring.coloured(found).where(F.col("pool") == pool).toPandas().groupby("genotype")["colour"].apply(sorted)
        assert {rows["genotype"][i]: c for i, c in want.items()} == got.to_dict()
    # ranges: fewer rows than copies, the same or apart
    assert ranges.count() < found.agg(F.sum("n")).first()[0]
    for pool in (0, 1):
        spans = sorted({(r.colour, r.n) for r in ranges.where(F.col("pool") == pool).collect()})
        assert all(a + n <= b for (a, n), (b, _) in zip(spans[:-1], spans[1:], strict=True))


def test_drafts_of_ranges_are_those_of_copies(spark, islands):
    found = kept(frequency.fragments(islands))
    by = [colouring.draft_haplotypes(colouring.consensus(c, 67), 67) for c in (colouring.colour_ranges(found), colouring.coloured(found))]
    a, b = ({(r.pool, r.hap): (r.links, r.n) for r in d.collect()} for d in by)
    assert a == b and sum(n for _, n in a.values()) == len({(r.pool, r.colour) for r in colouring.coloured(found).collect()})


def test_degrees_by_posting_lists(spark, islands, monkeypatch):
    monkeypatch.setattr(colouring, "WORDS", 1)  # several blocks, and blocks of several parts
    found = kept(frequency.fragments(islands))
    got = {(r.pool, r.genotype): r.degree for r in colouring.degrees(found).collect()}
    for pool in (0, 1):
        rows, parsed = pool_of(found, pool)
        for g, a in zip(rows["genotype"], parsed, strict=True):
            assert got[pool, g] == sum(any(b.get(s, v) != v for s, v in a.items()) for b in parsed)
    assert len(got) == found.count()


def test_degrees_by_subsets_and_by_posting_lists_agree(spark, islands, monkeypatch):
    found = kept(frequency.fragments(islands))
    got = []
    for most in (0, 2, 63):  # posting lists alone, both, subsets wherever they are few
        monkeypatch.setattr(colouring, "SHORT", most)
        got.append({(r.pool, r.genotype): r.degree for r in colouring.degrees(found).collect()})
    assert got[0] == got[1] == got[2] and len(got[0]) == found.count() and max(got[0].values()) > 0


def test_subsets_grow_with_the_nodes(spark, capsys):
    """Nodes do not meet each other's lists or blocks: one join, by what they hold."""
    rows = [(0, f"{a}{b}", [(1 << a) | (1 << b)], [(1 << a) if (a + b) % 3 else 0]) for a in range(6) for b in range(a + 1, 7)]
    nodes = spark.createDataFrame(rows, "pool long, genotype string, mask array<long>, bits array<long>")
    conflict = lambda x, y: x[2][0] & y[2][0] & (x[3][0] ^ y[3][0])
    assert {r.genotype: r.degree for r in colouring.degrees(nodes).collect()} == {x[1]: sum(bool(conflict(x, y)) for y in rows) for x in rows}
    colouring.subset_conflicts(nodes).explain()
    assert (plan := capsys.readouterr().out).count("Join") == 1 and "block" not in plan and "Python" not in plan


def test_joins_of_degrees_collect_nothing_on_the_driver(spark, islands, monkeypatch):
    """A file of nodes is small, what they multiply to is not: no side of a join by subsets or lists is broadcast for its file's size."""
    plans = []
    monkeypatch.setattr(colouring, "kept", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df))
    nodes = kept(frequency.fragments(islands))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in (subsets := plan(colouring.subset_conflicts(nodes))) and "SortMergeJoin" in subsets
    got = []
    for few, kind in ((1 << 15, "BroadcastHashJoin"), (0, "SortMergeJoin")):
        monkeypatch.setattr(colouring, "FEW", few)
        got.append(colouring.counted_conflicts(nodes))
        # the sizes of the pools alone go to all tasks, and the lists where they were counted to be few
        assert kind in plan(got[-1]) and plan(got[-1]).count("BroadcastExchange") == 1 + (few > 0) and plans[-1].count("Join") == plans[-1].count("BroadcastExchange") == 1
    a, b = ({(r.pool, r.genotype): r.degree for r in x.collect()} for x in got)
    assert a == b == {(r.pool, r.genotype): r.degree for r in colouring.degrees(nodes).collect()}


def test_degrees_have_no_python(spark, islands, capsys):
    colouring.counted_conflicts(kept(frequency.fragments(islands))).explain()
    assert "Python" not in (plan := capsys.readouterr().out) and "Pandas" not in plan


def test_moments_add_up_over_slices(spark, monkeypatch):
    monkeypatch.setattr(regression, "SLICE", 3)
    r = np.random.default_rng(1)
    rows = [(p, int(b), int(l), int(m), float(r.random()), [float(v) for v in r.integers(0, 2, 5)]) for p in (0, 1) for b, l, m in [(0, 0, 0)] + [(1, s, 0) for s in range(6)] + [(2, a, c) for a in range(6) for c in range(a + 1, 6)]]
    design = spark.createDataFrame(rows, "pool long, block int, l1 long, l2 long, label double, features array<double>")
    for row in regression.design_moments(design).collect():
        x, y = (np.array([t[k] for t in rows if t[0] == row.pool]) for k in (5, 4))
        assert row.n == len(y) and np.allclose(np.frombuffer(row.gram).reshape(5, 5), x.T @ x) and np.allclose(np.frombuffer(row.xy), x.T @ y)
        assert np.isclose(row.yy, y @ y) and np.allclose(np.frombuffer(row.sums), x.sum(axis=0))


def test_descent_meets_the_conditions_of_the_optimum():
    """Slopes of coefficients that are not 0 equal their price, others lie within it; warm starts end at the same place."""
    r = np.random.default_rng(2)
    x, y = r.integers(0, 2, (60, 12)).astype(float), r.random(60)
    m = regression.Moments.of(x, y)
    warm = None
    for penalty in (0.2, 0.1, 0.05, 0.01):
        found = regression.descended(m, penalty, warm)
        slope, price = x.T @ (y - x @ found.weights) / 60, penalty * x.std(axis=0, ddof=1)
        on = found.weights != 0
        assert found.converged and np.allclose(slope[on], (np.sign(found.weights) * price)[on], atol=1e-7) and (abs(slope[~on]) <= price[~on] + 1e-7).all()
        assert np.allclose(found.weights, regression.descended(m, penalty).weights, atol=1e-6)
        assert np.isclose(found.r2, 1 - ((y - x @ found.weights) ** 2).sum() / (y @ y))
        warm = found.weights
    assert np.allclose(regression.descended(m, 0.0).weights, np.linalg.lstsq(x, y, rcond=None)[0], atol=1e-5)
    assert not regression.descended(m, 0.0, rounds=2).converged


def test_em_in_blocks_is_em(monkeypatch):
    r = np.random.default_rng(7)
    haps, x = em.all_haplotypes(6), np.clip(r.normal(0.5, 0.15, (9, 6)), 0, 1)
    p = r.dirichlet(np.ones(64))
    whole = em.importance(haps, p, x, 1e6), em.solve(haps, x)
    mu, sigma = em.moments(haps, p)
    inverse = np.linalg.pinv(sigma)
    plain = [np.exp(-(h - mu) @ inverse @ (h - mu) / 2e6) * np.mean([np.exp((h - mu) @ inverse @ (v - mu) - 0.5 * (v - mu) @ inverse @ (v - mu)) for v in x]) for h in haps.astype(float)]
    assert np.allclose(whole[0], plain)
    for held in (1, 20, 100):
        monkeypatch.setattr(em, "HELD", held)
        assert np.allclose(em.importance(haps, p, x, 1e6), whole[0]) and np.allclose(em.solve(haps, x), whole[1])


def test_steps_leave_nothing_but_the_result(spark, tmp_path, monkeypatch):
    from poolweave.jobs import reconstruct
    from poolweave.sources import steps

    monkeypatch.setattr(steps, "shared_folder", lambda spark: f"file://{tmp_path}")
    found = reconstruct.reconstruct(spark.createDataFrame(planted(2, 60)[2], CALLS), 12)
    assert len(list(tmp_path.glob("step-*"))) == 1 and found.count()
    with pytest.raises(ZeroDivisionError), Steps(spark):
        kept(spark.range(3))
        raise ZeroDivisionError
    assert len(list(tmp_path.glob("step-*"))) == 1
