"""The fit of the quality rules against the same iteration in plain loops."""

import math
import random

import pytest

from poolweave.llm import quality_rules


def plain_fit(patterns, rounds=50, smooth=1.0):
    """Posteriors of every pattern: expectation by rule and vote, maximisation by counting."""
    rules = quality_rules.VOTES
    votes = [[p // 3**k % 3 for k in range(rules)] for p, _ in patterns]
    good = [0.05 if 0 in v else 0.95 for v in votes]
    prior, weights = 0.0, [[0.0] * 3 for _ in range(rules)]
    for _ in range(rounds):
        a = smooth + sum(n * g for (_, n), g in zip(patterns, good, strict=True))
        b = smooth + sum(n * (1 - g) for (_, n), g in zip(patterns, good, strict=True))
        prior = math.log(a / b)
        for k in range(rules):
            one, two = [smooth] * 3, [smooth] * 3
            for (_, n), v, g in zip(patterns, votes, good, strict=True):
                one[v[k]] += n * g
                two[v[k]] += n * (1 - g)
            weights[k] = [math.log(one[x] / sum(one)) - math.log(two[x] / sum(two)) for x in range(3)]
            weights[k][0] = min(weights[k][0], -math.log(quality_rules.LEAST_ODDS))
            weights[k][2] = max(weights[k][2], 0.0)
        good = [1 / (1 + math.exp(-max(-60.0, min(60.0, prior + sum(weights[k][x] for k, x in enumerate(v)))))) for v in votes]
    return prior, weights


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_em_of_rules_against_plain_loops(seed):
    r = random.Random(seed)
    counts = {}
    for _ in range(300):
        fine = r.random() < 0.7
        p = sum(r.choices((0, 1, 2), (1, 4, 5) if fine else (5, 4, 1))[0] * 3**k for k in range(quality_rules.VOTES))
        counts[p] = counts.get(p, 0) + r.randrange(1, 50)
    patterns = sorted(counts.items())
    found = quality_rules.expectation_maximisation(patterns)
    prior, weights = plain_fit(patterns)
    assert abs(found.prior - prior) < 1e-6
    assert all(abs(a - b) < 1e-6 for x, y in zip(found.weights, weights, strict=True) for a, b in zip(x, y, strict=True))
    assert quality_rules.expectation_maximisation([]).prior == 0.0


def test_posterior_decides(spark):
    """kept is what the fitted odds say of a row's votes, for rows that the base rules let pass."""
    good = " ".join(f"word{i} follows another one, quite plainly." for i in range(40))
    rows = [(i, good if i % 3 else " ".join("#$%" for _ in range(25)) + f" x{i} |||| <> " + "q " * 9) for i in range(60)] + [(100, None), (101, "few words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality_rules.fit(quality_rules.measured(docs))
    for r in quality_rules.quality_scores(docs).collect():
        measured = quality_rules.measured(docs.where(f"doc_id = {r.doc_id}")).select(quality_rules.pattern().alias("p")).first().p if r.doc_id in (0, 1, 101) else None
        if measured is not None:
            odds = model.prior + sum(w[measured // 3**k % 3] for k, w in enumerate(model.weights))
            assert abs(r.posterior - 1 / (1 + math.exp(-odds))) < 1e-9
        assert r.kept == (not r.base_failed and r.posterior >= 0.5)
