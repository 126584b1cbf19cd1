"""Every haplotype query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from poolweave.jobs import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", list(catalogue.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    found = duck.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    assert ordered(map(tuple, df.select(*(f"`{n}`" for n in names)).collect())) == ordered(found.fetchall())


def test_entry_module():
    import __spark_entry__

    assert set(catalogue.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_whole_design_against_plain_counts(spark):
    """All sites and pairs of every pool: labels counted in plain Python, features read off every haplotype."""
    from collections import defaultdict
    from itertools import combinations

    from poolweave.sources import bridge

    site, pair = defaultdict(list), defaultdict(list)
    reads = defaultdict(dict)
    for r in bridge.calls(spark, DATA).select("pool", "read_id", "site", "allele").collect():
        reads[r.pool, r.read_id][r.site] = r.allele
    for (pool, _), alleles in reads.items():
        for a in alleles:
            site[pool, a].append(alleles[a])
        for a, b in combinations(sorted(alleles), 2):
            pair[pool, a, b].append(alleles[a] * alleles[b])
    haps = sorted(r.hap for r in bridge.haps(spark, DATA).collect())
    want = {(p, 0, None, None): (1.0, "1" * len(haps)) for p, _ in site}
    want |= {(p, 1, a, None): (sum(x) / len(x), "".join(h[a] for h in haps)) for (p, a), x in site.items()}
    want |= {(p, 2, a, b): (sum(x) / len(x), "".join(str(int(h[a]) * int(h[b])) for h in haps)) for (p, a, b), x in pair.items()}
    found = catalogue.queries()["lasso_design_whole"](spark, DATA).collect()
    assert len(found) == len(want) and max(r.l1 for r in found if r.l1 is not None) > 3
    for r in found:
        label, features = want[r.pool, r.block, r.l1, r.l2]
        assert abs(r.label - label) < 1e-8 and r.features.replace(",", "") == features
