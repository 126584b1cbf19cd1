"""The Merkle manifest against a tree built in plain Python."""

import hashlib
import zlib

import pytest

from poolweave.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, pos long, path string, root string"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def grown(level):
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        first = i - i % 3
        out.append(("".join(level[first:i]), "".join(level[i + 1 : first + 3])))
        i //= 3
    return out


def plain(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    by = {}
    for doc, text, lang, source, chars in rows:
        head = "".join(map(field, (doc, source, lang, chars)))
        hit = doc is not None and text is not None and zlib.crc32(str(doc).encode()) % 2 == 0
        by.setdefault(source, []).append((doc, sha(head + field(text)), sha(head + field(text.replace("\n", "") if hit else text))))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {s: grown([x[1] for x in by[s]]) for s in names}
    top = grown([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (doc, leaf, start) in enumerate(by[s]):
            path = siblings(trees[s], i) + siblings(top, k)
            for left, right in path:
                start = sha(left + start + right)
            out.append((doc, leaf, trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), start, start == top[-1][0]))
    return out


def rows():
    """One source of half of all rows, lone rows, a null source and an empty one, nulls everywhere, repeated rows."""
    out = [(i, f"text {i}\nmore é" if i % 3 else f"text {i}", "en", "hot", i) for i in range(90)]
    out += [(200 + i, f"a\n{i}", "de", f"s{i % 7}", None) for i in range(60)]
    out += [(300, None, None, None, None), (301, "", "fr", None, 0), (302, "x\n" * 50, "fr", "", 3), (None, "a\nb", "en", "hot", 1), (None, None, None, "hot", None), (7, "again", "en", "hot", 2)]
    return out + [out[5], out[5], (400, "w " * 100_000 + "\n", "en", "é", 5)]


def order(found):
    return sorted(found, key=str)


@pytest.mark.parametrize("depth", [1, 2, 5])
def test_manifest_equals_plain_tree(spark, depth):
    given = rows()
    docs = spark.createDataFrame([(*r, "clash", 1, "clash", "clash") for r in given], SCHEMA).repartition(5)
    found = [tuple(r) for r in merkle.manifest(docs, depth).select(*COLUMNS).collect()]
    assert order(found) == order(plain(given))
    assert {r[-1] for r in found} == {True, False}


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(1, "a", "en", "s", 1, "", 0, "", "")], SCHEMA)
    assert [tuple(r) for r in merkle.manifest(one).select(*COLUMNS).collect()] == plain([(1, "a", "en", "s", 1)])
    assert merkle.manifest(one.limit(0)).collect() == []


def test_path_proves_a_row(spark):
    docs = spark.createDataFrame([(*r, "", 0, "", "") for r in rows()], SCHEMA)
    for r in merkle.manifest(docs, 2).where("doc_id BETWEEN 200 AND 220").collect():
        h = r["leaf"]
        for p in r["path"]:
            h = sha(p["l"].decode() + h + p["r"].decode())
        assert h == r["root"] and r["source"].startswith("s")
