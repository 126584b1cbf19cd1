"""Texts for the tests of this folder."""

import random


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{min(int(r.paretovariate(0.7)), vocabulary)}{'.' if r.random() < 0.1 else ''}" for _ in range(n))


def edited(text, seed, share):
    r = random.Random(seed)
    return " ".join(f"e{r.randrange(10**6)}" if r.random() < share else w for w in text.split(" "))


def texts():
    """(doc_id, text): nulls, blanks, a long text, exact and near copies, a shared passage, repeated rows."""
    base = [prose(i, 60 + 10 * i) for i in range(12)]
    passage = prose(99, 70)
    long = prose(7, 20_000, 4000)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "one two three four"), (6, "One two three FOUR"), (7, long), (8, long), (9, edited(long, 1, 0.01))]
    rows += [(10 + i, t) for i, t in enumerate(base)]
    rows += [(30 + i, edited(t, i, 0.01 + 0.004 * i)) for i, t in enumerate(base)]
    rows += [(50 + i, f"{prose(200 + i, 40)} {passage} {prose(300 + i, 40)}") for i in range(6)]
    rows += [(60, "é" * 60 + " ö"), (61, "ü" + "é" * 60), (62, "a" * 49), (63, "a" * 49), (64, "b" * 50), (65, "b" * 51), (10, base[0])]
    return rows
