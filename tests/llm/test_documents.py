"""Operators on documents against plain Python, with nulls, blanks, long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_samples import edited, prose

from poolweave.llm import chat, chunks, language_model, ngram_join, packing, quality_rules, shared, suffix_dedup, token_files, tokens
from poolweave.llm.shared import new_path


def words(t):
    return (t or "").encode().split()


def test_quality_measures(docs, rows):
    out = {r.doc_id: r for r in quality_rules.quality_scores(docs).collect()}
    assert len(out) == len({k for k, _ in rows})
    for k, t in rows:
        w, r = words(t), out[k]
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        n, hit = Counter(windows), set()
        for i, x in enumerate(windows):
            if n[x] > 1:
                hit.update(range(i, i + 8))
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(len(x.decode()) for x in w), len(hit), len(lines) - len(set(lines)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t or "")
        assert r.base_failed == (len(w) < 20 or 100 * len(hit) > 30 * len(w))
        assert not (r.kept and r.base_failed)


def test_quality_keeps_rows_and_columns(docs, nothing):
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert 7 in ids and not ids & {1, 2, 3, 4, 5}
    assert quality_rules.quality_scores(nothing).count() == 0 and quality_rules.keep_good(nothing).count() == 0


def test_rules_find_junk_among_prose(spark):
    junk = [" | ".join(prose(i, 60).split()) for i in range(20)]
    data = [(i, prose(i, 80)) for i in range(200)] + [(1000 + i, t) for i, t in enumerate(junk)]
    out = {r.doc_id: r.kept for r in quality_rules.quality_scores(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert all(out[i] for i in range(200)) and not any(out[1000 + i] for i in range(20))


def brute_components(rows):
    sets, parent = {}, {}
    for k, t in rows:
        w = (t or "").encode().lower().split()
        sets.setdefault(k, set()).update({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
        parent[k] = k

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def test_ngram_join(docs, rows, nothing):
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_classes(docs).collect()}
    assert out == brute_components(rows)
    assert out[6] == (1, 5) and out[1] == (0, 1)
    assert ngram_join.join_classes(nothing).count() == 0


def test_ngram_join_keeps_the_first_of_each_group(docs, rows):
    kept = ngram_join.keep_one(docs)
    expected = {k for k, (_, c) in brute_components(rows).items() if k == c}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == expected


def test_ngram_join_joins_a_chain(spark):
    """Neighbours link, ends do not: only components tell."""
    w = prose(5, 300, 10**9).split()
    data = [(i, " ".join(w[5 * i : 5 * i + 120])) for i in range(20)]
    out = {r.doc_id: r.component_id for r in ngram_join.join_classes(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert set(out.values()) == {0}


def test_crowded_lists_meet_by_two_orders(spark):
    """Pages of one template that do not link, and among them a few that do."""
    frame = prose(77, 60, 10**9)
    rows = [(i, f"{frame} {prose(2000 + i, 40, 10**9)}") for i in range(60)]
    rows += [(100 + i, edited(rows[i][1], i, 0.01)) for i in range(12)]
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_classes(spark.createDataFrame(rows, "doc_id long, text string"), long=1).collect()}
    assert out == brute_components(rows)


def brute_suffixes(rows):
    first = {}
    for k, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(first.get(b[i : i + 50], k), k)
    out = {}
    for k, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < k:
                gone[i : i + 50] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[k] = (len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("hot", "width"), [(suffix_dedup.HOT, 64), (2, 64), (suffix_dedup.HOT, 6), (2, 6)])
def test_suffix_dedup(docs, rows, hot, width):
    """Keys of 6 bits stand for several contexts and strings each: what they leave open is told by bytes."""
    out = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(docs, hot, width).collect()}
    assert out == brute_suffixes(rows)


def test_suffix_dedup_of_nothing_and_cut(docs, nothing):
    assert suffix_dedup.dedup(nothing).count() == 0
    cut = suffix_dedup.cut(docs)
    found = {r.doc_id: r.text for r in cut.collect()}
    assert cut.columns == docs.columns and 8 not in found and found[7] and found[1] is None and 51 in found


def test_suffix_array():
    r = np.random.default_rng(3)
    for size, letters in ((50, 2), (400, 3), (1000, 250)):
        text = np.concatenate([r.integers(1, letters + 1, size), [0, 0, 0]])
        order = suffix_dedup.suffix_array(text, letters + 1, 10**6)
        real = sorted(range(size), key=lambda i: text[i:].tolist())
        assert [i for i in order.tolist() if i < size] == real


def test_language_model(docs, rows, nothing):
    training, texts = Counter(), [(k, [*(t or "").encode().lower().split(), b"\n"]) for k, t in rows]
    for k, w in texts:
        if zlib.crc32(str(k).encode()) % 10:
            training.update(w)
    total, kinds = sum(training.values()), len(training)
    base = {k: sum(math.log10((training[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in w) for k, w in texts}
    out = language_model.score(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        w = dict(texts)[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0, len(w), sum(training[x] > 0 for x in w), total)
        assert abs(r.base_score - base[r.doc_id]) < 1e-6 * max(1, abs(base[r.doc_id])) and r.score < 0
    assert language_model.score(nothing).count() == 0


def classes_of(chunks, found):
    """Class of each word's key, by what came back to each chunk; the same in all of them."""
    out = {}
    for row in chunks.collect():
        c = language_model.Chunk(row.asDict())
        back = language_model.pa.Table.from_pylist([r.asDict() for r in found.where(f"chunk = {c.chunk}").collect()])
        for k, v in zip(c.keys.tolist(), c.classes(back, 1).tolist(), strict=True):
            assert out.setdefault(k, v) == v
    return out


def test_language_model_scores_by_its_classes(spark, docs, rows, monkeypatch):
    """Scores counted again in plain Python from the words' classes."""
    seen = {}
    fit = language_model.clustered

    def kept(chunks, n, words):
        found, sums = fit(chunks, n, words)
        seen.update(cls=classes_of(chunks, found), sums=sums, words=words)
        return found, sums

    monkeypatch.setattr(language_model, "clustered", kept)
    out = language_model.score(docs).collect()
    key = lambda w: language_model.xxhash.xxh64_intdigest(w)
    texts = [(k, [*(t or "").encode().lower().split(), b"\n"]) for k, t in rows]
    count, pairs = Counter(), Counter()
    for k, w in texts:
        if zlib.crc32(str(k).encode()) % 10:
            count.update(w)
            pairs.update((seen["cls"][key(a)], seen["cls"][key(b)]) for a, b in zip([b"\n", *w], w, strict=False))
    n = language_model.CLASSES
    mass, kinds, into, from_ = Counter(), Counter(), Counter(), Counter()
    for w, m in count.items():
        mass[seen["cls"][key(w)]] += m
        kinds[seen["cls"][key(w)]] += 1
    for (a, b), m in pairs.items():
        from_[a] += m
        into[b] += m
    total = sum(count.values())
    assert seen["sums"].tolist() == [*(mass[c] for c in range(n)), *(kinds[c] for c in range(n))] and sum(kinds.values()) == len(count)
    alone = [(into[c] + 0.1) / (total + 0.1 * n) for c in range(n)]
    move = lambda a, c: alone[c] if a is None or not from_[a] else 0.95 * pairs[a, c] / from_[a] + 0.05 * alone[c]
    for r in out:
        want, before = 0.0, seen["cls"][key(b"\n")]
        for w in dict(texts)[r.doc_id]:
            if count[w]:
                c = seen["cls"][key(w)]
                want += math.log10(move(before, c) * (count[w] + 0.1) / (mass[c] + 0.1 * (kinds[c] + 1)))
                before = c
            else:
                want += math.log10(sum(move(before, c) * 0.1 / (mass[c] + 0.1 * (kinds[c] + 1)) for c in range(n)))
                before = None
        assert abs(r.score - want) < 1e-6 * max(1, abs(want))


def test_no_move_gains_more_than_the_one_chosen():
    """Gains of all words and classes in plain loops, a word's own tokens taken out of its class."""
    r, n = np.random.default_rng(5), language_model.CLASSES
    both = r.integers(0, 60, (n, n)).astype(float)
    both[:, 9] = both[9] = 0  # a class without tokens takes no words
    keys, counts, words = [], [], []
    for i in range(40):
        word = int(r.integers(0, 2**55))
        old = int(r.integers(-1, n))
        old = -1 if old == 9 else old
        slots = {int(x): int(r.integers(1, 4)) for x in r.integers(0, 2 * n, 6)}
        if old >= 0:
            for s, m in slots.items():
                a, b = (s, old) if s < n else (old, s - n)
                both[a, b] = max(both[a, b], m)
        words.append((word, old, slots))
    for word, old, slots in sorted(words):
        for s, m in sorted([*slots.items(), (2 * n + old + 1, 1)]):
            keys.append(word << 8 | s)
            counts.append(m)
    keys, counts = np.array(keys, np.uint64), np.array(counts, np.uint64)
    old, new, _, _ = language_model.chosen(keys, counts, both, 0)
    rows, cols = both.sum(1), both.sum(0)
    for (word, was, slots), a, b in zip(sorted(words), old, new, strict=True):
        right, left = {s - n: m for s, m in slots.items() if s >= n}, {s: m for s, m in slots.items() if s < n}
        gain = {}
        for c in range(n):
            if not rows[c] + cols[c]:
                continue
            mine = (lambda m: m) if c == was else (lambda m: 0)
            gain[c] = sum(m * math.log(max(both[c, d] - mine(m), 0) + 0.1) for d, m in right.items()) + sum(m * math.log(max(both[d, c] - mine(m), 0) + 0.1) for d, m in left.items())
            gain[c] -= sum(right.values()) * math.log(max(rows[c] - mine(sum(right.values())), 0) + 0.1 * n) + sum(left.values()) * math.log(max(cols[c] - mine(sum(left.values())), 0) + 0.1 * n)
        assert a == was
        if was < 0 or word >> 13 & 1 == 0:
            assert gain[int(b)] > max(gain.values()) - 1e-9
        else:
            assert b == was


def test_words_that_may_not_move_send_their_class_alone():
    """What a chunk sends in a sweep, against counts in plain loops: neighbours only of words whose turn it is or without a class."""
    lm, r = language_model, np.random.default_rng(8)
    texts = [" ".join(f"w{int(k)}" for k in r.integers(0, 60, 40)) for _ in range(20)]
    rows = lm.pa.table({"doc_id": list(range(20)), "text": texts, "held_out": [False] * 20, "chunk": [0] * 20})
    c = lm.Chunk(lm.encoded(rows).to_pylist()[0])
    cls = r.integers(-1, lm.CLASSES, len(c.keys))
    x, before = (v.tolist() for v in c.training())
    for turn in (0, 1):
        want = Counter()
        for k, key in enumerate(c.keys.tolist()):
            want[key >> 8, 2 * lm.CLASSES + int(cls[k]) + 1] += 1
        asks = [bool(lm.may_move(c.keys >> lm.WIDTH, turn)[k]) or cls[k] < 0 for k in range(len(c.keys))]
        for word, other, side in ((x, before, 0), (before, x, lm.CLASSES)):
            want.update((int(c.keys[a]) >> 8, side + int(cls[b])) for a, b in zip(word, other, strict=True) if asks[a] and cls[b] >= 0)
        low, found = chunks.low_bits(4, 64), {}
        for m in lm.neighbours(c, cls, 1, low, turn).to_pylist():
            keys = (m["block"] << low) + np.cumsum(chunks.unpack(m["keys"], m["n"]).astype(object))
            found.update(((int(k) >> 8, int(k) & 255), int(v)) for k, v in zip(keys, chunks.unpack(m["counts"], m["n"]), strict=True))
        assert found == dict(want) and not all(asks)


def test_a_sweep_reads_the_corpus_once(docs, monkeypatch):
    """Bigrams of the classes before come with what is sent; the chunks are read once more after the last sweep, and for the model."""
    seen = {"read": 0, "sweeps": 0}

    def counting(name, f):
        def run(*args, **more):
            seen[name] += 1
            return f(*args, **more)

        return run

    monkeypatch.setattr(language_model, "classed", counting("read", language_model.classed))
    monkeypatch.setattr(language_model, "sweep", counting("sweeps", language_model.sweep))
    language_model.score(docs)
    assert seen["sweeps"] > 1 and seen["read"] <= seen["sweeps"] + 2


def test_numbers_packed_piece_by_piece():
    r = np.random.default_rng(3)
    for _ in range(60):
        each = [r.integers(0, 2 ** int(r.integers(1, 64)), int(r.integers(1, 40))).astype(np.uint64) >> r.integers(0, 64, 1).astype(np.uint64) for _ in range(9)]
        each += [np.array([0], np.uint64), np.full(5, 2**63 + 9, np.uint64), np.array([2**64 - 1, *range(300)], np.uint64), np.array([2**63, *[5] * 60, 128, 127, 16384], np.uint64)]
        ends = np.cumsum([len(x) for x in each])
        data = chunks.pack_each(np.concatenate(each), ends - [len(x) for x in each], ends)
        assert data == [chunks.pack(x) for x in each] and {0, 1, 8} <= {d[0] for d in data}
        sizes = [len(x) for x in each]
        for back in (chunks.unpack_each(data, sizes), [chunks.unpack(d, n) for d, n in zip(data, sizes, strict=True)]):
            assert all((x == y).all() and len(x) == len(y) and y.dtype == np.uint64 for x, y in zip(each, back, strict=True))
    assert chunks.unpack(chunks.pack(np.empty(0, np.uint64)), 0).tolist() == []


def test_held_out_text_is_likelier_than_by_the_base(spark):
    """Words alternate between two kinds: classes tell which kind comes next, also behind words seen a few times."""
    r = np.random.default_rng(2)
    sides = [[f"{side}{i}" for i in range(700)] for side in ("even", "odd")]
    texts = [" ".join(sides[k % 2][min(int(x), 699)] for k, x in enumerate(r.exponential(150, 60))) for _ in range(400)]
    out = language_model.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).where("held_out").collect()
    assert sum(x.score for x in out) > sum(x.base_score for x in out) + 0.2 * sum(x.n_tokens for x in out)


@pytest.mark.parametrize("size", [50, 200])
def test_totals_by_teams_and_rows_in_proportion(size):
    """A chunk sends a row to each part at most, and FAN whatever the corpus; numbers come back as they were packed."""
    r = np.random.default_rng(size)
    for n in (1, 3, 40):
        sent = [np.unique(r.integers(0, 2**30, size).astype(np.uint64)) for _ in range(n)]
        low = chunks.low_bits(n, 30)
        assert all(chunks.message(0, x, x, low).num_rows <= min(chunks.FAN, 2 ** chunks.bits_for(n)) for x in sent)
    values = [np.empty(0, np.uint64), r.integers(0, 2**63, size).astype(np.uint64), np.array([0, 127, 128, 2**64 - 1], np.uint64), np.append(np.ones(size, np.uint64), np.uint64(2**50))]
    assert all((chunks.unpack(chunks.pack(x), len(x)) == x).all() for x in values)


@pytest.mark.parametrize("lowest", [False, True])
def test_totals_in_two_steps(spark, monkeypatch, lowest):
    monkeypatch.setattr(chunks, "FAN", 4)
    r, rows_sent = np.random.default_rng(3), []
    for n in (10, 20, 40, 80):
        own = {c: np.unique(r.integers(0, 400, 60).astype(np.uint64) * np.uint64(2621440)) for c in range(n)}
        low = chunks.low_bits(n, 30)
        sent = [m for c, k in own.items() for m in chunks.message(c, k, np.full(len(k), c + 1), low, k & np.uint64(7)).to_pylist()]
        rows_sent.append(len(sent) / n)
        got = chunks.totals(spark.createDataFrame(sent, chunks.SENT), n, 30, lowest=lowest).collect()
        want = Counter()
        for c, keys in own.items():
            for k in keys.tolist():
                want[k] = min(want.get(k, 10**9), c + 1) if lowest else want[k] + c + 1
        for c, keys in own.items():
            back = chunks.pa.Table.from_pylist([x.asDict() for x in got if x.chunk == c])
            assert chunks.answers(back).tolist() == [want[k] for k in keys.tolist()]
    assert max(rows_sent) <= 4  # in proportion to chunks, not to their square


def test_keys_that_stand_for_different_things_say_so():
    keys, one = np.array([5, 9], np.uint64), np.ones(2, np.int64)
    sent = chunks.pa.concat_tables([chunks.message(c, keys, one + c, 20, np.array([1, c], np.uint64)) for c in (0, 1)])
    assert chunks.gathered(sent, 20, True).total.tolist() == [1, 0]


def test_more_chunks_than_buckets(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(chunks, "CHUNK", 3000)
    spark.conf.set("spark.sql.sources.bucketing.maxBuckets", "5")
    try:
        out = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_classes(docs).collect()}
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.maxBuckets")
    assert out == brute_components(rows)


def test_nothing_is_left_but_the_result(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "shared_dir", lambda spark: f"file://{tmp_path}/own")
    names = {t.name for t in spark.catalog.listTables()}
    for k, f in enumerate((ngram_join.join_classes, suffix_dedup.dedup, suffix_dedup.cut, language_model.score, packing.pack)):
        assert f(docs).count() and len(list((tmp_path / "own").iterdir())) == k + 1
    turns = spark.createDataFrame([(1, 0, "user", "a", 5, True), (1, 1, "bot", "b", 6, False), (2, 0, "user", "a", 7, None)], "conv_id long, turn long, role string, text string, copies int, last boolean")
    assert [tuple(r) for r in chat.format_chats(turns).collect()] == [(1, 2, 1, "<|user|>\na\n<|end|>\n<|bot|>\nb\n<|end|>\n")]
    assert len(list((tmp_path / "own").iterdir())) == k + 2
    assert {t.name for t in spark.catalog.listTables()} == names


def test_clashing_names_and_missing_ids(spark, rows):
    """Columns called like those the operators make, names with dots, and rows without doc_id."""
    names = "text string, `__m` string, `__p` double, `__failed` boolean, m long, p double, failed string, c0 string, c1 long, `a.b` string, size long, key string, comp long, rep long, h1 long, chunk long, n_chars int"
    extra = ("u", 0.5, False, 1, 0.25, "v", "w", 2, "d", 3, "k", 4, 5, 6, 7)
    data = [(None if i % 9 == 4 else k, t, *extra, 0 if t is None else len(t)) for i, (k, t) in enumerate(rows)] + [(None, rows[12][1], *extra, len(rows[12][1]))] * 3
    docs = spark.createDataFrame(data, f"doc_id long, {names}").repartition(3)
    as_is = {tuple(r) for r in docs.drop("text", "n_chars").collect()}
    for f in (quality_rules.keep_good, ngram_join.keep_one, suffix_dedup.cut):
        out = f(docs)
        assert out.dtypes == docs.dtypes, f
        assert {tuple(r) for r in out.drop("text", "n_chars").collect()} <= as_is
        assert all(r.n_chars == len(r.text or "") for r in out.collect())
    missing = sum(r[0] is None for r in data)
    for f in (quality_rules.quality_scores, ngram_join.join_classes, suffix_dedup.dedup, language_model.score, packing.pack):
        out = f(docs).collect()
        assert sum(r.doc_id is None and (f is not packing.pack or r.start == 0) for r in out) == missing, f
    assert all(r.component_id is None for r in ngram_join.join_classes(docs).collect() if r.doc_id is None)
    assert all(r.n_removed == 0 for r in suffix_dedup.dedup(docs).collect() if r.doc_id is None)
    path = new_path(spark, "missing")
    back = token_files.read_documents(token_files.file_starts(token_files.write_sequences(docs, path, tokens.default_path())), path).orderBy("start").collect()
    assert [r.doc_id for r in back[:missing]] == [None] * missing and len(back) == len(data)


def test_rows_of_one_doc_id_stay_or_go_together(spark):
    t = prose(1, 50)
    docs = spark.createDataFrame([(1, t, "a"), (1, t, "b"), (2, t, "c"), (2, prose(3, 50), "d")], "doc_id long, text string, x string")
    assert sorted(r.x for r in ngram_join.keep_one(docs).collect()) == ["a", "b"]


HOSTILE = ["a  b", "a   b", "a \n b\t c", " lead", "trail ", "tr  ", "\x1c x", "it's 's x'sure", "a\n \nb", "", "\xa0 \xa0x", "x  y", "12 34 5", "<|endoftext|> a", "² ½x é… æ. 漢字。 ß", "a\0b c", "!! a!! #b", "naïve façade 😀 x", "tabs\t\tx  \n\n y"]


def test_encoder_equals_the_library():
    coder = tokens.Encoder(tokens.default_path())
    assert coder.encode([*HOSTILE, None]) == coder.ids([*HOSTILE, ""])
    assert coder.encode(HOSTILE) == coder.ids(HOSTILE)


def test_pieces_that_words_share_are_merged_once():
    coder, calls = tokens.Encoder(tokens.default_path()), []
    inner = coder.model

    class Counting:
        def tokenize(self, data):
            calls.append(data)
            return inner.tokenize(data)

    coder.model = Counting()
    text = " ".join(["start", *(f"unheard{m}" for m in ("", ",", ".", "...", "!!", ".\nUnheard", "\nUnheard;"))])
    assert coder.encode([text]) == coder.ids([text])
    assert len(calls) == len(set(calls)) and sum("unheard" in x for x in calls) == 1


def reference_ids(rows, end):
    coder = tokens.Encoder(tokens.default_path())
    return [(k, np.append(np.frombuffer(coder.ids([t or ""])[0], coder.type), end).astype("<u4")) for k, t in rows]


def test_token_files_round_trip(spark, docs, rows, nothing):
    path = new_path(spark, "test")
    files = token_files.write_sequences(docs, path, tokens.default_path())
    out = token_files.read_documents(token_files.file_starts(files), path).orderBy("start").collect()
    assert [r.doc_id for r in out] == sorted(k for k, _ in rows)
    assert [r.start for r in out] == [0, *np.cumsum([r.n_tokens for r in out])[:-1]]
    crc = {k: zlib.crc32(x.tobytes()) for k, x in reference_ids(rows, 0)}
    assert all(r.ids_crc32 == crc[r.doc_id] for r in out)
    assert token_files.write_sequences(nothing, path + "-empty", tokens.default_path()).count() == 0


def test_token_files_random_access(spark, docs):
    import pyarrow as pa

    path = new_path(spark, "test")
    row = token_files.write_sequences(docs.coalesce(1), path, tokens.default_path(), length=64).orderBy("part").first()
    fs, root = token_files.opened(path)
    with pa.memory_map(f"{root}/{row.file}.arrow") as source:
        reader = token_files.SequenceReader(source)
        before = pa.total_allocated_bytes()
        flat = reader.slice(0, row.n_tokens)
        ids, mask = reader.sequence(1)
        assert (ids == flat[64:128]).all() and mask.all()
        assert pa.total_allocated_bytes() - before < len(flat)  # views of the map, not copies
        last, mask = reader.sequence((row.n_tokens - 1) // 64)
        assert mask.sum() == (row.n_tokens - 1) % 64 + 1


def test_packing(docs, rows, nothing):
    ids = {}
    for k, x in reference_ids(rows, 1):
        ids.setdefault(k, []).append(x)
    out = packing.pack(docs).collect()
    total = sum(len(x) for xs in ids.values() for x in xs)
    assert sum(r.length for r in out) == total
    by = {}
    for r in out:
        x = ids[r.doc_id][0]
        assert r.doc_tokens == len(x) and r.ids_crc32 == zlib.crc32(x[r.start : r.start + r.length].tobytes())
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(by) == -(-total // packing.LENGTH)
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.LENGTH
    assert packing.pack(nothing).count() == 0
