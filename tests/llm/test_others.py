"""Pages, conversations, benchmark items, toxicity and the pipeline."""

import random

import duckdb
import numpy as np
import pytest
from llm_samples import edited, prose

from poolweave.llm import chat, decontamination, html_text, queries, toxicity

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="home nav-open">
<header><p>Site name</p></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice"><p>We use cookies</p></div>
<article><header><h1>Caf&eacute; &amp; bar</h1></header><p>First   <b>bold</b>
 line.<br>Same block<p>Second &lt;tag&gt;.</p><aside>Related</aside><form><p>Sign up</p></form><ul><li>one<li>two</ul><div class="ad">Buy</div></article>
<section id="comments"><p>A long reader comment that has as many words as any paragraph of the article itself.</p></section><footer>&copy; x</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Café & bar\nFirst bold line. Same block\nSecond <tag>.\none\ntwo"
    assert html_text.main_text(None) == "" and html_text.main_text("") == "" and html_text.main_text("<nav>x</nav>") == ""
    assert html_text.main_text("<p>cut off in the mid") == "cut off in the mid"
    page = '<div class="page no-sidebar header-wrap"><article class="post has-sidebar"><div class="entry-header"><h1>T</h1></div><p>Text.</p><div class="comment-list"><p>Hi</p></div></article><aside><article><p>Card</p></article></aside></div>'
    assert html_text.main_text(page) == "T\nText."


def test_unmarked_page_by_ratio():
    links = "".join(f"<div><a href='/{i}'><span>l{i}</span></a></div>" for i in range(20))
    text = "".join(f"<p>{prose(i, 60)}</p>" for i in range(6))
    found = html_text.main_text(f"<body>{links}{text}{links}</body>")
    assert all(prose(i, 60) in found for i in range(6)) and "l3\n" not in found


def test_articles_of_comments_and_teasers_do_not_replace_the_text():
    body = "".join(f"<p>Paragraph {i} of the main text, which is long enough to be told from links by its ratio.</p>" for i in range(6))
    links = "<ul>" + "".join(f"<li><a href='/{i}'>go {i}</a></li>" for i in range(12)) + "</ul>"
    comments = "<section id=comments><article class=comment><p>A reader's comment that is as long as any paragraph of the main text is.</p></article></section>"
    want = "\n".join(f"Paragraph {i} of the main text, which is long enough to be told from links by its ratio." for i in range(6))
    assert html_text.main_text(f"<body>{links}<div class=content>{body}</div>{comments}{links}</body>") == want
    own = "<article class='comment depth-1'><p>A reader's comment that is as long as any paragraph of the main text is.</p></article>"
    assert html_text.main_text(f"<body>{links}<div class=content>{body}</div>{own}{links}</body>") == want
    cards = "<div class=row>" + "<article class=card><ul><li><a href='/x'>More</a></li></ul></article>" * 6 + "</div>"
    assert html_text.main_text(f"<body>{links}<div class=content>{body}</div>{cards}{links}</body>") == want
    post = f"<article class='post category-comment tag-related comments-open'><h1>T</h1>{body}</article>"
    assert html_text.main_text(f"<body>{links}<div class='page comments-open'>{post}</div>{links}</body>") == "T\n" + want


def test_extract_keeps_every_page(spark):
    rows = [(1, "u", PAGE, 9), (1, "u", PAGE, 9), (2, None, None, 9), (None, "v", "<p>" + "x " * 200_000, 9)]
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text long")).collect()
    assert len(out) == 4 and sorted(r.n_chars for r in out)[0] == 0 and all(r.n_chars == len(r.text) for r in out)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


TURNS = "conv_id long, turn long, role string, text string, h string, pos string"


def test_chat(spark):
    rows = [(i, t, "user" if t % 2 else "bot", f"s{t}", "a", "b") for i in (3, 4) for t in range(5)]  # equal ones
    rows += [(5, t, "user" if t % 2 else "bot", f"s{t}", "a", "b") for t in range(3)]  # a prefix of them
    rows += [(6, 0, None, None, "a", "b"), (7, 0, "bot", "s0", "a", "b"), (7, 0, "bot", "s0", "a", "b"), (8, 0, "x", "s0|x", "a", "b")]
    out = {r.conv_id: (r.n_turns, r.copies) for r in chat.format_chats(spark.createDataFrame(rows, TURNS)).collect()}
    assert out == {3: (5, 2), 6: (1, 1), 7: (2, 1), 8: (1, 1)}
    assert chat.format_chats(spark.createDataFrame([], TURNS)).count() == 0


def test_chat_against_sql(spark):
    r = random.Random(4)
    rows = [(c, t, r.choice("ab"), r.choice("xy"), "", "") for c in range(150) for t in range(r.randint(1, 4))]
    df = spark.createDataFrame(rows, TURNS)
    conversations = df.toPandas()
    expected = duckdb.connect().from_df(conversations).query("conversations", queries.oracle_sql()["op7_chat_formatting"]).fetchall()
    assert sorted(map(tuple, chat.format_chats(df).select("conv_id", "n_turns", "copies", "text").collect())) == sorted(expected)


def test_no_python_in_chat(spark, capsys):
    chat.format_chats(spark.createDataFrame([(1, 0, "a", "b", "", "")], TURNS)).explain()
    assert "Python" not in (text := capsys.readouterr().out) and "Arrow" not in text


@pytest.fixture(scope="module")
def benchmark(spark):
    items = [(i, prose(1000 + i, 40, 10**6)) for i in range(20)] + [(20, None), (21, ""), (22, "two words"), (3, prose(1003, 40, 10**6))]
    return spark.createDataFrame(items, "item_id long, text string")


def test_decontamination(spark, benchmark):
    items = {r.item_id: r.text for r in benchmark.collect()}
    rows = [(i, prose(i, 150, 10**6), "x") for i in range(60)] + [(1000, None, "x"), (1001, "", "x")]
    rows += [(100 + i, f"{prose(300 + i, 60)} {items[i]} {prose(400 + i, 60)}", "x") for i in range(20)]
    rows += [(200 + i, f"{prose(500 + i, 60)} {edited(items[i], i, 0.1).upper()}! {prose(600 + i, 60)}", "x") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    out = {(r.doc_id, r.item_id) for r in decontamination.matches(docs, benchmark).collect()}
    assert {(100 + i, i) for i in range(20)} <= out and {(200 + i, i) for i in range(20)} <= out
    assert not {d for d, _ in out if d < 100 or d >= 1000}
    kept = decontamination.clean(docs, benchmark)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {*range(60), 1000, 1001}
    assert decontamination.matches(docs, benchmark.limit(0)).count() == 0 and decontamination.matches(docs.limit(0), benchmark).count() == 0


def test_matches_against_alignment_without_seeds(spark):
    """Edited copies at up to a third of the words: recall against aligning every document with every item whole."""
    import numpy as np

    items = [(i, prose(3000 + i, 30 + 3 * i, 3000)) for i in range(16)] + [(None, prose(3100, 50, 3000))]
    rows = [(i, prose(4000 + i, 120, 3000)) for i in range(30)]
    rows += [(100 + k, f"{prose(5000 + k, 70, 3000)} {edited(items[k % 17][1], k, 0.02 * (k % 18))} {prose(6000 + k, 50, 3000)}") for k in range(72)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontamination.matches(docs, marks).collect()}
    of, count, total = decontamination.Words(), {}, 0
    for _, t in rows:
        for w in of.of(t).tolist():
            count[w] = count.get(w, 0) + 1
            total += 1
    want = {}
    for item, t in items:
        x = of.of(t)
        share = (np.array([count.get(w, 0) for w in x.tolist()]) + 0.5) / total
        weight = decontamination.MATCH * np.clip(np.log(share) / np.log(decontamination.RARE), 0.05, 1.0)
        for k, text in rows:
            score, *_ = decontamination.align(x, of.of(text), weight)
            if score / weight.sum() >= decontamination.MIN_SCORE:
                want[k, item] = score / weight.sum()
    assert {k for k, _ in want} <= set(range(100, 172)) and len(want) > 60 and any(item is None for _, item in want)
    assert set(found) <= set(want) and len(found) >= 0.9 * len(want)
    assert all(r.score <= want[k] + 1e-9 for k, r in found.items())
    words = {k: of.of(t) for k, t in rows}
    for (k, item), r in found.items():
        assert 0 <= r.begin_word < r.end_word <= len(words[k]) and 70 - 5 <= r.begin_word and r.end_word <= len(words[k]) - 45


def test_an_item_in_a_third_of_all_documents(spark):
    item = prose(7000, 40, 10**6)
    rows = [(i if i % 7 else None, f"{prose(7100 + i, 30, 10**6)} {item if i % 3 == 0 else ''} {prose(7500 + i, 30, 10**6)}", "x", [1]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, key array<long>").repartition(4)
    marks = spark.createDataFrame([(5, item)], "item_id long, text string")
    assert decontamination.matches(docs, marks).count() == 100
    kept = decontamination.clean(docs, marks)
    assert kept.columns == docs.columns and kept.count() == 200


def test_texts_are_read_and_split_once(spark):
    """Both passes after the first go by its words: rows of the corpus are made once."""
    item, seen = prose(7000, 40, 10**6), spark.sparkContext.accumulator(0)

    texts = [None if i % 9 == 0 else f"{prose(7100 + i, 30, 10**6)} -- {item if i % 3 == 0 else ''} " for i in range(60)]

    def rows(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield decontamination.pa.RecordBatch.from_arrays([b.column(0), decontamination.pa.array([texts[i] for i in b.column(0).to_pylist()])], names=["doc_id", "text"])

    docs = spark.range(0, 60, 1, 2).mapInArrow(rows, "doc_id long, text string")
    found = decontamination.matches(docs, spark.createDataFrame([(5, item)], "item_id long, text string"))
    assert {r.doc_id for r in found.collect()} == {i for i in range(60) if i % 3 == 0 and i % 9} and seen.value == 60


def test_coded_texts_are_their_words():
    import numpy as np

    texts = [None, "", " -- !! ", "Dog dog, DOG cat", *(prose(k, 50, 30).replace(" ", " ... " if k % 2 else " ") for k in range(9)), "\u00a0\u0130x\u03a3\x1cy ..."]
    words, places, sizes = decontamination.coded_texts(texts, decontamination.Words())
    each = np.split(words[places], np.cumsum(sizes)[:-1])
    assert len(sizes) == len(texts) and [x.tolist() for x in each] == [decontamination.Words().of(t).tolist() for t in texts]
    for none in ([], [None, "-"]):
        words, places, sizes = decontamination.coded_texts(none, decontamination.Words())
        assert len(places) == 0 and sizes.tolist() == [0] * len(none)


def test_alignment_against_plain_table():
    import numpy as np

    r = np.random.default_rng(2)
    for _ in range(200):
        a, b = r.integers(0, 4, r.integers(1, 12)), r.integers(0, 4, r.integers(1, 20))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        score, hits, begin, end = decontamination.align(a, b)
        assert score == h.max() and 0 <= begin <= end <= len(b) and (score == 0 or hits > 0)


def test_toxicity(spark):
    """Words never seen in training, but bent from ones that were, are found in the held-out part."""
    r = random.Random(6)
    bad = ["grumbleface", "snotwaggle", "dorkmuffin"]

    def bent(w):
        k = r.randrange(3, len(w) - 2)
        return w[:k] + r.choice("xyz1") + w[k:]

    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        words = prose(i, r.randint(30, 200)).split()
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), bent(r.choice(bad)))
        rows.append((i, " ".join(words), 0.5))
        labels.append((i, int(toxic)))
    rows += [(1000, None, 0.5), (1001, "", 0.5), (1001, "", 0.5), (1002, prose(1, 30_000), 0.5)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, marks)).collect()
    assert len(out) == len(rows) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in out)
    held = [(x.predicted, x.doc_id % 5 == 0) for x in out if x.held_out and x.doc_id < 600]
    assert sum(p == t for p, t in held) / len(held) > 0.95
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), marks)).count() == 0
    nameless = toxicity.score(docs.selectExpr("cast(null as long) as doc_id", "text"), toxicity.fit(docs, marks)).collect()
    assert len(nameless) == len(rows) and not any(x.held_out for x in nameless)
    none = toxicity.fit(docs, marks.limit(0))
    assert all(x.score < 1e-6 and x.predicted == 0 for x in toxicity.score(docs, none).collect())


def test_a_phrase_late_in_a_text_whose_words_came_before(spark):
    """Words that each stood apart before, and stand together at the end."""
    import numpy as np

    bad = [f"vile{i}x" for i in range(8)]
    model = toxicity.train([f"{prose(i, 40)} {' '.join(bad) if i % 2 else prose(900 + i, 8)}" for i in range(80)], [i % 2 for i in range(80)])
    apart = " ".join(f"{prose(50 + i, 60)} {w}" for i, w in enumerate(bad))
    low, high = toxicity.Scorer(model).scores([apart, f"{apart} {prose(99, 30)} {' '.join(bad)} *** -- !"])
    assert high > low and high >= 0.5
    words = [w for w in toxicity.words_of(f"{apart} {prose(99, 30)} {' '.join(bad)} *** -- !")]
    value = model.words(words)
    windows = [value[i : i + toxicity.WINDOW].mean() for i in range(len(words) - toxicity.WINDOW + 1)]
    assert abs(high - 1 / (1 + np.exp(-(max(windows) + model.bias)))) < 1e-9


def test_pipeline_of_nothing(spark, tmp_path, benchmark):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline(spark, tmp_path, benchmark):
    import corpus_pipeline

    items = {r.item_id: r.text for r in benchmark.collect()}
    good = {i: prose(i, 120, 10**6) for i in range(30)}
    rows = [(i, t, "en", "s", len(t)) for i, t in good.items()]
    rows += [(100 + i, " ".join(w if k != 50 else "changed" for k, w in enumerate(good[i].split())), "en", "s", 1) for i in range(10)]  # near copies
    rows += [(200 + i, " | ".join(prose(700 + i, 60).split()), "en", "s", 1) for i in range(5)]  # junk
    rows += [(300 + i, f"{prose(800 + i, 60, 10**6)} {items[i]}", "en", "s", 1) for i in range(5)]  # leaks
    rows += [(400, None, "en", "s", 0), (401, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.dtypes == docs.dtypes, name
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == set(good)
    assert sum(r.length for r in out) == sum({r.doc_id: r.doc_tokens for r in out}.values())


def test_ratio_decides_within_articles_too():
    """A prior is no pass: a strip of links in an article stays out, its title and short paragraphs stay in."""
    links = "<div>" + "".join(f"<div><a href='/{i}'><i><b>{i}</b></i></a></div>" for i in range(30)) + "</div>"
    body = "".join(f"<p>{prose(i, 80)}</p>" for i in range(8))
    found = html_text.main_text(f"<article><h1>A short title here</h1>{body}<p>Short end of it.</p>{links}</article>")
    assert found == "\n".join(["A short title here", *(" ".join(prose(i, 80).split()) for i in range(8)), "Short end of it."])


def paragraphs(n, words=60):
    return [" ".join(prose(400 + i, words).split()) for i in range(n)]


def test_links_and_adverts_inside_an_article_go():
    body = paragraphs(6)
    links = "<ul>" + "".join(f"<li><a href='/{i}'>Read story number {i} next</a></li>" for i in range(10)) + "</ul>"
    advert = "<div><p>Buy the finest boots</p><p><a href='/b'><b>Order</b></a></p><p>Now <i>half</i> <b>price</b></p></div>"
    html = "<article><h1>Title</h1>" + "".join(f"<p>{t}</p>" for t in body[:3]) + advert + "".join(f"<p>{t}</p>" for t in body[3:]) + links + "</article>"
    assert html_text.main_text(html) == "\n".join(["Title", *body])
    # a paragraph that is one link, between others, is text
    html = f"<article><p>{body[0]}</p><p><a href='/x'>The whole of it is a link</a></p><p>{body[1]}</p></article>"
    assert html_text.main_text(html) == f"{body[0]}\nThe whole of it is a link\n{body[1]}"


def test_title_and_short_end_of_an_unmarked_page_stay():
    body = paragraphs(5)
    links = "".join(f"<div><a href='/{i}'>Section {i}</a></div>" for i in range(12))
    html = f"<body>{links}<div class='x'><h1>A title</h1>" + "".join(f"<p>{t}</p>" for t in body) + f"<p>The end.</p></div>{links}</body>"
    assert html_text.main_text(html) == "\n".join(["A title", *body, "The end."])
    assert html_text.main_text(f"<article><p>{body[0]}</p><p class='comment-free'>{body[1]}</p></article>") == f"{body[0]}\n{body[1]}"


def test_smoothing_and_threshold_against_plain_loops():
    import math

    import numpy as np

    r = random.Random(2)
    for n in (1, 2, 3, 5, 40):
        v = [r.choice([0.0, r.random(), 3 + r.random()]) for _ in range(n)]
        at = lambda i: v[i if n < 3 and 0 <= i < n else min(max(i, 0), n - 1) if n < 3 else -i - 1 if i < 0 else 2 * n - 1 - i if i >= n else i]  # noqa: B023, E731
        weight = [math.exp(-k * k / 2) for k in range(-3, 4)]
        want = [sum(w * at(i + k) for k, w in zip(range(-3, 4), weight, strict=True)) / sum(weight) for i in range(n)]
        assert np.allclose(html_text.smooth(np.array(v)), want)
        low, high = min(v), max(v)
        if high - low > 1e-9:
            # two means by plain steps, to where nothing moves
            for _ in range(20):
                a, b = [x for x in v if x <= (low + high) / 2], [x for x in v if x > (low + high) / 2]
                low, high = sum(a) / len(a), sum(b) / len(b)
            assert abs(html_text.threshold(np.array(v)) - (low + high) / 2) < 1e-9


def test_deep_nesting_is_linear():
    import time

    took = []
    for n in (5000, 20_000):
        start = time.process_time()
        html_text.main_text("<div>" * n + "x" + "</span>" * n)
        took.append(time.process_time() - start)
    assert took[1] < 10 * took[0] + 0.2


def test_extra_columns_of_the_results_names(spark):
    rows = spark.createDataFrame([(1, "u", "<article><p>A short text of some words.</p></article>", "clash", 7)], "page_id long, url string, html string, text string, n_chars int")
    assert [tuple(r) for r in html_text.extract(rows).collect()] == [(1, "u", "A short text of some words.", 27)]


def test_filters_come_to_the_driver_once(spark, monkeypatch):
    """A filter made in many parts is added up slice by slice on Spark: what reaches the driver is one filter."""
    size, seen = 1 << 12, []
    kind = type(spark.range(1))
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: (seen.extend(rows := collect(self)), rows)[1])

    def part(batches):
        for b in batches:
            for x in b.column(0).to_pylist():
                out = np.zeros(size, np.uint8)
                out[[x, size - 1]] = x + 1, 7
                yield decontamination.slices(out)

    found = decontamination.merged_filters(spark.range(0, 40, 1, 20).mapInArrow(part, "slice long, f binary"), np.maximum, size)
    want = np.zeros(size, np.uint8)
    want[:40], want[-1] = np.arange(1, 41), 7
    assert (found == want).all() and sum(len(r["f"]) for r in seen) == 2 * size // decontamination.SLICES
    none = spark.range(0).mapInArrow(part, "slice long, f binary")
    assert not decontamination.merged_filters(none, np.maximum, size).any()
