"""Quality classifier, benchmark search, license scan, main text."""

from __future__ import annotations

import numpy as np
import pytest

from llm_rows import PASSAGE, SF
from tradeloom.llm import decontaminate, licenses, main_text, quality, queries_quality
from tradeloom.llm.words import words


def texts_of(kind, n):
    rng = np.random.default_rng(3)
    vocabulary = ["the", "river", "stone", "walks", "over", "house", "green", "and"]
    out = []
    for _ in range(n):
        chosen = rng.choice(vocabulary, 60)
        out.append(" ".join(chosen if kind else [w + "%%%" for w in chosen]).encode())
    return out


def test_network_learns_and_covers_the_whole_text():
    settings = quality.Settings(epochs=6, filters=8, batch=10)
    net = quality.fit(texts_of(0, 60) + texts_of(1, 60), [0] * 60 + [1] * 60, settings)
    p = quality.probabilities(net, texts_of(1, 3) + texts_of(0, 3))
    assert (p[:3] > 0.7).all() and (p[3:] < 0.3).all()
    tail = texts_of(1, 1)[0] * 3
    clean, spoilt = quality.probabilities(net, [tail * 20, tail * 20 + b"".join(texts_of(0, 40))])
    assert spoilt < clean


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(1)
    net = quality.fit(texts_of(0, 4) + texts_of(1, 4), [0] * 4 + [1] * 4, quality.Settings(epochs=1, filters=3, embedding=2))
    net = quality.Network(*[a.astype(np.float64) for a in (net.embed, net.kernel, net.shift, net.weight, net.bias)])
    texts, labels = texts_of(0, 3) + texts_of(1, 3), np.array([0, 0, 0, 1, 1, 1.0])
    _, grads = quality.gradients(net, texts, labels)
    for array, grad in zip((net.embed, net.kernel, net.shift, net.weight, net.bias), grads):
        for _ in range(3):
            at = tuple(rng.integers(0, s) for s in array.shape)
            if array is net.embed:
                at = (ord("e"), at[1])
            step, old = 1e-3, array[at]
            array[at] = old + step
            up = quality.gradients(net, texts, labels)[0]
            array[at] = old - step
            down = quality.gradients(net, texts, labels)[0]
            array[at] = old
            assert grad[at] == pytest.approx((up - down) / (2 * step), rel=0.1, abs=1e-3)


def test_gradients_of_parts_add_up(monkeypatch):
    net = quality.fit(texts_of(0, 4) + texts_of(1, 4), [0] * 4 + [1] * 4, quality.Settings(epochs=1))
    texts, labels = [t * n for n, t in enumerate(texts_of(0, 4) + texts_of(1, 4))], np.array([0, 0, 0, 0, 1, 1, 1, 1], np.float32)
    loss, whole = quality.gradients(net, texts, labels)
    monkeypatch.setattr(quality, "PIECE", 5)
    got, parts = quality.gradients(net, texts, labels)
    assert got == pytest.approx(loss, rel=1e-5) and all(np.allclose(a, b, rtol=1e-3, atol=1e-6) for a, b in zip(parts, whole))


def test_marks_anywhere_in_long_texts_are_learned(spark, make_docs):
    # The texts differ only at bytes 520 to 1780, which four excerpts of 512 bytes of 6000 miss.
    plain = [t.decode() for t in texts_of(1, 60)]
    long = [(" ".join(plain[i:] + plain[:i]) * 2)[:6000] for i in range(60)]
    rows = [(i, t if i % 2 else t[:520] + "#%" * 630 + t[1780:]) for i, t in enumerate(long)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    net = quality.train(make_docs(rows), labels, quality.Settings(epochs=40, batch=5, rate=0.03))
    p = quality.probabilities(net, [t.encode() for _, t in rows])
    assert p[1::2].min() > p[0::2].max() and p[1::2].mean() - p[0::2].mean() > 0.5


def test_batches_do_not_matter():
    net = quality.fit(texts_of(0, 20) + texts_of(1, 20), [0] * 20 + [1] * 20, quality.Settings(epochs=1))
    texts = [b"", b"a", b"b" * 127, b"c" * 128, b"d" * 5000, "é漢".encode() * 77]
    assert quality.probabilities(net, texts) == pytest.approx([quality.probabilities(net, [t])[0] for t in texts], abs=1e-5)


def test_scores_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    net = quality.train(odd_docs, labels, quality.Settings(epochs=1))
    out = quality.score(odd_docs, net)
    rows = out.collect()
    assert len(rows) == odd_docs.count() and sorted(out.columns) == sorted(odd_docs.columns)
    assert all(0 <= r.score <= 1 for r in rows)
    assert quality.score(no_docs, net).collect() == []
    nothing = quality.train(no_docs, labels.limit(0))
    assert [round(r.score, 6) for r in quality.score(odd_docs.limit(2), nothing).collect()] == [0.5, 0.5]


def test_held_out_accuracy(spark):
    scored = queries_quality.op4_quality_scores(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    held = scored[scored.held_out].merge(labels, on="doc_id")
    good, bad = held[held.quality == 1].score, held[held.quality == 0].score
    auc = np.mean([(g > bad).mean() + (g == bad).mean() / 2 for g in good])
    assert auc > 0.9 and (good >= queries_quality.ACCEPT).mean() > 0.97


def brute_tiles(item, text, least):
    """Greedy string tiling as it is defined: again and again the longest unmarked match, the earliest of equals."""
    used_i, used_t, out = set(), set(), []
    while True:
        best = None
        for i in range(len(item)):
            for t in range(len(text)):
                n = 0
                while i + n < len(item) and t + n < len(text) and item[i + n] == text[t + n] and i + n not in used_i and t + n not in used_t:
                    n += 1
                if n >= least and (best is None or n > best[0]):
                    best = (n, i, t)
        if best is None:
            return out
        n, i, t = best
        used_i.update(range(i, i + n))
        used_t.update(range(t, t + n))
        out.append(n)


def test_tiles_cover_as_much_as_the_definition():
    rng = np.random.default_rng(5)
    for _ in range(60):
        item, text = rng.integers(1, 4, rng.integers(1, 25)).astype(np.uint32), rng.integers(1, 4, rng.integers(1, 40)).astype(np.uint32)
        got, want = decontaminate.tiles(item, text, 3), brute_tiles(item.tolist(), text.tolist(), 3)
        assert max(got, default=0) == max(want, default=0)
        assert all(n >= 3 for n in got) and sum(got) <= len(item)


def test_reordered_passages_are_found(spark, make_docs):
    w = PASSAGE.split()
    rows = [(1, f"x y {PASSAGE} z"), (2, " ".join(w[10:] + ["foo"] + w[:10])), (3, " ".join(w[:6])), (4, "nothing of it at all here"), (5, PASSAGE.upper()), (5, PASSAGE.upper()), (6, None), (7, ""), (None, PASSAGE)]
    docs = make_docs(rows)
    items = spark.createDataFrame([(10, PASSAGE), (10, PASSAGE), (11, ""), (12, None), (13, "nothing of it")], "item_id long, text string")
    want = [(None, 10, 20), (1, 10, 20), (2, 10, 20), (4, 13, 3), (5, 10, 20), (5, 10, 20)]
    for block in (decontaminate.BLOCK_BYTES, 10):  # one block of items, and several
        got = sorted(((r.doc_id, r.item_id, r.matched_words) for r in decontaminate.contaminated(docs, items, block_bytes=block).collect()), key=str)
        assert got == sorted(want, key=str)
        left = decontaminate.without_contaminated(docs, items, block_bytes=block)
        assert left.columns == docs.columns and sorted((r.doc_id for r in left.collect())) == [3, 6, 7]
    assert decontaminate.contaminated(docs.limit(0), items).collect() == [] and decontaminate.contaminated(docs, items.limit(0)).collect() == []


def test_parts_of_long_items_are_found(spark, make_docs):
    item = [f"w{i}" for i in range(1000)]
    docs = make_docs([(1, " ".join(["x", *item[300:800], "y"])), (2, " ".join(item[:50])), (3, " ".join(item[:49])), (4, " ".join(w for i in range(0, 900, 30) for w in [*item[i : i + 10], "z"]))])
    items = spark.createDataFrame([(10, " ".join(item))], "item_id long, text string")
    got = sorted((r.doc_id, r.tiles, r.matched_words, r.coverage) for r in decontaminate.contaminated(docs, items).collect())
    assert got == [(1, 1, 500, 0.5), (2, 1, 50, 0.05)]
    assert sorted(r.doc_id for r in decontaminate.without_contaminated(docs, items).collect()) == [3, 4]


def test_benchmark_query_equals_word_runs(spark):
    got = {(r.doc_id, r.item_id) for r in queries_quality.op9_benchmark_decontamination(spark, SF).collect()}
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    bodies = {d.doc_id: " " + " ".join(words(d.text)) + " " for d in docs}
    assert got == {(d, i.item_id) for d, b in bodies.items() for i in items if " " + " ".join(words(i.text)) + " " in b}


def test_licenses_in_odd_rows(make_docs, no_docs):
    mit = licenses.TEMPLATES[4][1]
    rows = [(1, f"foo {mit} bar"), (2, f"RELEASED under the MIT license! {PASSAGE}"), (3, PASSAGE), (4, None), (5, ""), (6, "Released under the"), (None, "Released under the MIT License.")]
    broken = mit.split()
    broken[-1] = "other"  # the last word: one shingle less
    rows += [(7, " ".join(broken)), (2, f"RELEASED under the MIT license! {PASSAGE}"), (8, ("filler " * 70_000) + mit)]
    got = sorted(((r.doc_id, r.license, r.first_word, r.last_word) for r in licenses.scan(make_docs(rows)).collect()), key=str)
    n = len(words(mit))
    want = [(1, "MIT", 1, n), (2, "MIT", 0, 4), (2, "MIT", 0, 4), (None, "MIT", 0, 4), (7, "MIT", 0, n - 2), (8, "MIT", 70_000, 70_000 + n - 1)]
    assert got == sorted(want, key=str)
    assert licenses.scan(no_docs).collect() == []
    with pytest.raises(ValueError):
        licenses.Library([("x", "too short")])


def test_license_query_equals_search(spark):
    got = {(r.doc_id, r.license) for r in queries_quality.op1_license_scan(spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    bodies = {d.doc_id: " " + " ".join(words(d.text)) + " " for d in docs}
    want = {(d, name) for d, b in bodies.items() for name, t in licenses.TEMPLATES if f" {' '.join(words(t))} " in b}
    assert got == want and want


WHOLE = [(path.stem, path.read_text()) for path in sorted(licenses.TEXTS.glob("*.txt"))]


def test_whole_licenses_with_edits_and_insertions(make_docs):
    rows, want = [], {}
    for i, (name, text) in enumerate(WHOLE):
        w = text.split()
        edited = ["changed" if n % 60 == 59 else x for n, x in enumerate(w)]
        for k, version in enumerate((w, edited, [*w[: len(w) // 2], "words", "put", "in", "between", *w[len(w) // 2 :]])):
            rows.append((10 * i + k, f"{PASSAGE} {' '.join(version)} {PASSAGE}"))
            want[10 * i + k] = {name}
    got = {}
    for r in licenses.scan(make_docs(rows)).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    assert got == want


def test_usual_notices(make_docs):
    gpl = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    texts = dict(licenses.HEADERS) | {
        "MIT": "Foo is licensed under the MIT license.", "BSD-2-Clause": "distributed under the BSD 2-Clause License", "ISC": "It is available under the terms of the ISC license",
        "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.", "CC-BY-SA-3.0": "published under CC BY-SA 3.0",
        "BSD-3-Clause": "SPDX-License-Identifier: BSD-3-Clause", "GPL-2.0": gpl + licenses.GNU.format(work="program", name="GNU General Public License", version="2").split("version.")[1],
    }
    names = list(texts)
    got = {(names[r.doc_id], r.license) for r in licenses.scan(make_docs([(i, f"{PASSAGE} {texts[n]} {PASSAGE}") for i, n in enumerate(names)])).collect()}
    assert got == {(n, n) for n in names}


def test_neighbouring_licenses_are_both_found(make_docs):
    texts = dict(WHOLE)
    pairs = [("MIT", "BSD-3-Clause"), ("BSD-3-Clause", "MIT"), ("GPL-3.0", "LGPL-3.0"), ("ISC", "Unlicense")]
    got = {(r.doc_id, r.license) for r in licenses.scan(make_docs([(i, texts[a] + texts[b]) for i, (a, b) in enumerate(pairs)])).collect()}
    assert got == {(i, n) for i, pair in enumerate(pairs) for n in pair}


ARTICLE = "<p>" + "A long sentence of the article, with words enough to read. " * 4 + "</p>"
PAGES = {
    "": "",
    "<p>only</p>": "only",
    f"<html><body><nav><ul><li><a href=/>Home</a><li><a>News</a></ul></nav><article><h1>Head  line</h1>{ARTICLE}<p>Short&nbsp;end &amp; more</p></article><footer>&copy; us</footer>":
        "Head line " + " ".join(ARTICLE[3:-4].split()) + " Short end & more",
    f"<div class='sidebar'>{ARTICLE}</div><div id=content>{ARTICLE}<script>var a = '<p>no</p>';</script><p>x<b>y</b>z<br>w<form><p>name <input></form></div><div class='comments'>{ARTICLE}</div>":
        " ".join(ARTICLE[3:-4].split()) + " xyz w",
    f"<header>Site</header><div class='cookie notice'>We use {ARTICLE}</div><main>{ARTICLE}<aside>{ARTICLE}</aside>{ARTICLE}</main>":
        " ".join([" ".join(ARTICLE[3:-4].split())] * 2),
    "<nav>menu only</nav>": "",
    "<p>broken <b>tags <p>and a &am": "broken tags and a &am",
}


@pytest.mark.parametrize("html", PAGES)
def test_main_text(html):
    assert main_text.main_text(html) == PAGES[html]


LONG = "A long sentence with words enough to read. " * 60
SHORT = [f"Short line {i}." for i in range(20)]
PARTS = {
    "section": "<section>{}</section>", "quote": "<blockquote>{}</blockquote>", "div": "<div>{}</div>", "list": "<ul><li>{}</li></ul>",
    "table": "<table><tbody><tr><td>{}</td></tr></tbody></table>", "nested": "<section><div><blockquote>{}</blockquote></div></section>",
}


@pytest.mark.parametrize("around", ["article", "main", "div", "body"])
@pytest.mark.parametrize("part", PARTS)
def test_main_text_keeps_lines_around_a_long_part(around, part):
    before, after = ("".join(f"<p>{t}</p>" for t in half) for half in (SHORT[:10], SHORT[10:]))
    html = f"<nav><a>Home</a></nav><{around}>{before}{PARTS[part].format(LONG)}{after}</{around}><footer>us</footer>"
    assert main_text.main_text(html) == " ".join([*SHORT[:10], LONG.strip(), *SHORT[10:]])


@pytest.mark.parametrize("around", ["article", "main", "div"])
def test_main_text_keeps_sibling_parts(around):
    one, two = ("".join(f"<p>{LONG[:430].strip()}</p>" for _ in range(n)) for n in (17, 3))
    html = f"<nav><a>Home</a></nav><{around}><h1>Head</h1><section>{one}</section><section>{two}</section></{around}><footer>us</footer>"
    assert main_text.main_text(html) == " ".join(["Head", *[LONG[:430].strip()] * 20])
    html = f"<body><div class='ad'>{LONG}</div><article>{one}</article><article>{two}</article><div>Teaser</div>"
    assert main_text.main_text(html) == " ".join([LONG[:430].strip()] * 20)


WRAPPERS = ["<div class='layout has-sidebar'>", "<div class='no-sidebar'>", "<div class='with-navigation'>", "<div id='search-content'>", "<form>", "<div class='search'>", "<div id='sidebar' hidden>"]


@pytest.mark.parametrize("inner", ["article", "main", "div"])
@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_main_text_in_marked_wrappers(wrapper, inner):
    close = f"</{wrapper[1:].split()[0].rstrip('>')}>"
    text = " ".join([*SHORT[:3], LONG.strip()])
    own = f"<{inner}>" + "".join(f"<p>{t}</p>" for t in [*SHORT[:3], LONG]) + f"</{inner}>"
    menu = "<nav><a>Home</a></nav><div class='sidebar'><p>Beside it all.</p></div>"
    assert main_text.main_text(f"{wrapper}{menu}{own}{close}<footer>us</footer>") == text
    # Comments stay out beside an article, also when they are longer and articles themselves.
    comments = f"<div class='comments'><p>{LONG}</p><article class='comment'><p>{LONG[:99]}</p></article></div><aside><article>{LONG[:99]}</article></aside>"
    if inner != "div":
        assert main_text.main_text(f"{wrapper}{menu}{own}{comments}{close}<footer>us</footer>") == text


@pytest.mark.parametrize("opened", ["<head><title>t</title><body>", "<head><title>t</title>", "<header>Site", "<nav><a>Home</a>"])
def test_main_text_after_unclosed_elements(opened):
    for inner in ("article", "main"):
        assert main_text.main_text(f"{opened}<{inner}><p>{LONG}</p></{inner}>") == LONG.strip()


def test_main_text_in_a_marked_part_of_an_article():
    assert main_text.main_text(f"<article><div class='banner share'><p>{LONG}</p></div><div class='share'>Share this</div></article>") == LONG.strip()


def test_main_text_of_odd_rows(spark):
    rows = [(1, "u", "<p>é</p>", "x"), (None, None, None, "y"), (1, "u", "<p>é</p>", "x"), (2, "u", "<p>" + "long " * 100_000, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = main_text.extract(pages)
    assert sorted(out.columns) == ["n_chars", "page_id", "text", "url"]
    assert sorted(((r.page_id, r.n_chars) for r in out.collect()), key=str) == [(1, 1), (1, 1), (2, 499_999), (None, 0)]
    assert main_text.extract(pages.limit(0)).collect() == []


def test_unclosed_elements_stay_linear():
    """Rows without end tags, deep unclosed elements and stray end tags: memory grows with the page only."""
    import tracemalloc

    cells = "<table>" + "".join(f"<tr><td>cell {i}<td>more words here {i}" for i in range(20_000)) + "</table>"
    deep = "<div>" * 20_000 + "deep text" + "</section></nav>" * 20_000
    for page, held in ((cells, "more words here 19999"), (deep, "deep text")):
        tracemalloc.start()
        text = main_text.main_text(f"<body>{page}</body>")
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert held in text and peak < 60_000_000
    assert main_text.main_text("<table><tr><td>a<td>b<tr><td>c</table>") == "a b c"


def test_repeated_words_make_few_pairs():
    """5,000 equal words against 200,000: the tiles are found without a pair for every two places."""
    import tracemalloc

    from tradeloom.llm import decontaminate as d

    item, text = np.ones(5_000, np.uint32), np.ones(200_000, np.uint32)
    tracemalloc.start()
    assert d.tiles(item, text, 5) == [5_000]
    text[::3_000] = 0
    assert d.tiles(item, text, 5) == [2_999, 2_001]
    assert tracemalloc.get_traced_memory()[1] < 300_000_000
    tracemalloc.stop()


def brute_tiles(item, text, least):
    """Greedy string tiling by the definition: the longest match of unmarked words first, then by its places."""
    free_i, free_t, out = [True] * len(item), [True] * len(text), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for t in range(len(text)):
                n = 0
                while i + n < len(item) and t + n < len(text) and free_i[i + n] and free_t[t + n] and item[i + n] == text[t + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, t)
        n, i, t = best
        if n < least:
            return out
        out.append(n)
        for x in range(n):
            free_i[i + x] = free_t[t + x] = False


def test_maximal_runs_equal_all_pairs():
    """The runs of equal words between any two places, found from their starts only."""
    from tradeloom.llm import decontaminate as d

    rng = np.random.default_rng(7)
    for _ in range(60):
        words_ = int(rng.integers(1, 4))
        item, text = (rng.integers(1, words_ + 1, rng.integers(1, 40)).astype(np.uint32) for _ in range(2))
        free_i, free_t = (rng.random(len(x)) < 0.9 for x in (item, text))
        k, top = int(rng.integers(1, 4)), max(len(item), len(text))
        want = []
        for i in range(len(item)):
            for t in range(len(text)):
                same = lambda a, b: 0 <= a < len(item) and 0 <= b < len(text) and free_i[a] and free_t[b] and item[a] == text[b]  # noqa: B023, E731
                n = 0
                while same(i + n, t + n):
                    n += 1
                if n >= k and not same(i - 1, t - 1):
                    want.append((n, i, t))
        got = d.maximal(item, text, d.RunningHash(item).windows(k, top), d.RunningHash(text).windows(k, top), free_i, free_t, k)
        assert sorted(got) == sorted(want)


def test_coverage_equals_tiling_by_the_definition():
    """Words covered, which decide, and not only the longest tile."""
    from tradeloom.llm import decontaminate as d

    rng = np.random.default_rng(8)
    for _ in range(25):
        base = rng.integers(1, 60, 45).astype(np.uint32)
        cut = np.split(base, np.sort(rng.integers(0, 45, 3)))
        rng.shuffle(order := list(range(len(cut))))
        text = np.concatenate([np.concatenate([cut[j], rng.integers(60, 70, 4)]) for j in order]).astype(np.uint32)
        want = brute_tiles(base.tolist(), text.tolist(), 5)
        got = d.tiles(base, text, 5)
        assert sum(got) == sum(want) and max(got, default=0) == max(want, default=0)


def test_fit_does_not_depend_on_partitions(spark):
    """Repeated ids with different texts, dealt over 1, 3 and 7 partitions, learn the same network."""
    rows = [(i % 60, f"{'good clean words' if i % 2 else 'zz qq xx junk'} {i} " * (3 + i % 5)) for i in range(160)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(90)], "doc_id long, quality int")
    small = quality.Settings(texts=40)
    scores = []
    for parts in (1, 3, 7):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        net = quality.train(docs, labels, small)
        scores.append(round(quality.score(spark.createDataFrame([(0, "good words of a text")], "doc_id long, text string"), net).first().score, 9))
    assert len(set(scores)) == 1


PARA = [f"Paragraph {i} of the article, which has many words to read in a long and quiet sentence. " * 3 for i in range(6)]
BESIDE = {
    "links": "<ul>" + "".join(f"<li><a href=/{i}>Another page {i}</a>" for i in range(6)) + "</ul>",
    "link block": "<div><h4>More</h4>" + "".join(f"<p><a href=/{i}>Another page {i}</a></p>" for i in range(6)) + "</div>",
    "notice": "<div class=gdpr-layer><p>We store things on your device.</p><p>Fine by you?</p></div>",
    "sign-up": "<div class=mc-embed><p>Get our letter</p><input type=email><p>No spam</p></div>",
    "thread": "<div id=disqus_thread><p>Bob</p><p>I liked it a lot.</p></div>",
    "alert": "<div class=alert>Sale ends today!</div>",
    "remarks": "<section class=user-feedback>" + "".join(f"<div><b>Ann {i}</b><p>I read it <i>twice</i> and liked it.</p></div>" for i in range(4)) + "</section>",
}
KEEPS = {
    "list": "<ul><li>Milk<li>Eggs<li>Two loaves</ul>", "short": "<div><p>Short.</p></div>", "tasks": "<ul><li><input type=checkbox>Done<li><input type=checkbox>To do</ul>",
    "quote": "<blockquote>Said <a>so</a>.</blockquote>", "two links": "<div><a>One source</a><a>Another</a></div>", "table": "<table><tr><td>a<td>1<tr><td>b<td>2</table>",
}


def article_with(part, around):
    text = "".join(f"<p>{p}</p>" for p in PARA)
    return f"<nav><a>Home</a></nav><{around}><h1>Head</h1>{text}{part}<p>Short end.</p></{around}><footer>us</footer>"


@pytest.mark.parametrize("around", ["article", "main", "div"])
@pytest.mark.parametrize("part", BESIDE)
def test_ratios_decide_about_unnamed_parts(part, around, monkeypatch):
    want = " ".join(["Head", *[p.strip() for p in PARA], "Short end."])
    html = article_with(BESIDE[part], around)
    assert main_text.main_text(html) == want
    # Without differences between the ratios the part stays, whatever it is called.
    monkeypatch.setattr(main_text, "smoothed", lambda ratios: np.ones(len(ratios)))
    assert len(main_text.main_text(html)) > len(want)


@pytest.mark.parametrize("around", ["article", "main", "div"])
@pytest.mark.parametrize("part", KEEPS)
def test_thin_parts_without_a_sign_stay(part, around):
    alone = main_text.main_text(f"<article>{KEEPS[part]}</article>")
    assert alone and main_text.main_text(article_with(KEEPS[part], around)) == " ".join(["Head", *[p.strip() for p in PARA], alone, "Short end."])


def test_hinted_parts_with_dense_text_stay():
    inner = f"<section class='on-consent'><p>{LONG}</p></section>"
    assert LONG.strip() in main_text.main_text(article_with(inner, "article"))


@pytest.mark.parametrize("tail", ["<div>&copy; 2024 Us</div>", "<div><p>All rights reserved.</p><p>Made here.</p></div>"])
def test_page_without_article_ends_with_its_text(tail):
    text = "".join(f"<p>{p}</p>" for p in PARA)
    html = f"<body><div><a>Home</a><a>News</a></div><div><h1>Head</h1>{text}</div>{tail}</body>"
    assert main_text.main_text(html) == " ".join(["Head", *[p.strip() for p in PARA]])
    html = f"<body><div><a>Home</a><a>News</a></div><div><div><h1>Head</h1></div><div>{text}</div></div>{tail}</body>"
    assert main_text.main_text(html) == " ".join(["Head", *[p.strip() for p in PARA]])
