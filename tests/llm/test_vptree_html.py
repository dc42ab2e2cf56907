import random

import numpy as np
import pytest

from lodestone.llm import html_text, vptree


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 0.5, "clash") for i, v in rows], "vec_id long, embedding array<float>, label int, score double, shard string")


def brute(rows, width, k=10):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and len(v) == width and None not in v and np.isfinite(np.array(v, np.float32)).all() and any(v)]
    out = {}
    for q, x in good:
        if q % 100 == 0:
            found = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in good if i != q)[:k]
            out[q] = [(r + 1, i, d) for r, (d, i) in enumerate(found)]
    return out


def found_of(result):
    out = {}
    for r in result.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


@pytest.mark.parametrize("shard_rows", [60, 8192])
def test_factor_one_is_exact(spark, shard_rows):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).round(1).tolist()) for i in range(700)]
    rows += [(i, [1.0] * 8) for i in range(700, 1000)]  # a very common vector
    rows += [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [None, *[1.0] * 7]), (2004, [float("inf")] * 8), (2100, [1.0] * 3), (None, [1.0] * 8)]
    got = found_of(vptree.nearest(frame(spark, rows), vptree.F.col("vec_id") % 100 == 0, factor=1.0, shard_rows=shard_rows))
    want = brute(rows, 8)
    assert set(got) == set(want)
    for q in want:
        assert [(r, i) for r, i, _ in got[q]] == [(r, i) for r, i, _ in want[q]], q
        assert [d for *_, d in got[q]] == pytest.approx([d for *_, d in want[q]], rel=1e-12, abs=1e-12)


def test_production_factor_has_recall(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 32))
    rows = [(i, (centres[rng.integers(12)] + rng.normal(size=32) * 0.4).tolist()) for i in range(3000)]
    got, want = found_of(vptree.nearest_query(frame(spark, rows))), brute(rows, 32)
    hits = sum(len({i for _, i, _ in got[q]} & {i for _, i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_wide_and_equidistant_vectors(spark):
    rows = [(i, [1.0 if j == i else 0.0 for j in range(1500)]) for i in range(1500)]
    got = found_of(vptree.nearest(frame(spark, rows), vptree.F.col("vec_id") % 500 == 0, factor=1.0))
    assert set(got) == {0, 500, 1000}
    for q, found in got.items():
        assert [i for _, i, _ in found] == [i for i in range(12) if i != q][:10] and {round(d, 12) for *_, d in found} == {round(2**0.5, 12)}


def test_the_tree_prunes_where_vectors_cluster():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16)) * 4
    vectors = centres[rng.integers(40, size=6000)] + rng.normal(size=(6000, 16)) * 0.2
    tree = vptree.build(np.arange(6000), vectors, 11)
    assert max(e - b for b, e, at in zip(tree.begin, tree.end, tree.left) if at < 0) <= vptree.LEAF
    exact, who, entered = vptree.search(tree, vectors[:100], 11, 1.0)
    assert entered.mean() < 0.3 * 6000
    truth = np.sort(vptree.distances(vectors[:100], vectors), axis=1)[:, :11]
    assert np.allclose(exact, truth, rtol=1e-12)
    relaxed, _, fewer = vptree.search(tree, vectors[:100], 11, vptree.calibrated(tree, 11))
    assert fewer.mean() <= entered.mean() and (relaxed <= truth[:, 10:] + 1e-9).mean() >= 0.9


def test_few_rows(spark):
    assert found_of(vptree.nearest_query(frame(spark, []))) == {}
    assert found_of(vptree.nearest_query(frame(spark, [(0, [1.0, 2.0])]))) == {}
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, 2.0])]
    assert found_of(vptree.nearest_query(frame(spark, rows))) == {0: [(1, 1, 0.0), (2, 2, 2.0)]}


def test_cut_against_all_labellings():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(1, 8)
        gain = [rng.choice([-3, -1, -0.5, 0.5, 1, 2, 4]) * rng.random() for _ in range(n)]
        edges = [(i, i + 1, rng.random()) for i in range(n - 1)] + [(i, i + 2, rng.random()) for i in range(n - 2)]

        def price(labels):
            return sum(abs(g) for g, x in zip(gain, labels) if (g > 0) != x) + sum(w for a, b, w in edges if labels[a] != labels[b])

        best = min(price([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert price(html_text.source_side(gain, edges)) == pytest.approx(best)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>
<header class="site-header"><a href="/">Home</a> <a href="/b">Blog</a></header><nav><ul><li><a href="/x">x</a></li></ul></nav>
<!-- <p>hidden</p> --><div class="ad">Buy this now. It is cheap. Really.</div><div class="cookie-notice"><p>We use cookies. Do you agree to that?</p></div>
<article><h1>A &amp; B</h1><p><b>First&nbsp;words</b>here.<br>Next   line
goes on.<p>Second para <a href="/l">with link</a>.<aside>Read also this one.</aside><form><input name=q><label>Search</label></form><p>&lt;tag&gt; Short.</article>
<section id="comments"><h2>Comments</h2><div class="comment"><p>Great article, thanks. I liked it very much. Will read again.</p></div></section>
<div class="sidebar"><p>Other stories that may be of interest. Many of them.</p></div><footer>&copy; 2020 Site. All rights reserved."""


def test_pages(spark):
    want = "A & B First wordshere. Next line goes on. Second para with link. <tag> Short."
    assert html_text.main_text(PAGE) == want
    rows = [(1, "u", PAGE, "clash"), (1, "u", PAGE, "clash"), (2, None, None, ""), (3, "v", "", ""), (None, "w", "<p>", ""), (4, "x", "<div>" * 3000 + "Some words stand here. They are text." + "<b" * 10, ""), (5, "y", "<article><p>" + "Long text here. " * 50_000, "")]
    got = {(r.page_id, r.url, r.text, r.n_chars) for r in html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert (1, "u", want, len(want)) in got and {(2, None, "", 0), (3, "v", "", 0), (None, "w", "", 0)} <= got
    assert {n for i, _, _, n in got if i == 5} == {50_000 * 16 - 1}
    assert html_text.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


ARTICLE = "<article><p>First words stand here. They are text.</p>%s<p>Second words follow here. They are text too.</p></article>"
AROUND = ["First words stand here. They are text.", "Second words follow here. They are text too."]


@pytest.mark.parametrize(
    "odd, inside",
    [
        ('<svg class="i"/>', ""), ("<object>", ""), ("<video controls>", ""), ("<select>", ""), ("<iframe src=x>", ""), ("<svg><text>no</text></svg>", ""), ("<noscript>no</noscript>", ""),
        ("<object><object>no</object>nor this</object>", ""), ("<p>Let <math><mi>x</mi></math> be a number here.</p>", "Let x be a number here."), ("<script>var a = '<p>no</p>';</script>", ""),
        ("<p data-x=don't>An odd value stands here. It is text.</p>", "An odd value stands here. It is text."), ('<p class="x>An open quote stands here. It is text.</p>', "An open quote stands here. It is text."),
        ('<div class="alert-story"><p>A story about an alert. It is text.</p></div>', "A story about an alert. It is text."), ("<!-- <p>no</p> -->", ""), ("<p>a < b and c > d hold here. So it is.</p>", "a < b and c > d hold here. So it is."),
        ("<p>" + "Long line without any stop " * 30 + "ends here. It does. It does.</p>", "Long line without any stop " * 30 + "ends here. It does. It does."), ("<aside><p>Read this too. It is fine.</p></aside>", ""),
    ],
)
def test_odd_markup(odd, inside):
    assert html_text.main_text(ARTICLE % odd) == " ".join([AROUND[0], *([inside] if inside else []), AROUND[1]])


@pytest.mark.parametrize("bad", ["<a ", '<a b="', "<!--", "<object>", "<a b='x' ", "<a b=\"<a b='", "<script>", "<svg></svg", '<p class="a>', "<div>", "</p><div>", "<b", "&amp"])
def test_broken_tags_take_linear_time(bad):
    import time

    start = time.process_time()
    html_text.main_text(bad * (1_000_000 // len(bad)))
    assert time.process_time() - start < 8


def test_generated_pages_against_the_planted_text():
    """The text that a page was made from is the answer; boilerplate of every kind the contract names stands around and within it."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 9)))
    sentence = lambda: " ".join([word().title(), *(word() for _ in range(rng.randint(4, 14)))]) + rng.choice([". ", "! ", "? "])
    text = lambda: "".join(sentence() for _ in range(rng.randint(1, 6))).strip()
    escaped = lambda t: t.replace("a", "&#97;", 1).replace("e", "&#x65;", 1)
    wrong = 0
    for _ in range(400):
        paragraphs = [text() for _ in range(rng.randint(2, 9))]
        away = [
            lambda: f"<nav><ul>{''.join(f'<li><a href=/{word()}>{word()}</a></li>' for _ in range(5))}</ul></nav>", lambda: f'<div class="ad">{text()}</div>', lambda: f'<div id="sidebar"><p>{text()}</p></div>',
            lambda: f'<div class="cookie-notice">{text()}</div>', lambda: f"<form><p>{text()}</p><input name=q></form>", lambda: f"<script>{text()}</script>", lambda: f"<style>{word()}{{}}</style>", lambda: f"<!-- {text()} -->",
        ]
        noise = lambda: rng.choice(away)() if rng.random() < 0.5 else ""  # noqa: B023, E731
        inner = "".join(f"<p>{escaped(p).replace(' ', rng.choice([' ', '  ', chr(10)]), 1)}{rng.choice(['</p>', '</p>', ''])}{noise()}" for p in paragraphs)
        comments = f'<section class="comments">{"".join(f"<div class=comment><p>{text()}</p></div>" for _ in range(3))}</section>'
        page = f"<html><head><title>{text()}</title></head><body><header>{text()}</header>{noise()}{noise()}<article><h1>{escaped(paragraphs[0])}</h1>{inner}</article>{comments}{noise()}<footer>{text()}</footer></body></html>"
        wrong += html_text.main_text(page) != " ".join([paragraphs[0], *paragraphs])
    assert wrong == 0
