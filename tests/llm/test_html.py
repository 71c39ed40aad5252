import numpy as np
import pytest

from tributary.llm import html


@pytest.fixture(scope="module")
def pages(spark, sf):
    return [r.html for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/pages.parquet").orderBy("page_id").collect()]


def test_blocks():
    page = '<title>no</title><script>var t="</p>";</script><nav><ul><li><a href=x>One</a><li>Two</ul></nav><!-- c --><p>a <b>b<br>c<p>d &amp; e</div><x y="1>2">f<'
    got = html.blocks(page)
    assert [b.text for b in got] == ["One", "Two", "a b\nc", "d & e", "f<"]
    assert [t for t, _ in got[1].path] == ["nav", "ul", "li"] and got[0].linked == 3 and got[1].linked == 0
    assert [t for t, _ in got[3].path] == ["p"]
    for odd in ("", "<", "<<<>>>", "<p", "</p></p>", "plain", "<a <b>", '<p class="x', "<!--", "<script>x", "&#xZZ; &bogus;", "\0" * 50, "<p>" * 3000):
        html.blocks(odd)


def test_no_tag_takes_the_rest_of_the_page():
    for odd in ('<svg-icon name="x"></svg-icon>', "<title-bar>", "<template-x>", "<svg viewBox='0 0 1 1'/>", "<svg/>", "<noscript>", "<object data=x>", "<template>", "<svg>"):
        assert [b.text for b in html.blocks(f"{odd}<article><p>rest</p></article>")] == ["rest"], odd
    for hidden in ("<svg><text>no</text></svg>", "<noscript>no</noscript>", "<object data=x>no</object>", "<template>no</template>", "<script>no", "<style>no"):
        assert [b.text for b in html.blocks(f"<p>a</p>{hidden}")] == ["a"], hidden
    assert [b.text for b in html.blocks("<p>a <svg/> b</p>")] == ["a b"]


def test_labels():
    labels = {b.text: html.markup_label(b) for b in html.blocks('<article><p>a<aside>b</aside></article><div class="ad top">c</div><div class="shadow">d</div><main>e</main>')}
    assert labels == {"a": 1, "b": 0, "c": 0, "d": -1, "e": 1}


def test_gradients(pages):
    """Back-propagation against differences."""
    rng = np.random.default_rng(0)
    x, mask = rng.standard_normal((5, 3, html.INPUT)).astype(np.float32), np.ones((5, 3), bool)
    mask[3:, 1] = False
    w, c = html.initial()["wf"], html.initial()["cf"]
    d = rng.standard_normal((5, 3, html.HIDDEN)).astype(np.float32)
    kept = []
    html._read(w, c, x, mask, kept)
    dw, dc = html._back(w, x, mask, kept, d)
    w, c, x, d = (v.astype(np.float64) for v in (w, c, x, d))
    for i, j in ((0, 0), (html.INPUT + 3, 5), (10, 30), (html.INPUT, 80)):
        up, down = w.copy(), w.copy()
        up[i, j] += 1e-3
        down[i, j] -= 1e-3
        want = ((html._read(up, c, x, mask, None) - html._read(down, c, x, mask, None)) * d).sum() / 2e-3
        assert abs(want - dw[i, j]) < 1e-2 * max(1, abs(want))
    assert np.isfinite(dc).all()


def test_held_out_accuracy(pages):
    found = [html.blocks(p) for p in pages]
    weights = html.train(found[:150])
    right = {False: [], True: []}
    for hidden in right:
        for p, blocks in zip(html.scores(weights, [html.vectors(b, hidden) for b in found[150:]]), found[150:], strict=True):
            right[hidden] += ((p > 0.5) == np.array([html.markup_label(b) for b in blocks])).tolist()
    assert np.mean(right[False]) > 0.97 and np.mean(right[True]) > 0.9


def test_scores_do_not_depend_on_company(pages):
    found = [html.vectors(html.blocks(p)) for p in pages[:40]]
    weights = html.initial()
    together = html.scores(weights, [*found, np.zeros((0, html.INPUT), np.float32)])
    assert len(together[-1]) == 0
    for x, p in zip(found, together, strict=False):
        assert np.allclose(html.scores(weights, [x])[0], p, atol=1e-4)


def test_extract(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    out = {r.page_id: r for r in html.extract(pages).collect()}
    assert len(out) == pages.count()
    for r in pages.collect():
        want = "\n".join(b.text for b in html.blocks(r.html) if html.markup_label(b) == 1)
        assert out[r.page_id].text == want
    odd = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (2, "", "x"), (None, "<p>a", "x"), (3, "<p>" + "long " * 50_000, "x"), (4, "<li>" * 3000 + "x", "y")], "page_id bigint, html string, text string")
    got = sorted(str((r.page_id, r.text and r.text[:5], r.n_blocks, r.n_content)) for r in html.extract(odd).collect())
    assert got == sorted(map(str, [(1, None, None, None), (1, None, None, None), (2, "", 0, 0), (None, "a", 1, 1), (3, "long ", 1, 1), (4, "x", 1, 1)]))
    assert html.extract(odd.limit(0)).count() == 0


def test_markup_takes_time_in_proportion():
    """A megabyte of tags without an end, quotes without an end, and open tags."""
    import time

    odd = {
        "<a ": "<a " * 333_000, "quotes": '<a "x' * 200_000, "<div>": "<div>x" * 170_000, "skipped": "<noscript>" * 100_000, "one >": '<svg "' * 160_000 + ">", "end tags": "<div>" * 100_000 + "</p></x>" * 60_000,
        "items": "<ul>" + "<div>" * 80_000 + "<li></li>" * 80_000, "comments": "<!--" * 250_000, "ends": "</" * 500_000, "mixed quotes": "<a '" * 100_000 + '"' + '<b "' * 100_000,
    }
    for name, page in odd.items():
        began = time.process_time()
        found = html.blocks(page)
        [html.markup_label(b) for b in found]
        assert time.process_time() - began < 4, name
        assert len(found) == {"<div>": 170_000, "<a ": 1, "quotes": 1, "mixed quotes": 1, "ends": 1}.get(name, 0), name
    assert html.blocks("&#" + "9" * 5000 + "; &#" + "0" * 5000 + "65;")[0].text == "� A"


def test_network_by_force(pages):
    """Every block's probability worked out one block, one gate and one number at a time."""
    import math

    def sigmoid(x):
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))

    def states(w, c, rows):
        n = html.HIDDEN
        h, cell, out = [0.0] * n, [0.0] * n, []
        w, c = w.tolist(), c.tolist()
        for row in rows:
            fed = [(i, v) for i, v in enumerate([*row, *h]) if v]
            gates = [c[j] + sum(v * w[i][j] for i, v in fed) for j in range(4 * n)]
            cell = [sigmoid(gates[n + j]) * cell[j] + sigmoid(gates[j]) * math.tanh(gates[3 * n + j]) for j in range(n)]
            h = [sigmoid(gates[2 * n + j]) * math.tanh(cell[j]) for j in range(n)]
            out.append(h)
        return out

    found = [html.blocks(p) for p in pages[:60]]
    weights = html.train(found[:40])
    some = sorted((html.vectors(b) for b in found if b), key=len)[:: max(1, len(found) // 5)]
    for x, got in zip(some, html.scores(weights, some), strict=True):
        forth, back = states(weights["wf"], weights["cf"], x.tolist()), states(weights["wb"], weights["cb"], x[::-1].tolist())[::-1]
        v, o = weights["v"].tolist(), float(weights["o"][0])
        want = [sigmoid(o + sum(a * b for a, b in zip([*f, *b_], v, strict=True))) for f, b_ in zip(forth, back, strict=True)]
        assert np.allclose(got, want, atol=1e-4)
