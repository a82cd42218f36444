"""HTML extraction: block cutting, gradients, invented held-out pages, hand-written pages and awkward rows."""

import random

import numpy as np
import pytest

from lodestar.llm import html_extract as H


@pytest.fixture(scope="module")
def network():
    return H.trained()


@pytest.mark.parametrize(
    "page,want",
    [
        ("", []),
        ("plain &amp; simple", ["plain & simple"]),
        ("<p>a<b>b</b> c<br>d\n\te<p>f &lt;b&gt; &#233;&eacute&nbsp;x</p>tail", ["ab c d e", "f <b> éé x", "tail"]),
        ("<div>one<script>if (a<b) {'</p>'}</script> two<style>p{}</style></div><!-- <p>no</p> -->", ["one two"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("a < b and c > d", ["a < b and c > d"]),
        ("<p title='x>y' class=\"a>b\">t</p>", ["t"]),
        ("<title>not me</title><p>me", ["me"]),
        ("</div></p></b>x<p></i>y", ["x", "y"]),
        ("<p>open <a href='x", ["open <a href='x"]),
    ],
)
def test_blocks(page, want):
    assert [b.text for b in H.blocks(page)] == want


def test_paths_and_links():
    found = H.blocks('<article id="Main"><p>x <a>yy</a></p><div class="ad box">z</div></article>')
    assert found[0].path == ("t:article", "n:main", "t:p") and found[0].linked == 2
    assert found[1].path == ("t:article", "n:main", "t:div", "n:ad", "n:box")


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = H.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.standard_normal((3, 5, H.PATH_SIZE + H.WORD_SIZE + H.FIGURES))
    mask = (np.arange(5)[None] < np.array([5, 2, 4])[:, None]).astype(float)
    x *= mask[:, :, None]
    weights = rng.standard_normal((3, 5)) * mask
    _, kept = net.forward(x, mask, keep=True)
    grads, d_x = net.backward(weights, kept)
    loss = lambda: float((net.forward(x, mask) * weights).sum())
    for values, grad in [*((net.p[k], g) for k, g in grads.items()), (x, d_x)]:
        flat, g = values.reshape(-1), grad.reshape(-1)
        for i in rng.integers(0, len(flat), 4):
            if values is x and not mask.reshape(-1)[i // x.shape[2]]:
                continue
            was = flat[i]
            flat[i] = was + 1e-5
            up = loss()
            flat[i] = was - 1e-5
            down = loss()
            flat[i] = was
            assert abs((up - down) / 2e-5 - g[i]) < 1e-5


def test_held_out_pages(network):
    rng, right, total = random.Random(12345), 0, 0
    for _ in range(100):
        page, truth = H.made_page(rng)
        (found,) = H.labels(network, [H.blocks(page)])
        right += sum(a == m for a, (_, m) in zip(found.tolist(), truth, strict=True))
        total += len(truth)
    assert right / total > 0.985


PAGE = """<html><head><title>T</title><script>x()</script></head><body><header><h2>Site</h2></header>
<nav><ul><li><a href="/">Home</a></li><li><a href="/b">Blog</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
<article><h1>The  title</h1><p>First &amp; only.</p><div class="ad">Buy this now.</div><p>Second
paragraph goes on for a while, with some more words in it.<br><p>Third one ends it all, at last.</p></article>
<section class="comments"><h3>Comments</h3><div class="comment"><p>Nice text, I liked it.</p></div></section>
<aside class="sidebar"><h3>More</h3><ul><li><a href="/c">Other</a></li></ul></aside>
<form class="newsletter"><label>Mail</label><input></form><footer>&copy; Site</footer></body></html>"""


def test_a_page_with_every_kind_of_part(network):
    want = "The title\nFirst & only.\nSecond paragraph goes on for a while, with some more words in it.\nThird one ends it all, at last."
    assert H.main_text(network, [PAGE]) == [want]


def test_batches_do_not_change_labels(network):
    rng = random.Random(5)
    pages = [H.made_page(rng)[0] for _ in range(30)] + ["", PAGE]
    assert H.main_text(network, pages) == [H.main_text(network, [p])[0] for p in pages]


def test_awkward_rows(spark, network):
    long = "<article><h1>T</h1>" + "<p>Word word word word.</p>" * 5000 + "</article>"
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (None, "v", "", "x"), (3, "w", long, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, H.extracted(df, network).collect()), key=lambda r: (r[0] or 0, r[1] or ""))
    assert [r[0] for r in got] == [None, 1, 1, 2, 3] and all(r[3] == len(r[2]) for r in got)
    assert got[1] == got[2] and got[0][2] == got[3][2] == "" and got[4][2].count("\n") > 4900
    assert H.extracted(df.limit(0), network).collect() == []


@pytest.mark.parametrize(
    "middle",
    ['<svg width="1"/>', "<svg />", "<svg><path/></svg>", "<object data='x'>", "<button>", "<select>", "<iframe src='x'>"]
    + ["<button>Send</button>", "<select><option>x</select>", "<noscript>"],
)
def test_text_after_unclosed_elements_stays(middle):
    page = f"<article><p>a</p>{middle}<p>b</p></article>"
    assert [b.text for b in H.blocks(page)] == ["a", "b"]
    assert [b.text for b in H.blocks(f"{page}<button>Send</button><p>c</p>")] == ["a", "b", "c"]


def test_raw_text_runs_to_the_end():
    for name in ("script", "style", "textarea", "title"):
        assert [b.text for b in H.blocks(f"<p>a</p><{name}>x<p>b</p>")] == ["a"]


@pytest.mark.parametrize(
    "page,n_blocks",
    [
        ("<b>" * 100_000 + "</i>" * 100_000 + "x", 1),
        ("<b>" * 60_000 + "<div>" * 60_000 + "x", 1),
        ("<div class='k'>x" * 60_000, 60_000),
        ("<svg>" * 150_000 + "x", 1),
        ("<li>x" * 100_000, 100_000),
        ("<a " * 200_000, 1),
        ("<ul><li>" * 60_000 + "x" + "</p>" * 60_000, 1),
        ("".join(f"<div class='c{chr(97 + i % 26) * (i // 26 % 60 + 1)}'>y" for i in range(20_000)), 20_000),
    ],
    ids=["inline", "blocks", "nested", "svg", "items", "open", "lists", "names"],
)
def test_time_grows_with_the_page_alone(network, page, n_blocks):
    import time

    started = time.process_time()
    assert len(H.blocks(page)) == n_blocks
    cut = time.process_time() - started
    H.main_text(network, [page])
    assert cut < 2 and time.process_time() - started < 12


def test_both_directions_in_step_give_what_each_gives(network):
    """The fast pass against the one that training uses, and that against a plain loop over blocks."""
    rng = random.Random(12)
    cut = [H.blocks(H.made_page(rng)[0]) for _ in range(7)] + [[]]
    x = H.Leaves(cut)
    rows, mask, _ = H._laid_out(x, np.arange(len(cut)))
    values, _ = network.inputs(x, rows)
    dense = np.zeros((*mask.shape, values.shape[1]), np.float32)
    dense[mask] = values
    slow = network.forward(dense, mask.astype(np.float32))
    assert np.abs(slow - network.logits(dense, mask))[mask].max() < 1e-4

    p, h = {k: v.astype(float) for k, v in network.p.items()}, H.HIDDEN
    sig = lambda z: 1 / (1 + np.exp(-z))
    for i, page in enumerate(cut[:3]):
        vectors = []
        for b in page:
            path = [H._name_buckets((n,))[0] for n in b.path] or [0]
            words = [w for w in b.text.split()]
            ids = [int(H.word_hashes(*H.word_bytes(H.pa.array([w], H.pa.large_string())))[0]) % H.WORD_BUCKETS for w in words]
            own = x.figures[sum(map(len, cut[:i])) + len(vectors)]
            vectors.append(np.concatenate([p["P"][path].mean(0), p["M"][ids].mean(0), own]))
        total = np.full(len(page), p["b"][0])
        for k, order in (("f", range(len(page))), ("b", range(len(page) - 1, -1, -1))):
            s, c = np.zeros(h), np.zeros(h)
            for t in order:
                z = vectors[t] @ p[f"W{k}"] + s @ p[f"U{k}"] + p[f"c{k}"]
                c = sig(z[h : 2 * h]) * c + sig(z[:h]) * np.tanh(z[3 * h :])
                s = sig(z[2 * h : 3 * h]) * np.tanh(c)
                total[t] += s @ p["o"][(0 if k == "f" else h) : (h if k == "f" else 2 * h)]
        assert np.abs(total - slow[i, : len(page)]).max() < 1e-3
