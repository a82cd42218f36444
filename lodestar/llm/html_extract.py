"""Main text of HTML pages by a recurrent block labeller, in numpy.

A page is cut into blocks, the leaf sequence of its block elements: character references decoded, white space turned into
one space, trimmed, empty ones left out. Each block has hashed vectors for the tags, classes, ids and roles on its path
and for its words, and a few figures. A bidirectional LSTM reads the whole sequence, however long, and labels every block
as main text or not. Main blocks are joined by a line feed.

The network is trained on the driver on ``TRAINING_PAGES`` pages that ``made_page`` invents: articles among menus,
headers, footers, sidebars, notices, adverts, forms and reader comments, in many layouts. The seed is fixed, so it is the
same for any data. Scripts, styles and form controls never are blocks. Missing and crossed end tags are mended. Time and
memory grow with a page's length, however deep its tags are nested: a path is the number of names in each bucket.

Null and empty pages give an empty text; so do pages without main blocks. Repeated rows give equal rows, null ids are
carried along, other columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from bisect import bisect
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .segments import gathered, slices
from .words import Adam, coded_words, run_sums, sigmoid, word_bytes, word_hashes

_ATTRIBUTES = r"""(?:"[^"]*"|'[^']*'|[^>"']++)*+"""
#: Skipped with their content; only raw text runs to the page's end where its end tag is missing. The last ones can't hold
#: their own kind. Where their end tag is missing they are tags like any other.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>script|style|textarea|title)\b{_ATTRIBUTES}>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<svg\b{_ATTRIBUTES}(?<=/)>"
    rf"|<(?P<flat>button|select|iframe|noscript)\b{_ATTRIBUTES}>(?:(?!<(?P=flat)\b).)*?</(?P=flat)\s*>"
    rf"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>{_ATTRIBUTES}|[^>]*)>"
    r"|<[!?/][^>]*>",
    re.S | re.I,
)
#: Skipped up to their first end tag, if there is one.
_DEEP = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("svg", "object", "template")}
_DIGIT = re.compile(r"\d")
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_NAME = re.compile(r"[a-z]+")

# Elements by kind (fixed values of HTML).
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td "
    "tfoot th thead tr ul label option".split()
)
#: An element of these kinds ends an open one of the same group.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}}
SCOPE = set("ul ol menu dl table article section div main nav aside form".split())

PATH_BUCKETS, WORD_BUCKETS = 1024, 2048
PATH_SIZE, WORD_SIZE, FIGURES = 16, 6, 5
HIDDEN = 16
TRAINING_PAGES = 1600


class Block:
    """Text of a leaf, its open elements, the buckets of their names, and how many of its characters are link text."""

    __slots__ = ("text", "node", "buckets", "linked")

    def __init__(self, text: str, node: tuple | None, buckets: dict[int, int], linked: int):
        self.text, self.node, self.buckets, self.linked = text, node, buckets, linked

    @property
    def path(self) -> tuple[str, ...]:
        """The names on its path, outermost first."""
        found, node = [], self.node
        while node:
            found.append(node[0])
            node = node[1]
        return tuple(n for names in reversed(found) for n in names)


@lru_cache(100_000)
def _names(tag: str, attributes: str) -> tuple[str, ...]:
    found = ["t:" + tag]
    for value in _NAMED.findall(attributes):
        found += ["n:" + n for n in _NAME.findall(value.lower())]
    return tuple(found)


class _Open:
    """The open elements of a page. ``where`` and the lists of depths answer without looking through the stack."""

    def __init__(self):
        self.stack: list[str] = []
        self.where: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.scopes: list[int] = []
        #: Names of each open block element and what holds it, innermost last.
        self.nodes: list[tuple[tuple[str, ...], tuple | None]] = []
        self.counts: dict[int, int] = {}
        self._buckets: dict[int, int] | None = None

    def push(self, name: str, rest: str) -> None:
        depth = len(self.stack)
        self.stack.append(name)
        self.where.setdefault(name, []).append(depth)
        if name in SCOPE:
            self.scopes.append(depth)
        if name in BLOCK:
            self.blocks.append(depth)
            names = _names(name, rest)
            self.nodes.append((names, self.nodes[-1] if self.nodes else None))
            for b in _name_buckets(names):
                self.counts[b] = self.counts.get(b, 0) + 1
            self._buckets = None

    def cut(self, depth: int) -> None:
        """Close the element at ``depth`` and all inside it."""
        while len(self.stack) > depth:
            name = self.stack.pop()
            self.where[name].pop()
            if name in SCOPE:
                self.scopes.pop()
            if name in BLOCK:
                self.blocks.pop()
                for b in _name_buckets(self.nodes.pop()[0]):
                    self.counts[b] -= 1
                    if not self.counts[b]:
                        del self.counts[b]
                self._buckets = None

    def buckets(self) -> dict[int, int]:
        if self._buckets is None:
            self._buckets = dict(self.counts) or {0: 1}
        return self._buckets

    def linked(self) -> bool:
        return bool(self.where.get("a"))


def blocks(page: str) -> list[Block]:
    """The leaf sequence of a page."""
    out: list[Block] = []
    parts: list[str] = []
    linked = 0
    now = _Open()
    unclosed: set[str] = set()

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, now.nodes[-1] if now.nodes else None, now.buckets(), linked))
            parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        raw = html.unescape(raw) if "&" in raw else raw
        parts.append(raw)
        if now.linked():
            linked += len(raw)

    def closed(name: str) -> None:
        block = name in BLOCK
        if block:
            flush()
        at = now.where.get(name)
        # An end tag of another kind doesn't reach beyond the block that it stands in.
        if at and (block or not now.blocks or at[-1] > now.blocks[-1]):
            now.cut(at[-1])

    def opened(name: str, rest: str) -> None:
        if name in BLOCK:
            flush()
            if now.blocks and now.stack[now.blocks[-1]] == "p":
                now.cut(now.blocks[-1])
            scope = now.scopes[-1] if now.scopes else -1
            inside = [at[i] for n in CLOSES.get(name, ()) if (at := now.where.get(n)) and (i := bisect(at, scope)) < len(at)]
            if inside:
                now.cut(min(inside))
        if name not in VOID:
            now.push(name, rest)

    # No tag ends behind the last bracket, so none is looked for there.
    at, stop = 0, page.rfind(">") + 1
    while at < stop and (m := _TOKEN.search(page, at, stop)):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if m["end"]:
            closed(name)
            continue
        if name in _DEEP and name not in unclosed:
            end = _DEEP[name].search(page, at, stop)
            if end:
                at = end.end()
                continue
            unclosed.add(name)
        if name == "br":
            parts.append(" ")
            continue
        opened(name, m["rest"])
    if at < len(page):
        say(page[at:])
    flush()
    return out


@lru_cache(100_000)
def _name_buckets(names: tuple[str, ...]) -> tuple[int, ...]:
    return tuple(zlib.crc32(n.encode()) % PATH_BUCKETS for n in names)


class Leaves:
    """Hashed inputs of the blocks of many pages."""

    def __init__(self, pages: list[list[Block]]):
        flat = [b for page in pages for b in page]
        self.of_page = np.concatenate([[0], np.cumsum([len(p) for p in pages])]).astype(np.int64)
        #: Buckets of names, how often each is on the path, and where each block's begin and end.
        self.path = np.array([b for x in flat for b in x.buckets], np.int64)
        self.path_times = np.array([n for x in flat for n in x.buckets.values()], np.float32)
        self.path_bounds = np.concatenate([[0], np.cumsum([len(b.buckets) for b in flat])]).astype(np.int64)
        words, at, self.word_bounds = coded_words(pa.array([b.text for b in flat], pa.large_string()))
        self.word = (word_hashes(*word_bytes(words)) % np.uint64(WORD_BUCKETS)).astype(np.int64)[at]
        length = np.array([len(b.text) for b in flat], np.float32)
        n = np.maximum(np.diff(self.word_bounds), 1).astype(np.float32) if flat else length
        ends = np.array([b.text[-1] in ".!?…" for b in flat], np.float32)
        self.figures = np.stack(
            [
                np.log1p(length) / 5,
                np.array([min(b.linked, len(b.text)) for b in flat], np.float32) / np.maximum(length, 1),
                ends,
                np.log1p(n) / 4,
                np.array([_DIGIT.search(b.text) is not None for b in flat], np.float32),
            ],
            axis=1,
        ) if flat else np.zeros((0, FIGURES), np.float32)


class Network:
    """Embeddings, an LSTM in each direction, and a logistic layer on both states."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        small = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        d, h = PATH_SIZE + WORD_SIZE + FIGURES, HIDDEN
        self.p = {
            "P": (0.3 * rng.standard_normal((PATH_BUCKETS, PATH_SIZE))).astype(np.float32),
            "M": (0.1 * rng.standard_normal((WORD_BUCKETS, WORD_SIZE))).astype(np.float32),
            "o": small(2 * h),
            "b": np.zeros(1, np.float32),
        }
        for k in "fb":
            self.p |= {f"W{k}": small(d, 4 * h), f"U{k}": small(h, 4 * h), f"c{k}": np.zeros(4 * h, np.float32)}
            self.p[f"c{k}"][h : 2 * h] = 1  # remember by default

    def inputs(self, x: Leaves, rows: np.ndarray) -> tuple[np.ndarray, dict[str, tuple]]:
        """Inputs of some blocks; and for each table the ids used, each one's share of its block, and ids a block."""
        used, means = {}, []
        for table, ids, times, bounds in (
            ("P", x.path, x.path_times, x.path_bounds), ("M", x.word, None, x.word_bounds)
        ):
            n = np.diff(bounds)[rows]
            at = gathered(bounds[rows], n)
            own = np.concatenate([[0], np.cumsum(n)])
            times = np.ones(len(at), np.float32) if times is None else times[at]
            share = times / np.repeat(np.maximum(run_sums(times, own), 1), n)
            used[table] = (ids[at], share, n)
            means.append(run_sums(self.p[table][ids[at]] * share[:, None], own))
        return np.concatenate([*means, x.figures[rows]], axis=1).astype(np.float32), used

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """What ``forward`` gives, both directions in step: half the steps for long sequences."""
        n, steps, _ = x.shape
        h = HIDDEN
        u = np.stack([self.p["Uf"], self.p["Ub"]])
        gates = np.empty((steps, 2, n, 4 * h), np.float32)
        gates[:, 0] = (x @ self.p["Wf"] + self.p["cf"]).swapaxes(0, 1)
        gates[:, 1] = (x @ self.p["Wb"] + self.p["cb"]).swapaxes(0, 1)[::-1]
        m = np.stack([mask.T, mask.T[::-1]], axis=1)[..., None].astype(np.float32)
        whole = m.reshape(steps, -1).all(axis=1).tolist()
        states = np.empty((steps, 2, n, h), np.float32)
        s = c = np.zeros((2, n, h), np.float32)
        for t in range(steps):
            z = gates[t]
            z += s @ u
            g = z[..., : 3 * h]
            g *= 0.5
            np.tanh(z, out=z)
            g += 1
            g *= 0.5
            c_new = g[..., h : 2 * h] * c
            c_new += g[..., :h] * z[..., 3 * h :]
            s_new = g[..., 2 * h :] * np.tanh(c_new)
            if not whole[t]:
                s_new = m[t] * s_new + (1 - m[t]) * s
                c_new = m[t] * c_new + (1 - m[t]) * c
            s, c = s_new, c_new
            states[t] = s
        both = states[:, 0] @ self.p["o"][:h] + states[::-1, 1] @ self.p["o"][h:] + self.p["b"]
        return both.T

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits, pages by blocks, from inputs of pages by blocks by features."""
        n, steps, _ = x.shape
        h = HIDDEN
        states = np.zeros((n, steps, 2 * h), x.dtype)
        tape: dict[str, list] = {"f": [], "b": []}
        for k, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            gates_in = x @ self.p[f"W{k}"] + self.p[f"c{k}"]
            s = c = np.zeros((n, h), x.dtype)
            for t in order:
                z = gates_in[:, t] + s @ self.p[f"U{k}"]
                g = sigmoid(z[:, : 3 * h])
                u = np.tanh(z[:, 3 * h :])
                m = mask[:, t, None]
                c_new = m * (g[:, h : 2 * h] * c + g[:, :h] * u) + (1 - m) * c
                th = np.tanh(c_new)
                s_new = m * g[:, 2 * h :] * th + (1 - m) * s
                if keep:
                    tape[k].append((t, s, c, g, u, th, m))
                s, c = s_new, c_new
                states[:, t, (0 if k == "f" else h) : (h if k == "f" else 2 * h)] = s
        logits = states @ self.p["o"] + self.p["b"]
        return (logits, (x, states, tape)) if keep else logits

    def backward(self, d: np.ndarray, kept) -> tuple[dict[str, np.ndarray], np.ndarray]:
        x, states, tape = kept
        h, p = HIDDEN, self.p
        g = {"o": np.einsum("nt,nth->h", d, states), "b": d.sum(keepdims=True).reshape(1)}
        d_states, d_x = d[:, :, None] * p["o"], np.zeros_like(x)
        for k in "fb":
            part = slice(0, h) if k == "f" else slice(h, 2 * h)
            ds = dc = np.zeros((x.shape[0], h), x.dtype)
            dw, du, db = np.zeros_like(p[f"W{k}"]), np.zeros_like(p[f"U{k}"]), np.zeros_like(p[f"c{k}"])
            for t, s, c, gate, u, th, m in reversed(tape[k]):
                ds = ds + d_states[:, t, part]
                i, f, o = gate[:, :h], gate[:, h : 2 * h], gate[:, 2 * h :]
                d_o = m * ds * th
                dc_new = dc + m * ds * o * (1 - th * th)
                d_cell = m * dc_new
                dz = np.concatenate(
                    [d_cell * u * i * (1 - i), d_cell * c * f * (1 - f), d_o * o * (1 - o), d_cell * i * (1 - u * u)], axis=1
                )
                dw += x[:, t].T @ dz
                du += s.T @ dz
                db += dz.sum(0)
                d_x[:, t] += dz @ p[f"W{k}"].T
                ds = (1 - m) * ds + dz @ p[f"U{k}"].T
                dc = d_cell * f + (1 - m) * dc_new
            g |= {f"W{k}": dw, f"U{k}": du, f"c{k}": db}
        return g, d_x


def _laid_out(x: Leaves, pages: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of some pages in a row, and their places among pages by steps."""
    sizes = np.diff(x.of_page)[pages]
    rows = np.concatenate([np.arange(x.of_page[i], x.of_page[i + 1]) for i in pages.tolist()])
    mask = np.arange(max(sizes.max(), 1))[None, :] < sizes[:, None]
    return rows, mask, sizes


def labels(network: Network, pages: list[list[Block]], cells: int = 20_000) -> list[np.ndarray]:
    """Which blocks of each page are main text. Pages of like length share a run, so padding stays small."""
    x = Leaves(pages)
    sizes = np.diff(x.of_page)
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and sizes[order[end]] * (end - at + 1) <= cells:
            end += 1
        some = order[at:end]
        rows, mask, _ = _laid_out(x, some)
        values, _ = network.inputs(x, rows)
        dense = np.zeros((*mask.shape, values.shape[1]), np.float32)
        dense[mask] = values
        logits = network.logits(dense, mask)
        for i, page in enumerate(some.tolist()):
            out[page] = logits[i, : sizes[page]] > 0
        at = end
    return out


# Invented training pages --------------------------------------------------------------------------------------------------


def made_page(rng: random.Random) -> tuple[str, list[tuple[str, bool]]]:
    """A page and its blocks' texts in order, each with whether it is main text."""
    truth: list[tuple[str, bool]] = []
    syllables = "an er in the on re ti es la de ou en st ra mo ku li vo pe sa".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def words(a: int, b: int) -> str:
        text = " ".join(word() for _ in range(rng.randint(a, b)))
        return text[0].upper() + text[1:]

    def prose() -> str:
        return " ".join(words(2, 18) + rng.choice(".....,?") for _ in range(rng.choice([1, 1, 2, 4, 8])))

    def put(text: str, main: bool) -> str:
        truth.append((text, main))
        return text

    def named(tag: str, names: list[str], inner: str) -> str:
        attribute = f' {rng.choice(["class", "id", "class"])}="{rng.choice(names)}"' if names and rng.random() < 0.9 else ""
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def items(n: int, main: bool, link: bool) -> str:
        rows = []
        for _ in range(n):
            text = put(words(1, 4), main)
            rows.append(f'<li><a href="/{word()}">{text}</a></li>' if link else f"<li>{text}</li>")
        return f"<ul>{''.join(rows)}</ul>"

    def side() -> str:
        """One part that isn't main text."""
        kind = rng.randrange(9)
        text = lambda: put(rng.choice([words(2, 8), prose()]), False)
        if kind == 0:
            return named("div", ["ad", "ads", "advert", "banner", "ad-slot", "sponsored", "promo"], text())
        if kind == 1:
            tag = rng.choice(["div", "div", "section", "p"])
            return named(tag, ["cookie-notice", "cookie", "notice", "consent", "gdpr", "alert", "message-bar"], text())
        if kind == 2:
            return named(rng.choice(["aside", "aside", "div"]), ["sidebar", "side", "widget", "related"], f"<h3>{text()}</h3>" + items(rng.randint(1, 5), False, True) + f"<p>{text()}</p>")
        if kind == 3:
            return named("form", ["newsletter", "search", "login", "subscribe"], f'<label>{text()}</label><input name="q"><p>{text()}</p><button>Send</button>')
        if kind == 4:
            head = text()
            inner = "".join(f'<div class="comment"><p>{text()}</p></div>' for _ in range(rng.randint(1, 5)))
            return named(rng.choice(["section", "div", "ol"]), ["comments", "comment-list", "replies", "discussion"], f"<h3>{head}</h3>" + inner)
        if kind == 5:
            return named("div", ["share", "social", "tags", "breadcrumbs", "pager", "byline-links"], items(rng.randint(1, 5), False, True))
        if kind == 6:
            return named("div", ["menu", "navbar", "nav", "navigation"], items(rng.randint(2, 8), False, True))
        if kind == 7:
            return named("div", ["footer", "header", "masthead", "copyright", "legal"], text())
        return f"<nav>{items(rng.randint(2, 8), False, True)}</nav>"

    def main_block() -> str:
        kind = rng.randrange(12)
        if kind < 7:
            text = put(rng.choice([prose, prose, prose, lambda: words(1, 3)])(), True)
            return rng.choice([f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f'<p class="lead">{text}</p>', f"<p>{text}</p>"])
        if kind == 7:
            return f"<h{(k := rng.randint(2, 4))}>{put(words(1, 7), True)}</h{k}>"
        if kind == 8:
            return items(rng.randint(1, 5), True, False)
        if kind == 9:
            return f"<blockquote>{put(prose(), True)}</blockquote>"
        if kind == 10:
            return f"<table><tr><td>{put(words(1, 4), True)}</td><td>{put(words(1, 4), True)}</td></tr></table>"
        return f"<div>{put(prose(), True)}</div>"

    out = ["<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body>"]
    if rng.random() < 0.8:
        top = rng.random()
        if top < 0.4:
            out.append(f"<header><h2>{put(words(1, 4), False)}</h2>")
            out.append(f"<nav>{items(rng.randint(2, 8), False, True)}</nav></header>")
        else:
            out.append(f"<nav>{items(rng.randint(2, 8), False, True)}</nav>")
    for _ in range(rng.choice([0, 1, 1, 2, 3])):
        out.append(side())
    opening, closing = rng.choice(
        [
            ("<article>", "</article>"),
            ("<article>", "</article>"),
            ("<main><article>", "</article></main>"),
            ("<main>", "</main>"),
            ('<div class="content"><div class="post">', "</div></div>"),
            ('<div id="main"><div class="entry-content">', "</div></div>"),
            ('<div class="article-body">', "</div>"),
            ('<section class="story">', "</section>"),
        ]
    )
    out.append(opening)
    if rng.random() < 0.8:
        out.append(f"<h1>{put(words(2, 12), True)}</h1>")
    for _ in range(rng.choice([1, 2, 4, 8, 16])):
        if rng.random() < 0.08:
            out.append(side())
        out.append(main_block())
    inside = rng.random() < 0.3
    if inside:
        out.append(side())
    out.append(closing)
    for _ in range(rng.choice([0, 1, 2])):
        out.append(side())
    if rng.random() < 0.85:
        out.append(f"<footer>&copy; {put_footer(rng, put, words)}</footer>")
    out.append("</body></html>")
    return "".join(out), truth


def put_footer(rng: random.Random, put, words) -> str:
    text = f"{rng.choice(['www.', ''])}site.example &middot; {words(2, 14)}."
    put("© " + html.unescape(text), False)
    return text


@lru_cache(1)
def trained(pages: int = TRAINING_PAGES, epochs: int = 8, batch: int = 16, seed: int = 0) -> Network:
    """The labeller; the same for every data set."""
    rng, draw = random.Random(seed), np.random.default_rng(seed)
    made = []
    for _ in range(pages):
        page, truth = made_page(rng)
        found = blocks(page)
        if [b.text for b in found] != [" ".join(t.split()) for t, _ in truth]:
            raise AssertionError("an invented page was not cut into its blocks")
        made.append((found, np.array([m for _, m in truth], np.float32)))
    x = Leaves([b for b, _ in made])
    y = np.concatenate([m for _, m in made])
    network = Network(seed)
    adam = Adam(network.p, 0.01)
    for epoch in range(epochs):
        adam.rate = 0.01 * (1 - epoch / epochs) + 0.0005
        order = draw.permutation(pages)
        for i in range(0, pages, batch):
            rows, mask, _ = _laid_out(x, order[i : i + batch])
            values, used = network.inputs(x, rows)
            dense = np.zeros((*mask.shape, values.shape[1]), np.float32)
            dense[mask] = values
            # Words are random here: a part of each block's inputs is dropped, so that no single one decides.
            drop = np.ones_like(values)
            drop[draw.random(len(values)) < 0.1, :PATH_SIZE] = 0
            dense[mask] *= drop
            logits, kept = network.forward(dense, mask.astype(np.float32), keep=True)
            d = np.zeros(mask.shape, np.float32)
            d[mask] = (sigmoid(logits[mask]) - y[rows]) / len(rows)
            grads, d_x = network.backward(d, kept)
            d_in = d_x[mask] * drop
            for table, part in (("P", slice(0, PATH_SIZE)), ("M", slice(PATH_SIZE, PATH_SIZE + WORD_SIZE))):
                ids, share, n = used[table]
                grads[table] = 1e-5 * network.p[table]
                np.add.at(grads[table], ids, np.repeat(d_in[:, part], n, axis=0) * share[:, None])
            adam.step(grads)
    return network


# Spark --------------------------------------------------------------------------------------------------------------------


def main_text(network: Network, pages: list[str]) -> list[str]:
    cut = [blocks(p) for p in pages]
    return [
        "\n".join(b.text for b, main in zip(page, keep.tolist(), strict=True) if main)
        for page, keep in zip(cut, labels(network, cut), strict=True)
    ]


def extracted(pages: DataFrame, network: Network | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    shared = pages.sparkSession.sparkContext.broadcast(network or trained())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "html"):
                texts = main_text(shared.value, [p or "" for p in rows.column("html").to_pylist()])
                arrays = [rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [*arrays, pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
                )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(
        read, f"page_id {kind}, url string, text string, n_chars long"
    )
