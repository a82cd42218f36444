"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy.

A word's input joins a hashed word embedding, the mean embedding of its character n-grams, and the log-odds that the
labelled sample gives its word hash and its n-grams. Texts are read in overlapping windows of ``WINDOW`` words, one every
``STRIDE``; every window of the whole text is scored, and the highest decides. Input projections are made once for each
different word of a slice, so a step of the recurrence costs one small product a window.

The network is trained on the driver on at most ``PER_CLASS`` labelled rows a class (two-fold log-odds, so that it
doesn't learn its own counts), and on all windows of each: a text's logit is a soft maximum over them. A training step holds
the states of ``MOST_WINDOWS`` windows at a time, so long texts don't make it larger. The model, some MB whose size doesn't
depend on the data, goes to the workers with the function.

Null and empty texts are read as one empty window. With no labels, or labels of one class only, every score is that
class's share (0 without labels). Repeated rows get equal scores; null ids are scored and carried along; other columns
are ignored by ``toxicity_scores`` and kept by ``toxicity_filter``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .segments import gathered, slices, whole_texts
from .words import Adam, char_grams, coded_words, labelled_sample, run_sums, sigmoid, word_bytes, word_hashes

WINDOW, STRIDE = 32, 24
HIDDEN = 12
EMBEDDING = 6
WORD_BUCKETS = CHAR_BUCKETS = 4096
ODDS_BUCKETS = 1 << 18
GRAMS = (4, 5)
RATE = 0.01
#: Least number of training steps, for small samples.
STEPS = 400
PER_CLASS = 1800
#: Windows whose states a training step holds at once.
MOST_WINDOWS = 4096
TOXIC = 0.7


@dataclass
class Vocabulary:
    """Hashed parts of the different words of a slice."""

    word: np.ndarray
    grams: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of(cls, words: pa.Array) -> Vocabulary:
        plain = pc.ascii_lower(words)
        plain = pc.replace_substring_regex(plain, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
        data, ends = word_bytes(plain)
        grams, owner = char_grams(data, ends, GRAMS)
        bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(ends) - 1))]).astype(np.int64)
        return cls(word_hashes(data, ends), grams, bounds)


def _bucket(hashes: np.ndarray, n: int, shift: int = 0) -> np.ndarray:
    return ((hashes >> np.uint64(shift)) % np.uint64(n)).astype(np.int64)


class Odds:
    """Log-odds of word and n-gram buckets from the number of texts of each class that hold them."""

    def __init__(self):
        self.counts = np.zeros((2, 2 * ODDS_BUCKETS), np.float32)
        self.texts = np.zeros(2, np.float32)

    def add(self, found: np.ndarray, label: int) -> None:
        """One text by the buckets it holds, each named once."""
        self.counts[label, found] += 1
        self.texts[label] += 1

    def table(self) -> np.ndarray:
        share = (self.counts + 1) / (self.texts[:, None] + 2)
        return (np.log(share[1]) - np.log(share[0])).astype(np.float32)

    @staticmethod
    def held(v: Vocabulary, at: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
        """The buckets that each text holds."""
        word, gram = _bucket(v.word, ODDS_BUCKETS), _bucket(v.grams, ODDS_BUCKETS) + ODDS_BUCKETS
        for a, b in zip(bounds, bounds[1:], strict=False):
            used = np.unique(at[a:b])
            own = gram[gathered(v.bounds[used], v.bounds[used + 1] - v.bounds[used])] if len(used) else used
            yield np.unique(np.concatenate([word[used], own]))


def inputs(v: Vocabulary, odds: np.ndarray) -> np.ndarray:
    """Three log-odds figures a word: its own, the highest and the mean of its n-grams."""
    n = len(v.word)
    out = np.zeros((n, 3), np.float32)
    out[:, 0] = odds[_bucket(v.word, ODDS_BUCKETS)]
    g = odds[_bucket(v.grams, ODDS_BUCKETS) + ODDS_BUCKETS]
    filled = np.flatnonzero(np.diff(v.bounds) > 0)
    if len(filled):
        out[filled, 1] = np.maximum.reduceat(g, v.bounds[:-1][filled])
        out[filled, 2] = np.add.reduceat(g, v.bounds[:-1][filled]) / np.diff(v.bounds)[filled]
    return out / 3


def windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place, number of words and text of every window; an empty text has one empty window."""
    n = np.diff(bounds)
    per = np.maximum(1, -(-(n - (WINDOW - STRIDE)) // STRIDE))
    text = np.repeat(np.arange(len(n)), per)
    k = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    return bounds[:-1][text] + k * STRIDE, np.minimum(WINDOW, n[text] - k * STRIDE), text


class Network:
    """Parameters and both passes. A row of ``words`` beyond the last real word stands for padding."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        d, h = 2 * EMBEDDING + 3, HIDDEN
        small = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {
            "E": (0.1 * rng.standard_normal((WORD_BUCKETS, EMBEDDING))).astype(np.float32),
            "C": (0.1 * rng.standard_normal((CHAR_BUCKETS, EMBEDDING))).astype(np.float32),
            "A": small(2 * h, 8),
            "a": small(8),
            "o": small(2 * h),
            "b": np.zeros(1, np.float32),
        }
        for k in "fb":
            self.p |= {f"W{k}": small(d, 3 * h), f"U{k}": small(h, 3 * h), f"c{k}": np.zeros(3 * h, np.float32)}
        self.scale, self.shift = 1.0, 0.0

    def features(self, v: Vocabulary, figures: np.ndarray) -> np.ndarray:
        chars = run_sums(self.p["C"][_bucket(v.grams, CHAR_BUCKETS, 20)], v.bounds)
        chars /= np.maximum(np.diff(v.bounds), 1)[:, None]
        return np.concatenate([self.p["E"][_bucket(v.word, WORD_BUCKETS, 20)], chars, figures], axis=1)

    def projected(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """Input parts of the gates for each different word and, last, for padding."""
        x = np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])
        return {k: x @ self.p[f"W{k}"] + self.p[f"c{k}"] for k in "fb"}

    def forward(self, gates: dict[str, np.ndarray], at: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logit of each window; ``at`` and ``mask`` are windows by steps."""
        n, steps = at.shape
        h = HIDDEN
        states = np.zeros((steps, n, 2 * h), np.float32)
        tape: dict[str, list] = {"f": [], "b": []}
        for k, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            table, u, s = gates[k], self.p[f"U{k}"], np.zeros((n, h), np.float32)
            part = slice(0, h) if k == "f" else slice(h, 2 * h)
            for t in order:
                x = table[at[:, t]]
                r = s @ u
                zr = x[:, : 2 * h] + r[:, : 2 * h]
                np.negative(zr, out=zr)
                np.exp(zr, out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                z = zr[:, :h] * mask[:, t, None]
                c = zr[:, h:] * r[:, 2 * h :]
                c += x[:, 2 * h :]
                np.tanh(c, out=c)
                if keep:
                    tape[k].append((t, s, z, zr, r[:, 2 * h :], c))
                s = s + z * (c - s)
                states[t, :, part] = s
        hidden = np.tanh(states @ self.p["A"])
        score = hidden @ self.p["a"]
        m = mask.T
        weight = np.exp(np.clip(score, -30, 30)) * m
        total = weight.sum(0) + 1e-9
        alpha = weight / total
        pooled = np.einsum("tn,tnh->nh", alpha, states)
        logit = pooled @ self.p["o"] + self.p["b"]
        return (logit, (states, tape, hidden, alpha, pooled)) if keep else logit

    def backward(self, d_logit: np.ndarray, kept, at: np.ndarray, mask: np.ndarray, n_words: int):
        """Gradients of parameters, and of the gates' input parts for each word."""
        states, tape, hidden, alpha, pooled = kept
        h, p = HIDDEN, self.p
        g = {"o": pooled.T @ d_logit, "b": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * p["o"]
        d_states = alpha[:, :, None] * d_pooled[None]
        d_alpha = np.einsum("tnh,nh->tn", states, d_pooled)
        d_score = alpha * (d_alpha - (alpha * d_alpha).sum(0))
        g["a"] = np.einsum("tn,tnk->k", d_score, hidden)
        d_pre = d_score[:, :, None] * p["a"] * (1 - hidden**2)
        g["A"] = np.einsum("tnh,tnk->hk", states, d_pre, optimize=True)
        d_states += d_pre @ p["A"].T
        d_gates = {}
        for k in "fb":
            part = slice(0, h) if k == "f" else slice(h, 2 * h)
            du, ds = np.zeros_like(p[f"U{k}"]), np.zeros((at.shape[0], h), np.float32)
            dx_all = np.zeros((n_words + 1, 3 * h), np.float32)
            for t, s, z, zr, rc, c in reversed(tape[k]):
                ds = ds + d_states[t, :, part]
                dc = ds * z * (1 - c * c)
                dz = ds * (c - s) * mask[:, t, None]
                dr = dc * rc
                pre_z = dz * zr[:, :h] * (1 - zr[:, :h])
                pre_r = dr * zr[:, h:] * (1 - zr[:, h:])
                d_in = np.concatenate([pre_z, pre_r, dc], axis=1)
                d_rec = np.concatenate([pre_z, pre_r, dc * zr[:, h:]], axis=1)
                du += s.T @ d_rec
                np.add.at(dx_all, at[:, t], d_in)
                ds = ds * (1 - z) + d_rec @ p[f"U{k}"].T
            g[f"U{k}"] = du
            d_gates[k] = dx_all[:-1]
            g[f"c{k}"] = dx_all.sum(0)
        return g, d_gates


def _placed(starts: np.ndarray, lengths: np.ndarray, at: np.ndarray, padding: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers and mask, windows by steps."""
    k = np.arange(WINDOW)
    mask = k[None, :] < lengths[:, None]
    places = np.minimum(starts[:, None] + k[None, :], max(len(at) - 1, 0))
    words = at[places] if len(at) else np.zeros(places.shape, np.int64)
    return np.where(mask, words, padding), mask.astype(np.float32)


class Model:
    """A trained network with its log-odds, or a constant where there was nothing to learn from."""

    def __init__(self, network: Network | None, odds: np.ndarray | None, constant: float = 0.0):
        self.network, self.odds, self.constant = network, odds, constant

    def scores(self, texts: pa.Array, chunk: int = 2048) -> np.ndarray:
        """The highest calibrated window score of each text."""
        if self.network is None:
            return np.full(len(texts), self.constant)
        words, at, bounds = coded_words(texts)
        v = Vocabulary.of(words)
        gates = self.network.projected(self.network.features(v, inputs(v, self.odds)))
        starts, lengths, text = windows(bounds)
        logits = np.empty(len(starts), np.float32)
        for i in range(0, len(starts), chunk):
            part = slice(i, i + chunk)
            logits[part] = self.network.forward(gates, *_placed(starts[part], lengths[part], at, len(v.word)))
        best = np.maximum.reduceat(logits, np.searchsorted(text, np.arange(len(texts)))) if len(texts) else logits
        return sigmoid(self.network.scale * best.astype(np.float64) + self.network.shift)


def _calibrated(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic fit in which toxic texts weigh a quarter: they are rare in a corpus."""
    a, b = 1.0, 0.0
    target = np.where(y == 1, 0.995, 0.005)
    weight = np.where(y == 1, 0.25 / max(y.sum(), 1), 0.75 / max((1 - y).sum(), 1))
    for _ in range(500):
        e = (sigmoid(a * logits + b) - target) * weight
        a, b = max(0.2, a - 0.5 * float(e @ logits)), b - 0.5 * float(e.sum())
    return a, b


def fit(rows: list[tuple[str, int]], epochs: int = 4, seed: int = 0, batch: int = 32) -> Model:
    """A model from (text, label) rows."""
    y = np.array([label for _, label in rows], np.int64)
    if not len(y) or y.min() == y.max():
        return Model(None, None, float(y.mean()) if len(y) else 0.0)
    # Texts without words carry nothing toxic.
    rows = [*rows, *[("", 0)] * (1 + len(rows) // 50)]
    y = np.array([label for _, label in rows], np.int64)
    words, at, bounds = coded_words(pa.array([t for t, _ in rows], pa.large_string()))
    v = Vocabulary.of(words)
    rng = np.random.default_rng(seed)
    fold = rng.permutation(len(y)) % 2
    halves = [Odds(), Odds()]
    for found, k, label in zip(Odds.held(v, at, bounds), fold.tolist(), y.tolist(), strict=True):
        halves[k].add(found, label)
    figures = [inputs(v, halves[1 - k].table()) for k in (0, 1)]
    total = Odds()
    total.counts, total.texts = halves[0].counts + halves[1].counts, halves[0].texts + halves[1].texts
    del halves
    starts, lengths, text = windows(bounds)
    network = Network(seed)
    adam = Adam(network.p, RATE)
    by_text = np.searchsorted(text, np.arange(len(y) + 1))
    epochs = max(epochs, STEPS * batch // len(y))
    for epoch in range(epochs):
        adam.rate = RATE * (1 - epoch / epochs) + RATE / 10
        for k in (0, 1):
            members = rng.permutation(np.flatnonzero(fold == k))
            for i in range(0, len(members), batch):
                _step(network, adam, members[i : i + batch], by_text, starts, lengths, at, v, figures[k], y)
    model = Model(network, total.table())
    held = np.concatenate([_highest(network, v, figures[k], np.flatnonzero(fold == k), bounds, at) for k in (0, 1)])
    labels = np.concatenate([y[fold == k] for k in (0, 1)])
    network.scale, network.shift = _calibrated(held, labels)
    return model


def _highest(network: Network, v: Vocabulary, figures, members, bounds, at) -> np.ndarray:
    gates = network.projected(network.features(v, figures))
    starts, lengths, text = windows(bounds)
    out = np.full(len(bounds) - 1, -np.inf)
    mine = np.flatnonzero(np.isin(text, members))
    for i in range(0, len(mine), 2048):
        part = mine[i : i + 2048]
        logits = network.forward(gates, *_placed(starts[part], lengths[part], at, len(v.word)))
        np.maximum.at(out, text[part], logits)
    return out[members]


def _step(network, adam, members, by_text, starts, lengths, at, v, figures, y) -> None:
    rows = gathered(by_text[members], by_text[members + 1] - by_text[members])
    owner = np.repeat(np.arange(len(members)), by_text[members + 1] - by_text[members])
    places, mask = _placed(starts[rows], lengths[rows], at, -1)
    used, local = np.unique(places[places >= 0], return_inverse=True)
    numbers = np.full(places.shape, len(used))
    numbers[places >= 0] = local
    lens = np.diff(v.bounds)[used]
    small = Vocabulary(
        v.word[used], v.grams[gathered(v.bounds[used], lens)], np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
    )
    x = network.features(small, figures[used])
    gates = network.projected(x)
    parts = [slice(i, i + MOST_WINDOWS) for i in range(0, len(rows), MOST_WINDOWS)]
    if len(parts) == 1:
        logit, kept = network.forward(gates, numbers, mask, keep=True)
    else:
        logit, kept = np.concatenate([network.forward(gates, numbers[p], mask[p]) for p in parts]), None
    # The text's logit is a soft maximum over its windows.
    top = np.full(len(members), -np.inf, np.float32)
    np.maximum.at(top, owner, logit)
    soft = np.exp(logit - top[owner])
    total = np.bincount(owner, soft, len(members))
    error = sigmoid(top + np.log(total)) - y[members]
    d_logit = ((error[owner] * soft / total[owner]) / len(members)).astype(np.float32)
    grads, d_gates = {}, {}
    for p in parts:
        now = kept or network.forward(gates, numbers[p], mask[p], keep=True)[1]
        g, d_g = network.backward(d_logit[p], now, numbers[p], mask[p], len(used))
        grads = {k: grads.get(k, 0) + value for k, value in g.items()}
        d_gates = {k: d_gates.get(k, 0) + value for k, value in d_g.items()}
    d_x = np.zeros_like(x)
    for k in "fb":
        grads[f"W{k}"] = x.T @ d_gates[k]
        d_x += d_gates[k] @ network.p[f"W{k}"].T
    grads["E"] = np.zeros_like(network.p["E"])
    np.add.at(grads["E"], _bucket(small.word, WORD_BUCKETS, 20), d_x[:, :EMBEDDING])
    grads["C"] = np.zeros_like(network.p["C"])
    share = d_x[:, EMBEDDING : 2 * EMBEDDING] / np.maximum(lens, 1)[:, None]
    np.add.at(grads["C"], _bucket(small.grams, CHAR_BUCKETS, 20), np.repeat(share, lens, axis=0))
    adam.step(grads)


# Spark ----------------------------------------------------------------------------------------------------------------


def trained(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """A model from labelled rows outside fold 1 of 3 of crc32(doc_id)."""
    return fit(list(labelled_sample(docs, labels, "toxic", 3, 1, per_class)))


def toxicity_scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                scores = shared.value.scores(whole_texts(rows.column("text")))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return rows.mapInArrow(score, "doc_id long, score double").select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted")
    )


def toxicity_filter(docs: DataFrame, model: Model, threshold: float = TOXIC) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                yield rows.filter(pa.array(shared.value.scores(whole_texts(rows.column("text"))) < threshold))

    return docs.mapInArrow(keep, docs.schema)
