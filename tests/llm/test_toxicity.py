"""The recurrent toxicity model: gradients, windows, held-out accuracy and awkward rows."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lodestar.llm import toxicity as T
from lodestar.llm.words import coded_words


def corpus(prose, n, seed):
    rng = random.Random(seed)
    bad = "zorgish blukker vextrous".split()
    rows = []
    for i in range(n):
        words = prose(rng.randrange(20, 300), seed * 1000 + i).split()
        label = int(i % 4 == 0)
        if label:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((" ".join(words), label))
    return rows


@pytest.fixture(scope="module")
def model(prose):
    return T.fit(corpus(prose, 200, 1))


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = T.Network(1)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    net.p["c" + "f"] += 0.1
    x = rng.standard_normal((7, 2 * T.EMBEDDING + 3))
    at = rng.integers(0, 7, (4, T.WINDOW))
    mask = (np.arange(T.WINDOW)[None] < np.array([32, 5, 1, 20])[:, None]).astype(float)
    at = np.where(mask > 0, at, 7)
    weights = rng.standard_normal(4)

    def loss():
        return float(net.forward(net.projected(x), at, mask) @ weights)

    _, kept = net.forward(net.projected(x), at, mask, keep=True)
    grads, d_gates = net.backward(weights, kept, at, mask, 7)
    for k in "fb":
        grads["W" + k] = x.T @ d_gates[k]
    for name, grad in grads.items():
        flat, g = net.p[name].reshape(-1), grad.reshape(-1)
        for i in rng.integers(0, len(flat), 3):
            was, e = flat[i], 1e-3
            flat[i] = was + e
            up = loss()
            flat[i] = was - e
            down = loss()
            flat[i] = was
            assert abs((up - down) / (2 * e) - g[i]) < 2e-2 * max(1, abs(g[i])), name


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 56, 57, 500])
def test_windows_cover_every_word(n):
    starts, lengths, text = T.windows(np.array([0, n]))
    seen = {p for a, k in zip(starts, lengths) for p in range(a, a + k)}
    assert seen == set(range(n)) and (lengths <= T.WINDOW).all() and len(text) >= 1
    assert n == 0 or (lengths > 0).all()


def test_held_out_accuracy(model, prose):
    rows = corpus(prose, 120, 2)
    scores = model.scores(pa.array([t for t, _ in rows], pa.large_string()))
    assert np.mean((scores >= T.TOXIC) == [y for _, y in rows]) > 0.95


def test_whole_text_is_read(model, prose):
    """A toxic word at the very end of a very long text is seen."""
    long = " ".join(prose(300, k) for k in range(60))
    clean, bad = model.scores(pa.array([long, long + " zorgish blukker"], pa.large_string()))
    assert clean < T.TOXIC <= bad


def test_slices_do_not_change_scores(model, prose):
    texts = [prose(80, k) for k in range(20)]
    whole = model.scores(pa.array(texts, pa.large_string()))
    alone = [model.scores(pa.array([t], pa.large_string()))[0] for t in texts]
    assert np.allclose(whole, alone, atol=1e-5)


def test_awkward_rows(spark, model, awkward, empty_docs):
    rows = T.toxicity_scores(awkward, model).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in rows if r.doc_id in (2, 3, 9, 10)} and len({r.score for r in rows if r.doc_id == 5}) == 1
    kept = T.toxicity_filter(awkward, model)
    assert kept.columns == awkward.columns
    assert T.toxicity_scores(empty_docs, model).collect() == [] and T.toxicity_filter(empty_docs, model).collect() == []


def test_little_or_no_labels(spark, awkward, prose):
    none = T.trained(awkward, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert none.scores(pa.array(["a"], pa.large_string())).tolist() == [0.0]
    one = T.trained(awkward, spark.createDataFrame([(5, 1, 0), (6, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int"))
    assert one.scores(pa.array(["a"], pa.large_string())).tolist() == [0.0]


def test_coded_words_drop_only_white_space():
    texts = ["a  b\x0bc", "", " é\x1cf "]
    words, at, bounds = coded_words(pa.array(texts, pa.large_string()))
    pool = words.to_pylist()
    assert [[pool[i] for i in at[a:b]] for a, b in zip(bounds, bounds[1:])] == [["a", "b", "c"], [], ["é\x1cf"]]


def test_all_windows_of_a_text_are_trained_on(prose, monkeypatch):
    """A step's gradient counts every window, and is the same when their states are held a few at a time."""
    rows = [*corpus(prose, 20, 7), (prose(3000, 99) + " zorgish " + prose(40, 98), 1)]
    words, at, bounds = coded_words(pa.array([t for t, _ in rows], pa.large_string()))
    v, y = T.Vocabulary.of(words), np.array([k for _, k in rows])
    starts, lengths, text = T.windows(bounds)
    by_text = np.searchsorted(text, np.arange(len(rows) + 1))
    assert by_text[-1] - by_text[-2] > 100
    figures = np.zeros((len(v.word), 3), np.float32)
    found = []

    class Kept:
        def step(self, grads):
            found.append(grads)

    for most in (10**6, 16):
        monkeypatch.setattr(T, "MOST_WINDOWS", most)
        T._step(T.Network(3), Kept(), np.arange(len(rows)), by_text, starts, lengths, at, v, figures, y)
    for k, whole in found[0].items():
        assert np.allclose(whole, found[1][k], rtol=1e-3, atol=1e-5 * max(1, np.abs(whole).max()))
    # Words of all windows of the long text have a gradient, not those of its likeliest windows alone.
    used = np.unique(at[bounds[-2] :])
    assert (np.abs(found[0]["E"]).sum(1)[T._bucket(v.word[used], T.WORD_BUCKETS, 20)] > 0).all()


def test_scores_match_a_plain_pass(model):
    """Every window word by word and gate by gate, in plain loops."""
    net = model.network
    p = {k: x.astype(float) for k, x in net.p.items()}
    h, sig = T.HIDDEN, lambda z: 1 / (1 + np.exp(-z))
    for t in ("some words and a zorgish one " * 9, "only two", "", "plain text again and again " * 20):
        words, at, bounds = coded_words(pa.array([t], pa.large_string()))
        v = T.Vocabulary.of(words)
        x = net.features(v, T.inputs(v, model.odds)).astype(float)
        best, places = -np.inf, at.tolist()
        for begin in range(0, max(1, len(places) - (T.WINDOW - T.STRIDE)), T.STRIDE):
            own = places[begin : begin + T.WINDOW]
            states = np.zeros((len(own), 2 * h))
            for k, order in (("f", range(len(own))), ("b", range(len(own) - 1, -1, -1))):
                s = np.zeros(h)
                for i in order:
                    a, r = x[own[i]] @ p[f"W{k}"] + p[f"c{k}"], s @ p[f"U{k}"]
                    z, reset = sig(a[:h] + r[:h]), sig(a[h : 2 * h] + r[h : 2 * h])
                    s = s + z * (np.tanh(a[2 * h :] + reset * r[2 * h :]) - s)
                    states[i, (0 if k == "f" else h) : (h if k == "f" else 2 * h)] = s
            weight = np.exp(np.tanh(states @ p["A"]) @ p["a"])
            pooled = (weight[:, None] * states).sum(0) / weight.sum() if len(own) else np.zeros(2 * h)
            best = max(best, float(pooled @ p["o"] + p["b"][0]))
        want = sig(net.scale * best + net.shift)
        assert abs(model.scores(pa.array([t], pa.large_string()))[0] - want) < 1e-4
