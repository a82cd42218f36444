"""The multiple-instance quality model: gradients, attention, held-out accuracy and awkward rows."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lodestar.llm import quality_classifier as Q


def corpus(prose, n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = prose(rng.randrange(20, 400), seed * 1000 + i).split()
        label = int(i % 3 > 0)
        if not label:
            words = [w + rng.choice(["###", "%%%"]) for w in words] if i % 2 else [w for w in words for _ in (0, 1)]
        rows.append((" ".join(words), label))
    return rows


@pytest.fixture(scope="module")
def model(prose):
    return Q.fit(corpus(prose, 150, 1))


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = Q.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    mean, shape = rng.standard_normal((6, Q.EMBEDDING)), rng.standard_normal((6, Q.FIGURES + 2))
    of_text, weights = np.array([0, 1, 4, 6]), rng.standard_normal(3)
    _, kept = net.forward(mean, shape, of_text)
    grads, d_mean = net.backward(weights, kept, of_text)
    loss = lambda: float(net.forward(mean, shape, of_text)[0] @ weights)
    for values, grad in [*((net.p[k], g) for k, g in grads.items()), (mean, d_mean)]:
        flat, g = values.reshape(-1), grad.reshape(-1)
        for i in rng.integers(0, len(flat), 4):
            was = flat[i]
            flat[i] = was + 1e-5
            up = loss()
            flat[i] = was - 1e-5
            down = loss()
            flat[i] = was
            assert abs((up - down) / 2e-5 - g[i]) < 1e-5


def test_held_out_accuracy(model, prose):
    rows = corpus(prose, 90, 2)
    scores = model.scores(pa.array([t for t, _ in rows], pa.large_string()))
    assert np.mean((scores >= Q.GOOD) == [y for _, y in rows]) > 0.95


def test_passages_cover_every_word_and_attention_sums_to_one(model, prose):
    texts = [prose(n, n) for n in (1, 63, 64, 65, 1000)] + [""]
    bags = Q.Bags(pa.array(texts, pa.large_string()))
    assert bags.bounds.tolist()[-1] == len(bags.at) == 1 + 63 + 64 + 65 + 1000
    assert np.diff(bags.of_text).tolist() == [1, 1, 1, 2, 16, 1]
    weights = model.attention(texts[4])
    assert len(weights) == 16 and abs(weights.sum() - 1) < 1e-5


def test_slices_do_not_change_scores(model, prose):
    texts = [prose(80, k) for k in range(20)] + ["", "é " * 40]
    whole = model.scores(pa.array(texts, pa.large_string()))
    alone = [model.scores(pa.array([t], pa.large_string()))[0] for t in texts]
    assert np.allclose(whole, alone, atol=1e-5)


def test_awkward_rows(spark, model, awkward, empty_docs):
    rows = Q.quality_scores(awkward, model).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == int(r.score >= Q.GOOD) for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    assert Q.quality_scores(empty_docs, model).collect() == []


def test_labels_outside_the_fold_are_used(spark, prose):
    rows = [(i, t, 0) for i, (t, _) in enumerate(corpus(prose, 60, 3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    seen = list(Q.labelled_sample(docs, labels, "quality", 4, 2, 1000))
    import zlib

    want = {r[1] for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2}
    assert {t for t, _ in seen} == want
    assert len(list(Q.labelled_sample(docs, labels, "quality", 4, 2, 5))) == 10


def test_no_labels(spark, awkward):
    model = Q.trained(awkward, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert model.scores(pa.array(["a", ""], pa.large_string())).tolist() == [0.0, 0.0]
