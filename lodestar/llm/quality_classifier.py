"""Quality by attention-based multiple-instance learning, in numpy.

A text is a bag of passages of ``PASSAGE`` words; only the text has a label. Every passage of the whole text is encoded:
the mean of its words' hashed embeddings and shape figures (length, capitals, digits, symbols, ...), with its share of
words that return within five words. Gated attention (a tanh part times a sigmoid part) weighs the encoded passages, and
a logistic layer scores the weighted sum. Words' parts are made once for each different word of a slice.

The model is trained on the driver on at most ``PER_CLASS`` labelled rows a class; it is some hundred KB whatever the
data. Labels, language, source and id are never inputs.

Null and empty texts are one empty passage, and texts without words count as bad in training. With no labels, or labels
of one class only, every score is that class's share (0 without labels). Repeated rows get equal scores; null ids are
scored and carried along; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .segments import slices, whole_texts
from .words import Adam, coded_words, labelled_sample, run_sums, sigmoid, word_bytes, word_hashes

PASSAGE = 64
EMBEDDING, ENCODED, GATE = 12, 16, 8
BUCKETS = 4096
PER_CLASS = 1500
GOOD = 0.7
STEPS = 600
REPEAT_WITHIN = 5
FIGURES = 8


def word_figures(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Embedding bucket and shape figures of each different word."""
    plain = pc.replace_substring_regex(pc.ascii_lower(words), r"[^\p{L}\p{N}]+", "")
    data, ends = word_bytes(plain)
    bucket = (word_hashes(data, ends) % np.uint64(BUCKETS)).astype(np.int64)
    data, ends = word_bytes(words)
    lengths = np.maximum(np.diff(ends), 1)
    share = lambda mask: run_sums(mask.astype(np.float32), ends) / lengths
    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122) | (data >= 128)
    digit = (data >= 48) & (data <= 57)
    other = ~(upper | lower | digit)
    out = np.zeros((len(bucket), FIGURES), np.float32)
    out[:, 0] = np.minimum(lengths, 40) / 10
    out[:, 1] = share(upper)
    out[:, 2] = (out[:, 1] > 0.99) & (lengths > 1)
    out[:, 3] = share(digit)
    out[:, 4] = np.minimum(run_sums(other.astype(np.float32), ends), 5) / 2
    out[:, 5] = run_sums(other.astype(np.float32), ends) == np.diff(ends)
    last = data[np.maximum(ends[1:] - 1, 0)] if len(data) else np.zeros(len(bucket), np.uint8)
    out[:, 6] = np.isin(last, np.frombuffer(b".,;:?", np.uint8))
    out[:, 7] = np.isin(last, np.frombuffer(b"#*$%&|<>!", np.uint8))
    return bucket, out


class Bags:
    """Passages of texts: the words at each place, passage bounds, and the passages of each text."""

    def __init__(self, texts: pa.Array):
        words, self.at, bounds = coded_words(texts)
        self.bucket, self.figures = word_figures(words)
        n = np.diff(bounds)
        per = np.maximum(1, -(-n // PASSAGE))
        self.text = np.repeat(np.arange(len(n)), per)
        k = np.arange(len(self.text)) - np.repeat(np.cumsum(per) - per, per)
        self.bounds = np.concatenate([bounds[:-1][self.text] + k * PASSAGE, bounds[-1:]])
        self.of_text = np.concatenate([[0], np.cumsum(per)])
        again = np.zeros(len(self.at), np.float32)
        begin = np.repeat(bounds[:-1], n)
        place = np.arange(len(self.at))
        for d in range(1, REPEAT_WITHIN + 1):
            again[d:] = np.maximum(again[d:], (self.at[d:] == self.at[:-d]) & (place[d:] - d >= begin[d:]))
        size = np.maximum(np.diff(self.bounds), 1).astype(np.float32)
        self.size = size
        shape = run_sums(self.figures[self.at], self.bounds) / size[:, None]
        extra = np.stack([run_sums(again, self.bounds) / size, np.diff(self.bounds) / PASSAGE], axis=1)
        self.shape = np.concatenate([shape, extra], axis=1).astype(np.float32)


class Network:
    """Encoder, gated attention and logistic layer."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        small = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {
            "E": (0.1 * rng.standard_normal((BUCKETS, EMBEDDING))).astype(np.float32),
            "W": small(EMBEDDING + FIGURES + 2, ENCODED),
            "c": np.zeros(ENCODED, np.float32),
            "V": small(ENCODED, GATE),
            "U": small(ENCODED, GATE),
            "w": small(GATE),
            "o": small(ENCODED),
            "b": np.zeros(1, np.float32),
        }

    def forward(self, mean: np.ndarray, shape: np.ndarray, of_text: np.ndarray):
        """Logit of each text from its passages' mean embeddings and figures, and what the backward pass needs."""
        p = self.p
        x = np.concatenate([mean, shape], axis=1)
        h = np.tanh(x @ p["W"] + p["c"])
        t, s = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        score = (t * s) @ p["w"]
        weight = np.exp(np.clip(score, -30, 30))
        text = np.repeat(np.arange(len(of_text) - 1), np.diff(of_text))
        alpha = weight / run_sums(weight, of_text)[text]
        pooled = run_sums(alpha[:, None] * h, of_text)
        return pooled @ p["o"] + p["b"], (x, h, t, s, alpha, pooled, text)

    def backward(self, d: np.ndarray, kept, of_text: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the layers, and of the passages' mean embeddings."""
        x, h, t, s, alpha, pooled, text = kept
        p = self.p
        g = {"o": pooled.T @ d, "b": d.sum(keepdims=True)}
        d_pooled = (d[:, None] * p["o"])[text]
        d_h = alpha[:, None] * d_pooled
        d_alpha = (h * d_pooled).sum(1)
        d_score = alpha * (d_alpha - run_sums(alpha * d_alpha, of_text)[text])
        g["w"] = (t * s).T @ d_score
        d_t = d_score[:, None] * p["w"] * s * (1 - t * t)
        d_s = d_score[:, None] * p["w"] * t * s * (1 - s)
        g["V"], g["U"] = h.T @ d_t, h.T @ d_s
        d_h += d_t @ p["V"].T + d_s @ p["U"].T
        d_pre = d_h * (1 - h * h)
        g["W"], g["c"] = x.T @ d_pre, d_pre.sum(0)
        return g, (d_pre @ p["W"].T)[:, :EMBEDDING]


class Model:
    """A trained network, or a constant where there was nothing to learn from."""

    def __init__(self, network: Network | None, constant: float = 0.0):
        self.network, self.constant = network, constant

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.network is None or not len(texts):
            return np.full(len(texts), self.constant)
        bags = Bags(texts)
        per_word = self.network.p["E"][bags.bucket]
        mean = run_sums(per_word[bags.at], bags.bounds) / bags.size[:, None]
        logits, _ = self.network.forward(mean, bags.shape, bags.of_text)
        return sigmoid(logits.astype(np.float64))

    def attention(self, text: str) -> np.ndarray:
        """The weights of a text's passages."""
        bags = Bags(pa.array([text], pa.large_string()))
        mean = run_sums(self.network.p["E"][bags.bucket][bags.at], bags.bounds) / bags.size[:, None]
        return self.network.forward(mean, bags.shape, bags.of_text)[1][4]


def fit(rows: list[tuple[str, int]], epochs: int = 12, seed: int = 0, batch: int = 32, rate: float = 0.01) -> Model:
    """A model from (text, label) rows."""
    y = np.array([label for _, label in rows], np.int64)
    if not len(y) or y.min() == y.max():
        return Model(None, float(y.mean()) if len(y) else 0.0)
    rows = [*rows, *[("", 0)] * (1 + len(rows) // 50)]
    y = np.array([label for _, label in rows], np.int64)
    bags = Bags(pa.array([t for t, _ in rows], pa.large_string()))
    rng = np.random.default_rng(seed)
    network = Network(seed)
    adam = Adam(network.p, rate)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    epochs = max(epochs, STEPS * batch // len(y))
    for epoch in range(epochs):
        adam.rate = rate * (1 - epoch / epochs) + rate / 20
        order = rng.permutation(len(y))
        for i in range(0, len(order), batch):
            texts = order[i : i + batch]
            passages = np.concatenate([np.arange(bags.of_text[k], bags.of_text[k + 1]) for k in texts])
            of_text = np.concatenate([[0], np.cumsum(bags.of_text[texts + 1] - bags.of_text[texts])])
            places = np.concatenate([np.arange(bags.bounds[k], bags.bounds[k + 1]) for k in passages])
            bounds = np.concatenate([[0], np.cumsum(bags.bounds[passages + 1] - bags.bounds[passages])])
            bucket = bags.bucket[bags.at[places]]
            size = bags.size[passages][:, None]
            mean = run_sums(network.p["E"][bucket], bounds) / size
            logits, kept = network.forward(mean, bags.shape[passages], of_text)
            error = ((sigmoid(logits) - y[texts]) * weight[texts] / len(texts)).astype(np.float32)
            grads, d_mean = network.backward(error, kept, of_text)
            grads = {k: g + 1e-4 * network.p[k] for k, g in grads.items()}
            grads["E"] = 1e-4 * network.p["E"]
            np.add.at(grads["E"], bucket, np.repeat(d_mean / size, np.diff(bounds), axis=0))
            adam.step(grads)
    return Model(network)


def trained(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """A model from labelled rows outside fold 2 of 4 of crc32(doc_id)."""
    return fit(list(labelled_sample(docs, labels, "quality", 4, 2, per_class)))


def quality_scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text", 2_000_000):
                scores = shared.value.scores(whole_texts(rows.column("text")))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return rows.mapInArrow(score, "doc_id long, score double").select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted")
    )
