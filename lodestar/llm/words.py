"""Words of many texts as numbers, and vectorised hashes of the words' bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .segments import gathered


def mixed(x: np.ndarray) -> np.ndarray:
    """A scramble of 64-bit numbers."""
    x = x + np.uint64(0x632BE59BD9B4E019)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def coded_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words (runs of non-ASCII-white-space), the word at each place, and each text's first place and end."""
    n = len(texts)
    spaced = texts
    for other in "\t\n\v\f\r":
        spaced = pc.replace_substring(spaced, other, " ")
    split = pc.split_pattern(spaced, " ")
    coded = pc.dictionary_encode(split.flatten())
    at = coded.indices.to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(n), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))
    words = coded.dictionary
    filled = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0 if len(words) else np.zeros(0, bool)
    keep = filled[at] if len(at) else np.zeros(0, bool)
    return words, at[keep], np.concatenate([[0], np.cumsum(np.bincount(owner[keep], minlength=n))]).astype(np.int64)


def word_bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the words one after the other, and where each word's begin and end."""
    words = pa.concat_arrays([words, pa.array([], words.type)]) if words.offset else words
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    buffers, offsets = words.buffers(), np.frombuffer(words.buffers()[1], np.int64)[words.offset :]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    begin = int(offsets[0]) if len(offsets) else 0
    return data[begin : begin + int(ends[-1])], ends


def word_hashes(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash a word."""
    place = gathered(np.zeros(len(ends) - 1, np.int64), np.diff(ends)).astype(np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(place * np.uint64(256) + data), dtype=np.uint64)])
    return mixed(total[ends[1:]] - total[ends[:-1]])


def char_grams(data: np.ndarray, ends: np.ndarray, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the byte n-grams of every word with its edges marked, and the word that each belongs to."""
    n = len(ends) - 1
    lengths = np.diff(ends)
    wide_ends = ends + 2 * np.arange(n + 1)
    wide = np.full(int(wide_ends[-1]), 2, np.uint64)
    wide[wide_ends[:-1]] = 1
    wide[gathered(wide_ends[:-1] + 1, lengths)] = data
    owner = np.repeat(np.arange(n), lengths + 2)
    hashes, owners = [], []
    for size in sizes:
        if len(wide) < size:
            continue
        code = np.zeros(len(wide) - size + 1, np.uint64)
        for k in range(size):
            code = code * np.uint64(257) + wide[k : len(wide) - size + 1 + k]
        inside = owner[: len(code)] == owner[size - 1 :]
        hashes.append(mixed(code[inside] + np.uint64(size << 56)))
        owners.append(owner[: len(code)][inside])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes, owners = np.concatenate(hashes), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return hashes[order], owners[order]


def run_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of runs of rows; empty runs give zeros."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]), values.dtype)
    filled = np.flatnonzero(np.diff(bounds) > 0)
    if len(filled):
        out[filled] = np.add.reduceat(values, bounds[:-1][filled], axis=0)
    return out


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, left_out: int, per_class: int
) -> Iterator[tuple[str, int]]:
    """(text, label) of at most ``per_class`` labelled rows a class, without those of the fold that is left out.

    Rows are picked in the order of a hash of their id, so the sample doesn't depend on how tables are cut or ordered.
    Only the picked ids, a number bounded by ``per_class``, are broadcast. An id that is labelled more than once counts once,
    as 1 if any of its labels is 1; of several texts of one id the least is taken.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    usable = labels.select("doc_id", F.col(label).cast("int").alias("_label")).filter(
        F.col("doc_id").isNotNull() & F.col("_label").isin(0, 1) & (fold != left_out)
    ).groupBy("doc_id").agg(F.max("_label").alias("_label"))
    picked = None
    for k in (0, 1):
        one = usable.filter(F.col("_label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = one if picked is None else picked.union(one)
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    rows = (
        texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("_text").alias("t"), F.max("_label").alias("y"))
    )
    found = sorted((r.doc_id, r.t, r.y) for r in rows.collect())
    return ((t, y) for _, t, y in found)


class Adam:
    """Adam over a dict of arrays, changed in place."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.steps = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.steps += 1
        fix = np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.params[k] -= (self.rate * fix * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
