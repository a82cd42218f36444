"""Harmonic bins against the rules that define them, on invented lengths."""

import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.llm.packing import Bins, Piece, packed

CAPACITY = 64


def filled(lengths, capacity=CAPACITY):
    bins, docs = Bins(capacity, 0, True), {}
    for doc_id, n in enumerate(lengths):
        docs[doc_id] = np.arange(n, dtype="<u4") + 1000 * doc_id
        raw, whole = docs[doc_id].tobytes(), n - n % capacity
        for at in range(0, whole, capacity):
            bins.close([Piece(doc_id, at, raw[4 * at : 4 * (at + capacity)], n)])
        if whole < n:
            bins.add(Piece(doc_id, whole, raw[4 * whole :], n))
    before = len(bins.out)
    bins.finish()
    return docs, bins.out, before


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3 * CAPACITY), max_size=60))
def test_every_id_lies_in_one_piece_and_no_sequence_is_padded(lengths):
    docs, rows, _ = filled(lengths)
    bins, found = {}, {}
    for doc_id, start, length, crc, total, seq, at, raw in rows:
        assert crc == zlib.crc32(raw) and len(raw) == 4 * length and total == len(docs[doc_id]) and length
        bins.setdefault(seq, []).append((at, length))
        found.setdefault(doc_id, []).append((start, raw))
    for parts in bins.values():
        end = 0
        for at, length in sorted(parts):
            assert at == end
            end += length
        assert end <= CAPACITY and end & (end - 1) == 0
    for doc_id, ids in docs.items():
        own = sorted(found[doc_id])
        ends = [start + len(raw) // 4 for start, raw in own]
        assert [start for start, _ in own] == [0, *ends[:-1]]
        assert b"".join(raw for _, raw in own) == ids.tobytes()


def test_a_bin_holds_the_number_of_rests_that_its_class_says():
    rng = random.Random(3)
    _, rows, before = filled([rng.randint(1, CAPACITY - 1) for _ in range(3000)])
    bins = {}
    for doc_id, start, length, _, total, seq, _, _ in rows[:before]:
        bins.setdefault(seq, []).append((start, length, total))
    for parts in bins.values():
        # The rests of one class come first; what follows is cut from spares.
        k = CAPACITY // parts[0][1]
        assert len(parts) >= k and all(n == total and CAPACITY // n == k for _, n, total in parts[:k])
        assert sum(n for _, n, _ in parts[k:]) < CAPACITY / (k + 1)
        assert sum(n for _, n, _ in parts) == CAPACITY


def test_documents_are_seldom_cut():
    rng = random.Random(4)
    lengths = [int(rng.lognormvariate(6.2, 1)) + 1 for _ in range(20_000)]
    _, rows, _ = filled(lengths, 1024)
    rests = sum(1 for n in lengths if n % 1024)
    beyond = sum(1 for r in rows if r[2] < 1024)
    assert beyond < 1.6 * rests
    assert sum(r[2] == 1 for r in rows) < 0.002 * len(rows)


def test_empty_texts_share_sequences(spark):
    docs = spark.range(2050).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text")).coalesce(1)
    rows = packed(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    sizes = {}
    for r in rows:
        assert (r.start, r.length, r.doc_tokens) == (0, 1, 1)
        sizes[r.sequence_id] = sizes.get(r.sequence_id, 0) + 1
    assert sorted(sizes.values())[-2:] == [1024, 1024] and sum(sizes.values()) == 2050
