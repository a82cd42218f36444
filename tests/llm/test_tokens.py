"""Token files, packing and word-wise byte-level BPE against the libraries' direct answers."""

import hashlib
import zlib
from base64 import b64decode

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestar.llm.bpe_words import bpe_digest, bpe_ids
from lodestar.llm.common import shared_path
from lodestar.llm.packing import packed, pieces
from lodestar.llm.segments import json_encoder, segments
from lodestar.llm.token_files import part_bases, read_tokens, stored_digest, write_tokens

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def direct():
    tokenizer = Tokenizer.from_file(JSON)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab '\n\t 　\x1cé1!.<|>", max_size=30), max_size=5))
def test_segments_join_back_and_encode_alike(texts):
    pool, at, bounds = segments(pa.array(texts, pa.large_string()))
    assert ["".join(pool[k] for k in at[a:b]) for a, b in zip(bounds, bounds[1:])] == texts
    tokenizer = _tokenizer()
    ids, ends = json_encoder(JSON)(pa.array(texts, pa.large_string()))
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [
        tokenizer.encode(t, add_special_tokens=False).ids for t in texts
    ]


def _tokenizer(found=[]):  # noqa: B006
    if not found:
        found.append(Tokenizer.from_file(JSON))
    return found[0]


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_match_direct_encoding(awkward, awkward_rows, direct, encoding):
    rows = stored_digest(awkward, JSON, 2, encoding).collect()
    texts = sorted(awkward_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, before = [], 0
    for doc_id, text in texts:
        ids = [*direct(text), 2]
        want.append((doc_id, before, len(ids), crc(ids)))
        before += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want


def test_token_files_selective_reads(spark, awkward, direct):
    path = shared_path(spark, "test")
    write_tokens(awkward, path, JSON, 2, row_group_bytes=1 << 16, rows_per_page=2)
    one = read_tokens(spark, path, ("doc_id", "token_ids"), 7, 7)
    plan = one._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,token_ids:array<int>>" in plan and "PushedFilters: [IsNotNull" in plan
    assert [r.doc_id for r in one.collect()] == [7]
    assert read_tokens(spark, path, ("n_tokens",)).count() == awkward.count()
    assert part_bases(spark, path).count() >= 1


def test_empty_tables(empty_docs):
    assert stored_digest(empty_docs, JSON).collect() == []
    assert packed(empty_docs, JSON).collect() == []
    assert bpe_digest(empty_docs, RANKS, public_tokenizers.PATTERN).collect() == []


@given(st.integers(0, 5000))
def test_pieces_cover_a_document(n):
    end = 0
    for at, length in pieces(n, 1024):
        assert at == end and length & (length - 1) == 0 and length <= 1024
        end += length
    assert end == n


def test_packing_places_every_id_once(awkward, awkward_rows, direct):
    rows = packed(awkward, JSON, 0, 1024, with_ids=True).collect()
    bins = {}
    for r in rows:
        assert crc(r.token_ids) == r.ids_crc32 and len(r.token_ids) == r.length
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for at, length in sorted(parts):
            assert at == end
            end += length
        assert end <= 1024 and end & (end - 1) == 0  # no sequence needs padding
    for doc_id, text in set(awkward_rows):
        want = [*direct(text), 0]
        own = sorted(((r.start, r.token_ids) for r in rows if r.doc_id == doc_id), key=lambda x: x[0])
        copies = sum(1 for row in awkward_rows if row == (doc_id, text))
        assert sum(len(x) for _, x in own) == copies * len(want)
        assert [i for _, x in own[::copies] for i in x] == want


def test_bpe_words_match_direct_encoding(awkward, awkward_rows):
    with open(RANKS, "rb") as lines:
        ranks = {b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    direct = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for doc_id, text in awkward_rows:
        ids = direct.encode_ordinary(text or "")
        want.append((doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((text or "").encode())))
    key = lambda r: (r[0] or 0, *r[1:])
    got = bpe_digest(awkward, RANKS, public_tokenizers.PATTERN)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    listed = bpe_ids(awkward, RANKS, public_tokenizers.PATTERN).collect()
    assert {(r.doc_id, bytes(r.decoded)) for r in listed} == {(i, (t or "").encode()) for i, t in awkward_rows}


def test_bpe_words_share_one_exchange(awkward):
    df = bpe_digest(awkward, RANKS, public_tokenizers.PATTERN)
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()
