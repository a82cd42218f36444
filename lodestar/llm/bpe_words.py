"""Byte-level BPE by a global shuffle of distinct words, and decoding by the token-byte table.

1. A task explodes its documents into pre-tokens. For each block of texts it keeps the block's distinct words once and,
   in place of each occurrence, the word's number in the block; a document's numbers in order are its positions. The
   words are dealt out by hash, a packed list for each (block, bucket).
2. A bucket's task meets every block's words of that bucket, encodes each distinct word once by its byte ranks, and
   sends the ids back to the blocks.
3. A block joins ids to its numbers, puts the documents together by position, and decodes through the table of token
   bytes, which is as large as the vocabulary.

A common word costs one entry a block, never one a use, so no word makes a hot key. A block is bounded by
``BLOCK_BYTES`` of text (a longer text is a block of its own), and blocks are never larger for larger inputs. One
exchange serves both the words and the positions; blocks are named by task and order, which a re-run task repeats.

Null texts count as empty: no ids, no bytes. Repeated rows and ids give a row each, null ids are carried along, other
columns are ignored, an empty table gives an empty result. Special tokens in a text are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .segments import gathered, segments, slices, whole_texts

BLOCK_BYTES = 16 << 20
CHUNK_BYTES = 1 << 20

#: key deals rows out: the bucket for words (block set), the block for positions (block null).
ROW_SCHEMA = "key long, block long, bucket int, doc_ids array<long>, lengths array<long>, payload binary"
IDS_SCHEMA = "key long, bucket int, payload binary"
RESULT_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def packed_numbers(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as compressed byte planes; small ones leave empty planes."""
    planes = np.ascontiguousarray(numbers.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpacked_numbers(payload: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def packed_words(words: list[bytes]) -> bytes:
    lengths = np.array([len(w) for w in words], "<u4").tobytes()
    head = len(words).to_bytes(8, "little")
    return zstandard.ZstdCompressor(level=1).compress(head + lengths + b"".join(words))


def unpacked_words(payload: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    n = int.from_bytes(raw[:8], "little")
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 8), dtype=np.int64)
    body = raw[8 + 4 * n :]
    return [body[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)] if n else []


def packed_lists(lists: list[list[int]]) -> bytes:
    lengths = np.array([len(x) for x in lists], "<u4")
    flat = np.array([i for x in lists for i in x], "<u4")
    return len(lists).to_bytes(8, "little") + packed_numbers(np.concatenate([lengths, flat]))


def unpacked_lists(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, numbers = int.from_bytes(payload[:8], "little"), unpacked_numbers(payload[8:])
    return numbers[:n].astype(np.int64), numbers[n:]


class Block:
    """The distinct words of a run of texts and their numbers at each position."""

    def __init__(self, number: int, buckets: int):
        self.number, self.buckets, self.bytes = number, buckets, 0
        self.words: dict[str, int] = {}
        self.known: dict[str, bytes] = {}
        self.runs: list[tuple[list, np.ndarray, np.ndarray]] = []

    def add(self, rows: pa.RecordBatch, split) -> None:
        texts = whole_texts(rows.column("text"))
        self.bytes += texts.nbytes
        pool, at, bounds = segments(texts)
        words, known = self.words, self.known
        for s in pool:
            if s not in known:
                known[s] = np.array([words.setdefault(w, len(words)) for w in split(s)], "<u4").tobytes()
        parts = [known[s] for s in pool]
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        flat = np.frombuffer(b"".join(parts), "<u4")
        per_place = lengths[at]
        numbers = flat[gathered((np.cumsum(lengths) - lengths)[at], per_place)]
        ends = np.concatenate([[0], np.cumsum(per_place)])[bounds]
        self.runs.append((rows.column("doc_id").to_pylist(), np.diff(ends), numbers))

    def rows(self) -> Iterator[tuple]:
        counts = sum((np.bincount(n, minlength=len(self.words)) for _, _, n in self.runs), np.zeros(len(self.words)))
        raw = [w.encode() for w in self.words]
        bucket = np.fromiter((zlib.crc32(w) % self.buckets for w in raw), np.int64, len(raw))
        # Within a bucket words are sent in order of use, and numbers follow the same order.
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(raw), np.int64)
        rank[order] = np.arange(len(raw))
        by_bucket = order[np.argsort(bucket[order], kind="stable")]
        cuts = np.searchsorted(bucket[by_bucket], np.arange(self.buckets + 1))
        for b in range(self.buckets):
            own = by_bucket[cuts[b] : cuts[b + 1]]
            if len(own):
                ranks = packed_numbers(rank[own])
                payload = len(ranks).to_bytes(8, "little") + ranks + packed_words([raw[i] for i in own.tolist()])
                yield b, self.number, b, None, None, payload
        for ids, lengths, numbers in self.runs:
            ends = np.cumsum(lengths)
            i = 0
            while i < len(ids):
                start = int(ends[i] - lengths[i])
                j = max(i + 1, int(np.searchsorted(ends, start + CHUNK_BYTES // 4, side="right")))
                payload = packed_numbers(rank[numbers[start : int(ends[j - 1])]])
                yield self.number, None, -1, ids[i:j], lengths[i:j].tolist(), payload
                i = j


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
    )


_ROWS = pa.schema(
    [
        ("key", pa.int64()),
        ("block", pa.int64()),
        ("bucket", pa.int32()),
        ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())),
        ("payload", pa.binary()),
    ]
)
_IDS = pa.schema([("key", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary())])


def exploded(batches: Iterator[pa.RecordBatch], pattern: str, buckets: int) -> Iterator[pa.RecordBatch]:
    """Step 1 for one task."""
    import regex

    split = regex.compile(pattern).findall
    made, block = 0, None
    for batch in batches:
        for rows in slices(batch, "text", 2_000_000):
            if block is None:
                block = Block((TaskContext.get().partitionId() << 32) + made, buckets)
                made += 1
            block.add(rows, split)
            if block.bytes >= BLOCK_BYTES:
                yield _batch(list(block.rows()), _ROWS)
                block = None
    if block is not None:
        yield _batch(list(block.rows()), _ROWS)


@lru_cache(2)
def byte_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ids, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(2)
def _coder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=byte_ranks(path), special_tokens={})._core_bpe


def encoded_words(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """Step 2 for one task: every distinct word goes through the ranks once."""
    encode, known = _coder(path, pattern).encode_single_piece, {}
    for batch in batches:
        for row in batch.to_pylist():
            size = int.from_bytes(row["payload"][:8], "little")
            ranks, words = row["payload"][8 : 8 + size], unpacked_words(row["payload"][8 + size :])
            lists = []
            for w in words:
                if (ids := known.get(w)) is None:
                    ids = known[w] = encode(w)
                lists.append(ids)
            payload = size.to_bytes(8, "little") + ranks + packed_lists(lists)
            yield _batch([(row["block"], row["bucket"], payload)], _IDS)


def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table by id: all bytes, starts, lengths."""
    table = {i: b for b, i in byte_ranks(path).items()}
    parts = [table.get(i, b"") for i in range(max(table) + 1)]
    lengths = np.array([len(p) for p in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(lengths) - lengths, lengths


def reassembled(positions: pa.Table, words: pa.Table, path: str) -> Iterator[tuple[list, list, list, list]]:
    """Step 3 for one block: (doc ids, ids of each, bytes of each as arrays) a chunk of documents at a time."""
    rank_parts, length_parts, id_parts = [], [], []
    for payload in words.column("payload").to_pylist():
        size = int.from_bytes(payload[:8], "little")
        rank_parts.append(unpacked_numbers(payload[8 : 8 + size]).astype(np.int64))
        lengths, ids = unpacked_lists(payload[8 + size :])
        length_parts.append(lengths)
        id_parts.append(ids)
    empty = np.zeros(0, np.int64)
    ranks, lengths = np.concatenate([empty, *rank_parts]), np.concatenate([empty, *length_parts])
    flat = np.concatenate([np.zeros(0, "<u4"), *id_parts])
    word_start, word_length = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
    word_start[ranks], word_length[ranks] = np.cumsum(lengths) - lengths, lengths
    raw, byte_start, byte_length = token_bytes(path)
    for row in positions.select(["doc_ids", "lengths", "payload"]).to_pylist():
        numbers = unpacked_numbers(row["payload"]).astype(np.int64)
        per_place = word_length[numbers]
        ids = np.ascontiguousarray(flat[gathered(word_start[numbers], per_place)]).astype("<u4")
        ends = np.concatenate([[0], np.cumsum(per_place)])[np.concatenate([[0], np.cumsum(row["lengths"])]).astype(int)]
        per_id = byte_length[ids]
        body = raw[gathered(byte_start[ids], per_id)]
        cuts = np.concatenate([[0], np.cumsum(per_id)])[ends]
        yield row["doc_ids"], ids, ends.tolist(), body, cuts.tolist()


def _digested(positions: pa.Table, words: pa.Table, path: str) -> pa.Table:
    out: list[tuple] = []
    for doc_ids, ids, ends, body, cuts in reassembled(positions, words, path):
        id_raw, text_raw = memoryview(ids).cast("B"), memoryview(body).cast("B")
        for i, doc_id in enumerate(doc_ids):
            a, b = ends[i], ends[i + 1]
            out.append(
                (
                    doc_id,
                    b - a,
                    hashlib.sha256(id_raw[4 * a : 4 * b]).hexdigest(),
                    hashlib.sha256(text_raw[cuts[i] : cuts[i + 1]]).hexdigest(),
                )
            )
    columns = zip(*out, strict=True) if out else ([], [], [], [])
    types = (pa.int64(), pa.int64(), pa.string(), pa.string())
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _listed(positions: pa.Table, words: pa.Table, path: str) -> pa.Table:
    out = []
    for doc_ids, ids, ends, body, cuts in reassembled(positions, words, path):
        for i, doc_id in enumerate(doc_ids):
            out.append((doc_id, ids[ends[i] : ends[i + 1]].astype(np.int32), body[cuts[i] : cuts[i + 1]].tobytes()))
    columns = zip(*out, strict=True) if out else ([], [], [])
    types = (pa.int64(), pa.list_(pa.int32()), pa.binary())
    return pa.table(
        [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "token_ids", "decoded"]
    )


def _blocks(docs: DataFrame, path: str, pattern: str, finish, schema: str) -> DataFrame:
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    dealt = rows.mapInArrow(lambda b: exploded(b, pattern, n), ROW_SCHEMA).repartition(n, "key")
    # A filter that isn't a function of the row alone stays above the exchange, which both sides then share.
    stays = F.rand(0) >= 0
    words = dealt.filter(stays & (F.col("bucket") >= 0)).mapInArrow(
        lambda b: encoded_words(b, path, pattern), IDS_SCHEMA
    )
    positions = dealt.filter(stays & (F.col("bucket") < 0))
    return (
        positions.groupBy("key")
        .cogroup(words.groupBy("key"))
        .applyInArrow(lambda left, right: finish(left, right, path), schema)
    )


def bpe_digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: the number of ids and the digests of ids and of decoded bytes."""
    return _blocks(docs, path, pattern, _digested, RESULT_SCHEMA)


def bpe_ids(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, token_ids and the decoded bytes."""
    return _blocks(docs, path, pattern, _listed, "doc_id long, token_ids array<int>, decoded binary")
