"""Harmonic packing of token ids into sequences of a power-of-two capacity.

A document gives whole sequences and a rest. Rests fall into reciprocal-capacity classes: class k holds the lengths in
(capacity / (k + 1), capacity / k]. A bin of class k takes k rests, whole and one after the other, and is then closed; what
it lacks, less than capacity / (k + 1), is cut from the front of one spare rest, so that it has no padding. When the spare
is used up, the next rest becomes the spare. Documents are so cut at whole sequences, or while they are the spare.

Every worker packs on its own and holds one open bin a class, which is some 2 * sqrt(capacity) bins, and nothing else. When
its rows end, the rests in them, longest first, are laid end to end into whole sequences; what is left, less than one
sequence, is cut into powers of two, which need no padding either.

Null texts count as empty and give the end id alone; equal rows are packed as separate documents; a null doc_id is
carried along; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .segments import json_encoder, slices, whole_texts

PIECE_SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)
IDS_COLUMN = "token_ids"


def pieces(tokens: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of parts that are whole sequences, then the binary parts of the rest."""
    at = 0
    while tokens - at >= capacity:
        yield at, capacity
        at += capacity
    size = capacity >> 1
    while at < tokens:
        if tokens - at >= size:
            yield at, size
            at += size
        size >>= 1


class Piece(NamedTuple):
    """A run of one document's ids, as bytes of unsigned 32-bit numbers."""

    doc_id: int | None
    start: int
    raw: bytes
    doc_tokens: int

    def part(self, begin: int, end: int) -> Piece:
        return Piece(self.doc_id, self.start + begin, self.raw[4 * begin : 4 * end], self.doc_tokens)


def size(piece: Piece) -> int:
    return len(piece.raw) // 4


class Bins:
    """One worker's open bins, one a class, and its spare; ``out`` collects rows of PIECE_SCHEMA and, if wanted, bytes."""

    def __init__(self, capacity: int, first_id: int, with_ids: bool = False):
        self.capacity, self.next_id, self.with_ids = capacity, first_id, with_ids
        self.out: list[tuple] = []
        self.open: dict[int, list[Piece]] = {}
        #: Bins that have all their rests but found no spare to fill them up.
        self.short: list[list[Piece]] = []
        self.spare: Piece | None = None

    def close(self, rows: list[Piece]) -> None:
        at = 0
        for piece in rows:
            doc_id, start, raw, total = piece
            length = len(raw) // 4
            row = (doc_id, start, length, zlib.crc32(raw), total, self.next_id, at)
            self.out.append((*row, raw) if self.with_ids else row)
            at += length
        self.next_id += 1

    def _fill(self) -> None:
        """Close the short bins, as far as the spare goes."""
        while self.short and self.spare:
            rows, have = self.short[-1], size(self.spare)
            lack = self.capacity - sum(map(size, rows))
            rows.append(self.spare.part(0, min(lack, have)))
            self.spare = self.spare.part(lack, have) if have > lack else None
            if have >= lack:
                self.close(self.short.pop())

    def add(self, rest: Piece) -> None:
        """A rest of fewer ids than the capacity, and of one at least."""
        if self.spare is None:
            self.spare = rest
            self._fill()
            return
        k = self.capacity // size(rest)
        rows = self.open.setdefault(k, [])
        rows.append(rest)
        if len(rows) == k:
            del self.open[k]
            if sum(map(size, rows)) == self.capacity:
                self.close(rows)
            else:
                self.short.append(rows)
                self._fill()

    def finish(self) -> None:
        """Close all that is open, without padding."""
        left = [p for rows in (*self.short, *self.open.values()) for p in rows] + [self.spare] * (self.spare is not None)
        self.open, self.short, self.spare = {}, [], None
        rows, have = [], 0
        for piece in sorted(left, key=size, reverse=True):
            room = self.capacity - have
            if size(piece) < room:
                rows.append(piece)
                have += size(piece)
                continue
            self.close([*rows, piece.part(0, room)])
            rows = [piece.part(room, size(piece))] if size(piece) > room else []
            have = size(rows[0]) if rows else 0
        alike: dict[int, list[Piece]] = {}
        for piece in rows:
            for at, length in pieces(size(piece), self.capacity):
                alike.setdefault(length, []).append(piece.part(at, at + length))
        for same in alike.values():
            while same:
                n = 1 << (len(same).bit_length() - 1)
                self.close(same[:n])
                del same[:n]


def pack_batches(
    batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, capacity: int, with_ids: bool, flush: int = 20_000
) -> Iterator[pa.RecordBatch]:
    """Rows of PIECE_SCHEMA (and the ids) for one worker's documents."""
    encode = json_encoder(tokenizer)
    bins = Bins(capacity, TaskContext.get().partitionId() << 40, with_ids)
    names = [c.split()[0] for c in PIECE_SCHEMA.split(", ")]

    def flushed() -> pa.RecordBatch:
        columns, bins.out = [*zip(*bins.out, strict=True)], []
        arrays = [pa.array(c, pa.int64()) for c in columns[: len(names)]]
        if with_ids:
            ids = [np.frombuffer(raw, "<u4").astype(np.int32) for raw in columns[-1]]
            arrays.append(pa.array(ids, pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(arrays, names=names + [IDS_COLUMN] * with_ids)

    for batch in batches:
        for rows in slices(batch, "text"):
            ended, bounds = encode(whole_texts(rows.column("text")), end_id)
            raw, offsets = memoryview(ended).cast("B"), bounds.tolist()
            for doc_id, begin, end in zip(rows.column("doc_id").to_pylist(), offsets, offsets[1:], strict=False):
                total = end - begin
                whole = total - total % capacity
                for at in range(0, whole, capacity):
                    a = 4 * (begin + at)
                    bins.close([Piece(doc_id, at, bytes(raw[a : a + 4 * capacity]), total)])
                if whole < total:
                    bins.add(Piece(doc_id, whole, bytes(raw[4 * (begin + whole) : 4 * end]), total))
                # A long document alone may fill many sequences.
                if len(bins.out) >= flush:
                    yield flushed()
    bins.finish()
    if bins.out:
        yield flushed()


def packed(
    docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 1024, with_ids: bool = False
) -> DataFrame:
    """One row per piece; ``with_ids`` adds the piece's ids as a list column."""
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    schema = PIECE_SCHEMA + f", {IDS_COLUMN} array<int>" * with_ids
    return rows.mapInArrow(lambda b: pack_batches(b, tokenizer, end_id, capacity, with_ids), schema)
