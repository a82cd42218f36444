"""Texts cut, without changing any byte, at places where every pre-tokenizer of the byte-level family cuts too.

A space before a character that is not white space always begins a pre-token, so the stretches between such places can be
encoded one by one. Arrow splits and dictionary-encodes them, and each different stretch is then looked at once a slice.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CUT = re.compile(r" (?=\S)")

#: Behind a line feed that follows no white space, and before an ASCII letter or digit.
LINE = re.compile(r"(?<=\S\n)(?=[A-Za-z0-9])")

#: Marks that end words; none is part of the text of a special token.
MARKS = b".,;:!?#$%&*\n"
#: Longer runs of marks stay with their word.
MOST_MARKS = 4


def _bytes(some: Iterable[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[*some]] = True
    return out


_IS_MARK = _bytes(MARKS)
_IS_PLAIN = _bytes(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
#: First bytes of white space: ASCII, and those of U+0085, U+00A0, U+1680, U+2000 and after, U+3000.
_MAY_BE_SPACE = _bytes([*range(0x21), 0xC2, 0xE1, 0xE2, 0xE3])
#: Second bytes of the letters from U+00C0 to U+00FF.
_IS_LATIN = _bytes({*range(0x80, 0xC0)} - {0x97, 0xB7})


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``most_bytes`` of text at most; a longer text stands alone and stays whole."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    first, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most_bytes:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += n
    yield batch.slice(first)


def whole_texts(column: pa.Array) -> pa.Array:
    """Nulls as empty texts, with 64-bit offsets."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def _open_to_the_left(words: pa.Array) -> np.ndarray:
    """Which words are empty or begin with white space, so that a cut before them may not be one."""
    out = pc.binary_length(words).to_numpy(zero_copy_only=False) == 0
    _, offsets, data = words.buffers()
    if len(words) and data is not None and data.size:
        starts = np.frombuffer(offsets, np.int64)[words.offset :][: len(words)]
        first = np.frombuffer(data, np.uint8)[np.minimum(starts, data.size - 1)]
        unsure = np.flatnonzero(~out & _MAY_BE_SPACE[first])
        out[unsure] = [w[0].isspace() for w in words.take(pa.array(unsure)).to_pylist()]
    return out


def _strings(lengths: np.ndarray, data: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


def _without_marks(words: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """The words without the marks that some end with, the marks, and which words had some.

    Marks after a letter or digit are where every pre-tokenizer of the family cuts, so they are a segment by themselves.
    """
    n = len(words)
    _, offsets, data = words.buffers()
    if not n or data is None or not data.size:
        return words, words.slice(0, 0), np.zeros(n, bool)
    ends = np.frombuffer(offsets, np.int64)[words.offset : words.offset + n + 1]
    raw, begin = np.frombuffer(data, np.uint8), ends[:-1]
    run, open_ = np.zeros(n, np.int64), np.arange(n)
    for _ in range(MOST_MARKS + 1):
        last = ends[1:][open_] - 1 - run[open_]
        open_ = open_[(last > begin[open_]) & _IS_MARK[raw[np.maximum(last, 0)]]]
        run[open_] += 1
    last = ends[1:] - 1 - run
    # A letter of two bytes, of those that all editions of Unicode have.
    wide = (last > begin) & (raw[np.maximum(last - 1, 0)] == 0xC3) & _IS_LATIN[raw[np.maximum(last, 0)]]
    marked = (run > 0) & (run <= MOST_MARKS) & (_IS_PLAIN[raw[np.maximum(last, 0)]] | wide)
    run[~marked] = 0
    own = raw[ends[0] : ends[-1]]
    cut = np.zeros(len(own), bool)
    cut[gathered(ends[1:] - run - ends[0], run)] = True
    return _strings(np.diff(ends) - run, own[~cut]), _strings(run[marked], own[cut]), marked


def _lines(words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words cut behind line feeds: all first parts, then the others; how many parts each has, and where its others begin."""
    parts = np.ones(len(words), np.int64)
    rows = np.flatnonzero(pc.match_substring(words, "\n").to_numpy(zero_copy_only=False))
    cut = [LINE.split(w) for w in words.take(pa.array(rows)).to_pylist()]
    parts[rows] = [*map(len, cut)]
    others = np.cumsum(parts - 1) - (parts - 1) + len(words)
    if len(rows):
        firsts = np.zeros(len(words), bool)
        firsts[rows] = True
        heads = pc.replace_with_mask(words, pa.array(firsts), pa.array([c[0] for c in cut], words.type))
        words = pa.concat_arrays([heads, pa.array([w for c in cut for w in c[1:]], words.type)])
    return words, parts, others


def segments(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different segments, the segment number at each place, and where each text's places begin and end."""
    if not len(texts):
        return [], np.zeros(0, np.int32), np.zeros(1, np.int64)
    split = pc.split_pattern(texts, " ")
    bounds = split.offsets.to_numpy().astype(np.int64)
    bounds -= bounds[0]
    coded = pc.dictionary_encode(split.flatten())
    place = np.array(coded.indices, np.int32)
    first = np.zeros(len(place), bool)
    first[bounds[:-1]] = True
    cut, parts, others = _lines(coded.dictionary)
    bare, ending, marked = _without_marks(cut)
    stems, endings = pc.dictionary_encode(bare), pc.dictionary_encode(ending)
    n = len(stems.dictionary)
    odd_words = _open_to_the_left(coded.dictionary)
    odd = np.flatnonzero(np.add.reduceat(odd_words[place] & ~first, bounds[:-1])) if odd_words.any() else ()
    # Numbers of segments: words behind a space, words without one, marks. Each part of a word is one or two of them.
    spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), stems.dictionary, pa.scalar(" ", pa.large_string()))
    pool = pa.concat_arrays([spaced, stems.dictionary, endings.dictionary])
    number = np.array(stems.indices, np.int32)
    number[len(parts) :] += n
    per_part = marked + np.int32(1)
    flat = np.repeat(number, per_part)
    begins = np.cumsum(per_part) - per_part
    flat[begins[marked] + 1] = np.array(endings.indices, np.int32) + 2 * n
    if len(cut) > len(parts):
        # Parts lie apart; bring those of one word together.
        order = np.argsort(np.concatenate([np.arange(len(parts)), np.repeat(np.arange(len(parts)), parts - 1)]), kind="stable")
        flat = flat[gathered(begins[order], per_part[order])]
        per_word = np.add.reduceat(per_part[order], np.cumsum(parts) - parts)
    else:
        per_word = per_part
    # Numbers within a slice fit in 32 bits.
    per_word = per_word.astype(np.int32)
    begins = np.cumsum(per_word, dtype=np.int32) - per_word
    per_place = per_word[place]
    at = flat[gathered(begins[place], per_place)]
    ends = np.concatenate([[0], np.cumsum(per_place, dtype=np.int64)])
    at[ends[bounds[:-1]]] += n
    bounds = ends[bounds]
    if len(odd):
        own, runs, numbers = set(odd.tolist()), [], {}
        for i in range(len(texts)):
            if i in own:
                head, *rest = CUT.split(texts[i].as_py())
                run = [numbers.setdefault(s, len(numbers)) for s in (head, *(" " + s for s in rest))]
                runs.append(np.array(run, np.int32) + len(pool))
            else:
                runs.append(at[bounds[i] : bounds[i + 1]])
        pool = pa.concat_arrays([pool, pa.array(list(numbers), pool.type)])
        at = np.concatenate(runs)
        bounds = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
    used = np.zeros(len(pool), bool)
    used[at] = True
    renumbered = np.cumsum(used, dtype=np.int32) - 1
    return pool.filter(pa.array(used)).to_numpy(zero_copy_only=False).tolist(), renumbered[at], bounds


def gathered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every run, one run after the other."""
    ends = np.cumsum(lengths, dtype=lengths.dtype)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0, dtype=lengths.dtype)


class Encoder:
    """Encodes slices of texts; each different segment goes to ``encode`` once while it is remembered.

    Two generations of about ``remembered`` segments bound the memory; what is still in use moves to the new one.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], remembered: int):
        self.encode, self.most, self.new, self.old = encode, remembered, {}, {}

    def __call__(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids as one array, each text's closed by the id ``end`` if that is given; where each text's begin and end."""
        pool, at, bounds = segments(texts)
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}
        parts = [*map(self.new.get, pool)]
        missing = [i for i, p in enumerate(parts) if p is None]
        older = [*map(self.old.get, [pool[i] for i in missing])]
        unknown = [i for i, p in zip(missing, older, strict=True) if p is None]
        for i, p in zip(missing, older, strict=True):
            parts[i] = p
        for i, p in zip(unknown, self.encode([pool[i] for i in unknown]), strict=True):
            parts[i] = p
        self.new.update((pool[i], parts[i]) for i in missing)
        if end is not None:
            at = np.insert(at, bounds[1:], len(parts))
            bounds = bounds + np.arange(len(bounds))
            parts.append(end.to_bytes(4, "little"))
        # A slice has far fewer than 2**31 ids, so its places fit in 32 bits.
        lengths = np.fromiter(map(len, parts), np.int32, len(parts)) // 4
        flat = np.frombuffer(b"".join(parts), "<u4")
        per_place = lengths[at]
        ids = flat[gathered((np.cumsum(lengths, dtype=np.int32) - lengths)[at], per_place)]
        return ids, np.concatenate([[0], np.cumsum(per_place)])[bounds]


def _byte_symbols() -> dict[int, str]:
    """The printable symbol that byte-level tokenizers write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}


@lru_cache(2)
def json_encoder(path: str, remembered: int = 500_000) -> Encoder:
    """An Encoder by the tokenizers library and one of its byte-level files, without special tokens added.

    A worker process keeps it from task to task. Segments that hold one space, at their start, are encoded many at a
    time: a token that begins with a space is then where the next one begins. Of these, a space and letters alone are one
    pre-token, so they go to the same model in its own symbols, past the pre-tokenizer.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    from tokenizers.models import BPE
    from tokenizers.pre_tokenizers import WhitespaceSplit

    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as lines:
        model = json.load(lines)["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    # Words come to it once, so a memory of its own would only cost it time.
    bare = Tokenizer(BPE(model["vocab"], merges, cache_capacity=0))
    bare.pre_tokenizer = WhitespaceSplit()
    symbols = _byte_symbols()
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    opens = np.zeros(max(vocabulary.values()) + 1, bool)
    opens[[i for token, i in vocabulary.items() if token.startswith(symbols[32])]] = True
    spelled = symbols | {10: " "}

    def alone(texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def apart(run: Tokenizer, text: str, texts: list[str]) -> list[bytes]:
        ids = np.array(run.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        starts = np.flatnonzero(opens[ids])
        if len(starts) != len(texts) or starts[0]:
            return alone(texts)
        ends, raw = [*(4 * starts[1:]).tolist(), 4 * len(ids)], ids.tobytes()
        return [raw[a:b] for a, b in zip((4 * starts).tolist(), ends, strict=True)]

    def together(texts: list[str]) -> list[bytes]:
        return apart(tokenizer, "".join(texts), texts)

    def words(texts: list[str]) -> list[bytes]:
        return apart(bare, "\n".join(texts).encode().decode("latin-1").translate(spelled), texts)

    def encode(texts: list[str]) -> list[bytes]:
        kinds: dict[Callable, list[int]] = {words: [], together: [], alone: []}
        for i, s in enumerate(texts):
            spaced = s[:1] == " "
            how = words if spaced and s[1:].isalpha() else together if spaced and len(s) > 1 and s.count(" ") == 1 else alone
            kinds[how].append(i)
        out: list[bytes | None] = [None] * len(texts)
        for how, run in kinds.items():
            for i in range(0, len(run), 1000):
                part = run[i : i + 1000]
                for k, ids in zip(part, how([texts[k] for k in part]), strict=True):
                    out[k] = ids
        return out

    return Encoder(encode, remembered)
