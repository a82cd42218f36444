"""Segments and the encoder against the libraries on whole texts, where marks, lines and odd white space meet words."""

import public_tokenizers
import pyarrow as pa
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestar.llm.segments import json_encoder, segments

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)
SPLIT = regex.compile(public_tokenizers.PATTERN)

BITS = st.sampled_from(
    [*"abzAZ019éß×÷ñ中_ .,;:!?#$%&*'\"()-<|>\n\n\r\t\x0b\x1c\x85\xa0 　", " ", " ", "\n", "\r\n", " word", "it's", "Qué", "été"]
    + ["<|endoftext|>", "....", ".....", "$$$$$$", ".\n", ",\n\n", "́", "🙂", "퟿"]
)
TEXTS = st.lists(st.lists(BITS, max_size=14).map("".join), max_size=6)


@settings(max_examples=1500, deadline=None)
@given(TEXTS)
def test_ids_are_those_of_whole_texts(texts):
    ids, ends = json_encoder(PATH)(pa.array(texts, pa.large_string()), 7)
    got = [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)]
    assert got == [[*WHOLE.encode(t, add_special_tokens=False).ids, 7] for t in texts]


@settings(max_examples=1500, deadline=None)
@given(TEXTS)
def test_pre_tokens_never_cross_segments(texts):
    pool, at, bounds = segments(pa.array(texts, pa.large_string()))
    for text, a, b in zip(texts, bounds, bounds[1:], strict=False):
        own = [pool[k] for k in at[a:b]]
        assert "".join(own) == text
        assert [w for s in own for w in SPLIT.findall(s)] == SPLIT.findall(text)


def test_slices_of_longer_arrays_keep_their_own_texts():
    texts = pa.array(["one two, three.\nFour", "", "five. six", "a\nb\nc d!"] * 50, pa.large_string())
    pool, at, bounds = segments(texts.slice(1, 3))
    assert ["".join(pool[k] for k in at[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)] == texts.slice(1, 3).to_pylist()
