"""Small document tables with the awkward cases: nulls, empty and very long texts, ties, repeated rows, more columns."""

import random

import pytest

from lodestar.llm.common import cleared

AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from the old house."),
    (2, ""),
    (3, None),
    (None, "a text whose id is missing"),
    (4, "  two  spaces   three\n\nlines\tand\r\ntabs   wide　space  "),
    (5, "été — naïve café's   don't 12345 <|endoftext|> $$$ <b>bold</b> \x00\x1c end"),
    (5, "été — naïve café's   don't 12345 <|endoftext|> $$$ <b>bold</b> \x00\x1c end"),
    (6, "word " * 30_000),
    (7, "🙂🙂 emoji 漢字 かな 한국어 " * 50),
    (8, "x" * 50_000),
    (9, " "),
    (10, "\n\n\n"),
]


@pytest.fixture(scope="session")
def awkward_rows():
    return AWKWARD


@pytest.fixture(scope="session")
def awkward(spark):
    """The awkward rows with extra columns whose names could clash with an operator's own."""
    rows = [(i, t, "en", "src0", n, "x", 0) for n, (i, t) in enumerate(AWKWARD)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _q_text string, score long"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def prose():
    """A maker of invented sentences from a seed."""

    def make(n: int, seed: int, words: str = "the of and river stone walks under green light tower seven bridges") -> str:
        rng = random.Random(seed)
        return " ".join(rng.choice(words.split()) + rng.choice(["", "s", "ed", ","]) for _ in range(n))

    return make


@pytest.fixture(scope="session", autouse=True)
def no_scratch_left(spark):
    yield
    cleared(spark)
