"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Every figure comes from built-in expressions over one row, so there is no shuffle, no state and no Python on the
executors; a lost executor costs the re-read of its own splits.

Definitions (words are runs of non-ASCII-white-space, null text counts as empty):

* ``n_words``, ``word_chars`` (code points in words), ``n_symbols`` (characters of ``#*$%&|<>``)
* ``n_dup_lines``: lines holding a word that equal an earlier line
* ``n_repeat_words``: words covered by 5-word windows that occur twice or more in the text. Windows are compared by a
  64-bit hash of their words' 64-bit hashes.
* ``base_failed``: fewer than 10 words, or more than a fifth of the words repeated
* ``kept``: not ``base_failed`` and no rule of the table is broken

Empty and null texts have zeros throughout, fail the base rule and are not kept. Rows are judged one by one, so
repeated rows and ids give equal rows, an empty table gives an empty result, and other columns are never looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

WINDOW = 5

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that for it was on with as be at by this from or an are "
    "de la le les des et en un une du est que pour dans qui sur par au avec "
    "der die das und den von zu mit sich auf ist im dem nicht ein eine als auch "
    "el los las del se por con para su al lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """A text of at least ``min_words`` words is rejected where ``figure`` is below ``least`` or above ``most``."""

    figure: str
    least: float | None = None
    most: float | None = None
    min_words: int = 0


#: The production threshold table.
RULES = (
    Rule("chars_per_word", least=2.0, most=25.0, min_words=20),
    Rule("symbols_per_word", most=0.2),
    Rule("stop_word_ratio", least=0.01, min_words=60),
    Rule("dup_line_ratio", most=0.5),
    Rule("marked_line_ratio", most=0.9),
    Rule("capital_ratio", most=0.7, min_words=20),
    Rule("wordless_ratio", most=0.5),
)


def _hash_window(hashes: Column, length: Column) -> Column:
    def window(first: Column, at: Column) -> Column:
        return F.xxhash64(first, *(F.get(hashes, at + F.lit(k)) for k in range(1, WINDOW)))

    return F.transform(F.slice(hashes, F.lit(1), F.greatest(length - F.lit(WINDOW - 1), F.lit(0))), window)


def _covered(windows: Column) -> Column:
    """Words covered by windows that occur twice or more, from the sorted (hash, position) pairs of a text."""
    repeated = F.filter(
        windows,
        lambda x, i: F.coalesce(F.get(windows, i - 1)["h"] == x["h"], F.lit(False)) & (i > 0)
        | F.coalesce(F.get(windows, i + 1)["h"] == x["h"], F.lit(False)),
    )
    return F.sort_array(F.transform(repeated, lambda x: x["p"]))


def measured(docs: DataFrame, text: str = "text", prefix: str = "_q_") -> DataFrame:
    """``docs`` with the figures of every row as columns named ``prefix`` + figure."""
    p = lambda name: F.col(prefix + name)
    put = lambda df, **new: df.withColumns({prefix + k: v for k, v in new.items()})
    df = put(docs, text=F.coalesce(F.col(text), F.lit("")))
    df = put(
        df,
        words=F.regexp_extract_all(p("text"), F.lit(f"({WORD})"), F.lit(1)),
        lines=F.filter(F.split(p("text"), "\n"), lambda x: x.rlike(WORD)),
    )
    df = put(
        df,
        n_words=F.size(p("words")).cast("long"),
        n_lines=F.size(p("lines")).cast("long"),
        word_chars=F.aggregate(p("words"), F.lit(0).cast("long"), lambda n, w: n + F.length(w)),
        n_symbols=(F.length(p("text")) - F.length(F.translate(p("text"), "#*$%&|<>", ""))).cast("long"),
        n_dup_lines=(F.size(p("lines")) - F.size(F.array_distinct(p("lines")))).cast("long"),
        n_stop=F.size(F.filter(F.transform(p("words"), lambda w: F.lower(w)), lambda w: w.isin(STOP_WORDS))),
        n_marked=F.size(F.filter(p("lines"), lambda x: x.rlike(r"^[\x20\x09]*[-*•·>#]"))),
        n_capital=F.length(F.regexp_replace(p("text"), r"[^\p{Lu}]+", "")),
        n_letters=F.length(F.regexp_replace(p("text"), r"[^\p{L}]+", "")),
        n_wordless=F.size(F.filter(p("words"), lambda w: ~w.rlike(r"[\p{L}\p{N}]"))),
        hashes=F.transform(p("words"), lambda w: F.xxhash64(w)),
    )
    df = put(df, windows=_hash_window(p("hashes"), F.size(p("hashes"))))
    # Most texts repeat no window: one hash-set pass tells, and only the others are sorted.
    df = put(
        df,
        sorted=F.when(
            F.size(F.array_distinct(p("windows"))) < F.size(p("windows")),
            F.sort_array(F.transform(p("windows"), lambda h, i: F.struct(h.alias("h"), i.alias("p")))),
        ),
    )
    df = put(df, at=_covered(p("sorted")))
    df = put(
        df,
        n_repeat_words=F.coalesce(
            F.aggregate(
                F.transform(
                    p("at"), lambda x, i: F.coalesce(F.least(F.get(p("at"), i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))
                ),
                F.lit(0).cast("long"),
                lambda n, x: n + x,
            ),
            F.lit(0).cast("long"),
        ),
    )
    per = lambda a, b: F.coalesce(p(a) / F.nullif(p(b), F.lit(0)), F.lit(0.0))
    return put(
        df,
        chars_per_word=per("word_chars", "n_words"),
        symbols_per_word=per("n_symbols", "n_words"),
        stop_word_ratio=per("n_stop", "n_words"),
        dup_line_ratio=per("n_dup_lines", "n_lines"),
        marked_line_ratio=per("n_marked", "n_lines"),
        capital_ratio=per("n_capital", "n_letters"),
        wordless_ratio=per("n_wordless", "n_words"),
    )


def broken(rules: tuple[Rule, ...], figure, n_words: Column) -> Column:
    """The table as one boolean expression; ``figure`` gives a figure's column by name."""
    tests = []
    for r in rules:
        bad = F.lit(False)
        if r.least is not None:
            bad = bad | (figure(r.figure) < F.lit(r.least))
        if r.most is not None:
            bad = bad | (figure(r.figure) > F.lit(r.most))
        tests.append((n_words >= F.lit(r.min_words)) & bad)
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _settled(value: Column) -> Column:
    """``value``, through which no later filter is pushed.

    A filter above would otherwise be rewritten in terms of the text and evaluate every figure many times over. It stops
    at a projection that isn't a function of the row alone, such as one with a row number.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", prefix: str = "_q_") -> DataFrame:
    """``measured`` with ``prefix`` + ``base_failed`` and ``prefix`` + ``kept``."""
    df = measured(docs, text, prefix)
    p = lambda name: F.col(prefix + name)
    failed = (p("n_words") < 10) | (100 * p("n_repeat_words") > 20 * p("n_words"))
    df = df.withColumn(prefix + "base_failed", failed)
    return df.withColumn(prefix + "kept", _settled(~(p("base_failed") | broken(rules, p, p("n_words")))))


def quality_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: id, base figures, base verdict and final verdict."""
    df = judged(docs.select("doc_id", "text"), rules)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return df.select("doc_id", *(_settled(F.col("_q_" + n)).alias(n) for n in names))


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the table keeps, with their own columns and no others."""
    prefix = "_q_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    return judged(docs, rules, text, prefix).filter(F.col(prefix + "kept")).select(*docs.columns)
