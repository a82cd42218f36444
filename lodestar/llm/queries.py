"""The registered queries of this package and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import quality_classifier
from .bpe_words import bpe_digest
from .common import table
from .html_extract import extracted
from .jaccard_join import near_duplicates
from .media import media_round_trip
from .packing import packed
from .quality_rules import RULES, STOP_WORDS, quality_report
from .token_files import stored_digest
from .toxicity import toxicity_scores, trained
from .url_filter import url_verdicts


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures and verdicts of every document."""
    return quality_report(table(spark, sf_dir, "documents"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from the labelled ones outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.quality_scores(docs, quality_classifier.trained(docs, table(spark, sf_dir, "labels")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the labelled ones outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return toxicity_scores(docs, trained(docs, table(spark, sf_dir, "labels")))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written in order of doc_id and read back."""
    return stored_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extracted(table(spark, sf_dir, "pages"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored in a media container and read back."""
    return media_round_trip(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all page URLs."""
    return url_verdicts(table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 ids."""
    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op10_bpe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by ranks and decoded again."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe_digest(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_toxicity": op2_toxicity,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_token_files": op4_token_files,
    "op5_html_extract": op5_html_extract,
    "op6_media": op6_media,
    "op7_url_filter": op7_url_filter,
    "op8_quality_rules": op8_quality_rules,
    "op9_packing": op9_packing,
    "op10_bpe_words": op10_bpe_words,
}

_W = r"[^\x20\x09-\x0D]+"


def _rules_sql() -> str:
    """The threshold table as DuckDB SQL."""
    tests = []
    for r in RULES:
        bad = [f"{r.figure} < {r.least}"] if r.least is not None else []
        bad += [f"{r.figure} > {r.most}"] if r.most is not None else []
        tests.append(f"(n_words >= {r.min_words} AND ({' OR '.join(bad)}))")
    return " OR ".join(tests)


OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '{_W}') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_W}')) AS ls
  FROM d
),
grams AS (
  SELECT rid, pos, ws[pos:pos + 4] AS gram FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS pos FROM w)
),
marked AS (SELECT rid, pos, count(*) OVER (PARTITION BY rid, gram) > 1 AS again FROM grams),
covered AS (
  SELECT rid, count(DISTINCT pos + k) AS n FROM marked, (SELECT unnest(range(0, 5)) AS k) WHERE again GROUP BY rid
),
f AS (
  SELECT doc_id, len(ws) AS n_words,
    CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
    len(list_filter(ws, lambda x: list_contains({STOP_WORDS!r}, lower(x)))) AS n_stop,
    len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•·>#]'))) AS n_marked,
    length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) AS n_capital,
    length(regexp_replace(t, '[^\\p{{L}}]+', '', 'g')) AS n_letters,
    len(list_filter(ws, lambda x: NOT regexp_matches(x, '[\\p{{L}}\\p{{N}}]'))) AS n_wordless
  FROM w LEFT JOIN covered USING (rid)
),
r AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    coalesce(word_chars / nullif(n_words, 0), 0) AS chars_per_word,
    coalesce(n_symbols / nullif(n_words, 0), 0) AS symbols_per_word,
    coalesce(n_stop / nullif(n_words, 0), 0) AS stop_word_ratio,
    coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_ratio,
    coalesce(n_marked / nullif(n_lines, 0), 0) AS marked_line_ratio,
    coalesce(n_capital / nullif(n_letters, 0), 0) AS capital_ratio,
    coalesce(n_wordless / nullif(n_words, 0), 0) AS wordless_ratio
  FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR {_rules_sql()}) AS kept
FROM r
"""

ORACLE_SQL: dict[str, str] = {
    "op8_quality_rules": OP8_SQL,
}
