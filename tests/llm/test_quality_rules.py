"""Quality rules against plain Python, and against their SQL."""

import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestar.llm.quality_rules import quality_filter, quality_report
from lodestar.llm.queries import ORACLE_SQL

MORE = [
    (20, "a b c d e f a b c d e f g h i j k l m n"),
    (21, "one line here\none line here\n \none line here\nanother line"),
    (22, "x y " * 40),
    (23, "#tag * $ % & | < > text with symbols and nothing else to see here at all"),
    (24, "\x0b\x0c\r tabs\tand\x1cseparators \x85 next line\xa0space ten words here now ok yes"),
    (25, "THE WHOLE TEXT IS IN CAPITALS AND SHOUTS AT EVERY READER WHO PASSES BY IT TODAY OR TOMORROW AGAIN AND MORE"),
]


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(grams)
    again = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(5)}
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    failed = len(words) < 10 or 100 * len(again) > 20 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(again), failed


@pytest.fixture(scope="module")
def rows(awkward_rows):
    return awkward_rows + MORE


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, 7, "z") for i, t in rows], "doc_id long, text string, n_words int, _q_kept string")


def test_figures_match_plain_python(docs, rows):
    got = quality_report(docs).collect()
    key = lambda r: (r[0] or 0, *r[1:7])
    assert sorted((tuple(r)[:7] for r in got), key=key) == sorted(((i, *plain(t)) for i, t in rows), key=key)
    assert all(not (r.kept and r.base_failed) for r in got)
    assert {r.doc_id: r.kept for r in got}[25] is False and {r.doc_id: r.kept for r in got}[1] is True


def test_sql_gives_the_same(docs, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, t in rows])
    want = con.execute(ORACLE_SQL["op8_quality_rules"]).fetchall()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, quality_report(docs).collect()), key=key) == sorted(want, key=key)


def test_filter_keeps_columns_and_good_rows(docs):
    kept = quality_filter(docs)
    assert kept.columns == docs.columns
    good = {r.doc_id for r in quality_report(docs).filter("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == good


def test_no_python_and_no_exchange(docs):
    plan = quality_report(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def test_empty_table(empty_docs):
    assert quality_report(empty_docs).collect() == [] and quality_filter(empty_docs).select(F.col("lang")).collect() == []
