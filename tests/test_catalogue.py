"""Every query of the catalogue against DuckDB on small tables, and the bench's cases."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from lodestar import catalogue
from lodestar.benchmark import cases, measured

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in catalogue.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def ordered(columns, rows):
    places = sorted(range(len(columns)), key=lambda i: columns[i])
    key = lambda r: [(v is None, v if v is not None else 0) for v in r]
    return sorted((tuple(r[i] for i in places) for r in rows), key=key)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_same_as_duckdb(spark, duck, name):
    frame = catalogue.queries()[name](spark, SF)
    other = duck.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in other.description]
    assert sorted(frame.columns) == sorted(columns)
    assert ordered(frame.columns, map(tuple, frame.collect())) == ordered(columns, other.fetchall())
    names = {"BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}
    assert {d[0]: names[str(d[1])] for d in other.description} == dict(frame.dtypes)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.queries()) <= set(entry.queries())


def test_benchmark_cases_agree_without_pruning(spark):
    found = measured(spark, 20_000)
    assert [f[0] for f in found] == list(cases(20_000)) and all(f[4] for f in found)
    assert {f[0]: f[3] for f in found}["selective_range"] == 399


def test_saved_table_is_read_back_whole(spark, duck):
    """Every row of every row group, with the saved values of all columns."""
    got = catalogue.queries()["table_save_attach"](spark, SF)
    columns = [d[0] for d in duck.execute("SELECT * FROM orders LIMIT 0").description]
    assert got.columns == [*columns, "price"]
    rows = got.collect()
    assert sorted(r.o_orderkey for r in rows) == [k for (k,) in duck.execute("SELECT o_orderkey FROM orders ORDER BY 1").fetchall()]
    assert all(r.o_totalprice == r.price for r in rows)


SORTED = ["sort_asc", "sort_desc", "sort_nulls_first", "sort_nulls_last", "sort_multi", "sort_unselected", "sort_alias", "sort_ordinal", "sort_agg", "distinct_order", "distinct_order_unselected"]


@pytest.mark.parametrize("name", SORTED)
def test_sorts_return_every_row_in_order(spark, duck, name):
    """As many rows as without an order, and in the order that DuckDB gives them."""
    unsorted = catalogue.QUERIES[name][0].split(" ORDER BY ")[0]
    got = catalogue.queries()[name](spark, SF).collect()
    assert len(got) == duck.execute(f"SELECT count(*) FROM ({unsorted})").fetchone()[0]
    assert [tuple(r) for r in got] == duck.execute(catalogue.oracle_sql()[name]).fetchall()


@pytest.mark.parametrize("name", ["join_left", "join_right"])
def test_outer_joins_match_and_pad_at_any_key(spark, name):
    """Matched rows aren't held to the lowest customers, and some rows are padded."""
    rows = [tuple(r) for r in catalogue.queries()[name](spark, SF).collect()]
    matched = [c for c, o in rows if c is not None and o is not None]
    customers = spark.read.parquet(f"{SF}/customer.parquet").count()
    assert max(matched) >= 0.9 * customers and len(matched) < len(rows)
