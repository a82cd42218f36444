"""Named queries, one for each thing the engine can do, over the star-schema tables, with DuckDB equivalents.

The first text of each entry is in the engine's dialect, where whole numbers are INT64 and others FLOAT64, ``/`` is always
a float division, and a zero divisor gives NULL; the second says the same in DuckDB. NULLs are made within queries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import Session

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

NQ = "CASE WHEN l_quantity > 25 THEN l_quantity END"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


#: name: (engine's SQL, DuckDB's SQL or None where both read alike)
QUERIES: dict[str, tuple[str, str | None]] = {
    # Scan, projection, wildcards
    "scan_project": ("SELECT n_nationkey, n_name FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation"),
    "scan_wildcard": ("SELECT * FROM region", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region"),
    "qualified_wildcard": (
        "SELECT n.* FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey",
        "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey",
    ),
    "select_no_from": (
        "SELECT 1 + 1 AS a, CAST('7' AS INT) * 2 AS b, 'it''s' AS c, TRUE AS d, 1.5 AS e",
        "SELECT CAST(2 AS BIGINT) AS a, CAST(14 AS BIGINT) AS b, 'it''s' AS c, true AS d, CAST(1.5 AS DOUBLE) AS e",
    ),
    # Predicates
    "filter_range": ("SELECT l_orderkey, l_quantity, l_discount FROM lineitem WHERE l_quantity > 45 AND l_discount <= 0.05", None),
    "filter_literal_left": ("SELECT l_orderkey, l_quantity FROM lineitem WHERE 45 < l_quantity", None),
    "filter_not_equal": ("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'", None),
    "filter_or_not": ("SELECT l_orderkey, l_quantity FROM lineitem WHERE NOT (l_quantity < 10 OR l_quantity > 40)", None),
    "filter_between": ("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20", None),
    "filter_not_between": ("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity NOT BETWEEN 10 AND 20", None),
    "filter_in": ("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O')", None),
    "filter_not_in": ("SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F', 'O')", None),
    "in_with_null": ("SELECT count(*) AS n FROM orders WHERE o_orderstatus IN ('F', NULL)", None),
    "not_in_with_null": ("SELECT count(*) AS n FROM orders WHERE o_orderstatus NOT IN ('F', NULL)", None),
    "like_prefix": ("SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'a%'", None),
    "like_infix": ("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%an%'", None),
    "like_underscore": ("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '_a%'", None),
    "not_like": ("SELECT p_partkey FROM part WHERE p_name NOT LIKE '%a%'", None),
    "like_column_pattern": ("SELECT n_name FROM nation WHERE n_name LIKE n_name", None),
    "is_null": (f"SELECT count(*) AS n FROM lineitem WHERE ({NQ}) IS NULL", None),
    "is_not_null": (f"SELECT count(*) AS n FROM lineitem WHERE ({NQ}) IS NOT NULL", None),
    "three_valued_and": (f"SELECT count(*) AS n FROM lineitem WHERE ({NQ}) > 30 AND l_discount > 0.05", None),
    "three_valued_or": (f"SELECT count(*) AS n FROM lineitem WHERE ({NQ}) > 30 OR l_discount > 0.05", None),
    "three_valued_not": (f"SELECT count(*) AS n FROM lineitem WHERE NOT (({NQ}) > 30)", None),
    "compare_with_null": ("SELECT count(*) AS n FROM lineitem WHERE l_quantity = NULL", None),
    # Arithmetic
    "arith_int": ("SELECT o_orderkey * 2 + 1 AS a, o_orderkey - 7 AS b FROM orders", None),
    "arith_float": ("SELECT l_quantity * 1.5 AS a, l_quantity + 0.25 AS b FROM lineitem", "SELECT l_quantity * 1.5e0 AS a, l_quantity + 0.25e0 AS b FROM lineitem"),
    "arith_mixed": ("SELECT l_orderkey + l_discount AS a FROM lineitem", None),
    "div_int": ("SELECT o_orderkey, o_orderkey / 7 AS q FROM orders", None),
    "div_zero": ("SELECT o_orderkey, o_orderkey / (o_orderkey - o_orderkey) AS q FROM orders", "SELECT o_orderkey, CAST(NULL AS DOUBLE) AS q FROM orders"),
    "mod": ("SELECT o_orderkey % 7 AS a, (3 - o_orderkey) % 5 AS b FROM orders", None),
    "mod_zero": ("SELECT o_orderkey, o_orderkey % 0 AS m FROM orders", "SELECT o_orderkey, CAST(NULL AS BIGINT) AS m FROM orders"),
    "unary_minus": ("SELECT -l_quantity AS a, - -l_orderkey AS b, +l_discount AS c FROM lineitem", "SELECT -l_quantity AS a, l_orderkey AS b, l_discount AS c FROM lineitem"),
    # Casts
    "cast_float_int": ("SELECT CAST(l_extendedprice AS INT) AS a, CAST(-l_extendedprice AS BIGINT) AS b FROM lineitem", "SELECT CAST(trunc(l_extendedprice) AS BIGINT) AS a, CAST(trunc(-l_extendedprice) AS BIGINT) AS b FROM lineitem"),
    "cast_int_float": ("SELECT CAST(o_orderkey AS DOUBLE) AS a FROM orders", None),
    "cast_int_text": ("SELECT CAST(o_orderkey AS TEXT) AS a FROM orders", None),
    "cast_float_text": ("SELECT CAST(l_quantity AS TEXT) AS a FROM lineitem", "SELECT CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '.0' AS a FROM lineitem"),
    "cast_text_int": ("SELECT CAST(CAST(o_orderkey AS TEXT) AS INT) AS a FROM orders", "SELECT o_orderkey AS a FROM orders"),
    "cast_text_float": ("SELECT CAST(CAST(l_discount AS TEXT) AS FLOAT) AS a FROM lineitem", "SELECT l_discount AS a FROM lineitem"),
    "cast_text_trim": (
        "SELECT CAST('\t7\n' AS INT) + o_orderkey AS a, CAST('\u3000 1.5\t' AS FLOAT) AS b FROM orders",
        "SELECT 7 + o_orderkey AS a, CAST(1.5 AS DOUBLE) AS b FROM orders",
    ),
    "cast_small_float_text": (
        "SELECT CAST(1e-20 AS TEXT) AS a, CAST(-1.5e-7 AS TEXT) AS b, CAST(1e300 AS TEXT) AS c, CAST(1.25e17 AS TEXT) AS d, CAST(0.00012 AS TEXT) AS e",
        "SELECT '0.' || repeat('0', 19) || '1' AS a, '-0.00000015' AS b, '1' || repeat('0', 300) AS c, '125' || repeat('0', 15) AS d, '0.00012' AS e",
    ),
    "count_distinct_star": ("SELECT count(DISTINCT *) AS n FROM lineitem", "SELECT count(*) AS n FROM lineitem"),
    "quoted_identifier": (
        'SELECT "n_name" AS "Name of nation", n."n_regionkey" + 0 AS "select" FROM nation "n" WHERE "n_nationkey" > 3',
        'SELECT n_name AS "Name of nation", CAST(n_regionkey AS BIGINT) AS "select" FROM nation WHERE n_nationkey > 3',
    ),
    "cast_bool_int": ("SELECT CAST(l_quantity > 25 AS INT) AS a, CAST(l_linenumber - 1 AS BOOL) AS b FROM lineitem", "SELECT CAST(l_quantity > 25 AS BIGINT) AS a, l_linenumber <> 1 AS b FROM lineitem"),
    "cast_bool_text": ("SELECT CAST(l_quantity > 25 AS TEXT) AS a, CAST('f' AS BOOLEAN) AS b FROM lineitem", "SELECT CAST(l_quantity > 25 AS VARCHAR) AS a, false AS b FROM lineitem"),
    # CASE
    "case_searched": ("SELECT l_orderkey, CASE WHEN l_quantity > 30 THEN 'big' WHEN l_quantity > 10 THEN 'mid' ELSE 'small' END AS size FROM lineitem", None),
    "case_operand": ("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS s FROM orders", None),
    "case_no_else": (f"SELECT l_orderkey, {NQ} AS q FROM lineitem", None),
    "case_widen": ("SELECT l_orderkey, CASE WHEN l_quantity > 25 THEN 1 ELSE 2.5 END AS q FROM lineitem", "SELECT l_orderkey, CASE WHEN l_quantity > 25 THEN 1e0 ELSE 2.5e0 END AS q FROM lineitem"),
    # Aggregates
    "agg_global": (
        f"SELECT count(*) AS n, count({NQ}) AS c, sum(l_quantity) AS s, min(l_quantity) AS lo, max({NQ}) AS hi, avg(l_quantity) AS m FROM lineitem",
        None,
    ),
    "agg_empty": ("SELECT count(*) AS n, sum(l_quantity) AS s, min(l_orderkey) AS lo, avg(l_quantity) AS m FROM lineitem WHERE l_orderkey < 0", None),
    "agg_group_empty": ("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_orderkey < 0 GROUP BY l_returnflag", None),
    "agg_sum_int": ("SELECT sum(l_orderkey) AS s, sum(l_linenumber) AS t FROM lineitem", f"SELECT {big('sum(l_orderkey)')} AS s, {big('sum(l_linenumber)')} AS t FROM lineitem"),
    "agg_group": ("SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY l_returnflag", None),
    "agg_group_multi": ("SELECT l_returnflag, l_linestatus, count(*) AS n, avg(l_quantity) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus", None),
    "agg_group_expr": ("SELECT l_quantity % 10 AS k, count(*) AS n FROM lineitem GROUP BY l_quantity % 10", None),
    "agg_group_ordinal": ("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1", None),
    "agg_null_group": (f"SELECT {NQ} AS k, count(*) AS n FROM lineitem GROUP BY {NQ}", None),
    "agg_count_distinct": (f"SELECT count(DISTINCT l_quantity) AS a, count(DISTINCT {NQ}) AS b FROM lineitem", None),
    "agg_sum_distinct": ("SELECT sum(DISTINCT l_quantity) AS s FROM lineitem", None),
    "agg_avg_distinct": (f"SELECT avg(DISTINCT {NQ}) AS m FROM lineitem", None),
    "agg_distinct_grouped": ("SELECT l_returnflag, count(DISTINCT l_suppkey) AS n, max(DISTINCT l_quantity) AS hi FROM lineitem GROUP BY l_returnflag", None),
    "agg_minmax_text": ("SELECT min(o_orderpriority) AS lo, max(o_orderpriority) AS hi FROM orders", None),
    "agg_minmax_bool": ("SELECT min(l_quantity > 10) AS lo, max(l_quantity > 10) AS hi FROM lineitem", None),
    "agg_expr_over_agg": ("SELECT l_returnflag, CAST(sum(l_quantity) / count(*) * 1000 AS INT) AS m FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, CAST(trunc(sum(l_quantity) / count(*) * 1000) AS BIGINT) AS m FROM lineitem GROUP BY l_returnflag"),
    "having": ("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 600", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 600"),
    "having_unselected": ("SELECT l_suppkey FROM lineitem GROUP BY l_suppkey HAVING max(l_quantity) > 49 AND count(*) > 10", None),
    "having_global": ("SELECT count(*) AS n FROM orders HAVING count(*) > 10", None),
    # Joins
    "join_inner": ("SELECT c.c_name, o.o_orderkey FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey", None),
    "join_left": ("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 400000", None),
    "join_right": ("SELECT c.c_custkey, o.o_orderkey FROM customer c RIGHT OUTER JOIN orders o ON c.c_custkey = o.o_custkey AND c.c_acctbal > 4000", None),
    "join_full": ("SELECT c.c_custkey, o.o_orderkey FROM customer c FULL JOIN orders o ON c.c_custkey = o.o_custkey + 60", None),
    "join_left_residual": ("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 100000", None),
    "join_full_residual": ("SELECT c.c_custkey, o.o_orderkey FROM customer c FULL JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 100000", None),
    "join_left_where": ("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey + 60 WHERE o.o_orderkey IS NULL", None),
    "join_null_key": (
        "SELECT a.n_name AS a, b.n_name AS b FROM nation a LEFT JOIN nation b ON CASE WHEN a.n_nationkey > 5 THEN a.n_nationkey END = CASE WHEN b.n_nationkey > 5 THEN b.n_nationkey END",
        None,
    ),
    "join_theta": ("SELECT r.r_name, n.n_name FROM region r JOIN nation n ON r.r_regionkey < n.n_regionkey", None),
    "join_left_theta": ("SELECT r.r_name, n.n_name FROM region r LEFT JOIN nation n ON r.r_regionkey > n.n_regionkey", None),
    "join_full_theta": ("SELECT r.r_name, n.n_name FROM region r FULL JOIN nation n ON r.r_regionkey > n.n_regionkey + 2", None),
    "join_cross": ("SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n", None),
    "join_comma": ("SELECT n.n_name, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey", None),
    "join_comma_multi_key": (
        "SELECT count(*) AS n FROM lineitem a, lineitem b WHERE a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber",
        None,
    ),
    "join_three": (
        "SELECT c.c_mktsegment, count(*) AS n, max(l.l_quantity) AS q FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY c.c_mktsegment",
        None,
    ),
    "join_five": (
        "SELECT r.r_name, count(*) AS n FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey JOIN customer c ON c.c_nationkey = n.n_nationkey JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY r.r_name",
        None,
    ),
    "join_self": ("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    "join_nested": ("SELECT c.c_custkey, n.n_name FROM customer c LEFT JOIN (nation n JOIN region r ON n.n_regionkey = r.r_regionkey) ON c.c_nationkey = n.n_nationkey", "SELECT c.c_custkey, n.n_name FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey"),
    "join_mixed_type_key": ("SELECT o.o_orderkey FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_quantity * 2", None),
    "join_agg": ("SELECT n.n_name AS name, count(*) AS customers, max(c.c_acctbal) AS top FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name ORDER BY customers DESC, name", None),
    # Sort, limit
    "sort_asc": (f"SELECT l_orderkey, l_linenumber, {NQ} AS q FROM lineitem ORDER BY q, l_orderkey, l_linenumber", f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, {NQ} AS q FROM lineitem ORDER BY q ASC NULLS LAST, l_orderkey, l_linenumber"),
    "sort_desc": (f"SELECT l_orderkey, l_linenumber, {NQ} AS q FROM lineitem ORDER BY q DESC, l_orderkey, l_linenumber", f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, {NQ} AS q FROM lineitem ORDER BY q DESC NULLS FIRST, l_orderkey, l_linenumber"),
    "sort_nulls_first": (f"SELECT l_orderkey, l_linenumber, {NQ} AS q FROM lineitem ORDER BY q ASC NULLS FIRST, l_orderkey, l_linenumber", f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, {NQ} AS q FROM lineitem ORDER BY q ASC NULLS FIRST, l_orderkey, l_linenumber"),
    "sort_nulls_last": (f"SELECT l_orderkey, l_linenumber, {NQ} AS q FROM lineitem ORDER BY q DESC NULLS LAST, l_orderkey, l_linenumber", f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, {NQ} AS q FROM lineitem ORDER BY q DESC NULLS LAST, l_orderkey, l_linenumber"),
    "sort_multi": ("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderstatus DESC, o_totalprice ASC, o_orderkey", None),
    "sort_unselected": ("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey", None),
    "sort_alias": ("SELECT o_orderkey, -o_totalprice AS o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey", "SELECT o_orderkey, -o_totalprice AS o_totalprice FROM orders ORDER BY -orders.o_totalprice, o_orderkey"),
    "sort_ordinal": ("SELECT o_custkey, o_orderkey FROM orders ORDER BY 1 DESC, 2", None),
    "sort_agg": ("SELECT l_suppkey FROM lineitem GROUP BY l_suppkey ORDER BY count(*) DESC, l_suppkey", None),
    "top_k_report": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", None),
    "limit": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7", None),
    "offset": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 14000", None),
    "limit_offset": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5 OFFSET 100", None),
    "limit_zero": ("SELECT o_orderkey FROM orders LIMIT 0", None),
    # DISTINCT
    "distinct": ("SELECT DISTINCT o_orderstatus FROM orders", None),
    "distinct_multi": ("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", None),
    "distinct_null": (f"SELECT DISTINCT {NQ} AS q FROM lineitem", None),
    "distinct_order": ("SELECT DISTINCT l_quantity AS q FROM lineitem ORDER BY q DESC", None),
    "distinct_order_unselected": (
        "SELECT DISTINCT o_custkey FROM orders ORDER BY o_totalprice DESC",
        "SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY max(o_totalprice) DESC",
    ),
    # The flagship
    "pricing_summary": (
        "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS q, max(l_extendedprice * (1 - l_discount)) AS top FROM lineitem WHERE l_discount > 0.02 GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus",
        "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS q, max(l_extendedprice * (1 - l_discount)) AS top FROM lineitem WHERE l_discount > 0.02e0 GROUP BY l_returnflag, l_linestatus",
    ),
}


def session_over(spark: SparkSession, sf_dir: str) -> Session:
    """A session with the tables of a folder; only their schemas are read."""
    session = Session(spark)
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        session.register(name, spark.read.parquet(path), path)
    return session


def _runner(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: session_over(spark, sf_dir).query(sql)


# Statements that change the catalog, each ending in a SELECT


def table_create_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = Session(spark)
    session.execute("CREATE TABLE t (a INT NOT NULL, b TEXT, c DOUBLE); INSERT INTO t VALUES (1, 'x', 2), (1 + 1, NULL, 0.5)")
    session.execute("INSERT INTO t VALUES (CAST('3' AS INT), 'it''s', NULL)")
    return session.query("SELECT a, b, c FROM t")


def table_drop_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = Session(spark)
    session.execute("CREATE TABLE t (a INT); INSERT INTO t VALUES (1); DROP TABLE t; CREATE TABLE t (a TEXT)")
    return session.query("SELECT count(*) AS n, max(a) AS a FROM t")


def _as_csv(spark: SparkSession, sf_dir: str) -> str:
    from .sources.csvio import scratch

    where = scratch(spark)
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey")
    nations.coalesce(1).write.csv(where, header=True)
    return where


def table_import_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = Session(spark)
    session.import_csv("n", _as_csv(spark, sf_dir))
    return session.query("SELECT n_nationkey, n_name, n_regionkey FROM n WHERE n_regionkey > 1")


def table_copy_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = Session(spark)
    session.execute(f"CREATE TABLE n (k INT, name TEXT, region DOUBLE); COPY n FROM '{_as_csv(spark, sf_dir)}'")
    return session.query("SELECT k, name, region FROM n")


def table_save_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.csvio import scratch

    session, where = session_over(spark, sf_dir), scratch(spark)
    session.save_table("orders", where, 8192)
    session.attach("saved", where)
    return session.query("SELECT s.*, o.o_totalprice AS price FROM saved s JOIN orders o ON s.o_orderkey = o.o_orderkey")


def import_csv_tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with white space of several kinds around them, and lines of nothing else, as a file of its own."""
    from .sources.csvio import scratch

    where = scratch(spark)
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    cells = F.concat(F.lit("\t"), F.col("n_nationkey"), F.lit(" \t,\u3000"), F.col("n_name"), F.lit(" \t"))
    lines = nation.select(F.struct(F.lit(1).alias("k"), cells.alias("line")).alias("r"))
    extra = spark.createDataFrame([(0, "key\t, name"), (2, "\t"), (2, " \t ")], "k int, line string")
    both = lines.select("r.*").union(extra).coalesce(1).sortWithinPartitions("k").select("line")
    both.write.text(where)
    session = Session(spark)
    session.import_csv("t", where)
    return session.query("SELECT key + 0 AS n, name FROM t")


STATEMENTS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "table_create_insert": (
        table_create_insert,
        "SELECT CAST(a AS BIGINT) AS a, b, CAST(c AS DOUBLE) AS c FROM (VALUES (1, 'x', 2.0), (2, NULL, 0.5), (3, 'it''s', NULL)) v(a, b, c)",
    ),
    "table_drop_create": (table_drop_create, "SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS a"),
    "table_import_csv": (table_import_csv, "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation WHERE n_regionkey > 1"),
    "import_csv_tabs": (import_csv_tabs, "SELECT CAST(n_nationkey AS BIGINT) AS n, n_name AS name FROM nation"),
    "table_copy_csv": (table_copy_csv, "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name, CAST(n_regionkey AS DOUBLE) AS region FROM nation"),
    "table_save_attach": (table_save_attach, "SELECT * REPLACE (CAST(o_orderdate AS VARCHAR) AS o_orderdate), o_totalprice AS price FROM orders"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _runner(sql) for k, (sql, _) in QUERIES.items()} | {k: f for k, (f, _) in STATEMENTS.items()}


def oracle_sql() -> dict[str, str]:
    return {k: other or sql for k, (sql, other) in QUERIES.items()} | {k: sql for k, (_, sql) in STATEMENTS.items()}
