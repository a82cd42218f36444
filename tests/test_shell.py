"""The shell and its table printer."""

import subprocess
import sys

import pytest

from lodestar.errors import EngineError
from lodestar.render import cell, table
from lodestar.session import Session
from lodestar.shell import Shell


@pytest.fixture
def shell(spark):
    return Shell(Session(spark))


def test_table():
    assert table(["a", "b"], [(1, None), (2.0, "naïve")]) == (
        "┌─────┬───────┐\n│ a   │ b     │\n├─────┼───────┤\n│ 1   │ NULL  │\n│ 2.0 │ naïve │\n└─────┴───────┘\n2 rows\n"
    )
    assert table(["a"], [(True,)]).endswith("1 row\n") and table([], [(), ()]) == "(2 rows, no columns)\n"
    assert cell("x" * 41) == "x" * 39 + "…" and cell("x" * 40) == "x" * 40 and cell(1e20) == "100000000000000000000"


def test_commands(shell, tmp_path):
    assert shell.handle("\\dt") == "no tables; try \\import <name> <file.csv>\n"
    path = tmp_path / "o.csv"
    path.write_text("id,amount\n1,2.5\n2,\n")
    assert shell.handle(f"\\import o {path}") == "imported 2 rows into o\n"
    described = shell.handle("\\d o")
    assert "o (2 rows)" in described and "min=2.5 max=2.5 nulls=1 distinct≈1" in described and "NOT NULL" in described
    out = tmp_path / "o.parquet"
    assert shell.handle(f"\\save o {out}") == f"wrote 2 rows to {out}; o now reads from it\n"
    assert "file  " in shell.handle("\\dt")
    assert shell.handle(f"\\attach p {out}").startswith("attached p (2 rows)")
    assert "Scan: o [id]" in shell.handle("\\explain SELECT id FROM o")
    assert shell.handle("\\timing") == "timing on\n" and "ms" in shell.handle("SELECT 1;")
    assert "\\import" in shell.handle("\\help") and shell.handle("") == ""
    for bad in ("\\nope", "\\d", "\\import x", "\\explain", "\\d nope"):
        with pytest.raises(EngineError):
            shell.handle(bad)
    shell.handle("\\q")
    assert shell.done


def test_script_stops_at_the_first_failure(shell):
    said = []
    text = "-- a comment; with a semicolon\nCREATE TABLE t (a INT);\n\n-- another\nINSERT INTO t\nVALUES (1);\nSELECT nope FROM t;\nSELECT a FROM t;\n"
    assert not shell.script(text.splitlines(), said.append)
    assert said[0] == "created table t\n" and said[-1].startswith("plan error") and len(said) == 3


def test_prompt_goes_on_after_errors_and_runs_the_rest(shell):
    said = []
    shell.prompt(["SELECT nope;", "SELECT CAST('x' AS INT);", "SELECT 1", "  + 1 AS a"], said.append)
    assert said[0].startswith("plan error") and said[1].startswith("execution error") and "1 row" in said[2]
    shell.prompt(["\\q", "SELECT 1;"], said.append)
    assert said[-1] == ""


def test_command_line(tmp_path):
    script = tmp_path / "s.sql"
    script.write_text("SELECT 1 + 1 AS two;\n")
    run = subprocess.run([sys.executable, "-m", "lodestar", str(script)], capture_output=True, text=True, timeout=120)
    assert run.returncode == 0 and "│ two │" in run.stdout


def test_script_tells_a_failure_of_rows_and_stops(shell):
    said = []
    assert not shell.script(["SELECT CAST('x' AS INT);", "SELECT 1;"], said.append)
    assert len(said) == 1 and said[0].startswith("execution error") and "cannot cast" in said[0]


def test_long_results_are_cut_with_a_word(shell, monkeypatch):
    monkeypatch.setattr("lodestar.shell.MOST_SHOWN", 2)
    shell.handle("CREATE TABLE t (a INT); INSERT INTO t VALUES (1), (2), (3);")
    answer = shell.handle("SELECT a FROM t ORDER BY a;")
    assert "│ 2 │" in answer and "│ 3 │" not in answer and answer.endswith("only the first 2 rows are shown\n")
    assert "shown" not in shell.handle("SELECT a FROM t LIMIT 2;")


def test_save_replaces_what_is_there_even_its_own_files(shell, tmp_path):
    out = tmp_path / "t"
    shell.handle("CREATE TABLE t (a INT); INSERT INTO t VALUES (1), (2);")
    shell.handle("CREATE TABLE u (b TEXT); INSERT INTO u VALUES ('x');")
    for line in (f"\\save t {out}", f"\\save t {out}", f"\\save u {out}"):
        shell.handle(line)
    assert "│ x │" in shell.handle("SELECT b FROM u;") and sorted(p.name for p in tmp_path.iterdir()) == ["t"]


def test_errors_beyond_the_sample_name_the_column(shell, tmp_path):
    path = tmp_path / "o.csv"
    path.write_text("id,amount\n" + "1,2\n" * 1500 + "7,nope\n")
    with pytest.raises(EngineError, match="cannot cast 'nope' to .* in column amount"):
        shell.handle(f"\\import o {path}")
    path.write_text("id,amount\n" + "1,2\n" * 1500 + "7,8,9\n")
    with pytest.raises(EngineError, match="expected 2 fields in line: 7,8,9"):
        shell.handle(f"\\import o {path}")
