"""Shared storage: where it is, that it can be read again, and that it can be emptied."""

import os
from types import SimpleNamespace

import pytest

from lodestar.llm import common
from lodestar.llm.common import arrow_rows, cleared, removed, shared_root, stored


def test_stored_tables(spark, tmp_path):
    df = spark.range(10)
    a, b = stored(df, "a"), stored(df, "b")
    assert a.schema.simpleString() == df.schema.simpleString() and a.count() == 10
    folder = a.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert os.path.isdir(folder)
    removed(spark, a)
    assert not os.path.isdir(folder) and b.count() == 10


def test_the_cluster_names_the_folder(spark, tmp_path, monkeypatch):
    named = SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: {"spark.checkpoint.dir": "hdfs://shared/x/"}.get(key, default)),
        sparkContext=SimpleNamespace(applicationId="app-1"),
    )
    assert shared_root(named) == "hdfs://shared/x/lodestar/app-1"
    named.conf.get = lambda key, default: default
    assert shared_root(named) == f"{common.LOCAL_SHARED_DIR}/lodestar/app-1"
    monkeypatch.setattr(common, "shared_root", lambda spark: f"file://{tmp_path}/app")
    assert stored(spark.range(3), "x").count() == 3 and os.listdir(tmp_path) == ["app"]
    cleared(spark)
    assert os.listdir(tmp_path) == []


def test_arrow_rows_come_back(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with arrow_rows(spark, 7):
        assert spark.conf.get(key) == "7"
    assert spark.conf.get(key) == before


@pytest.mark.parametrize("master,good", [("local", True), ("local[4]", True), ("local-cluster[2,1,512]", False), ("spark://h:7077", False), ("yarn", False)])
def test_a_cluster_must_name_its_shared_folder(master, good):
    one = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master=master, applicationId="app"))
    if good:
        assert common.shared_root(one) == f"{common.LOCAL_SHARED_DIR}/lodestar/app"
    else:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_root(one)
    one.conf = {"spark.checkpoint.dir": "x://shared/"}
    assert common.shared_root(one) == "x://shared/lodestar/app"
