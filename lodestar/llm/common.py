"""Helpers shared by the operators: input tables, shared scratch tables, fixed text rules."""

from __future__ import annotations

import gc
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Where scratch tables go when the session names no folder (tests, a laptop).
LOCAL_SHARED_DIR = "file:///tmp/lodestar-shared"

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``; any path that Spark's reader opens."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """This application's folder in the storage that driver and executors share.

    The cluster names that storage in ``spark.checkpoint.dir``. Where that is unset and driver and executors are one
    process, a local folder is used; on a cluster it would lose rows without a word, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", getattr(spark.sparkContext, "master", "local")):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        base = LOCAL_SHARED_DIR
    return f"{base.rstrip('/')}/lodestar/{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below ``shared_root``."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to shared storage and read again: a lineage cut that outlives any executor."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the jobs that run inside; then as they were."""
    before = {key: spark.conf.get(key) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def arrow_rows(spark: SparkSession, rows: int):
    """At most so many rows an Arrow batch in the jobs that run inside, as texts can be long; then as it was."""
    return settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)})


def removed(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a ``stored`` frame that nothing will read again."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(spark, folder)


def cleared(spark: SparkSession) -> None:
    """Delete all that this application has stored; frames that read it are of no use afterwards."""
    _delete(spark, shared_root(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def released(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more, instead of at some later time."""
    gc.collect()
    spark._jvm.System.gc()
