"""Token ids in Parquet list columns: dictionary or delta encoding, set row groups and pages, selective reads.

``write_tokens`` deals documents out by ranges of doc_id, sorts within each range, and writes doc_id, n_tokens, part,
at (ids of the part before this document) and token_ids. Parquet's column and offset indexes let ``read_tokens`` fetch
single documents or the metadata alone. The number of ids before a document is its part's base plus ``at``; bases come
from one small row per written part.

Null texts count as empty and hold the end id alone. A null doc_id sorts first. Equal ids are ordered by the signed 64-bit
hash of their text (``xxhash64``, null as 42), then by text, over all parts: that pair deals them out too, so one id may
have any number of rows. Rows that agree in both are alike. Other columns are ignored. An empty table writes no rows. The text of a special token inside a document is read as the
library reads it by default.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import settings, shared_path
from .segments import json_encoder, slices, whole_texts

FILE_SCHEMA = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("n_tokens", LongType()),
        StructField("part", IntegerType()),
        StructField("at", LongType()),
        StructField("token_ids", ArrayType(IntegerType(), containsNull=False)),
    ]
)

#: Parquet settings by encoding; "delta" is the second version of the format without a dictionary.
ENCODINGS = {
    "dictionary": {"parquet.enable.dictionary": "true"},
    "delta": {"parquet.enable.dictionary": "false", "parquet.writer.version": "PARQUET_2_0"},
}


#: Arrow batches of few rows, as texts can be long; and lists in two levels, a repeated number without a group around each,
#: which Parquet's writer is much faster with. They hold no nulls.
WRITING = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.parquet.writeLegacyFormat": "true"}


def encode_batches(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Rows of FILE_SCHEMA for one sorted part."""
    encode, part, before = json_encoder(tokenizer, 400_000), TaskContext.get().partitionId(), 0
    for batch in batches:
        for rows in slices(batch, "text"):
            ids, offsets = encode(whole_texts(rows.column("text")), end_id)
            n = rows.num_rows
            lengths = np.diff(offsets)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    pa.array(lengths, pa.int64()),
                    pa.array(np.full(n, part, np.int32)),
                    pa.array(before + offsets[:-1], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.view(np.int32))),
                ],
                names=["doc_id", "n_tokens", "part", "at", "token_ids"],
            )
            before += int(offsets[-1])


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    encoding: str = "dictionary",
    row_group_bytes: int = 32 << 20,
    rows_per_page: int = 1000,
) -> None:
    """Write every document's ids, in ascending order of doc_id over the parts, to ``path``."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.xxhash64("text").alias("spread")
    )
    dealt = rows.repartitionByRange("doc_id", "spread").sortWithinPartitions("doc_id", "spread", "text")
    encoded = dealt.mapInArrow(lambda batches: encode_batches(batches, tokenizer, end_id), FILE_SCHEMA)
    writer = encoded.write.option("compression", "zstd").option("parquet.block.size", row_group_bytes)
    writer = writer.option("parquet.page.row.count.limit", rows_per_page)
    with settings(docs.sparkSession, WRITING):
        writer.options(**ENCODINGS[encoding]).parquet(path)


def read_tokens(
    spark: SparkSession,
    path: str,
    columns: tuple[str, ...] = ("doc_id", "n_tokens", "part", "at", "token_ids"),
    first_id: int | None = None,
    last_id: int | None = None,
) -> DataFrame:
    """The named columns of the documents in a closed range of ids; the scan skips other pages and columns."""
    df = spark.read.schema(FILE_SCHEMA).parquet(path)
    if first_id is not None:
        df = df.filter(F.col("doc_id") >= first_id)
    if last_id is not None:
        df = df.filter(F.col("doc_id") <= last_id)
    return df.select(*columns)


def part_bases(spark: SparkSession, path: str) -> DataFrame:
    """part and base, the ids before the part: one row per written part, so as many as there were tasks."""
    totals = read_tokens(spark, path, ("part", "n_tokens")).groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    rows, before = [], 0
    for part, n in sorted((r.part, r.n) for r in totals):
        rows.append((part, before))
        before += n
    return spark.createDataFrame(rows, "part int, base long")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("token_ids")
        bounds, flat = lists.offsets.to_pylist(), np.ascontiguousarray(lists.values.to_numpy().astype("<u4"))
        raw = memoryview(flat).cast("B")
        sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds, bounds[1:], strict=False)]
        kept = [batch.column(c) for c in ("doc_id", "n_tokens", "part", "at")]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array(sums, pa.int64())], names=["doc_id", "n_tokens", "part", "at", "ids_crc32"]
        )


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files at ``path``: doc_id, start, n_tokens, ids_crc32."""
    sums = read_tokens(spark, path).mapInArrow(
        _checksums, "doc_id long, n_tokens long, part int, at long, ids_crc32 long"
    )
    # One row of 12 bytes for each task that wrote: its size follows the number of tasks, not of documents.
    joined = sums.join(F.broadcast(part_bases(spark, path)), "part")
    return joined.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def stored_digest(docs: DataFrame, tokenizer: str, end_id: int = 2, encoding: str = "dictionary") -> DataFrame:
    """Write ``docs`` to shared storage, read the files back, and digest them."""
    path = shared_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id, encoding)
    return token_digest(docs.sparkSession, path)
