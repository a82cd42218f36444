"""The labelled sample: bounded by class, without the fold left out, and with one row for each id."""

import zlib

from lodestar.llm.words import labelled_sample


def test_repeated_labels_and_texts_count_once(spark):
    used = [i for i in range(100) if zlib.crc32(str(i).encode()) % 3 != 1][:8]
    docs = spark.createDataFrame(
        [(i, f"text {i}") for i in used] + [(used[0], "a text"), (used[1], None), (None, "no id")], "doc_id long, text string"
    )
    labels = spark.createDataFrame(
        [(i, n % 2) for n, i in enumerate(used)] + [(used[0], 1), (used[2], 0), (used[3], None), (None, 1), (used[4], 7)],
        "doc_id long, toxic int",
    )
    got = sorted(labelled_sample(docs, labels, "toxic", 3, 1, 100))
    want = [("a text", 1), ("", 1)] + [(f"text {i}", n % 2) for n, i in enumerate(used) if n > 1]
    assert got == sorted(want)
    assert len(list(labelled_sample(docs, labels, "toxic", 3, 1, 2))) == 4
    left_out = [i for i in range(100) if zlib.crc32(str(i).encode()) % 3 == 1][0]
    assert list(labelled_sample(docs, spark.createDataFrame([(left_out, 1)], "doc_id long, toxic int"), "toxic", 3, 1, 2)) == []
