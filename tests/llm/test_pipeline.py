"""The pipeline's stages on a small table, each against what its operator alone says of the stage's own input."""

import random

import pytest

import corpus_pipeline as P
from lodestar.llm.jaccard_join import near_duplicates
from lodestar.llm.quality_rules import quality_report


@pytest.fixture(scope="module")
def folder(spark, prose, tmp_path_factory):
    rng = random.Random(0)
    rows, labels = [], []
    for i in range(120):
        text = prose(rng.randrange(30, 120), i)
        toxic = int(i % 4 == 0)
        if toxic:
            text += " zorgish blukker you vextrous zorgish"
        rows.append((i, text, "en", f"src{i % 3}", len(text)))
        labels.append((i, 1, toxic))
    rows += [(200 + k, rows[1][1], "en", "src0", 1) for k in range(5)]
    rows += [(300, "### " * 50, "en", "src1", 1), (301, None, None, None, None), (302, "", "en", "src1", 0)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = P.table(spark, folder, "documents")
    columns = docs.columns
    kept = [docs]
    for name, stage in P.STAGES[:-1]:
        out = P.stored(stage(spark, kept[-1], folder), name)
        assert out.columns == columns
        kept.append(out)
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in kept]
    assert ids[1] == {r.doc_id for r in quality_report(kept[0]).collect() if r.kept}
    assert ids[1] - ids[2] == {i for i in ids[1] if i < 120 and i % 4 == 0}
    same = {r.doc_id for r in near_duplicates(kept[2]).collect() if r.component_id == r.doc_id}
    assert ids[3] == same and not ids[3] & set(range(200, 205))
    pieces = P.run(spark, folder).collect()
    assert {r.doc_id for r in pieces} == ids[3]
    assert sum(r.length for r in pieces) == sum({r.doc_id: r.doc_tokens for r in pieces}.values())


def test_empty_and_odd_tables(spark, tmp_path):
    """No documents; and documents with more columns, whose names the stages use too, nulls, and rows that repeat."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows in (("none", []), ("nulls", [(1, None, "en", "s", 0), (None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "", "", 0)])):
        path = str(tmp_path / name)
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        assert P.run(spark, path).collect() == []
    words = "the river and the old bridge of stone walks under a green light near the tower"
    rows = [(i, f"{words} number {i} in the garden of the town", i, "x", 0.5, True, i) for i in (4, 4, 7, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long, sid string, score double, kept boolean, label long")
    labels = spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labelled/labels.parquet")
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, f"{tmp_path}/labelled")
        assert out.columns == docs.columns and {tuple(r) for r in out.collect()} <= {tuple(r) for r in docs.collect()}
    assert {r.doc_id for r in P.STAGES[-1][1](spark, docs, "").collect()} == {4, 7, 9, None}


def test_run_by_brute_force(spark, folder, prose):
    """All stages in plain Python: rules by their own test's definitions, every text scored alone, all pairs, direct ids."""
    import zlib

    import numpy as np
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from lodestar.llm import toxicity as T

    rows = [(r.doc_id, r.text) for r in P.table(spark, folder, "documents").collect()]
    labelled = {r.doc_id: r.toxic for r in P.table(spark, folder, "labels").collect()}
    rule_kept = {r.doc_id for r in quality_report(P.table(spark, folder, "documents")).collect() if r.kept}
    rows = [r for r in rows if r[0] in rule_kept]
    sample = sorted((i, t or "", labelled[i]) for i, t in rows if i in labelled and zlib.crc32(str(i).encode()) % 3 != 1)
    model = T.fit([(t, y) for _, t, y in sample])
    rows = [r for r in rows if model.scores(pa.array([r[1] or ""], pa.large_string()))[0] < T.TOXIC]

    def shingles(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets, group = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and sets[a] and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows if group[i] == i}

    pieces = sorted(P.run(spark, folder).collect(), key=lambda r: (r.doc_id, r.start))
    found = {}
    for r in pieces:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert r.start == found.get(r.doc_id, 0) and r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        found[r.doc_id] = r.start + r.length
    assert found == {i: len(ids) for i, ids in want.items()}
