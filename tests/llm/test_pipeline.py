"""The pipeline against a plain version of each stage on its own input."""

import os

import pytest
from test_decontaminate import brute as contaminated
from test_jaccard import brute as similar
from test_line_dedup import brute as deduped

import corpus_pipeline
from keidai.llm.common import fresh_path


def test_stages_on_their_own_inputs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        path = fresh_path(spark, name)
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "language":
            assert 0.9 * len(before) < len(after) <= len(before) and set(after.items()) <= set(before)
        elif name == "lines":
            assert after == {i: t for i, t in deduped(before) if t is None or t.strip(" ") or t == dict(before)[i]}
        elif name == "near_duplicates":
            assert set(after) == {i for i, (c, _, _) in similar(before).items() if c == i}
        elif name == "benchmarks":
            assert set(after) == {i for i, (_, _, _, bad) in contaminated(before, bench).items() if not bad}
        else:
            assert set(after.items()) == set(before) and all(r["decoded"] == r["text"] for r in docs.collect())
        if name != "pieces":
            assert docs.columns == columns


def test_registered(spark, sf):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert "pipeline" not in __spark_entry__.oracle_sql()


def leftovers(spark):
    from urllib.parse import urlparse

    from keidai.llm.common import shared_dir

    folder = os.path.join(urlparse(shared_dir(spark)).path, "keidai")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_run_leaves_its_result_alone(spark, sf, monkeypatch):
    before = leftovers(spark)
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and [x.split("-")[:2] for x in leftovers(spark) - before] == [["stage", "pieces"]]
    after = leftovers(spark)

    def fails(spark, docs, sf_dir):
        raise RuntimeError("lost")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [*corpus_pipeline.STAGES[:2], ("fails", fails)])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, sf)
    assert leftovers(spark) == after


def test_odd_rows_and_empty_tables(spark, sf):
    """Null ids, texts and languages, repeated rows, columns whose names the stages use: defined at every stage, and no rows of none."""
    text = "the house and the garden of the old town were quiet in the morning light\nsecond line of the text\nthird line of the text"
    rows = [(1, text, "en"), (1, text, "en"), (None, text + " more words", None), (2, None, "en"), (3, "", "en"), (4, "12345", None), (5, "ein Haus und ein Garten in der alten Stadt", "de"), (6, text, "en")]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or ""), "x", "y", "z") for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, ld_text string, dc_items string, jj_gone string")
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
        path = fresh_path(spark, name)
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns[:8] == ["doc_id", "text", "lang", "source", "n_chars", "ld_text", "dc_items", "jj_gone"]
        sizes.append(sorted((str(r["doc_id"]) for r in docs.collect())))
    assert sizes[0] == ["1", "1", "5", "6", "None"]  # und goes: null, empty, no letters
    assert sizes[1] == ["1", "1", "5", "None"]  # nothing is left of 6
    assert sizes[2] == sizes[3] == sizes[4] == ["1", "1", "5", "None"]
