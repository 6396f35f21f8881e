import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from keidai.llm import lm_score as L


def base(rows, held):
    x = pd.DataFrame({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows], "held_out": [i in held for i, _ in rows]})
    con = duckdb.connect()
    con.register("docs", x)
    return {int(r.doc_id): (r.n_tokens, r.n_known, r.base_score) for r in con.execute(L.BASE_SQL).df().itertuples()}


@pytest.mark.parametrize("frequent", [L.FREQUENT, 3])
def test_base_score_is_exact(make, monkeypatch, frequent):
    monkeypatch.setattr(L, "frequent", lambda counts, f=L.frequent: f(counts, frequent))
    rows = [(i, t) for i, t in enumerate([None, "", "The the cat", "a b a\tb\nÉ é", "cat " * 500, "x y z", "the cat sat"])]
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    expected = base(rows, held)
    for r in L.score_fold(make(rows)).collect():
        n, known, score = expected[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"]) == (n, known) and r["base_score"] == pytest.approx(score, abs=1e-9)
        assert r["held_out"] == (r["doc_id"] in held) and r["score"] <= 0


def test_repeated_rows_null_ids_and_nothing_to_learn(make):
    docs = make([(1, "a b"), (1, "a b"), (None, "c"), (2, "a")])
    rows = L.score_fold(docs).collect()
    assert len(rows) == 4 and len({(r["base_score"], r["score"]) for r in rows if r["doc_id"] == 1}) == 1
    alone = L.score(docs, docs.limit(0)).collect()
    assert {(r["n_known"], r["train_tokens"], r["base_score"]) for r in alone} == {(0, 0, 0.0)}
    assert L.score(docs.limit(0), docs).count() == 0


def test_filter_never_counts_less_and_seldom_more():
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(0, 2**63, 20_000, dtype=np.uint64) * np.uint64(2))
    counts = rng.integers(1, 200, len(values))
    for bits in (64, 40):
        back = L.unpacked(L.packed(L.cut(values, bits), counts, bits), bits)
        assert (back[0] == L.cut(values, bits)).all() and (back[1] == counts).all()
    words = L.entered(values, L.quantised(counts))
    grid = L.CountFilter(words, np.array([0, len(words)]))
    low = L.expected(L.quantised(counts))
    got = grid.counts(values)
    assert (got >= low).all() and (got > low).mean() < 0.05
    assert (grid.counts(rng.integers(0, 2**63, 20_000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) > 0).mean() < 0.05


def test_model_beats_the_base_on_held_out_text(documents):
    rows = [r for r in L.score_fold(documents).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


@pytest.mark.parametrize("exact", [True, False])
def test_score_against_plain_counts(make, monkeypatch, exact):
    """Many segments and parts. With room enough in the filter every score is the plain model's; with the usual bits it seldom counts more."""
    if exact:
        monkeypatch.setattr(L, "BITS", 2000)
        monkeypatch.setattr(L, "SPARE_BITS", 40)
    monkeypatch.setattr(L, "SEGMENT_TOKENS", 100)
    monkeypatch.setattr(L, "PART", 2000)
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{x}" for x in rng.zipf(1.3, 40) % 5000)) for i in range(200)] + [(None, "w1 w2"), (200, None), (201, ""), (1, "w1 w2"), (202, rows0 := "W5 w6\tw7  w8\n w9 "), (203, rows0)]
    held = {i for i, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 7 == 2}
    of = lambda t: [L.END] * 3 + (t or "").encode().lower().split() + [L.END]
    one, context, whole = Counter(), Counter(), Counter()
    for i, t in rows:
        if i not in held:
            w = of(t)
            one.update(w[3:])
            context.update(tuple(w[k - 3 : k]) for k in range(3, len(w)))
            whole.update(tuple(w[k - 3 : k + 1]) for k in range(3, len(w)))
    total, level = sum(one.values()), lambda n: float(L.expected(L.quantised(np.array([n])))[0])
    expected = []
    for i, t in rows:
        score, w = 0.0, of(t)
        for k in range(3, len(w)):
            single, before = (level(one[w[k]]) + 1) / (total + len(one) + 1), level(context[tuple(w[k - 3 : k])])
            score += np.log10(min((min(level(whole[tuple(w[k - 3 : k + 1])]), before) + L.PRIOR * single) / (before + L.PRIOR), 1.0))
        expected.append((str(i), len(w) - 3, score))
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in L.score_fold(make(rows)).collect())
    assert [x[:2] for x in got] == [x[:2] for x in sorted(expected)]
    differences = np.abs([a[2] - b[2] for a, b in zip(got, sorted(expected))])
    assert differences.max() < (1e-6 if exact else 12) and np.median(differences) < 1


def test_documents_that_occur_twice_stand_apart(spark):
    """A model of the whole corpus gives most of the documents that occur twice more a token than nine in ten of those that occur once."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = L.score_fold(docs).join(docs.select("doc_id", F.xxhash64("text").alias("text")), "doc_id").where("n_tokens > 20").collect()
    times = Counter(r["text"] for r in rows)
    by = {n: [r["score"] / r["n_tokens"] for r in rows if times[r["text"]] == n] for n in (1, 2)}
    assert np.mean(np.array(by[2]) > np.quantile(by[1], 0.9)) > 0.5
