import random
import re

import numpy as np
import pytest

from keidai.llm import jaccard_join as J


def sets(t):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None


def brute(rows):
    by = {}
    for i, t in sorted({(i, t) for i, t in rows if i is not None}, key=str):
        by.setdefault(sets(t) if sets(t) is not None else ("none", i), []).append(i)
    keys = list(by)
    links = {k: set() for k in keys}
    for a in keys:
        for b in keys:
            if a is not b and isinstance(a, frozenset) and isinstance(b, frozenset) and 5 * len(a & b) >= 4 * len(a | b):
                links[a].add(b)
    out = {}
    for k in keys:
        seen, todo = {k}, [k]
        while todo:
            for x in links[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        for i in by[k]:
            out[i] = (min(min(by[x]) for x in seen), len(links[k]), len(by[k]))
    return out


def run(df):
    return {r["doc_id"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in J.jaccard_join(df).collect()}


def corpus(seed, n=160):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            w = rng.choice(rows)[1].split()
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                if w:
                    w[rng.randrange(len(w))] = f"n{rng.randrange(999)}"
            rows.append((i, rng.choice([" ", ", "]).join(w)))
        else:
            rows.append((i, " ".join(f"w{rng.randrange(500)}" for _ in range(rng.choice([3, 12, 60, 200])))))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_and_links_against_all_pairs(make, seed):
    rows = corpus(seed)
    assert run(make(rows)) == brute(rows)


def test_a_component_of_many_blocks(make, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_GRAMS", 2000)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(base[: 40 + i % 3] + [f"x{i}"] + base[41:])) for i in range(60)]
    assert run(make(rows)) == brute(rows)


def test_nulls_short_texts_copies_and_case(make):
    rows = [(0, None), (1, ""), (2, "..."), (3, "one two"), (4, "One, TWO!"), (5, "one two three"), (6, None), (None, "one two"), (7, "one two")]
    assert run(make(rows)) == brute(rows)
    assert run(make(rows).limit(0)) == {}
    assert run(make([(1, "a b c d e f"), (1, "a b c d e f")])) == {1: (1, 0, 1)}


def test_one_of_each_group_stays(make):
    long = " ".join(f"w{i}" for i in range(100))
    kept = J.keep_one(make([(5, long), (3, long), (9, long.replace("w50", "z")), (4, "other text here"), (6, None), (7, "")]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 6, 7]


def test_bands_reach_the_recall():
    bands, rows = J.bands_for()
    assert 1 - (1 - J.THRESHOLD**rows) ** bands >= J.RECALL and bands * rows <= J.HASHES


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (100, 102), (7, 7)], "a long, b long")
    found = {r["node"]: r["root"] for r in J.components(edges, "path").collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}


def test_compare_counts_whole_sets():
    rng = np.random.default_rng(0)
    left = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(12)]
    found = J.compare(left, None, 0.5)
    for i in range(12):
        for j in range(12):
            a, b = set(left[i].tolist()), set(left[j].tolist())
            assert found[i, j] == (i != j and len(a & b) >= 0.5 * len(a | b))


def test_blocks_by_size_lose_no_link(make, monkeypatch):
    """Sizes just within and just beyond what the threshold allows, in a component of several blocks, and buckets of several blocks."""
    monkeypatch.setattr(J, "BLOCK_GRAMS", 900)
    monkeypatch.setattr(J, "LEAST_GRAMS", 1)
    monkeypatch.setattr(J, "BUCKET_TEXTS", 3)
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(base[: 104 + 4 * i])) for i in range(40)] + [(100 + i, " ".join(base[:200] + [f"x{i}", f"y{i}"])) for i in range(30)]
    assert run(make(rows)) == brute(rows)


def test_texts_that_share_a_passage_are_told_apart_before_their_sets_are_compared(make, spark):
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, passage + " " + " ".join(f"v{rng.randrange(10**6)}" for _ in range(70))) for i in range(120)] + [(500, rows0 := passage + " end of it"), (501, rows0 + "."), (502, rows0 + " x")]
    assert run(make(rows)) == brute(rows)
    docs = make(rows)
    bands, per = J.bands_for()
    sketched = J.sketches(docs, "doc_id", "text", 5, bands, per)
    reps = spark.createDataFrame([(r["id"], r["text_h"]) for r in sketched.select("id", "text_h").collect()], "rep long, rep_h long")
    tight = J.candidate_edges(sketched, reps, 0.63).distinct().collect()
    loose = J.candidate_edges(sketched, reps, 0.0).distinct().collect()
    assert len(loose) > 20 and {x for e in tight for x in e} == {500, 501, 502}


def test_signatures_connect_what_pairs_do():
    rng = np.random.default_rng(3)
    for _ in range(20):
        sigs = rng.integers(0, 3, (30, 12)).astype(np.uint8)
        near = (sigs[:, None] == sigs[None]).mean(2) >= 0.6
        want = list(range(30))
        for _ in range(30):
            want = [min(want[j] for j in range(30) if near[i, j]) for i in range(30)]
        got = list(range(30))
        for _ in range(30):
            for a, b in J.alike(sigs, 0.6):
                got[a] = got[b] = min(got[a], got[b])
        assert got == want


def test_clashing_names_stay(make):
    from pyspark.sql import functions as F

    docs = make(["a b c d e f", "a b c d e f", "g"]).withColumns({"jj_gone": F.lit(1), "JJ_GONE_": F.lit(2), "class_id": F.lit(3)})
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 2]


def test_near_copies_of_the_documents_are_found(spark):
    """Recall of links against all pairs, whole sets."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    by = {}
    for i, t in rows:
        if (s := sets(t)) is not None:
            by.setdefault(s, []).append(i)
    keys = sorted(by, key=len)
    links = dict.fromkeys(map(id, keys), 0)
    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            if 4 * len(b) > 5 * len(a):
                break
            if 9 * len(a & b) >= 4 * (len(a) + len(b)):  # the same as 0.8 of the union
                links[id(a)] += 1
                links[id(b)] += 1
    want = {i: links[id(k)] for k in keys for i in by[k]}
    got = {r["doc_id"]: r["n_links"] for r in J.jaccard_join(docs).collect()}
    assert sum(want.values()) > 0 and all(got[i] <= n for i, n in want.items())
    assert sum(got[i] for i in want) >= 0.99 * sum(want.values())
