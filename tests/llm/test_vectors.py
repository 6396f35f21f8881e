"""Nearest neighbours against all distances, and codes against a plain version."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from keidai.llm import nearest, vector_codes

ROWS = "vec_id long, embedding array<float>, label int, v string, cell int, rep string, score double"


@pytest.fixture
def vectors(spark):
    """Rows (id, vector) or (id, vector, label), with columns whose names the operators use inside."""
    return lambda rows: spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else 0, "x", 1, "y", 0.5) for r in rows], ROWS)


def plain_nearest(rows, queries, k):
    out = {}
    for q in queries:
        v = np.array(rows[q], np.float64)
        found = sorted((float(np.sqrt(((np.array(x, np.float64) - v) ** 2).sum())), i) for i, x in rows.items() if i != q)
        out[q] = found[:k]
    return out


def found_nearest(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["vec_id"])
    return {q: [x[i] for i in range(1, len(x) + 1)] for q, x in out.items()}


def test_recall_over_the_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = {r["vec_id"]: r["embedding"] for r in df.collect()}
    want = plain_nearest(rows, [i for i in rows if i % 100 == 0], 10)
    got = found_nearest(nearest.nearest_neighbours(df, F.col("id") % 100 == 0))
    assert got.keys() == want.keys() and all(len(x) == 10 for x in got.values())
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.97 * 10 * len(want)
    assert all(score == pytest.approx(dict((i, d) for d, i in plain_nearest(rows, [q], len(rows))[q])[i], rel=1e-12) for q in got for score, i in got[q])


def test_windows_prune_what_is_far(spark):
    """Clusters far apart: most blocks are not searched, and what is found is exact."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 16)) * 50
    v = np.concatenate([c + rng.normal(size=(300, 16)) for c in centres])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = found_nearest(nearest.nearest_neighbours(df, F.col("id") % 100 == 0, k=5))
    want = plain_nearest(dict(enumerate(v.tolist())), range(0, len(v), 100), 5)
    assert sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want) >= 0.95 * 5 * len(want)
    axes = nearest.projections(16, 64)
    keys = np.sort((v[:300] @ axes).T.astype("<f4"), axis=1)
    block = nearest.Block({"n": 300, "ids": np.arange(300).astype("<i8").tobytes(), "vectors": v[:300].astype("<f8").tobytes(), "keys": keys.tobytes(), "places": np.zeros((64, 300), "<u2").tobytes()}, 16, 64)
    at = np.stack([v[0] @ axes, v[2000] @ axes])
    assert block.reached(at, np.full((2, 64), 3.0), nearest.threshold(64, 0.7, 2.5)).tolist() == [0]


def test_more_chunks_of_queries_give_the_same(spark, sf, monkeypatch):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = found_nearest(nearest.nearest_neighbours(df, F.col("id") % 50 == 0))
    monkeypatch.setattr(nearest, "CHUNK_BYTES", 1024)
    assert found_nearest(nearest.nearest_neighbours(df, F.col("id") % 50 == 0)) == want


def test_copies_ties_and_rows_that_take_no_part(vectors):
    one, nan = [1.0, 2.0], float("nan")
    rows = [(i, one) for i in range(0, 60)] + [(100, [1.0, 3.0]), (200, None), (300, [0.0, 0.0]), (400, [nan, 1.0]), (500, [None, 1.0]), (600, [1.0]), (None, one), (700, []), (800, [float("inf"), 0.0])]
    got = found_nearest(nearest.nearest_neighbours(vectors(rows), F.col("id") % 100 == 0))
    assert got == {0: [(0.0, i) for i in range(1, 11)], 100: [(1.0, i) for i in range(10)]}


def test_repeated_ids_count_once_and_few_candidates_are_all_returned(vectors):
    got = found_nearest(nearest.nearest_neighbours(vectors([(0, [0.0, 1.0]), (0, [5.0, 5.0]), (0, [0.0, 1.0]), (1, [0.0, 2.0]), (1, [0.0, 2.0]), (2, [-0.0, 4.0])]), F.col("id") % 100 == 0))
    assert got == {0: [(1.0, 1), (3.0, 2)]}
    assert nearest.nearest_neighbours(vectors([(0, [1.0, 1.0])]), F.col("id") % 100 == 0).collect() == []
    for rows in ([], [(1, None)], [(1, [1.0]), (2, [2.0])]):
        empty = nearest.nearest_neighbours(vectors(rows), F.col("id") % 100 == 0)
        assert empty.collect() == [] and empty.columns == ["query_id", "rank", "vec_id", "score"]


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """rows (id, vector, label) sorted by id; every step as the contract says it, in Python's whole numbers."""
    q = [[int(np.floor(1024 * float(x))) for x in v] for _, v, _ in rows]
    each = len(q[0]) // parts
    cut = [[v[p * each : (p + 1) * each] for p in range(parts)] for v in q]
    books = [[cut[i][p] for i in range(min(entries, len(rows)))] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            found = [near(v[p], book)[1] for v in cut]
            for i in range(len(book)):
                own = [v[p] for v, f in zip(cut, found) if f == i]
                if own:
                    book[i] = [sum(c) // len(own) for c in zip(*own)]
    last = [[near(v[p], book) for p, book in enumerate(books)] for v in cut]
    errors = [sum(d for d, _ in x) for x in last]
    sha = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return [(r[0], "".join(f"{i:02x}" for _, i in x), e, sum(o for o, s in zip(errors, rows) if s[2] == r[2]), sha) for r, x, e in zip(rows, last, errors)]


def coded(df, **more):
    return sorted((tuple(r) for r in vector_codes.vector_codes(df, **more).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def test_codes_equal_a_plain_version(vectors):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)], None if i % 5 == 0 else i % 3) for i in range(70)]
    assert coded(vectors(rows), entries=6) == sorted(plain_codes(rows, entries=6), key=repr)
    assert coded(vectors(rows[::-1])) == sorted(plain_codes(rows), key=repr)


def test_blocks_of_any_width_merge_alike(vectors, monkeypatch):
    rows = [(i, [float(i * 37 % 11), -float(i), 3.0e4 * (i % 4), 0.25], i % 2) for i in range(40)]
    want = sorted(plain_codes(rows, entries=4), key=repr)
    assert coded(vectors(rows).repartition(7), entries=4) == want
    monkeypatch.setattr(vector_codes, "AT_ONCE", 3)
    assert coded(vectors(rows), entries=4) == want


def test_rows_without_a_usable_vector_are_left_out(vectors):
    nan = float("nan")
    rows = [(3, [1.0, 2.0, 3.0, 4.0], 1), (3, [1.0, 2.0, 3.0, 4.0], 1), (None, [1.0, 2.0, 3.0, 4.5], None), (5, None, 1), (6, [nan, 1.0, 1.0, 1.0], 1), (7, [None, 1.0, 1.0, 1.0], 2), (8, [], 1), (9, [1.0], 1)]
    got = coded(vectors(rows))
    assert [r[0] for r in got] == [3, 3, None] and [r[1] for r in got] == ["00000000"] * 2 + ["00000002"] and {r[2] for r in got} == {0}
    assert vector_codes.vector_codes(vectors([])).collect() == []
    assert vector_codes.vector_codes(vectors([])).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_components_too_large_for_whole_numbers_are_told(vectors):
    with pytest.raises(Exception, match="pass 64 bits"):
        vector_codes.vector_codes(vectors([(1, [1e30, 1.0, 1.0, 1.0])])).collect()
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.vector_codes(vectors([(1, [1.0, 1.0, 1.0])]))
