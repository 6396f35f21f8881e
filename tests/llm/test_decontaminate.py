import random
import re

from keidai.llm.decontaminate import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    windows = {}
    for k, t in items:
        w = words(t)
        if w and k is not None:
            m = min(13, len(w))
            for i in range(len(w) - m + 1):
                windows.setdefault(tuple(w[i : i + m]), set()).add(str(k))
    lengths = {len(w) for w in windows}
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for m in lengths:
            for i in range(len(w) - m + 1):
                if (key := tuple(w[i : i + m])) in windows:
                    hit |= set(range(i, i + m))
                    found |= windows[key]
        out[d] = (len(w), len(hit), len(found), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def run(spark, make, docs, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in decontaminate(make(docs), bench).collect()}


def test_every_span_of_thirteen_words_is_found(spark, make):
    rng = random.Random(11)
    pool = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(pool) for _ in range(n))) for i, n in enumerate([13, 14, 20, 40, 3, 12, 1, 0, 25])] + [(9, "a " * 30), (10, None), (2, "one two three four"), (0, "É É Über straße")]
    docs = []
    for i in range(120):
        w = [rng.choice(pool) for _ in range(rng.randint(0, 60))]
        k, t = rng.choice(items)
        src = (t or "").split()
        at = rng.randint(0, len(src))
        w[len(w) // 2 : len(w) // 2] = src[at : at + rng.randint(0, 30)]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(x.upper() if rng.random() < 0.2 else x for x in w)))
    docs += [(200, None), (201, ""), (202, "..."), (203, "A " * 50), (204, "é é über straße"), (205, "É É Über straße")]
    assert run(spark, make, docs, items) == brute(docs, items)


def test_empty_tables_and_repeated_rows(spark, make):
    text = " ".join(f"k{i}" for i in range(20))
    assert run(spark, make, [(0, text)], []) == {0: (20, 0, 0, False)}
    found = decontaminate(make([(1, text), (1, text)]), spark.createDataFrame([(5, text), (5, text)], "item_id long, text string")).collect()
    assert [(r["n_hit"], r["n_items"]) for r in found] == [(20, 1), (20, 1)]
    assert decontaminate(make([(1, text)]).limit(0), spark.createDataFrame([(5, text)], "item_id long, text string")).count() == 0


def test_null_ids_are_searched_and_clashing_names_stay(spark, make):
    from pyspark.sql import functions as F

    text = " ".join(f"k{i}" for i in range(20))
    names = ("dc_id", "dc_items", "dc_doc_text", "dc_text", "dc_n_hit", "dc_a", "dc_b", "dc_row", "DC_WORDS")
    docs = make([(None, text), (3, text), (None, "clean words"), (3, text + " more"), (None, None)]).withColumns({c: F.lit(c) for c in names}).withColumn("N_Hit", F.lit(-1))
    found = decontaminate(docs, spark.createDataFrame([(5, text), (6, text)], "item_id long, text string"))
    assert [c for c in found.columns if c.lower() == "n_hit"] == ["n_hit"]
    rows = found.collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in rows) == [
        ("3", 20, 20, 2, True), ("3", 21, 20, 2, True), ("None", 0, 0, 0, False), ("None", 2, 0, 0, False), ("None", 20, 20, 2, True),
    ]
    assert all(r[c] == c for r in rows for c in names)


def test_without_broadcasts_and_a_long_text(spark, make, monkeypatch):
    from keidai.llm import common

    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    items = [(i, " ".join(f"i{i}w{j}" for j in range(30))) for i in range(5)]
    docs = [(0, " ".join(f"f{j}" for j in range(100_000)) + " " + items[2][1]), (1, items[3][1]), (2, "x"), (3, items[3][1])]
    assert run(spark, make, docs, items) == brute(docs, items)
