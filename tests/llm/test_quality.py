import re

import pytest
from pyspark.sql import functions as F

from keidai.llm.quality import SQL, base_counts, binomial_cdf, quality_rules, safe_levels

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = [x for x in SPACE.split(text) if x]
    lines = [x for x in text.split("\n") if SPACE.sub("", x)]
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {p for v in at.values() if len(v) > 1 for i in v for p in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \n\t", "a b c d e", "a b c d e a b c d e", "x " * 30, "é 😀 # | <b>\n\nsame\nsame\n same", "1 2 3 4 5 6 1 2 3 4 5 7 2 3 4 5 6", "a b\nc d\nc d\n" * 400, "\x0b\x0c\r word", "a b c"]


def test_base_counts(make):
    for r in base_counts(make(TEXTS), "doc_id", "text").collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(TEXTS[r["qr_id"]])


def test_binomial_tail(spark):
    import math

    cases = [(0, 100, 0.05), (2, 200, 0.02), (3, 1000, 0.005), (9, 10, 0.5)]
    df = spark.createDataFrame(cases, "k long, n long, p double")
    for r in df.select("k", "n", "p", binomial_cdf(F.col("k"), F.col("n"), F.col("p")).alias("c")).collect():
        exact = sum(math.comb(r["n"], j) * r["p"] ** j * (1 - r["p"]) ** (r["n"] - j) for j in range(r["k"] + 1))
        assert r["c"] == pytest.approx(exact if r["k"] < r["n"] * r["p"] else 1.0)


def test_cutoffs_need_evidence(spark, make):
    """With few labels nothing is safe; with many clean ones the lowest cutoffs are, and a stratum's own share decides."""
    rows = [(i, " ".join(f"w{j}" for j in range(20))) for i in range(6000)]
    docs = make(rows + [(9000, " ".join(f"#v{j}" for j in range(30)))])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(6000)] + [(9000, 0, 0)], "doc_id long, quality int, toxic int")
    found = quality_rules(docs, labels)
    assert found.where("NOT kept").select("doc_id").collect() == [(9000,)]
    few = quality_rules(docs, labels.where("doc_id < 50 OR doc_id = 9000"))
    assert few.where("NOT kept").count() == 0


def test_base_failures_nulls_and_empty_tables(spark, make):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality_rules(make([None, "", "short text", "a b c d e " * 10, " ".join(map(str, range(20)))]), labels).collect()}
    assert found == {0: (True, False), 1: (True, False), 2: (True, False), 3: (True, False), 4: (False, True)}
    assert quality_rules(make(["x"]).limit(0), labels).count() == 0
    assert safe_levels(spark.createDataFrame([], "qr_id long, qr_stratum string, qr_level int"), labels.select(F.col("doc_id").alias("qr_good"))).count() == 0


def test_levels_against_plain_binomial_tails(spark):
    """Strata of different sizes and rejections: the strictest level up to which each is refuted, at delta over the strata."""
    import math

    rows, good = [], []
    for stratum, (n, bad) in {"a": (3000, {3: 5, 6: 30, 7: 40}), "b": (300, {8: 1}), "c": (216, {}), "d": (150, {}), "": (900, {1: 60})}.items():
        levels = [t for t, k in bad.items() for _ in range(k)]
        rows += [(len(rows) + i, stratum, t) for i, t in enumerate(levels + [9] * (n - len(levels)))]
    good = [(i,) for i, _, _ in rows]
    rows += [(rows[0][0], rows[0][1], 9), rows[5]]  # repeated ids count once, by their strictest row
    found = {r["qr_stratum"]: r["safe"] for r in safe_levels(spark.createDataFrame(rows, "qr_id long, qr_stratum string, qr_level int"), spark.createDataFrame(good, "qr_good long")).collect()}
    want = {}
    for s in "abcd", "":
        for stratum in s or [""]:
            level = {i: min(t for j, x, t in rows if j == i) for i, x, _ in rows if x == stratum}
            safe, n = 0, len(level)
            for t in range(1, 9):
                k = sum(v <= t for v in level.values())
                tail = sum(math.comb(n, j) * 0.02**j * 0.98 ** (n - j) for j in range(k + 1))
                if tail > 0.05 / 5:
                    break
                safe = t
            if safe:
                want[stratum] = safe
    assert found == want and set(want) == {"a", "b"}


def test_with_enough_labels_rows_equal_the_sql(spark, duck):
    """Where cutoffs exist, Spark and DuckDB agree on what they reject; null strata, repeated rows and long texts among the documents."""
    import random

    rng = random.Random(5)
    rows, labels = [], []
    for i in range(4000):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(10, 40))]
        text = " ".join(words) + ("\nsame line\nsame line" if i % 50 == 0 else "") + (" ###" * rng.randint(1, 9) if i % 97 == 0 else "")
        rows.append((i, text, ("en", "de", None, "rare")[(i % 8 > 4) + (i % 8 > 6) + (i % 200 == 199)], "s", len(text)))
        labels.append((i, 1 if i % 97 else 0, 0))
    rows.append((5000, " ".join(f"x{i}" for i in range(2000)) + "".join(f" #y{i}" for i in range(900)), "en", "s", 0))
    labels += labels[:100]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    con = duck.cursor()
    con.execute("CREATE SCHEMA own")
    con.execute("USE own")
    con.register("documents", documents.toPandas())
    con.register("labels", marks.toPandas())
    found = sorted(tuple(r) for r in quality_rules(documents, marks).collect())
    assert found == sorted(con.execute(SQL).fetchall())
    rejected = {r[0] for r in found if not r[6] and not r[7]}
    assert 5000 in rejected and 20 < len(rejected) < 100
    assert sorted(tuple(r) for r in quality_rules(documents.unionAll(documents.where("doc_id < 3")), marks).distinct().collect()) == found


def test_a_very_long_text(spark, make):
    text = " ".join(f"x{i}" for i in range(300_000)) + "\nsame\nsame" * 1000
    found = base_counts(make([text]), "doc_id", "text").first()
    assert (found["n_words"], found["n_dup_lines"], found["n_repeat_words"]) == (302_000, 1999, 2000)


def test_cutoffs_exist_at_the_smallest_checked_scale(spark):
    tables = [spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels")]
    assert quality_rules(*tables).where("NOT base_failed AND NOT kept").count() > 0
