"""Quality rules whose cutoffs are chosen on labelled holdouts so that few good documents are rejected, with a guarantee."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keidai.llm.common import written

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
RUN = 5  # words of a window that counts as repeated
#: At most this share of a stratum's good documents may be rejected by the cutoffs ...
RISK = 0.02
#: ... with this probability that any stratum breaks it.
DELTA = 0.05
#: Per-mille features, of integers: name, SQL over the base counts (the same in Spark and DuckDB), and a cutoff for each level, lenient
#: to strict. At a level a document is rejected if any feature is over its cutoff there; so each level rejects what the ones before it do.
FEATURES = (
    ("symbols", "least(1000 * n_symbols // greatest(n_words, 1), 100000)", (1000, 700, 500, 400, 300, 200, 100, 50)),
    ("dup_lines", "least(1000 * n_dup_lines // greatest(n_lines, 1), 100000)", (900, 800, 700, 600, 500, 400, 300, 200)),
    ("repeats", "1000 * n_repeat_words // greatest(n_words, 1)", (200, 190, 180, 170, 160, 150, 130, 110)),
    ("long_words", "greatest(0, 1000 * word_chars // greatest(n_words, 1) - 8000) // 10", (1000, 800, 600, 500, 400, 300, 200, 150)),
)
LEVELS = len(FEATURES[0][2])


def base_counts(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and n_lines (lines with a word) of every whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = [F.col(id_col).alias("qr_id"), *more]
    names = ["qr_id", *[f"qr_more{i}" for i in range(len(more))]]
    words = docs.select(kept[0], *[m.alias(f"qr_more{i}") for i, m in enumerate(more)], text.alias("qr_text")).select(
        *names,
        F.array_remove(F.split("qr_text", r"[\x20\x09-\x0D]+", -1), "").alias("qr_words"),
        F.length(F.translate("qr_text", SPACE, "")).alias("word_chars"),
        (F.length("qr_text") - F.length(F.translate("qr_text", SYMBOLS, ""))).alias("n_symbols"),
        F.filter(F.split("qr_text", "\n", -1), lambda line: F.translate(line, SPACE, "") != "").alias("qr_lines"),
    )
    n = F.size("qr_words")
    counts = ["word_chars", "n_symbols"]
    hashed = words.select(
        *names,
        n.alias("n_words"),
        *counts,
        F.size("qr_lines").alias("n_lines"),
        (F.size("qr_lines") - F.size(F.array_distinct("qr_lines"))).alias("n_dup_lines"),
        F.when(
            n > RUN,
            F.transform(F.sequence(F.lit(0), F.greatest(n - RUN, F.lit(0))), lambda i: F.xxhash64(*[F.get(F.col("qr_words"), i + k) for k in range(RUN)])),
        ).alias("qr_runs"),
    )
    counts += ["n_words", "n_lines", "n_dup_lines"]
    # Most texts repeat nothing: only the others are sorted.
    sorted_runs = hashed.select(
        *names,
        *counts,
        F.when(
            F.size(F.array_distinct("qr_runs")) < F.size("qr_runs"), F.sort_array(F.transform("qr_runs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        ).alias("qr_sorted"),
    )
    runs = F.col("qr_sorted")
    same = lambda a, b: F.coalesce(F.get(runs, a)["h"] == F.get(runs, b)["h"], F.lit(False))
    starts = sorted_runs.select(
        *names,
        *counts,
        F.sort_array(
            F.transform(
                F.filter(F.transform(runs, lambda r, j: F.struct(r["i"].alias("i"), (same(j, j + 1) | F.when(j > 0, same(j, j - 1)).otherwise(False)).alias("two"))), lambda r: r["two"]),
                lambda r: r["i"],
            )
        ).alias("qr_starts"),
    )
    s = F.col("qr_starts")
    steps = F.zip_with(F.slice(s, 2, F.size(s)), F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(RUN)))
    repeated = F.when(F.size(s) > 0, F.lit(RUN) + F.aggregate(steps, F.lit(0), lambda t, x: t + x)).otherwise(F.lit(0))
    return starts.select(*names, *[F.col(c).cast("long").alias(c) for c in counts], repeated.cast("long").alias("n_repeat_words"))


def binomial_cdf(k: Column, n: Column, p: Column) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), summed term by term in logarithms; 1 where k >= n * p, which no test here needs finer."""
    odds = F.ln(p / (1 - p))
    first = n * F.ln(1 - p)
    terms = F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1).cast("long"))),
        F.struct(first.alias("log"), F.exp(first).alias("sum")),
        lambda acc, j: F.struct(
            (acc["log"] + F.ln((n - j + 1) / j) + odds).alias("log"), F.when(j <= k, acc["sum"] + F.exp(acc["log"] + F.ln((n - j + 1) / j) + odds)).otherwise(acc["sum"]).alias("sum")
        ),
        lambda acc: acc["sum"],
    )
    return F.when(k >= n * p, F.lit(1.0)).otherwise(terms)


def level_sql() -> str:
    """The first level that rejects a document, beyond the base rule; LEVELS + 1 if none does. The same in Spark and DuckDB, over f_ columns."""
    over = lambda t: " OR ".join(f"f_{name} > {cuts[t]}" for name, _, cuts in FEATURES)
    return f"CASE WHEN base_failed THEN {LEVELS + 1} " + " ".join(f"WHEN {over(t)} THEN {t + 1}" for t in range(LEVELS)) + f" ELSE {LEVELS + 1} END"


def safe_levels(features: DataFrame, good: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The strictest safe level of each stratum: qr_stratum, safe; no row where none is.

    `features` has qr_id, qr_stratum and qr_level, `good` the ids (qr_good) labelled good; an id counts once, by its strictest row. A level
    is safe if the hypothesis "it rejects more than `risk` of the stratum's good documents" is refuted by the exact binomial tail at
    delta over the number of strata (Bonferroni). Within a stratum levels are tested in order and testing ends at the first that isn't
    safe, so these need no further correction.
    """
    labelled = features.join(good, F.col("qr_id") == F.col("qr_good")).groupBy("qr_stratum", "qr_id").agg(F.min("qr_level").alias("qr_level"))
    counted = labelled.groupBy("qr_stratum").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("qr_level") <= t).alias(f"k{t}") for t in range(1, LEVELS + 1)])
    tests = counted.select("qr_stratum", "n", F.explode(F.array(*[F.struct(F.lit(t).alias("level"), F.col(f"k{t}").alias("k")) for t in range(1, LEVELS + 1)])).alias("t")).select("qr_stratum", "n", "t.*")
    number = counted.select(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("strata"))
    refuted = binomial_cdf(F.col("k"), F.col("n"), F.lit(risk)) <= F.lit(delta) / F.col("strata")
    tested = tests.crossJoin(F.broadcast(number)).withColumn("refuted", refuted)  # one row, of the number of strata
    safe = F.coalesce(F.min(F.when(~F.col("refuted"), F.col("level"))), F.lit(LEVELS + 1)) - 1
    return tested.groupBy("qr_stratum").agg(safe.alias("safe")).where("safe > 0")


def quality_rules(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang", risk: float = RISK, delta: float = DELTA
) -> DataFrame:
    """Base counts, base_failed and kept of every document.

    Rejects a document that fails the base rule, or whose symbols, duplicate lines, repeated words or word length exceed the
    cutoffs of its stratum's level. Levels come from documents labelled good (labels: doc_id, quality), see safe_levels().

    Null and empty texts have no words and fail the base rule. A null stratum is a stratum of its own; a stratum with too
    few labels rejects by the base rule only. Repeated label rows count once; ids labelled both good and bad are not good.
    Repeated documents are judged alike, and count once as labelled; a null id is judged by its stratum's level.
    """
    counts = base_counts(docs, id_col, text_col, F.coalesce(F.col(stratum).cast("string"), F.lit(""))).withColumnRenamed("qr_more0", "qr_stratum")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    features = counts.withColumn("base_failed", failed).withColumns({f"f_{name}": F.expr(sql.replace("//", "div")) for name, sql, _ in FEATURES})
    features = written(features.withColumn("qr_level", F.expr(level_sql())).drop(*[f"f_{name}" for name, _, _ in FEATURES]), "quality-counts")
    good = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("qr_good")).agg(F.min("quality").alias("q")).where("q = 1").select("qr_good")
    # A row a stratum; where one stratum holds most documents adaptive execution splits them.
    joined = features.join(written(safe_levels(features, good, risk, delta), "quality-levels"), "qr_stratum", "left")
    return joined.select(
        F.col("qr_id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.col("qr_level") > F.coalesce("safe", F.lit(0)))).alias("kept"),
    )


def _sql() -> str:
    feature = ", ".join(f"CAST({sql} AS BIGINT) AS f_{name}" for name, sql, _ in FEATURES)
    over = f"SELECT *, {level_sql()} AS level FROM (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {feature} FROM b)"
    blank = r"[\x20\x09-\x0D]"
    return f"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, stratum, text, list_filter(regexp_split_to_array(text, '{blank}+'), lambda x: x <> '') AS w,
      list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '{blank}', '', 'g') <> '') AS l FROM t),
r AS (SELECT doc_id, unnest(range(len(w) - 4)) AS p, w FROM w WHERE len(w) > 5),
v AS (SELECT doc_id, p, array_to_string(w[p + 1 : p + 5], ' ') AS win FROM r),
x AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, win) AS n FROM v) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(p, p + 5)) AS pos FROM x) GROUP BY doc_id),
b AS (SELECT w.doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{blank}', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
      CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
f AS ({over}),
q AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
g AS (SELECT stratum, doc_id, min(level) AS level FROM f JOIN q USING (doc_id) GROUP BY ALL),
c AS (SELECT stratum, t, count(*) AS n, count(*) FILTER (WHERE level <= t) AS k FROM g, (SELECT unnest(range(1, {LEVELS + 1})) AS t) GROUP BY stratum, t),
terms AS (SELECT stratum, t, n, k, unnest(range(0, k + 1)) AS j FROM c WHERE k < n * {RISK!r}),
logs AS (SELECT stratum, t, n * ln(1 - {RISK!r}) + sum(CASE WHEN j = 0 THEN 0 ELSE ln((n - j + 1) / CAST(j AS DOUBLE)) + ln({RISK!r} / (1 - {RISK!r})) END)
         OVER (PARTITION BY stratum, t ORDER BY j) AS lp FROM terms),
cdf AS (SELECT stratum, t, sum(exp(lp)) AS pv FROM logs GROUP BY stratum, t),
ok AS (SELECT c.stratum, c.t, coalesce(pv <= {DELTA!r} / (SELECT count(DISTINCT stratum) FROM g), false) AS refuted FROM c LEFT JOIN cdf ON c.stratum = cdf.stratum AND c.t = cdf.t),
ch AS (SELECT stratum, coalesce(min(CASE WHEN NOT refuted THEN t END), {LEVELS + 1}) - 1 AS safe FROM ok GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND level > coalesce(safe, 0) AS kept FROM f LEFT JOIN ch ON f.stratum = ch.stratum
"""


#: DuckDB, over `documents` and `labels`.
SQL = _sql()
