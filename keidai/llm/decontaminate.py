"""Benchmark decontamination: winnowed k-gram fingerprints find shared spans, which are then extended and verified word by word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keidai.llm.common import small, without, written

SPAN = 13  # words of a shared span that must be found
K = 8  # words of a fingerprinted k-gram
WINNOW = SPAN - K + 1  # k-grams of a winnowing window: each SPAN words hold one whole window
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What is between words in a text whose A-Z are still capitals.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A capital letter other than A-Z, which lower() would change too.
OTHER_CAPITAL = r"[\p{javaUpperCase}\p{javaTitleCase}&&[^A-Z]]"
POSITION_BITS = 31  # of a word's place in its text, beside the high bits of a hash
#: Columns that stand for a text: two hashes, 128 bits.
KEY = ["dc_a", "dc_b"]
SEED = 20240229


def text_key(text: str) -> list[Column]:
    return [F.xxhash64(text).alias(KEY[0]), F.xxhash64(F.lit(SEED), text).alias(KEY[1])]


def words_of(text: Column) -> Column:
    """Runs of characters other than ASCII non-alphanumerics, with A-Z in lower case; none for null."""
    text = F.coalesce(text, F.lit(""))
    # lower() is many times faster than translate(), and does the same where A-Z are the only capitals.
    lower = F.when(text.rlike(OTHER_CAPITAL), F.translate(text, LETTERS, LETTERS.lower())).otherwise(F.lower(text))
    return F.array_remove(F.split(lower, NOT_WORD, -1), "")


def word_hashes(words: str) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def gram(hashes: Column, at: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), *[F.get(hashes, at + j) for j in range(k)])


def winnow(hashes: str, k: int, window: int) -> Column:
    """Of each `window` consecutive k-grams the one with the least hash (of its 33 high bits, the leftmost on ties): the places of all these."""
    n = F.size(hashes)
    grams = lambda: F.transform(
        F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.shiftleft(gram(F.col(hashes), i, k), POSITION_BITS).bitwiseOR(i.cast("long"))
    )
    place = lambda v: v.bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int")
    if window == 1:
        return F.when(n >= k, F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))))
    least = F.transform(
        F.array(grams()),
        lambda g: F.transform(F.sequence(F.lit(0), F.greatest(n - k - window + 1, F.lit(0))), lambda i: F.least(*[F.get(g, i + j) for j in range(window)])),
    )[0]
    return F.when(n >= k + window - 1, F.transform(F.array_distinct(least), place))


def fingerprints(hashed: DataFrame, keys: list[str], hashes: str, k: int, window: int, around: int | None = None) -> DataFrame:
    """One row for each fingerprint of a row: keys, dc_fp (64 bits), dc_pos; with `around` also dc_ctx, the word hashes from so many before it to so many after it."""
    context = lambda p: F.transform(F.sequence(p - around, p + (k + around - 1)), lambda j: F.when(j >= 0, F.get(F.col(hashes), j)))
    made = F.transform(winnow(hashes, k, window), lambda p: F.struct(p.alias("pos"), gram(F.col(hashes), p, k).alias("fp"), *([] if around is None else [context(p).alias("ctx")])))
    return (
        hashed.select(*keys, F.explode_outer(made).alias("dc_v"))
        .where(F.col("dc_v").isNotNull())
        .select(*keys, F.col("dc_v.fp").alias("dc_fp"), F.col("dc_v.pos").alias("dc_pos"), *([] if around is None else [F.col("dc_v.ctx").alias("dc_ctx")]))
    )


def benchmark_fingerprints(items: DataFrame, item_id: str, text: str) -> tuple[DataFrame, list[int]]:
    """Fingerprints of all items with the words around each and the items that have these, and the lengths of the items that are shorter than a span."""
    hashed = written(
        items.where(F.col(item_id).isNotNull())
        .select(F.col(item_id).cast("string").alias("dc_item"), words_of(F.col(text)).alias("dc_words"))
        .select("dc_item", word_hashes("dc_words").alias("dc_iwh"))
        .where(F.size("dc_iwh") > 0)
        .distinct(),
        "benchmark-words",
    )
    short = sorted(r[0] for r in hashed.select(F.size("dc_iwh").alias("n")).where(F.col("n") < SPAN).distinct().collect())  # at most SPAN - 1 numbers
    around = SPAN - K
    out = fingerprints(hashed, ["dc_item"], "dc_iwh", K, WINNOW, around).withColumns({"dc_len": F.lit(SPAN), "dc_left": F.lit(around)})
    for m in short:
        out = out.unionByName(fingerprints(hashed.where(F.size("dc_iwh") == m), ["dc_item"], "dc_iwh", m, 1, 0).withColumns({"dc_len": F.lit(m), "dc_left": F.lit(0)}))
    # A passage that many items share is one row, with its items.
    return written(out.groupBy("dc_len", "dc_fp", "dc_left", "dc_ctx").agg(F.sort_array(F.collect_set("dc_item")).alias("dc_in")), "benchmark-fingerprints"), short


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Marks the document words that lie in any occurrence of an item's window of 13 words.

    Both sides are winnowed (8-word k-grams, 6 to a window), which keeps a fingerprint of every span of 13 words; equal
    fingerprints are extended over the words around them and only whole windows count, so the result is exact. An
    item of fewer than 13 words is one window and is fingerprinted whole. Returns the input columns and n_words,
    n_hit, n_items (long), items_sha256, contaminated (n_hit > 0 and 20 * n_hit >= n_words).

    Null and empty texts have no words. Items with a null id or no words are ignored; repeated items count once by
    id. What is found depends on the text alone: null ids and repeated rows are marked like any other. An empty benchmark marks
    nothing. Columns named as the new ones, in whatever case, are replaced; all others stay, whatever their names.
    """
    made = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    docs = without(docs, made)
    bench, short = benchmark_fingerprints(items, item_id, item_text)
    texts = docs.where(F.col(text_col).isNotNull()).select(*text_key(text_col), F.col(text_col).alias("dc_text"))
    hashed = texts.select(*KEY, words_of(F.col("dc_text")).alias("dc_words")).select(*KEY, word_hashes("dc_words").alias("dc_wh"))
    prints = fingerprints(hashed, KEY, "dc_wh", K, WINNOW).withColumn("dc_len", F.lit(SPAN))
    for m in short:
        prints = prints.unionByName(fingerprints(hashed, KEY, "dc_wh", m, 1).withColumn("dc_len", F.lit(m)))
    hits = written(
        prints.join(small(bench), ["dc_len", "dc_fp"])
        .distinct()
        .groupBy(*KEY)
        .agg(F.collect_list(F.struct((F.col("dc_pos") - F.col("dc_left")).alias("at"), "dc_len", "dc_in", "dc_ctx")).alias("dc_hits")),
        "benchmark-hits",
    )
    # Written with their hashed words: read as a plain column, these aren't split and hashed again for every word that is compared.
    candidates = written(
        texts.join(small(hits), KEY).select(*KEY, "dc_hits", words_of(F.col("dc_text")).alias("dc_words")).select(*KEY, "dc_hits", word_hashes("dc_words").alias("dc_wh")),
        "benchmark-candidates",
    )

    def found(hit: Column) -> Column:
        """The hit's item and the words of the windows that agree in every word."""
        same = F.transform(hit["dc_ctx"], lambda x, j: F.coalesce(x == F.when(hit["at"] + j >= 0, F.get(F.col("dc_wh"), hit["at"] + j)), F.lit(False)))
        starts = F.sequence(F.lit(0), F.size(hit["dc_ctx"]) - hit["dc_len"])
        windows = F.transform(F.array(same), lambda g: F.filter(starts, lambda s: F.forall(F.slice(g, s + 1, hit["dc_len"]), lambda x: x)))[0]
        return F.struct(hit["dc_in"].alias("items"), F.flatten(F.transform(windows, lambda s: F.sequence(hit["at"] + s, hit["at"] + s + hit["dc_len"] - 1))).alias("words"))

    verified = candidates.select(*KEY, F.filter(F.transform("dc_hits", found), lambda f: F.size(f["words"]) > 0).alias("dc_found")).select(
        *KEY,
        F.size(F.array_distinct(F.flatten(F.transform("dc_found", lambda f: f["words"])))).cast("long").alias("dc_n_hit"),
        F.sort_array(F.array_distinct(F.flatten(F.transform("dc_found", lambda f: f["items"])))).alias("dc_items"),
    )
    marked = written(verified.where("dc_n_hit > 0").distinct(), "benchmark-marked")  # repeated texts are one
    # A row's own columns stay in a struct, where no name of theirs can meet one of these.
    counted = (
        docs.select(F.struct("*").alias("dc_row"), *text_key(text_col))
        .join(small(marked), KEY, "left")
        .select(
            "dc_row",
            F.size(F.array_remove(F.split(F.coalesce(F.col("dc_row").getField(text_col), F.lit("")), BETWEEN, -1), "")).cast("long").alias("n_words"),
            F.coalesce("dc_n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("dc_items", F.array().cast("array<string>")).alias("dc_items"),
        )
    )
    n_hit = F.col("n_hit")
    return counted.select(
        *[F.col("dc_row").getField(c).alias(c) for c in docs.columns],
        "n_words",
        "n_hit",
        F.size("dc_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("dc_items", ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


#: DuckDB, over `documents` and `benchmark`.
SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
bi AS (SELECT item, w, least(len(w), 13) AS m FROM bw WHERE len(w) > 0),
bp AS (SELECT item, m, w, unnest(range(len(w) - m + 1)) AS p FROM bi),
b AS (SELECT DISTINCT item, m, array_to_string(w[p + 1 : p + m], ' ') AS win FROM bp),
ms AS (SELECT DISTINCT m FROM b),
dp AS (SELECT doc_id, m, w, unnest(range(len(w) - m + 1)) AS p FROM dw, ms WHERE len(w) >= m),
d AS (SELECT doc_id, m, p, array_to_string(w[p + 1 : p + m], ' ') AS win FROM dp),
h AS (SELECT d.doc_id, d.m, d.p, b.item FROM d JOIN b ON d.m = b.m AND d.win = b.win),
hp AS (SELECT DISTINCT doc_id, m, p FROM h),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS pos FROM hp) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(i.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(dw.w) AS contaminated
FROM dw LEFT JOIN c ON dw.doc_id = c.doc_id LEFT JOIN i ON dw.doc_id = i.doc_id
"""
