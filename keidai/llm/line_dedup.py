"""Line dedup: overlapping windows of consecutive lines, found again anywhere in the corpus, lose their later occurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keidai.llm.common import without, written

WINDOW = 3


def line_windows(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """One row for each run of `window` consecutive lines that holds a visible character: document key, position, 96-bit hash."""
    lines = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("ld_id"), F.xxhash64(text_col).alias("ld_text"), F.split(F.col(text_col), "\n", -1).alias("ld_lines")
    )
    hashed = lines.select(
        "ld_id",
        "ld_text",
        F.transform("ld_lines", lambda line: F.when(F.trim(line) == "", F.lit(None).cast("long")).otherwise(F.xxhash64(line))).alias("ld_hash"),
        F.transform("ld_lines", lambda line: F.xxhash64(line)).alias("ld_full"),
    )
    last = F.size("ld_full") - window
    at = lambda column, i: [F.get(F.col(column), i + k) for k in range(window)]
    runs = F.when(
        last >= 0,
        F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: F.when(
                F.coalesce(*at("ld_hash", i)).isNotNull(),
                F.struct(i.alias("pos"), F.xxhash64(*at("ld_full", i)).alias("h"), F.hash(*at("ld_full", i)).alias("g")),
            ),
        ),
    )
    return (
        hashed.select("ld_id", "ld_text", F.explode_outer(runs).alias("w"))
        .where(F.col("w").isNotNull())
        .select("ld_id", "ld_text", F.col("w.pos").alias("ld_pos"), F.col("w.h").alias("ld_h"), F.col("w.g").alias("ld_g"))
    )


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Removes the lines that later occurrences of repeated line windows cover.

    A window is `window` consecutive \\n-split lines, equal if all its lines are. Of all occurrences of a window in
    the table the one with the least (id, position) is the first; every line that any other occurrence covers goes.
    So the text of each line that goes is still there, at an earlier place. Returns the input columns, with the
    remaining lines joined in `text_col`, and `n_lines`, `n_removed` (long).

    Nulls: a null text or id passes unchanged (n_lines null for a null text). Empty text: one blank line. Windows of
    blank lines only, and texts of fewer lines than a window, remove nothing. Repeated rows with the same id and text
    count as one document and stay alike; rows with one id and different texts are different documents. Columns named as the
    new ones, in whatever case, are replaced; all others stay, whatever their names.
    """
    docs = without(docs, ["n_lines", "n_removed"])
    occurrences = line_windows(docs, id_col, text_col, window)
    me = F.struct("ld_id", "ld_text", "ld_pos")
    # Counting combines before the shuffle, so a window that a third of all lines repeat is one row a task.
    repeated = written(
        occurrences.groupBy("ld_h", "ld_g").agg(F.count(F.lit(1)).alias("ld_n"), F.min(me).alias("ld_first")).where("ld_n > 1").drop("ld_n"),
        "line-windows",
    )
    # A join of two plain scans: adaptive execution splits the partition that a very frequent window fills.
    later = occurrences.join(repeated, ["ld_h", "ld_g"]).where(me != F.col("ld_first")).select("ld_id", "ld_text", "ld_pos")
    in_order = Window.partitionBy("ld_id", "ld_text").orderBy("ld_pos")
    gap = F.col("ld_pos") - F.lag("ld_pos").over(in_order) > window
    merged = (
        later.withColumn("ld_gap", F.coalesce(gap, F.lit(False)).cast("int"))
        .withColumn("ld_run", F.sum("ld_gap").over(in_order))
        .groupBy("ld_id", "ld_text", "ld_run")
        .agg(F.min("ld_pos").alias("a"), (F.max("ld_pos") + window).alias("b"))
        .groupBy("ld_id", "ld_text")
        .agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("ld_cover"))
    )
    # A row's own columns stay in a struct, where no name of theirs can meet one of these.
    rows = docs.select(F.struct("*").alias("ld_row"), F.col(id_col).alias("ld_key"), F.xxhash64(text_col).alias("ld_key_text"))
    joined = rows.join(merged, (F.col("ld_key") == F.col("ld_id")) & (F.col("ld_key_text") == F.col("ld_text")), "left")
    own = F.col("ld_row").getField
    split = joined.withColumn("ld_lines", F.split(own(text_col), "\n", -1))
    starts = F.concat(F.array(F.lit(0)), F.transform("ld_cover", lambda c: c["b"]))
    ends = F.concat(F.transform("ld_cover", lambda c: c["a"]), F.array(F.size("ld_lines")))
    kept = F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(F.col("ld_lines"), a + 1, b - a)))
    out = split.withColumn("ld_kept", F.when(F.col("ld_cover").isNotNull(), kept))
    removed = F.when(F.col("ld_cover").isNotNull(), F.size("ld_lines") - F.size("ld_kept")).otherwise(F.lit(0))
    text = F.when(F.col("ld_cover").isNotNull(), F.array_join("ld_kept", "\n")).otherwise(own(text_col))
    return out.select(
        *[(text if c == text_col else own(c)).alias(c) for c in docs.columns],
        F.when(own(text_col).isNotNull(), F.size("ld_lines")).cast("long").alias("n_lines"),
        removed.cast("long").alias("n_removed"),
    )


#: DuckDB, over `documents`.
SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
e AS (SELECT doc_id, l, unnest(range(len(l) - 2)) AS pos FROM d WHERE text IS NOT NULL AND len(l) >= 3),
w AS (SELECT doc_id, pos, l[pos + 1] || chr(10) || l[pos + 2] || chr(10) || l[pos + 3] AS win FROM e
      WHERE trim(l[pos + 1]) <> '' OR trim(l[pos + 2]) <> '' OR trim(l[pos + 3]) <> ''),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS nth FROM w),
c AS (SELECT DISTINCT doc_id, pos + k AS pos FROM r, (SELECT unnest(range(3)) AS k) WHERE nth > 1),
n AS (SELECT doc_id, l, unnest(range(len(l))) AS pos FROM d WHERE text IS NOT NULL),
k AS (SELECT n.doc_id, string_agg(n.l[n.pos + 1], chr(10) ORDER BY n.pos) AS text, count(*) AS m
      FROM n LEFT JOIN c ON n.doc_id = c.doc_id AND n.pos = c.pos WHERE c.doc_id IS NULL GROUP BY n.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text,
       CAST(len(d.l) AS BIGINT) AS n_lines, CAST(coalesce(len(d.l) - coalesce(k.m, 0), 0) AS BIGINT) AS n_removed
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
