"""Text files as numbered lines, whatever their size: files are split, and numbers come from the lines of the splits before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keidai.functions.joins import small_side
from keidai.sources.shared import kept


def numbered_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """volume (the file), line_no (from 0), line of text files; a line ends with \\n or \\r\\n.

    Each split is numbered where it is read, by Spark's ids, which grow in reading order within a task; a split's first line
    has the number of the lines in the splits before it, a prefix sum over the splits, which are few. So a file of any size
    is read by as many tasks as it has splits, and no line is shuffled. The lines are written once, so that both passes see
    the same splits. A line end at the end of a file begins no further line.
    """
    text = spark.read.option("lineSep", "\n").text(paths)
    lines = kept(
        text.select(
            F.col("_metadata.file_path").alias("volume"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("line")
        ),
        "lines",
    )
    splits = lines.groupBy("volume", "split").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("volume").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = kept(splits.select("volume", "split", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "splits")
    return lines.join(small_side(splits), ["volume", "split"]).select("volume", (F.col("base") + F.col("at") - F.col("first")).alias("line_no"), "line")
