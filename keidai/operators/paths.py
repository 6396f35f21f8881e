"""Climb along ordered points, and headings carried forward over ordered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keidai.functions.text import round_half_up
from keidai.sources.shared import kept

#: Lines of a segment, where segments are cut by line number.
SEGMENT_LINES = 1 << 16


def segment_of(order: Column, size: int = SEGMENT_LINES) -> Column:
    """Segments of a whole-numbered order: so many numbers each."""
    return F.floor(order / size).cast("long")


def _in_segments(rows: DataFrame, partition: list[str], segment: Column | None) -> tuple[DataFrame, list[str]]:
    return (rows, partition) if segment is None else (rows.withColumn("_segment", segment), [*partition, "_segment"])


def cumulative_elevation(points: DataFrame, path: str, *order: str, segment: Column | None = None) -> DataFrame:
    """path, ascent_m, descent_m, coverage of points with an `elevation`; an unknown one breaks the chain and is not bridged.

    With a `segment`, a number that doesn't fall along a path's order, each segment is summed on its own and gives its first
    and last height; the steps between segments are taken from these, so no task needs a path as a whole.
    """
    rows, by = _in_segments(points, [path], segment)
    before = F.lag("elevation").over(Window.partitionBy(*by).orderBy(*order))
    steps = rows.select(*by, *order, "elevation", (F.col("elevation") - before).alias("d"))
    sums = [F.coalesce(F.sum(F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))), F.lit(0.0)).alias(n) for n, c in (("up", F.col("d")), ("down", -F.col("d")))]
    ends = []
    if segment is not None:
        at = F.struct(*order)
        ends = [F.min_by(F.struct("elevation"), at).alias("first"), F.max_by(F.struct("elevation"), at).alias("last")]  # structs, as a null height is an end too
    parts = steps.groupBy(*by).agg(*sums, F.count("elevation").alias("known"), F.count(F.lit(1)).alias("n"), *ends)
    if segment is not None:
        step = F.col("first.elevation") - F.lag("last").over(Window.partitionBy(path).orderBy("_segment"))["elevation"]
        parts = parts.withColumn("step", F.coalesce(step, F.lit(0.0)))
        parts = parts.withColumns({"up": F.col("up") + F.greatest(F.col("step"), F.lit(0.0)), "down": F.col("down") + F.greatest(-F.col("step"), F.lit(0.0))})
        parts = parts.groupBy(path).agg(F.sum("up").alias("up"), F.sum("down").alias("down"), F.sum("known").alias("known"), F.sum("n").alias("n"))
    return parts.select(path, round_half_up(F.col("up"), 1).alias("ascent_m"), round_half_up(F.col("down"), 1).alias("descent_m"), (F.col("known") / F.col("n")).alias("coverage"))


def carry_forward(rows: DataFrame, partition: list[str], order: list[str], outer: Column, inner: Column, segment: Column | None = None) -> DataFrame:
    """Adds `outer` and `inner`: the latest headings at each row, '' before the first. A new outer heading takes the inner one away.

    `outer` and `inner` are the headings a row sets, null where it sets none. With a `segment`, a number that doesn't fall
    along the order, headings are carried within segments; what a segment begins with is the last heading of those before it,
    found over one row a segment. So one partition may hold all rows, and no task does.
    """
    rows, by = _in_segments(rows, partition, segment)
    if segment is not None:  # rows are read twice, and what makes their headings may be costly
        rows = kept(rows.withColumns({"_outer": outer, "_inner": inner}), "headed")
        outer, inner = F.col("_outer"), F.col("_inner")
    sub = F.when(outer.isNotNull(), F.lit("")).otherwise(inner)
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({"outer": F.last(outer, True).over(w), "inner": F.last(sub, True).over(w)})
    if segment is None:
        return local.withColumns({"outer": F.coalesce("outer", F.lit("")), "inner": F.coalesce("inner", F.lit(""))})
    at = F.struct(*order)
    latest = lambda c: F.max_by(c, F.when(c.isNotNull(), at))
    ends = rows.withColumn("_inner", sub).groupBy(*by).agg(latest(F.col("_outer")).alias("_outer"), latest(F.col("_inner")).alias("_inner"))
    before = Window.partitionBy(*partition).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    begins = ends.select(*by, F.last("_outer", True).over(before).alias("_outer"), F.last("_inner", True).over(before).alias("_inner"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    joined = local.alias("a").join(begins.alias("b"), on=same, how="left")
    others = [c for c in local.columns if c not in ("outer", "inner", "_outer", "_inner", "_segment")]
    return joined.select(*[F.col(f"a.{c}") for c in others], F.coalesce("a.outer", "b._outer", F.lit("")).alias("outer"), F.coalesce("a.inner", "b._inner", F.lit("")).alias("inner"))
