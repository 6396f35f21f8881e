"""Broadcasts that are checked first, and rows dealt by their number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a broadcast side may have: masters, curated by hand, have some hundreds.
MASTER_ROWS = 100_000


def small_side(df: DataFrame, rows: int = MASTER_ROWS) -> DataFrame:
    """Marks a side for broadcast if a count finds it within the bound, else leaves the join to be shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Rows that a task sorts at once, about.
TASK_ROWS = 500_000


def parts_of(df: DataFrame, times: float = 1.0, rows: int = TASK_ROWS) -> int:
    """How many parts have so many rows each, if every row becomes `times` of them; no fewer than there are cores, if there is a row for each."""
    n = df.count()
    return max(int(n * times // rows) + 1, min(n, df.sparkSession.sparkContext.defaultParallelism))


def dealt(df: DataFrame, parts: int, *by: str) -> DataFrame:
    """Rows dealt by columns into a number of parts that adaptive execution leaves: it goes by bytes, and knows nothing of what rows become."""
    return df.repartition(parts, *by)


def spread(df: DataFrame) -> DataFrame:
    """Rows spread evenly over four tasks a core, for work that takes much longer a byte than reading: a file of some MB is read as one split, by one core."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)
