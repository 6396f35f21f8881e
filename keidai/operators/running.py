"""Seasonal medians that are kept up to date: counts of values as state, merged with what a new month adds or takes away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keidai.operators.priority import BASE_MONTHS, ratios
from keidai.sources.versions import current_parts, publish_parts

BUCKETS = 64
STATE = "bucket int, title string, season string, value double, n bigint"


def bucket_of(title: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(title), F.lit(buckets)).cast("int")


def delta(months: DataFrame, sign: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """Counts of values (bucket, title, season, value, n) that monthly rows (title, year, month, views) add; with sign -1, take away.

    Months of no season and null views count nothing. A correction is the old rows with -1 and the new ones with 1.
    """
    season = F.when(F.col("month").isin(*BASE_MONTHS), "base").when(F.col("month") == 1, "january")
    rows = months.select(F.col("title").cast("string").alias("title"), season.alias("season"), F.col("views").cast("double").alias("value")).where("season IS NOT NULL AND value IS NOT NULL AND title IS NOT NULL")
    return rows.groupBy("title", "season", "value").agg((sign * F.count(F.lit(1))).alias("n")).select(bucket_of(F.col("title"), buckets).alias("bucket"), "title", "season", "value", "n")


def merged(*states: DataFrame) -> DataFrame:
    """States and deltas as one: counts add up, in whatever order; a value that is all taken away is gone."""
    rows = states[0]
    for s in states[1:]:
        rows = rows.unionByName(s)
    return rows.groupBy("bucket", "title", "season", "value").agg(F.sum("n").alias("n")).where("n <> 0")


def medians(state: DataFrame) -> DataFrame:
    """title, pv_base_median, pv_january: of each season the median of the values that are counted, the same as over the rows themselves."""
    of = lambda season: F.percentile(F.when(F.col("season") == season, F.col("value")), 0.5, F.col("n"))
    return state.groupBy("title").agg(of("base").alias("pv_base_median"), of("january").alias("pv_january"))


def running_ratio(state: DataFrame) -> DataFrame:
    """title, pv_base_median, pv_january, new_year_ratio, clipped of the months in a state."""
    return ratios(medians(state), "title")


def update(spark: SparkSession, root: str, change: DataFrame) -> set[int]:
    """Merges a delta into the state at `root` and returns the buckets that changed.

    Only buckets with titles of the delta are read and written. The state has a row for each title, season and distinct
    value: at most one for each month kept, whatever the number of updates. All buckets become current at once; where
    counts would fall below zero (a month taken away that wasn't there) nothing is published.
    """
    touched = {r["bucket"] for r in change.select("bucket").distinct().collect()}  # of a fixed number of buckets
    if not touched:
        return touched
    old = current_parts(spark, root, "bucket", STATE, {str(b) for b in touched})
    new = merged(old, change)
    checked = new.select("bucket", "title", "season", "value", F.when(F.col("n") > 0, F.col("n")).otherwise(F.raise_error(F.concat(F.lit("more views taken away than were there: "), "title")).cast("bigint")).alias("n"))
    gone = tuple(map(str, touched))  # a bucket that has nothing left has no part
    publish_parts(spark, root, "bucket", checked, "bucket", gone)
    return touched


def state_of(spark: SparkSession, root: str) -> DataFrame:
    return current_parts(spark, root, "bucket", STATE)
