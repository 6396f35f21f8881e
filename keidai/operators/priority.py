"""Inclusion priority: seasonal ratio of monthly views, ranges over the population, weighted score. Internal figures:
none of these columns belongs in a public table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keidai.functions.text import round_half_up

# Fixed values.
BASE_MONTHS = (3, 4, 6, 7)
RATIO_CLIP = 3.0
WEIGHTS = {"pv_base_median": 0.35, "new_year_ratio": 0.30, "official_visitors": 0.25, "sitelinks": 0.05, "has_goshuin": 0.05}
NO_ARTICLE_WEIGHTS = {"official_listed": 0.4, "has_rank": 0.2, "osm_has_name": 0.1, "nearby_population": 0.3}


def exclude_current_month(views: DataFrame, year: int, month: int) -> DataFrame:
    """Rows of months that are over: the current month (UTC) is not final."""
    return views.where(~((F.col("year") == year) & (F.col("month") == month)))


def newyear_ratio(views: DataFrame, key: str, year: int, month: int) -> DataFrame:
    """key, pv_base_median, pv_january, new_year_ratio, clipped from rows (key, year, month, views).

    Base: median over the base months; January: median over all years. The ratio is null without either, and clipped at 3.
    """
    month_in = lambda months: F.when(F.col("month").isin(*months), F.col("views"))
    medians = exclude_current_month(views, year, month).groupBy(key).agg(F.median(month_in(BASE_MONTHS)).alias("pv_base_median"), F.median(month_in((1,))).alias("pv_january"))
    return ratios(medians, key)


def ratios(medians: DataFrame, key: str) -> DataFrame:
    """Adds new_year_ratio and clipped to rows key, pv_base_median, pv_january."""
    raw = F.col("pv_january") / F.nullif(F.col("pv_base_median"), F.lit(0.0))
    return medians.select(
        key, "pv_base_median", "pv_january", round_half_up(F.when(raw > RATIO_CLIP, RATIO_CLIP).otherwise(raw), 2).alias("new_year_ratio"), F.coalesce(raw > RATIO_CLIP, F.lit(False)).alias("clipped")
    )


def ranges(inputs: DataFrame) -> DataFrame:
    """One row: least and greatest of the logarithms of views and visitors (positive ones), of ratios and of site links; 0 where there are none."""
    log = lambda c: F.when(F.col(c) > 0, F.ln(c))
    of = {"pv": log("pv_base_median"), "visitors": log("official_visitors"), "ratio": F.col("new_year_ratio"), "links": F.col("sitelinks").cast("double")}
    return inputs.agg(*[F.coalesce(f(c), F.lit(0.0)).alias(f"{name}_{what}") for name, c in of.items() for what, f in (("min", F.min), ("max", F.max))])


def normalize(value: Column, low: Column, high: Column) -> Column:
    """0 to 1 between the ends; where they meet, 1 from there on. Null stays null."""
    return F.when(value.isNull(), None).when(high <= low, F.when(value >= high, 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low))))


def score(inputs: DataFrame) -> DataFrame:
    """Adds `score`: the weighted sum of the normalised measures, a missing one counting 0, to four places."""
    ends = F.broadcast(ranges(inputs))  # one row
    part = lambda value, name: F.coalesce(normalize(value, F.col(f"{name}_min"), F.col(f"{name}_max")), F.lit(0.0))
    log = lambda c: F.when(F.col(c) > 0, F.ln(c))
    total = (
        F.lit(WEIGHTS["pv_base_median"]) * part(log("pv_base_median"), "pv")
        + F.lit(WEIGHTS["new_year_ratio"]) * part(F.col("new_year_ratio"), "ratio")
        + F.lit(WEIGHTS["official_visitors"]) * part(log("official_visitors"), "visitors")
        + F.lit(WEIGHTS["sitelinks"]) * part(F.col("sitelinks").cast("double"), "links")
        + F.lit(WEIGHTS["has_goshuin"]) * F.when(F.col("has_goshuin"), 1.0).otherwise(0.0)
    )
    return inputs.crossJoin(ends).select(*inputs.columns, round_half_up(total, 4).alias("score"))


def no_article_score(signals: DataFrame) -> DataFrame:
    """Adds `score` for sites without an article: listed, ranked, named on the map, and people nearby within the population's range."""
    ends = F.broadcast(signals.agg(F.coalesce(F.min("nearby_population"), F.lit(0.0)).alias("low"), F.coalesce(F.max("nearby_population"), F.lit(0.0)).alias("high")))  # one row
    flag = lambda c: F.lit(NO_ARTICLE_WEIGHTS[c]) * F.when(F.col(c), 1.0).otherwise(0.0)
    people = F.lit(NO_ARTICLE_WEIGHTS["nearby_population"]) * F.coalesce(normalize(F.col("nearby_population"), F.col("low"), F.col("high")), F.lit(0.0))
    total = flag("official_listed") + flag("has_rank") + flag("osm_has_name") + people
    return signals.crossJoin(ends).select(*signals.columns, round_half_up(total, 4).alias("score"))


def ranked(scored: DataFrame, key: str) -> DataFrame:
    return scored.orderBy(F.desc("score"), key)


def top_and_bottom(rated: DataFrame, key: str, top: int = 20, bottom: int = 10) -> DataFrame:
    """The greatest and the least ratios: part, key, new_year_ratio."""
    known = rated.where(F.col("new_year_ratio").isNotNull())
    first = known.orderBy(F.desc("new_year_ratio"), key).limit(top).select(F.lit("top").alias("part"), key, "new_year_ratio")
    return first.unionByName(known.orderBy("new_year_ratio", key).limit(bottom).select(F.lit("bottom").alias("part"), key, "new_year_ratio"))


def summary(inputs: DataFrame) -> DataFrame:
    """Counts of sites, of those with a ratio, and of those without an article."""
    return inputs.agg(F.count(F.lit(1)).alias("n_sites"), F.count("new_year_ratio").alias("with_ratio"), F.count_if(~F.col("has_article")).alias("no_article"))
