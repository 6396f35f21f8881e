"""What a collection lacks, over grids that are filled with zeros, and the report of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keidai.operators.access import without_car
from keidai.sources.shared import kept

# Regions with their first and last prefecture; kinds with their headings, in order.
REGIONS = (("北海道", 1, 1), ("東北", 2, 7), ("関東", 8, 14), ("中部", 15, 23), ("近畿", 24, 30), ("中国", 31, 35), ("四国", 36, 39), ("九州・沖縄", 40, 47))
KINDS = {"geography": "地理の穴", "benefit": "御利益の穴", "access": "アクセスの穴", "goshuin": "御朱印の穴", "pilgrimage": "巡礼の穴", "etiquette": "作法の穴"}
MAJORS = ("enmusubi", "shoubai", "gakugyou", "kenkou", "yakuyoke", "anzan", "koutsuu", "shoubu", "kanai", "nariwai")


@dataclass(frozen=True)
class Least:
    """How many of each there should be, at least."""

    prefecture: int = 3
    region_benefit: int = 1
    car_free: int = 3
    goshuin: int = 3


def regions(spark) -> DataFrame:
    """region_ord, region, prefecture_code: all 47."""
    rows = [(i, name, f"{p:02d}") for i, (name, a, b) in enumerate(REGIONS) for p in range(a, b + 1)]
    return spark.createDataFrame(rows, "region_ord int, region string, prefecture_code string")


def low_counts(grid: DataFrame, rows: DataFrame, keys: list[str], least: int, counted: Column) -> DataFrame:
    """The grid's cells with fewer than `least` rows, with their count; a cell without rows has 0."""
    counts = rows.groupBy(*keys).agg(counted.alias("n"))
    return grid.join(counts, keys, "left").withColumn("count", F.coalesce("n", F.lit(0)).cast("long")).drop("n").where(F.col("count") < least)


def coverage(groups: DataFrame, memberships: DataFrame) -> DataFrame:
    """group_id, name, total_count, registered: sites that belong to each group that states a total."""
    n = memberships.groupBy("group_id").agg(F.count_distinct("site_id").alias("n"))
    return groups.where(F.coalesce("total_count", F.lit(0)) > 0).join(n, "group_id", "left").select("group_id", "name", "total_count", F.coalesce("n", F.lit(0)).cast("long").alias("registered"))


def incomplete(covered: DataFrame) -> DataFrame:
    return covered.where(F.col("registered") < F.col("total_count"))


#: Which of (prefecture, region, major) a cell isn't about, as grouping_id() has it.
BY_PREFECTURE, BY_MAJOR, BY_REGION = 0b011, 0b100, 0b101


def cells(spark, majors: tuple[str, ...], least: Least) -> DataFrame:
    """Every cell that should have sites: kind, level, prefecture_code, region, major_id, least, and o0 to o4, its place in the report. 143 rows with ten majors."""
    rows = [("geography", BY_PREFECTURE, f"{p:02d}", None, None, least.prefecture, 0, i, p, 0, 0) for i, (_, a, b) in enumerate(REGIONS) for p in range(a, b + 1)]
    for i, (name, _, _) in enumerate(REGIONS):
        rows += [("benefit", BY_MAJOR, None, name, m, least.region_benefit, 1, i, 0, j, 0) for j, m in enumerate(majors)]
        rows += [("access", BY_REGION, None, name, None, least.car_free, 1, i, 1, 0, 0), ("goshuin", BY_REGION, None, name, None, least.goshuin, 1, i, 2, 0, 0)]
    return spark.createDataFrame(rows, "kind string, level int, prefecture_code string, region string, major_id string, least int, o0 int, o1 int, o2 int, o3 int, o4 int")


def small_cells(sites: DataFrame, majors: tuple[str, ...] = MAJORS, least: Least = Least()) -> DataFrame:
    """The cells of cells() with fewer sites than they should have, and their count: by prefecture, by region and primary major, and by region.

    All counts are one pass over the sites: each is expanded to its primary majors, its first row alone counts for the other
    levels, and grouping sets add up the three levels in one shuffle of partial counts. A cell without sites has 0; sites
    of no known prefecture are in none.
    """
    spark, c = sites.sparkSession, F.col
    primary = F.transform(F.filter("benefits", lambda b: (b["weight"] == "primary") & b["major_id"].isin(*majors)), lambda b: b["major_id"])
    wide = sites.join(F.broadcast(regions(spark)), "prefecture_code").select(  # 47 rows
        "prefecture_code", "region", F.coalesce(without_car(c("access_mode")), F.lit(False)).alias("free"), F.coalesce(c("goshuin_available") == "yes", F.lit(False)).alias("stamp"), F.posexplode_outer(F.array_distinct(primary)).alias("at", "major_id")
    )
    first = F.coalesce(c("at"), F.lit(0)) == 0
    counts = wide.groupingSets([["prefecture_code"], ["region", "major_id"], ["region"]], "prefecture_code", "region", "major_id").agg(
        F.grouping_id().cast("int").alias("g_level"), F.count_if(first).alias("n"), F.count("major_id").alias("n_major"), F.count_if(first & c("free")).alias("n_free"), F.count_if(first & c("stamp")).alias("n_stamp")
    )
    counts = counts.withColumnsRenamed({"prefecture_code": "g_prefecture", "region": "g_region", "major_id": "g_major"})
    same = (c("level") == c("g_level")) & c("prefecture_code").eqNullSafe(c("g_prefecture")) & c("region").eqNullSafe(c("g_region")) & c("major_id").eqNullSafe(c("g_major"))
    n = F.when(c("kind") == "benefit", c("n_major")).when(c("kind") == "access", c("n_free")).when(c("kind") == "goshuin", c("n_stamp")).otherwise(c("n"))
    # Of known prefectures, regions and majors alone, there are as few counts as cells.
    joined = cells(spark, majors, least).join(F.broadcast(counts), same, "left").withColumn("count", F.coalesce(n, F.lit(0)).cast("long"))
    return joined.where(c("count") < c("least")).drop("g_level", "g_prefecture", "g_region", "g_major", "n", "n_major", "n_free", "n_stamp")


def detect(sites: DataFrame, majors: tuple[str, ...] = MAJORS, covered: DataFrame | None = None, least: Least = Least()) -> DataFrame:
    """All gaps: ord (struct), kind, description, count, expected, region, major_id, group_id.

    sites (id, pos, name, prefecture_code, benefits array<struct<major_id, weight>>, access_mode, goshuin_available, etiquette_source_type).
    """
    spark = sites.sparkSession
    c, say = F.col, F.format_string

    def gap(df: DataFrame, kind: Column, text: Column, expected: Column, ord_: Column, region=None, major=None, group=None) -> DataFrame:
        text_or_null = lambda x: (F.lit(None) if x is None else x).cast("string")
        return df.select(
            ord_.alias("ord"), kind.alias("kind"), text.alias("description"), c("count"), expected.cast("long").alias("expected"),
            text_or_null(region).alias("region"), text_or_null(major).alias("major_id"), text_or_null(group).alias("group_id"),
        )

    place = lambda *at: F.struct(*[(F.lit(x) if isinstance(x, int) else x).cast("int").alias(f"o{i}") for i, x in enumerate(at)])
    low = small_cells(sites, majors, least)
    text = (
        F.when(c("kind") == "geography", say("都道府県コード %s の収録が %d 件しかありません。", "prefecture_code", "count"))
        .when(c("kind") == "benefit", say("%sに「%s」の社寺が %d 件しかありません。", "region", "major_id", "count"))
        .when(c("kind") == "access", say("%sに「車なしで行ける」社寺が %d 件しかありません。", "region", "count"))
        .otherwise(say("%sに御朱印を授与している社寺が %d 件しかありません。", "region", "count"))
    )
    found = gap(low, c("kind"), text, c("least"), place(*[c(f"o{i}") for i in range(5)]), F.coalesce("region", "prefecture_code"), c("major_id"))
    if covered is not None:
        part = incomplete(covered).withColumn("count", c("registered"))
        text = say("%s が %d/%d 件しか収録されていません。めぐりコース機能が成立しません。", "name", "registered", "total_count")
        found = found.unionByName(gap(part, F.lit("pilgrimage"), text, c("total_count"), place(2, F.dense_rank().over(_by("group_id")), 0, 0, 0), group=c("group_id")))
    # Ten names at most are shown: those are found first, so no list grows with the table.
    waiting = sites.where(c("etiquette_source_type") == "pending")
    ten = waiting.orderBy("pos").limit(10).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]), "、").alias("names"))
    both = waiting.agg(F.count(F.lit(1)).alias("n")).crossJoin(ten).where("n > 0").withColumn("count", F.lit(0).cast("long"))
    return found.unionByName(gap(both, F.lit("etiquette"), say("参拝作法が未確認（PENDING_VERIFICATION）の社寺が %d 件あります: %s", "n", "names"), c("n"), place(3, 0, 0, 0, 0)))


def _by(column: str):
    from pyspark.sql import Window

    return Window.orderBy(column)  # over the pilgrimage groups alone, which are few


def by_kind(gaps: DataFrame) -> DataFrame:
    return gaps.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def report(gaps: DataFrame, date: str, title: str = "穴の検出結果") -> DataFrame:
    """nth, line: the report, with a section for each kind that has gaps, in the fixed order of kinds. Gaps are cells of a grid, groups and one row more, so they are few."""
    from pyspark.sql import Window

    gaps = kept(gaps, "gaps")  # the report takes them apart five times
    spark, c = gaps.sparkSession, F.col
    kinds = F.broadcast(spark.createDataFrame([(i, k, label) for i, (k, label) in enumerate(KINDS.items(), 1)], "section int, kind string, label string"))  # six rows
    blank = gaps.schema["ord"].dataType
    at = lambda section, step, line, ord_=None: (section.cast("int").alias("section"), F.lit(step).alias("step"), (F.lit(None).cast(blank) if ord_ is None else ord_).alias("ord"), line.alias("line"))
    total = gaps.agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(0)
    texts = [F.lit(f"# {title} {date}"), F.lit(""), F.format_string("検出した穴: **%d 件**", "n"), F.lit(""), F.lit("この一覧が、そのまま次の収録キューになります。"), F.lit("")]
    lines = total.select(F.posexplode(F.array(*texts)).alias("step", "line")).select(none.alias("section"), "step", F.lit(None).cast(blank).alias("ord"), "line")
    counts = by_kind(gaps).join(kinds, "kind")
    parts = [
        counts.select(*at(c("section"), 0, F.format_string("## %s（%d件）", "label", "n"))),
        counts.select(*at(c("section"), 1, F.lit(""))),
        gaps.join(kinds, "kind").select(*at(c("section"), 2, F.concat(F.lit("- "), "description"), c("ord"))),
        counts.select(*at(c("section"), 3, F.lit(""))),
        total.where("n = 0").select(*at(F.lit(99), 0, F.lit("穴は検出されませんでした。"))),
    ]
    for part in parts:
        lines = lines.unionAll(part)
    return lines.select((F.row_number().over(Window.orderBy("section", "step", "ord", "line")) - 1).alias("nth"), "line")


def markdown(gaps: DataFrame, date: str, title: str = "穴の検出結果") -> str:
    """The report as one text: some hundred lines."""
    return "\n".join(r["line"] for r in report(gaps, date, title).orderBy("nth").collect())
