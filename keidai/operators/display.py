"""What the pages of a site show, as projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keidai.functions.text import encode_component, js_number, present

# Labels and notes.
LAYERS = {1: "一次史料", 2: "読み下し・現代語", 3: "近代の記録"}
RIGHTS = {"PD": "（原文はパブリックドメイン）", "CC-BY-SA-4.0": "（CC BY-SA 4.0）", "PD+CC-BY-SA-4.0": "（原文はPD／注は CC BY-SA 4.0）"}
OCR_NOTE = "※OCRテキストのため誤りを含む場合があります"
WRITE_STYLES = {"direct": "直書き", "paper": "書き置きのみ", "both": "直書き・書き置きの両方", "seasonal": "時期による（繁忙期は書き置き）", "unknown": "不明"}
GOSHUIN_TITLES = {"yes": "御朱印の授与があります", "no": "御朱印の授与はありません", "unknown": "御朱印の有無は確認できていません"}
GOSHUIN_NONE = "御朱印の情報はまだ調べていません。"
GOSHUIN_UNMANNED_NOTE = "無人の社寺では授与所が無く、いただけない場合があります。"
GOSHUIN_HOURS_NOTE = "※参拝時間と御朱印の受付時間は別です。御朱印のほうが早く終わることがあります。"
QUALITY_FLAGS = ("dq_benefit", "dq_etiquette", "dq_goshuin", "dq_access", "dq_citation")


def months_since(date: Column, now: Column) -> Column:
    """Whole calendar months from a date, 0 for later dates; null if it is none."""
    d = F.try_to_date(date.cast("string"))
    n = now.cast("date")
    return F.greatest(F.lit(0), (F.year(n) - F.year(d)) * 12 + F.month(n) - F.month(d))


def is_stale(date: Column, now: Column, months: int = 6) -> Column:
    return F.coalesce(months_since(date, now) >= months, F.lit(False))


def place(lat: Column, lng: Column) -> Column:
    return F.concat(js_number(lat), F.lit(","), js_number(lng))


def map_url(lat: Column, lng: Column) -> Column:
    return F.concat(F.lit("https://www.google.com/maps/search/?api=1&query="), place(lat, lng))


def directions_url(lat: Column, lng: Column, mode: str = "transit") -> Column:
    return F.concat(F.lit("https://www.google.com/maps/dir/?api=1&destination="), place(lat, lng), F.lit(f"&travelmode={mode}"))


def course_url(points: Column, mode: str = "transit", mobile: bool = False) -> Column:
    """A route through points (array of struct lat, lng); null under two points, over the waypoints a browser takes, or beyond 2,048 characters."""
    n = F.size(points)
    at = lambda p: place(p["lat"], p["lng"])
    inner = F.slice(points, 2, F.greatest(n - 2, F.lit(0)))
    way = F.when(n > 2, F.concat(F.lit("&waypoints="), encode_component(F.array_join(F.transform(inner, at), "|")))).otherwise(F.lit(""))
    url = F.concat(
        F.lit("https://www.google.com/maps/dir/?api=1&origin="), encode_component(at(F.get(points, F.lit(0)))), F.lit("&destination="), encode_component(at(F.get(points, n - 1))), F.lit(f"&travelmode={mode}"), way
    )
    return F.when((n >= 2) & (n - 2 <= (3 if mobile else 9)) & (F.length(url) <= 2048), url)


def citations(links: DataFrame, sources: DataFrame) -> DataFrame:
    """Citations (site_id, pos, source_id, layer) with their sources, by layer; those of unknown sources are left out."""
    return links.join(sources, "source_id").orderBy("site_id", "layer", "pos")


def named(value: Column, names: dict) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), value)


def layer_badge(layer: Column) -> Column:
    """Label of a citation's layer."""
    return named(layer, LAYERS)


def rights_note(rights: Column, ocr: Column) -> Column:
    """What is said of a source's rights, and a warning on text read by machine; empty where nothing is."""
    return F.concat(F.coalesce(named(rights, RIGHTS), F.lit("")), F.when(F.coalesce(ocr, F.lit(False)), F.lit(OCR_NOTE)).otherwise(F.lit("")))


def lore(rows: DataFrame) -> DataFrame:
    """Lore that has a source."""
    return rows.where(F.coalesce("source_url", F.lit("")) != "")


def group_names(memberships: DataFrame, groups: DataFrame) -> DataFrame:
    """site_id, group_id, shown: the group's name, the site's number in it, and whether it is disputed. Unknown groups are left out."""
    shown = F.concat(F.col("name"), F.when(F.col("order_no").isNotNull(), F.concat(F.lit(" 第"), F.col("order_no").cast("string"), F.lit("番"))).otherwise(F.lit("")), F.when(F.coalesce("disputed", F.lit(False)), F.lit("（諸説あり）")).otherwise(F.lit("")))
    return memberships.join(groups, "group_id").select("site_id", "group_id", shown.alias("shown"))


def quality_flags(sites: DataFrame) -> DataFrame:
    """site_id, flag, ok: one row for each data-quality flag of a site."""
    pairs = ", ".join(f"'{f}', {f}" for f in QUALITY_FLAGS)
    return sites.selectExpr("site_id", f"stack({len(QUALITY_FLAGS)}, {pairs}) AS (flag, ok)")


def goshuin_panel(sites: DataFrame) -> DataFrame:
    """site_id, title, rows (array<struct<name, value>>), notes (array<string>): what is shown of a site's stamp.

    sites (site_id, goshuin struct<available, hours struct<from, to>, lunch_break struct<from, to>, write_style, fee, unmanned,
    mail_order, limited_note, denomination_note>). No struct: nothing is known. Rows are there only where a stamp is given.
    """
    g = F.col("goshuin")
    given, refused = g["available"] == "yes", g["available"] == "no"
    row = lambda name, value: F.when(value.isNotNull(), F.struct(F.lit(name).alias("name"), value.alias("value")))
    span = lambda s: F.when(s.isNotNull(), F.concat(s["from"], F.lit("〜"), s["to"]))
    rows = F.array_compact(
        F.array(
            row("受付時間", span(g["hours"])),
            row("昼休み", span(g["lunch_break"])),
            row("書き方", F.coalesce(named(g["write_style"], WRITE_STYLES), F.lit(WRITE_STYLES["unknown"]))),
            row("初穂料", F.concat(js_number(g["fee"]), F.lit("円"))),
            row("授与所", F.when(g["unmanned"], F.lit("無人（不在の場合があります）"))),
            row("郵送", F.when(g["mail_order"] == "yes", F.lit("対応あり"))),
        )
    )
    denomination = present(g["denomination_note"])
    notes = (
        F.when(g.isNull(), F.array().cast("array<string>"))
        .when(given, F.array_compact(F.array(F.when(g["hours"].isNotNull(), F.lit(GOSHUIN_HOURS_NOTE)), present(g["limited_note"]), denomination)))
        .when(refused, F.array_compact(F.array(denomination)))
        .otherwise(F.array_compact(F.array(denomination, F.lit(GOSHUIN_UNMANNED_NOTE))))
    )
    title = F.when(g.isNull(), F.lit(GOSHUIN_NONE)).otherwise(F.coalesce(named(g["available"], GOSHUIN_TITLES), F.lit(GOSHUIN_TITLES["unknown"])))
    return sites.select("site_id", title.alias("title"), F.when(given, rows).otherwise(F.slice(rows, 1, 0)).alias("rows"), notes.alias("notes"))


def verified_note(date: Column, now: Column, stale_after: int = 6) -> Column:
    """From when what is shown is, with a warning if that is long ago; null without a date."""
    months = months_since(date, now)
    old = F.when(months >= stale_after, F.format_string("（%dヶ月前。変更されている可能性があります）", months)).otherwise(F.lit(""))
    return F.when(present(date).isNotNull(), F.concat(date, F.lit(" 時点の情報"), F.coalesce(old, F.lit(""))))
