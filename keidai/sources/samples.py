"""A few sites with all their parts, for pages and tests without data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SITE = (
    "id string, name string, type string, denomination string, prefecture_code string, lat double, lng double, address string, rank array<string>, deities array<struct<display:string,link_target:string,role:string,source:string,cluster_id:string,matched_by:string>>, "
    "benefits array<struct<benefit_id:string,major_id:string,weight:string,confidence:string,derived_deity:string,derived_cluster:string>>, etiquette_source_type string, "
    "goshuin struct<available:string,hours:struct<`from`:string,to:string>,lunch_break:struct<`from`:string,to:string>,write_style:string,fee:int,unmanned:boolean,denomination_note:string,source_url:string,verified_at:string>, "
    "access struct<access_mode:string,walk_load:string,station:struct<name:string,line_name:string,distance_m:int,walk_min:int>,bus:struct<name:string,operator:string,distance_m:int,walk_min:int,trips_weekday:int,trips_sat:int,trips_sun:int,unknown_reason:string>,"
    "walk_distance_m:int,walk_minutes:int,ascent_m:int,descent_m:int,relief_around_m:int,reason:string,computed_at:string>, "
    "shikinai struct<province:string,district:string,shrine_name:string,rank:string,offering:string,tsukinami:boolean,niiname:boolean,ainame:boolean,seats:int,raw_note:string,has_defect:boolean>, "
    "citations array<struct<classical_source_id:string,layer:int,benefit_id:string,connection_type:string,editor_note:string,ocr_warning:boolean>>, groups array<struct<group_id:string,order_no:int>>, "
    "data_quality struct<benefit:boolean,etiquette:boolean,goshuin:boolean,access:boolean,citation:boolean>"
)
NO_TIMETABLE = "バス停「大社前」はありますが、この地域のバス運行データが公開されていないため便数を確認できません。現地の時刻表をご確認ください。"
# The three sample sites, in the order of the schema's columns.
SITES = (
    (
        "sample-otokuni", "乙訓坐大雷神社（サンプル）", "shrine", None, "26", 34.9298, 135.6917, "京都府（サンプル）", ["式内社（名神大）"],
        [("大雷神", None, "unknown", "jawp", None, None), ("稲荷神", "稲荷神", "unknown", "jawp", "inari", "linkTarget")],
        [
            ("shoubai_hanjou", "shoubai", "primary", "derived", "稲荷神", "inari"),
            ("gokoku_houjou", "nariwai", "primary", "derived", "稲荷神", "inari"),
            ("kinun", "shoubai", "secondary", "derived", "稲荷神", "inari"),
        ],
        "default",
        ("yes", ("09:00", "16:00"), ("12:00", "13:00"), "both", 300, False, None, "https://example.jinja.jp/goshuin", "2026-08-01"),
        ("TRAIN_ONLY", "EASY", ("長岡京駅", "JR東海道本線", 960, 12), None, 960, 12, 18, 4, 12, "長岡京駅から徒歩12分。", "2026-09-01T00:00:00Z"),
        ("山城國", "乙訓郡", "乙訓坐大雷神社", "myojin_tai", None, True, True, False, 1, "名神大。月／次新甞。", False),
        [("engishiki-yamashiro-otokuni-ikazuchi", 1, "gokoku_houjou", "shikinai_rank", "名神大社であり、月次祭・新嘗祭に預かる。国家的な祈年穀の対象だったことが、割注の記載だけから言えます。", False)],
        [], (True, False, True, True, True),
    ),
    (
        "sample-kenkun", "某建勲系神社（サンプル）", "shrine", None, "32", 35.4053, 132.6857, "島根県（サンプル）", [],
        [("織田信長", "織田信長", "unknown", "jawp", "jinbutsu_shin", "linkTarget")],
        [],  # a person's shrine: nothing is derived
        "default",
        ("unknown", None, None, "unknown", None, True, None, None, None),
        ("UNKNOWN", "MODERATE", None, ("大社前", "一畑バス", 640, 8, None, None, None, NO_TIMETABLE), 640, 8, 42, 6, 35, NO_TIMETABLE, "2026-09-01T00:00:00Z"),
        None, [], [], (False, False, False, True, False),
    ),
    (
        "sample-yamadera", "某山中の寺（サンプル）", "temple", "浄土真宗本願寺派", "38", 33.8416, 132.7657, "愛媛県（サンプル）", [],
        [("阿弥陀如来", "阿弥陀如来", "unknown", "jawp", "amida", "linkTarget")],
        [],
        "default",
        ("no", None, None, "unknown", None, None, "浄土真宗では原則として御朱印を授与していません。一部の寺院で「法語印」を授与している場合があります。", None, None),
        ("CAR_ONLY", "HARD", None, ("谷口", "伊予鉄バス", 3400, 42, 2, 0, 0, None), 3400, 42, 210, 12, 180, "最寄りの交通機関から徒歩42分。公共交通では現実的ではありません。", "2026-09-01T00:00:00Z"),
        None, [], [("shikoku88", 51)], (False, False, True, True, False),
    ),
)


def sample_sites(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SITES), SITE)


def find_site(sites: DataFrame, site_id: str) -> DataFrame:
    """The site of an id: one row or none."""
    return sites.where(F.col("id") == site_id)
