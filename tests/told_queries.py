"""Operators over inline rows: texts whose results can be told by hand. The SQL of each states the expected rows. They read no table, so they are tests and not registered."""

from __future__ import annotations

from pyspark.sql import functions as F

from keidai.functions import geo, text
from keidai.operators import access, benefits, display, etiquette, gaps, identity, registry, wikitext
from keidai.sources import dumps, masters, samples

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def query(types: str, *expected: tuple):
    """Registers a query with its expected rows. types: name kind, ... in SQL."""

    def add(f):
        columns = [c.split() for c in types.split(", ")]
        casts = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in columns)
        values = ", ".join("(" + ", ".join(map(_literal, row)) + ")" for row in expected)
        QUERIES[f.__name__] = f
        SQL[f.__name__] = f"SELECT {casts} FROM (VALUES {values}) AS v({', '.join(n for n, _ in columns)})"
        return f

    return add


@query(
    "name VARCHAR, key VARCHAR",
    ("天照皇大神", "天照皇"), ("天照大神", "天照"), ("大国主（大己貴）", "大国主"), ("底 筒 男 命", "底筒男"), ("命", "命"), ("素戔嗚尊", "素戔嗚"), ("金山毘古命", "金山彦"), ("金山彦命", "金山彦"),
    ("主祭神：イチキシマヒメ", "いちきしまひめ"), ("市杵島比売命", "市杵島姫"), ("素盞鳴命", "素戔嗚"), ("大国主命", "大国主"), ("天照大御神", "天照"), ("大國主", "大国主"), ("釼神社媛", "剣神社姫"),
)
def deity_normalize(spark, sf_dir):
    names = ["天照皇大神", "天照大神", "大国主（大己貴）", "底 筒 男 命", "命", "素戔嗚尊", "金山毘古命", "金山彦命", "主祭神：イチキシマヒメ", "市杵島比売命", "素盞鳴命", "大国主命", "天照大御神", "大國主", "釼神社媛"]
    return spark.createDataFrame([(n,) for n in names], "name string").select("name", text.deity_key(F.col("name")).alias("key"))


@query(
    "s VARCHAR, n INTEGER, seats INTEGER, defect BOOLEAN",
    ("二千八百六十一", 2861, None, False), ("参佰玖拾玖", 399, None, False), ("廿七座", None, 27, False), ("卅七", 37, None, False), ("十", 10, None, False), ("〓", None, None, True), ("三千一百〓二座", None, None, True),
    ("53", 53, None, False), ("", None, None, False), ("一二", 2, None, False), ("川田神社二座", None, 2, False), ("万", None, None, False), (" 百二十二 ", 122, None, False),
)
def kansuji(spark, sf_dir):
    rows = ["二千八百六十一", "参佰玖拾玖", "廿七座", "卅七", "十", "〓", "三千一百〓二座", "53", "", "一二", "川田神社二座", "万", " 百二十二 "]
    s = F.col("s")
    return spark.createDataFrame([(r,) for r in rows], "s string").select("s", text.kansuji(s).alias("n"), text.seats(s).alias("seats"), text.has_defect(s).alias("defect"))


REGISTRY_LINES = (
    "巻頭の注記", "山城國百二十二座大五十三座小六十九座", "乙訓郡十九座大五座小十四座", "羽束師坐高御産日神社／大。月／次新甞∥", "小倉神社／小∥", "自玉手祭來酒解神社／名神大。月次新嘗∥", "葛野郡廿座",
    "平野祭神四社／並名神大。月次／新嘗。案上官幣∥", "川田神社二座", "大和國二百八十六座", "欠字〓神社／貞コ∥", "",
)


def registry_lines(spark):
    return spark.createDataFrame([("v9", i, line) for i, line in enumerate(REGISTRY_LINES)], "volume string, line_no int, line string")


@query(
    "line_no INTEGER, shrine_name VARCHAR, province VARCHAR, district VARCHAR, rank VARCHAR, offering VARCHAR, offering_detail VARCHAR, tsukinami BOOLEAN, niiname BOOLEAN, ainame BOOLEAN, seats INTEGER, raw_note VARCHAR, n_defects INTEGER",
    (3, "羽束師坐高御産日神社", "山城國", "乙訓郡", "tai", None, None, True, True, False, 1, "大。月／次新甞", 0),
    (4, "小倉神社", "山城國", "乙訓郡", "sho", None, None, False, False, False, 1, "小", 0),
    (5, "自玉手祭來酒解神社", "山城國", "乙訓郡", "myojin_tai", None, None, True, True, False, 1, "名神大。月次新嘗", 0),
    (7, "平野祭神四社", "山城國", "葛野郡", "myojin_tai", "kanpei", "anjo", True, True, False, 1, "並名神大。月次／新嘗。案上官幣", 0),
    (8, "川田神社", "山城國", "葛野郡", None, None, None, False, False, False, 2, "", 0),
    (10, "欠字〓神社", "大和國", "", None, None, None, False, False, False, 1, "貞コ", 2),
)
def registry_parse(spark, sf_dir):
    out = registry.shrines(registry_lines(spark)).withColumn("n_defects", F.size("defects"))
    return out.select("line_no", "shrine_name", "province", "district", "rank", "offering", "offering_detail", "tsukinami", "niiname", "ainame", "seats", "raw_note", "n_defects")


@query(
    "line_no INTEGER, kind VARCHAR, name VARCHAR, total INTEGER, tai INTEGER, sho INTEGER",
    (1, "province", "山城國", 122, 53, 69), (2, "district", "乙訓郡", 19, None, None), (6, "district", "葛野郡", 20, None, None), (9, "province", "大和國", 286, None, None),
)
def registry_headers(spark, sf_dir):
    return registry.headers(registry_lines(spark)).select("line_no", "kind", "name", "total", "tai", "sho")


@query("kind VARCHAR, n BIGINT", ("unparsed", 1), ("province", 2), ("district", 2), ("shrine", 6))
def registry_line_kinds(spark, sf_dir):
    return registry.classified(registry_lines(spark)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "n_shrines BIGINT, n_myojin_tai BIGINT, n_tai BIGINT, n_sho BIGINT, n_rank_unknown BIGINT, seats BIGINT, n_tsukinami BIGINT, n_niiname BIGINT, n_ainame BIGINT, n_defect BIGINT, n_provinces BIGINT, as_stated BOOLEAN",
    (6, 2, 1, 1, 2, 7, 3, 3, 0, 1, 2, False),
)
def registry_quality(spark, sf_dir):
    return registry.quality(registry.shrines(registry_lines(spark)))


@query(
    "line_no INTEGER, sentence VARCHAR",
    (3, "『延喜式』神名帳に、山城國乙訓郡の「大社」として記載されている。月次祭・新嘗祭に預かる。"),
    (7, "『延喜式』神名帳に、山城國葛野郡の「名神大社」として記載されている。案上官幣・月次祭・新嘗祭に預かる。"),
    (8, "『延喜式』神名帳に、山城國葛野郡の「川田神社」として記載されている。2座。"),
)
def registry_sentences(spark, sf_dir):
    return registry.shrines(registry_lines(spark)).where("line_no IN (3, 7, 8)").select("line_no", registry.describe().alias("sentence"))


INFOBOXES = (
    ("a", "{{神社\n|名称=甲\n|祭神=[[天照大神|天照皇大神]]<br />[[素戔嗚尊]]・[[大国主]]<ref name=\"x\">注釈</ref>、相殿、ほか4柱\n|社格=一宮}}本文"),
    ("b", "前文{{神社\n| 祭神 = {{wikidata|property|P825}}\n}}"),
    ("c", "{{神社|祭神=八幡・住吉（相殿）<!-- 注 -->,{{efn|脚注}}稲荷神|所在地={{ウィキ座標|1}}}}"),
    ("d", "{{日本の寺院|本尊=[[阿弥陀如来]]|宗派=[[浄土真宗]]本願寺派<ref/>|札所等=四国八十八箇所 1番}}"),
    ("e", "{{日本の寺院|宗旨=[[天台宗]]|本尊=|札所等=}}"),
    ("f", "{{神社|祭神=開いたまま"),
)


@query(
    "id VARCHAR, display VARCHAR, link_target VARCHAR, delegated BOOLEAN, aidono BOOLEAN",
    ("a", "天照皇大神", "天照大神", False, True), ("a", "素戔嗚尊", "素戔嗚尊", False, True), ("a", "大国主", "大国主", False, True), ("b", None, None, True, False), ("c", "八幡・住吉", None, False, True),
    ("c", "稲荷神", None, False, True), ("d", None, None, False, False), ("e", None, None, False, False), ("f", "開いたまま", None, False, False),
)
def infobox_deities(spark, sf_dir):
    pages = spark.createDataFrame(list(INFOBOXES), "id string, text string")
    out = wikitext.shrine_info(pages).select("id", F.explode_outer("deities").alias("d"), F.col("delegated_to_wikidata").alias("delegated"), F.col("has_aidono_marker").alias("aidono"))
    return out.select("id", "d.display", "d.link_target", "delegated", "aidono")


@query("id VARCHAR, honzon VARCHAR, denomination VARCHAR, fudasho VARCHAR", ("d", "阿弥陀如来", "浄土真宗本願寺派", "四国八十八箇所 1番"), ("e", "", "天台宗", None))
def infobox_temples(spark, sf_dir):
    pages = spark.createDataFrame([r for r in INFOBOXES if r[0] in "de"], "id string, text string")
    return wikitext.temple_info(pages).select("id", F.array_join(F.transform("honzon", lambda x: x["display"]), ",").alias("honzon"), "denomination", "fudasho")


@query(
    "s VARCHAR, body VARCHAR",
    ("{{另|効|敷/敦}}く<ref>注</ref>。<!-- x -->\n{{header}}\n\n\n\n次[[Category:古典]]", "効く。\n\n次"),
    ("{{page|12}}本文<ref name=a/> \n終", "本文\n終"),
)
def source_body_text(spark, sf_dir):
    rows = ["{{另|効|敷/敦}}く<ref>注</ref>。<!-- x -->\n{{header}}\n\n\n\n次[[Category:古典]]", "{{page|12}}本文<ref name=a/> \n終"]
    return spark.createDataFrame([(r,) for r in rows], "s string").select("s", text.body_text(F.col("s")).alias("body"))


CLUSTERS = (
    (0, "amaterasu", "天照大神", "shinto", ["Q1"], ["天照皇大神", "大日孁貴"], None),
    (1, "susanoo", "素戔嗚尊", "shinto", ["Q2", "Q3"], ["素盞鳴命"], None),
    (2, "munakata", "宗像三女神", "shinto", ["Q4"], ["イチキシマヒメ", "市杵島姫命"], None),
    (3, "later", "後発", "shinto", ["Q2"], ["素戔嗚尊"], None),
)
DEITIES = (
    ("s1", 0, "よくわからない名前", None, "Q3"), ("s1", 1, "市杵島姫命", "イチキシマヒメ", None), ("s1", 2, "素盞鳴命", None, None), ("s1", 3, "彦火明命", None, None), ("s2", 0, "天照大御神", "", ""),
    ("s2", 1, "どこにもない", "天照皇大神", "Q999"),
)


@query(
    "site_id VARCHAR, pos INTEGER, cluster_id VARCHAR, matched_by VARCHAR",
    ("s1", 0, "susanoo", "qid"), ("s1", 1, "munakata", "linkTarget"), ("s1", 2, "susanoo", "alias"), ("s1", 3, None, None), ("s2", 0, "amaterasu", "alias"), ("s2", 1, "amaterasu", "linkTarget"),
)
def deity_resolution(spark, sf_dir):
    clusters = spark.createDataFrame(list(CLUSTERS), masters.SCHEMAS["clusters"])
    deities = spark.createDataFrame(list(DEITIES), "site_id string, pos int, display string, link_target string, qid string")
    return identity.resolve_deities(deities, clusters).select("site_id", "pos", "cluster_id", "matched_by")


@query(
    "benefit_id VARCHAR, sentence VARCHAR",
    ("a", "「縁結び」— この社寺の公式情報に記載があります。"), ("b", "「b」— 大国主をお祀りしているため（祭神・本尊にもとづく推定）。"), ("c", "「厄除け」— 分類の根拠を確認できていません。"),
)
def benefit_sentences(spark, sf_dir):
    rows = [("a", "縁結び", "official", None), ("b", None, "derived", "大国主"), ("c", "厄除け", "derived", None)]
    df = spark.createDataFrame(rows, "benefit_id string, label string, confidence string, deity string")
    return df.select("benefit_id", benefits.explain(F.col("benefit_id"), F.col("label"), F.col("confidence"), F.col("deity")).alias("sentence"))


@query(
    "site_key VARCHAR, clap INTEGER, source_type VARCHAR, pending BOOLEAN, shown VARCHAR",
    ("izumo", 2, "default", True, "二礼二拍手一礼"), ("usa", 4, "official", False, "二礼四拍手一礼"), ("none", 2, "default", False, "二礼二拍手一礼"), ("tera", 0, "default", False, "合掌（拍手はしません）"), ("nourl", 2, "default", True, "二礼二拍手一礼"),
)
def etiquette_resolution(spark, sf_dir):
    sites = spark.createDataFrame([("izumo", "shrine"), ("usa", "shrine"), ("none", "shrine"), ("tera", "temple"), ("nourl", "shrine")], "site_key string, type string")
    rows = [
        (0, "izumo", "甲", 2, 4, 1, "二礼四拍手一礼", None, None, "pending", "PENDING_VERIFICATION", None),
        (1, "usa", "乙", 2, 2, 1, "古い", None, "http://u", "official", None, None),
        (2, "usa", "乙", 2, 4, 1, "二礼四拍手一礼", None, "http://u", "official", "VERIFIED", None),
        (3, "nourl", "丙", 2, 8, 1, "八拍手", None, "", "official", None, None),
    ]
    out = etiquette.resolve(sites, spark.createDataFrame(rows, masters.SCHEMAS["overrides"]))
    shown = etiquette.describe(F.col("bow_before"), F.col("clap"), F.col("bow_after"), F.col("label"))
    return out.select("site_key", "clap", "source_type", "pending", shown.alias("shown"))


@query(
    "name VARCHAR, denomination VARCHAR, goshuin_default VARCHAR",
    ("浄土真宗本願寺派", "浄土真宗", "no"), ("真宗大谷派", "浄土真宗", "no"), ("日蓮宗", "日蓮宗", "unknown"), ("高野山真言宗", None, None), (None, None, None), ("本門法華宗", "日蓮宗", "unknown"),
)
def denomination_rule(spark, sf_dir):
    rows = ["浄土真宗本願寺派", "真宗大谷派", "日蓮宗", "高野山真言宗", None, "本門法華宗"]
    df = spark.createDataFrame([(r,) for r in rows], "name string").withColumn("r", etiquette.denomination_rule(F.col("name")))
    return df.select("name", "r.denomination", "r.goshuin_default")


@query(
    "id INTEGER, access_mode VARCHAR, walk_load VARCHAR, reason VARCHAR, icon VARCHAR",
    (1, "TRAIN_ONLY", "EASY", "甲駅から徒歩12分。", "🚃"),
    (2, "TRAIN_BUS", "EASY", "バス停「乙」（平日18本/日）から徒歩8分。", "🚌"),
    (3, "UNKNOWN", "EASY", "バス停「乙」はありますが、この地域のバス運行データが公開されていないため便数を確認できません。現地の時刻表をご確認ください。", "❓"),
    (4, "CAR_RECOMMENDED", "EASY", "バス停「乙」の便数が平日3本/日と少ないため、車をおすすめします。", "🚗"),
    (5, "CAR_ONLY", "HARD", "最寄りの交通機関から徒歩75分。公共交通では現実的ではありません。", "🚗"),
    (6, "CAR_ONLY", "EASY", "徒歩圏に鉄道駅・バス停が見つかりませんでした。", "🚗"),
    (7, "CAR_RECOMMENDED", "EASY", "バス停「乙」から徒歩8分と離れています。", "🚗"),
    (8, "CAR_RECOMMENDED", "HARD", "最寄り駅甲駅から徒歩40分。バス路線は確認できていません。", "🚗"),
    (9, "CAR_ONLY", "HARD", "最寄り駅甲駅から徒歩70分。公共交通では現実的ではありません。", "🚗"),
)
def access_sentences(spark, sf_dir):
    bus = lambda walk, trips, connects: ("乙", walk, trips, None, connects)
    rows = [
        (1, ("甲駅", 12), None, 12, 0.0), (2, ("甲駅", 60), bus(8, 18, True), 8, 0.0), (3, None, bus(8, None, None), 8, None), (4, None, bus(8, 3, None), 8, None), (5, None, bus(50, 2, None), 75, None),
        (6, None, None, None, None), (7, None, bus(8, 20, False), 8, None), (8, ("甲駅", 40), None, 40, 150.0), (9, ("甲駅", 70), None, 70, None),
    ]
    schema = "id int, station struct<name:string,walk_min:int>, bus struct<name:string,walk_min:int,trips_weekday:int,unknown_reason:string,connects_to_station:boolean>, walk_minutes int, ascent_m double"
    out = access.assess(spark.createDataFrame(rows, schema))
    badge = access.badge(F.col("access_mode"), F.col("walk_load"), F.col("walk_minutes"), F.col("ascent_m"), F.lit(None).cast("double"))
    return out.select("id", "access_mode", "walk_load", "reason", badge["icon"].alias("icon"))


@query("kind VARCHAR, n BIGINT", ("geography", 47), ("benefit", 80), ("access", 8), ("goshuin", 8))
def gaps_of_nothing(spark, sf_dir):
    sites = spark.createDataFrame([], "id string, pos int, name string, prefecture_code string, benefits array<struct<major_id:string,weight:string>>, access_mode string, goshuin_available string, etiquette_source_type string")
    return gaps.by_kind(gaps.detect(sites))


@query(
    "kind VARCHAR, description VARCHAR, count BIGINT, expected BIGINT",
    ("pilgrimage", "四国八十八箇所 が 62/88 件しか収録されていません。めぐりコース機能が成立しません。", 62, 88),
    ("etiquette", "参拝作法が未確認（PENDING_VERIFICATION）の社寺が 2 件あります: 甲、乙", 0, 2),
    ("access", "関東に「車なしで行ける」社寺が 1 件しかありません。", 1, 3),
)
def gaps_report_rows(spark, sf_dir):
    schema = "id string, pos int, name string, prefecture_code string, benefits array<struct<major_id:string,weight:string>>, access_mode string, goshuin_available string, etiquette_source_type string"
    rows = [("a", 0, "甲", "13", [("enmusubi", "primary")], "TRAIN_ONLY", "yes", "pending"), ("b", 1, "乙", "13", [("shoubai", "secondary")], "CAR_ONLY", "no", "pending"), ("c", 2, "丙", "99", [], None, None, "default")]
    covered = spark.createDataFrame([("shikoku88", "四国八十八箇所", 88, 62), ("seven", "七福神", 7, 7)], "group_id string, name string, total_count int, registered long")
    found = gaps.detect(spark.createDataFrame(rows, schema), covered=covered)
    return found.where("kind IN ('pilgrimage', 'etiquette') OR (kind = 'access' AND region = '関東')").select("kind", "description", "count", "expected")


@query(
    "id INTEGER, map VARCHAR, directions VARCHAR, course VARCHAR",
    (1, "https://www.google.com/maps/search/?api=1&query=35.5,139.25", "https://www.google.com/maps/dir/?api=1&destination=35.5,139.25&travelmode=transit",
     "https://www.google.com/maps/dir/?api=1&origin=35.5%2C139.25&destination=35%2C139&travelmode=transit&waypoints=34%2C138%7C-33.125%2C0.00001"),
    (2, "https://www.google.com/maps/search/?api=1&query=1,-2", "https://www.google.com/maps/dir/?api=1&destination=1,-2&travelmode=transit", None),
)
def map_links(spark, sf_dir):
    rows = [(1, [(35.5, 139.25), (34.0, 138.0), (-33.125, 0.00001), (35.0, 139.0)]), (2, [(1.0, -2.0)])]
    df = spark.createDataFrame(rows, "id int, points array<struct<lat:double,lng:double>>")
    first = F.get(F.col("points"), F.lit(0))
    return df.select("id", display.map_url(first["lat"], first["lng"]).alias("map"), display.directions_url(first["lat"], first["lng"]).alias("directions"), display.course_url(F.col("points")).alias("course"))


@query(
    "title VARCHAR, url VARCHAR",
    ("明治 神宮", "https://wikimedia.org/api/rest_v1/metrics/pageviews/per-article/ja.wikipedia/all-access/user/%E6%98%8E%E6%B2%BB_%E7%A5%9E%E5%AE%AE/monthly/2025010100/2026070100"),
    ("A (b)!", "https://wikimedia.org/api/rest_v1/metrics/pageviews/per-article/ja.wikipedia/all-access/user/A_(b)!/monthly/2025010100/2026070100"),
)
def pageview_urls(spark, sf_dir):
    months = dumps.month_range(F.lit(2025), F.lit(1), F.lit(2026), F.lit(7))
    df = spark.createDataFrame([("明治 神宮",), ("A (b)!",)], "title string").withColumn("m", months)
    return df.select("title", dumps.pageview_url(F.col("title"), F.col("m.start"), F.col("m.end")).alias("url"))


@query("id INTEGER, year INTEGER, month INTEGER, views BIGINT", (1, 2026, 1, 18438), (1, 2026, 2, 7000))
def pageview_responses(spark, sf_dir):
    body = '{"items":[{"timestamp":"2026010100","views":18438},{"timestamp":"2026020100","views":7000}]}'
    df = spark.createDataFrame([(1, body), (2, '{"items":[]}'), (3, "no json")], "id int, body string")
    return df.select("id", F.inline(dumps.parse_pageview_response(F.col("body"))))


@query("title VARCHAR, n INTEGER", *[(t, 1) for t in dict.fromkeys(t for titles in dumps.CLASSICAL_TITLES.values() for t in titles)])
def classical_titles(spark, sf_dir):
    return dumps.classical_titles(spark).groupBy("title").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("s VARCHAR, file VARCHAR", ('延喜式/卷第九:a*?"<>|\\', "延喜式_卷第九_a_______"))
def file_names(spark, sf_dir):
    return spark.createDataFrame([('延喜式/卷第九:a*?"<>|\\',)], "s string").select("s", text.file_name(F.col("s")).alias("file"))


@query("z INTEGER, layers VARCHAR", (14, "dem5a,dem5b,dem5c,dem"), (15, "dem5a,dem5b,dem5c"), (16, ""))
def dem_layers(spark, sf_dir):
    return spark.createDataFrame([(14,), (15,), (16,)], "z int").select("z", F.array_join(geo.layers_for_zoom(F.col("z")), ",").alias("layers"))


@query("site_id VARCHAR, shown VARCHAR", ("a", "四国八十八箇所 第3番"), ("a", "日本三大稲荷（諸説あり）"))
def group_names(spark, sf_dir):
    members = spark.createDataFrame([("a", "g1", 3), ("a", "g2", None), ("a", "gone", 1)], "site_id string, group_id string, order_no int")
    groups = spark.createDataFrame([("g1", "四国八十八箇所", False), ("g2", "日本三大稲荷", True)], "group_id string, name string, disputed boolean")
    return display.group_names(members, groups).select("site_id", "shown")


@query(
    "site_id VARCHAR, title VARCHAR, shown VARCHAR, notes VARCHAR",
    ("a", "御朱印の授与があります", "受付時間=09:00〜16:00|昼休み=12:00〜13:00|書き方=直書き・書き置きの両方|初穂料=300円", "※参拝時間と御朱印の受付時間は別です。御朱印のほうが早く終わることがあります。"),
    ("b", "御朱印の授与があります", "書き方=書き置きのみ|授与所=無人（不在の場合があります）|郵送=対応あり", "限定|宗派"),
    ("c", "御朱印の授与はありません", "", "宗派"),
    ("d", "御朱印の有無は確認できていません", "", "宗派|無人の社寺では授与所が無く、いただけない場合があります。"),
    ("e", "御朱印の情報はまだ調べていません。", "", ""),
)
def goshuin_panels(spark, sf_dir):
    span = "struct<`from`:string,to:string>"
    schema = f"site_id string, goshuin struct<available:string,hours:{span},lunch_break:{span},write_style:string,fee:double,unmanned:boolean,mail_order:string,limited_note:string,denomination_note:string>"
    rows = [
        ("a", ("yes", ("09:00", "16:00"), ("12:00", "13:00"), "both", 300.0, False, "no", None, "")), ("b", ("yes", None, None, "paper", None, True, "yes", "限定", "宗派")),
        ("c", ("no", None, None, "direct", 300.0, None, None, None, "宗派")), ("d", ("unknown", None, None, "unknown", None, None, None, None, "宗派")), ("e", None),
    ]
    out = display.goshuin_panel(spark.createDataFrame(rows, schema))
    return out.select("site_id", "title", F.array_join(F.transform("rows", lambda r: F.concat_ws("=", r["name"], r["value"])), "|").alias("shown"), F.array_join("notes", "|").alias("notes"))


@query("date VARCHAR, shown VARCHAR", ("2026-08-01", "2026-08-01 時点の情報"), ("2026-01-31", "2026-01-31 時点の情報（8ヶ月前。変更されている可能性があります）"), ("いつか", "いつか 時点の情報"), (None, None))
def verified_notes(spark, sf_dir):
    df = spark.createDataFrame([("2026-08-01",), ("2026-01-31",), ("いつか",), (None,)], "date string")
    return df.select("date", display.verified_note(F.col("date"), F.to_date(F.lit("2026-09-01"))).alias("shown"))


@query(
    "id INTEGER, badge VARCHAR, note VARCHAR",
    (1, "一次史料", "（原文はパブリックドメイン）"), (2, "読み下し・現代語", "（CC BY-SA 4.0）※OCRテキストのため誤りを含む場合があります"), (3, "近代の記録", "（原文はPD／注は CC BY-SA 4.0）"), (4, "一次史料", ""),
)
def citation_badges(spark, sf_dir):
    rows = [(1, 1, "PD", False), (2, 2, "CC-BY-SA-4.0", True), (3, 3, "PD+CC-BY-SA-4.0", None), (4, 1, None, False)]
    df = spark.createDataFrame(rows, "id int, layer int, rights string, ocr boolean")
    return df.select("id", display.layer_badge(F.col("layer")).alias("badge"), display.rights_note(F.col("rights"), F.col("ocr")).alias("note"))


@query("confidence VARCHAR, badge VARCHAR", ("official", "公式サイト記載"), ("derived", "祭神・本尊からの推定"), ("unknown", "未確認"))
def confidence_badges(spark, sf_dir):
    return spark.createDataFrame([("official",), ("derived",), ("unknown",)], "confidence string").select("confidence", benefits.confidence_badge(F.col("confidence")).alias("badge"))


@query("id INTEGER, notice VARCHAR", (1, None), (2, "この社寺のご利益は、祭神・本尊からは特定できていません。文化財指定・札所・御朱印の情報をご覧ください。"), (3, None))
def benefit_notices(spark, sf_dir):
    df = spark.createDataFrame([(1, ["a"], []), (2, [], []), (3, [], ["b"])], "id int, primary_ids array<string>, secondary_ids array<string>")
    return df.select("id", benefits.benefit_notice(F.col("primary_ids"), F.col("secondary_ids")).alias("notice"))


@query(
    "id INTEGER, icon VARCHAR, label VARCHAR, load VARCHAR, walk VARCHAR, notes VARCHAR, car_free VARCHAR",
    (1, "🚃", "電車のみ", "徒歩らく", "徒歩12分 / 登り5m", "", "車なしで行ける"),
    (2, "❓", "判定不能", "徒歩きつい", "徒歩40分", "この地域はバスの運行データが公開されていないため、車が必要かどうかを判定できていません。バス停の位置は地図に表示しています。現地の時刻表をご確認ください。|参道の登りがあります。歩きやすい靴をおすすめします。|周辺より約31m 高い場所にあります。", "車が必要"),
    (3, "❓", "アクセス未調査", None, "", "", "未調査"),
)
def access_badges(spark, sf_dir):
    rows = [(1, "TRAIN_ONLY", "EASY", 12, 4.5, 29.9), (2, "UNKNOWN", "HARD", 40, None, 30.5), (3, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, mode string, load string, minutes int, ascent double, around double")
    b = access.badge(F.col("mode"), F.col("load"), F.col("minutes"), F.col("ascent"), F.col("around"))
    return df.select("id", b.alias("b"), access.car_free_label(F.col("mode")).alias("car_free")).select("id", "b.icon", "b.label", "b.load", "b.walk", F.array_join("b.notes", "|").alias("notes"), "car_free")


@query("site_id VARCHAR, text VARCHAR", ("a", "x"))
def sourced_lore(spark, sf_dir):
    return display.lore(spark.createDataFrame([("a", "x", "http://s"), ("b", "y", ""), ("c", "z", None)], "site_id string, text string, source_url string")).select("site_id", "text")


MASTER = {
    "majors": [(i, m, m) for i, m in enumerate(gaps.MAJORS) if m != "nariwai"] + [(10, "odd", "?")],
    "minors": [(0, "enmusubi", "love", "恋愛"), (1, "enmusubi", "love", "重複"), (100, "shoubai", "trade", "商売"), (1000, "odd", "lost", "?")],
    "clusters": [(0, "a", "甲神", "shinto", [], ["共有"], None), (1, "b", "乙", "shinto", [], ["共有", "甲"], None), (2, "a", "再", "shinto", [], [], None), (3, "c", "丙", "shinto", [], [], None)],
    "mappings": [(0, "a", ["love", "trade", "love2"], ["love"], None), (1, "b", [], ["lost"], None), (2, "zz", ["love"], [], None), (3, "b", ["trade"], [], "NO_AUTO_MAPPING")],
    "overrides": [(0, "k", "社", 2, 4, 1, "四拍手", None, None, "official", None, None), (1, "l", "宮", 2, 4, 1, "四拍手", None, "http://x", "pending", "PENDING_VERIFICATION", None)],
    "groups": [(0, "g", "fudasho", "札所", None, None, True, False, None), (1, "g", "sandai", "三大", 3, None, False, False, None), (2, "h", "odd", "?", None, None, False, False, None)],
}


@query(
    "rule VARCHAR, severity VARCHAR, file VARCHAR, message VARCHAR",
    ("V1", "error", "benefits.yaml", '未知の大分類ID "odd"。許可されるのは enmusubi, shoubai, gakugyou, kenkou, yakuyoke, anzan, koutsuu, shoubu, kanai, nariwai'),
    ("V2", "error", "benefits.yaml", '細分類ID "love" が重複しています'),
    ("V3", "error", "benefits.yaml", "大分類が欠けています: nariwai"),
    ("V4", "error", "deity_clusters.yaml", 'クラスタID "a" が重複しています'),
    ("V5", "warning", "deity_clusters.yaml", '別名 "共有" が a と b の両方にあります。先に定義された a が優先されます'),
    ("V5b", "warning", "deity_clusters.yaml", '別名 "甲" の正規形が a と重なります'),
    ("V6", "error", "cluster_benefits.yaml", 'クラスタ "zz" が deity_clusters.yaml に存在しません'),
    ("V7", "error", "cluster_benefits.yaml", 'クラスタ "b" の割り当てが重複しています'),
    ("V8", "error", "cluster_benefits.yaml", 'a.primary の御利益ID "love2" が benefits.yaml に存在しません'),
    ("V8", "error", "cluster_benefits.yaml", 'b.secondary の御利益ID "lost" が benefits.yaml に存在しません'),
    ("V9", "error", "cluster_benefits.yaml", 'a: "love" が primary と secondary の両方にあります'),
    ("V10", "warning", "cluster_benefits.yaml", "a: primary が 3 件あります。設計方針は「1〜2個だけ」です"),
    ("V11", "warning", "cluster_benefits.yaml", "b: primary が空です。検索に一切出てきません"),
    ("V12", "warning", "deity_clusters.yaml", 'クラスタ "c" に御利益の割り当てがありません。この祭神からは何も導出されません'),
    ("V13", "error", "etiquette_overrides.yaml", "社: source_type が official なのに source_url がありません"),
    ("V14", "warning", "etiquette_overrides.yaml", "宮: source_url があるのに pending のままです。official に昇格させてください"),
    ("V15", "warning", "etiquette_overrides.yaml", "宮: 一次情報の裏取りが未了です（四拍手 は表示されません）"),
    ("V16", "error", "pilgrimage_groups.yaml", 'グループID "g" が重複しています'),
    ("V16", "error", "pilgrimage_groups.yaml", 'h: 未知の kind "odd"'),
    ("V17", "warning", "pilgrimage_groups.yaml", "g: numbered なのに total_count がありません。収録率を管理できません"),
    ("V17", "warning", "pilgrimage_groups.yaml", "g: kind が sandai です。諸説あるなら disputed: true を付けてください"),
)
def master_issues(spark, sf_dir):
    return masters.validate(masters.tables(spark, MASTER))


@query("condition VARCHAR, n BIGINT", *[(c, 0) for c in masters.conditions("shikinai_record")])
def schema_checks(spark, sf_dir):
    return masters.violations(registry.shrines(registry_lines(spark)), "shikinai_record")


@query("name VARCHAR, key VARCHAR, kind VARCHAR, n BIGINT", ("site", "id", "primary", 1), ("site_benefit", "benefit_id", "foreign", 2), ("site_lore", "site_id", "foreign", 1))
def schema_keys(spark, sf_dir):
    t = {
        "site": spark.createDataFrame([("a",), ("a",), ("b",)], "id string"),
        "benefit": spark.createDataFrame([("x",)], "id string"),
        "site_benefit": spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y")], "site_id string, benefit_id string"),
        "site_lore": spark.createDataFrame([("a", None), ("c", "x")], "site_id string, benefit_id string"),
    }
    return masters.key_violations(t)


@query("n BIGINT, volume VARCHAR, line_no INTEGER, line VARCHAR", (1, "v9", 0, "巻頭の注記"))
def unparsed_lines(spark, sf_dir):
    return registry.unparsed_sample(registry_lines(spark), 5)


@query("id VARCHAR, name VARCHAR, n_groups INTEGER, bus VARCHAR", ("sample-yamadera", "某山中の寺（サンプル）", 1, "谷口"))
def sample_site(spark, sf_dir):
    return samples.find_site(samples.sample_sites(spark), "sample-yamadera").select("id", "name", F.size("groups").alias("n_groups"), F.col("access.bus.name").alias("bus"))


@query("name VARCHAR, n BIGINT", ("majors", 10), ("minors", 4), ("clusters", 4), ("mappings", 4), ("overrides", 2), ("groups", 3), ("suppressed", 1))
def master_summary(spark, sf_dir):
    return masters.summary(masters.tables(spark, MASTER)).withColumnRenamed("table", "name")


BROKEN = {name: "" for name in masters.FILES} | {"cluster_benefits": "mappings:\n  - {cluster: gone, primary: []}\n"}


@query("line VARCHAR", ("[benefits.yaml] 大分類が欠けています: " + ", ".join(gaps.MAJORS),), ('[cluster_benefits.yaml] クラスタ "gone" が deity_clusters.yaml に存在しません',))
def master_load_error(spark, sf_dir):
    try:
        masters.load(spark, BROKEN)
    except masters.MasterDataError as e:
        return spark.createDataFrame([(line,) for line in str(e).split("\n")], "line string")


@query(
    "line VARCHAR",
    ("errors: 2, warnings: 1",), ("[error] benefits.yaml: 大分類が欠けています: " + ", ".join(gaps.MAJORS),), ('[error] cluster_benefits.yaml: クラスタ "gone" が deity_clusters.yaml に存在しません',), ("[warning] cluster_benefits.yaml: gone: primary が空です。検索に一切出てきません",),
)
def master_report(spark, sf_dir):
    issues = masters.validate(masters.tables(spark, masters.parse(BROKEN)))
    return spark.createDataFrame([(line,) for line in masters.render(issues).split("\n")], "line string")
