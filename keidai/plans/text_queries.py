"""Operators on texts and files, over whole benchmark tables: each row becomes a text of known parts, and the SQL states these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keidai.functions import text
from keidai.operators import access, etiquette, gaps, registry, wikitext
from keidai.plans.table_queries import ACCESS_SQL, access_sites, read
from keidai.sources import dumps, masters
from keidai.sources.shared import fresh_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def pick(items: tuple, at: Column) -> Column:
    return F.get(F.array(*map(F.lit, items)), at.cast("int"))


def listed(items: tuple, at: str) -> str:
    """The same in DuckDB."""
    return f"([{', '.join(repr(x) for x in items)}])[1 + ({at})]"


# ── Numerals and names ──


@query("SELECT o_orderkey, CAST(o_orderkey % 10000 AS INTEGER) AS n, CAST(o_orderkey % 10000 AS INTEGER) AS seats, o_orderkey % 13 = 0 AS defect FROM orders")
def numerals_of_orders(spark, sf_dir):
    n = F.col("o_orderkey") % 10000
    digit = lambda d: pick(tuple("〇一二三四五六七八九"), d)
    place = lambda k, unit: F.when(F.floor(n / k) % 10 == 0, "").when(F.floor(n / k) % 10 == 1, unit).otherwise(F.concat(digit(F.floor(n / k) % 10), F.lit(unit)))
    numeral = F.concat(place(1000, "千"), place(100, "百"), place(10, "十"), F.when((n % 10 > 0) | (n == 0), digit(n % 10)).otherwise(""))
    line = F.concat(F.lit("社"), numeral, F.lit("座"), F.when(F.col("o_orderkey") % 13 == 0, "〓").otherwise(""))
    return read(spark, sf_dir, "orders").select("o_orderkey", text.kansuji(numeral).alias("n"), text.seats(line).alias("seats"), text.has_defect(line).alias("defect"))


STEMS = ("天照", "素戔嗚", "大国主", "金山彦", "市杵島姫", "竜田", "桜井", "弥勒")
SPELLED = ("天照", "素盞鳴", "大國主", "金山毘古", "市杵島比売", "龍田", "櫻井", "彌勒")
SUFFIXES = ("命", "尊", "大神", "大御神", "", "様", "神", "権現")


@query(f"SELECT p_partkey, {listed(STEMS, 'p_partkey % 8')} || CAST(p_partkey AS VARCHAR) AS key FROM part")
def names_of_parts(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.concat(
        F.when(k % 5 == 0, "主祭神：").otherwise(""), F.when(k % 3 == 0, pick(STEMS, k % 8)).otherwise(pick(SPELLED, k % 8)), F.when(k % 11 == 0, "・").otherwise(""), k.cast("string"),
        pick(SUFFIXES, F.floor(k / 8) % 8), F.when(k % 7 == 0, "（異説あり）").otherwise(""),
    )
    return read(spark, sf_dir, "part").select("p_partkey", text.deity_key(name).alias("key"))


# ── Registry ──

PROVINCES = ("山城國", "大和國", "河內國", "和泉國", "攝津國")
DISTRICTS = ("乙訓郡", "葛野郡", "愛宕郡")
NOTES = ("大。月次／新嘗", "小", "名神大。月次新嘗", "並名神大。月次／新嘗。案上官幣", "", "大。相甞")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    shrine = F.concat(F.lit("社"), k.cast("string"), F.lit("神社"), F.when(k % 3 == 0, "二座").otherwise(""), F.lit("／"), pick(NOTES, k % 6), F.lit("∥"))
    line = (
        F.when(k % 20 == 0, F.concat(pick(PROVINCES, c % 5), F.lit("百二十二座大五十三座小六十九座")))
        .when(k % 20 < 3, F.concat(pick(DISTRICTS, k % 3), F.lit("十九座")))
        .when(k % 20 == 3, F.concat(F.lit("巻頭の注記 "), k.cast("string")))
        .when(k % 20 == 4, F.lit("　"))
        .otherwise(shrine)
    )
    return read(spark, sf_dir, "orders").select((c % 50).alias("volume"), k.alias("line_no"), line.alias("line"))


LINES_SQL = f"""l AS (SELECT o_custkey % 50 AS volume, o_orderkey AS line_no, o_orderkey % 20 AS m, CASE WHEN o_orderkey % 20 = 0 THEN {listed(PROVINCES, 'o_custkey % 5')} END AS p,
  CASE WHEN o_orderkey % 20 IN (1, 2) THEN {listed(DISTRICTS, 'o_orderkey % 3')} END AS d FROM orders),
h AS (SELECT volume, line_no, m, coalesce(last_value(p IGNORE NULLS) OVER w, '') AS province, coalesce(last_value(CASE WHEN p IS NOT NULL THEN '' ELSE d END IGNORE NULLS) OVER w, '') AS district FROM l WHERE m <> 4
  WINDOW w AS (PARTITION BY volume ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s AS (SELECT volume, line_no, '社' || CAST(line_no AS VARCHAR) || '神社' AS shrine_name, province, district, {listed(('tai', 'sho', 'myojin_tai', 'myojin_tai', '', 'tai'), 'line_no % 6')} AS r,
  line_no % 6 = 3 AS kanpei, line_no % 6 IN (0, 2, 3) AS tsukinami, line_no % 6 IN (0, 2, 3) AS niiname, line_no % 6 = 5 AS ainame, CAST(CASE WHEN line_no % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS seats FROM h WHERE m > 4)"""


@query(f"""WITH {LINES_SQL} SELECT volume, line_no, shrine_name, province, district, nullif(r, '') AS rank, CASE WHEN kanpei THEN 'kanpei' END AS offering, CASE WHEN kanpei THEN 'anjo' END AS offering_detail, tsukinami, niiname, ainame, seats,
'『延喜式』神名帳に、' || CASE WHEN province <> '' THEN province || district || 'の' ELSE '' END || '「' || CASE r WHEN 'tai' THEN '大社' WHEN 'sho' THEN '小社' WHEN 'myojin_tai' THEN '名神大社' ELSE shrine_name END || '」として記載されている。'
|| CASE WHEN kanpei OR tsukinami OR niiname OR ainame THEN concat_ws('・', CASE WHEN kanpei THEN '案上官幣' END, CASE WHEN tsukinami THEN '月次祭' END, CASE WHEN niiname THEN '新嘗祭' END, CASE WHEN ainame THEN '相嘗祭' END) || 'に預かる。' ELSE '' END
|| CASE WHEN seats > 1 THEN CAST(seats AS VARCHAR) || '座。' ELSE '' END AS sentence FROM s""")
def registry_of_orders(spark, sf_dir):
    columns = ("volume", "line_no", "shrine_name", "province", "district", "rank", "offering", "offering_detail", "tsukinami", "niiname", "ainame", "seats")
    return registry.shrines(order_lines(spark, sf_dir)).select(*columns, registry.describe().alias("sentence"))


@query(f"""WITH l AS (SELECT *, o_orderkey % 20 AS m FROM orders)
SELECT o_custkey % 50 AS volume, o_orderkey AS line_no, CASE m WHEN 0 THEN 'province' ELSE 'district' END AS kind, CASE m WHEN 0 THEN {listed(PROVINCES, 'o_custkey % 5')} ELSE {listed(DISTRICTS, 'o_orderkey % 3')} END AS name,
CAST(CASE m WHEN 0 THEN 122 ELSE 19 END AS INTEGER) AS total, CAST(CASE m WHEN 0 THEN 53 END AS INTEGER) AS tai, CAST(CASE m WHEN 0 THEN 69 END AS INTEGER) AS sho FROM l WHERE m < 3""")
def registry_headers_of_orders(spark, sf_dir):
    return registry.headers(order_lines(spark, sf_dir)).select("volume", "line_no", "kind", "name", "total", "tai", "sho")


@query("""WITH u AS (SELECT o_custkey % 50 AS volume, o_orderkey AS line_no, '巻頭の注記 ' || CAST(o_orderkey AS VARCHAR) AS line FROM orders WHERE o_orderkey % 20 = 3)
SELECT (SELECT count(*) FROM u) AS n, volume, line_no, line FROM u ORDER BY volume, line_no LIMIT 20""")
def registry_unparsed_of_orders(spark, sf_dir):
    return registry.unparsed_sample(order_lines(spark, sf_dir), 20)


@query(f"""WITH {LINES_SQL} SELECT count(*) AS n_shrines, count(*) FILTER (WHERE r = 'myojin_tai') AS n_myojin_tai, count(*) FILTER (WHERE r = 'tai') AS n_tai, count(*) FILTER (WHERE r = 'sho') AS n_sho, count(*) FILTER (WHERE r = '') AS n_rank_unknown,
CAST(coalesce(sum(seats), 0) AS BIGINT) AS seats, count(*) FILTER (WHERE tsukinami) AS n_tsukinami, count(*) FILTER (WHERE niiname) AS n_niiname, count(*) FILTER (WHERE ainame) AS n_ainame, CAST(0 AS BIGINT) AS n_defect,
count(DISTINCT nullif(province, '')) AS n_provinces, abs(count(*) - 2861) <= 50 AS as_stated FROM s""")
def registry_quality_of_orders(spark, sf_dir):
    return registry.quality(registry.shrines(order_lines(spark, sf_dir)))


# ── Infoboxes ──


@query("""WITH k AS (SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS k FROM part),
d AS (SELECT p_partkey, unnest(CASE p_partkey % 4 WHEN 0 THEN [{'a': 'D' || k, 'b': 'L' || k}, {'a': 'M' || k, 'b': 'M' || k}, {'a': 'N' || k, 'b': 'N' || k}] WHEN 1 THEN [{'a': '八幡' || k || '・住吉', 'b': NULL}, {'a': '稲荷神' || k, 'b': NULL}]
WHEN 2 THEN [{'a': 'P' || k, 'b': NULL}] ELSE [] END) AS d FROM k) SELECT p_partkey, d.a AS display, d.b AS link_target FROM d""")
def infoboxes_of_parts(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    field = (
        F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("[[L"), k, F.lit("|D"), k, F.lit("]]<br />[[M"), k, F.lit("]]・[[N"), k, F.lit(']]<ref name="x">注</ref>、相殿、ほか4柱')))
        .when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("八幡"), k, F.lit("・住吉（相殿）<!-- 注 -->,{{efn|脚注}}稲荷神"), k))
        .when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("\n P"), k, F.lit(" \n")))
        .otherwise("{{wikidata|property|P825}}")
    )
    pages = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("前文{{神社\n|名称="), F.col("p_name"), F.lit("\n|祭神="), field, F.lit("\n|社格={{ウィキ座標|1}}}}本文 |祭神=外")).alias("text"))
    named = F.transform("deities", lambda d: F.struct(d["display"].alias("display"), d["link_target"].alias("link_target")))
    return wikitext.shrine_info(pages).select("p_partkey", F.inline_outer(named)).where("display IS NOT NULL")  # outer, as a filter on empty arrays would be pushed down to where the file is read


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '阿弥陀如来' || CAST(p_partkey AS VARCHAR) ELSE '' END AS honzon, CASE WHEN p_partkey % 3 = 0 THEN '浄土真宗本願寺派' ELSE '天台宗' END AS denomination,
CASE WHEN p_partkey % 5 = 0 THEN '四国八十八箇所 ' || CAST(p_partkey AS VARCHAR) || '番' END AS fudasho FROM part""")
def temples_of_parts(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_partkey").cast("string")
    body = F.concat(
        F.lit("{{日本の寺院|本尊="), F.when(k % 2 == 0, F.concat(F.lit("[[阿弥陀如来"), n, F.lit("]]"))).otherwise(""), F.when(k % 3 == 0, "|宗派=[[浄土真宗]]本願寺派<ref/>").otherwise("|宗旨=[[天台宗]]"),
        F.when(k % 5 == 0, F.concat(F.lit("|札所等=四国八十八箇所 "), n, F.lit("番"))).otherwise("|札所等="), F.lit("}}"),
    )
    out = wikitext.temple_info(read(spark, sf_dir, "part").select("p_partkey", body.alias("text")))
    return out.select("p_partkey", F.array_join(F.transform("honzon", lambda x: x["display"]), ",").alias("honzon"), "denomination", "fudasho")


# ── Access and etiquette ──


@query(f"""WITH {ACCESS_SQL}, x AS (SELECT a.*, acc.access_mode, walk > 60 AS far FROM a JOIN acc USING (site_id))
SELECT site_id, CASE WHEN station_walk <= 25 THEN 'Sから徒歩' || CAST(station_walk AS VARCHAR) || '分。'
WHEN bus AND trips IS NULL THEN 'バス停「B」はありますが、この地域のバス運行データが公開されていないため便数を確認できません。現地の時刻表をご確認ください。'
WHEN bus AND trips >= 6 AND bus_walk <= 20 AND coalesce(connects, true) THEN 'バス停「B」（平日' || CAST(trips AS VARCHAR) || '本/日）から徒歩' || CAST(bus_walk AS VARCHAR) || '分。'
WHEN bus AND far THEN '最寄りの交通機関から徒歩' || CAST(walk AS VARCHAR) || '分。公共交通では現実的ではありません。'
WHEN bus AND trips < 6 THEN 'バス停「B」の便数が平日' || CAST(trips AS VARCHAR) || '本/日と少ないため、車をおすすめします。'
WHEN bus THEN 'バス停「B」から徒歩' || CAST(bus_walk AS VARCHAR) || '分と離れています。'
WHEN station_walk IS NOT NULL AND far THEN '最寄り駅Sから徒歩' || CAST(station_walk AS VARCHAR) || '分。公共交通では現実的ではありません。'
WHEN station_walk IS NOT NULL THEN '最寄り駅Sから徒歩' || CAST(station_walk AS VARCHAR) || '分。バス路線は確認できていません。' ELSE '徒歩圏に鉄道駅・バス停が見つかりませんでした。' END AS reason,
CASE access_mode WHEN 'TRAIN_ONLY' THEN '🚃' WHEN 'TRAIN_BUS' THEN '🚌' WHEN 'UNKNOWN' THEN '❓' ELSE '🚗' END AS icon, CASE WHEN access_mode IN ('TRAIN_ONLY', 'TRAIN_BUS') THEN '車なしで行ける' ELSE '車が必要' END AS car_free FROM x""")
def access_reasons(spark, sf_dir):
    rows = access_sites(spark, sf_dir)
    b = access.badge(F.col("access_mode"), F.col("walk_load"), F.col("walk_minutes"), F.col("ascent_m"), F.lit(None).cast("double"))
    return rows.select("site_id", "reason", b["icon"].alias("icon"), access.car_free_label(F.col("access_mode")).alias("car_free"))


@query("""WITH o AS (SELECT l_suppkey AS k, arg_max({'clap': l_linenumber, 'ok': l_returnflag = 'R' AND l_linestatus = 'F'}, l_orderkey * 10 + l_linenumber) AS o FROM lineitem WHERE l_suppkey % 3 <> 0 GROUP BY 1)
SELECT s_suppkey AS site_key, CAST(CASE WHEN o.ok THEN o.clap WHEN s_nationkey % 2 = 0 THEN 2 ELSE 0 END AS INTEGER) AS clap, CASE WHEN o.ok THEN 'official' ELSE 'default' END AS source_type, k IS NOT NULL AND NOT coalesce(o.ok, false) AS pending,
CASE WHEN o.ok THEN '二礼' || ([' 〇', '一', '二', '三', '四', '五', '六', '七'])[1 + o.clap] || '拍手一礼' WHEN s_nationkey % 2 = 0 THEN '二礼二拍手一礼' ELSE '合掌（拍手はしません）' END AS shown FROM supplier LEFT JOIN o ON s_suppkey = k""")
def etiquette_of_suppliers(spark, sf_dir):
    sites = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("site_key"), F.when(F.col("s_nationkey") % 2 == 0, "shrine").otherwise("temple").alias("type"))
    c = F.col
    rows = read(spark, sf_dir, "lineitem").where("l_suppkey % 3 <> 0").select(
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("ord"), c("l_suppkey").alias("site_key"), F.lit(2).alias("bow_before"), c("l_linenumber").cast("int").alias("clap"), F.lit(1).alias("bow_after"), F.lit("x").alias("label"),
        F.lit(None).cast("string").alias("notes"), F.when(c("l_linestatus") == "F", "http://s").otherwise("").alias("source_url"), F.when(c("l_returnflag") == "R", "official").otherwise("pending").alias("source_type"),
    )
    out = etiquette.resolve(sites, rows)
    return out.select("site_key", "clap", "source_type", "pending", etiquette.describe(c("bow_before"), c("clap"), c("bow_after"), c("label")).alias("shown"))


SECTS = ("浄土真宗本願寺派", "真宗大谷派", "日蓮宗", "高野山真言宗", "本門法華宗", "")


@query(f"""SELECT s_suppkey, ([ '浄土真宗', '浄土真宗', '日蓮宗', NULL, '日蓮宗', NULL ])[1 + s_suppkey % 6] AS denomination, (['no', 'no', 'unknown', NULL, 'unknown', NULL])[1 + s_suppkey % 6] AS goshuin_default FROM supplier""")
def denominations_of_suppliers(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", etiquette.denomination_rule(F.concat(F.col("s_name"), pick(SECTS, F.col("s_suppkey") % 6))).alias("r"))
    return rows.select("s_suppkey", "r.denomination", "r.goshuin_default")


# ── Files ──


@query("SELECT p_name || ' ' || CAST(p_partkey AS VARCHAR) AS title, p_brand || ' & <b>' || p_type || '</b> é' AS text, CAST(strlen(p_brand || ' & <b>' || p_type || '</b> é') AS BIGINT) AS bytes FROM part WHERE p_partkey % 2 = 0")
def xml_dump_of_parts(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    title = F.concat(F.col("p_name"), F.lit(" "), F.col("p_partkey").cast("string"))
    body = F.concat(F.col("p_brand"), F.lit(" &amp; &lt;b&gt;"), F.col("p_type"), F.lit("&lt;/b&gt; é"))
    page = F.concat(F.lit("<page><title>"), title, F.lit("</title><ns>0</ns><revision><id>1</id><text>"), body, F.lit("</text></revision></page>"))
    files = part.groupBy(F.floor(F.col("p_partkey") / 1000)).agg(F.collect_list(page).alias("pages"))  # a thousand pages to a file
    path = fresh_folder(spark, "xml")
    whole = F.concat(F.lit("<mediawiki>\n"), F.array_join("pages", "\n"), F.lit("\n</mediawiki>"))
    files.select(whole.alias("value")).write.option("compression", "bzip2").option("maxRecordsPerFile", 1).text(path)
    return dumps.xml_pages(spark, path, part.where("p_partkey % 2 = 0").select(title.alias("title")))


@query("""WITH e AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), m AS (SELECT unnest([1, 2]) AS month)
SELECT event_type || ' ' || CAST(user_id AS VARCHAR) AS title, CAST(2025 AS INTEGER) AS year, CAST(month AS INTEGER) AS month, CAST(n * month AS DOUBLE) AS views FROM e, m WHERE user_id % 3 = 0 AND event_type <> 'error'""")
def months_of_dumps(spark, sf_dir):
    counts = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    user = F.col("user_id").cast("string")
    found = []
    for month in (1, 2):
        path = fresh_folder(spark, f"views-{month}")
        line = F.concat_ws(" ", F.lit("ja.wikipedia"), F.concat("event_type", F.lit("_"), user), user, F.when(F.col("event_type") == "error", "spider").otherwise("user"), (F.col("n") * month).cast("string"), F.lit("A1"))
        counts.select(line.alias("value")).write.option("compression", "bzip2").text(path)
        found.append((path, 2025, month))
    titles = counts.where("user_id % 3 = 0").select(F.concat("event_type", F.lit(" "), user).alias("title"))
    return dumps.accumulate_months(spark, found, titles)


@query("SELECT DISTINCT p_name AS title FROM part WHERE p_size % 2 = 0")
def titles_of_parts(spark, sf_dir):
    path = fresh_folder(spark, "titles")
    names = read(spark, sf_dir, "part").select(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("　"), F.col("p_name"), F.lit(" \t"))).when(F.col("p_size") % 3 == 0, F.concat(F.lit(" # "), F.col("p_name"))).otherwise("  ").alias("value"))
    names.write.text(path)
    return dumps.title_list(spark, path).distinct()


@query("SELECT CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INTEGER) AS line_no, s_name AS line FROM supplier")
def volumes_of_suppliers(spark, sf_dir):
    path = fresh_folder(spark, "volumes")
    whole = read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda x: x["s_name"]), "\r\n").alias("value"))  # a file a nation
    whole.select("value").write.option("maxRecordsPerFile", 1).option("lineSep", "\u0001").text(path)
    return dumps.volumes(spark, [path]).select("line_no", F.replace("line", F.lit("\u0001"), F.lit("")).alias("line"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, s_acctbal AS lat FROM supplier")
def sites_of_suppliers(spark, sf_dir):
    path = fresh_folder(spark, "sites")
    site = F.struct(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("lat"))
    by_nation = read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.collect_list(site).alias("sites"))  # a file a nation, an array or an object in turn
    body = F.when(F.col("s_nationkey") % 2 == 0, F.to_json("sites")).otherwise(F.to_json(F.struct("sites")))
    by_nation.select(body.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    fields = T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("lat", T.DoubleType())])
    return dumps.sites_json(spark, path, fields)


@query("""SELECT o_orderpriority AS title, 'x' AS kind, true AS found FROM orders GROUP BY 1 UNION ALL SELECT p_brand, 'x', false FROM part GROUP BY 1""")
def manifest_of_pages(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("title")).agg(F.count(F.lit(1)).cast("string").alias("text"))
    pages = orders.withColumn("bytes", F.octet_length("text").cast("long"))
    wanted = pages.select("title").unionByName(read(spark, sf_dir, "part").select(F.col("p_brand").alias("title")).distinct())
    path = fresh_folder(spark, "pages")
    dumps.write_pages(pages, path, wanted)
    return spark.read.json(f"{path}/manifest").select("title", F.lit("x").alias("kind"), "found")


# ── Master data and gaps ──


@query("""SELECT n_name AS cluster, 'b' || CAST(n_regionkey AS VARCHAR) AS benefit, 'primary' AS weight, CASE WHEN n_nationkey % 6 = 0 THEN 'NO_AUTO_MAPPING' END AS policy FROM nation
UNION ALL SELECT n_name, 'b9', 'secondary', CASE WHEN n_nationkey % 6 = 0 THEN 'NO_AUTO_MAPPING' END FROM nation WHERE n_nationkey % 2 = 0""")
def mappings_of_nations(spark, sf_dir):
    rows = read(spark, sf_dir, "nation").collect()  # 25 nations, as a master file
    lines = ["mappings:"]
    for r in rows:
        lines += [f'  - cluster: "{r["n_name"]}"', f"    primary: [b{r['n_regionkey']}]", *(["    secondary: [b9]"] if r["n_nationkey"] % 2 == 0 else []), *(["    policy: NO_AUTO_MAPPING"] if r["n_nationkey"] % 6 == 0 else [])]
    raw = {name: "" for name in masters.FILES} | {"cluster_benefits": "\n".join(lines)}
    return masters.mapping(masters.tables(spark, masters.parse(raw))).select("cluster", "benefit", "weight", "policy")


GAP_REGIONS = ", ".join(f"({i}, '{name}', {a}, {b})" for i, (name, a, b) in enumerate(gaps.REGIONS))
GAP_MAJORS = ", ".join(f"({i}, '{m}')" for i, m in enumerate(gaps.MAJORS))


GAP_SQL = f"""r(i, name, a, b) AS (VALUES {GAP_REGIONS}), m(j, major) AS (VALUES {GAP_MAJORS}),
c AS (SELECT c_custkey AS id, 1 + c_custkey % 60 AS p, 'x' AS major FROM customer WHERE c_custkey % 60 < 10),
g AS (SELECT 0 AS o0, i AS o1, p AS o2, 0 AS o3, 'geography' AS kind, '都道府県コード ' || lpad(CAST(p AS VARCHAR), 2, '0') || ' の収録が ' || CAST((SELECT count(*) FROM c WHERE c.p = x.p) AS VARCHAR) || ' 件しかありません。' AS description
  FROM (SELECT i, unnest(range(a, b + 1)) AS p FROM r) x WHERE (SELECT count(*) FROM c WHERE c.p = x.p) < 3
UNION ALL SELECT 1, i, 0, j, 'benefit', name || 'に「' || major || '」の社寺が 0 件しかありません。' FROM r, m
UNION ALL SELECT 1, i, 1, 0, 'access', name || 'に「車なしで行ける」社寺が 0 件しかありません。' FROM r
UNION ALL SELECT 1, i, 2, 0, 'goshuin', name || 'に御朱印を授与している社寺が 0 件しかありません。' FROM r)"""


def few_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = lambda kind: F.lit(None).cast(kind)
    sites = read(spark, sf_dir, "customer").where("c_custkey % 60 < 10").select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_custkey").cast("int").alias("pos"), F.col("c_mktsegment").alias("name"), F.lpad((1 + F.col("c_custkey") % 60).cast("string"), 2, "0").alias("prefecture_code"),
        F.array().cast("array<struct<major_id:string,weight:string>>").alias("benefits"), none("string").alias("access_mode"), none("string").alias("goshuin_available"), none("string").alias("etiquette_source_type"),
    )
    return gaps.detect(sites)


@query(f"WITH {GAP_SQL} SELECT CAST(row_number() OVER (ORDER BY o0, o1, o2, o3) AS INTEGER) AS nth, kind, description FROM g")
def gap_order(spark, sf_dir):
    from pyspark.sql import Window

    return few_places(spark, sf_dir).select(F.row_number().over(Window.orderBy("ord")).alias("nth"), "kind", "description")  # over the gaps alone, a grid of some hundreds at most


@query(f"""WITH {GAP_SQL}, k(n, kind, label) AS (VALUES (0, 'geography', '地理の穴'), (1, 'benefit', '御利益の穴'), (2, 'access', 'アクセスの穴'), (3, 'goshuin', '御朱印の穴')),
s AS (SELECT n, kind, label, count(*) AS c FROM g JOIN k USING (kind) GROUP BY ALL),
t AS (SELECT -1 AS n, unnest(range(7)) AS o0, 0 AS o1, 0 AS o2, 0 AS o3, unnest(['# 穴の検出結果 2026-09-01', '', '検出した穴: **' || (SELECT count(*) FROM g) || ' 件**', '', 'この一覧が、そのまま次の収録キューになります。', '', NULL]) AS line
UNION ALL SELECT n, -2, 0, 0, 0, '## ' || label || '（' || c || '件）' FROM s UNION ALL SELECT n, -1, 0, 0, 0, '' FROM s
UNION ALL SELECT n, o0, o1, o2, o3, '- ' || description FROM g JOIN k USING (kind) UNION ALL SELECT n, 9, 0, 0, 0, '' FROM s)
SELECT CAST(row_number() OVER (ORDER BY n, o0, o1, o2, o3) - 1 AS INTEGER) AS nth, line FROM t WHERE line IS NOT NULL""")
def gap_report(spark, sf_dir):
    return gaps.report(few_places(spark, sf_dir), "2026-09-01")
