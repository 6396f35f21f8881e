"""What pages, files and reports say, over whole benchmark tables; each row becomes parts that the SQL puts together on its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from keidai.functions import geo, text
from keidai.operators import access, benefits, display, gaps, identity, priority, registry, wikitext
from keidai.plans.network_queries import MASTER_SQL, master_tables
from keidai.plans.table_queries import SCORE_SQL, priority_inputs, read
from keidai.plans.text_queries import LINES_SQL, order_lines, pick
from keidai.sources import dumps, masters, samples
from keidai.sources.shared import fresh_folder, kept
from keidai.streaming import pageviews

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def word(column, *around: str):
    """A number as text, between other texts."""
    before, after = (*around, "", "")[:2]
    return F.concat(F.lit(before), column.cast("string"), F.lit(after))


# ── Texts and files ──


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand || p_name || '。' || chr(10) || chr(10) || '次' ELSE p_name || chr(10) || '終' END AS body,
CASE WHEN p_partkey % 2 = 0 THEN p_brand || p_name || '。' || chr(10) || '{{header}}' || repeat(chr(10), 4) || '次[[Category:' || p_type || ']]' ELSE p_name || chr(10) || '終' END AS noted FROM part""")
def bodies_of_parts(spark, sf_dir):
    even = F.concat(F.lit("{{另　|"), F.col("p_brand"), F.lit("|敷/敦}}"), F.col("p_name"), F.lit("<ref>注</ref>。<!-- x -->  \n{{header}}\n\n\n\n次[[Category:"), F.col("p_type"), F.lit("]]"))
    odd = F.concat(F.lit("{{page|12}}"), F.col("p_name"), F.lit("<ref name=a/> \n終"))
    raw = F.when(F.col("p_partkey") % 2 == 0, even).otherwise(odd)
    return read(spark, sf_dir, "part").select("p_partkey", text.body_text(raw).alias("body"), text.strip_source_notes(raw).alias("noted"))


@query("SELECT p_partkey, p_name || '_' || p_brand || '_' || p_type || '_x_' AS file FROM part")
def files_of_parts(spark, sf_dir):
    title = F.concat(F.col("p_name"), F.lit("/"), F.col("p_brand"), F.lit("\\"), F.col("p_type"), F.lit('"x?'))
    return read(spark, sf_dir, "part").select("p_partkey", text.file_name(title).alias("file"))


@query("""SELECT p_partkey, 'https://wikimedia.org/api/rest_v1/metrics/pageviews/per-article/ja.wikipedia/all-access/user/' || replace(p_name, ' ', '_') || '_' || replace(p_brand, '#', '%23') || '_(' || p_type || ')!/monthly/'
|| (2020 + p_size % 5) || lpad(CAST(1 + p_size % 12 AS VARCHAR), 2, '0') || '0100/2026120100' AS url FROM part""")
def urls_of_parts(spark, sf_dir):
    title = F.concat(F.col("p_name"), F.lit(" "), F.col("p_brand"), F.lit(" ("), F.col("p_type"), F.lit(")!"))
    m = dumps.month_range((2020 + F.col("p_size") % 5).cast("int"), (1 + F.col("p_size") % 12).cast("int"), F.lit(2026), F.lit(12))
    return read(spark, sf_dir, "part").withColumn("m", m).select("p_partkey", dumps.pageview_url(title, F.col("m.start"), F.col("m.end")).alias("url"))


@query("""SELECT p_partkey, CAST(2026 AS INTEGER) AS year, CAST(m AS INTEGER) AS month, CAST(p_size * 100 + m AS BIGINT) AS views FROM part, (SELECT unnest([1, 2, 12]) AS m) WHERE p_partkey % 7 <> 0""")
def answers_of_parts(spark, sf_dir):
    items = F.array(*[F.struct(F.lit(f"2026{m:02d}0100").alias("timestamp"), (F.col("p_size") * 100 + m).cast("long").alias("views")) for m in (1, 2, 12)])
    body = F.when(F.col("p_partkey") % 14 == 0, "no answer").when(F.col("p_partkey") % 7 == 0, '{"items":[]}').otherwise(F.to_json(F.struct(items.alias("items"))))
    return read(spark, sf_dir, "part").select("p_partkey", F.inline(dumps.parse_pageview_response(body)))


@query("""WITH e AS (SELECT user_id, event_type, 2020 + user_id % 5 AS year, 1 + user_id % 12 AS month, count(*) AS n FROM events GROUP BY ALL)
SELECT event_type || ' ' || CAST(user_id AS VARCHAR) AS title, CAST(year AS INTEGER) AS year, CAST(month AS INTEGER) AS month, CAST(n AS DOUBLE) AS views FROM e WHERE event_type <> 'error'""")
def streamed_dumps(spark, sf_dir):
    """Dumps, each a folder of files, ingested by a stream that is started twice: each file counts once."""
    user = F.col("user_id").cast("string")
    counts = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    line = F.concat_ws(" ", F.lit("ja.wikipedia"), F.concat("event_type", F.lit("_"), user), user, F.when(F.col("event_type") == "error", "spider").otherwise("user"), F.col("n").cast("string"), F.lit("A1"))
    source, target, state = (fresh_folder(spark, f"stream-{x}") for x in ("in", "out", "state"))
    stamp = F.format_string("pageviews-%d%02d", (2020 + F.col("user_id") % 5).cast("int"), (1 + F.col("user_id") % 12).cast("int"))
    counts.select(stamp.alias("dump"), line.alias("value")).write.partitionBy("dump").text(source)
    for _ in range(2):
        pageviews.ingest(spark, source, target, state)
    return spark.read.parquet(target).select("title", F.col("year").cast("int"), F.col("month").cast("int"), "views")


@query(f"""WITH {LINES_SQL} SELECT volume, line_no, shrine_name, '『延喜式』神名帳に、' || CASE WHEN province <> '' THEN province || district || 'の' ELSE '' END || '「' || CASE r WHEN 'tai' THEN '大社' WHEN 'sho' THEN '小社' WHEN 'myojin_tai' THEN '名神大社' ELSE shrine_name END
|| '」として記載されている。' || CASE WHEN kanpei OR tsukinami OR niiname OR ainame THEN concat_ws('・', CASE WHEN kanpei THEN '案上官幣' END, CASE WHEN tsukinami THEN '月次祭' END, CASE WHEN niiname THEN '新嘗祭' END, CASE WHEN ainame THEN '相嘗祭' END) || 'に預かる。' ELSE '' END
|| CASE WHEN seats > 1 THEN CAST(seats AS VARCHAR) || '座。' ELSE '' END AS description, (SELECT count(*) FROM orders WHERE o_orderkey % 20 = 3) AS n_unparsed FROM s""")
def written_registry(spark, sf_dir):
    """The registry's files, read again."""
    lines, path = order_lines(spark, sf_dir), fresh_folder(spark, "registry")
    found = registry.shrines(lines)
    dumps.write_registry(found, registry.classified(lines).where("kind = 'unparsed'").select("volume", "line_no", "line"), registry.quality(found), path)
    n = spark.read.json(f"{path}/unparsed").agg(F.count(F.lit(1)).alias("n_unparsed"))
    return spark.read.json(f"{path}/shrines").select("volume", "line_no", "shrine_name", "description").crossJoin(F.broadcast(n))  # one row


@query(f"WITH {SCORE_SQL} SELECT site_id, score, '2001-10' AS month FROM s")
def written_priorities(spark, sf_dir):
    """The priorities' files, read again with the month that their note leaves out."""
    path = fresh_folder(spark, "priorities")
    dumps.write_priorities(priority.score(priority_inputs(spark, sf_dir)).select("site_id", "score"), path, 2001, 10)
    meta = spark.read.json(f"{path}/meta").select(F.col("excludedCurrentMonth").alias("month"))
    return spark.read.json(f"{path}/priorities").crossJoin(F.broadcast(meta))  # one row


# ── What a page shows ──


@query("""SELECT p_partkey, '「' || CASE WHEN p_partkey % 4 = 0 THEN 'b' || p_partkey ELSE p_name END || '」— ' || CASE WHEN p_partkey % 3 = 0 THEN 'この社寺の公式情報に記載があります。' WHEN p_partkey % 3 = 1 AND p_partkey % 5 <> 0 THEN p_brand || 'をお祀りしているため（祭神・本尊にもとづく推定）。'
ELSE '分類の根拠を確認できていません。' END AS sentence, CASE p_partkey % 3 WHEN 0 THEN '公式サイト記載' WHEN 1 THEN '祭神・本尊からの推定' ELSE '未確認' END AS badge,
CASE WHEN p_partkey % 6 = 0 THEN 'この社寺のご利益は、祭神・本尊からは特定できていません。文化財指定・札所・御朱印の情報をご覧ください。' END AS notice FROM part""")
def explanations_of_parts(spark, sf_dir):
    k = F.col("p_partkey")
    confidence = pick(("official", "derived", "unknown"), k % 3)
    ids = lambda n: F.when(k % n == 0, F.array().cast("array<string>")).otherwise(F.array(word(k, "b")))
    sentence = benefits.explain(word(k, "b"), F.when(k % 4 != 0, F.col("p_name")), confidence, F.when(k % 10 == 0, "").when(k % 5 != 0, F.col("p_brand")))
    return read(spark, sf_dir, "part").select("p_partkey", sentence.alias("sentence"), benefits.confidence_badge(confidence).alias("badge"), benefits.benefit_notice(ids(2), ids(3)).alias("notice"))


@query("""WITH p AS (SELECT c_custkey AS k, unnest([0, 1, 2]) AS i FROM customer), q AS (SELECT k, i, (k + i) % 90 AS a, (k * 3 + i) % 180 AS b FROM p),
t AS (SELECT k, i, CAST(a // 2 AS VARCHAR) || CASE WHEN a % 2 = 1 THEN '.5' ELSE '' END AS lat, CAST(b // 4 AS VARCHAR) || CASE b % 4 WHEN 1 THEN '.25' WHEN 2 THEN '.5' WHEN 3 THEN '.75' ELSE '' END AS lng FROM q),
w AS (SELECT k, max(lat) FILTER (WHERE i = 0) AS a0, max(lng) FILTER (WHERE i = 0) AS b0, max(lat) FILTER (WHERE i = 1) AS a1, max(lng) FILTER (WHERE i = 1) AS b1, max(lat) FILTER (WHERE i = 2) AS a2, max(lng) FILTER (WHERE i = 2) AS b2 FROM t GROUP BY k)
SELECT k AS c_custkey, 'https://www.google.com/maps/search/?api=1&query=' || a0 || ',' || b0 AS map, 'https://www.google.com/maps/dir/?api=1&destination=' || a0 || ',' || b0 || '&travelmode=transit' AS directions,
CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN 'https://www.google.com/maps/dir/?api=1&origin=' || a0 || '%2C' || b0 || '&destination=' || a1 || '%2C' || b1 || '&travelmode=transit'
WHEN 2 THEN 'https://www.google.com/maps/dir/?api=1&origin=' || a0 || '%2C' || b0 || '&destination=' || a2 || '%2C' || b2 || '&travelmode=transit&waypoints=' || a1 || '%2C' || b1
ELSE NULL END AS course FROM w""")
def links_of_customers(spark, sf_dir):
    """Courses of one, two, three and twelve points."""
    k = F.col("c_custkey")
    point = lambda i: F.struct(((k + i) % 90 / 2.0).alias("lat"), ((k * 3 + i) % 180 / 4.0).alias("lng"))
    points = F.transform(F.sequence(F.lit(0), pick((0, 1, 2, 11), k % 4)), lambda i: F.struct(((k + i) % 90 / 2.0).alias("lat"), ((k * 3 + i) % 180 / 4.0).alias("lng")))
    first = point(F.lit(0))
    return read(spark, sf_dir, "customer").select("c_custkey", display.map_url(first["lat"], first["lng"]).alias("map"), display.directions_url(first["lat"], first["lng"]).alias("directions"), display.course_url(points).alias("course"))


@query("""SELECT o_orderkey AS site_id, o_orderpriority || CASE WHEN o_orderkey % 4 <> 0 THEN ' 第' || (o_orderkey % 88) || '番' ELSE '' END || CASE WHEN o_orderpriority LIKE '%M%' THEN '（諸説あり）' ELSE '' END AS shown FROM orders WHERE o_orderpriority NOT LIKE '1%'""")
def groups_of_orders(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    members = orders.select(F.col("o_orderkey").alias("site_id"), F.col("o_orderpriority").alias("group_id"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") % 88).alias("order_no"))
    groups = orders.where("o_orderpriority NOT LIKE '1%'").select(F.col("o_orderpriority").alias("group_id")).distinct().select("group_id", F.col("group_id").alias("name"), F.col("group_id").contains("M").alias("disputed"))
    return display.group_names(members, groups).select("site_id", "shown")


@query("""WITH s AS (SELECT s_suppkey AS k, CASE s_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'yes' WHEN 2 THEN 'no' WHEN 3 THEN 'unknown' ELSE 'yes' END AS a, s_suppkey % 2 = 0 AS hours, s_suppkey % 3 = 0 AS lunch, s_suppkey % 7 = 0 AS unmanned, s_suppkey % 11 = 0 AS mail,
  (s_suppkey % 4) * 100 AS fee, s_suppkey % 6 = 0 AS said, s_suppkey % 13 = 0 AS limited FROM supplier)
SELECT k AS site_id, CASE a WHEN 'yes' THEN '御朱印の授与があります' WHEN 'no' THEN '御朱印の授与はありません' WHEN 'unknown' THEN '御朱印の有無は確認できていません' ELSE '御朱印の情報はまだ調べていません。' END AS title,
CASE WHEN a = 'yes' THEN concat_ws('|', CASE WHEN hours THEN '受付時間=09:00〜16:00' END, CASE WHEN lunch THEN '昼休み=12:00〜13:00' END, '書き方=' || ['直書き', '書き置きのみ', '直書き・書き置きの両方', '時期による（繁忙期は書き置き）', '不明'][1 + k % 5], CASE WHEN fee > 0 THEN '初穂料=' || fee || '円' END,
  CASE WHEN unmanned THEN '授与所=無人（不在の場合があります）' END, CASE WHEN mail THEN '郵送=対応あり' END) ELSE '' END AS shown,
CASE a WHEN 'yes' THEN concat_ws('|', CASE WHEN hours THEN '※参拝時間と御朱印の受付時間は別です。御朱印のほうが早く終わることがあります。' END, CASE WHEN limited THEN '限定' || k END, CASE WHEN said THEN '宗派' || k END) WHEN 'no' THEN CASE WHEN said THEN '宗派' || k ELSE '' END
WHEN 'unknown' THEN concat_ws('|', CASE WHEN said THEN '宗派' || k END, '無人の社寺では授与所が無く、いただけない場合があります。') ELSE '' END AS notes FROM s""")
def stamps_of_suppliers(spark, sf_dir):
    k = F.col("s_suppkey")
    span = lambda a, b: F.struct(F.lit(a).alias("from"), F.lit(b).alias("to"))
    stamp = F.struct(
        pick(("", "yes", "no", "unknown", "yes"), k % 5).alias("available"), F.when(k % 2 == 0, span("09:00", "16:00")).alias("hours"), F.when(k % 3 == 0, span("12:00", "13:00")).alias("lunch_break"),
        pick(("direct", "paper", "both", "seasonal", "unknown"), k % 5).alias("write_style"), F.when(k % 4 > 0, (k % 4 * 100).cast("double")).alias("fee"), (k % 7 == 0).alias("unmanned"), F.when(k % 11 == 0, "yes").otherwise("no").alias("mail_order"),
        F.when(k % 13 == 0, word(k, "限定")).otherwise("").alias("limited_note"), F.when(k % 6 == 0, word(k, "宗派")).alias("denomination_note"),
    )
    out = display.goshuin_panel(read(spark, sf_dir, "supplier").select(k.alias("site_id"), F.when(k % 5 > 0, stamp).alias("goshuin")))
    return out.select("site_id", "title", F.array_join(F.transform("rows", lambda r: F.concat_ws("=", r["name"], r["value"])), "|").alias("shown"), F.array_join("notes", "|").alias("notes"))


@query("""WITH d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'いつか' WHEN o_orderkey % 9 <> 1 THEN strftime(o_orderdate, '%Y-%m-%d') END AS d, greatest(0, (1998 - year(o_orderdate)) * 12 + 9 - month(o_orderdate)) AS m FROM orders)
SELECT o_orderkey, d || ' 時点の情報' || CASE WHEN m >= 6 AND d <> 'いつか' THEN '（' || m || 'ヶ月前。変更されている可能性があります）' ELSE '' END AS shown FROM d""")
def verified_of_orders(spark, sf_dir):
    k = F.col("o_orderkey")
    date = F.when(k % 9 == 0, "いつか").when(k % 9 != 1, F.date_format("o_orderdate", "yyyy-MM-dd"))
    return read(spark, sf_dir, "orders").select("o_orderkey", display.verified_note(date, F.to_date(F.lit("1998-09-01"))).alias("shown"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ['一次史料', '読み下し・現代語', '近代の記録', NULL][1 + l_linenumber % 4] AS badge,
['（原文はパブリックドメイン）', '（CC BY-SA 4.0）', '（原文はPD／注は CC BY-SA 4.0）', ''][1 + l_partkey % 4] || CASE WHEN l_returnflag = 'R' THEN '※OCRテキストのため誤りを含む場合があります' ELSE '' END AS note FROM lineitem WHERE l_linestatus = 'F'""")
def badges_of_lines(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").withColumn("source_url", F.when(F.col("l_linestatus") == "F", "http://s").when(F.col("l_linenumber") % 2 == 0, ""))
    rights, ocr = pick(("PD", "CC-BY-SA-4.0", "PD+CC-BY-SA-4.0", "?"), F.col("l_partkey") % 4), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "R")
    return display.lore(rows).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", display.layer_badge((1 + F.col("l_linenumber") % 4).cast("int")).alias("badge"), display.rights_note(rights, ocr).alias("note"))


@query("""SELECT c_custkey, CASE WHEN 12 + c_custkey % 5 <= 14 THEN 'dem5a,dem5b,dem5c,dem' WHEN 12 + c_custkey % 5 = 15 THEN 'dem5a,dem5b,dem5c' ELSE '' END AS layers,
'https://cyberjapandata.gsi.go.jp/xyz/dem5a_png/' || (12 + c_custkey % 5) || '/' || c_custkey || '/' || c_nationkey || '.png' AS url FROM customer""")
def layers_of_customers(spark, sf_dir):
    z = (12 + F.col("c_custkey") % 5).cast("int")
    return read(spark, sf_dir, "customer").select("c_custkey", F.array_join(geo.layers_for_zoom(z), ",").alias("layers"), geo.tile_url(F.lit("dem5a"), z, F.col("c_custkey"), F.col("c_nationkey")).alias("url"))


@query("""WITH a AS (SELECT o_orderkey AS k, ['TRAIN_ONLY', 'TRAIN_BUS', 'CAR_RECOMMENDED', 'CAR_ONLY', 'UNKNOWN', NULL][1 + o_orderkey % 6] AS mode, ['EASY', 'MODERATE', 'HARD', NULL][1 + o_custkey % 4] AS load, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey % 90 END AS m, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey % 150 END AS up, o_custkey % 60 AS around FROM orders)
SELECT k AS site_id, concat_ws(' / ', CASE WHEN m IS NOT NULL THEN '徒歩' || m || '分' END, CASE WHEN up IS NOT NULL THEN '登り' || up || 'm' END) AS walk, CASE WHEN mode IS NULL THEN '未調査' WHEN mode IN ('TRAIN_ONLY', 'TRAIN_BUS') THEN '車なしで行ける' ELSE '車が必要' END AS car_free,
(CASE WHEN mode = 'UNKNOWN' THEN 1 ELSE 0 END) + (CASE WHEN load = 'HARD' THEN 1 ELSE 0 END) + (CASE WHEN around >= 30 THEN 1 ELSE 0 END) AS n_notes, CASE WHEN around >= 30 THEN '周辺より約' || around || 'm 高い場所にあります。' END AS above FROM a""")
def access_badges_of_orders(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    mode = F.when(k % 6 < 5, pick(("TRAIN_ONLY", "TRAIN_BUS", "CAR_RECOMMENDED", "CAR_ONLY", "UNKNOWN"), k % 6))
    load = F.when(c % 4 < 3, pick(("EASY", "MODERATE", "HARD"), c % 4))
    b = access.badge(mode, load, F.when(k % 5 != 0, (c % 90).cast("int")), F.when(k % 7 != 0, (c % 150).cast("double")), (c % 60).cast("double"))
    rows = read(spark, sf_dir, "orders").select(k.alias("site_id"), b.alias("b"), access.car_free_label(mode).alias("car_free"))
    return rows.select("site_id", "b.walk", "car_free", F.size("b.notes").alias("n_notes"), F.get(F.filter("b.notes", lambda n: n.startswith("周辺より")), F.lit(0)).alias("above"))


# ── Gaps, constraints and reports ──


@query("""WITH m AS (SELECT o_orderpriority AS g, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1), c AS (SELECT g, n, n + CASE WHEN g LIKE '%M%' THEN 0 ELSE 5 END AS total FROM m),
w AS (SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 3 = 0)
SELECT 'pilgrimage' AS kind, g || ' が ' || n || '/' || total || ' 件しか収録されていません。めぐりコース機能が成立しません。' AS description, n AS count, CAST(total AS BIGINT) AS expected FROM c WHERE n < total
UNION ALL SELECT 'etiquette', '参拝作法が未確認（PENDING_VERIFICATION）の社寺が ' || (SELECT count(*) FROM w) || ' 件あります: ' || (SELECT string_agg(s_name, '、' ORDER BY s_suppkey) FROM (SELECT * FROM w ORDER BY s_suppkey LIMIT 10)), 0, (SELECT count(*) FROM w)""")
def coverage_gaps(spark, sf_dir):
    none, k = lambda kind: F.lit(None).cast(kind), F.col("s_suppkey")
    sites = read(spark, sf_dir, "supplier").select(
        k.cast("string").alias("id"), k.cast("int").alias("pos"), F.col("s_name").alias("name"), F.lit("13").alias("prefecture_code"), none("array<struct<major_id:string,weight:string>>").alias("benefits"), none("string").alias("access_mode"),
        none("string").alias("goshuin_available"), F.when(k % 3 == 0, "pending").otherwise("default").alias("etiquette_source_type"),
    )
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("group_id"), F.col("o_custkey").alias("site_id"))
    totals = orders.groupBy("group_id").agg((F.count_distinct("site_id") + F.when(F.col("group_id").contains("M"), 0).otherwise(5)).cast("int").alias("total_count")).withColumn("name", F.col("group_id"))
    found = gaps.detect(sites, covered=gaps.coverage(totals, orders))
    return found.where("kind IN ('pilgrimage', 'etiquette')").select("kind", "description", "count", "expected")


@query("""WITH s AS (SELECT 1 + c_custkey % 47 AS p FROM customer WHERE c_custkey % 5 = 0), n AS (SELECT p, count(*) AS n FROM s GROUP BY 1)
SELECT 'geography' AS kind, 47 - (SELECT count(*) FROM n WHERE n >= 3) AS n WHERE 47 > (SELECT count(*) FROM n WHERE n >= 3) UNION ALL SELECT 'benefit', 80 UNION ALL SELECT 'access', 8 UNION ALL SELECT 'goshuin', 8""")
def gap_counts(spark, sf_dir):
    none, k = lambda kind: F.lit(None).cast(kind), F.col("c_custkey")
    sites = read(spark, sf_dir, "customer").where(k % 5 == 0).select(
        k.cast("string").alias("id"), k.cast("int").alias("pos"), F.col("c_name").alias("name"), F.lpad((1 + k % 47).cast("string"), 2, "0").alias("prefecture_code"), none("array<struct<major_id:string,weight:string>>").alias("benefits"), none("string").alias("access_mode"),
        none("string").alias("goshuin_available"), none("string").alias("etiquette_source_type"),
    )
    return gaps.by_kind(gaps.detect(sites))


@query("""WITH s AS (SELECT s_suppkey % 5 AS t, s_suppkey % 7 AS n, s_suppkey % 3 AS g FROM supplier)
SELECT * FROM (VALUES ('type IN (''shrine'', ''temple'')', (SELECT count(*) FROM s WHERE t = 2)), ('name IS NOT NULL', (SELECT count(*) FROM s WHERE n = 0)), ('type IS NOT NULL', (SELECT count(*) FROM s WHERE t = 3)), ('prefecture_code IS NOT NULL', 0), ('lat IS NOT NULL', (SELECT count(*) FROM s WHERE g = 1)),
('lng IS NOT NULL', 0), ('ranks IS NOT NULL', 0), ('updated_at IS NOT NULL', (SELECT count(*) FROM s WHERE t = 4 AND n = 3))) AS v(condition, n)""")
def site_constraints(spark, sf_dir):
    k = F.col("s_suppkey")
    sites = read(spark, sf_dir, "supplier").select(
        k.alias("id"), F.when(k % 7 != 0, F.col("s_name")).alias("name"), F.when(k % 5 < 2, "shrine").when(k % 5 == 2, "other").when(k % 5 == 4, "temple").alias("type"), F.lit("01").alias("prefecture_code"), F.when(k % 3 != 1, 35.0).alias("lat"), F.lit(135.0).alias("lng"),
        F.array().cast("array<string>").alias("ranks"), F.when(~((k % 5 == 4) & (k % 7 == 3)), "2026").alias("updated_at"),
    )
    return masters.violations(sites, "site")


@query("""WITH p AS (SELECT o_orderkey // 2 AS id FROM orders WHERE o_orderkey % 5 <> 4), f AS (SELECT l_orderkey AS site_id, l_partkey AS benefit_id FROM lineitem)
SELECT 'site' AS name, 'id' AS key, 'primary' AS kind, (SELECT count(*) FROM (SELECT id FROM p GROUP BY 1 HAVING count(*) > 1)) AS n UNION ALL SELECT 'site_benefit', 'site_id, benefit_id', 'primary', n FROM (SELECT count(*) AS n FROM (SELECT 1 FROM f GROUP BY site_id, benefit_id HAVING count(*) > 1)) WHERE n > 0
UNION ALL SELECT 'site_benefit', 'site_id', 'foreign', (SELECT count(*) FROM f WHERE site_id NOT IN (SELECT id FROM p)) UNION ALL SELECT 'site_benefit', 'benefit_id', 'foreign', (SELECT count(*) FROM f WHERE benefit_id NOT IN (SELECT p_partkey FROM part WHERE p_size < 40))""")
def key_constraints(spark, sf_dir):
    t = {
        "site": read(spark, sf_dir, "orders").where("o_orderkey % 5 <> 4").select(F.floor(F.col("o_orderkey") / 2).alias("id")),
        "benefit": read(spark, sf_dir, "part").where("p_size < 40").select(F.col("p_partkey").alias("id")),
        "site_benefit": read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("site_id"), F.col("l_partkey").alias("benefit_id")),
    }
    return masters.key_violations(t)


@query(f"""WITH {MASTER_SQL} SELECT 0 AS part, '' AS rule, '' AS message, 'errors: ' || count(*) FILTER (WHERE severity = 'error') || ', warnings: ' || count(*) FILTER (WHERE severity <> 'error') AS line FROM i
UNION ALL SELECT CASE severity WHEN 'error' THEN 1 ELSE 2 END, rule, message, '[' || severity || '] ' || file || ': ' || message FROM i""")
def report_of_tables(spark, sf_dir):
    return masters.report(masters.validate(master_tables(spark, sf_dir)))


TITLES = tuple(dict.fromkeys(t for titles in dumps.CLASSICAL_TITLES.values() for t in titles))
TITLE_ROWS = ", ".join(f"({i}, '{t}')" for i, t in enumerate(TITLES))


@query(f"WITH t(i, title) AS (VALUES {TITLE_ROWS}) SELECT title, count(p_partkey) AS pages FROM t LEFT JOIN part ON p_partkey % 20 = i AND i % 5 <> 4 GROUP BY 1")
def classical_pages_of_parts(spark, sf_dir):
    """How many pages there are of each classical title, of works that share titles; titles without one have 0."""
    k = F.col("p_partkey") % 20
    pages = read(spark, sf_dir, "part").where((k < len(TITLES)) & (k % 5 != 4)).select(pick(TITLES, k).alias("title"))
    counts = pages.groupBy("title").agg(F.count(F.lit(1)).alias("n"))
    return dumps.classical_titles(spark).join(counts, "title", "left").select("title", F.coalesce("n", F.lit(0)).alias("pages"))


@query(f"""WITH e AS (SELECT 'V6' AS rule, '[cluster_benefits.yaml] クラスタ "' || n_name || '" が deity_clusters.yaml に存在しません' AS line FROM nation WHERE n_nationkey % 3 <> 0
UNION ALL SELECT 'V8', '[cluster_benefits.yaml] ' || n_name || '.primary の御利益ID "b' || n_regionkey || '" が benefits.yaml に存在しません' FROM nation WHERE n_nationkey % 3 <> 0
UNION ALL SELECT 'V3', '[benefits.yaml] 大分類が欠けています: {", ".join(gaps.MAJORS)}') SELECT rule, line FROM e""")
def load_errors_of_nations(spark, sf_dir):
    """What loading master files with errors raises: every error, with its file."""
    rows = read(spark, sf_dir, "nation").where("n_nationkey % 3 <> 0").orderBy("n_nationkey").collect()  # 25 nations at most, as a master file
    lines = ["mappings:", *[f'  - {{cluster: "{r["n_name"]}", primary: [b{r["n_regionkey"]}]}}' for r in rows]]
    try:
        masters.load(spark, {name: "" for name in masters.FILES} | {"cluster_benefits": "\n".join(lines)})
    except masters.MasterDataError as e:
        found = spark.createDataFrame([(line,) for line in str(e).split("\n")], "line string")
        rule = F.when(F.col("line").contains("クラスタ"), "V6").when(F.col("line").contains("御利益ID"), "V8").otherwise("V3")
        return found.select(rule.alias("rule"), "line")
    raise AssertionError("no error was raised")


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '乙訓坐大雷神社（サンプル）' WHEN 1 THEN '某建勲系神社（サンプル）' ELSE '某山中の寺（サンプル）' END AS name, CASE o_orderkey % 4 WHEN 0 THEN 'TRAIN_ONLY' WHEN 1 THEN 'UNKNOWN' ELSE 'CAR_ONLY' END AS access_mode,
CASE o_orderkey % 4 WHEN 0 THEN '長岡京駅' WHEN 1 THEN '大社前' ELSE '谷口' END AS stop, CAST(CASE o_orderkey % 4 WHEN 0 THEN 3 ELSE 0 END AS INTEGER) AS n_benefits, CAST(CASE o_orderkey % 4 WHEN 2 THEN 51 END AS INTEGER) AS order_no FROM orders WHERE o_orderkey % 4 < 3""")
def samples_of_orders(spark, sf_dir):
    """Orders that ask for a sample site; an id that none has is left out."""
    asked = read(spark, sf_dir, "orders").select("o_orderkey", pick(("sample-otokuni", "sample-kenkun", "sample-yamadera", "sample-none"), F.col("o_orderkey") % 4).alias("id"))
    sites = F.broadcast(samples.sample_sites(spark))  # three rows
    stop = F.coalesce("access.station.name", "access.bus.name")
    return asked.join(sites, "id").select("o_orderkey", "name", "access.access_mode", stop.alias("stop"), F.size("benefits").alias("n_benefits"), F.get("groups", F.lit(0))["order_no"].alias("order_no"))


# ── From infoboxes to a search ──


@query("""WITH p AS (SELECT p_partkey AS k, unnest([{'pos': 0, 'n': p_partkey % 30}, {'pos': 1, 'n': p_partkey * 7 % 25}]) AS d FROM part WHERE p_partkey % 9 <> 0),
r AS (SELECT k, d.pos AS pos, 'n' || d.n AS cluster, d.n AS n FROM p WHERE d.n < 25 AND d.n % 8 <> 7),
b AS (SELECT k, 'b' || (n % 6) AS b, 'm' || (n % 6 % 3) AS m FROM r),
o AS (SELECT p_partkey AS k, 'b' || (p_partkey % 10) AS b, 'm' || (p_partkey % 10 % 3) AS m FROM part WHERE p_partkey % 5 = 0),
f AS (SELECT DISTINCT k FROM (SELECT * FROM b UNION ALL SELECT * FROM o) WHERE m = 'm1')
SELECT k AS site_id, ['TRAIN_ONLY', 'TRAIN_BUS', 'CAR_ONLY', 'UNKNOWN'][1 + k % 4] AS access_mode, ['EASY', 'MODERATE', 'HARD'][1 + k % 3] AS walk_load, CAST([0, 1, 4, 3][1 + k % 4] AS INTEGER) AS mode_rank FROM f WHERE k % 4 < 2""")
def infobox_to_search(spark, sf_dir):
    """Pages of parts: deities of their infoboxes, resolved to nations as clusters, derived benefits, official ones over them, and the car-free sites of one major group."""
    k = F.col("p_partkey")
    name = lambda n, after: F.concat(F.lit("NATION_"), n.cast("string"), F.lit(after))
    entries = F.concat(name(k % 30, "大神"), F.lit("　<br　/>[["), name(k * 7 % 25, ""), F.lit("|"), F.lit("別名"), k.cast("string"), F.lit("]]"))
    body = F.when(k % 9 == 0, F.lit("{{神社|祭神={{wikidata|P825}}}}")).otherwise(F.concat(F.lit("{{神社\n|　祭神　= "), entries, F.lit("\n|社格=一宮}}")))
    part = read(spark, sf_dir, "part")
    pages = wikitext.shrine_info(part.select(k.alias("site_id"), body.alias("text")))
    # Outer, as a filter on empty arrays would be pushed down to where the file is read, and read every page twice and on one core.
    deities = pages.select("site_id", F.posexplode_outer("deities").alias("pos", "d")).where("pos IS NOT NULL").select("site_id", "pos", "d.display", "d.link_target", F.lit(None).cast("string").alias("qid"))
    n = F.col("n_nationkey")
    nation = read(spark, sf_dir, "nation")
    clusters = nation.select(n.cast("int").alias("ord"), word(n, "n").alias("id"), word(n, "NATION_", "命").alias("label"), F.array().cast("array<string>").alias("qids"), F.array().cast("array<string>").alias("aliases"))
    found = kept(identity.resolve_deities(deities, clusters), "deities")  # they are counted before they are dealt
    rule = lambda b, weight, rank: nation.select(word(n, "n").alias("cluster"), word(b, "b").alias("benefit"), F.lit(weight).alias("weight"), F.lit(rank).alias("weight_rank"), F.lit(0).alias("pos"), F.when(n % 8 == 7, "NO_AUTO_MAPPING").alias("policy"))
    mapping = rule(n % 6, "primary", 0).unionByName(rule(n % 4 + 6, "secondary", 1))
    taxonomy = spark.range(10).select(word(F.col("id"), "b").alias("benefit"), word(F.col("id") % 3, "m").alias("major"))
    lore = part.where(k % 5 == 0).select(k.alias("site_id"), F.lit(0).alias("pos"), word(k % 10, "b").alias("benefit_id"), F.lit("http://s").alias("source_url"))
    own = benefits.benefits_of_major(found, mapping, taxonomy, lore, "m1")
    reached = part.select(k.alias("site_id"), pick(("TRAIN_ONLY", "TRAIN_BUS", "CAR_ONLY", "UNKNOWN"), k % 4).alias("access_mode"), pick(("EASY", "MODERATE", "HARD"), k % 3).alias("walk_load"))
    sites = part.select(k.alias("site_id"), k.alias("pos"))
    return benefits.search(sites, reached, own, "m1", car_free=True).select("site_id", "access_mode", "walk_load", "mode_rank")
