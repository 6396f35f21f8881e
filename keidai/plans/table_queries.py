"""Operators over the benchmark tables: each query maps a table onto an operator's columns, and has the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keidai.functions import geo, text
from keidai.operators import access, benefits, display, gaps, identity, paths, priority
from keidai.sources import dumps, masters

QUERIES: dict = {}
SQL: dict[str, str] = {}
NOW = (2001, 10)  # the month that isn't over yet


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipped lines of each supplier and month, as a series of views."""
    li = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("site_id"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"))
    return li.groupBy("site_id", "year", "month").agg(F.count(F.lit(1)).alias("views"))


RATIO_SQL = f"""
v AS (SELECT l_suppkey AS site_id, year(l_shipdate) AS year, month(l_shipdate) AS month, count(*) AS views FROM lineitem GROUP BY 1, 2, 3),
m AS (SELECT site_id, median(CASE WHEN month IN (3, 4, 6, 7) THEN views END) AS pv_base_median, median(CASE WHEN month = 1 THEN views END) AS pv_january
      FROM v WHERE NOT (year = {NOW[0]} AND month = {NOW[1]}) GROUP BY site_id),
r AS (SELECT site_id, pv_base_median, pv_january, floor(CASE WHEN pv_january / nullif(pv_base_median, 0) > 3.0 THEN 3.0 ELSE pv_january / nullif(pv_base_median, 0) END * 100 + 0.5) / 100 AS new_year_ratio,
      coalesce(pv_january / nullif(pv_base_median, 0) > 3.0, false) AS clipped FROM m)
"""


@query(f"WITH {RATIO_SQL} SELECT * FROM r")
def newyear_ratio(spark, sf_dir):
    return priority.newyear_ratio(monthly(spark, sf_dir), "site_id", *NOW)


def priority_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = priority.newyear_ratio(monthly(spark, sf_dir), "site_id", *NOW)
    links = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.count_distinct("l_partkey").alias("sitelinks"))
    site = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("site_id"), F.col("s_acctbal").alias("official_visitors"), (F.col("s_nationkey") % 2 == 0).alias("has_goshuin"))
    joined = site.join(ratio, "site_id", "left").join(links, F.col("site_id") == F.col("k"), "left").drop("k")
    return joined.withColumn("has_article", F.col("pv_base_median").isNotNull())


SCORE_SQL = f"""{RATIO_SQL},
k AS (SELECT l_suppkey, count(DISTINCT l_partkey) AS sitelinks FROM lineitem GROUP BY 1),
i AS (SELECT s_suppkey AS site_id, s_acctbal AS official_visitors, s_nationkey % 2 = 0 AS has_goshuin, pv_base_median, new_year_ratio, sitelinks, pv_base_median IS NOT NULL AS has_article
      FROM supplier LEFT JOIN r ON s_suppkey = r.site_id LEFT JOIN k ON s_suppkey = k.l_suppkey),
e AS (SELECT min(CASE WHEN pv_base_median > 0 THEN ln(pv_base_median) END) AS a0, max(CASE WHEN pv_base_median > 0 THEN ln(pv_base_median) END) AS a1, min(new_year_ratio) AS b0, max(new_year_ratio) AS b1,
      min(CASE WHEN official_visitors > 0 THEN ln(official_visitors) END) AS c0, max(CASE WHEN official_visitors > 0 THEN ln(official_visitors) END) AS c1, min(sitelinks) AS d0, max(sitelinks) AS d1 FROM i),
s AS (SELECT site_id, floor((0.35 * coalesce(n(CASE WHEN pv_base_median > 0 THEN ln(pv_base_median) END, a0, a1), 0) + 0.30 * coalesce(n(new_year_ratio, b0, b1), 0)
      + 0.25 * coalesce(n(CASE WHEN official_visitors > 0 THEN ln(official_visitors) END, c0, c1), 0) + 0.05 * coalesce(n(sitelinks, d0, d1), 0) + 0.05 * CASE WHEN has_goshuin THEN 1 ELSE 0 END) * 10000 + 0.5) / 10000 AS score FROM i, e)
"""


def _normalized(sql: str) -> str:
    """Writes out n(x, low, high) in SQL."""
    while (at := sql.find(" n(")) >= 0 or (at := sql.find("(n(") ) >= 0:
        start, depth, parts, begin = at + 1, 0, [], at + 3
        for i in range(start, len(sql)):
            if sql[i] == "(":
                depth += 1
            elif sql[i] == "," and depth == 1:
                parts.append(sql[begin:i])
                begin = i + 1
            elif sql[i] == ")":
                depth -= 1
                if not depth:
                    parts.append(sql[begin:i])
                    break
        x, low, high = (p.strip() for p in parts)
        sql = sql[:start] + f"CASE WHEN {x} IS NULL THEN NULL WHEN {high} <= {low} THEN CASE WHEN {x} >= {high} THEN 1.0 WHEN {x} < {high} THEN 0.0 END ELSE greatest(0.0, least(1.0, ({x} - {low}) / ({high} - {low}))) END" + sql[i + 1 :]
    return sql


SCORE_SQL = _normalized(SCORE_SQL)


@query(f"WITH {SCORE_SQL} SELECT site_id, score FROM s")
def priority_score(spark, sf_dir):
    return priority.ranked(priority.score(priority_inputs(spark, sf_dir)), "site_id").select("site_id", "score")


@query(f"""WITH {RATIO_SQL}, t AS (SELECT * FROM r WHERE new_year_ratio IS NOT NULL)
SELECT part, site_id, new_year_ratio FROM (SELECT 'top' AS part, site_id, new_year_ratio FROM t ORDER BY new_year_ratio DESC, site_id LIMIT 20)
UNION ALL SELECT part, site_id, new_year_ratio FROM (SELECT 'bottom' AS part, site_id, new_year_ratio FROM t ORDER BY new_year_ratio, site_id LIMIT 10)""")
def priority_topk(spark, sf_dir):
    return priority.top_and_bottom(priority.newyear_ratio(monthly(spark, sf_dir), "site_id", *NOW), "site_id")


@query(f"WITH {SCORE_SQL} SELECT count(*) AS n_sites, count(new_year_ratio) AS with_ratio, count(*) FILTER (WHERE NOT has_article) AS no_article FROM i")
def priority_summary(spark, sf_dir):
    return priority.summary(priority_inputs(spark, sf_dir))


@query("""WITH e AS (SELECT min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer)
SELECT c_custkey AS site_id, floor((0.4 * CASE WHEN c_nationkey % 5 = 0 THEN 1 ELSE 0 END + 0.2 * CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END + 0.1 * CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END
+ 0.3 * greatest(0.0, least(1.0, (c_acctbal - low) / (high - low)))) * 10000 + 0.5) / 10000 AS score FROM customer, e""")
def no_article_priority(spark, sf_dir):
    signals = read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("site_id"),
        (F.col("c_nationkey") % 5 == 0).alias("official_listed"),
        (F.col("c_mktsegment") == "BUILDING").alias("has_rank"),
        (F.col("c_custkey") % 3 == 0).alias("osm_has_name"),
        F.col("c_acctbal").alias("nearby_population"),
    )
    return priority.no_article_score(signals).select("site_id", "score")


def part_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.alias_index(read(spark, sf_dir, "part"), F.lower("p_name"), "p_brand", "p_partkey")


@query("SELECT lower(p_name) AS key, min_by(p_brand, p_partkey) AS cluster FROM part GROUP BY 1")
def alias_index_first_wins(spark, sf_dir):
    return part_index(spark, sf_dir)


RESOLVE_SQL = """
WITH q AS (SELECT p_partkey AS key, p_brand AS cluster FROM part WHERE p_partkey % 3 = 0),
t AS (SELECT p_type AS key, min_by(p_brand, p_partkey) AS cluster FROM part WHERE p_size < 10 GROUP BY 1),
n AS (SELECT lower(p_name) AS key, min_by(p_brand, p_partkey) AS cluster FROM part GROUP BY 1),
d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey END AS qid, CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS link, CASE WHEN p_size % 3 = 0 THEN lower(p_name) END AS name
      FROM lineitem JOIN part ON l_partkey = p_partkey),
r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(q.cluster, t.cluster, n.cluster) AS cluster_id,
      CASE WHEN q.cluster IS NOT NULL THEN 'qid' WHEN t.cluster IS NOT NULL THEN 'linkTarget' WHEN n.cluster IS NOT NULL THEN 'alias' END AS matched_by
      FROM d LEFT JOIN q ON d.qid = q.key LEFT JOIN t ON nullif(d.link, '') = t.key LEFT JOIN n ON nullif(d.name, '') = n.key)
"""


def resolved_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(part, F.col("l_partkey") == F.col("p_partkey"))
    by_qid = part.where("p_partkey % 3 = 0").select(F.col("p_partkey").cast("string").alias("key"), F.col("p_brand").alias("cluster"))
    by_type = identity.alias_index(part.where("p_size < 10"), F.col("p_type"), "p_brand", "p_partkey")
    qid = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey").cast("string"))
    link = F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("")
    name = F.when(F.col("p_size") % 3 == 0, F.lower("p_name"))
    out = identity.resolve(lines, by_qid, by_type, part_index(spark, sf_dir), qid, link, name)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cluster_id", "matched_by")


@query(RESOLVE_SQL + "SELECT * FROM r")
def resolve_cascade(spark, sf_dir):
    return resolved_lines(spark, sf_dir)


@query(RESOLVE_SQL + "SELECT coalesce(avg(CASE WHEN cluster_id IS NOT NULL THEN 1.0 ELSE 0.0 END), 0.0) AS rate, count(*) AS total, count(cluster_id) AS matched FROM r")
def identification_rate(spark, sf_dir):
    return identity.identification_rate(resolved_lines(spark, sf_dir))


DERIVE_SQL = """
d AS (SELECT l_orderkey AS site_id, l_linenumber AS pos, p_name AS display, p_brand AS cluster_id FROM lineitem JOIN part ON l_partkey = p_partkey),
m AS (SELECT p_brand AS cluster, p_type AS benefit, CASE WHEN min(p_size) < 3 THEN 'primary' ELSE 'secondary' END AS weight, CASE WHEN min(p_size) < 3 THEN 0 ELSE 1 END AS weight_rank, min(p_partkey) AS pos FROM part
      WHERE p_size < 20 AND p_brand NOT IN (SELECT min(p_brand) FROM part) GROUP BY 1, 2),
t AS (SELECT p_type AS benefit, 'm' || CAST(min(p_partkey) % 10 AS VARCHAR) AS major FROM part WHERE p_retailprice > 950 GROUP BY 1),
j AS (SELECT d.site_id, m.benefit, m.weight, m.weight_rank, d.pos, m.pos AS list_pos, d.display, d.cluster_id, t.major FROM d JOIN m ON d.cluster_id = m.cluster JOIN t ON m.benefit = t.benefit),
b AS (SELECT site_id, benefit AS benefit_id, arg_min({'major': major, 'weight': weight, 'display': display, 'cluster_id': cluster_id}, {'a': weight_rank, 'b': pos, 'c': list_pos, 'd': display}) AS r,
      min({'a': CAST(pos AS BIGINT), 'b': CAST(weight_rank AS BIGINT), 'c': CAST(list_pos AS BIGINT)}) AS ord FROM j GROUP BY 1, 2),
dv AS (SELECT site_id, benefit_id, r.major AS major_id, r.weight AS weight, 'derived' AS confidence, r.display AS derived_deity, r.cluster_id AS derived_cluster, ord FROM b)
"""


def part_taxonomy(spark, sf_dir):
    part = read(spark, sf_dir, "part").where("p_retailprice > 950")
    return part.groupBy(F.col("p_type").alias("benefit")).agg(F.concat(F.lit("m"), (F.min("p_partkey") % 10).cast("string")).alias("major"))


def derive_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """deities, mapping, taxonomy and lore of orders: one join of lines and parts serves deities and lore."""
    part = read(spark, sf_dir, "part")
    lines = read(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    site, pos = F.col("l_orderkey").alias("site_id"), F.col("l_linenumber").alias("pos")
    deities = lines.select(site, pos, F.col("p_name").alias("display"), F.col("p_brand").alias("cluster_id"))
    source = F.when(F.col("l_linestatus") == "F", F.concat(F.lit("http://s/"), F.col("l_suppkey").cast("string"))).otherwise("")
    lore = lines.where("l_returnflag = 'R'").select(site, pos, F.col("p_type").alias("benefit_id"), source.alias("source_url"))
    rules = part.where("p_size < 20").groupBy(F.col("p_brand").alias("cluster"), F.col("p_type").alias("benefit")).agg(F.min("p_size").alias("s"), F.min("p_partkey").alias("pos"))
    first = part.agg(F.min("p_brand").alias("first_brand"))
    rules = rules.crossJoin(F.broadcast(first)).select(  # one row
        "cluster",
        "benefit",
        "pos",
        F.when(F.col("s") < 3, "primary").otherwise("secondary").alias("weight"),
        F.when(F.col("s") < 3, 0).otherwise(1).alias("weight_rank"),
        F.when(F.col("cluster") == F.col("first_brand"), "NO_AUTO_MAPPING").alias("policy"),
    )
    return deities, rules, part_taxonomy(spark, sf_dir), lore


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benefits.derive(*derive_inputs(spark, sf_dir)[:3])


@query(f"WITH {DERIVE_SQL} SELECT * EXCLUDE (ord) FROM dv")
def derive_benefits(spark, sf_dir):
    return derived(spark, sf_dir).drop("ord")


OFFICIAL_SQL = DERIVE_SQL + """,
lo AS (SELECT l_orderkey AS site_id, p_type AS benefit_id, max_by('http://s/' || CAST(l_suppkey AS VARCHAR), {'a': l_linenumber, 'b': 'http://s/' || CAST(l_suppkey AS VARCHAR)}) AS source_url, min(l_linenumber) AS lore_pos
       FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND l_linestatus = 'F' GROUP BY 1, 2),
lt AS (SELECT lo.*, major FROM lo JOIN t ON lo.benefit_id = t.benefit),
o AS (SELECT coalesce(dv.site_id, lt.site_id) AS site_id, coalesce(dv.benefit_id, lt.benefit_id) AS benefit_id, coalesce(lt.major, major_id) AS major_id, CASE WHEN lt.site_id IS NOT NULL THEN 'primary' ELSE weight END AS weight,
      CASE WHEN lt.site_id IS NOT NULL THEN 'official' ELSE confidence END AS confidence, CASE WHEN lt.site_id IS NULL THEN derived_deity END AS derived_deity, CASE WHEN lt.site_id IS NULL THEN derived_cluster END AS derived_cluster, source_url,
      coalesce(ord, {'a': CAST(2147483647 AS BIGINT), 'b': CAST(0 AS BIGINT), 'c': CAST(lore_pos AS BIGINT)}) AS ord FROM dv FULL JOIN lt ON dv.site_id = lt.site_id AND dv.benefit_id = lt.benefit_id)
"""


def official(spark: SparkSession, sf_dir: str) -> DataFrame:
    deities, rules, taxonomy, lore = derive_inputs(spark, sf_dir)
    return benefits.official(deities, rules, taxonomy, lore)


@query(f"WITH {OFFICIAL_SQL} SELECT * EXCLUDE (ord) FROM o")
def official_overrides(spark, sf_dir):
    return official(spark, sf_dir).drop("ord")


@query(f"WITH {OFFICIAL_SQL} SELECT site_id, benefit_id, major_id, weight FROM o WHERE weight = 'primary'")
def search_primary(spark, sf_dir):
    return benefits.for_search(official(spark, sf_dir)).select("site_id", "benefit_id", "major_id", "weight")


@query(f"WITH {OFFICIAL_SQL} SELECT site_id, list_sort(list(benefit_id) FILTER (WHERE weight = 'primary')) AS p, list_sort(list(benefit_id) FILTER (WHERE weight = 'secondary')) AS s FROM o GROUP BY site_id".replace(
    "list_sort(list(benefit_id) FILTER (WHERE weight = 'primary')) AS p, list_sort(list(benefit_id) FILTER (WHERE weight = 'secondary')) AS s",
    "coalesce(string_agg(benefit_id, ',' ORDER BY ord, benefit_id) FILTER (WHERE weight = 'primary'), '') AS primary_ids, coalesce(string_agg(benefit_id, ',' ORDER BY ord, benefit_id) FILTER (WHERE weight = 'secondary'), '') AS secondary_ids, count(*) = 0 AS no_benefit",
))
def benefit_lists(spark, sf_dir):
    out = benefits.benefit_list(official(spark, sf_dir))
    return out.select("site_id", F.array_join("primary_ids", ",").alias("primary_ids"), F.array_join("secondary_ids", ",").alias("secondary_ids"), "no_benefit")


ACCESS_SQL = """
a AS (SELECT o_orderkey AS site_id, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 70 END AS station_walk, o_orderkey % 3 <> 0 AS bus, o_custkey % 40 AS bus_walk, CASE WHEN o_custkey % 5 <> 0 THEN o_custkey % 15 END AS trips,
      CASE WHEN o_custkey % 7 = 0 THEN false WHEN o_custkey % 7 = 1 THEN true END AS connects, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 90 END AS walk, CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderkey % 150 AS DOUBLE) END AS ascent FROM orders),
acc AS (SELECT site_id, CASE WHEN station_walk <= 25 THEN 'TRAIN_ONLY' WHEN bus AND trips IS NULL THEN 'UNKNOWN' WHEN bus AND trips >= 6 AND bus_walk <= 20 AND coalesce(connects, true) THEN 'TRAIN_BUS'
      WHEN (bus OR station_walk IS NOT NULL) AND walk > 60 THEN 'CAR_ONLY' WHEN bus OR station_walk IS NOT NULL THEN 'CAR_RECOMMENDED' ELSE 'CAR_ONLY' END AS access_mode,
      CASE greatest(CASE WHEN walk >= 30 THEN 2 WHEN walk >= 15 THEN 1 ELSE 0 END, CASE WHEN ascent >= 100 THEN 2 WHEN ascent >= 30 THEN 1 ELSE 0 END) WHEN 0 THEN 'EASY' WHEN 1 THEN 'MODERATE' ELSE 'HARD' END AS walk_load FROM a)
"""


def access_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    station = F.when(k % 4 != 0, F.struct(F.lit("S").alias("name"), (k % 70).cast("int").alias("walk_min")))
    bus = F.when(
        k % 3 != 0,
        F.struct(
            F.lit("B").alias("name"),
            (c % 40).cast("int").alias("walk_min"),
            F.when(c % 5 != 0, (c % 15).cast("int")).alias("trips_weekday"),
            F.lit(None).cast("string").alias("unknown_reason"),
            F.when(c % 7 == 0, False).when(c % 7 == 1, True).alias("connects_to_station"),
        ),
    )
    rows = read(spark, sf_dir, "orders").select(
        k.alias("site_id"), station.alias("station"), bus.alias("bus"), F.when(k % 11 != 0, (k % 90).cast("int")).alias("walk_minutes"), F.when(k % 13 != 0, (k % 150).cast("double")).alias("ascent_m")
    )
    return access.assess(rows)


@query(f"WITH {ACCESS_SQL} SELECT * FROM acc")
def access_assessment(spark, sf_dir):
    return access_sites(spark, sf_dir).select("site_id", "access_mode", "walk_load")


@query(f"""WITH {OFFICIAL_SQL}, {ACCESS_SQL}, w AS (SELECT DISTINCT site_id FROM o WHERE weight = 'primary' AND major_id = 'm3')
SELECT acc.site_id, access_mode, walk_load, CAST(CASE access_mode WHEN 'TRAIN_ONLY' THEN 0 WHEN 'TRAIN_BUS' THEN 1 WHEN 'CAR_RECOMMENDED' THEN 2 WHEN 'UNKNOWN' THEN 3 ELSE 4 END AS INTEGER) AS mode_rank
FROM acc JOIN w ON acc.site_id = w.site_id WHERE access_mode IN ('TRAIN_ONLY', 'TRAIN_BUS', 'UNKNOWN')""")
def search_benefit(spark, sf_dir):
    sites = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("site_id"), F.col("o_orderkey").alias("pos"))
    reached = access_sites(spark, sf_dir).select("site_id", "access_mode", "walk_load")
    found = benefits.search(sites, reached, benefits.benefits_of_major(*derive_inputs(spark, sf_dir), "m3"), "m3", car_free=True, include_unknown=True)
    return found.select("site_id", "access_mode", "walk_load", "mode_rank")


@query("""WITH w AS (SELECT user_id AS site_id, event_type AS benefit_id, count(*) AS count FROM events GROUP BY 1, 2), d AS (SELECT DISTINCT user_id AS site_id, event_type AS benefit_id FROM events WHERE value > 90)
SELECT w.* FROM w ANTI JOIN d ON w.site_id = d.site_id AND w.benefit_id = d.benefit_id WHERE count >= 3""")
def unexplained_wishes(spark, sf_dir):
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("site_id"), F.col("event_type").alias("benefit_id"), "value")
    visits = events.select("site_id", F.array("benefit_id").alias("wish_benefit_ids"))
    return benefits.unexplained_wishes(benefits.wish_tally(visits), events.where("value > 90").select("site_id", "benefit_id").distinct())


@query("""WITH p AS (SELECT user_id, ts, event_id, CASE WHEN event_type <> 'error' THEN value END AS e FROM events),
d AS (SELECT user_id, e, e - lag(e) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM p)
SELECT user_id AS path_id, floor(coalesce(sum(greatest(d, 0.0)) FILTER (WHERE d IS NOT NULL), 0.0) * 10 + 0.5) / 10 AS ascent_m, floor(coalesce(sum(greatest(-d, 0.0)) FILTER (WHERE d IS NOT NULL), 0.0) * 10 + 0.5) / 10 AS descent_m,
count(e) / count(*) AS coverage FROM d GROUP BY 1""")
def cumulative_elevation(spark, sf_dir):
    points = read(spark, sf_dir, "events").select(F.col("user_id").alias("path_id"), "ts", "event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("elevation"))
    return paths.cumulative_elevation(points, "path_id", "ts", "event_id")


@query("""WITH r AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 100 AS c, list_transform(embedding[2:9], lambda x: CAST(x AS DOUBLE) * 100) AS ring FROM embeddings),
m AS (SELECT vec_id, floor((c - list_min(ring)) * 10 + 0.5) / 10 AS relief, floor((list_max(ring) - list_min(ring)) * 10 + 0.5) / 10 AS range FROM r)
SELECT vec_id, relief, range, CASE WHEN range < 20 THEN 'flat' WHEN range < 60 THEN 'rolling' ELSE 'hilly' END AS terrain FROM m""")
def relief_terrain(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    h = F.transform(F.slice("embedding", 1, 9), lambda x: x.cast("double") * 100)
    return e.select("vec_id", geo.relief(F.get(h, F.lit(0)), F.slice(h, 2, 8)).alias("r")).select("vec_id", "r.*")


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 256 AS r, l_suppkey % 256 AS g, l_orderkey % 256 AS b FROM lineitem),
x AS (SELECT *, r * 65536 + g * 256 + b AS x FROM p)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN r = 128 AND g = 0 AND b = 0 THEN NULL ELSE floor(CASE WHEN x < 8388608 THEN CAST(x AS DOUBLE) * CAST(0.01 AS DOUBLE) ELSE CAST(x - 16777216 AS DOUBLE) * CAST(0.01 AS DOUBLE) END * 100 + 0.5) / 100 END AS metres FROM x""")
def dem_decode(spark, sf_dir):
    rgb = [(F.col(c) % 256) for c in ("l_partkey", "l_suppkey", "l_orderkey")]
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", geo.dem_metres(*rgb).alias("metres"))


@query("""WITH p AS (SELECT c_custkey, 30 + (c_custkey % 1500) / 100.0 AS lat, 129 + (c_custkey % 1700) / 100.0 AS lng FROM customer),
f AS (SELECT c_custkey, lat, lng, (lng + 180) / 360 * 32768 AS fx, (1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 32768 AS fy FROM p)
SELECT c_custkey, CAST(floor(fx) AS INTEGER) AS x, CAST(floor(fy) AS INTEGER) AS y, CAST(least(floor((fx - floor(fx)) * 256), 255) AS INTEGER) AS px, CAST(least(floor((fy - floor(fy)) * 256), 255) AS INTEGER) AS py,
'dem5a,dem5b,dem5c' AS layers FROM f""")
def tile_coords(spark, sf_dir):
    k = F.col("c_custkey")
    lat, lng = F.lit(30) + (k % 1500) / 100.0, F.lit(129) + (k % 1700) / 100.0
    rows = read(spark, sf_dir, "customer").select("c_custkey", geo.tile_of(lat, lng, F.lit(15)).alias("t"), F.array_join(geo.layers_for_zoom(F.lit(15)), ",").alias("layers"))
    return rows.select("c_custkey", "t.*", "layers")


@query("""WITH p AS (SELECT c_custkey, 30 + (c_custkey % 1500) / 100.0 AS lat, 129 + (c_custkey % 1700) / 100.0 AS lng, unnest(range(8)) AS i FROM customer)
SELECT c_custkey, CAST(i AS INTEGER) AS i, round(lat + 400 * cos(2 * pi() * i / 8) / 111320, 9) AS lat, round(lng + 400 * sin(2 * pi() * i / 8) / (111320 * cos(radians(lat))), 9) AS lng FROM p""")
def ring_points(spark, sf_dir):
    k = F.col("c_custkey")
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.posexplode(geo.ring(F.lit(30) + (k % 1500) / 100.0, F.lit(129) + (k % 1700) / 100.0)).alias("i", "p"))
    return rows.select("c_custkey", "i", F.round("p.lat", 9).alias("lat"), F.round("p.lng", 9).alias("lng"))


@query("""WITH s AS (SELECT c_custkey, c_custkey % 32768 AS x, (c_custkey * 7) % 32768 AS y, c_custkey % 256 AS px, c_nationkey AS py FROM customer)
SELECT c_custkey, round(degrees(atan(sinh(pi() * (1 - 2 * (y + (py + 0.5) / 256) / 32768)))), 9) AS lat, round((x + (px + 0.5) / 256) / 32768 * 360 - 180, 9) AS lng FROM s""".replace("sinh(pi() * (1 - 2 * (y + (py + 0.5) / 256) / 32768))", "(exp(pi() * (1 - 2 * (y + (py + 0.5) / 256) / 32768)) - exp(-(pi() * (1 - 2 * (y + (py + 0.5) / 256) / 32768)))) / 2"))
def tile_places(spark, sf_dir):
    k = F.col("c_custkey")
    p = geo.place_of(k % 32768, (k * 7) % 32768, F.lit(15), k % 256, F.col("c_nationkey"))
    return read(spark, sf_dir, "customer").select("c_custkey", p.alias("p")).select("c_custkey", F.round("p.lat", 9).alias("lat"), F.round("p.lng", 9).alias("lng"))


@query("""WITH c AS (SELECT conv_id, turn, role, CASE WHEN role = 'system' OR turn % 7 = 0 THEN 'p' || CAST(turn AS VARCHAR) END AS o, CASE WHEN role = 'user' THEN 'd' || CAST(turn AS VARCHAR) END AS i FROM conversations)
SELECT conv_id, turn, coalesce(last_value(o IGNORE NULLS) OVER w, '') AS outer_heading, coalesce(last_value(CASE WHEN o IS NOT NULL THEN '' ELSE i END IGNORE NULLS) OVER w, '') AS inner_heading FROM c
WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def carry_forward_headers(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    turn = F.col("turn").cast("string")
    outer = F.when((F.col("role") == "system") | (F.col("turn") % 7 == 0), F.concat(F.lit("p"), turn))
    inner = F.when(F.col("role") == "user", F.concat(F.lit("d"), turn))
    out = paths.carry_forward(rows, ["conv_id"], ["turn"], outer, inner)
    return out.select("conv_id", "turn", F.col("outer").alias("outer_heading"), F.col("inner").alias("inner_heading"))


STRIP_SQL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '(?s)<!--.*?-->', '', 'g'), '<ref[^>]*/>', '', 'g'), '(?s)<ref[^>]*>.*?</ref>', '', 'g'), '(?s)\{{\{{efn\|.*?\}}\}}', '', 'g'), '(?s)\{{\{{sfn\|.*?\}}\}}', '', 'g')"


@query(f"SELECT page_id, md5({STRIP_SQL.format('html')}) AS body, CAST(strlen(html) AS BIGINT) AS bytes FROM pages")
def strip_annotations(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.md5(text.strip_annotations(F.col("html"))).alias("body"), F.octet_length("html").cast("long").alias("bytes"))


@query("SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&')) AS body FROM pages")
def xml_unescape(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.md5(text.unescape_xml(F.col("html"))).alias("body"))


WHITE_SQL = r"\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


@query(rf"""WITH s AS (SELECT page_id, string_split(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<br\s*/?>', chr(10), 'g'), '\]\]\s*[・･]\s*\[\[', ']]' || chr(10) || '[[', 'g'), '[、,]', chr(10), 'g'), chr(10)) AS parts FROM pages),
e AS (SELECT page_id, unnest(parts) AS part FROM s), t AS (SELECT page_id, regexp_replace(part, '^[{WHITE_SQL}]+|[{WHITE_SQL}]+$', '', 'g') AS part FROM e)
SELECT page_id, count(*) AS n, CAST(sum(length(part)) AS BIGINT) AS chars FROM t WHERE part <> '' GROUP BY 1""")
def split_entries(spark, sf_dir):
    parts = read(spark, sf_dir, "pages").select("page_id", F.explode(text.split_entries(F.col("html"))).alias("part"))
    return parts.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("part")).alias("chars"))


@query("""WITH l AS (SELECT event_id AS pos, CASE WHEN user_id % 2 = 0 THEN 'ja.wikipedia' ELSE 'en.wikipedia' END AS wiki, event_type || '_' || CAST(user_id AS VARCHAR) AS title, CASE WHEN event_id % 5 = 0 THEN 'spider' ELSE 'user' END AS agent, event_id % 1000 AS views FROM events),
w AS (SELECT DISTINCT 'click ' || CAST(user_id AS VARCHAR) AS title FROM events UNION SELECT DISTINCT 'view_' || CAST(user_id AS VARCHAR) FROM events),
m AS (SELECT coalesce(a.title, b.title) AS title, pos, views FROM l LEFT JOIN w a ON replace(l.title, '_', ' ') = a.title LEFT JOIN w b ON l.title = b.title WHERE wiki = 'ja.wikipedia' AND agent = 'user')
SELECT title, CAST(2024 AS INTEGER) AS year, CAST(1 AS INTEGER) AS month, CAST(max_by(views, pos) AS DOUBLE) AS views FROM m WHERE title IS NOT NULL GROUP BY title""")
def pageview_lines(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    lines = events.select(
        F.col("event_id").alias("at"),
        F.concat_ws(
            " ", F.when(F.col("user_id") % 2 == 0, "ja.wikipedia").otherwise("en.wikipedia"), F.concat("event_type", F.lit("_"), user), user, F.when(F.col("event_id") % 5 == 0, "spider").otherwise("user"),
            (F.col("event_id") % 1000).cast("string"), F.lit("A1"),
        ).alias("value"),
    )
    titles = events.select(F.concat(F.lit("click "), user).alias("title")).union(events.select(F.concat(F.lit("view_"), user).alias("title"))).distinct()
    return dumps.scan_pageviews(lines, titles, 2024, 1)


GRID_SQL = """
WITH s AS (SELECT c_custkey AS id, c_nationkey AS nation, c_mktsegment AS seg, c_acctbal FROM customer),
"""


@query(GRID_SQL + "g AS (SELECT n_nationkey AS nation FROM nation) SELECT g.nation, count(s.id) AS count FROM g LEFT JOIN s ON g.nation = s.nation AND s.c_acctbal > 9000 GROUP BY 1 HAVING count(s.id) < 8")
def gaps_geography(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation"))
    grid = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"))
    return gaps.low_counts(grid, rows, ["nation"], 8, F.count(F.lit(1)))


@query(GRID_SQL + "m AS (SELECT DISTINCT seg FROM s), g AS (SELECT n_nationkey AS nation, seg FROM nation, m) SELECT g.nation, g.seg, count(DISTINCT s.id) AS count FROM g LEFT JOIN s ON g.nation = s.nation AND g.seg = s.seg AND s.c_acctbal > 9000 GROUP BY 1, 2 HAVING count(DISTINCT s.id) < 3")
def gaps_region_segment(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("seg"), "c_acctbal")
    grid = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation")).crossJoin(F.broadcast(rows.select("seg").distinct()))  # 25 nations, a few segments
    return gaps.low_counts(grid, rows.where("c_acctbal > 9000"), ["nation", "seg"], 3, F.count_distinct("id"))


@query("""WITH g AS (SELECT o_orderpriority AS group_id, o_orderpriority AS name, 40000 AS total_count FROM orders GROUP BY 1),
m AS (SELECT o_orderpriority AS group_id, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1)
SELECT g.group_id, g.name, CAST(total_count AS INTEGER) AS total_count, coalesce(n, 0) AS registered FROM g LEFT JOIN m ON g.group_id = m.group_id WHERE coalesce(n, 0) < total_count""")
def pilgrimage_coverage(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    groups = orders.select(F.col("o_orderpriority").alias("group_id")).distinct().select("group_id", F.col("group_id").alias("name"), F.lit(40000).alias("total_count"))
    return gaps.incomplete(gaps.coverage(groups, orders.select(F.col("o_orderpriority").alias("group_id"), F.col("o_custkey").alias("site_id"))))


@query("""SELECT 'line_key' AS rule, 'error' AS severity, CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR) AS message FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'order_customer', 'error', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
UNION ALL SELECT 'balance', 'warning', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE NOT s_acctbal >= 0""")
def validate_issues(spark, sf_dir):
    lines, orders, customers, suppliers = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    say = lambda df, rule, severity, message: df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), message.alias("message"))
    a = say(masters.primary_key(lines, ["l_orderkey", "l_linenumber"]), "line_key", "error", F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    b = say(masters.foreign_key(orders, "o_custkey", customers.where("c_acctbal > 0"), "c_custkey"), "order_customer", "error", F.col("o_orderkey").cast("string"))
    c = say(masters.check(suppliers, F.col("s_acctbal") >= 0), "balance", "warning", F.col("s_suppkey").cast("string"))
    return a.unionByName(b).unionByName(c)


@query("""SELECT o_orderkey, CAST(greatest(0, (2001 - year(o_orderdate)) * 12 + 6 - month(o_orderdate)) AS INTEGER) AS months, greatest(0, (2001 - year(o_orderdate)) * 12 + 6 - month(o_orderdate)) >= 6 AS stale FROM orders""")
def months_since(spark, sf_dir):
    date, now = F.to_date("o_orderdate"), F.to_date(F.lit("2001-06-15"))
    return read(spark, sf_dir, "orders").select("o_orderkey", display.months_since(date, now).alias("months"), display.is_stale(date, now).alias("stale"))


@query("""SELECT o_orderkey AS site_id, l_linenumber AS pos, l_suppkey AS source_id, CAST(1 + l_linenumber % 3 AS INTEGER) AS layer, s_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal > 0""")
def citations_sorted(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    links = lines.select(F.col("o_orderkey").alias("site_id"), F.col("l_linenumber").alias("pos"), F.col("l_suppkey").alias("source_id"), (1 + F.col("l_linenumber") % 3).alias("layer"))
    sources = read(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("source_id"), "s_name")
    return display.citations(links, sources).select("site_id", "pos", "source_id", "layer", "s_name")


@query("""SELECT p_partkey AS site_id, u.flag, u.ok FROM (SELECT p_partkey, unnest([{'flag': 'dq_benefit', 'ok': p_size > 10}, {'flag': 'dq_etiquette', 'ok': p_size > 20}, {'flag': 'dq_goshuin', 'ok': p_size > 30},
{'flag': 'dq_access', 'ok': p_size > 40}, {'flag': 'dq_citation', 'ok': p_size > 45}]) AS u FROM part)""")
def quality_flags(spark, sf_dir):
    sizes = dict(zip(display.QUALITY_FLAGS, (10, 20, 30, 40, 45)))
    return display.quality_flags(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("site_id"), *[(F.col("p_size") > n).alias(f) for f, n in sizes.items()]))
