"""Operators on places, files and versions over whole benchmark tables, and the SQL of the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keidai.functions.geo import TILE, tile_of
from keidai.functions.joins import spread
from keidai.functions.tables import register_tables
from keidai.operators import access, gaps, nearby, paths, priority, rules, running
from keidai.plans.table_queries import NOW, RATIO_SQL, monthly, read
from keidai.plans.text_queries import GAP_MAJORS, GAP_REGIONS, NOTES, PROVINCES, listed, order_lines, pick
from keidai.sources import lines, masters, pageview_api, tiles, versions
from keidai.sources.shared import fresh_folder, kept
from keidai.streaming import pageviews

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


# ── Nearest stations ──


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers on a map: a third of them at one corner of it."""
    k = F.col("s_suppkey")
    spread = read(spark, sf_dir, "supplier").select(k.alias("site_id"), F.when(k % 3 == 0, 35.0).otherwise(31.0 + (k * 7919 % 13000) / 1000.0).alias("lat"), F.when(k % 3 == 0, 135.0).otherwise(130.0 + (k * 104729 % 15000) / 1000.0).alias("lng"))
    return spread


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as stations: a third of them in one small cell."""
    k = F.col("c_custkey")
    crowd = k % 3 == 0
    return read(spark, sf_dir, "customer").select(
        k.alias("station_id"), F.col("c_name").alias("name"), F.when(crowd, 35.0 + (k * 31 % 1009) / 100000.0).otherwise(30.0 + (k * 6151 % 15013) / 1000.0).alias("lat"), F.when(crowd, 135.0 + (k * 17 % 997) / 100000.0).otherwise(129.0 + (k * 3571 % 17011) / 1000.0).alias("lng")
    )


NEAR_SQL = """
p AS (SELECT s_suppkey AS site_id, CASE WHEN s_suppkey % 3 = 0 THEN 35.0::DOUBLE ELSE 31.0::DOUBLE + (s_suppkey * 7919 % 13000) / 1000.0::DOUBLE END AS lat, CASE WHEN s_suppkey % 3 = 0 THEN 135.0::DOUBLE ELSE 130.0::DOUBLE + (s_suppkey * 104729 % 15000) / 1000.0::DOUBLE END AS lng FROM supplier),
s AS (SELECT c_custkey AS station_id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 35.0::DOUBLE + (c_custkey * 31 % 1009) / 100000.0::DOUBLE ELSE 30.0::DOUBLE + (c_custkey * 6151 % 15013) / 1000.0::DOUBLE END AS lat,
      CASE WHEN c_custkey % 3 = 0 THEN 135.0::DOUBLE + (c_custkey * 17 % 997) / 100000.0::DOUBLE ELSE 129.0::DOUBLE + (c_custkey * 3571 % 17011) / 1000.0::DOUBLE END AS lng FROM customer),
d AS (SELECT site_id, station_id, name, 2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians(s.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lng - p.lng) / 2), 2)))) AS metres FROM p, s),
n AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY metres, station_id) AS rank FROM d QUALIFY rank <= 3)
"""


@query(f"WITH {NEAR_SQL} SELECT site_id, CAST(rank AS INTEGER) AS rank, station_id, round(metres, 3) AS metres FROM n")
def nearest_stations(spark, sf_dir):
    near = nearby.nearest_stations(places(spark, sf_dir), stations(spark, sf_dir), k=3, crowd=500)
    return near.select("site_id", "rank", "station_id", F.round("metres", 3).alias("metres"))


@query(f"""WITH {NEAR_SQL}, w AS (SELECT site_id, name, CAST(ceil(metres / 80.0) AS INTEGER) AS walk FROM n WHERE rank = 1)
SELECT site_id, CASE WHEN walk <= 25 THEN 'TRAIN_ONLY' WHEN walk > 60 THEN 'CAR_ONLY' ELSE 'CAR_RECOMMENDED' END AS access_mode, CASE WHEN walk >= 30 THEN 'HARD' WHEN walk >= 15 THEN 'MODERATE' ELSE 'EASY' END AS walk_load FROM w""")
def access_by_distance(spark, sf_dir):
    sites = nearby.with_station(places(spark, sf_dir), stations(spark, sf_dir))
    none = F.lit(None).cast("struct<name:string,walk_min:int,trips_weekday:int,unknown_reason:string,connects_to_station:boolean>")
    rows = sites.select("site_id", "station", none.alias("bus"), F.col("station.walk_min").alias("walk_minutes"), F.lit(None).cast("double").alias("ascent_m"))
    return access.assess(rows).select("site_id", "access_mode", "walk_load")


# ── Elevation from tiles ──

CORNER = (29084, 12841)  # of zoom 15


def heights_of_tile(layer: str, z: Column, x: Column, y: Column) -> Column:
    """Centimetres by column and row, with gaps: the first layer lacks a stripe, the second some pixels."""
    seed = {"dem5a": 1000, "dem5b": 2000, "dem": -500}[layer]
    cm = lambda i: (seed + (x * 7 + y * 13 + (i % TILE) * 3 + F.floor(i / TILE) * 5) % 4000).cast("int")
    gap = {"dem5a": lambda i: i % TILE < 64, "dem5b": lambda i: i % 5 == 0, "dem": lambda i: F.lit(False)}[layer]
    return F.transform(F.sequence(F.lit(0), F.lit(TILE * TILE - 1)), lambda i: F.when(~gap(i), cm(i)))


def on_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers within 4 x 4 tiles of zoom 15, and some where there is no tile."""
    k = F.col("c_custkey")
    lng = F.lit(CORNER[0] / 32768 * 360 - 180) + (k * 7919 % 10007) / 10007.0 * (4 * 360 / 32768)
    return read(spark, sf_dir, "customer").select("c_custkey", F.when(k % 10 == 9, 60.0).otherwise(36.0 + (k * 104729 % 10009) / 10009.0 * 0.03).alias("lat"), lng.alias("lng"))


PIXEL_SQL = f"""
p AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 9 THEN 60.0::DOUBLE ELSE 36.0::DOUBLE + (c_custkey * 104729 % 10009) / 10009.0::DOUBLE * 0.03::DOUBLE END AS lat,
      {CORNER[0]}::DOUBLE / 32768 * 360 - 180 + (c_custkey * 7919 % 10007) / 10007.0::DOUBLE * (4 * 360 / 32768::DOUBLE) AS lng FROM customer),
f AS (SELECT c_custkey, lat, (lng + 180) / 360 * 32768 AS fx, (1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 32768 AS fy FROM p),
t AS (SELECT c_custkey, lat, floor(fx)::BIGINT AS x, floor(fy)::BIGINT AS y, least(floor((fx - floor(fx)) * 256), 255)::BIGINT AS px, least(floor((fy - floor(fy)) * 256), 255)::BIGINT AS py,
      floor(fx / 2)::BIGINT AS x4, floor(fy / 2)::BIGINT AS y4, least(floor((fx / 2 - floor(fx / 2)) * 256), 255)::BIGINT AS px4, least(floor((fy / 2 - floor(fy / 2)) * 256), 255)::BIGINT AS py4 FROM f),
h AS (SELECT c_custkey, CASE WHEN lat < 50 AND (x + y) % 3 <> 0 AND px >= 64 THEN 1000 + (x * 7 + y * 13 + px * 3 + py * 5) % 4000 END AS a, CASE WHEN lat < 50 AND (x + y) % 2 = 0 AND (py * 256 + px) % 5 <> 0 THEN 2000 + (x * 7 + y * 13 + px * 3 + py * 5) % 4000 END AS b,
      CASE WHEN lat < 50 THEN -500 + (x4 * 7 + y4 * 13 + px4 * 3 + py4 * 5) % 4000 END AS d FROM t)
"""


@query(f"WITH {PIXEL_SQL} SELECT c_custkey, coalesce(a, b, d) / 100::DOUBLE AS elevation, CASE WHEN a IS NOT NULL THEN 'dem5a' WHEN b IS NOT NULL THEN 'dem5b' WHEN d IS NOT NULL THEN 'dem' END AS layer FROM h")
def elevations_of_customers(spark, sf_dir):
    points = on_tiles(spark, sf_dir)
    at = points.where("lat < 50").select(tile_of(F.col("lat"), F.col("lng"), F.lit(15)).alias("t"), tile_of(F.col("lat"), F.col("lng"), F.lit(14)).alias("u"))
    x, y = F.col("x"), F.col("y")
    fine, coarse = at.select("t.x", "t.y").distinct(), at.select("u.x", "u.y").distinct()
    kinds = [("dem5a", 15, fine.where((x + y) % 3 != 0)), ("dem5b", 15, fine.where((x + y) % 2 == 0)), ("dem", 14, coarse)]
    grids = [df.select(F.lit(layer).alias("layer"), F.lit(z).alias("z"), "x", "y", heights_of_tile(layer, F.lit(z), x, y).alias("cm")) for layer, z, df in kinds]
    folder = fresh_folder(spark, "tiles")
    tiles.write_tiles(reduce(DataFrame.unionByName, grids), folder)
    return tiles.elevations(points, tiles.read_tiles(spark, folder)).select("c_custkey", "elevation", "layer")


# ── Files of lines, and segments of them ──


@query("SELECT CAST(row_number() OVER (PARTITION BY c_nationkey % 3 ORDER BY c_custkey) - 1 AS BIGINT) AS line_no, c_name AS line FROM customer")
def numbered_lines_of_customers(spark, sf_dir):
    """Three files, read in splits of a few KB each."""
    path = fresh_folder(spark, "numbered")
    rows = read(spark, sf_dir, "customer").select((F.col("c_nationkey") % 3).alias("file"), "c_custkey", "c_name")
    rows.repartition("file").sortWithinPartitions("file", "c_custkey").select("file", F.concat("c_name", F.lit("\r")).alias("value")).write.partitionBy("file").text(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        return lines.numbered_lines(spark, path).select("line_no", "line")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@query(f"""WITH l AS (SELECT o_orderkey AS line_no, CASE WHEN o_orderkey % 20 = 0 THEN {listed(PROVINCES, 'o_custkey % 5')} END AS p, CASE WHEN o_orderkey % 20 IN (1, 2) THEN {listed(('乙訓郡', '葛野郡', '愛宕郡'), 'o_orderkey % 3')} END AS d FROM orders WHERE o_orderkey % 20 <> 4)
SELECT line_no, coalesce(last_value(p IGNORE NULLS) OVER w, '') AS province, coalesce(last_value(CASE WHEN p IS NOT NULL THEN '' ELSE d END IGNORE NULLS) OVER w, '') AS district FROM l
WINDOW w AS (ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def headings_of_one_volume(spark, sf_dir):
    """All lines are one volume, carried forward in segments of 256 lines."""
    rows = order_lines(spark, sf_dir).where("line_no % 20 <> 4").withColumn("volume", F.lit("all"))
    k = F.col("line_no")
    named = lambda when: F.when(when, F.regexp_extract("line", "^([^0-9]*?[國郡])", 1))
    out = paths.carry_forward(rows, ["volume"], ["line_no"], named(k % 20 == 0), named((k % 20).isin(1, 2)), paths.segment_of(k, 256))
    return out.select("line_no", F.col("outer").alias("province"), F.col("inner").alias("district"))


@query("""WITH p AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS e FROM events), d AS (SELECT e, e - lag(e) OVER (ORDER BY event_id) AS d FROM p)
SELECT 'all' AS path_id, round(sum(greatest(d, 0.0)) FILTER (WHERE d IS NOT NULL), 0) AS ascent_m, round(sum(greatest(-d, 0.0)) FILTER (WHERE d IS NOT NULL), 0) AS descent_m, count(e) / count(*) AS coverage FROM d""")
def climb_of_one_path(spark, sf_dir):
    """All events are one path, climbed in segments of 1,000 points."""
    points = read(spark, sf_dir, "events").select(F.lit("all").alias("path_id"), "event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("elevation"))
    out = paths.cumulative_elevation(points, "path_id", "event_id", segment=paths.segment_of(F.col("event_id"), 1000))
    return out.select("path_id", F.round("ascent_m", 0).alias("ascent_m"), F.round("descent_m", 0).alias("descent_m"), "coverage")


# ── Months: replayed, corrected, running ──


@query("""WITH e AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), m AS (SELECT unnest([{'month': 1, 'f': 1}, {'month': 2, 'f': 5}, {'month': 3, 'f': 3}]) AS x)
SELECT event_type || ' ' || CAST(user_id AS VARCHAR) AS title, CAST(2025 AS INTEGER) AS year, CAST(x.month AS INTEGER) AS month, CAST(n * x.f AS DOUBLE) AS views FROM e, m""")
def replayed_months(spark, sf_dir):
    """Three months, of which one comes twice and one is corrected later; a batch is applied twice and an old version comes last."""
    counts = kept(spread(read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))), "counts")
    user = F.col("user_id").cast("string")
    root = fresh_folder(spark, "months")

    def version(month: int, factor: int, day: int) -> DataFrame:
        line = F.concat_ws(" ", F.lit("ja.wikipedia"), F.concat("event_type", F.lit("_"), user), user, F.lit("user"), (F.col("n") * factor).cast("string"), F.lit("A1"))
        name, at = f"file:/dumps/{day}/pageviews-2025{month:02d}-user", F.to_timestamp(F.lit(f"2026-01-{day:02d} 00:00:00"))
        return pageviews.file_rows(counts.select(line.alias("value"), F.lit(name).alias("path"), at.alias("modified"), F.col("user_id").alias("at")))

    pageviews.upsert(spark, version(1, 1, 1).unionByName(version(2, 2, 1)), root, "a")
    pageviews.upsert(spark, version(1, 1, 1).unionByName(version(2, 2, 1)), root, "a")
    pageviews.upsert(spark, version(2, 5, 3).unionByName(version(3, 3, 3)), root, "b")
    pageviews.upsert(spark, version(1, 1, 1).unionByName(version(2, 2, 1)), root, "again")
    return pageviews.months_of(spark, root)


@query(f"WITH {RATIO_SQL} SELECT CAST(site_id AS VARCHAR) AS title, pv_base_median, pv_january, new_year_ratio, clipped FROM r")
def running_ratio(spark, sf_dir):
    """A state that years are merged into one after another, one of them wrong at first and then corrected."""
    months = priority.exclude_current_month(monthly(spark, sf_dir), *NOW).withColumn("title", F.col("site_id").cast("string"))
    root = fresh_folder(spark, "state")
    early, late = months.where("year < 1995"), months.where("year >= 1995")
    running.update(spark, root, running.delta(early))
    running.update(spark, root, running.delta(late.withColumn("views", F.col("views") + 3)))
    running.update(spark, root, running.merged(running.delta(late.withColumn("views", F.col("views") + 3), -1), running.delta(late)))
    # A title whose months count for neither season has no state, and so no ratio.
    rest = months.select("title").distinct()
    return rest.join(running.running_ratio(running.state_of(spark, root)), "title", "left").withColumn("clipped", F.coalesce("clipped", F.lit(False)))


def answers_as_files(spark: SparkSession, answers: DataFrame) -> str:
    """Writes answers (title, body) of a service as files, and returns the address under which the source asks for them."""
    import pyarrow as pa

    from keidai.sources.shared import ship

    folder = fresh_folder(spark, "answers")

    def write(batches):
        files, path = pageview_api.folder_of(folder)
        files.create_dir(path, recursive=True)
        n = 0
        for batch in batches:
            for title, body in zip(batch.column("title").to_pylist(), batch.column("body").to_pylist()):
                with files.open_output_stream(f"{path}/{title}") as f:
                    f.write(body.encode())
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    ship(spark)
    answers.select("title", "body").mapInArrow(write, "n long").agg(F.sum("n")).collect()
    return f"{folder if '://' in folder else 'file://' + folder}/{{title}}"


def answer(k: Column, months: tuple[int, ...]) -> Column:
    return F.to_json(F.struct(F.array(*[F.struct(F.lit(f"2026{m:02d}0100").alias("timestamp"), (k * 100 + m).alias("views")) for m in months]).alias("items")))


@query("""WITH m AS (SELECT unnest([1, 2, 3]) AS month) SELECT s_name AS title, CAST(2026 AS INTEGER) AS year, CAST(month AS INTEGER) AS month, CAST(s_suppkey * 100 + month AS BIGINT) AS views FROM supplier, m WHERE s_suppkey % 5 <> 0""")
def views_of_suppliers(spark, sf_dir):
    """Answers of a service as files that the source asks for by address; a title without an answer isn't known."""
    k = F.col("s_suppkey")
    supplier = read(spark, sf_dir, "supplier")
    service = answers_as_files(spark, supplier.where(k % 5 != 0).select(F.col("s_name").alias("title"), answer(k, (1, 2, 3)).alias("body")))
    return pageview_api.read_pageviews_api(supplier.select(F.col("s_name").alias("title")), fresh_folder(spark, "spool"), "2026010100", "2026030100", service=service, spacing=0, lanes=4)


@query("""WITH t AS (SELECT n_nationkey AS k, n_name AS title, unnest([1, 2]) AS month FROM nation) SELECT title, CAST(2026 AS INTEGER) AS year, CAST(month AS INTEGER) AS month, CAST(100 * k + month AS BIGINT) AS views FROM t WHERE k % 5 <> 0""")
def months_of_an_api(spark, sf_dir):
    """Nations asked twice with one spool: first only some have an answer, then the others are asked, and none again."""
    k = F.col("n_nationkey")
    nation = read(spark, sf_dir, "nation")
    service = answers_as_files(spark, nation.where(k % 5 != 0).select(F.col("n_name").alias("title"), answer(k, (1, 2)).alias("body")))
    spool, titles = fresh_folder(spark, "spool"), nation.select(k, F.col("n_name").alias("title"))
    ask = lambda rows: pageview_api.read_pageviews_api(rows, spool, "2026010100", "2026020100", service=service, spacing=0)
    ask(titles.where(k % 2 == 0)).write.format("noop").mode("overwrite").save()
    return ask(titles)


# ── Gaps, masters, publication ──


@query(f"""WITH r(i, name, a, b) AS (VALUES {GAP_REGIONS}), m(j, major) AS (VALUES {GAP_MAJORS}),
c AS (SELECT c_custkey AS id, 1 + c_custkey % 60 AS p, c_custkey % 10 AS m1, (c_custkey // 10) % 10 AS m2, c_custkey % 4 < 2 AS free, c_custkey % 7 = 0 AS stamp FROM customer WHERE c_custkey % 60 NOT IN (3, 4, 30, 31, 32, 33, 34) AND c_custkey % 60 < 36),
x AS (SELECT c.*, r.i, r.name FROM c JOIN r ON c.p BETWEEN r.a AND r.b),
y AS (SELECT DISTINCT id, i, unnest([m1, m2]) AS j FROM x)
SELECT 'geography' AS kind, CAST(0 AS INTEGER) AS o0, i AS o1, p AS o2, CAST(0 AS INTEGER) AS o3, (SELECT count(*) FROM c WHERE c.p = g.p) AS count FROM (SELECT i, CAST(unnest(range(a, b + 1)) AS INTEGER) AS p FROM r) g WHERE (SELECT count(*) FROM c WHERE c.p = g.p) < 3
UNION ALL SELECT 'benefit', 1, r.i, 0, m.j, (SELECT count(*) FROM y WHERE y.i = r.i AND y.j = m.j) FROM r, m WHERE (SELECT count(*) FROM y WHERE y.i = r.i AND y.j = m.j) < 1
UNION ALL SELECT 'access', 1, r.i, 1, 0, (SELECT count(*) FROM x WHERE x.i = r.i AND free) FROM r WHERE (SELECT count(*) FROM x WHERE x.i = r.i AND free) < 3
UNION ALL SELECT 'goshuin', 1, r.i, 2, 0, (SELECT count(*) FROM x WHERE x.i = r.i AND stamp) FROM r WHERE (SELECT count(*) FROM x WHERE x.i = r.i AND stamp) < 3""")
def region_gaps(spark, sf_dir):
    k = F.col("c_custkey")
    major = lambda j: F.struct(pick(gaps.MAJORS, j).alias("major_id"), F.lit("primary").alias("weight"))
    mode = pick(("TRAIN_ONLY", "TRAIN_BUS", "CAR_ONLY", "UNKNOWN"), k % 4)
    sites = read(spark, sf_dir, "customer").where(~(k % 60).isin(3, 4, 30, 31, 32, 33, 34) & (k % 60 < 36)).select(
        k.alias("id"), F.lpad((1 + k % 60).cast("string"), 2, "0").alias("prefecture_code"), F.array(major(k % 10), major(F.floor(k / 10) % 10), F.struct(F.lit("enmusubi").alias("major_id"), F.lit("secondary").alias("weight"))).alias("benefits"),
        mode.alias("access_mode"), F.when(k % 7 == 0, "yes").otherwise("no").alias("goshuin_available"),
    )
    return gaps.small_cells(sites).select("kind", "o0", "o1", "o2", "o3", "count")


def master_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Master tables of the benchmark's: nations as majors, parts as minors, suppliers as clusters, customers as mappings and overrides, orders as groups."""
    c = F.col
    text = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    n, p, s, u, o = (c(k) for k in ("n_nationkey", "p_partkey", "s_suppkey", "c_custkey", "o_orderkey"))
    customer = read(spark, sf_dir, "customer")
    none = F.lit(None).cast("string")
    return {
        "majors": read(spark, sf_dir, "nation").where(n < 9).select(n.cast("int").alias("ord"), F.when(n < 7, pick(gaps.MAJORS, n)).otherwise(text("x", n)).alias("id"), c("n_name").alias("label")),
        "minors": read(spark, sf_dir, "part").select(p.cast("int").alias("ord"), F.when(p % 7 == 0, "zz").otherwise(pick(gaps.MAJORS, p % 10)).alias("major_id"), text("b", p % 500).alias("id"), c("p_name").alias("label")),
        "clusters": read(spark, sf_dir, "supplier").select(
            s.cast("int").alias("ord"), text("c", F.when(s % 11 == 0, s - 1).otherwise(s)).alias("id"), text("神", s).alias("label"), F.lit("shinto").alias("religion"), F.array().cast("array<string>").alias("qids"),
            F.array(text("別名", s % 40), F.concat(text("社", s % 30), pick(("大神", "命", "神"), s % 3))).alias("aliases"), none.alias("benefit_policy"),
        ),
        "mappings": customer.where(u % 4 != 0).select(
            u.cast("int").alias("ord"), text("c", F.floor(u / 2)).alias("cluster"), F.when(u % 5 == 0, F.array().cast("array<string>")).when(u % 5 == 1, F.array(text("b", u % 700), text("b", u % 7), text("b", u % 9 + 20))).otherwise(F.array(text("b", u % 700))).alias("primary"),
            F.array(text("b", u % 3 + 500 * F.when(u % 13 == 0, 1).otherwise(0)), text("b", u % 7)).alias("secondary"), F.when(u % 6 == 0, "NO_AUTO_MAPPING").alias("policy"),
        ),
        "overrides": customer.select(
            u.cast("int").alias("ord"), text("s", u).alias("site_key"), c("c_name").alias("name"), F.lit(2).alias("bow_before"), F.lit(2).alias("clap"), F.lit(1).alias("bow_after"), c("c_mktsegment").alias("label"), none.alias("notes"),
            F.when(u % 3 == 0, "http://s").when(u % 3 == 1, "").alias("source_url"), F.when(u % 4 == 0, "pending").otherwise("official").alias("source_type"), F.when(u % 5 == 0, "PENDING_VERIFICATION").alias("status"), none.alias("verified_at"),
        ),
        "groups": read(spark, sf_dir, "orders").select(
            o.cast("int").alias("ord"), text("g", F.floor(o / 3)).alias("id"), F.when(o % 8 == 0, "odd").when(o % 8 == 1, "sandai").otherwise("local").alias("kind"), c("o_orderpriority").alias("name"), F.when(o % 4 != 0, 8).alias("total_count"), none.alias("region"),
            (o % 2 == 0).alias("numbered"), (o % 3 == 0).alias("disputed"), none.alias("source_url"),
        ),
    }


MAJOR_LIST = ", ".join(gaps.MAJORS)
MASTER_SQL = f"""
ma AS (SELECT n_nationkey AS ord, CASE WHEN n_nationkey < 7 THEN {listed(gaps.MAJORS, 'n_nationkey')} ELSE 'x' || n_nationkey END AS id FROM nation WHERE n_nationkey < 9),
mi AS (SELECT p_partkey AS ord, CASE WHEN p_partkey % 7 = 0 THEN 'zz' ELSE 'ok' END AS major_id, 'b' || (p_partkey % 500) AS id FROM part),
cl AS (SELECT s_suppkey AS ord, 'c' || CASE WHEN s_suppkey % 11 = 0 THEN s_suppkey - 1 ELSE s_suppkey END AS id, '神' || s_suppkey AS label, '別名' || (s_suppkey % 40) AS a1, '社' || (s_suppkey % 30) || {listed(('大神', '命', '神'), 's_suppkey % 3')} AS a2, '社' || (s_suppkey % 30) AS k2 FROM supplier),
al AS (SELECT ord, 0 AS pos, id, label AS alias, label AS key FROM cl UNION ALL SELECT ord, 1, id, a1, a1 FROM cl UNION ALL SELECT ord, 2, id, a2, k2 FROM cl),
mp AS (SELECT c_custkey AS ord, 'c' || (c_custkey // 2) AS cluster, CASE c_custkey % 5 WHEN 0 THEN [] WHEN 1 THEN ['b' || (c_custkey % 700), 'b' || (c_custkey % 7), 'b' || (c_custkey % 9 + 20)] ELSE ['b' || (c_custkey % 700)] END AS pr,
       ['b' || (c_custkey % 3 + CASE WHEN c_custkey % 13 = 0 THEN 500 ELSE 0 END), 'b' || (c_custkey % 7)] AS se, CASE WHEN c_custkey % 6 = 0 THEN 'p' END AS policy FROM customer WHERE c_custkey % 4 <> 0),
us AS (SELECT cluster, 'primary' AS kind, unnest(pr) AS b FROM mp UNION ALL SELECT cluster, 'secondary', unnest(se) FROM mp),
ov AS (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS label, c_custkey % 3 = 0 AS sourced, c_custkey % 4 = 0 AS pending, c_custkey % 5 = 0 AS open FROM customer),
gr AS (SELECT o_orderkey AS ord, 'g' || (o_orderkey // 3) AS id, o_orderkey % 8 AS k, o_orderkey % 4 = 0 AS no_total, o_orderkey % 2 = 0 AS numbered, o_orderkey % 3 = 0 AS disputed FROM orders),
ow AS (SELECT alias, arg_min(id, {{'a': ord, 'b': pos}}) AS owner FROM al GROUP BY 1),
ok AS (SELECT key, arg_min({{'id': id, 'alias': alias}}, {{'a': ord, 'b': pos}}) AS o FROM al GROUP BY 1),
i AS (
SELECT 'V1' AS rule, 'error' AS severity, 'benefits.yaml' AS file, '未知の大分類ID "' || id || '"。許可されるのは {MAJOR_LIST}' AS message FROM ma WHERE ord >= 7
UNION ALL SELECT 'V2', 'error', 'benefits.yaml', '細分類ID "' || id || '" が重複しています' FROM (SELECT id, row_number() OVER (PARTITION BY id ORDER BY ord) AS n FROM mi WHERE major_id = 'ok') WHERE n > 1
UNION ALL SELECT 'V3', 'error', 'benefits.yaml', '大分類が欠けています: {", ".join(gaps.MAJORS[7:])}'
UNION ALL SELECT 'V4', 'error', 'deity_clusters.yaml', 'クラスタID "' || id || '" が重複しています' FROM (SELECT id, row_number() OVER (PARTITION BY id ORDER BY ord) AS n FROM cl) WHERE n > 1
UNION ALL SELECT 'V5', 'warning', 'deity_clusters.yaml', '別名 "' || alias || '" が ' || owner || ' と ' || id || ' の両方にあります。先に定義された ' || owner || ' が優先されます' FROM al JOIN ow USING (alias) WHERE id <> owner
UNION ALL SELECT 'V5b', 'warning', 'deity_clusters.yaml', '別名 "' || alias || '" の正規形が ' || o.id || ' と重なります' FROM al JOIN ok USING (key) WHERE al.id <> o.id AND alias <> o.alias
UNION ALL SELECT 'V6', 'error', 'cluster_benefits.yaml', 'クラスタ "' || cluster || '" が deity_clusters.yaml に存在しません' FROM mp WHERE cluster NOT IN (SELECT id FROM cl)
UNION ALL SELECT 'V7', 'error', 'cluster_benefits.yaml', 'クラスタ "' || cluster || '" の割り当てが重複しています' FROM (SELECT cluster, row_number() OVER (PARTITION BY cluster ORDER BY ord) AS n FROM mp) WHERE n > 1
UNION ALL SELECT 'V8', 'error', 'cluster_benefits.yaml', cluster || '.' || kind || ' の御利益ID "' || b || '" が benefits.yaml に存在しません' FROM us WHERE b NOT IN (SELECT id FROM mi WHERE major_id = 'ok')
UNION ALL SELECT 'V9', 'error', 'cluster_benefits.yaml', cluster || ': "' || b || '" が primary と secondary の両方にあります' FROM (SELECT cluster, unnest(list_distinct([x FOR x IN pr IF list_contains(se, x)])) AS b FROM mp)
UNION ALL SELECT 'V10', 'warning', 'cluster_benefits.yaml', cluster || ': primary が ' || len(pr) || ' 件あります。設計方針は「1〜2個だけ」です' FROM mp WHERE policy IS NULL AND len(pr) > 2
UNION ALL SELECT 'V11', 'warning', 'cluster_benefits.yaml', cluster || ': primary が空です。検索に一切出てきません' FROM mp WHERE policy IS NULL AND len(pr) = 0
UNION ALL SELECT 'V12', 'warning', 'deity_clusters.yaml', 'クラスタ "' || id || '" に御利益の割り当てがありません。この祭神からは何も導出されません' FROM cl WHERE id NOT IN (SELECT cluster FROM mp)
UNION ALL SELECT 'V13', 'error', 'etiquette_overrides.yaml', name || ': source_type が official なのに source_url がありません' FROM ov WHERE NOT pending AND NOT sourced
UNION ALL SELECT 'V14', 'warning', 'etiquette_overrides.yaml', name || ': source_url があるのに pending のままです。official に昇格させてください' FROM ov WHERE pending AND sourced
UNION ALL SELECT 'V15', 'warning', 'etiquette_overrides.yaml', name || ': 一次情報の裏取りが未了です（' || label || ' は表示されません）' FROM ov WHERE open
UNION ALL SELECT 'V16', 'error', 'pilgrimage_groups.yaml', 'グループID "' || id || '" が重複しています' FROM (SELECT id, row_number() OVER (PARTITION BY id ORDER BY ord) AS n FROM gr) WHERE n > 1
UNION ALL SELECT 'V16', 'error', 'pilgrimage_groups.yaml', id || ': 未知の kind "odd"' FROM gr WHERE k = 0
UNION ALL SELECT 'V17', 'warning', 'pilgrimage_groups.yaml', id || ': numbered なのに total_count がありません。収録率を管理できません' FROM gr WHERE numbered AND no_total
UNION ALL SELECT 'V17', 'warning', 'pilgrimage_groups.yaml', id || ': kind が sandai です。諸説あるなら disputed: true を付けてください' FROM gr WHERE k = 1 AND NOT disputed)
"""


@query(f"WITH {MASTER_SQL} SELECT * FROM i")
def issues_of_tables(spark, sf_dir):
    return masters.validate(master_tables(spark, sf_dir))


@query(f"""WITH {MASTER_SQL} SELECT 'majors' AS name, count(*) AS n FROM ma UNION ALL SELECT 'minors', count(*) FROM mi UNION ALL SELECT 'clusters', count(*) FROM cl UNION ALL SELECT 'mappings', count(*) FROM mp
UNION ALL SELECT 'overrides', count(*) FROM ov UNION ALL SELECT 'groups', count(*) FROM gr UNION ALL SELECT 'suppressed', count(*) FROM mp WHERE policy IS NOT NULL""")
def summary_of_tables(spark, sf_dir):
    return masters.summary(master_tables(spark, sf_dir)).withColumnRenamed("table", "name")


@query("SELECT o_orderpriority AS title, count(*) AS orders, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS done FROM orders GROUP BY 1")
def published_outputs(spark, sf_dir):
    """Two outputs published as one; a publication that fails half-way leaves them as they were."""
    orders, root = read(spark, sf_dir, "orders"), fresh_folder(spark, "published")
    outputs = lambda df: {"all": df.groupBy("o_orderpriority").count(), "done": df.where("o_orderstatus = 'F'").groupBy("o_orderpriority").count()}
    versions.publish(spark, root, outputs(orders))
    broken = orders.where("o_orderkey % 2 = 0")
    failing = broken.select("o_orderpriority", F.raise_error(F.lit("fails half-way")).alias("x"))
    try:
        versions.publish(spark, root, outputs(broken) | {"last": failing})
    except Exception as e:
        if "fails half-way" not in str(e):
            raise
    a, b = versions.current(spark, root, "all"), versions.current(spark, root, "done")
    return a.withColumnRenamed("count", "orders").join(b.withColumnRenamed("count", "done"), "o_orderpriority", "left").select(F.col("o_orderpriority").alias("title"), "orders", F.coalesce("done", F.lit(0)).cast("long").alias("done"))


# ── Table functions and rules ──


@query(f"""WITH k AS (SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS k FROM part), e AS (SELECT p_partkey, unnest([{{'pos': 0, 'said': '甲' || k}}, {{'pos': 1, 'said': '乙'}}, {{'pos': 2, 'said': '[[M' || k || ']]'}}, {{'pos': 3, 'said': '[[N]]'}}]) AS x FROM k)
SELECT p_partkey, CAST(x.pos AS INTEGER) AS pos, x.said AS entry, nullif({listed(('tai', 'sho', 'myojin_tai', 'myojin_tai', '', 'tai'), 'p_partkey % 6')}, '') AS rank, p_partkey % 6 IN (0, 2, 3) AS tsukinami, CASE WHEN p_partkey % 6 = 3 THEN 'kanpei' END AS offering FROM e""")
def entries_in_sql(spark, sf_dir):
    """Table functions in one SQL statement, each joined LATERAL to the row it reads."""
    register_tables(spark)
    read(spark, sf_dir, "part").select("p_partkey", pick(NOTES, F.col("p_partkey") % 6).alias("note")).createOrReplaceTempView("keidai_notes")
    return spark.sql("""
        WITH f AS (SELECT p_partkey, note, concat('甲', p_partkey, '<br　/>乙、[[M', p_partkey, ']]　・　[[N]]、　') AS field FROM keidai_notes)
        SELECT f.p_partkey, e.pos, e.entry, n.rank, n.tsukinami, n.offering FROM f, LATERAL entries(f.field) e, LATERAL registry_note(f.note) n""")


@query("""WITH r AS (SELECT s_suppkey AS ord, CASE WHEN s_suppkey % 3 = 0 THEN substr(md5(CAST(s_suppkey AS VARCHAR)), 1, 3) WHEN s_suppkey % 3 = 1 THEN substr(md5(CAST(s_suppkey AS VARCHAR)), 1, 5) ELSE substr(md5(CAST(s_suppkey AS VARCHAR)), 1, 2) END AS pattern FROM supplier),
t AS (SELECT p_partkey, CASE WHEN p_partkey % 17 <> 0 THEN md5(CAST(p_partkey AS VARCHAR)) || md5(p_name) END AS text FROM part)
SELECT p_partkey, min(ord) AS ord FROM t LEFT JOIN r ON contains(t.text, r.pattern) GROUP BY 1""")
def first_rules_of_parts(spark, sf_dir):
    k = F.col("s_suppkey")
    digest = F.md5(k.cast("string").cast("binary"))
    table = read(spark, sf_dir, "supplier").select(k.alias("ord"), F.when(k % 3 == 0, F.substring(digest, 1, 3)).when(k % 3 == 1, F.substring(digest, 1, 5)).otherwise(F.substring(digest, 1, 2)).alias("pattern"))
    texts = read(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 17 != 0, F.concat(F.md5(F.col("p_partkey").cast("string").cast("binary")), F.md5(F.col("p_name").cast("binary")))).alias("text"))
    return rules.first_rule(texts, "text", table, ["p_partkey"])
