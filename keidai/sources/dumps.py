"""Readers of dumps and lists, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keidai.functions.joins import small_side
from keidai.functions.text import WHITE, body_text, encode_component, file_name, js_trim, once

# Titles by work.
CLASSICAL_TITLES = {
    "engishiki": ["延喜式/卷第九", "延喜式/卷第十"],
    "fudoki": ["古風土記/出雲國風土記", "古風土記/常陸國風土記", "古風土記/播磨國風土記", "古風土記/肥前國風土記", "古風土記/豐後國風土記"],
    "kiki": ["古事記", "日本書紀"],
    "rikkokushi": ["日本書紀", "續日本紀", "日本後紀", "續日本後紀", "日本文德天皇實錄", "日本三代實錄"],
}
PAGE = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("revision", T.StructType([T.StructField("text", T.StringType())])),
])


def classical_titles(spark: SparkSession) -> DataFrame:
    """title: every work's pages once."""
    rows = [(w, t) for w, titles in CLASSICAL_TITLES.items() for t in titles]
    return spark.createDataFrame(rows, "work string, title string").select("title").distinct()


def xml_pages(spark: SparkSession, path: str, titles: DataFrame | None = None) -> DataFrame:
    """title, text, bytes of a page dump (plain or .bz2), of the wanted titles only. Of pages with one title the one last in the file stays."""
    pages = (
        spark.read.format("xml").option("rowTag", "page").option("ignoreSurroundingSpaces", "false").schema(PAGE).load(path)
        .select("title", F.col("revision.text").alias("text"), F.monotonically_increasing_id().alias("at"))
    )
    if titles is not None:
        pages = pages.join(titles.distinct(), "title", "left_semi")
    last = pages.groupBy("title").agg(F.max_by("text", "at").alias("text"))
    return last.select("title", F.coalesce("text", F.lit("")).alias("text"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"))


def title_list(spark: SparkSession, path: str) -> DataFrame:
    """title: lines of a list, trimmed, without blank ones and those that start with #."""
    lines = spark.read.text(path).select(js_trim(F.col("value")).alias("title"))
    return lines.where((F.col("title") != "") & ~F.col("title").startswith("#"))


def volumes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """volume, line_no, line of text files, each a volume of its own."""
    whole = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("volume"), "value")
    return whole.select("volume", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))


def sites_json(spark: SparkSession, path: str, site: T.StructType) -> DataFrame:
    """Sites of a JSON file that is an array of them, or an object with them under `sites`."""
    wrapped = spark.read.schema(T.StructType([T.StructField("sites", T.ArrayType(site)), *site.fields])).json(path, multiLine=True)
    direct = wrapped.where(F.col("sites").isNull()).select(*site.fieldNames())
    return direct.unionByName(wrapped.where(F.col("sites").isNotNull()).selectExpr("inline(sites)"))


# ── Page views ──


def parse_pageview_line(line: Column, wiki: str = "ja.wikipedia", agent: str = "user") -> Column:
    """Struct title, page_id, views of a dump line; null for blank lines, comments, other wikis and agents, and totals that are no number.

    A line of fewer than five columns raises an error whatever it is of: the format has changed then.
    """
    def of(trimmed: Column, parts: Column) -> Column:
        at = lambda i: F.get(parts, F.lit(i))
        total = at(4).try_cast("double")
        fine = (at(0) == wiki) & (at(3) == agent) & total.isNotNull() & (F.abs(total) < F.lit(float("inf")))
        row = F.struct(at(1).alias("title"), at(2).alias("page_id"), total.alias("views"))
        broken = F.raise_error(F.concat(F.lit("page-view line with fewer than 5 columns: "), F.substring(trimmed, 1, 200)))
        return F.when((trimmed == "") | trimmed.startswith("#"), None).when(F.size(parts) < 5, broken.cast(row_type())).when(fine, row)

    return once(js_trim(line), lambda trimmed: once(F.split(trimmed, f"[{WHITE}]+"), lambda parts: of(trimmed, parts)))


def row_type() -> T.StructType:
    return T.StructType([T.StructField("title", T.StringType()), T.StructField("page_id", T.StringType()), T.StructField("views", T.DoubleType())])


def scan_pageviews(lines: DataFrame, titles: DataFrame, year: int, month: int, agg: str = "last") -> DataFrame:
    """title, year, month, views of the wanted titles, from lines (at, value). A title with blanks for underscores is tried first, then as it is.

    A title on several lines keeps the last one's views; agg="sum" adds them.
    """
    rows = lines.select("at", parse_pageview_line(F.col("value")).alias("r")).where("r IS NOT NULL").select("at", "r.title", F.replace("r.title", F.lit("_"), F.lit(" ")).alias("spaced"), "r.views")
    want = titles.select("title").where("title IS NOT NULL").distinct()
    # A dump has a thousand times more lines than wanted titles: one semi join on either spelling, broadcast if the titles are few, leaves those that may be wanted.
    t, first = small_side(want.select(F.col("title").alias("t"))), small_side(want.select(F.col("title").alias("first")))
    near = rows.withColumn("t", F.explode(F.array_distinct(F.array("spaced", "title")))).join(t, "t", "left_semi")
    # Of a line that both spellings name, the one with blanks counts.
    found = near.join(first, F.col("spaced") == F.col("first"), "left").where((F.col("t") == F.col("spaced")) | F.col("first").isNull()).select(F.col("t").alias("title"), "at", "views")
    total = F.sum("views") if agg == "sum" else F.max_by("views", "at")
    return found.groupBy("title").agg(total.alias("views")).select("title", F.lit(year).alias("year"), F.lit(month).alias("month"), "views")


def read_pageviews(spark: SparkSession, path: str, titles: DataFrame, year: int, month: int, agg: str = "last") -> DataFrame:
    """scan_pageviews() over a dump file, plain or .bz2."""
    return scan_pageviews(spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), "value"), titles, year, month, agg)


def accumulate_months(spark: SparkSession, dump_files: list[tuple[str, int, int]], titles: DataFrame, agg: str = "last") -> DataFrame:
    """title, year, month, views over several monthly dumps (path, year, month): each is scanned on its own, so a title has a row for each dump that names it."""
    if not dump_files:
        return spark.createDataFrame([], "title string, year int, month int, views double")
    parts = [read_pageviews(spark, path, titles, year, month, agg) for path, year, month in dump_files]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def month_range(y1: Column, m1: Column, y2: Column, m2: Column) -> Column:
    """Struct start, end: YYYYMM0100 of two months."""
    stamp = lambda y, m: F.format_string("%d%02d0100", y, m)
    return F.struct(stamp(y1, m1).alias("start"), stamp(y2, m2).alias("end"))


def pageview_url(title: Column, start: Column, end: Column, project: str = "ja.wikipedia") -> Column:
    return F.concat(
        F.lit(f"https://wikimedia.org/api/rest_v1/metrics/pageviews/per-article/{project}/all-access/user/"), encode_component(F.replace(title, F.lit(" "), F.lit("_"))), F.lit("/monthly/"), start, F.lit("/"), end
    )


def parse_pageview_response(body: Column) -> Column:
    """Array of struct year, month, views of an API answer."""
    items = F.from_json(body, "items array<struct<timestamp:string,views:bigint>>")["items"]
    return F.transform(items, lambda x: F.struct(F.substring(x["timestamp"], 1, 4).cast("int").alias("year"), F.substring(x["timestamp"], 5, 2).cast("int").alias("month"), x["views"].alias("views")))


class FetchError(RuntimeError):
    pass


def fetch_with_retry(url: str, fetch, sleep, retries: int = 3, first_wait: float = 15.0) -> str | None:
    """The body that fetch(url) -> (status, body) gives; None on 404. Other failures wait 15, 45, 135 s and try again, then raise."""
    for attempt in range(retries + 1):
        status, body = fetch(url)
        if 200 <= status < 300:
            return body
        if status == 404:
            return None
        if attempt < retries:
            sleep(first_wait * 3**attempt)
    raise FetchError(f"{url}: no answer after {retries} retries (status {status})")


def fetch_views(spark: SparkSession, urls: list[tuple[str, str]], fetch, sleep, spacing: float = 6.0) -> DataFrame:
    """title, year, month, views for (title, url) pairs, one request after another: the service limits the rate, so this isn't distributed."""
    bodies = []
    for i, (title, url) in enumerate(urls):
        if i:
            sleep(spacing)
        bodies.append((title, fetch_with_retry(url, fetch, sleep)))
    df = spark.createDataFrame(bodies, "title string, body string").where("body IS NOT NULL")
    return df.select("title", F.inline(parse_pageview_response(F.col("body"))))


# ── Sinks ──


def missing_titles(wanted: DataFrame, found: DataFrame) -> DataFrame:
    return wanted.select("title").distinct().join(found.select("title"), "title", "left_anti")


# What the outputs say of themselves.
EXTRACT_META = {"source": "zh.wikisource dump", "rights": "原文はパブリックドメイン。校勘注は CC BY-SA 4.0", "note": ".raw.txt は校勘注つきの原データ、.txt は注を落とした本文"}
REGISTRY_META = {"source": "延喜式 巻第九・巻第十（神名帳）", "sourceUrl": "https://zh.wikisource.org/wiki/延喜式/卷第九", "rights": "原文はパブリックドメイン"}
PRIORITY_META = {"note": "★収録優先度は内部の作業順。D1 の公開テーブルにも API にも載せないこと", "source": "Wikipedia pageviews (CC0)"}


def write_meta(spark: SparkSession, meta: dict[str, str], path: str, stats: DataFrame | None = None) -> None:
    """One JSON row that says what an output is, with the columns of a one-row table of figures."""
    row = spark.range(1).select(F.current_timestamp().alias("generatedAt"), *[F.lit(v).alias(k) for k, v in meta.items()])
    (row if stats is None else row.crossJoin(stats)).write.mode("overwrite").json(path)


def write_pages(pages: DataFrame, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """Writes pages (title, text, bytes) as JSON under `path`/pages with a file-safe name, the raw text and the body without notes each; returns the manifest.

    The manifest (title, file, bytes, found) is written to `path`/manifest; wanted titles that no page has are in it with found false.
    """
    named = pages.withColumns({"file": F.concat(file_name(F.col("title")), F.lit(".txt")), "body": body_text(F.col("text"))})
    named.write.mode("overwrite").json(f"{path}/pages")
    manifest = named.select("title", "file", "bytes", F.lit(True).alias("found"))
    if wanted is not None:
        gone = missing_titles(wanted, pages)
        manifest = manifest.unionByName(gone.select("title", F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("bytes"), F.lit(False).alias("found")))
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    write_meta(pages.sparkSession, EXTRACT_META, f"{path}/meta")
    return manifest


def write_registry(shrines: DataFrame, unparsed: DataFrame, stats: DataFrame, path: str) -> None:
    """The registry as JSON: shrines with the sentence of their facts, lines that weren't parsed, and figures with what the source is."""
    from keidai.operators.registry import describe

    shrines.withColumn("description", describe()).write.mode("overwrite").json(f"{path}/shrines")
    unparsed.write.mode("overwrite").json(f"{path}/unparsed")
    write_meta(shrines.sparkSession, REGISTRY_META, f"{path}/meta", stats)


def write_priorities(priorities: DataFrame, path: str, year: int, month: int, base_months: tuple[int, ...] = (3, 4, 6, 7)) -> None:
    """Priorities as JSON, with the note that they are internal, the base months and the month that was left out as it isn't over."""
    priorities.write.mode("overwrite").json(f"{path}/priorities")
    meta = {**PRIORITY_META, "baseMonths": ",".join(map(str, base_months)), "excludedCurrentMonth": f"{year}-{month}"}
    write_meta(priorities.sparkSession, meta, f"{path}/meta")
