"""Incremental ingestion of page-view dumps into monthly rows: appended once for each file, or kept by month so that repeats and corrections count once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keidai.functions.joins import small_side
from keidai.sources.dumps import parse_pageview_line
from keidai.sources.shared import kept
from keidai.sources.versions import current_parts, manifest, publish_parts

#: Year and month in the name of a dump, which is a file or a folder of part files.
FILE = r"(\d{4})-?(\d{2})[^/]*(?:/part-[^/]*)?$"
NAME = r"([^/]*)$"
#: Rows of a month: each file's views of a title, with which version of the file they are from.
MONTH = "month string, file string, modified timestamp, path string, title string, page_id string, views double"
BATCH = "batch="


def monthly_rows(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of title, page_id, year, month, views over a folder of dumps whose names hold their month."""
    lines = spark.readStream.format("text").option("recursiveFileLookup", "true").load(folder).select("value", F.col("_metadata.file_path").alias("path"))
    rows = lines.select(parse_pageview_line(F.col("value")).alias("r"), "path").where("r IS NOT NULL")
    part = lambda i: F.regexp_extract("path", FILE, i).try_cast("int")
    return rows.select(F.replace("r.title", F.lit("_"), F.lit(" ")).alias("title"), "r.page_id", part(1).alias("year"), part(2).alias("month"), "r.views")


def ingest(spark: SparkSession, folder: str, target: str, checkpoint: str) -> None:
    """Reads the files that came since the last call and appends their rows to `target`, by month; ends when all are read."""
    query = monthly_rows(spark, folder).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).partitionBy("year", "month").trigger(availableNow=True).start()
    query.awaitTermination()


def file_rows(lines: DataFrame, agg: str = "last") -> DataFrame:
    """Lines (value, path, modified, at: their order) of dump files as rows of months: a title on several lines of a file keeps the last one's views; agg="sum" adds them."""
    month = F.concat_ws("-", F.regexp_extract("path", FILE, 1), F.regexp_extract("path", FILE, 2))
    rows = lines.where(F.col("path").rlike(FILE)).select(parse_pageview_line(F.col("value")).alias("r"), "path", "modified", "at").where("r IS NOT NULL")
    rows = rows.select(month.alias("month"), F.regexp_extract("path", NAME, 1).alias("file"), "modified", "path", F.replace("r.title", F.lit("_"), F.lit(" ")).alias("title"), "r.page_id", "r.views", "at")
    views = F.sum("views") if agg == "sum" else F.max_by("views", "at")
    found = rows.groupBy("month", "file", "modified", "path", "title").agg(F.max_by("page_id", "at").alias("page_id"), views.alias("views"))
    return found.select("month", "file", "modified", "path", "title", "page_id", "views")


VERSION = ["month", "file", "modified", "path"]


def latest(rows: DataFrame) -> DataFrame:
    """Of each month's files of one name only the version that was modified last."""
    versions = rows.groupBy("month", "file").agg(F.max(F.struct("modified", "path")).alias("v")).select("month", "file", "v.modified", "v.path")
    return rows.join(small_side(versions), VERSION, "left_semi")


def upsert(spark: SparkSession, rows: DataFrame, root: str, batch: str) -> bool:
    """Puts rows of months into the table at `root`: only their months are written anew, all of them become current at once, and the batch is noted with them.

    A batch that is noted isn't applied again. Whatever comes again under another name of the batch changes nothing either: a file counts
    once, by its name, in the version modified last, in whatever order versions come. Returns whether the batch was applied.
    """
    if f"{BATCH}{batch}" in manifest(spark, root):
        return False
    rows = kept(rows.select(*[c.split()[0] for c in MONTH.split(", ")]), "batch")  # parsed once, however often months and versions are asked for
    months = {r["month"] for r in rows.select("month").distinct().collect()}  # the months of one batch
    again = small_side(rows.select(*VERSION).distinct())  # versions that are there already count once
    both = current_parts(spark, root, "month", MONTH, months).join(again, VERSION, "left_anti").unionByName(rows)
    publish_parts(spark, root, "month", latest(both), "month", note={f"{BATCH}{batch}": {"months": sorted(months)}})
    return True


def ingest_months(spark: SparkSession, folder: str, root: str, checkpoint: str, stream: str = "dumps", agg: str = "last") -> None:
    """Reads the dump files that came since the last call into the table of months; ends when all are read.

    A batch that failed is run again by the stream, and one that had been applied before its failure isn't applied twice.
    """

    def apply(batch: DataFrame, number: int) -> None:
        upsert(spark, file_rows(batch.withColumn("at", F.monotonically_increasing_id()), agg), root, f"{stream}-{number}")

    lines = spark.readStream.format("text").option("recursiveFileLookup", "true").load(folder)
    lines = lines.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"))
    lines.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def months_of(spark: SparkSession, root: str, only: set[str] | None = None) -> DataFrame:
    """title, year, month, views of the current months: a title's views are added over a month's files."""
    part = lambda i: F.substring_index("month", "-", i).cast("int")
    rows = current_parts(spark, root, "month", MONTH, only)
    return rows.groupBy("title", "month").agg(F.sum("views").alias("views")).select("title", part(1).alias("year"), part(-1).alias("month"), "views")

