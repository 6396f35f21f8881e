"""Monthly page views from a REST service, as a Spark data source that keeps to the service's rate and can be resumed."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from keidai.sources.shared import fresh_folder, ship

SERVICE = "https://wikimedia.org/api/rest_v1/metrics/pageviews/per-article/{project}/all-access/user/{title}/monthly/{start}/{end}"
AGENT = "keidai (batch page views)"
SPACING, RETRIES, FIRST_WAIT, WAIT_FACTOR = 6.0, 3, 15.0, 3
PREFIX = "answer-"


class NoAnswer(RuntimeError):
    pass


def http(url: str) -> tuple[int, str]:
    """Status and body of one request; a file that isn't there is a 404."""
    request = urllib.request.Request(url, headers={"User-Agent": AGENT})
    try:
        with urllib.request.urlopen(request, timeout=60) as answer:
            return getattr(answer, "status", None) or 200, answer.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, ""
    except urllib.error.URLError as e:
        return (404 if isinstance(e.reason, FileNotFoundError) else 0), ""


def asked(url: str, get: Callable[[str], tuple[int, str]], sleep: Callable[[float], None], retries: int, first_wait: float) -> str | None:
    """The body; None for a title that the service doesn't have. Any other failure waits, each time longer, and asks again, at last it raises."""
    for attempt in range(retries + 1):
        status, body = get(url)
        if 200 <= status < 300:
            return body
        if status == 404:
            return None
        if attempt < retries:
            sleep(first_wait * WAIT_FACTOR**attempt)
    raise NoAnswer(f"{url}: status {status} after {retries} retries")


def months(title: str, body: str | None) -> list[tuple[str, int, int, int]]:
    """Rows title, year, month, views of an answer."""
    items = (json.loads(body).get("items") or []) if body else []
    return [(title, int(x["timestamp"][:4]), int(x["timestamp"][4:6]), int(x["views"])) for x in items]


class Lane(InputPartition):
    """Every so many titles of the list, beginning with one: lanes are asked side by side, at a share of the rate each."""

    def __init__(self, first: int, lanes: int) -> None:
        super().__init__(first)
        self.first, self.lanes = first, lanes


def folder_of(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


class Spool:
    """Answers, each kept under its address as soon as it is there: who asks again, after a failure or in another attempt, finds it."""

    def __init__(self, uri: str) -> None:
        self.files, self.path = folder_of(uri)
        self.files.create_dir(self.path, recursive=True)

    def name(self, url: str) -> str:
        return f"{self.path}/{PREFIX}{hashlib.sha256(url.encode()).hexdigest()}"

    def get(self, url: str) -> tuple[bool, str | None]:
        from pyarrow import fs

        if self.files.get_file_info(self.name(url)).type == fs.FileType.NotFound:
            return False, None
        with self.files.open_input_stream(self.name(url)) as f:
            return True, json.loads(f.read().decode())

    def put(self, url: str, body: str | None) -> None:
        with self.files.open_output_stream(f"{self.name(url)}.draft") as f:
            f.write(json.dumps(body).encode())
        self.files.move(f"{self.name(url)}.draft", self.name(url))


class PageviewReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.titles, self.spool = options["titles"], options["spool"]
        self.service = options.get("service", SERVICE)
        self.fixed = {k: options[k] for k in ("project", "start", "end")}
        self.lanes = int(options.get("lanes", 1))
        self.spacing, self.first_wait = float(options.get("spacing", SPACING)), float(options.get("firstWait", FIRST_WAIT))
        self.retries = int(options.get("retries", RETRIES))

    def partitions(self) -> list[Lane]:
        return [Lane(i, self.lanes) for i in range(self.lanes)]

    def listed(self, lane: Lane) -> Iterator[str]:
        """This lane's titles, in the list's order, read file by file."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        files, path = folder_of(self.titles)
        n = 0
        for info in sorted(files.get_file_info(fs.FileSelector(path)), key=lambda i: i.path):
            if info.path.endswith(".parquet"):
                with files.open_input_file(info.path) as f:
                    for batch in pq.ParquetFile(f).iter_batches(columns=["title"]):
                        for title in batch.column(0).to_pylist():
                            if n % lane.lanes == lane.first:
                                yield title
                            n += 1

    def read(self, partition: Lane) -> Iterator[tuple]:
        spool, last = Spool(self.spool), None
        for title in self.listed(partition):
            url = self.service.format(title=urllib.parse.quote(title.replace(" ", "_"), safe="!'()*~"), **self.fixed)
            there, body = spool.get(url)
            if not there:
                if last is not None:
                    time.sleep(max(0.0, last + self.spacing * self.lanes - time.monotonic()))
                last = time.monotonic()
                body = asked(url, http, time.sleep, self.retries, self.first_wait)
                spool.put(url, body)
            yield from months(title, body)


class PageviewSource(DataSource):
    """Format `pageviews`. Options: titles (a Parquet folder with `title`), spool (a folder that all executors share), project, start, end, and
    lanes, spacing, retries, firstWait, service (an address with {project}, {title}, {start}, {end})."""

    @classmethod
    def name(cls) -> str:
        return "pageviews"

    def schema(self) -> str:
        return "title string, year int, month int, views bigint"

    def reader(self, schema) -> PageviewReader:
        return PageviewReader(self.options)


def read_pageviews_api(titles: DataFrame, spool: str, start: str, end: str, project: str = "ja.wikipedia", **options) -> DataFrame:
    """title, year, month, views of titles (title) from the service. Titles are asked once: a failed run that is called again with its spool goes on where it stopped.

    Titles are asked in order, null and empty ones not at all, and a title that the service doesn't have gives no rows. The rate is the
    service's: `spacing` seconds between two requests, over all lanes.
    """
    spark: SparkSession = titles.sparkSession
    ship(spark)
    spark.dataSource.register(PageviewSource)
    path = fresh_folder(spark, "titles")
    titles.where("title <> ''").select("title").distinct().repartitionByRange("title").sortWithinPartitions("title").write.parquet(path)
    reader = spark.read.format("pageviews").options(titles=path, spool=spool, project=project, start=start, end=end)
    return reader.options(**{k: str(v) for k, v in options.items()}).load()
