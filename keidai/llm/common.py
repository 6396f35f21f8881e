"""What the corpus operators share: tables, the shared folder, size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it has at most this many rows, counted before.
BROADCAST_ROWS = 200_000
#: And at most so many bytes, as JSON.
BROADCAST_BYTES = 32 << 20
#: Bytes of rows sent to Python at once, about: 10,000 rows of text, Spark's own bound, may be any number of bytes.
ARROW_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one on a single machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="keidai-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class _Open(threading.local):
    """Paths of tables written within scratch(), for each that this thread has open."""

    def __init__(self) -> None:
        self.paths: list[list[str]] = []


_SCRATCH = _Open()


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the intermediate tables that operators have written within it, also after a failure. Results must have been written by then."""
    made: list[str] = []
    _SCRATCH.paths.append(made)
    try:
        yield
    finally:
        _SCRATCH.paths.remove(made)
        for path in made:
            delete(spark, path)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/keidai/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """The rows written as Parquet in the shared folder and read back: later stages don't depend on the executors that made them."""
    path = fresh_path(df.sparkSession, name)
    if _SCRATCH.paths:
        _SCRATCH.paths[-1].append(path)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a written table for broadcast if its counted rows and their bytes are within the bounds, else leaves the join to be shuffled."""
    if df.count() > rows:
        return df
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """True for the fold that crc32 of the id's text picks; a null id is never in it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """The other columns than those of these names, in whatever case."""
    gone = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in gone])


def ship(spark: SparkSession) -> None:
    """Makes a session ready for functions that run in Python: sends this package to the executors, once, so that functions pickled
    by name can be loaded there, and bounds the bytes of Arrow batches, where the session doesn't say how many it wants."""
    if spark.conf.get(ARROW_BYTES[0], None) is None:
        spark.conf.set(*ARROW_BYTES)
    sc = spark.sparkContext
    if getattr(sc, "_keidai_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="keidai-"), "keidai.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(target)
    sc._keidai_shipped = True
