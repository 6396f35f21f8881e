"""Outputs of several tables that change together: each version is staged in full, and a manifest, written last, says what is current."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "_current.json"


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, root: str) -> dict[str, dict]:
    """What is current: by name the path and schema of each output; empty before the first version."""
    path, files = _files(spark, f"{root}/{MANIFEST}")
    if not files.exists(path):
        return {}
    stream = files.open(path)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def point_to(spark: SparkSession, root: str, entries: dict[str, dict]) -> None:
    """Replaces the manifest in one step: it is written under a name of its own and renamed over the old one."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    draft, files = _files(spark, f"{root}/{MANIFEST}.{uuid.uuid4().hex}")
    stream = files.create(draft, True)
    stream.write(bytearray(json.dumps(entries, ensure_ascii=False, sort_keys=True).encode()))
    stream.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), conf).rename(draft, _files(spark, f"{root}/{MANIFEST}")[0], options)


def publish(spark: SparkSession, root: str, outputs: dict[str, DataFrame], remove: tuple[str, ...] = ()) -> dict[str, dict]:
    """Writes the outputs beside the current ones and makes all of them current at once; others stay as they are, `remove` goes.

    Whatever fails before the end leaves readers with the version they had. Outputs may read current ones: nothing is overwritten.
    """
    version = f"{root}/versions/{uuid.uuid4().hex}"
    entries = {k: v for k, v in manifest(spark, root).items() if k not in remove}
    for name, df in outputs.items():
        df.write.parquet(f"{version}/{name}")
        entries[name] = {"path": f"{version}/{name}", "schema": df.schema.json()}
    point_to(spark, root, entries)
    return entries


def publish_parts(spark: SparkSession, root: str, prefix: str, rows: DataFrame, by: str, gone: tuple[str, ...] = (), note: dict[str, dict] | None = None) -> dict[str, dict]:
    """Publishes rows as one output for each value of `by` (text or numbers), named `prefix`=value; only the parts that rows have, and `gone` values, change.

    The rows are written once, in folders by value; their number is that of the values, so these must be few: months or buckets.
    What `note` has is put into the manifest in the same step.
    """
    version = f"{root}/versions/{uuid.uuid4().hex}"
    rows.withColumn("_part", F.col(by).cast("string")).hint("rebalance", "_part").write.partitionBy("_part").parquet(version)
    entries = {k: v for k, v in manifest(spark, root).items() if k not in {f"{prefix}={g}" for g in gone}}
    path, files = _files(spark, version)
    for status in files.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("_part="):
            entries[f"{prefix}={name.removeprefix('_part=')}"] = {"path": f"{version}/{name}", "schema": rows.schema.json()}
    point_to(spark, root, entries | (note or {}))
    return entries


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A current output by name."""
    entry = manifest(spark, root)[name]
    return spark.read.schema(T.StructType.fromJson(json.loads(entry["schema"]))).parquet(entry["path"])


def current_parts(spark: SparkSession, root: str, prefix: str, schema: T.StructType | str, only: set[str] | None = None) -> DataFrame:
    """All current parts of a prefix, or those of some values, as one table; empty if there are none."""
    names = {f"{prefix}={v}" for v in only} if only is not None else None
    paths = [e["path"] for n, e in manifest(spark, root).items() if n.startswith(f"{prefix}=") and (names is None or n in names)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def clean(spark: SparkSession, root: str) -> int:
    """Deletes versions that the manifest doesn't name, of failed or replaced publications; not while another one runs. Returns their number."""
    used = {e["path"].removeprefix(f"{root}/versions/").split("/")[0] for e in manifest(spark, root).values() if "path" in e}
    path, files = _files(spark, f"{root}/versions")
    old = [s.getPath() for s in (files.listStatus(path) if files.exists(path) else []) if s.getPath().getName() not in used]
    for p in old:
        files.delete(p, True)
    return len(old)
