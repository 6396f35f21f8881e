"""Deity names to clusters: an index whose first definition wins, and a cascade of three lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keidai.functions.text import deity_key, present


def alias_index(names: DataFrame, key: Column, cluster: str, *order: str) -> DataFrame:
    """key, cluster: of all definitions of a key the first in `order`."""
    return names.select(key.alias("key"), F.col(cluster).alias("cluster"), F.struct(*order).alias("o")).where(F.col("key").isNotNull() & (F.col("key") != "")).groupBy("key").agg(F.min_by("cluster", "o").alias("cluster"))


def deity_index(clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Indexes by Wikidata id and by name key, from clusters (ord, id, label, qids, aliases)."""
    by_qid = alias_index(clusters.select("ord", "id", F.posexplode("qids").alias("pos", "qid")), F.col("qid"), "id", "ord", "pos")
    names = clusters.select("ord", "id", F.posexplode(F.concat(F.array("label"), "aliases")).alias("pos", "name"))
    return by_qid, alias_index(names, deity_key(F.col("name")), "id", "ord", "pos")


def resolve(rows: DataFrame, by_qid: DataFrame, by_link: DataFrame, by_name: DataFrame, qid: Column, link: Column, name: Column) -> DataFrame:
    """Adds cluster_id and matched_by (qid, linkTarget, alias): the first of three lookups that finds a cluster; null where none does.

    The indexes have unique keys, so each lookup is an equi-join that keeps every row; empty strings are absent values.
    """
    keyed = rows.withColumns({"k_qid": present(qid), "k_link": present(link), "k_name": present(name)})
    for i, (k, index) in enumerate((("k_qid", by_qid), ("k_link", by_link), ("k_name", by_name))):
        side = index.select(F.col("key").alias(f"i{i}"), F.col("cluster").alias(f"c{i}"))
        # Rows without a key get one of their own, which no index has: else all of them would be shuffled to one task.
        spread = F.when(F.col(k).isNull(), F.concat(F.lit("\u0000"), F.xxhash64(*rows.columns).cast("string"))).otherwise(F.col(k))
        keyed = keyed.withColumn(k, spread).join(side, F.col(k) == F.col(f"i{i}"), "left")
    by = F.when(F.col("c0").isNotNull(), "qid").when(F.col("c1").isNotNull(), "linkTarget").when(F.col("c2").isNotNull(), "alias")
    return keyed.select(*rows.columns, F.coalesce("c0", "c1", "c2").alias("cluster_id"), by.alias("matched_by"))


def resolve_deities(deities: DataFrame, clusters: DataFrame) -> DataFrame:
    """resolve() for deities (display, link_target, qid, ...) over clusters."""
    by_qid, by_name = deity_index(clusters)
    return resolve(deities, by_qid, by_name, by_name, F.col("qid"), deity_key(F.col("link_target")), deity_key(F.col("display")))


def identification_rate(resolved: DataFrame) -> DataFrame:
    """One row: the share of rows with a cluster; 0 of none."""
    return resolved.agg(F.coalesce(F.avg(F.col("cluster_id").isNotNull().cast("double")), F.lit(0.0)).alias("rate"), F.count(F.lit(1)).alias("total"), F.count("cluster_id").alias("matched"))
