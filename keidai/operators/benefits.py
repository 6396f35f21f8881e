"""Benefits of sites: derived from deities with their provenance, overridden by official statements, searched and explained."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keidai.functions.joins import dealt, parts_of, small_side

# Fixed values.
DISCLAIMER = "本サイトのご利益分類は、祭神・本尊に関する一般的な言説にもとづく参考情報です。正式なご祈祷の内容は各社寺の公式情報をご確認ください。"
CONFIDENCE_LABELS = {"official": "公式サイト記載", "derived": "祭神・本尊からの推定", "unknown": "未確認"}
NO_BENEFIT_NOTICE = "この社寺のご利益は、祭神・本尊からは特定できていません。文化財指定・札所・御朱印の情報をご覧ください。"


def parts_for(deities: DataFrame, mapping: DataFrame) -> int:
    """Into how many parts sites are dealt: by the benefits that all deities have, before a site's are made one."""
    n = mapping.where(F.col("policy").isNull()).agg(F.count(F.lit(1)) / F.count_distinct("cluster")).first()[0]
    return parts_of(deities, n or 1)


def derive(deities: DataFrame, mapping: DataFrame, taxonomy: DataFrame, include_secondary: bool = True, parts: int | None = None) -> DataFrame:
    """site_id, benefit_id, major_id, weight, confidence, derived_deity, derived_cluster, ord: one row for each benefit of a site.

    deities (site_id, pos, display, cluster_id), mapping (cluster, benefit, weight, weight_rank 0 primary / 1 secondary, pos,
    policy), taxonomy (benefit, major). Suppressed clusters and unknown benefits give nothing. If any deity has a benefit as
    primary the first such one is its reason, else the first secondary one; ord keeps the order of first mention.

    A deity becomes as many rows as its cluster has benefits, and a task sorts all rows of its sites: so sites are dealt into
    `parts` (else parts_for()) before, and a task's rows are bounded whatever their number.
    """
    parts = parts or parts_for(deities, mapping)
    rules = mapping.where(F.col("policy").isNull())
    if not include_secondary:
        rules = rules.where(F.col("weight") == "primary")
    rules = rules.select(F.col("cluster").alias("m_cluster"), "benefit", "weight", "weight_rank", F.col("pos").alias("list_pos"))
    rules = small_side(rules.join(taxonomy.select(F.col("benefit").alias("t_benefit"), "major"), F.col("benefit") == F.col("t_benefit")))
    # Of a site's deities of one cluster only the first matters, so they are one row before each becomes as many as its cluster has benefits.
    first = deities.where(F.col("cluster_id").isNotNull()).groupBy("site_id", "cluster_id").agg(F.min(F.struct("pos", "display")).alias("d")).select("site_id", "cluster_id", "d.pos", "d.display")
    joined = dealt(first, parts, "site_id").join(rules, F.col("cluster_id") == F.col("m_cluster"))
    reason = F.struct("weight", "display", "cluster_id", "major")
    picked = joined.groupBy("site_id", "benefit").agg(
        F.min_by(reason, F.struct("weight_rank", "pos", "list_pos", "display")).alias("r"), F.min(F.struct("pos", "weight_rank", "list_pos")).alias("ord")
    )
    return picked.select(
        "site_id",
        F.col("benefit").alias("benefit_id"),
        F.col("r.major").alias("major_id"),
        F.col("r.weight").alias("weight"),
        F.lit("derived").alias("confidence"),
        F.col("r.display").alias("derived_deity"),
        F.col("r.cluster_id").alias("derived_cluster"),
        "ord",
    )


def apply_official(derived: DataFrame, lore: DataFrame, taxonomy: DataFrame, parts: int | None = None) -> DataFrame:
    """Derived benefits, one row each as derive() has them, with official ones put over them: a benefit that lore (site_id, pos, benefit_id, source_url) names with a source is official and primary.

    The last lore of a benefit wins; one without a source, or of an unknown benefit, is not used. An official row says its
    source and no deity: what was derived isn't the reason of what is stated. `ord` goes on: an official benefit that was
    derived too keeps its place, the others follow all derived ones in the order of their first lore. With the `parts` of
    derive() both sides are dealt alike, and each site's rows are where they are put together.
    """
    said = (
        lore.where(F.col("benefit_id").isNotNull() & (F.coalesce("source_url", F.lit("")) != ""))
        .groupBy("site_id", "benefit_id")
        .agg(F.max_by("source_url", F.struct("pos", "source_url")).alias("source_url"), F.min("pos").alias("lore_pos"))
        .join(small_side(taxonomy.select(F.col("benefit").alias("benefit_id"), F.col("major").alias("l_major"))), "benefit_id")
    )
    if parts:
        said = dealt(said, parts, "site_id")
    last = F.struct(F.lit(2**31 - 1).cast("long").alias("pos"), F.lit(0).alias("weight_rank"), F.col("lore_pos").cast("long").alias("list_pos"))
    place = F.struct(F.col("ord.pos").cast("long").alias("pos"), F.col("ord.weight_rank").cast("int").alias("weight_rank"), F.col("ord.list_pos").cast("long").alias("list_pos"))
    found = derived.select("site_id", "benefit_id", "major_id", "weight", "confidence", "derived_deity", "derived_cluster", place.alias("ord"), F.lit(None).cast("boolean").alias("official"))
    both = found.unionByName(said.withColumn("official", F.lit(True)), allowMissingColumns=True)
    # A benefit of a site has one row of each side at most. Rows without a site are of none, so they don't meet.
    sides = [c for c in both.columns if c not in ("site_id", "benefit_id")]
    apart = F.when(F.col("site_id").isNull(), F.col("official").isNull())
    both = both.groupBy("site_id", "benefit_id", apart.alias("apart")).agg(*[F.first(c, True).alias(c) for c in sides])
    official = F.coalesce("official", F.lit(False))
    return both.select(
        "site_id",
        "benefit_id",
        F.coalesce("l_major", "major_id").alias("major_id"),
        F.when(official, "primary").otherwise(F.col("weight")).alias("weight"),
        F.when(official, "official").otherwise(F.col("confidence")).alias("confidence"),
        F.when(~official, F.col("derived_deity")).alias("derived_deity"),
        F.when(~official, F.col("derived_cluster")).alias("derived_cluster"),
        F.when(official, F.col("source_url")).alias("source_url"),
        F.coalesce("ord", last).alias("ord"),
    )


def official(deities: DataFrame, mapping: DataFrame, taxonomy: DataFrame, lore: DataFrame, include_secondary: bool = True) -> DataFrame:
    """apply_official(derive(...)), dealt once."""
    parts = parts_for(deities, mapping)
    return apply_official(derive(deities, mapping, taxonomy, include_secondary, parts), lore, taxonomy, parts)


def benefits_of_major(deities: DataFrame, mapping: DataFrame, taxonomy: DataFrame, lore: DataFrame, major: str, include_related: bool = False) -> DataFrame:
    """The rows that apply_official(derive(...)) has of one major group, of primary ones alone without the related.

    The group is taken before anything is joined: a benefit's major is that of the taxonomy on either side, and if any deity
    has a benefit as primary it is primary whatever else there is.
    """
    own = taxonomy.where(F.col("major") == major)
    return official(deities, mapping, own, lore, include_related)


def for_search(benefits: DataFrame, include_related: bool = False) -> DataFrame:
    return benefits if include_related else benefits.where(F.col("weight") == "primary")


def search(sites: DataFrame, access: DataFrame, benefits: DataFrame, major: str, include_related: bool = False, car_free: bool = False, include_unknown: bool = False) -> DataFrame:
    """Sites with a benefit of a major group, by how easily they are reached: access mode, then walking load, then input order (pos).

    sites (site_id, pos, ...), access (site_id, access_mode, walk_load). A site without access comes last, and never passes the car-free filter.
    """
    from keidai.operators.access import LOAD_ORDER, MODE_ORDER, rank, without_car

    wanted = for_search(benefits, include_related).where(F.col("major_id") == major).select("site_id")
    found = sites.join(wanted, "site_id", "left_semi").join(access, "site_id", "left")
    if car_free:
        found = found.where(F.coalesce(without_car(F.col("access_mode"), include_unknown), F.lit(False)))
    ranked = found.withColumns({"mode_rank": rank(F.col("access_mode"), MODE_ORDER), "load_rank": rank(F.col("walk_load"), LOAD_ORDER)})
    return ranked.orderBy("mode_rank", "load_rank", "pos")


def unexplained_wishes(wishes: DataFrame, derived: DataFrame, least: int = 3) -> DataFrame:
    """Wishes (site_id, benefit_id, count) made often at a site whose deities don't explain them, the most frequent first."""
    return wishes.where(F.col("count") >= least).join(derived.select("site_id", "benefit_id"), ["site_id", "benefit_id"], "left_anti").orderBy(F.desc("count"), "site_id", "benefit_id")


def wish_tally(visits: DataFrame) -> DataFrame:
    """site_id, benefit_id, count from visits (site_id, wish_benefit_ids)."""
    return visits.select("site_id", F.explode("wish_benefit_ids").alias("benefit_id")).groupBy("site_id", "benefit_id").agg(F.count(F.lit(1)).alias("count"))


def explain(benefit: Column, label: Column, confidence: Column, deity: Column) -> Column:
    """A sentence that says why a site has a benefit."""
    name = F.concat(F.lit("「"), F.coalesce(label, benefit), F.lit("」— "))
    return (
        F.when(confidence == "official", F.concat(name, F.lit("この社寺の公式情報に記載があります。")))
        .when((confidence == "derived") & (F.coalesce(deity, F.lit("")) != ""), F.concat(name, deity, F.lit("をお祀りしているため（祭神・本尊にもとづく推定）。")))
        .otherwise(F.concat(name, F.lit("分類の根拠を確認できていません。")))
    )


def confidence_badge(confidence: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE_LABELS.items() for x in kv]), confidence)


def benefit_notice(primary: Column, secondary: Column) -> Column:
    """The notice for a site without benefits, else null."""
    return F.when((F.coalesce(F.size(primary), F.lit(0)) <= 0) & (F.coalesce(F.size(secondary), F.lit(0)) <= 0), F.lit(NO_BENEFIT_NOTICE))


def benefit_list(benefits: DataFrame) -> DataFrame:
    """A row a site: benefit ids that are primary and secondary, each in the order of `ord`, and whether a notice is due as there are none."""
    placed = lambda w: F.sort_array(F.collect_list(F.when(F.col("weight") == w, F.struct("ord", "benefit_id"))))
    ids = lambda w: F.transform(placed(w), lambda x: x["benefit_id"])
    out = benefits.groupBy("site_id").agg(ids("primary").alias("primary_ids"), ids("secondary").alias("secondary_ids"))
    return out.withColumn("no_benefit", (F.size("primary_ids") == 0) & (F.size("secondary_ids") == 0))
