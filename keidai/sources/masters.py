"""Hand-curated master data: YAML to tables, and the rules it must keep."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keidai.functions.joins import dealt, parts_of, spread
from keidai.functions.text import deity_key
from keidai.operators.gaps import MAJORS
from keidai.sources.shared import kept

# Fixed values.
FILES = ("benefits", "deity_clusters", "cluster_benefits", "etiquette_overrides", "pilgrimage_groups")
PILGRIMAGE_KINDS = ("fudasho", "seven_gods", "three_shrines", "ichinomiya", "sandai", "local")

SCHEMAS = {
    "majors": "ord int, id string, label string",
    "minors": "ord int, major_id string, id string, label string",
    "clusters": "ord int, id string, label string, religion string, qids array<string>, aliases array<string>, benefit_policy string",
    "mappings": "ord int, cluster string, primary array<string>, secondary array<string>, policy string",
    "overrides": "ord int, site_key string, name string, bow_before int, clap int, bow_after int, label string, notes string, source_url string, source_type string, status string, verified_at string",
    "groups": "ord int, id string, kind string, name string, total_count int, region string, numbered boolean, disputed boolean, source_url string",
}


def read_raw(folder: str) -> dict[str, str]:
    """The five files' contents by name."""
    out = {}
    for name in FILES:
        with open(os.path.join(folder, f"{name}.yaml"), encoding="utf-8") as f:
            out[name] = f.read()
    return out


def parse(raw: dict[str, str]) -> dict[str, list[tuple]]:
    """Rows of each table. Scalars stay as written (`no` is a word, dates are text); only true and false are booleans."""
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    keep = {"tag:yaml.org,2002:null", "tag:yaml.org,2002:int", "tag:yaml.org,2002:merge"}
    Loader.yaml_implicit_resolvers = {c: [(t, r) for t, r in rules if t in keep] for c, rules in yaml.SafeLoader.yaml_implicit_resolvers.items()}
    d = {name: yaml.load(text, Loader) or {} for name, text in raw.items()}
    true = lambda v: v is True or v == "true"
    text = lambda v: None if v is None else str(v)
    majors = d["benefits"].get("majors") or []
    return {
        "majors": [(i, m["id"], m.get("label")) for i, m in enumerate(majors)],
        "minors": [(100 * i + j, m["id"], x["id"], x.get("label")) for i, m in enumerate(majors) for j, x in enumerate(m.get("minors") or [])],
        "clusters": [(i, c["id"], c.get("label"), c.get("religion"), c.get("qids") or [], c.get("aliases") or [], c.get("benefit_policy")) for i, c in enumerate(d["deity_clusters"].get("clusters") or [])],
        "mappings": [(i, m["cluster"], m.get("primary") or [], m.get("secondary") or [], m.get("policy")) for i, m in enumerate(d["cluster_benefits"].get("mappings") or [])],
        "overrides": [
            (i, o["site_key"], o.get("name"), o.get("bow_before"), o.get("clap"), o.get("bow_after"), o.get("label"), o.get("notes"), o.get("source_url"), o.get("source_type"), o.get("status"), text(o.get("verified_at")))
            for i, o in enumerate(d["etiquette_overrides"].get("overrides") or [])
        ],
        "groups": [
            (i, g["id"], g.get("kind"), g.get("name"), g.get("total_count"), g.get("region"), true(g.get("numbered")), true(g.get("disputed")), g.get("source_url"))
            for i, g in enumerate(d["pilgrimage_groups"].get("groups") or [])
        ],
    }


def tables(spark: SparkSession, rows: dict[str, list[tuple]]) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame(rows.get(name, []), schema) for name, schema in SCHEMAS.items()}


def absent(df: DataFrame, key: str, dimension: DataFrame, dim_key: str) -> DataFrame:
    return df.join(dimension.select(F.col(dim_key).alias("dim_key")).distinct(), F.col(key) == F.col("dim_key"), "left_anti")


#: What is said of a broken rule: severity, file and message; {a} and {b} are the claim's, {owner} is the id that defined its key first. A form begins with its rule.
FORMS = {
    "V1": ("error", "benefits", '未知の大分類ID "{a}"。許可されるのは ' + ", ".join(MAJORS)),
    "V2": ("error", "benefits", '細分類ID "{a}" が重複しています'),
    "V3": ("error", "benefits", "大分類が欠けています: {a}"),
    "V4": ("error", "deity_clusters", 'クラスタID "{a}" が重複しています'),
    "V5": ("warning", "deity_clusters", '別名 "{a}" が {owner} と {b} の両方にあります。先に定義された {owner} が優先されます'),
    "V5b": ("warning", "deity_clusters", '別名 "{a}" の正規形が {owner} と重なります'),
    "V6": ("error", "cluster_benefits", 'クラスタ "{a}" が deity_clusters.yaml に存在しません'),
    "V7": ("error", "cluster_benefits", 'クラスタ "{a}" の割り当てが重複しています'),
    "V8 primary": ("error", "cluster_benefits", '{a}.primary の御利益ID "{b}" が benefits.yaml に存在しません'),
    "V8 secondary": ("error", "cluster_benefits", '{a}.secondary の御利益ID "{b}" が benefits.yaml に存在しません'),
    "V9": ("error", "cluster_benefits", '{a}: "{b}" が primary と secondary の両方にあります'),
    "V10": ("warning", "cluster_benefits", "{a}: primary が {b} 件あります。設計方針は「1〜2個だけ」です"),
    "V11": ("warning", "cluster_benefits", "{a}: primary が空です。検索に一切出てきません"),
    "V12": ("warning", "deity_clusters", 'クラスタ "{a}" に御利益の割り当てがありません。この祭神からは何も導出されません'),
    "V13": ("error", "etiquette_overrides", "{a}: source_type が official なのに source_url がありません"),
    "V14": ("warning", "etiquette_overrides", "{a}: source_url があるのに pending のままです。official に昇格させてください"),
    "V15": ("warning", "etiquette_overrides", "{a}: 一次情報の裏取りが未了です（{b} は表示されません）"),
    "V16": ("error", "pilgrimage_groups", 'グループID "{a}" が重複しています'),
    "V16 kind": ("error", "pilgrimage_groups", '{a}: 未知の kind "{b}"'),
    "V17": ("warning", "pilgrimage_groups", "{a}: numbered なのに total_count がありません。収録率を管理できません"),
    "V17 disputed": ("warning", "pilgrimage_groups", "{a}: kind が sandai です。諸説あるなら disputed: true を付けてください"),
}
CLAIM = "struct<space:string,key:string,defines:boolean,at:bigint,form:string,a:string,b:string>"


def claims(t: dict[str, DataFrame]) -> DataFrame:
    """What each row of the tables says, one pass over each table: it defines a key of a space, refers to one, or is an issue by itself, without a space.

    A definition has the form that a later one of the same key breaks, a reference the form that it breaks if nothing defines its key. `at`
    is the claim's place: its row's, then its own in the row. A claim has no message yet, only what goes into it.
    """
    c = F.col
    none = F.lit(None).cast("string")

    def claim(defines: bool, form: str | None, a: Column = none, b: Column = none, space: str | None = None, key: Column = none, pos: Column = F.lit(0)) -> Column:
        text = lambda v: F.lit(v).cast("string")
        at = F.shiftleft(F.coalesce(c("ord"), F.lit(-(2**31))).cast("long"), 32) + pos
        return F.struct(text(space), key.cast("string"), F.lit(defines), at, text(form), a.cast("string"), b.cast("string")).cast(CLAIM)

    def define(form: str | None, space: str, key: Column, a: Column = none, b: Column = none, pos: Column = F.lit(0)) -> Column:
        return claim(True, form, a, b, space, key, pos)

    def refer(form: str, space: str, key: Column, a: Column, b: Column = none) -> Column:
        return claim(False, form, a, b, space, key)

    def issue(when: Column, form: str, a: Column, b: Column = none) -> Column:
        return F.when(when, claim(False, form, a, b))

    one = lambda *found: F.array_compact(F.array(*found))
    known = lambda column: c(column).isin(*MAJORS)
    unsourced = F.coalesce("source_url", F.lit("")) == ""
    spelled = F.concat(F.array("label"), "aliases")
    uses = lambda kind: F.transform(kind, lambda b: refer(f"V8 {kind}", "minor", b, c("cluster"), b))
    shared = lambda form, space, key: F.transform(spelled, lambda a, i: define(form, space, key(a), a, c("id"), i))
    rows = {
        "majors": one(define(None, "major", c("id")), issue(~known("id"), "V1", c("id"))),
        "minors": one(F.when(known("major_id"), define("V2", "minor", c("id"), c("id")))),
        "clusters": F.concat(
            one(define("V4", "cluster", c("id"), c("id")), refer("V12", "mapping", c("id"), c("id"))),
            shared("V5", "alias", lambda a: a),
            shared("V5b", "spelling", deity_key),
        ),
        "mappings": F.concat(
            one(
                define("V7", "mapping", c("cluster"), c("cluster")),
                refer("V6", "cluster", c("cluster"), c("cluster")),
                issue(c("policy").isNull() & (F.size("primary") > 2), "V10", c("cluster"), F.size("primary")),
                issue(c("policy").isNull() & (F.size("primary") == 0), "V11", c("cluster")),
            ),
            uses("primary"),
            uses("secondary"),
            F.transform(F.array_intersect("primary", "secondary"), lambda b: claim(False, "V9", c("cluster"), b)),
        ),
        "overrides": one(
            issue((c("source_type") == "official") & unsourced, "V13", c("name")),
            issue((c("source_type") == "pending") & ~unsourced, "V14", c("name")),
            issue(c("status") == "PENDING_VERIFICATION", "V15", c("name"), c("label")),
        ),
        "groups": one(
            define("V16", "group", c("id"), c("id")),
            issue(~c("kind").isin(*PILGRIMAGE_KINDS), "V16 kind", c("id"), c("kind")),
            issue(c("numbered") & c("total_count").isNull(), "V17", c("id")),
            issue((c("kind") == "sandai") & ~c("disputed"), "V17 disputed", c("id")),
        ),
    }
    spark = t["majors"].sparkSession
    out = spark.createDataFrame(list(enumerate(MAJORS)), "ord int, id string").select(F.array(refer("V3", "major", c("id"), c("id"))).alias("claims"))
    for name, found in rows.items():
        table = spread(t[name]) if name == "clusters" else t[name]  # spellings are folded, which takes much longer than reading
        out = out.unionAll(table.select(found.alias("claims")))
    return out.select(F.inline("claims"))


def said(broken: DataFrame, *forms: str, owner: str | None = None) -> DataFrame:
    """rule, severity, file, message of broken claims (form, a, b) of some forms; `owner` is the column of the first definition's id."""
    values = {"{a}": F.col("a"), "{b}": F.col("b"), "{owner}": F.coalesce(owner, F.lit("")) if owner else F.lit("")}
    written = lambda text: F.concat(*[values.get(p, F.lit(p)) for p in re.split(r"(\{[a-z]+\})", text) if p])

    def of(part: int, what: Callable[[str], Column]) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for form in forms:
            out = out.when(F.col("form") == form, what(FORMS[form][part]))
        return out

    return broken.select(F.substring_index("form", " ", 1).alias("rule"), of(0, F.lit).alias("severity"), of(1, lambda f: F.lit(f"{f}.yaml")).alias("file"), of(2, written).alias("message"))


def against_first(rows: DataFrame) -> DataFrame:
    """Claims on keys (k: space and key, as one), with the place of their key's first definition, null if there is none.

    Both sides are dealt by key into parts of bounded numbers of rows, and only a part's distinct keys and first places are held: nothing is
    sorted, and claims on a frequent key stream past its one entry.
    """
    k = F.concat_ws(":", "space", "key").alias("k")  # a null key is one of its own
    parts = parts_of(rows)
    first = dealt(rows.where("defines").select(k, "at"), parts, "k").groupBy("k").agg(F.min("at").alias("first"))
    return dealt(rows.select(k, "defines", "at", "form", "a", "b"), parts, "k").join(first.hint("shuffle_hash"), "k", "left")


def validate(t: dict[str, DataFrame]) -> DataFrame:
    """Every broken rule: rule, severity, file, message.

    The tables are read once, into their rows' claims, and claims on keys meet the first definition of their key. So the work is that of the
    rows, whatever the number of rules; messages are made of what is broken alone.
    """
    c = F.col
    rows = kept(claims(t), "claims")
    alone = rows.where("space IS NULL")
    broken = F.when(c("defines"), c("at") > c("first")).otherwise(c("first").isNull())
    keyed = against_first(rows.where("space NOT IN ('major', 'alias', 'spelling')")).where(broken)
    # An alias may come again, but not with another id than its first one's; of definitions at one place the least id counts.
    met = against_first(rows.where("space IN ('alias', 'spelling')"))
    owners = met.where("at = first").groupBy("k").agg(F.min(F.struct("b", "a")).alias("owner"))
    shared = met.join(owners.hint("shuffle_hash"), "k").where((c("b") != c("owner.b")) & ((c("form") == "V5") | (c("a") != c("owner.a"))))
    # The majors that are missing, ten at most, are one issue.
    missing = against_first(rows.where("space = 'major'")).where(broken & c("form").isNotNull())
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "a"))), lambda x: x["a"]), ", ")
    missing = missing.groupBy("form").agg(names.alias("a")).withColumn("b", F.lit(None).cast("string"))
    out = said(alone, "V1", "V9", "V10", "V11", "V13", "V14", "V15", "V16 kind", "V17", "V17 disputed").unionAll(said(keyed, "V2", "V4", "V6", "V7", "V8 primary", "V8 secondary", "V12", "V16"))
    return out.unionAll(said(shared, "V5", "V5b", owner="owner.b")).unionAll(said(missing, "V3"))


class MasterDataError(ValueError):
    pass


def load(spark: SparkSession, raw: dict[str, str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables (cached: they are small and joined by everything) and their issues; raises if any is an error."""
    t = {name: df.cache() for name, df in tables(spark, parse(raw)).items()}
    issues = validate(t).cache()
    errors = issues.where("severity = 'error'").orderBy("rule", "message").collect()
    if errors:
        raise MasterDataError("\n".join(f"[{e['file']}] {e['message']}" for e in errors))
    return t, issues


def render(issues: DataFrame) -> str:
    """Counts, then every issue, errors first."""
    rows = sorted(issues.collect(), key=lambda r: (r["severity"] != "error", r["rule"], r["message"]))
    n = sum(r["severity"] == "error" for r in rows)
    return "\n".join([f"errors: {n}, warnings: {len(rows) - n}", *[f"[{r['severity']}] {r['file']}: {r['message']}" for r in rows]])


def report(issues: DataFrame) -> DataFrame:
    """part, rule, message, line: what render() says as a table, for any number of issues: part 0 has the counts, 1 the errors, 2 the warnings."""
    c = F.col
    error = c("severity") == "error"
    issues = kept(issues, "issues")  # they are counted and listed
    counts = issues.agg(F.count_if(error).alias("e"), F.count_if(~error).alias("w"))
    first = counts.select(F.lit(0).alias("part"), F.lit("").alias("rule"), F.lit("").alias("message"), F.format_string("errors: %d, warnings: %d", "e", "w").alias("line"))
    rest = issues.select(F.when(error, 1).otherwise(2).alias("part"), "rule", "message", F.concat(F.lit("["), c("severity"), F.lit("] "), c("file"), F.lit(": "), c("message")).alias("line"))
    return first.unionAll(rest)


def taxonomy(t: dict[str, DataFrame]) -> DataFrame:
    return t["minors"].select(F.col("id").alias("benefit"), F.col("major_id").alias("major"), "label", "ord")


def mapping(t: dict[str, DataFrame]) -> DataFrame:
    """Rows (cluster, benefit, weight, weight_rank, pos, policy); the last mapping of a cluster counts."""
    last = t["mappings"].groupBy("cluster").agg(F.max_by(F.struct("primary", "secondary", "policy"), "ord").alias("m"))
    part = lambda w, r: last.select("cluster", F.posexplode(f"m.{w}").alias("pos", "benefit"), F.lit(w).alias("weight"), F.lit(r).alias("weight_rank"), F.col("m.policy").alias("policy"))
    return part("primary", 0).unionByName(part("secondary", 1))


def summary(t: dict[str, DataFrame]) -> DataFrame:
    """table, n: rows of each table, and the clusters that a policy suppresses."""
    out = None
    for name, df in [*t.items(), ("suppressed", t["mappings"].where("policy IS NOT NULL"))]:
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n")
        out = row if out is None else out.unionByName(row)
    return out


# ── Constraints of the relational schema ──


def primary_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are null or repeated, with their number of rows."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(null | (F.col("n") > 1))


def foreign_key(df: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key isn't null and has no parent."""
    return absent(df.where(F.col(key).isNotNull()), key, parent, parent_key)


def check(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that break a condition; one that is unknown holds, as in SQL."""
    return df.where(~F.coalesce(condition, F.lit(True)))


# The relational schema's constraints, table by table.
PRIMARY_KEYS = {
    "site": ["id"], "deity_cluster": ["id"], "site_deity": ["site_id", "display"], "benefit": ["id"], "cluster_benefit": ["cluster_id", "benefit_id"], "site_benefit": ["site_id", "benefit_id"], "etiquette": ["site_id"],
    "goshuin": ["site_id"], "access": ["site_id"], "classical_source": ["id"], "site_citation": ["site_id", "classical_source_id", "layer"], "shikinai_record": ["province", "district", "shrine_name"],
    "pilgrimage_group": ["id"], "site_group": ["site_id", "group_id"], "wish_tally": ["site_id", "benefit_id"], "area": ["id"],
}
FOREIGN_KEYS = {
    "site_deity": {"site_id": "site", "cluster_id": "deity_cluster"}, "cluster_benefit": {"cluster_id": "deity_cluster", "benefit_id": "benefit"}, "site_benefit": {"site_id": "site", "benefit_id": "benefit"},
    "etiquette": {"site_id": "site"}, "goshuin": {"site_id": "site"}, "access": {"site_id": "site"}, "site_citation": {"site_id": "site", "classical_source_id": "classical_source", "benefit_id": "benefit"},
    "shikinai_record": {"site_id": "site"}, "shinkai": {"site_id": "site"}, "site_lore": {"site_id": "site", "benefit_id": "benefit"}, "site_group": {"site_id": "site", "group_id": "pilgrimage_group"},
    "wish_tally": {"site_id": "site", "benefit_id": "benefit"},
}
NOT_NULL = {
    "site": "name type prefecture_code lat lng ranks updated_at", "deity_cluster": "label religion qids aliases", "site_deity": "role source", "benefit": "major_id label sort_no", "cluster_benefit": "weight",
    "site_benefit": "major_id weight confidence", "etiquette": "bow_before clap bow_after label source_type", "goshuin": "available write_style", "access": "access_mode walk_load reason computed_at",
    "classical_source": "work title original_text provenance rights source_url", "site_citation": "connection_type ocr_warning", "shikinai_record": "province district shrine_name tsukinami niiname ainame seats raw_note has_defect",
    "shinkai": "site_id rank source_text source_book", "site_lore": "site_id text source_type source_url source_name", "pilgrimage_group": "kind name numbered disputed", "wish_tally": "count updated_at",
    "area": "name prefecture_code region",
}
CHECKS = {
    "site": ("type IN ('shrine', 'temple')",),
    "deity_cluster": ("religion IN ('shinto', 'buddhist')", "policy IN ('NO_AUTO_MAPPING', 'NO_CURRENT_BENEFIT')"),
    "site_deity": ("role IN ('main', 'aidono', 'unknown')", "source IN ('wikidata', 'jawp', 'manual')", "matched_by IN ('qid', 'linkTarget', 'alias')"),
    "cluster_benefit": ("weight IN ('primary', 'secondary')",),
    "site_benefit": (
        "weight IN ('primary', 'secondary')", "confidence IN ('official', 'derived', 'unknown')", "confidence <> 'official' OR source_url IS NOT NULL", "confidence <> 'derived' OR derived_deity IS NOT NULL",
    ),
    "etiquette": ("source_type IN ('official', 'default', 'pending')", "source_type <> 'official' OR source_url IS NOT NULL"),
    "goshuin": ("available IN ('yes', 'no', 'unknown')", "write_style IN ('direct', 'paper', 'both', 'seasonal', 'unknown')", "mail_order IN ('yes', 'no', 'unknown')"),
    "access": ("access_mode IN ('TRAIN_ONLY', 'TRAIN_BUS', 'CAR_RECOMMENDED', 'CAR_ONLY', 'UNKNOWN')", "walk_load IN ('EASY', 'MODERATE', 'HARD')"),
    "classical_source": ("provenance IN ('zh.wikisource', 'aozora', 'kokugakuin', 'ndl')", "rights IN ('PD', 'CC-BY-SA-4.0', 'PD+CC-BY-SA-4.0')"),
    "site_citation": ("layer IN (1, 2, 3)", "connection_type IN ('myth', 'shikinai_rank', 'shinkai', 'fudoki', 'modern')"),
    "shikinai_record": ("rank IN ('myojin_tai', 'tai', 'sho')", "offering IN ('kanpei', 'kokuhei')", "offering_detail IN ('anjo', 'ange')"),
    "site_lore": ("source_type IN ('official', 'shaden', 'municipal', 'classical')",),
    "pilgrimage_group": ("kind IN ('fudasho', 'seven_gods', 'three_shrines', 'ichinomiya', 'sandai', 'local')",),
}


def conditions(name: str) -> list[str]:
    """What every row of a table has to meet: CHECKs, then columns that are never null."""
    return [*CHECKS.get(name, ()), *(f"{c} IS NOT NULL" for c in NOT_NULL.get(name, "").split())]


def violations(df: DataFrame, name: str) -> DataFrame:
    """condition, n: the rows of a table that break each of its conditions, of those whose columns it has."""
    has = {c.lower() for c in df.columns}
    holds = [c for c in conditions(name) if {w.lower() for w in re.findall(r"[a-z_]+(?= (?:IN|IS|<>) )", c)} <= has]
    counts = df.agg(*[F.count_if(~F.coalesce(F.expr(c), F.lit(True))).alias(f"c{i}") for i, c in enumerate(holds)])
    return counts.selectExpr(f"stack({len(holds)}, " + ", ".join(f"'{c.replace(chr(39), chr(39) * 2)}', c{i}" for i, c in enumerate(holds)) + ") AS (condition, n)")


def key_violations(t: dict[str, DataFrame]) -> DataFrame:
    """name, key, kind (primary or foreign), n: how many keys of the tables are null or repeated, and rows without a parent, where there are any."""
    spark = next(iter(t.values())).sparkSession
    out = spark.createDataFrame([], "name string, key string, kind string, n long")
    one = lambda df, name, key, kind: df.agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit(name).alias("name"), F.lit(key).alias("key"), F.lit(kind).alias("kind"), "n")
    for name, df in t.items():
        if name in PRIMARY_KEYS:
            out = out.unionByName(one(primary_key(df, PRIMARY_KEYS[name]), name, ", ".join(PRIMARY_KEYS[name]), "primary"))
        for column, parent in FOREIGN_KEYS.get(name, {}).items():
            if column in df.columns and parent in t:
                out = out.unionByName(one(foreign_key(df, column, t[parent], "id"), name, column, "foreign"))
    return out
