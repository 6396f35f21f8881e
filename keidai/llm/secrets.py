"""Secret scans over a ledger of content-addressed blobs: a blob is scanned once for each rule version."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keidai.llm.common import small, written


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches of `pattern`, leftmost and non-overlapping, count if `group` has `least` characters."""

    kind: str
    pattern: str
    group: int
    least: int


#: The base rules, in their order for equal starts.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
#: Kinds beside the base ones: private key blocks, signed web tokens, hosting tokens.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*-----END [A-Z ]*PRIVATE KEY-----", 0, 40),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("hosting", r"gh[pousr]_[A-Za-z0-9]+", 0, 36),
)
RULES = BASE + MORE


def version_of(rules: tuple[Rule, ...]) -> str:
    """A version that changes with any of the rules."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


RULE_VERSION = version_of(RULES)
SPANS = "array<struct<start:int,ord:int,kind:string,stop:int>>"
CHUNK = 256


def kind_spans(text: Column, rule: Rule, order: int) -> Column:
    """Spans (start, order, kind, end) of a rule's counting matches, in code points."""
    # Between two matches lies one part of the split, so their lengths alone give every position. A greedy run of one
    # class is the same with its least length in the pattern, which keeps short runs from being made at all.
    pattern = rule.pattern
    if rule.group == 0 and pattern.endswith("]+"):
        head = pattern[: pattern.rindex("[")]
        plain = head if head.isalnum() else ""
        if not head or plain:
            pattern = f"{pattern[:-1]}{{{rule.least - len(plain)},}}"
    lengths = lambda strings: F.transform(strings, lambda x: F.length(x))
    whole = lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    inner = lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group))) if rule.group else whole
    every = F.arrays_zip(lengths(F.split(text, pattern, -1)).alias("gap"), whole.alias("m"), inner.alias("v"))
    step = lambda x: x["gap"] + F.coalesce(x["m"], F.lit(0))
    # Arrays grow by copying, so sums run within chunks and over the chunks' totals: a text of many matches isn't quadratic.
    chunks = lambda e: F.transform(F.sequence(F.lit(0), F.floor((F.size(e) - 1) / CHUNK).cast("int")), lambda c: F.slice(e, c * CHUNK + 1, CHUNK))
    total = lambda chunk: F.aggregate(chunk, F.lit(0), lambda t, x: t + step(x))
    starts = lambda parts: F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
        lambda acc, chunk: F.struct((acc["at"] + total(chunk)).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")),
        lambda acc: acc["all"],
    )

    def spans(chunk: Column, at: Column) -> Column:
        span = lambda acc, x: F.struct((acc["at"] + x["gap"]).alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), (acc["at"] + x["gap"] + x["m"]).alias("stop"))
        return F.aggregate(
            chunk,
            F.struct(at.alias("at"), F.array().cast(SPANS).alias("spans")),
            lambda acc, x: F.struct(
                (acc["at"] + step(x)).alias("at"), F.when(F.coalesce(x["v"], F.lit(-1)) >= rule.least, F.concat(acc["spans"], F.array(span(acc, x)))).otherwise(acc["spans"]).alias("spans")
            ),
            lambda acc: acc["spans"],
        )

    once = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  binds a value that f uses more than once
    found = once(every, lambda e: once(chunks(e), lambda parts: F.flatten(F.zip_with(parts, starts(parts), spans))))
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(F.array().cast(SPANS))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of each blob: blob, spans array<struct<start, ord, kind, stop>> by start, then rule order."""
    parts = blobs.select("blob", *[kind_spans(F.col("content"), r, i).alias(f"s{i}") for i, r in enumerate(rules)])
    return parts.select("blob", F.sort_array(F.concat(*[F.col(f"s{i}") for i in range(len(rules))])).alias("spans"))


def empty_ledger(spark) -> DataFrame:
    return spark.createDataFrame([], f"blob binary, rule_version string, spans {SPANS}")


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def scan_incremental(versions: DataFrame, text: str, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, rule_version: str | None = None) -> DataFrame:
    """The ledger with the (blob, rule version) pairs of `versions` that it lacked scanned and added.

    A blob is the sha-256 of a whole text (null: empty), so equal texts are scanned once, at whatever paths and
    in whatever versions they stand. Pairs the ledger has are not scanned again; old rows stay. The rule version is that
    of the rules themselves unless it is given. With a ledger only hashes are compared with it: content is moved for unseen blobs alone.
    """
    rule_version = rule_version or version_of(rules)
    keyed = versions.select(blob_id(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    if ledger is not None:
        known = ledger.where(F.col("rule_version") == rule_version).select("blob")
        unseen = written(keyed.select("blob").distinct().join(known, "blob", "left_anti"), "unseen")
        keyed = keyed.join(small(unseen), "blob", "left_semi")
    blobs = keyed.groupBy("blob").agg(F.first("content").alias("content"))
    if ledger is None:
        return written(scan_blobs(blobs, rules).select("blob", F.lit(rule_version).alias("rule_version"), "spans"), "ledger")
    new = scan_blobs(blobs, rules).select("blob", F.lit(rule_version).alias("rule_version"), "spans")
    return written(ledger.unionByName(new), "ledger")


def findings(versions: DataFrame, text: str, ledger: DataFrame, rule_version: str = RULE_VERSION) -> DataFrame:
    """Joins the ledger's findings back to every version: its columns, whatever their names, without the text, and sc_spans."""
    # Blobs without findings need no join; one hot blob's versions are split by adaptive execution. A pair that a ledger has twice is one.
    hit = ledger.where((F.col("rule_version") == rule_version) & (F.size("spans") > 0)).groupBy(F.col("blob").alias("sc_blob")).agg(F.min("spans").alias("sc_spans"))
    others = [c for c in versions.columns if c not in (text, "sc_spans")]
    keyed = versions.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("sc_row") if others else F.lit(None).alias("sc_row"), blob_id(F.col(text)).alias("sc_key"))
    joined = keyed.join(hit, F.col("sc_key") == F.col("sc_blob"), "left")
    return joined.select(*[F.col(f"sc_row.`{c}`").alias(c) for c in others], "sc_spans")


def joined_spans(spans: Column) -> Column:
    """kind:start:end, comma-joined; empty for none."""
    parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string")))
    return F.array_join(F.coalesce(parts, F.array().cast("array<string>")), ",")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: DataFrame | None = None) -> DataFrame:
    """Secrets of every document: id, n_assign, n_access, n_hex (long), base_sha256, spans.

    Null and empty texts have none. Repeated rows get the same findings, each its own row; a null id is kept. Positions
    are code points, ends exclusive. Columns beside id and text are left out, whatever their names.
    """
    docs = docs.select(F.col(id_col).alias("sc_id"), F.col(text_col).alias("sc_text"))
    rows = findings(docs, "sc_text", scan_incremental(docs, "sc_text", ledger))
    count = lambda kind: F.coalesce(F.size(F.filter("sc_spans", lambda s: s["kind"] == kind)), F.lit(0)).cast("long")
    return rows.select(
        F.col("sc_id").alias(id_col),
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined_spans(F.filter("sc_spans", lambda s: s["ord"] < len(BASE))), 256).alias("base_sha256"),
        joined_spans(F.col("sc_spans")).alias("spans"),
    )


def _sql() -> str:
    def part(i: int, r: Rule) -> str:
        pattern = r.pattern.replace("'", "''")
        return (
            f"SELECT doc_id, text, {i} AS ord, '{r.kind}' AS kind, regexp_split_to_array(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}', 0) AS m, "
            f"regexp_extract_all(text, '{pattern}', {r.group}) AS v, {r.least} AS least FROM t"
        )

    parts = " UNION ALL ".join(part(i, r) for i, r in enumerate(RULES))
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p AS ({parts}),
u AS (SELECT doc_id, ord, kind, least, unnest(range(1, len(m) + 1)) AS i, gaps, m, v FROM p),
l AS (SELECT doc_id, ord, kind, i, least, length(gaps[i]) AS g, length(m[i]) AS n, length(v[i]) AS nv FROM u),
s AS (SELECT doc_id, ord, kind, nv, n, least, sum(g + n) OVER (PARTITION BY doc_id, ord ORDER BY i) AS stop FROM l),
k AS (SELECT doc_id, ord, kind, stop - n AS start, stop FROM s WHERE nv >= least),
f AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
      string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, ord) FILTER (WHERE ord < {len(BASE)}) AS base,
      string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, ord) AS spans FROM k GROUP BY doc_id)
SELECT t.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN f ON t.doc_id = f.doc_id
"""


#: DuckDB, over `documents`.
SQL = _sql()
