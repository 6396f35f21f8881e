"""Infobox parameters and the deities in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keidai.functions.joins import spread
from keidai.functions.text import WHITE, js_trim, once, present, split_entries, strip_annotations

# Fixed values.
MARKERS = ("相殿", "配神", "合祀", "摂社", "末社")
SHRINE, TEMPLE = "神社", "日本の寺院"
TOKENS = r"(?s)(\{\{|\}\}|\[\[|\]\]|\||[^{}\[\]|]+|.)"
DELEGATED = rf"(?i)\{{\{{[{WHITE}]*wikidata[{WHITE}]*\|"


def _until(text: Column, tokens: str, start: Column, depths, ends) -> Column:
    """The beginning of a text up to where a fold over its tokens ends. The fold keeps depths and a length alone, so it is linear in the tokens. `text` is a bound variable, as it is read twice."""

    def step(acc: Column, token: Column) -> Column:
        n, done = ends(acc, token)
        now = depths(acc, token)
        return F.struct(*[F.when(done, acc[c]).otherwise(now[c]).alias(c) for c in now], (acc["n"] + F.when(acc["done"], 0).otherwise(n)).alias("n"), (acc["done"] | done).alias("done"))

    return F.substr(text, F.lit(1), F.aggregate(F.regexp_extract_all(text, F.lit(tokens), F.lit(1)), start, step, lambda acc: acc["n"]))


def _turn(token: Column, opens: str, closes: str) -> Column:
    return F.when(token == opens, 1).when(token == closes, -1).otherwise(0)


def _template(text: Column, name: str) -> Column:
    """From the first {{name to its balanced end, or to the end of the text; null if there is none."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("done"))
    depth = lambda acc, token: {"depth": acc["depth"] + _turn(token, "{{", "}}")}
    closed = lambda acc, token: (F.length(token), (token == "}}") & (acc["depth"] == 1))
    return once(text, lambda t: once(F.nullif(F.instr(t, "{{" + name), F.lit(0)), lambda at: once(F.substr(t, at), lambda rest: _until(rest, TOKENS, start, depth, closed))))


def infobox_param(text: Column, template: str, param: str) -> Column:
    """The trimmed value of a parameter of a template, up to the next bar outside of braces and brackets; null if absent or empty."""
    return _param(_template(text, template), param)


def _param(body: Column, param: str) -> Column:
    pattern = f"(?s)^.*?\\|[{WHITE}]*{param}[{WHITE}]*=(.*)$"
    value = once(body, lambda b: F.when(b.rlike(pattern), F.regexp_extract(b, pattern, 1)))
    start = F.struct(F.lit(0).alias("brace"), F.lit(0).alias("bracket"), F.lit(0).alias("n"), F.lit(False).alias("done"))
    depths = lambda acc, token: {"brace": acc["brace"] + _turn(token, "{{", "}}"), "bracket": acc["bracket"] + _turn(token, "[[", "]]")}

    def ends(acc: Column, token: Column) -> tuple[Column, Column]:
        over = (acc["brace"] == 0) & ((token == "}}") | ((token == "|") & (acc["bracket"] == 0)))
        return F.when(over, 0).otherwise(F.length(token)), over

    return present(js_trim(once(value, lambda v: _until(v, TOKENS, start, depths, ends))))


def entry(c: Column) -> Column:
    """Struct display, link_target of one entry; null if it names no deity."""
    return once(js_trim(c), _entry)


def _entry(s: Column) -> Column:
    link = r"\[\[([^\]|]+)(?:\|([^\]]+))?\]\]"
    target = js_trim(F.regexp_extract(s, link, 1))
    bare = js_trim(F.regexp_replace(F.regexp_replace(s, "[（(][^）)]*[）)]", ""), "^[（(]", ""))
    plain = once(bare, lambda b: F.when((b != "") & ~b.rlike("^(ほか|他|以下|など|等)"), F.struct(b.alias("display"), F.lit(None).cast("string").alias("link_target"))))
    return (
        F.when((s == "") | s.rlike(DELEGATED), None)
        .when(s.rlike(link), F.struct(js_trim(F.coalesce(present(F.regexp_extract(s, link, 2)), F.regexp_extract(s, link, 1))).alias("display"), target.alias("link_target")))
        .otherwise(plain)
    )


def deities(raw: Column) -> Column:
    """Array of struct display, link_target of a raw field."""
    return F.filter(F.transform(split_entries(strip_annotations(raw)), entry), lambda x: x.isNotNull())


def shrine_info(pages: DataFrame, text: str = "text") -> DataFrame:
    """Adds deities (display, link_target, role, source), delegated_to_wikidata, has_aidono_marker and raw of a shrine's infobox."""
    raw = spread(pages).withColumn("raw", infobox_param(F.col(text), SHRINE, "祭神"))
    r = F.col("raw")
    named = F.filter(deities(r), lambda x: ~x["display"].isin(*MARKERS))
    full = F.transform(named, lambda x: F.struct(x["display"].alias("display"), x["link_target"].alias("link_target"), F.lit("unknown").alias("role"), F.lit("jawp").alias("source")))
    empty = F.array().cast("array<struct<display:string,link_target:string,role:string,source:string>>")
    return raw.withColumns({
        "deities": F.coalesce(full, empty),
        "delegated_to_wikidata": F.coalesce(r.rlike(DELEGATED), F.lit(False)),
        "has_aidono_marker": F.coalesce(r.rlike("|".join(MARKERS)), F.lit(False)),
    })


def temple_info(pages: DataFrame, text: str = "text") -> DataFrame:
    """Adds honzon (display, link_target, role, source), denomination, fudasho and raw of a temple's infobox."""
    t = F.col(text)
    raw = spread(pages).withColumn("raw", infobox_param(t, TEMPLE, "本尊"))
    full = F.transform(deities(F.col("raw")), lambda x: F.struct(x["display"].alias("display"), x["link_target"].alias("link_target"), F.lit("unknown").alias("role"), F.lit("jawp").alias("source")))
    return raw.withColumns({
        "honzon": F.coalesce(full, F.array().cast("array<struct<display:string,link_target:string,role:string,source:string>>")),
        "denomination": js_trim(F.regexp_replace(strip_annotations(F.coalesce(infobox_param(t, TEMPLE, "宗派"), infobox_param(t, TEMPLE, "宗旨"))), r"\[\[|\]\]", "")),
        "fudasho": js_trim(strip_annotations(infobox_param(t, TEMPLE, "札所等"))),
    })
