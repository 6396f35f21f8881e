"""String expressions: trimming, numerals, names, markup. All are Column to Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the Unicode sense, which trim() and \s don't have in Java.
WHITE = r"\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"

# Chinese numerals.
DIGITS = {"〇": 0, "零": 0, "一": 1, "壱": 1, "壹": 1, "二": 2, "弐": 2, "貳": 2, "貮": 2, "三": 3, "参": 3, "參": 3, "四": 4, "肆": 4, "五": 5, "伍": 5, "六": 6, "陸": 6, "七": 7, "柒": 7, "漆": 7, "八": 8, "捌": 8, "九": 9, "玖": 9}
UNITS = {"十": 10, "拾": 10, "百": 100, "佰": 100, "陌": 100, "千": 1000, "仟": 1000, "阡": 1000}
LIGATURES = {"廿": 20, "卄": 20, "卅": 30, "丗": 30, "卌": 40}
SEATS = "([〇零一二三四五六七八九十百千壱壹弐貳貮参參肆伍陸柒漆捌玖拾佰陌仟阡廿卄卅丗卌0-9〓■]+)座"

# What the key of a deity's name drops or replaces, in order; spellings of several characters first.
VARIANTS = (
    ("毘古|比古", "彦"), ("毘売|比売|媛", "姫"), ("[戔盞]", "戔"), ("[嗚鳴]", "嗚"), ("[國国]", "国"), ("[龍竜]", "竜"), ("[櫻桜]", "桜"), ("[藝芸]", "芸"), ("[燈灯]", "灯"), ("[禱祷]", "祷"), ("[彌弥]", "弥"), ("[體体]", "体"),
    ("[惠恵]", "恵"), ("[濱浜]", "浜"), ("[劍剣釼]", "剣"), ("[甞嘗]", "嘗"),
)
HONORIFICS = ("大御神", "大明神", "大権現", "大神", "御魂", "命", "尊", "神", "公", "卿", "様", "菩薩", "如来", "明王", "天", "権現")


#: Of the variants, those of single characters and the kana, for one pass of translate().
SPELLINGS = tuple(v for v in VARIANTS if not v[0].startswith("["))
CHARACTERS = {ch: to for pattern, to in VARIANTS if pattern.startswith("[") for ch in pattern[1:-1] if ch != to} | {chr(k): chr(k - 0x60) for k in range(0x30A1, 0x30F7)}


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c as a bound variable: however often f names it, it is evaluated once. An expression that folds a text would else be so at each mention."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{WHITE}]+|[{WHITE}]+$", "")


def round_half_up(c: Column, digits: int = 0) -> Column:
    """Rounds halves towards positive infinity."""
    scale = 10.0**digits
    return F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def present(c: Column) -> Column:
    """Null for an empty string."""
    return F.nullif(c, F.lit(""))


def has_defect(c: Column) -> Column:
    """Whether a text holds a mark for an unreadable character."""
    return c.rlike("[〓■□▲]")


def _lookup(values: dict[str, int], key: Column) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def kansuji(c: Column) -> Column:
    """Integer of a Chinese (or plain ASCII) numeral; null if any other character or a defect is in it.

    A unit without a digit before it counts once, a ligature drops a digit before it, the later of two digits wins.
    """
    start = F.struct(F.lit(0).alias("section"), F.lit(None).cast("int").alias("digit"), F.lit(False).alias("bad"))

    def step(acc: Column, ch: Column) -> Column:
        digit, unit, ligature = _lookup(DIGITS, ch), _lookup(UNITS, ch), _lookup(LIGATURES, ch)
        return F.struct(
            (acc["section"] + F.coalesce(ligature, F.coalesce(acc["digit"], F.lit(1)) * unit, F.lit(0))).alias("section"),
            digit.alias("digit"),
            (acc["bad"] | F.coalesce(digit, unit, ligature).isNull()).alias("bad"),
        )

    folded = lambda s: F.aggregate(F.filter(F.split(s, ""), lambda x: x != ""), start, step, lambda acc: F.when(~acc["bad"], acc["section"] + F.coalesce(acc["digit"], F.lit(0))))
    return once(js_trim(c), lambda s: F.when((s == "") | has_defect(s), F.lit(None)).when(s.rlike("^[0-9]+$"), s.try_cast("int")).otherwise(folded(s)))


def seats(c: Column) -> Column:
    """The number before the first 座; null if there is none."""
    return kansuji(present(F.regexp_extract(c, SEATS, 1)))


def deity_key(c: Column) -> Column:
    """Key under which spellings of a deity's name meet: notes, blanks, labels and honorifics go, variants and kana are made one."""
    s = js_trim(c)
    s = F.regexp_replace(s, "[（(][^）)]*[）)]", "")
    s = F.regexp_replace(s, f"[{WHITE}・･、,。．.]", "")
    s = F.regexp_replace(s, "^(主祭神|祭神|本尊|御祭神)[:：]?", "")
    for pattern, to in SPELLINGS:
        s = F.regexp_replace(s, pattern, to)
    s = F.translate(s, "".join(CHARACTERS), "".join(CHARACTERS.values()))
    return F.regexp_replace(s, f"^(.+?)(?:{'|'.join(HONORIFICS)})+$", "$1")


def js_number(c: Column) -> Column:
    """A double as JavaScript writes it: 35 for 35.0, plain decimals from a millionth up to 10**21, else with an exponent."""
    short = c.cast("double").cast("string")
    plain = F.regexp_replace(F.regexp_replace(short.try_cast("decimal(38,12)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    exponent = F.regexp_replace(F.regexp_replace(short, r"\.0E", "E"), r"E(\d)", "e+$1")
    size = F.abs(c.cast("double"))
    return F.when(size == 0, F.lit("0")).when((size >= 1e-6) & (size < 1e21), plain).otherwise(F.replace(exponent, F.lit("E"), F.lit("e")))


def unescape_xml(c: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


# Markup that is dropped or replaced, in order: editors' notes, what else isn't body, annotations of infobox fields.
SOURCE_NOTES = (
    (rf"\{{\{{[{WHITE}]*另[{WHITE}]*\|([^|}}]*)\|[^}}]*\}}\}}", "$1"),
    (r"<ref[^>]*/>", ""),
    (r"(?s)<ref[^>]*>.*?</ref>", ""),
    (r"(?s)<!--.*?-->", ""),
    (rf"(?i)\{{\{{[{WHITE}]*(?:page|頁|ページ)[^}}]*\}}\}}", ""),
    (r"(?m)[ \t]+$", ""),
)
BODY = ((rf"(?m)^[{WHITE}]*\{{\{{[^}}]*\}}\}}[{WHITE}]*$", ""), (r"(?i)\[\[Category:[^\]]*\]\]", ""), (r"\[\[分类:[^\]]*\]\]", ""), (r"\n{3,}", "\n\n"))
ANNOTATIONS = (r"(?s)<!--.*?-->", r"<ref[^>]*/>", r"(?s)<ref[^>]*>.*?</ref>", r"(?s)\{\{efn\|.*?\}\}", r"(?s)\{\{sfn\|.*?\}\}")


def strip_source_notes(c: Column) -> Column:
    """Drops editors' notes: of variant readings the first stays; references, comments, page marks and trailing blanks go."""
    for pattern, to in SOURCE_NOTES:
        c = F.regexp_replace(c, pattern, to)
    return c


def body_text(c: Column) -> Column:
    """The notes' removal, then lines of one template only, categories, and runs of empty lines."""
    c = strip_source_notes(c)
    for pattern, to in BODY:
        c = F.regexp_replace(c, pattern, to)
    return js_trim(c)


def strip_annotations(c: Column) -> Column:
    for pattern in ANNOTATIONS:
        c = F.regexp_replace(c, pattern, "")
    return c


def split_entries(c: Column) -> Column:
    """Entries of a field: line breaks, commas, and middle dots between two links separate them."""
    c = F.regexp_replace(c, f"(?i)<br[{WHITE}]*/?>", "\n")
    c = F.regexp_replace(c, rf"\]\][{WHITE}]*[・･][{WHITE}]*\[\[", "]]\n[[")
    c = F.regexp_replace(c, "[、,]", "\n")
    return F.filter(F.transform(F.split(c, "\n"), js_trim), lambda x: x != "")


def encode_component(c: Column) -> Column:
    """Percent-encodes as a URI component: blanks as %20, and !'()*~ as they are."""
    c = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for code, ch in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        c = F.replace(c, F.lit(code), F.lit(ch))
    return c


def file_name(c: Column) -> Column:
    """Characters that file systems don't take, as underscores."""
    return F.regexp_replace(c, r'[/\\:*?"<>|]', "_")


def register_sql(spark) -> None:
    """The numeral, seat and name functions as temporary SQL functions; they stay expressions for the optimizer."""
    from keidai.functions.sqltext import DEITY_KEY_SQL, KANSUJI_SQL

    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION kansuji(s STRING) RETURNS INT RETURN {KANSUJI_SQL}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION deity_key(s STRING) RETURNS STRING RETURN {DEITY_KEY_SQL}")
