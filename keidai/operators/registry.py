"""The classical registry: lines of shrines under headings of provinces and districts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keidai.functions.joins import spread
from keidai.functions.text import WHITE, has_defect, js_trim, kansuji, present, seats
from keidai.operators.paths import carry_forward, segment_of

# Fixed values.
PROVINCE = rf"^([^{WHITE}／∥]{{1,6}}[國国])(.*)$"
DISTRICT = rf"^([^{WHITE}／∥]{{1,8}}郡)(.*)$"
SHRINE_HINT = "(神社|神宮|大社|[^國国郡]社|宮)"
NAME_SEATS = "[〇零一二三四五六七八九十百千壱壹弐貳貮参參肆伍陸柒漆捌玖拾佰陌仟阡0-9〓■]+座$"
RANK_LABELS = {"myojin_tai": "名神大社", "tai": "大社", "sho": "小社"}
MOJIBAKE = (("貞コ", "「貞観」の変換残骸とみられる（未確定）"),)
EXPECTED = {"shrines": 2861, "tai": 492, "sho": 2640, "tolerance": 50}


def is_header(line: Column, pattern: str) -> Column:
    return line.rlike(pattern) & line.contains("座")


def header(line: Column, pattern: str) -> Column:
    """Struct name, total, tai, sho of a heading."""
    rest = F.regexp_extract(line, pattern, 2)
    number = lambda p: kansuji(present(F.regexp_extract(rest, p, 1)))
    return F.struct(F.regexp_extract(line, pattern, 1).alias("name"), number("^([^大小]*?)座").alias("total"), number("大([^小座]*?)座").alias("tai"), number("小([^大座]*?)座").alias("sho"))


def name_and_note(line: Column) -> Column:
    """Struct name, note: split at the first ／ and the last ∥; the whole line without a ／."""
    at = F.instr(line, "／")
    rest = F.when(at > 0, F.substr(line, at + 1))
    inner = F.when(rest.contains("∥"), F.regexp_replace(rest, "(?s)∥[^∥]*$", "")).otherwise(rest)
    return F.struct(js_trim(F.when(at > 0, F.substr(line, F.lit(1), at - 1)).otherwise(line)).alias("name"), F.when(at > 0, js_trim(inner)).otherwise(F.lit("")).alias("note"))


def note_attributes(raw: Column) -> Column:
    """Struct rank, offering, offering_detail, tsukinami, niiname, ainame, seats that a note states."""
    note = F.replace(raw, F.lit("／"), F.lit(""))
    alone = lambda c: note.rlike(f"(^|[。{WHITE}]){c}([。{WHITE}]|$)") | note.startswith(c)
    state, province = note.rlike("官[幣幤]"), note.rlike("国幣|國[幣幤]")
    return F.struct(
        F.when(note.contains("名神大"), "myojin_tai").when(alone("大"), "tai").when(alone("小"), "sho").alias("rank"),
        F.when(state, "kanpei").when(province, "kokuhei").alias("offering"),
        F.when(state, F.when(note.contains("案上"), "anjo").when(note.contains("案下"), "ange")).alias("offering_detail"),
        note.contains("月次").alias("tsukinami"),
        note.rlike("新[甞嘗]").alias("niiname"),
        note.rlike("相[甞嘗]").alias("ainame"),
        seats(note).alias("seats"),
    )


def defects(line: Column) -> Column:
    found = [F.when(has_defect(line), F.lit("欠字（〓/■）を含む"))]
    found += [F.when(line.contains(p), F.lit(f"文字化けの疑い: {p}（{note}）")) for p, note in MOJIBAKE]
    return F.array_compact(F.array(*found))


def classified(lines: DataFrame) -> DataFrame:
    """Lines (volume, line_no, line) trimmed and not empty, with their kind (province, district, shrine, unparsed) and the headings they stand under."""
    rows = spread(lines).withColumn("line", js_trim(F.col("line"))).where("line <> ''").withColumn("split", name_and_note(F.col("line")))
    line = F.col("line")
    kind = (
        F.when(is_header(line, PROVINCE), "province")
        .when(is_header(line, DISTRICT), "district")
        .when((~line.contains("／") & ~line.rlike(SHRINE_HINT)) | (F.col("split.name") == ""), "unparsed")
        .otherwise("shrine")
    )
    rows = rows.withColumn("kind", kind)
    named = lambda k, p: F.when(F.col("kind") == k, F.regexp_extract(line, p, 1))
    out = carry_forward(rows, ["volume"], ["line_no"], named("province", PROVINCE), named("district", DISTRICT), segment_of(F.col("line_no")))
    return out.withColumnsRenamed({"outer": "province", "inner": "district"})


def unparsed_sample(lines: DataFrame, most: int = 20) -> DataFrame:
    """n, volume, line_no, line: the first unparsed lines in reading order, each with the number of all of them."""
    rows = classified(lines).where("kind = 'unparsed'").select("volume", "line_no", "line")
    return rows.agg(F.count(F.lit(1)).alias("n")).crossJoin(rows.orderBy("volume", "line_no").limit(most))  # one row with a few


def shrines(lines: DataFrame) -> DataFrame:
    """A row for each shrine line: name, headings, what its note states, raw line and note, and defects. Unparsed lines are kept in classified()."""
    rows = classified(lines).where("kind = 'shrine'").withColumn("a", note_attributes(F.col("split.note")))
    clean = F.regexp_replace("split.name", NAME_SEATS, "")
    return rows.select(
        "volume",
        "line_no",
        F.coalesce(present(clean), F.col("split.name")).alias("shrine_name"),
        "province",
        "district",
        *[F.col(f"a.{c}").alias(c) for c in ("rank", "offering", "offering_detail", "tsukinami", "niiname", "ainame")],
        F.coalesce(seats(F.col("split.name")), F.col("a.seats"), F.lit(1)).alias("seats"),
        F.col("split.note").alias("raw_note"),
        F.col("line").alias("raw_line"),
        defects(F.col("line")).alias("defects"),
    ).withColumn("has_defect", F.size("defects") > 0)


def headers(lines: DataFrame) -> DataFrame:
    """kind, name, total, tai, sho and raw line of every heading."""
    rows = classified(lines).where("kind IN ('province', 'district')")
    h = F.when(F.col("kind") == "province", header(F.col("line"), PROVINCE)).otherwise(header(F.col("line"), DISTRICT))
    wide = rows.withColumn("h", h)
    return wide.select("volume", "line_no", "kind", "h.name", "h.total", *[F.when(F.col("kind") == "province", F.col(f"h.{c}")).alias(c) for c in ("tai", "sho")], F.col("line").alias("raw"))


def describe() -> Column:
    """The sentence of facts that a registry row states."""
    c = F.col
    label = F.try_element_at(F.create_map(*[F.lit(x) for kv in RANK_LABELS.items() for x in kv]), c("rank"))
    where = F.when(c("province") != "", F.concat(c("province"), c("district"), F.lit("の"))).otherwise(F.lit(""))
    offering = F.when(c("offering") == "kanpei", F.when(c("offering_detail") == "anjo", "案上官幣").when(c("offering_detail") == "ange", "案下官幣").otherwise("官幣")).when(c("offering") == "kokuhei", "国幣")
    clauses = F.concat_ws("・", offering, F.when(c("tsukinami"), "月次祭"), F.when(c("niiname"), "新嘗祭"), F.when(c("ainame"), "相嘗祭"))
    return F.concat(
        F.lit("『延喜式』神名帳に、"),
        where,
        F.lit("「"),
        F.coalesce(label, c("shrine_name")),
        F.lit("」として記載されている。"),
        F.when(clauses != "", F.concat(clauses, F.lit("に預かる。"))).otherwise(F.lit("")),
        F.when(c("seats") > 1, F.concat(c("seats").cast("string"), F.lit("座。"))).otherwise(F.lit("")),
    )


def quality(rows: DataFrame) -> DataFrame:
    """One row over shrines(): counts by rank, seats, festivals, defects, provinces, and how the number compares with what the source states."""
    n = F.count(F.lit(1))
    return rows.agg(
        n.alias("n_shrines"),
        *[F.count_if(F.col("rank") == r).alias(f"n_{r}") for r in RANK_LABELS],
        F.count_if(F.col("rank").isNull()).alias("n_rank_unknown"),
        F.coalesce(F.sum("seats"), F.lit(0)).alias("seats"),
        *[F.count_if(f).alias(f"n_{f}") for f in ("tsukinami", "niiname", "ainame")],
        F.count_if("has_defect").alias("n_defect"),
        F.count_distinct(present(F.col("province"))).alias("n_provinces"),
        (F.abs(n - EXPECTED["shrines"]) <= EXPECTED["tolerance"]).alias("as_stated"),
    )
