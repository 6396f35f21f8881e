import random

import pytest
from pyspark.sql import functions as F

from keidai.functions import geo, text
from keidai.operators import benefits, gaps, paths, priority, wikitext
from keidai.sources import dumps, masters
from keidai.streaming import pageviews

# Monthly views of six sites: January, and the four base months. Ratios are with the median.
SERIES = {"a": (18438, [6471, 6471, 6471, 6471], 2.85), "b": (12066, [5906, 5907, 5900, 5910], 2.04), "c": (1274, [771, 772, 700, 800], 1.65)}


def series(spark):
    rows = [(t, 2026, m, v) for t, (jan, base, _) in SERIES.items() for m, v in zip((1, 3, 4, 6, 7, 8), [jan, *base, 999_999])]
    return spark.createDataFrame(rows, "title string, year int, month int, views long")


def test_ratio_uses_the_median_and_leaves_out_the_current_month(spark):
    found = {r["title"]: r["new_year_ratio"] for r in priority.newyear_ratio(series(spark), "title", 2026, 8).collect()}
    assert found == {t: r for t, (_, _, r) in SERIES.items()}


def test_ratio_is_clipped_or_null(spark):
    rows = [("spike", 2026, 1, 10000), ("spike", 2026, 3, 100), ("no_january", 2026, 3, 5), ("no_base", 2026, 1, 5), ("zero", 2026, 1, 5), ("zero", 2026, 4, 0)]
    found = {r["title"]: (r["new_year_ratio"], r["clipped"]) for r in priority.newyear_ratio(spark.createDataFrame(rows, "title string, year int, month int, views long"), "title", 2026, 8).collect()}
    assert found == {"spike": (3.0, True), "no_january": (None, False), "no_base": (None, False), "zero": (None, False)}


def test_score_of_nothing_is_zero_and_one_row_is_its_own_range(spark):
    schema = "site_id string, pv_base_median double, new_year_ratio double, official_visitors double, sitelinks int, has_goshuin boolean"
    assert priority.score(spark.createDataFrame([("x", None, None, None, None, False)], schema)).first()["score"] == 0
    assert priority.score(spark.createDataFrame([("x", 10.0, 2.0, 5.0, 3, True)], schema)).first()["score"] == 1.0


def test_rounding_is_half_up(spark):
    row = spark.createDataFrame([(1.005, -2.5)], "a double, b double").select(text.round_half_up(F.col("a"), 2), text.round_half_up(F.col("b"))).first()
    assert tuple(row) == (1.0, -2.0)


@pytest.mark.parametrize(("heights", "expected"), [([10, 20, 15, 40], (35.0, 5.0, 1.0)), ([10, None, 100], (0.0, 0.0, 2 / 3)), ([None], (0.0, 0.0, 0.0))])
def test_unknown_heights_break_the_path(spark, heights, expected):
    rows = [("p", i, None if h is None else float(h)) for i, h in enumerate(heights)]
    row = paths.cumulative_elevation(spark.createDataFrame(rows, "path string, seq int, elevation double"), "path", "seq").first()
    assert (row["ascent_m"], row["descent_m"], row["coverage"]) == pytest.approx(expected)


def test_elevation_pixels_and_tiles(spark):
    pixels = [(1, 207, 188, 1187.16), (0, 0, 0, 0.0), (255, 255, 156, -1.0), (128, 0, 0, None)]
    df = spark.createDataFrame([p[:3] for p in pixels], "r int, g int, b int")
    assert [r[0] for r in df.select(geo.dem_metres(F.col("r"), F.col("g"), F.col("b"))).collect()] == [p[3] for p in pixels]
    t = spark.range(1).select(geo.tile_of(F.lit(35.688533), F.lit(137.466431), F.lit(15)).alias("t")).first()["t"]
    assert (t["x"], t["y"]) == (28896, 12902)
    back = spark.range(1).select(geo.place_of(F.lit(t["x"]), F.lit(t["y"]), F.lit(15), F.lit(t["px"]), F.lit(t["py"])).alias("p")).first()["p"]
    assert back["lat"] == pytest.approx(35.688533, abs=1e-4) and back["lng"] == pytest.approx(137.466431, abs=1e-4)


def test_relief_needs_a_centre_and_a_height(spark):
    df = spark.createDataFrame([(100.0, [70.0, 90.0, None]), (None, [1.0]), (5.0, [None])], "c double, ring array<double>")
    found = [tuple(r["r"]) for r in df.select(geo.relief(F.col("c"), F.col("ring")).alias("r")).collect()]
    assert found == [(30.0, 20.0, "rolling"), (None, None, None), (None, None, None)]


def _param(s, template, param):
    """A plain scanner, for comparison."""
    at = s.find("{{" + template)
    if at < 0:
        return None
    depth, end, i = 0, len(s), at
    while i < len(s) - 1:
        two = s[i : i + 2]
        if two in ("{{", "}}"):
            depth += 1 if two == "{{" else -1
            i += 2
            if two == "}}" and depth == 0:
                end = i
                break
        else:
            i += 1
    body = s[at:end]
    import re

    m = re.search(rf"\|\s*{param}\s*=", body)
    if not m:
        return None
    out, i, braces, brackets = "", m.end(), 0, 0
    while i < len(body):
        two = body[i : i + 2]
        if two == "}}" and braces == 0:
            break
        if two in ("{{", "}}", "[[", "]]"):
            braces += (two == "{{") - (two == "}}")
            brackets += (two == "[[") - (two == "]]")
            out += two
            i += 2
            continue
        if body[i] == "|" and braces == 0 and brackets == 0:
            break
        out += body[i]
        i += 1
    return out.strip() or None


def test_infobox_parameter_against_a_scanner(spark):
    rng = random.Random(5)
    parts = ["{{T", "{{", "}}", "[[", "]]", "|", "p=", "|p=", " | p = ", "x", "y ", "\n", "{", "}", "["]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + ["{{T|p=a{{b|c}}d|q=1}}", "{{T|p=[[a|b]]}}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    found = {r["i"]: r["v"] for r in df.select("i", wikitext.infobox_param(F.col("s"), "T", "p").alias("v")).collect()}
    assert [found[i] for i in range(len(texts))] == [_param(t, "T", "p") for t in texts]


def test_sql_functions_agree_with_the_columns(spark):
    text.register_sql(spark)
    names = ["天照皇大神", "底 筒 男 命", "廿七", "二千八百六十一", "主祭神：イチキシマヒメ", "", "〓", None]
    df = spark.createDataFrame([(n,) for n in names], "s string")
    for r in df.select(text.kansuji(F.col("s")).alias("a"), F.expr("kansuji(s)").alias("b"), text.deity_key(F.col("s")).alias("c"), F.expr("deity_key(s)").alias("d")).collect():
        assert r["a"] == r["b"] and r["c"] == r["d"]


def test_secondary_benefits_can_be_left_out_and_primary_ones_win(spark):
    deities = spark.createDataFrame([("s", 0, "素戔嗚尊", "a"), ("s", 1, "金山彦命", "b"), ("s", 2, "織田信長", "c")], "site_id string, pos int, display string, cluster_id string")
    rules = [("a", "g", "secondary", 1, 0, None), ("b", "g", "primary", 0, 0, None), ("a", "x", "primary", 0, 0, None), ("c", "x", "primary", 0, 0, "NO_AUTO_MAPPING"), ("b", "gone", "primary", 0, 1, None)]
    mapping = spark.createDataFrame(rules, "cluster string, benefit string, weight string, weight_rank int, pos int, policy string")
    taxonomy = spark.createDataFrame([("g", "m"), ("x", "m")], "benefit string, major string")
    found = {r["benefit_id"]: (r["weight"], r["derived_deity"]) for r in benefits.derive(deities, mapping, taxonomy).collect()}
    assert found == {"g": ("primary", "金山彦命"), "x": ("primary", "素戔嗚尊")}
    assert benefits.derive(deities, mapping, taxonomy, include_secondary=False).count() == 2


XML = """<mediawiki>
  <page>
    <title>古事記</title>
    <revision><text xml:space="preserve">天地&amp;初發 &lt;ref&gt;注&lt;/ref&gt;
次行 </text></revision>
  </page>
  <page>
    <title>無関係</title>
    <revision><text>x</text></revision>
  </page>
</mediawiki>
"""


def test_xml_dump_keeps_wanted_titles(spark, tmp_path):
    (tmp_path / "d.xml").write_text(XML, encoding="utf-8")
    wanted = spark.createDataFrame([("古事記",), ("日本書紀",)], "title string")
    pages = dumps.xml_pages(spark, str(tmp_path / "d.xml"), wanted)
    rows = pages.collect()
    assert [(r["title"], r["text"]) for r in rows] == [("古事記", "天地&初發 <ref>注</ref>\n次行 ")]
    assert rows[0]["bytes"] == len("天地&初發 <ref>注</ref>\n次行 ".encode())
    assert [r["title"] for r in dumps.missing_titles(wanted, pages).collect()] == ["日本書紀"]
    manifest = dumps.write_pages(pages, str(tmp_path / "out")).collect()
    assert manifest[0]["file"] == "古事記.txt"
    out = str(tmp_path / "with")
    assert sorted((r["title"], r["found"]) for r in dumps.write_pages(pages, out, wanted).collect()) == [("古事記", True), ("日本書紀", False)]
    assert [(r["title"], r["body"]) for r in spark.read.json(f"{out}/pages").collect()] == [("古事記", "天地&初發\n次行")]
    assert spark.read.json(f"{out}/meta").first()["source"] == "zh.wikisource dump"


def test_registry_and_priority_outputs(spark, tmp_path):
    from keidai.operators import registry
    from told_queries import registry_lines

    lines = registry_lines(spark)
    shrines, out = registry.shrines(lines), str(tmp_path / "registry")
    dumps.write_registry(shrines, registry.unparsed_sample(lines), registry.quality(shrines), out)
    assert spark.read.json(f"{out}/shrines").where("description LIKE '『延喜式』神名帳に%'").count() == shrines.count()
    meta = spark.read.json(f"{out}/meta").first()
    assert meta["rights"] == "原文はパブリックドメイン" and meta["n_shrines"] == 6 and spark.read.json(f"{out}/unparsed").count() == 1
    dumps.write_priorities(spark.createDataFrame([("a", 0.5)], "site_id string, score double"), out + "p", 2026, 9)
    meta = spark.read.json(f"{out}p/meta").first()
    assert (meta["excludedCurrentMonth"], meta["baseMonths"]) == ("2026-9", "3,4,6,7") and "D1" in meta["note"]


def test_numbers_as_javascript_writes_them(spark):
    from keidai.functions.text import js_number

    cases = {0.0: "0", -0.0: "0", 35.0: "35", 139.25: "139.25", -33.125: "-33.125", 0.0001: "0.0001", 0.000001: "0.000001", 0.0000001: "1e-7", 2.5e-9: "2.5e-9", 12345678.0: "12345678", 123456789.5: "123456789.5", 0.1: "0.1", 1e21: "1e+21"}
    found = spark.createDataFrame([(k,) for k in cases], "x double").select(js_number(F.col("x")).alias("s")).collect()
    assert [r["s"] for r in found] == list(cases.values())


def test_every_table_has_its_constraints(spark):
    from keidai.sources import masters

    assert set(masters.CHECKS) | set(masters.FOREIGN_KEYS) | set(masters.NOT_NULL) | set(masters.PRIMARY_KEYS) == set(masters.NOT_NULL) | {"site_group"}
    broken = spark.createDataFrame([("maybe", "direct", "yes"), ("yes", None, None), (None, "odd", "no")], "available string, write_style string, mail_order string")
    assert {r["condition"]: r["n"] for r in masters.violations(broken, "goshuin").collect()} == {
        "available IN ('yes', 'no', 'unknown')": 1, "write_style IN ('direct', 'paper', 'both', 'seasonal', 'unknown')": 1, "mail_order IN ('yes', 'no', 'unknown')": 0, "available IS NOT NULL": 1, "write_style IS NOT NULL": 1,
    }


def test_title_list_volumes_and_sites(spark, tmp_path):
    (tmp_path / "t.txt").write_text("# x\n　明治神宮 \n\n浅草寺\n", encoding="utf-8")
    assert sorted(r["title"] for r in dumps.title_list(spark, str(tmp_path / "t.txt")).collect()) == ["明治神宮", "浅草寺"]
    (tmp_path / "v.txt").write_text("一\r\n二", encoding="utf-8")
    assert [(r["line_no"], r["line"]) for r in dumps.volumes(spark, [str(tmp_path / "v.txt")]).collect()] == [(0, "一"), (1, "二")]
    from pyspark.sql import types as T

    site = T.StructType([T.StructField("id", T.StringType())])
    for name, body in (("a.json", '[{"id": "x"}, {"id": "y"}]'), ("b.json", '{"sites": [{"id": "x"}, {"id": "y"}]}')):
        (tmp_path / name).write_text(body)
        assert sorted(r["id"] for r in dumps.sites_json(spark, str(tmp_path / name), site).collect()) == ["x", "y"]


def test_page_view_lines(spark):
    lines = ["ja.wikipedia 明治_神宮 1 user 5 A", "ja.wikipedia 明治_神宮 1 user 7 A", "en.wikipedia 明治_神宮 1 user 9 A", "ja.wikipedia 明治_神宮 1 spider 9 A", "# c", "", "ja.wikipedia a_b 1 user x A"]
    df = spark.createDataFrame(list(enumerate(lines)), "at int, value string")
    titles = spark.createDataFrame([("明治 神宮",)], "title string")
    assert [tuple(r) for r in dumps.scan_pageviews(df, titles, 2026, 1).collect()] == [("明治 神宮", 2026, 1, 7.0)]
    assert dumps.scan_pageviews(df, titles, 2026, 1, agg="sum").first()["views"] == 12.0
    with pytest.raises(Exception, match="fewer than 5"):
        dumps.scan_pageviews(spark.createDataFrame([(0, "en.wikipedia x")], "at int, value string"), titles, 2026, 1).collect()


def test_fetching_waits_and_gives_up(spark):
    waits = []
    answers = iter([(429, ""), (500, ""), (200, '{"items":[{"timestamp":"2026010100","views":3}]}')])
    assert "items" in dumps.fetch_with_retry("u", lambda _: next(answers), waits.append)
    assert waits == [15.0, 45.0]
    assert dumps.fetch_with_retry("u", lambda _: (404, ""), waits.append) is None
    with pytest.raises(dumps.FetchError):
        dumps.fetch_with_retry("u", lambda _: (429, ""), lambda _: None)
    waits.clear()
    rows = dumps.fetch_views(spark, [("a", "u"), ("b", "v")], lambda u: (200, '{"items":[{"timestamp":"2026010100","views":3}]}') if u == "u" else (404, ""), waits.append)
    assert [tuple(r) for r in rows.collect()] == [("a", 2026, 1, 3)] and waits == [6.0]


def test_stream_takes_each_file_once(spark, tmp_path):
    source, target, at = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "at")
    source.mkdir()
    (source / "views-2026-01.txt").write_text("ja.wikipedia 明治_神宮 1 user 5 A\n")
    pageviews.ingest(spark, str(source), target, at)
    (source / "views-2026-02.txt").write_text("ja.wikipedia 明治_神宮 1 user 6 A\n# c\n")
    pageviews.ingest(spark, str(source), target, at)
    rows = spark.read.parquet(target).orderBy("month").collect()
    assert [(r["title"], r["year"], r["month"], r["views"]) for r in rows] == [("明治 神宮", 2026, 1, 5.0), ("明治 神宮", 2026, 2, 6.0)]


YAML = {
    "benefits": "majors:\n" + "".join(f"  - id: {m}\n    label: {m}\n    minors: [{{id: {m}_a, label: x}}]\n" for m in gaps.MAJORS),
    "deity_clusters": "clusters:\n  - {id: a, label: 甲神, religion: shinto, aliases: [甲]}\n",
    "cluster_benefits": "mappings:\n  - {cluster: a, primary: [enmusubi_a], secondary: [shoubai_a]}\n",
    "etiquette_overrides": "overrides:\n  - {site_key: k, name: 社, bow_before: 2, clap: 4, bow_after: 1, label: x, source_url: null, source_type: pending, status: PENDING_VERIFICATION, verified_at: 2026-08-31}\n",
    "pilgrimage_groups": "groups:\n  - {id: g, kind: fudasho, name: 札所, total_count: 88, numbered: true, note: no}\n",
}


def test_masters_load_or_raise(spark):
    tables, issues = masters.load(spark, YAML)
    assert [r["rule"] for r in issues.collect()] == ["V15"]
    assert tables["overrides"].first()["verified_at"] == "2026-08-31"
    assert masters.mapping(tables).count() == 2 and masters.taxonomy(tables).count() == 10
    assert {r["table"]: r["n"] for r in masters.summary(tables).collect()}["minors"] == 10
    assert masters.render(issues).startswith("errors: 0, warnings: 1")
    broken = YAML | {"cluster_benefits": "mappings:\n  - {cluster: typo, primary: [nothing]}\n"}
    with pytest.raises(masters.MasterDataError, match="typo"):
        masters.load(spark, broken)


def test_gap_report(spark):
    schema = "id string, pos int, name string, prefecture_code string, benefits array<struct<major_id:string,weight:string>>, access_mode string, goshuin_available string, etiquette_source_type string"
    report = gaps.markdown(gaps.detect(spark.createDataFrame([], schema)), "2026-08-31")
    assert "**143 件**" in report and report.index("地理の穴") < report.index("御利益の穴") < report.index("御朱印の穴")


def test_rows_of_sites_are_dealt_by_what_they_become(spark, monkeypatch):
    """A task holds the benefits of some sites alone: of twice the deities there are twice the parts; no derived row is shuffled again for official ones."""
    from keidai.functions import joins

    monkeypatch.setattr(joins.parts_of, "__defaults__", (1.0, 100))
    mapping = spark.range(10).selectExpr("'c' AS cluster", "concat('b', id) AS benefit", "'primary' AS weight", "0 AS weight_rank", "id AS pos", "CAST(NULL AS STRING) AS policy")
    taxonomy = mapping.selectExpr("benefit", "'m' AS major")
    lore = spark.range(50).selectExpr("id AS site_id", "0 AS pos", "'b3' AS benefit_id", "'http://s' AS source_url").unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS site_id, 0 AS pos, 'b3' AS benefit_id, 'http://n' AS source_url"))
    for n in (100, 200):
        deities = spark.range(n).selectExpr("nullif(id, 99) AS site_id", "0 AS pos", "'d' AS display", "'c' AS cluster_id")
        assert benefits.parts_for(deities, mapping) == n // 10 + 1
        out = benefits.official(deities, mapping, taxonomy, lore)
        assert out.groupBy("confidence").count().orderBy("confidence").collect() == [("derived", 10 * n - 50), ("official", 51)]
        assert out.where("site_id IS NULL AND benefit_id = 'b3'").count() == 2  # rows without a site are of none
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert f"hashpartitioning(site_id#" in plan and "site_id, benefit_id" not in plan and f", {n // 10 + 1}), REPARTITION_BY_NUM" in plan


def test_an_infobox_is_folded_once_and_off_the_reading_task(spark, sf):
    from keidai.plans.catalogue import QUERIES

    for name in ("infoboxes_of_parts", "temples_of_parts"):
        lines = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString().splitlines()
        at = next(i for i, line in enumerate(lines) if "Repartition " in line)
        assert not any("aggregate(" in line for line in lines[at + 1 :])
        folds = sum(line.count("aggregate(regexp_extract_all(") for line in lines)
        assert folds <= (2 if name == "infoboxes_of_parts" else 10)  # the template and the value, of each parameter


def test_lines_are_classified_once(spark, sf):
    """What carries headings forward reads rows with their kinds and headings, which were found once and over all cores."""
    from keidai.plans.text_queries import order_lines
    from keidai.operators import registry

    out = registry.classified(order_lines(spark, sf))
    assert out.inputFiles() and all("headed" in f for f in out.inputFiles())
    assert out.columns == ["volume", "line_no", "line", "split", "kind", "province", "district"]
    numeral = spark.range(1).select(text.kansuji(F.concat(F.lit("二十"), F.col("id").cast("string"))).alias("n"))
    assert numeral._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
