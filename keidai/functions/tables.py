"""Table functions for SQL: a field's entries, what a registry note states, and the ring around a place, for LATERAL joins."""

from __future__ import annotations

from pyspark.sql import SparkSession

from keidai.functions.geo import METRES_PER_DEGREE
from keidai.functions.sqltext import KANSUJI_SQL
from keidai.functions.text import SEATS, WHITE


def _quoted(text: str) -> str:
    return "r'" + text + "'"


def _trimmed(sql: str) -> str:
    return f"regexp_replace({sql}, {_quoted(f'^[{WHITE}]+|[{WHITE}]+$')}, '')"


_PARTS = f"regexp_replace(regexp_replace(regexp_replace(field, {_quoted(f'(?i)<br[{WHITE}]*/?>')}, '\\n'), {_quoted(rf'\]\][{WHITE}]*[・･][{WHITE}]*\[\[')}, ']]\\n[['), '[、,]', '\\n')"

#: Each entry of a field with its place, from 0.
ENTRIES = f"""CREATE OR REPLACE TEMPORARY FUNCTION entries(field STRING) RETURNS TABLE (pos INT, entry STRING)
RETURN SELECT pos, entry FROM (SELECT posexplode(filter(transform(split({_PARTS}, '\\n'), x -> {_trimmed('x')}), x -> x <> '')) AS (pos, entry))"""


def _alone(word: str) -> str:
    return f"(note rlike {_quoted(f'(^|[。{WHITE}]){word}([。{WHITE}]|$)')} OR startswith(note, '{word}'))"


#: What a registry note states, as one row.
NOTE = f"""CREATE OR REPLACE TEMPORARY FUNCTION registry_note(raw STRING)
RETURNS TABLE (rank STRING, offering STRING, offering_detail STRING, tsukinami BOOLEAN, niiname BOOLEAN, ainame BOOLEAN, seats INT)
RETURN SELECT CASE WHEN contains(note, '名神大') THEN 'myojin_tai' WHEN {_alone('大')} THEN 'tai' WHEN {_alone('小')} THEN 'sho' END,
  CASE WHEN note rlike '官[幣幤]' THEN 'kanpei' WHEN note rlike '国幣|國[幣幤]' THEN 'kokuhei' END,
  CASE WHEN note rlike '官[幣幤]' THEN CASE WHEN contains(note, '案上') THEN 'anjo' WHEN contains(note, '案下') THEN 'ange' END END,
  contains(note, '月次'), note rlike '新[甞嘗]', note rlike '相[甞嘗]', (SELECT {KANSUJI_SQL} FROM (SELECT nullif(regexp_extract(note, {_quoted(SEATS)}, 1), '') AS s))
FROM (SELECT replace(raw, '／', '') AS note)"""

#: Points at equal angles around a place.
RING = f"""CREATE OR REPLACE TEMPORARY FUNCTION ring_points(lat DOUBLE, lng DOUBLE, metres DOUBLE DEFAULT 400.0, points INT DEFAULT 8) RETURNS TABLE (i INT, ring_lat DOUBLE, ring_lng DOUBLE)
RETURN SELECT k, lat + metres * cos(2 * pi() * k / points) / {METRES_PER_DEGREE}, lng + metres * sin(2 * pi() * k / points) / ({METRES_PER_DEGREE} * cos(radians(lat))) FROM (SELECT explode(sequence(0, points - 1)) AS k)"""


def register_tables(spark: SparkSession) -> None:
    """entries(field), registry_note(raw) and ring_points(lat, lng) as temporary table functions: SELECT ... FROM t, LATERAL entries(t.field)."""
    for sql in (ENTRIES, NOTE, RING):
        spark.sql(sql)
