"""The k nearest stations of every place, by an equi-join on grid cells that grow until what lies outside can't be nearer."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keidai.functions.geo import EARTH, metres_between
from keidai.functions.joins import small_side
from keidai.sources.shared import kept

#: The finest cells: 360 degrees in 2**14, some 2.4 km from north to south.
FINEST = 14
#: Stations in the mean of a first cell.
FULL = 4
#: Bits by which cells grow from round to round.
STEP = 2
#: Stations of a cell beyond which it is dealt out to several tasks.
CROWD = 2_000
#: Metres a walker makes in a minute.
WALK = 80.0


def on_earth(lat: str, lng: str) -> Column:
    return F.coalesce(F.col(lat).between(-90, 90) & F.col(lng).between(-180, 180), F.lit(False))


def cell_of(lat: Column, lng: Column, bits: int) -> tuple[Column, Column]:
    """Row and column of a place's cell in a grid of 2**bits columns; 180 degrees east is 180 west."""
    size = 360.0 / (1 << bits)
    return F.floor((lat + 90) / size).cast("int"), (F.floor((lng + 180) / size) % (1 << bits)).cast("int")


def cells_around(lat: Column, lng: Column, bits: int) -> Column:
    """The distinct cells of the 3 x 3 block around a place, as row * 2**bits + column."""
    row, column = cell_of(lat, lng, bits)
    shifts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    number = lambda s: (row + s["i"]).cast("long") * (1 << bits) + F.pmod(column + s["j"], F.lit(1 << bits))
    return F.array_distinct(F.transform(shifts, number))


def outside(lat: Column, lng: Column, bits: int) -> Column:
    """Metres to the nearest point that isn't in the block of 3 x 3 cells; infinite if the block is all there is that way.

    To the north and south it is along the meridian. To the east and west nothing beyond a meridian is nearer than that
    meridian's great circle, whose distance has the sine cos(lat) * sin(degrees to it), and from 90 degrees on than the pole.
    """
    size, columns = 360.0 / (1 << bits), 1 << bits
    row, column = F.floor((lat + 90) / size), F.floor((lng + 180) / size)
    north, south = (row + 2) * size - 90, (row - 1) * size - 90
    far = F.lit(math.inf)
    up = F.when(north >= 90, far).otherwise(EARTH * F.radians(north - lat))
    down = F.when(south <= -90, far).otherwise(EARTH * F.radians(lat - south))
    if columns <= 3:
        return F.least(up, down)
    turn = F.least((column + 2) * size - 180 - lng, lng - ((column - 1) * size - 180), F.lit(90.0))
    return F.least(up, down, EARTH * F.asin(F.cos(F.radians(lat)) * F.sin(F.radians(turn))))


def in_cells(places: DataFrame, stations: DataFrame, bits: int, k: int, crowd: int) -> DataFrame:
    """lat, lng, rank, station, metres: the k nearest stations of each place in the 3 x 3 cells around it.

    A cell with many stations is dealt out by a hash of the station, and a place in reach of it asks all parts.
    """
    row, column = cell_of(F.col("s_lat"), F.col("s_lng"), bits)
    s = stations.withColumn("cell", row.cast("long") * (1 << bits) + column)
    crowded = s.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / crowd).cast("int").alias("parts")).where("parts > 1")
    crowded = small_side(kept(crowded, f"crowded-{bits}"))
    part = F.pmod(F.xxhash64("station"), F.coalesce("parts", F.lit(1)))
    s = s.join(crowded, "cell", "left").select("cell", part.cast("int").alias("part"), "station", "s_lat", "s_lng")
    p = places.select("lat", "lng", F.explode(cells_around(F.col("lat"), F.col("lng"), bits)).alias("cell")).join(crowded, "cell", "left")
    p = p.select("lat", "lng", "cell", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    pairs = p.join(s, ["cell", "part"]).withColumn("metres", metres_between(F.col("lat"), F.col("lng"), F.col("s_lat"), F.col("s_lng")))
    # Only the first k of each place and task go on to the shuffle.
    rank = F.row_number().over(Window.partitionBy("lat", "lng").orderBy("metres", "station"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("lat", "lng", "rank", "station", "metres")


def first_bits(stations: DataFrame, finest: int) -> int:
    """Bits of the grid to begin with: the coarsest in which an occupied cell has FULL stations at most in the mean. It decides the number of rounds, not what is found."""
    grids = [F.approx_count_distinct(F.struct(*cell_of(F.col("s_lat"), F.col("s_lng"), b))).alias(f"c{b}") for b in range(finest + 1)]
    row = stations.agg(F.count(F.lit(1)).alias("n"), *grids).first()
    return next((b for b in range(finest) if row["n"] <= FULL * row[f"c{b}"]), finest)


def nearest_stations(places: DataFrame, stations: DataFrame, k: int = 1, place_id: str = "site_id", station_id: str = "station_id", finest: int = FINEST, crowd: int = CROWD) -> DataFrame:
    """place_id, rank (from 1), station_id, metres: the k nearest stations (station_id, lat, lng) of every place (place_id, lat, lng), ties to the least id.

    Places of equal coordinates are looked up once, and of stations at one point only k are kept, so a crowd at one point
    makes no pairs. A round joins places and stations by cell and takes the 3 x 3 cells around each place. A place is done
    when its k-th station is nearer than anything outside of these; the others go on to cells of four times the size, of which
    the last is the whole earth. Places and stations without coordinates on earth have no rows; fewer stations than k are all returned.
    """
    where = places.where(on_earth("lat", "lng")).select(F.col(place_id), F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"))
    at = Window.partitionBy("s_lat", "s_lng").orderBy("station")
    s = stations.where(on_earth("lat", "lng") & F.col(station_id).isNotNull()).select(F.col(station_id).alias("station"), F.col("lat").cast("double").alias("s_lat"), F.col("lng").cast("double").alias("s_lng"))
    s = kept(s.distinct().withColumn("n", F.row_number().over(at)).where(F.col("n") <= k).drop("n"), "stations")
    left, done = kept(where.select("lat", "lng").distinct(), "places"), []
    for bits in [*range(first_bits(s, finest), 0, -STEP), 0]:
        found = kept(in_cells(left, s, bits, k, crowd), f"near-{bits}")
        if bits == 0:
            done.append(found)
            break
        last = found.where(F.col("rank") == k).where(F.col("metres") < outside(F.col("lat"), F.col("lng"), bits)).select("lat", "lng")
        done.append(found.join(last, ["lat", "lng"], "left_semi"))
        left = kept(left.join(last, ["lat", "lng"], "left_anti"), f"far-{bits}")
        if left.isEmpty():
            break
    near = reduce(DataFrame.unionByName, done)
    return where.join(near, ["lat", "lng"]).select(place_id, "rank", F.col("station").alias(station_id), "metres")


def with_station(sites: DataFrame, stations: DataFrame, metres_a_minute: float = WALK) -> DataFrame:
    """Sites (site_id, lat, lng, ...) with `station`, a struct of name and walk_min of the nearest of stations (station_id, name, lat, lng), as the assessment of access takes it; null where there is none."""
    near = nearest_stations(sites, stations).join(stations.select("station_id", "name"), "station_id")
    minutes = F.ceil(F.col("metres") / metres_a_minute).cast("int")
    return sites.join(near.select("site_id", F.struct(F.col("name"), minutes.alias("walk_min")).alias("station")), "site_id", "left")
