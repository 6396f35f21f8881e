"""Tiles, elevation pixels and points around a place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keidai.functions.text import round_half_up

# Elevation tile layers with their deepest zoom, pixels a tile, metres a degree.
LAYERS = (("dem5a", 15), ("dem5b", 15), ("dem5c", 15), ("dem", 14))
TILE = 256
METRES_PER_DEGREE = 111_320.0
#: Mean radius of the earth in metres.
EARTH = 6_371_000.0


def dem_metres(r: Column, g: Column, b: Column) -> Column:
    """Metres of an elevation pixel; null for the no-data colour."""
    x = r.cast("long") * 65536 + g * 256 + b
    return F.when((r == 128) & (g == 0) & (b == 0), F.lit(None)).otherwise(round_half_up(F.when(x < 2**23, x * 0.01).otherwise((x - 2**24) * 0.01), 2))


def layers_for_zoom(z: Column) -> Column:
    """Names of the layers that have tiles at this zoom, finest first."""
    every = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(m).alias("deepest")) for n, m in LAYERS])
    return F.transform(F.filter(every, lambda x: z <= x["deepest"]), lambda x: x["name"])


def tile_url(layer: Column, z: Column, x: Column, y: Column) -> Column:
    return F.concat(F.lit("https://cyberjapandata.gsi.go.jp/xyz/"), layer, F.lit("_png/"), z.cast("string"), F.lit("/"), x.cast("string"), F.lit("/"), y.cast("string"), F.lit(".png"))


def tile_of(lat: Column, lng: Column, z: Column) -> Column:
    """Struct x, y, px, py: the Web Mercator tile of a place and the pixel in it."""
    n = F.pow(F.lit(2.0), z)
    x = (lng + 180) / 360 * n
    rad = F.radians(lat)
    y = (1 - F.ln(F.tan(rad) + 1 / F.cos(rad)) / F.pi()) / 2 * n
    pixel = lambda v: F.least(F.floor((v - F.floor(v)) * TILE), F.lit(TILE - 1)).cast("int")
    return F.struct(F.floor(x).cast("int").alias("x"), F.floor(y).cast("int").alias("y"), pixel(x).alias("px"), pixel(y).alias("py"))


def place_of(x: Column, y: Column, z: Column, px: Column | None = None, py: Column | None = None) -> Column:
    """Struct lat, lng of the centre of a tile's pixel; without a pixel, of the tile's corner."""
    n = F.pow(F.lit(2.0), z)
    fx = x + (F.lit(0.0) if px is None else (px + 0.5) / TILE)
    fy = y + (F.lit(0.0) if py is None else (py + 0.5) / TILE)
    return F.struct(F.degrees(F.atan(F.sinh(F.pi() * (1 - 2 * fy / n)))).alias("lat"), (fx / n * 360 - 180).alias("lng"))


def ring(lat: Column, lng: Column, metres: float = 400.0, points: int = 8) -> Column:
    """Array of struct lat, lng: points at equal angles around a place."""

    def at(i: Column) -> Column:
        angle = 2 * F.pi() * i / points
        return F.struct(
            (lat + metres * F.cos(angle) / METRES_PER_DEGREE).alias("lat"), (lng + metres * F.sin(angle) / (METRES_PER_DEGREE * F.cos(F.radians(lat)))).alias("lng")
        )

    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at)


def relief(center: Column, around: Column) -> Column:
    """Struct relief, range, terrain from a centre's height and those around it; all null without a centre or heights."""
    low, high = F.array_min(around), F.array_max(around)  # nulls are left out
    span = F.when(center.isNotNull(), round_half_up(high - low, 1))
    return F.struct(
        round_half_up(center - low, 1).alias("relief"),
        span.alias("range"),
        F.when(span < 20, "flat").when(span < 60, "rolling").when(span.isNotNull(), "hilly").alias("terrain"),
    )


def metres_between(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance by the haversine formula."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2.0))
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lng1, lng2)
    return 2 * EARTH * F.asin(F.sqrt(F.least(F.lit(1.0), h)))
