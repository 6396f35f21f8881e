"""Elevation tiles: PNG files as arrays of heights, and the heights of points read from them."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keidai.functions.geo import LAYERS, TILE, tile_of
from keidai.functions.joins import small_side
from keidai.sources.shared import fresh_folder, ship

#: Where a file's layer, zoom, column and row stand in its path.
PATH = r"([a-z0-9]+)_png/(\d+)/(\d+)/(\d+)\.png$"
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes a pixel of the colour types that are read: RGB and RGBA, 8 bits each.
CHANNELS = {2: 3, 6: 4}
NO_DATA = (128, 0, 0)


def chunks(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(SIGNATURE)
    while at + 8 <= len(png):
        (n,) = struct.unpack(">I", png[at : at + 4])
        yield png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        at += 12 + n


def unfiltered(lines: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """Bytes of each line from the differences that its filter stored: to the left, above, their mean, or the one that Paeth's rule picks."""
    out = np.zeros((len(lines) + 1, lines.shape[1] + step), np.uint8)  # a line above and a pixel to the left of zeros
    for y, (line, kind) in enumerate(zip(lines, kinds), 1):
        own, above = out[y], out[y - 1]
        if kind == 0:
            own[step:] = line
        elif kind == 1:
            own[step:] = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            own[step:] = line + above[step:]
        elif kind in (3, 4):
            up, corner, now = above.astype(int).tolist(), above.astype(int).tolist(), own.astype(int).tolist()
            for i, d in enumerate(line.tolist(), step):
                a, b, c = now[i - step], up[i], corner[i - step]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                now[i] = (d + guess) & 255
            own[:] = now
        else:
            raise ValueError(f"unknown filter {kind}")
    return out[1:, step:]


def pixels(png: bytes) -> np.ndarray:
    """Rows x columns x channels of a PNG of 8-bit RGB or RGBA that isn't interlaced."""
    if png[: len(SIGNATURE)] != SIGNATURE:
        raise ValueError("not a PNG")
    parts = list(chunks(png))
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", dict(parts)[b"IHDR"])
    if depth != 8 or colour not in CHANNELS or interlaced:
        raise ValueError(f"a PNG of depth {depth}, colour type {colour}, interlaced {interlaced} isn't read")
    step = CHANNELS[colour]
    raw = np.frombuffer(zlib.decompress(b"".join(data for kind, data in parts if kind == b"IDAT")), np.uint8).reshape(height, 1 + width * step)
    return unfiltered(raw[:, 1:], raw[:, 0], step).reshape(height, width, step)


def heights(png: bytes) -> np.ndarray:
    """Centimetres of every pixel, row by row; the no-data colour is the least 32-bit number."""
    rgb = pixels(png)[:, :, :3].astype(np.int32)
    x = rgb @ np.array([65536, 256, 1], np.int32)
    return np.where((rgb == NO_DATA).all(2), np.iinfo(np.int32).min, np.where(x < 1 << 23, x, x - (1 << 24))).astype(np.int32)


def png(rgb: np.ndarray) -> bytes:
    """A PNG of rows x columns x 3 bytes, each line unfiltered."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = np.concatenate([np.zeros((len(rgb), 1), np.uint8), rgb.reshape(len(rgb), -1)], 1)
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", rgb.shape[1], len(rgb), 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def colours(centimetres: np.ndarray) -> np.ndarray:
    """The tile's colours of heights; the least 32-bit number is no data."""
    x = np.where(centimetres < 0, centimetres + (1 << 24), centimetres)
    rgb = np.stack([x >> 16, x >> 8 & 255, x & 255], -1).astype(np.uint8)
    rgb[centimetres == np.iinfo(np.int32).min] = NO_DATA
    return rgb


def read_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """layer, z, x, y, content of the PNG files under folder/<layer>_png/z/x/y.png."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(folder)
    part = lambda i: F.regexp_extract("path", PATH, i)
    return files.where(F.col("path").rlike(PATH)).select(part(1).alias("layer"), *[part(i).cast("int").alias(n) for i, n in ((2, "z"), (3, "x"), (4, "y"))], "content")


def decoded(tiles: DataFrame) -> DataFrame:
    """layer, z, x, y, cm: a tile's heights as an array of whole centimetres, null where there is no data."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one tile at a time: a row of 256 KB
                found = heights(batch.column("content")[i].as_py())
                if found.shape != (TILE, TILE):
                    raise ValueError(f"a tile of {found.shape} pixels")
                flat = pa.array(found.ravel(), mask=found.ravel() == np.iinfo(np.int32).min)
                names = ["layer", "z", "x", "y"]
                yield pa.RecordBatch.from_arrays([*[batch.column(n).slice(i, 1) for n in names], pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)], names=[*names, "cm"])

    ship(tiles.sparkSession)
    return tiles.mapInArrow(decode, "layer string, z int, x int, y int, cm array<int>")


def zooms(z: int) -> list[tuple[str, int]]:
    """Layers in the order they are tried, each at the zoom asked for or its deepest."""
    return [(name, min(z, deepest)) for name, deepest in LAYERS]


def elevations(points: DataFrame, tiles: DataFrame, z: int = 15, lat: str = "lat", lng: str = "lng", through_gaps: bool = True) -> DataFrame:
    """Points with `elevation` (metres) and `layer` from tiles (layer, z, x, y, content); both null where no layer has a height.

    Layers are tried finest first, each at its own zoom: the next one where a tile is missing and, with through_gaps, where
    it has no data. Only tiles that points fall on are decoded, each once, into a table by layer; then points meet each
    layer's tiles by an equi-join, in which adaptive execution may split the points of one tile. A repeated tile counts
    once. Points off the map have no tile.
    """
    spark = points.sparkSession
    order, levels = zooms(z), sorted({zoom for _, zoom in zooms(z)}, reverse=True)
    on_map = F.coalesce(F.col(lat).between(-85.05, 85.05) & (F.col(lng) >= -180) & (F.col(lng) < 180), F.lit(False))
    at = lambda zoom: F.when(on_map, tile_of(F.col(lat).cast("double"), F.col(lng).cast("double"), F.lit(zoom)))
    spots = points.withColumns({f"_t{zoom}": at(zoom) for zoom in levels})
    needed = reduce(DataFrame.union, [spots.where(F.col(f"_t{zoom}").isNotNull()).select(F.lit(zoom).alias("z"), f"_t{zoom}.x", f"_t{zoom}.y") for zoom in levels]).distinct()
    wanted = reduce(Column.__or__, [(F.col("layer") == layer) & (F.col("z") == zoom) for layer, zoom in order])
    folder = fresh_folder(spark, "heights")
    decoded(tiles.where(wanted).join(small_side(needed), ["z", "x", "y"], "left_semi")).write.partitionBy("layer").parquet(folder)
    grids = spark.read.schema("z int, x int, y int, cm array<int>, layer string").parquet(folder)
    out = spots
    for zoom in levels:
        out = out.withColumns({"_x": F.col(f"_t{zoom}.x"), "_y": F.col(f"_t{zoom}.y")})
        for layer in [name for name, own in order if own == zoom]:
            grid = grids.where((F.col("layer") == layer) & (F.col("z") == zoom)).groupBy(F.col("x").alias("_x"), F.col("y").alias("_y")).agg(F.first("cm").alias("_cm"))
            pixel = F.col(f"_t{zoom}.py") * TILE + F.col(f"_t{zoom}.px")
            # One height a point goes on, not the tile.
            out = out.join(grid, ["_x", "_y"], "left").withColumn(f"_{layer}", F.struct(F.col("_cm").isNotNull().alias("there"), F.get("_cm", pixel).alias("cm"))).drop("_cm")
    usable = lambda layer: F.col(f"_{layer}.cm").isNotNull() if through_gaps else F.col(f"_{layer}.there")
    picked = F.coalesce(*[F.when(usable(layer), F.struct(F.col(f"_{layer}.cm").alias("cm"), F.lit(layer).alias("layer"))) for layer, _ in order])
    out = out.withColumn("_picked", picked)
    height = F.col("_picked.cm")
    return out.select(*points.columns, (height / 100).alias("elevation"), F.when(height.isNotNull(), F.col("_picked.layer")).alias("layer"))


def write_tiles(grids: DataFrame, folder: str) -> None:
    """Writes rows (layer, z, x, y, cm: array of whole centimetres, row by row, null for no data) as PNG files under folder/<layer>_png/z/x/y.png."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")
        n = 0
        for batch in batches:
            for i in range(batch.num_rows):
                layer, z, x, y = (batch.column(c)[i].as_py() for c in ("layer", "z", "x", "y"))
                cm = batch.column("cm")[i].values.fill_null(np.iinfo(np.int32).min).to_numpy().reshape(TILE, TILE)
                files.create_dir(f"{path}/{layer}_png/{z}/{x}", recursive=True)
                with files.open_output_stream(f"{path}/{layer}_png/{z}/{x}/{y}.png") as f:
                    f.write(png(colours(cm)))
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    ship(grids.sparkSession)
    grids.select("layer", "z", "x", "y", "cm").mapInArrow(write, "n long").agg(F.sum("n")).collect()
