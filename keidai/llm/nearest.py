"""Approximate nearest neighbours by counting collisions in query-centred windows of single projections."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keidai.llm.common import ship, written
from keidai.llm.vector_codes import finite, usual_length

#: Projections, and half the width of a window in units of the radius it is for.
PROJECTIONS, HALF = 64, 0.7
#: Standard errors under the expected collisions of a vector at the radius, at which it is verified.
SLACK = 2.5
#: Windows grow by this factor from one virtual rehashing to the next; so many of them.
GROWTH, LEVELS = 1.3, 3
#: Vectors of an index block, vectors of the sample that gives each query its first radius, and signs that bring near vectors into one block.
BLOCK, SAMPLE, SIGNS = 2048, 4096, 12
#: Bytes of queries that are sent to all blocks at once, about; more queries take more passes.
CHUNK_BYTES = 16 << 20
#: Queries whose counts are held at once.
AT_ONCE = 256


def projections(dimensions: int, count: int, seed: int = 11) -> np.ndarray:
    """Fixed normal directions, dimensions x count."""
    return np.random.default_rng(seed).standard_normal((dimensions, count))


def threshold(count: int, half: float, slack: float) -> int:
    """Collisions that a vector at the radius has but for `slack` standard errors: each projection collides with chance erf(half / sqrt 2)."""
    chance = math.erf(half / math.sqrt(2))
    return max(1, math.floor(count * chance - slack * math.sqrt(count * chance * (1 - chance))))


def euclidean(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    d = rows.astype(np.float64) - query
    return np.sqrt((d * d).sum(1))


def vectors_of(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dimensions)


def with_cell(rows: DataFrame, sample: np.ndarray, signs: int) -> DataFrame:
    """Adds `cell`: on which side of the sample's medians the first projections lie, so that near vectors are sorted together."""
    axes = projections(sample.shape[1], signs)
    middle = np.median(sample @ axes, axis=0) if len(sample) else np.zeros(signs)
    weights = 1 << np.arange(signs)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side = (vectors_of(batch.column("v"), len(axes)) @ axes > middle) @ weights
            yield batch.append_column("cell", pa.array(side, pa.int32()))

    return rows.mapInArrow(add, T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())]))


def index_blocks(rows: DataFrame, dimensions: int, count: int, size: int) -> DataFrame:
    """Rows (id, v) in blocks: n, ids, vectors, keys (each projection's values, sorted) and places (where in the block each is)."""
    axes = projections(dimensions, count)
    double = rows.schema["v"].dataType.elementType.typeName() == "double"
    kind = "<f8" if double else "<f4"

    def block(ids: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        keys = (v.astype(np.float64) @ axes).T.astype("<f4")
        places = np.argsort(keys, axis=1, kind="stable")
        data = {"ids": ids.astype("<i8"), "vectors": v.astype(kind), "keys": np.take_along_axis(keys, places, 1), "places": places.astype("<u2")}
        return pa.RecordBatch.from_pydict({"n": pa.array([len(ids)], pa.int32()), **{k: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for k, x in data.items()}})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, v = np.empty(0, np.int64), np.empty((0, dimensions), kind)
        for batch in batches:
            ids = np.concatenate([ids, batch.column("id").to_numpy(zero_copy_only=False)])
            v = np.concatenate([v, vectors_of(batch.column("v"), dimensions)])
            while len(ids) >= size:
                yield block(ids[:size], v[:size])
                ids, v = ids[size:], v[size:]
        if len(ids):
            yield block(ids, v)

    return rows.mapInArrow(pack, "n int, ids binary, vectors binary, keys binary, places binary")


class Block:
    """An index block, and the search in it."""

    def __init__(self, row: dict, dimensions: int, count: int) -> None:
        self.n = row["n"]
        self.ids = np.frombuffer(row["ids"], "<i8")
        kind = f"<f{len(row['vectors']) // max(1, self.n * dimensions)}"
        self.vectors = np.frombuffer(row["vectors"], kind).reshape(self.n, dimensions)
        self.keys = np.frombuffer(row["keys"], "<f4").reshape(count, self.n)
        self.places = np.frombuffer(row["places"], "<u2").reshape(count, self.n)

    def reached(self, at: np.ndarray, half: np.ndarray, least: int) -> np.ndarray:
        """Queries whose windows overlap this block's range in enough projections: no vector of it can collide with the others often enough."""
        overlap = (at + half >= self.keys[:, 0]) & (at - half <= self.keys[:, -1])
        return np.flatnonzero(overlap.sum(1) >= least)

    def windows(self, at: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each query's window begins and ends in each sorted array."""
        low, high = np.empty(at.shape, np.int64), np.empty(at.shape, np.int64)
        for i, keys in enumerate(self.keys):
            low[:, i] = np.searchsorted(keys, at[:, i] - half[:, i], "left")
            high[:, i] = np.searchsorted(keys, at[:, i] + half[:, i], "right")
        return low, high


class Nearest:
    """The k nearest vectors found so far of every query, and its radius: no vector farther than that is wanted."""

    def __init__(self, queries: np.ndarray, known: list[tuple[np.ndarray, np.ndarray]], k: int, axes: np.ndarray, half: float, least: int) -> None:
        self.queries, self.known, self.k, self.half, self.least = queries, known, k, half, least
        self.radius = np.array([d[-1] if len(d) == k else math.inf for d, _ in known])
        self.at = queries @ axes
        self.found: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def window(self, which: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Half widths: as the radius says, and what rounding of the keys may take away."""
        return self.half * radius[:, None] + 1e-6 * (1 + np.abs(self.at[which]))

    def verify(self, q: int, block: Block, places: np.ndarray) -> None:
        d = euclidean(block.vectors[places], self.queries[q])
        before = self.found.get(q, self.known[q])
        near = (d <= self.radius[q]) & ~np.isin(block.ids[places], before[1])
        if not near.any():
            return
        d, ids = np.concatenate([before[0], d[near]]), np.concatenate([before[1], block.ids[places[near]]])
        order = np.lexsort((ids, d))[: self.k]
        self.found[q] = d[order], ids[order]
        if len(order) == self.k:
            self.radius[q] = min(self.radius[q], d[order[-1]])

    def search(self, block: Block, levels: int, growth: float) -> None:
        """Virtual rehashing: windows grow until they are wide enough for a query's radius, which shrinks with what is verified meanwhile."""
        everything = np.arange(len(self.queries))
        for a in range(0, len(everything), AT_ONCE):
            some = everything[a : a + AT_ONCE]
            active = some[block.reached(self.at[some], self.window(some, self.radius[some]), self.least)]
            first = self.radius[active]
            counts = np.zeros((len(active), block.n), np.int64)
            open_, low, high = np.arange(len(active)), None, None
            for level in range(levels):
                radius = first[open_] * growth ** (level + 1 - levels)
                new_low, new_high = block.windows(self.at[active[open_]], self.window(active[open_], radius))
                for j, o in enumerate(open_):
                    spans = [p[x:y] for p, x, y in zip(block.places, new_low[j], new_high[j] if low is None else low[j]) if y > x]
                    if low is not None:
                        spans += [p[x:y] for p, x, y in zip(block.places, high[j], new_high[j]) if y > x]
                    if not spans:
                        continue
                    before = counts[o] >= self.least
                    counts[o] += np.bincount(np.concatenate(spans), minlength=block.n)
                    places = np.flatnonzero((counts[o] >= self.least) & ~before)
                    if len(places):
                        self.verify(active[o], block, places)
                stay = self.radius[active[open_]] > radius
                open_, low, high = open_[stay], new_low[stay], new_high[stay]
                if not len(open_):
                    break


def with_known(queries: DataFrame, ids: np.ndarray, sample: np.ndarray, k: int) -> DataFrame:
    """Adds `near` and `near_ids`: distances and ids of the k nearest vectors of a sample. What is searched can't be farther than the last of k."""
    known = queries.sparkSession.sparkContext.broadcast((ids, sample))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sample = known.value
        for batch in batches:
            near, near_ids = [], []
            for q in vectors_of(batch.column("v"), sample.shape[1]).astype(np.float64):
                d = euclidean(sample, q)
                order = np.lexsort((ids, d))[:k]
                near.append(d[order])
                near_ids.append(ids[order])
            yield batch.append_column("near", pa.array(near, pa.list_(pa.float64()))).append_column("near_ids", pa.array(near_ids, pa.list_(pa.int64())))

    more = [T.StructField("near", T.ArrayType(T.DoubleType())), T.StructField("near_ids", T.ArrayType(T.LongType()))]
    return queries.mapInArrow(add, T.StructType([*queries.schema.fields, *more]))


def found_in(index: DataFrame, queries: DataFrame, dimensions: int, k: int, count: int, half: float, least: int) -> DataFrame:
    """rep, vec, score: what each task finds nearest to a bounded chunk of queries in its blocks."""
    rows = queries.select("rep", "v", "near", "near_ids").toArrow()
    if not rows.num_rows:
        return index.sparkSession.createDataFrame([], "rep long, vec long, score double")
    near = [(np.array(d, np.float64), np.array(i, np.int64)) for d, i in zip(rows["near"].to_pylist(), rows["near_ids"].to_pylist())]
    known = index.sparkSession.sparkContext.broadcast((rows["rep"].to_numpy(), vectors_of(rows["v"].combine_chunks(), dimensions).astype(np.float64), near))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reps, v, near = known.value
        nearest = Nearest(v, near, k, projections(dimensions, count), half, least)
        for batch in batches:
            for row in batch.to_pylist():
                nearest.search(Block(row, dimensions, count), LEVELS, GROWTH)
        for q, (d, ids) in nearest.found.items():
            new = ~np.isin(ids, near[q][1])
            d, ids = d[new], ids[new]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), reps[q]), pa.int64()), pa.array(ids, pa.int64()), pa.array(d, pa.float64())], names=["rep", "vec", "score"])

    return index.mapInArrow(search, "rep long, vec long, score double")


def nearest_neighbours(
    vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", count: int = PROJECTIONS, half: float = HALF, slack: float = SLACK
) -> DataFrame:
    """The k nearest rows found of every row for which `is_query` (of the id) holds: query_id, rank, the id, score (the distance).

    Every vector is projected on `count` normal directions; in each of them a window centred on the query is `half` radii
    wide to either side, and a vector that is in enough windows is verified by its distance. Nearest first, ties to the
    smaller id; a query's own row is no candidate; with fewer candidates all are returned.

    Vectors that are null, empty, zero, or have null or non-finite components take no part, nor do those of another length
    than most have, or of a null id. An id that several rows have counts once, with the least of its vectors. Of equal
    vectors only the k + 1 least ids can be among anybody's nearest, so no more are kept of them, and equal queries are
    searched once: a vector that a third of all rows have costs no more than any other. Other columns are left out.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.where(finite(vector_col) & F.col(id_col).isNotNull()).where(F.exists(vector_col, lambda x: x != 0)).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    dimensions = usual_length(rows, "v")
    if dimensions is None:
        return spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score double")
    rows = written(rows.where(F.size("v") == dimensions).groupBy("id").agg(F.min("v").alias("v")), "ann-vectors")
    copy = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    kept = written(rows.withColumn("copy", copy).where(F.col("copy") <= k + 1).drop("copy"), "ann-kept")
    # A sample of fixed size: it gives medians and each query's first radius, no vector is left out for it.
    drawn = kept.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("id", "v").toArrow()
    sample = vectors_of(drawn["v"].combine_chunks(), dimensions).astype(np.float64)
    index = written(index_blocks(with_cell(kept, sample, SIGNS).repartitionByRange("cell", "id").sortWithinPartitions("cell", "id"), dimensions, count, BLOCK), "ann-index")
    asked = rows.where(is_query).withColumnRenamed("id", "query_id")
    reps = written(with_known(asked.groupBy("v").agg(F.min("query_id").alias("rep")), drawn["id"].to_numpy(), sample, k + 1), "ann-queries")
    chunks = max(1, math.ceil(reps.count() * dimensions * 8 / CHUNK_BYTES))
    least = threshold(count, half, slack)
    parts = [written(found_in(index, reps.where(F.pmod(F.xxhash64("rep"), F.lit(chunks)) == c), dimensions, k + 1, count, half, least), "ann-found") for c in range(chunks)]
    parts.append(reps.select("rep", F.explode(F.arrays_zip(F.col("near_ids").alias("vec"), F.col("near").alias("score"))).alias("x")).select("rep", "x.vec", "x.score"))
    place = F.row_number().over(Window.partitionBy("rep").orderBy("score", "vec"))
    best = reduce(DataFrame.unionAll, parts).withColumn("place", place).where(F.col("place") <= k + 1)
    lists = best.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("score", "vec"))).alias("near"))
    answers = asked.join(reps.select("v", "rep"), "v").join(lists, "rep")
    others = F.slice(F.filter("near", lambda x: x["vec"] != F.col("query_id")), 1, k)
    return answers.select("query_id", F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec").alias(id_col), F.col("x.score").alias("score"))
