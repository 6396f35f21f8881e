"""Vector code compression: each vector as one byte a part, from codebooks that a reduction tree refines in whole numbers."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keidai.llm.common import ship, small, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors whose distances to all entries are held at once: 512 x 256 whole numbers stay in a core's cache.
AT_ONCE = 512


def finite(vector: str) -> Column:
    """Whether a vector is there, isn't empty, and has neither null nor non-finite components."""
    v = F.col(vector)
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))), F.lit(False))


def usual_length(rows: DataFrame, vector: str) -> int | None:
    """The length that most vectors have, of equals the least; None if there are no vectors."""
    found = rows.groupBy(F.size(vector).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return found and found["d"]


def distances(block: np.ndarray, codebook: np.ndarray) -> np.ndarray:
    """Squared distances (vectors x entries) of a part's columns (dimensions x vectors) to its entries, summed dimension by dimension."""
    most = int(max(np.abs(block).max(initial=0), np.abs(codebook).max(initial=0)))
    kind = np.int32 if len(block) * (2 * most) ** 2 < 1 << 31 else np.int64
    block, codebook = block.astype(kind), codebook.astype(kind)
    total = np.zeros((block.shape[1], len(codebook)), kind)
    step = np.empty_like(total)
    for column, entries in zip(block, codebook.T):
        np.subtract(column[:, None], entries[None, :], out=step)
        np.multiply(step, step, out=step)
        total += step
    return total


def nearest(block: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each vector's part, of equals the first, and the squared distance to it."""
    codes, errors = np.empty(block.shape[1], np.int64), np.empty(block.shape[1], np.int64)
    for a in range(0, block.shape[1], AT_ONCE):
        d = distances(block[:, a : a + AT_ONCE], codebook)
        codes[a : a + AT_ONCE] = found = d.argmin(1)
        errors[a : a + AT_ONCE] = d[np.arange(len(d)), found]
    return codes, errors


def columns(data: bytes, width: int, dimensions: int) -> np.ndarray:
    """A block's whole numbers, dimensions x vectors."""
    return np.frombuffer(data, f"<i{width}").reshape(dimensions, -1)


def whole_numbers(values: np.ndarray, scale: int, parts: int) -> np.ndarray:
    """floor(scale * x); a scale that is a power of two makes it exact. Distances must fit 64 bits."""
    scaled = np.floor(values.astype(np.float64) * scale)
    most = math.isqrt((1 << 62) // (values.shape[1] // parts)) // 2
    if np.abs(scaled).max(initial=0) > most:
        raise ValueError(f"a component times {scale} is over {most}: squared distances would pass 64 bits")
    return scaled.astype(np.int64)


def blocks_of(rows: DataFrame, dimensions: int, parts: int, scale: int) -> DataFrame:
    """Rows (id, label, v) as blocks: ids, labels, n, width, and data, the whole numbers column by column in the fewest bytes they fit."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    schema = T.StructType([
        T.StructField("ids", T.ArrayType(kinds["id"])), T.StructField("labels", T.ArrayType(kinds["label"])),
        T.StructField("n", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("data", T.BinaryType()),
    ])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            q = whole_numbers(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(n, dimensions), scale, parts).T
            width = next(w for w in (2, 4, 8) if w == 8 or np.abs(q).max() < 1 << (8 * w - 1))
            as_list = lambda c: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), c)
            yield pa.RecordBatch.from_arrays(
                [as_list(batch.column("id")), as_list(batch.column("label")), pa.array([n], pa.int32()), pa.array([width], pa.int32()), pa.array([np.ascontiguousarray(q, f"<i{width}").tobytes()], pa.binary())],
                names=["ids", "labels", "n", "width", "data"],
            )

    return rows.mapInArrow(pack, schema)


def first_entries(rows: DataFrame, dimensions: int, parts: int, entries: int, scale: int) -> np.ndarray:
    """Codebooks (parts x entries x dimensions of a part) from the vectors of least ids; fewer vectors give fewer entries."""
    least = rows.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").collect()
    q = whole_numbers(np.array([r["v"] for r in least], np.float64).reshape(-1, dimensions), scale, parts)
    return np.stack(np.split(q, parts, axis=1))


def refined(blocks: DataFrame, codebooks: np.ndarray, dimensions: int) -> np.ndarray:
    """One round: sums and counts of what is nearest to each entry, merged by a tree of reductions; an entry becomes the floor of its mean."""
    sc = blocks.sparkSession.sparkContext
    books = sc.broadcast(codebooks)  # parts x entries x dimensions of a part: its size doesn't depend on the rows
    parts, entries, each = codebooks.shape

    def add(total: tuple[np.ndarray, np.ndarray], row) -> tuple[np.ndarray, np.ndarray]:
        sums, counts = total
        block = columns(row["data"], row["width"], dimensions)
        for p, book in enumerate(books.value):
            part = block[p * each : (p + 1) * each]
            codes, _ = nearest(part, book)
            np.add.at(sums[p], codes, part.T.astype(np.int64))
            np.add.at(counts[p], codes, 1)
        return sums, counts

    def merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return a[0] + b[0], a[1] + b[1]

    zero = (np.zeros((parts, entries, each), np.int64), np.zeros((parts, entries), np.int64))
    sums, counts = blocks.select("width", "data").rdd.treeAggregate(zero, add, merge)
    books.unpersist()
    return np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], codebooks)


def coded(blocks: DataFrame, codebooks: np.ndarray, dimensions: int) -> DataFrame:
    """id, label, code, error of every vector."""
    kinds = {f.name: f.dataType.elementType for f in blocks.schema.fields if f.name in ("ids", "labels")}
    schema = T.StructType([T.StructField("id", kinds["ids"]), T.StructField("label", kinds["labels"]), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    books = blocks.sparkSession.sparkContext.broadcast(codebooks)
    each = codebooks.shape[2]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = columns(batch.column("data")[i].as_py(), batch.column("width")[i].as_py(), dimensions)
                codes, errors = zip(*(nearest(block[p * each : (p + 1) * each], book) for p, book in enumerate(books.value)))
                text = [c.tobytes().hex() for c in np.stack(codes, 1).astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, batch.column("labels")[i].values, pa.array(text, pa.string()), pa.array(sum(errors), pa.int64())], names=["id", "label", "code", "error"])

    return blocks.mapInArrow(assign, schema)


def book_text(codebooks: np.ndarray) -> str:
    """All components as decimals by part, entry and position, comma-joined."""
    return ",".join(map(str, codebooks.ravel().tolist()))


def train(blocks: DataFrame, codebooks: np.ndarray, dimensions: int, rounds: int = ROUNDS) -> np.ndarray:
    for _ in range(rounds):
        codebooks = refined(blocks, codebooks, dimensions)
    return codebooks


def vector_codes(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> DataFrame:
    """Codes of all vectors: id, code, error, label_error, codebooks_sha256.

    Components become floor(scale * x); a vector is cut into `parts` equal consecutive parts. A part's codebook starts as that
    part of the vectors of least ids; each round gives every part to the nearest entry (squared distance, ties to the lower
    index) and makes an entry the floor of the mean of its parts. `code` has two hex digits a part, `error` is the squared
    distance over all parts, `label_error` its sum over equal labels (null is a label).

    Vectors that are null, empty, or have null or non-finite components are left out, and so are those of another length than
    most have. Repeated rows are coded each; rows of one id start codebooks in the order of their vectors, and a null id comes
    after all others. Fewer vectors than entries make a shorter codebook; no vectors, no rows. The length must be
    divisible by `parts`, and entries be 256 at most. Other columns are left out, whatever their names.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte a part: 1 to 256 entries")
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.where(finite(vector_col)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    empty = rows.select(F.col("id").alias(id_col), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    dimensions = usual_length(rows, "v")
    if dimensions is None:
        return empty.where(F.lit(False))
    if dimensions % parts:
        raise ValueError(f"vectors of {dimensions} components can't be cut into {parts} equal parts")
    rows = rows.where(F.size("v") == dimensions)
    codebooks = first_entries(rows, dimensions, parts, entries, scale)
    blocks = written(blocks_of(rows, dimensions, parts, scale), "vector-blocks")
    codebooks = train(blocks, codebooks, dimensions, rounds)
    found = written(coded(blocks, codebooks, dimensions), "vector-codes")
    # Labels may be many, or one may have most rows: the sums are small after a partial aggregation, and a join that isn't broadcast is split where it is skewed.
    sums = small(written(found.groupBy(F.col("label").alias("s_label")).agg(F.sum("error").alias("label_error")), "label-errors"))
    joined = found.join(sums, F.col("label").eqNullSafe(F.col("s_label")), "left")
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(hashlib.sha256(book_text(codebooks).encode()).hexdigest()).alias("codebooks_sha256"))


def _sql() -> str:
    def assign(n: int) -> str:
        return f"""
d{n} AS (SELECT x.row, x.part, b.entry, sum((x.q - b.c) * (x.q - b.c)) AS d FROM x JOIN b{n} b ON b.part = x.part AND b.pos = x.pos GROUP BY ALL),
a{n} AS (SELECT row, part, arg_min(entry, d * {ENTRIES} + entry) AS entry, min(d) AS d FROM d{n} GROUP BY ALL),"""

    def update(n: int) -> str:
        return f"""
m{n} AS (SELECT x.part, a.entry, x.pos, sum(x.q)::BIGINT AS s, count(*) AS n FROM x JOIN a{n - 1} a ON a.row = x.row AND a.part = x.part GROUP BY ALL),
b{n} AS (SELECT b.part, b.entry, b.pos, CASE WHEN m.n IS NULL THEN b.c ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS c
         FROM b{n - 1} b LEFT JOIN m{n} m ON m.part = b.part AND m.entry = b.entry AND m.pos = b.pos),"""

    rounds = assign(0) + "".join(update(n) + assign(n) for n in range(1, ROUNDS + 1))
    return f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row, vec_id, embedding, label FROM embeddings
           WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
u AS (SELECT row, len(embedding) // {PARTS} AS each, unnest(embedding) AS v, unnest(range(len(embedding))) AS place FROM k),
x AS (SELECT row, place // each AS part, place % each AS pos, CAST(floor({SCALE} * CAST(v AS DOUBLE)) AS BIGINT) AS q FROM u),
b0 AS (SELECT part, row - 1 AS entry, pos, q AS c FROM x WHERE row <= {ENTRIES}),{rounds}
h AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b{ROUNDS}),
c AS (SELECT row, string_agg(printf('%02x', entry::INTEGER), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY row)
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, h.codebooks_sha256 FROM k JOIN c USING (row) CROSS JOIN h"""


SQL = _sql()
