"""Language-model scores: n-gram counts, quantised in a log-frequency Bloom filter, are read by repeated membership probes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keidai.llm.common import held_out, ship, written
from keidai.llm.token_files import blocks, gathered

END = b"\n"  # no word holds white space
ORDER = 4  # tokens of the model's n-grams
#: Most frequent words whose exact counts every worker holds; the counts of all others are joined.
FREQUENT = 200_000
BITS = 10  # of the filter, for each entry
#: Tokens of the corpus for each segment of the filter, about: what one group counts, enters and probes.
SEGMENT_TOKENS = 1 << 19
PROBES = 4  # bits of an entry within one 64-bit block
PRIOR = 2.0  # weight of the single tokens
#: Bytes of text whose words are counted before they are shuffled, about.
COUNTED = 8_000_000
#: Bytes of text whose tokens are held at once, about: what asks the filter together.
PART = 2_500_000
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
#: Bits of an n-gram's hash that are shuffled beyond the logarithm of the n-grams' number: one in 4,096 meets another, far under the filter's own error.
SPARE_BITS = 12
SEED = np.uint64(20240229)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on the input's."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words between ASCII white space with A-Z in lower case, of all texts one after another; and how many each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, offsets = split.flatten(), split.offsets.to_numpy()
    real = pc.greater(pc.binary_length(words), 0)
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return words.filter(real).dictionary_encode(), np.diff(before[offsets - offsets[0]])


def hashes_of(words: pa.Array) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each token alone, of the ORDER - 1 tokens before it, and of these and itself; and where each text's tokens begin. Every text ends with END and has END before it."""
    words, counts = words_of(texts)
    end = hashes_of(pa.array([END.decode()]))[0]
    pad = ORDER - 1
    starts = np.concatenate([[0], np.cumsum(counts + pad + 1)])
    tokens = np.full(starts[-1], end, np.uint64)
    is_word = np.ones(len(tokens), bool)
    for k in range(pad):
        is_word[starts[:-1] + k] = False
    is_token = is_word.copy()
    is_word[starts[1:] - 1] = False
    tokens[is_word] = hashes_of(words.dictionary)[words.indices.to_numpy()] if len(words) else tokens[:0]
    at = np.flatnonzero(is_token)
    context = np.full(len(at), SEED, np.uint64)
    for k in range(pad, 0, -1):
        context = mix(context * MULTIPLY + tokens[at - k])
    return mix(tokens[at]), context, mix(context * MULTIPLY + tokens[at] + np.uint64(1)), np.concatenate([[0], np.cumsum(counts + 1)])


def packed(values: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """Sorted values of so many high bits as their differences, and counts, compressed plane by plane."""
    import zstandard

    deltas = np.diff(values >> np.uint64(64 - bits), prepend=np.uint64(0)).astype("<u8")
    planes = np.concatenate([deltas.view(np.uint8).reshape(-1, 8).T.ravel(), counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.ravel()])
    return len(values).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(blob: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    n = int.from_bytes(blob[:4], "little")
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[4:]), np.uint8)
    deltas = np.ascontiguousarray(planes[: 8 * n].reshape(8, n).T).view("<u8").ravel()
    counts = np.ascontiguousarray(planes[8 * n :].reshape(4, n).T).view("<u4").ravel()
    return np.cumsum(deltas, dtype=np.uint64) << np.uint64(64 - bits), counts.astype(np.int64)


def summed(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted values and the sums of their counts."""
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[first], np.add.reduceat(counts, first) if len(first) else counts


def word_counts(train: DataFrame, text_col: str) -> DataFrame:
    """word (binary), n: exact counts of all words and the end token; tasks combine before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, text_col, COUNTED):
            found = words_of(batch.column(0))[0].value_counts()
            words = pa.concat_arrays([found.field("values").dictionary_decode().cast(pa.binary()), pa.array([END], pa.binary())])
            yield pa.RecordBatch.from_arrays([words, pa.concat_arrays([found.field("counts"), pa.array([batch.num_rows], pa.int64())])], names=["word", "n"])

    return train.select(text_col).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int = FREQUENT) -> dict[bytes, float]:
    """log10(n + 1) of the words that are at least so frequent that there are no more than `most` of them."""
    size = F.floor(F.log2("n") * 8).cast("int")
    sizes = {r["size"]: r["words"] for r in counts.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("words")).collect()}  # 8 a power of two
    least, held = max(sizes, default=0) + 1, 0
    for s in sorted(sizes, reverse=True):
        if held + sizes[s] > most:
            break
        least, held = s, held + sizes[s]
    return {bytes(r["word"]): r["log"] for r in counts.where(size >= least).select("word", F.log10(F.col("n") + 1).alias("log")).collect()}


def parted(rows: DataFrame) -> DataFrame:
    """part, asks, payload: rows (id, key, out, text, learn, ask) packed some PART bytes of text to a row, so that a part stays the same in all stages."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def row():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for x in held:
                    out.write_batch(x)
            asks = any(pc.any(x.column("ask")).as_py() for x in held)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([asks]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["part", "asks", "payload"])

        for batch in batches:
            for a, b in blocks(batch, "text", PART):
                piece = batch.slice(a, b - a)
                held.append(piece)
                size += (pc.sum(pc.binary_length(piece.column("text"))).as_py() or 0) + piece.num_rows
                if size >= PART // 2:
                    yield row()
                    number, held, size = number + 1, [], 0
        if held:
            yield row()

    # Few parts to a file, as readers take many rows of a file at once.
    return written(rows.mapInArrow(pack, "part long, asks boolean, payload binary"), "score-parts", maxRecordsPerFile=8)


def rows_of(payload: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(payload.as_buffer()).read_all().combine_chunks()


def gram_levels(parts: DataFrame, segments: int, bits: int, tasks: int) -> DataFrame:
    """part, seg, levels: the filter's levels (a byte each) of the distinct n-grams of a part whose hashes fall in a segment of the hash range.

    A part's n-grams go to their segments with their counts in what is learned from; a segment's filter holds all of its
    n-grams, is asked there, and the answers go back, so nothing is broadcast and no task's share grows with the corpus.
    """
    shift = np.uint64(64 - max(segments.bit_length() - 1, 0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, asks, payload in zip(batch.column("part"), batch.column("asks"), batch.column("payload")):
                rows = rows_of(payload)
                found = []
                for learn in (True, False):
                    texts = rows.filter(pc.equal(rows["learn"], learn))["text"].combine_chunks()
                    if len(texts) and (learn or asks.as_py()):
                        values, n = np.unique(cut(np.concatenate(grams(texts)[:3]), bits), return_counts=True)
                        found.append((values, n if learn else np.zeros(len(n), np.int64)))
                if not found:
                    continue
                values, counts = found[0] if len(found) == 1 else summed(*(np.concatenate(x) for x in zip(*found)))
                seg = (values >> shift).astype(np.int64) if segments > 1 else np.zeros(len(values), np.int64)
                edges = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
                blobs = [packed(values[a:b], counts[a:b], bits) for a, b in zip(edges, [*edges[1:], len(seg)])]
                k = len(edges)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.as_py()] * k, pa.int64()), pa.array([asks.as_py()] * k), pa.array(seg[edges], pa.int64()), pa.array(blobs, pa.binary())], names=["part", "asks", "seg", "blob"]
                )

    def ask(key, rows):
        blobs = [unpacked(b.as_py(), bits) for b in rows["blob"]]
        values, counts = summed(np.concatenate([x[0] for x in blobs]), np.concatenate([x[1] for x in blobs]))
        words = entered(values, quantised(counts), BITS)
        levels = CountFilter(words, np.array([0, len(words)])).levels(values).astype(np.uint8)
        asks = rows["asks"].to_pylist()
        answers = [levels[np.searchsorted(values, x[0])].tobytes() if a else None for x, a in zip(blobs, asks)]
        return pa.table({"part": rows["part"], "seg": rows["seg"], "levels": pa.array(answers, pa.binary())}).filter(rows["asks"])

    return parts.mapInArrow(count, "part long, asks boolean, seg long, blob binary").repartition(tasks, "seg").groupBy("seg").applyInArrow(ask, "part long, seg long, levels binary")


def cut(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Hashes with so many high bits, the others 0."""
    return (hashes >> np.uint64(64 - bits)) << np.uint64(64 - bits)


def quantised(counts: np.ndarray) -> np.ndarray:
    """1 + the whole part of the binary logarithm."""
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)


def expected(levels: np.ndarray) -> np.ndarray:
    """A count for each quantised one: 0 and 1 exact, else the middle of its range."""
    return np.where(levels <= 1, levels, 0.75 * np.exp2(levels.astype(np.float64))).astype(np.float64)


def places(hashes: np.ndarray, level: int, blocks: np.ndarray | int, bases: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Block and bits of an n-gram's entry for one level."""
    h = mix(hashes + np.uint64(level * int(MULTIPLY) & 0xFFFFFFFFFFFFFFFF))
    block = bases + ((h >> np.uint64(32)) % blocks).astype(np.int64)
    bits = np.zeros(len(h), np.uint64)
    for k in range(PROBES):
        bits |= np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63))
    return block, bits


class CountFilter:
    """Counts of n-grams, never under the quantised ones: an n-gram of level q was entered for levels 1 to q."""

    def __init__(self, words: np.ndarray, edges: np.ndarray):
        self.words, self.edges = words, edges  # blocks of all segments; where each begins
        self.sizes = np.maximum(np.diff(edges), 1).astype(np.uint64)
        self.shift = np.uint64(64 - (len(self.sizes).bit_length() - 1)) if len(self.sizes) > 1 else None

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        distinct, back = np.unique(hashes, return_inverse=True)
        return expected(self.levels(distinct))[back]

    def levels(self, distinct: np.ndarray) -> np.ndarray:
        levels = np.zeros(len(distinct), np.int64)
        seg = (distinct >> self.shift).astype(np.int64) if self.shift is not None else np.zeros(len(distinct), np.int64)
        active = np.flatnonzero(self.edges[seg + 1] > self.edges[seg])
        level = 1
        while len(active):
            block, bits = places(distinct[active], level, self.sizes[seg[active]], self.edges[seg[active]])
            active = active[(self.words[block] & bits) == bits]
            levels[active] = level
            level += 1
            if level > 48:
                break
        return levels


def entered(values: np.ndarray, levels: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The 64-bit blocks of one segment's filter, with so many bits for each of its entries."""
    blocks = -(-int(levels.sum()) * bits // 64)
    words = np.zeros(blocks, np.uint64)
    for q in range(1, int(levels.max(initial=0)) + 1):
        block, bits = places(values[levels >= q], q, np.uint64(max(blocks, 1)), 0)
        np.bitwise_or.at(words, block, bits)
    return words


def score(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds to the ids of `docs`: n_tokens, n_known, train_tokens (long), base_score and score, both log10 probabilities of the whole text.

    Learns from `train` (text). base_score has exact counts of single tokens plus one. `score` is a 4-gram model: counts c' come from
    the filter, p(w) = (c'(w) + 1) / (N + V + 1), and p(w | v) = (min(c'(vw), c'(v)) + PRIOR p(w)) / (c'(v) + PRIOR), v being the three
    tokens before w. So it tells apart what the corpus holds once, more often, or not at all.
    Null and empty texts are one end token. Repeated rows are scored each, ids may be null; other columns are left out. With
    nothing to learn from, N and V are 0 and every base probability is 1.
    """
    asking = docs.select(*asked(docs, id_col, text_col), F.lit(False).alias("learn"), F.lit(True).alias("ask"))
    kind = docs.schema[id_col].dataType
    learning = train.select(F.lit(None).cast(kind).alias("id"), F.lit(0).cast("long").alias("key"), F.lit(False).alias("out"), F.col(text_col).alias("text"), F.lit(True).alias("learn"), F.lit(False).alias("ask"))
    return scored(asking.unionAll(learning), train.select(F.col(text_col).alias("text")), id_col)


def asked(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    return [F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), held_out(id_col, 7, 2).alias("out"), F.col(text_col).alias("text")]


def scored(rows: DataFrame, train: DataFrame, id_col: str) -> DataFrame:
    """Scores of the rows to `ask` for, from those to `learn`, whose texts are `train`."""
    spark = rows.sparkSession
    ship(spark)
    counts = written(word_counts(train, "text"), "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    segments = 1 << max(0, (int(total) // SEGMENT_TOKENS).bit_length())
    kind = rows.schema["id"].dataType.simpleString()
    bits = min(64, (3 * int(total)).bit_length() + SPARE_BITS)
    parts = parted(rows)
    # As many tasks as the corpus needs, whatever the session's number: two segments or two parts each, about.
    at_least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    answers = written(gram_levels(parts, segments, bits, max(at_least, segments // 2)), "gram-levels")
    tasks = max(at_least, parts.count() // 2)
    found = frequent(counts)  # FREQUENT rows at most, as two arrays: a dict of them takes ten times their bytes in every worker
    often = spark.sparkContext.broadcast((pa.array(list(found), pa.binary()), np.array(list(found.values()), np.float64)))

    def partial(left: pa.Table, right: pa.Table) -> pa.Table:
        frequent_words, logs = often.value
        table = rows_of(left["payload"][0])
        texts = table["text"].combine_chunks()
        one, context, whole, starts = grams(texts)
        order = np.argsort(right["seg"].to_numpy())
        levels = right["levels"].to_pylist()
        found = expected(np.frombuffer(b"".join(levels[i] for i in order), np.uint8))
        _, back = np.unique(cut(np.concatenate([one, context, whole]), bits), return_inverse=True)
        c1, c3, c4 = (found[x] for x in np.split(back, 3))
        single = (c1 + 1) / (total + distinct + 1)
        p = (np.minimum(c4, c3) + PRIOR * single) / (c3 + PRIOR)
        model = np.add.reduceat(np.log10(np.minimum(p, 1.0)), starts[:-1])
        asks = np.array(table["ask"].to_pylist(), bool)
        words, counts = words_of(texts)
        # Distinct words of each text that is asked for, and one END, with how often it has them.
        names = pa.concat_arrays([words.dictionary.cast(pa.binary()), pa.array([END], pa.binary())])
        log = np.append(logs, np.nan)[pc.fill_null(pc.index_in(names, value_set=frequent_words), len(logs)).to_numpy()]
        pair = np.repeat(np.arange(len(texts)), counts) * len(names) + words.indices.to_numpy()
        pair, times = np.unique(np.concatenate([pair, np.arange(len(texts)) * len(names) + len(names) - 1]), return_counts=True)
        text, word = pair // len(names), pair % len(names)
        held = ~np.isnan(log[word])
        known = np.bincount(text[held], times[held], len(texts)).astype(np.int64)
        base = np.bincount(text[held], times[held] * log[word[held]], len(texts))
        joined = np.flatnonzero(~held & asks[text])
        wanted = np.flatnonzero(asks)
        index = np.concatenate([text[joined], wanted])
        last = np.arange(len(index)) >= len(joined)
        row = lambda x, kind: pa.array(x[index], kind, mask=~last)
        rare = names.take(pa.array(np.concatenate([word[joined], np.zeros(len(wanted), np.int64)]), mask=last))
        times = np.concatenate([times[joined], np.zeros(len(wanted), np.int64)])
        return pa.table(
            {
                **{c: table[c].take(pa.array(index)) for c in ("id", "key", "out")},
                "word": rare,
                "times": pa.array(times, pa.int64()),
                "n_tokens": row(counts + 1, pa.int64()),
                "known": row(known, pa.int64()),
                "base": row(base, pa.float64()),
                "score": row(model, pa.float64()),
            }
        )

    rows = (
        parts.where("asks")
        .repartition(tasks, "part")
        .groupBy("part")
        .cogroup(answers.repartition(tasks, "part").groupBy("part"))
        .applyInArrow(partial, f"id {kind}, key long, out boolean, word binary, times long, n_tokens long, known long, base double, score double")
        # A row without a word stands for its document; a key of its own keeps such rows from meeting in one task.
        .withColumn("word", F.coalesce("word", F.concat(F.lit(b" "), F.encode(F.concat_ws(" ", "id", "key"), "utf-8"))))
    )
    # What is joined has no very frequent word: those are in `often`.
    joined = rows.join(counts, "word", "left")
    sums = joined.groupBy("id", "key").agg(
        F.count("n_tokens").alias("copies"),
        F.max("out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        F.max("known").alias("known"),
        F.max("base").alias("base"),
        F.max("score").alias("score"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times") * F.log10(F.col("n") + 1)).otherwise(0.0)).alias("more_base"),
    )
    return sums.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("known") + (F.col("more") / F.col("copies"))).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("more_base") / F.col("copies") - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))).alias("base_score"),
        "score",
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"),
    ).drop("copy")


def score_fold(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all documents, learned outside the fold crc32(id) mod 7 = 2."""
    rows = docs.select(*asked(docs, id_col, text_col), (~held_out(id_col, 7, 2)).alias("learn"), F.lit(True).alias("ask"))
    return scored(rows, docs.where(~held_out(id_col, 7, 2)).select(F.col(text_col).alias("text")), id_col)


#: DuckDB, for base_score and the counts of small tables in tests: the fold is passed in as a table, as DuckDB has no crc32.
BASE_SQL = r"""
WITH t AS (SELECT doc_id, held_out, list_append(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> ''), chr(10)) AS w FROM docs),
u AS (SELECT doc_id, held_out, unnest(w) AS w FROM t),
c AS (SELECT w, count(*) AS n FROM u WHERE NOT held_out GROUP BY w),
s AS (SELECT coalesce(sum(n), 0) AS total, count(*) AS v FROM c)
SELECT u.doc_id, count(*) AS n_tokens, count(c.n) AS n_known, sum(log10((coalesce(c.n, 0) + 1) / CAST(total + v + 1 AS DOUBLE))) AS base_score
FROM u LEFT JOIN c ON u.w = c.w, s GROUP BY u.doc_id
"""
