"""Phrase collocations: frequent phrases level by level, counted by the slots of a minimal perfect hash."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keidai.llm.common import delete, fresh_path, ship, written
from keidai.llm.slots import Slots
from keidai.llm.token_files import gathered

LEAST, LONGEST, FIRST = 100, 5, 2000
#: Characters that end a piece, and those that part words.
STOPS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: Bytes of text in a row of encoded words, about.
BLOCK = 4 << 20
#: Candidates that one pass has slots for; more take more passes over the encoded words.
SLOTS = 2 << 20
#: Keys that a task gathers before it tells them apart.
GATHER = 2 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
KIND = np.zeros(256, np.uint8)  # of bytes: 0 in a word, 1 between words, 2 between pieces
KIND[list(BLANKS)] = 1
KIND[list(STOPS)] = 2


def encoded(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of all words in turn, 0 between pieces and 1 + the word's place among the distinct words; the distinct words; their counts."""
    end, nothing = pa.scalar(b"\n", pa.large_binary()), pa.scalar(b"", pa.large_binary())
    ended = pc.binary_join_element_wise(pc.cast(pc.fill_null(texts, ""), pa.large_binary()), end, nothing)
    _, offsets, data = ended.buffers()
    at = np.frombuffer(offsets, np.int64)[ended.offset : ended.offset + len(ended) + 1]
    text = LOWER[np.frombuffer(data, np.uint8)[at[0] : at[-1]]]
    if not len(text):
        return np.empty(0, np.int32), pa.array([], pa.string()), np.empty(0, np.int64)
    kind = KIND[text]
    # Runs of bytes of a word, or of bytes between words: every run is a string of one array, so Arrow tells them apart.
    inside = kind == 0
    starts = np.concatenate([[0], np.flatnonzero(inside[1:] != inside[:-1]) + 1])
    is_word = inside[starts]
    stop = np.maximum.reduceat(kind, starts) == 2
    runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(text)).astype(np.int64)), pa.py_buffer(text)])
    words = runs.filter(pa.array(is_word)).dictionary_encode()
    codes = np.zeros(len(starts), np.int32)
    codes[is_word] = words.indices.to_numpy() + 1
    return codes[is_word | stop], pc.cast(words.dictionary, pa.string()), np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))


def encode_words(docs: DataFrame) -> DataFrame:
    """Rows (lang, text) as rows lang, n (words), codes (32-bit), words and counts of the distinct ones: some MB of text of one language each."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in gathered(batches, "text", BLOCK):
            langs = rows.column("lang").dictionary_encode()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                codes, words, counts = encoded(rows.column("text").filter(pc.equal(langs.indices, i)))
                if len(words):
                    yield pa.RecordBatch.from_pydict({
                        "lang": pa.array([lang], pa.string()), "n": pa.array([counts.sum()], pa.int64()), "codes": pa.array([codes.tobytes()], pa.binary()),
                        "words": pa.array([words], pa.list_(pa.string())), "counts": pa.array([counts], pa.list_(pa.int64())),
                    })

    return docs.mapInArrow(encode, "lang string, n long, codes binary, words array<string>, counts array<long>")


def word_key(entry: bytes) -> int:
    """The same as Spark's xxhash64 of a string."""
    return xxhash.xxh64_intdigest(entry, 42)


class Words:
    """Numbers of the frequent words of one group: slots of their hashes, each with its word for verification."""

    def __init__(self, rows: pa.Table) -> None:
        self.slots = Slots(rows["key"].to_numpy().view(np.uint64))
        order = np.argsort(self.slots(rows["key"].to_numpy().view(np.uint64)))
        self.entries = rows["entry"].combine_chunks().take(pa.array(order))

    def __len__(self) -> int:
        return len(self.slots)

    def places(self, keys: np.ndarray) -> np.ndarray:
        return self.slots.places(keys)

    def __call__(self, lang: str, words: pa.Array) -> np.ndarray:
        entries = pc.binary_join_element_wise(lang, words, "\t")
        found = self.slots(np.fromiter((word_key(e.encode()) for e in entries.to_pylist()), np.uint64, len(entries)))
        there = np.flatnonzero(found >= 0)
        same = pc.equal(self.entries.take(pa.array(found[there])), entries.take(pa.array(there))).to_numpy(zero_copy_only=False)
        found[there[~same]] = -1
        return found


def group_of(groups: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(groups))


@dataclass
class Places:
    """Where phrases of the level before begin in a block, their numbers, and the numbers of their last words."""

    at: np.ndarray
    last: np.ndarray
    tail: np.ndarray

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Which phrases another one follows a word later, and the keys of both as a phrase of a word more: the first one's number and the second's last word.

        Only Apriori-safe ones: the phrases without the last word and without the first one are both frequent.
        """
        i = np.flatnonzero(np.diff(self.at) == 1)
        return i, self.last[i].astype(np.int64) << 32 | self.tail[i + 1]


def integers(value: bytes | None) -> np.ndarray | None:
    return None if value is None else np.frombuffer(value, "<i4")


def places(row: dict) -> Places:
    """Of a block: all words' numbers in turn, 0 for those that aren't frequent and between pieces; of longer phrases only where there is one."""
    last = integers(row["last"])
    if row["at"] is None:
        at = np.flatnonzero(last > 0)
        return Places(at, last[at], last[at])
    return Places(integers(row["at"]), last, integers(row["tail"]))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns)}


def candidates(tokens: DataFrame, words: int, least: int) -> DataFrame:
    """Keys of the Apriori-safe phrases that occur often enough by a sum of what tasks find."""

    def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[first], np.add.reduceat(counts[order], first, dtype=np.int32)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def batches_of(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + 100_000]), pa.array(counts[a : a + 100_000])], names=["key", "n"])

        for row in rows_of(batches):
            _, keys = places(row).keys()
            if not len(keys):
                continue
            held.append(merged(keys, np.ones(len(keys), np.int32)))
            n += len(held[-1][0])
            if n >= GATHER:
                held = [merged(*(np.concatenate(x) for x in zip(*held)))]
                n = len(held[0][0])
                if n >= GATHER // 2:
                    yield from batches_of(*held[0])
                    held, n = [], 0
        if held:
            yield from batches_of(*merged(*(np.concatenate(x) for x in zip(*held))))

    found = tokens.select("at", "last", "tail").mapInArrow(gather, "key long, n int")
    return written(found.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("key"), f"phrases-{words}")


def described(level: DataFrame, before: DataFrame | None) -> DataFrame:
    """number, key, prefix, suffix, f of a level: the numbers of the phrase without its last and without its first word.

    Of a pair they are its words. Else the suffix is what the level before has for the prefix's own suffix followed by the last word.
    """
    word = F.col("key").bitwiseAND(F.lit(0xFFFFFFFF))
    level = level.select("number", "key", F.shiftright("key", 32).alias("prefix"), word.alias("word"), "f")
    if before is None:
        return level.select("number", "key", "prefix", F.col("word").alias("suffix"), "f")
    of_prefix = before.select(F.col("number").alias("prefix"), F.col("suffix").alias("middle"))
    by_key = before.select(F.col("key").alias("b_key"), F.col("number").alias("suffix"))
    joined = level.join(of_prefix, "prefix").withColumn("b_key", F.shiftleft("middle", 32).bitwiseOR(F.col("word"))).join(by_key, "b_key")
    return joined.select("number", "key", "prefix", "suffix", "f")


def added_up(rows: DataFrame, size: int) -> np.ndarray:
    """Counts by slot: one array of each task, summed in a tree."""
    arrays = rows.where(F.col("total").isNotNull()).select("total").rdd.map(lambda r: np.frombuffer(r[0], "<i8"))
    return arrays.treeAggregate(np.zeros(size, np.int64), lambda a, b: a + b, lambda a, b: a + b)


#: A block on its way from one level to the next. `next` has the numbers found so far while groups remain to be looked at, `total` a task's counts.
BLOCKS = "lang string, codes binary, words array<string>, counts array<long>, at binary, last binary, tail binary, next binary, total binary"
KINDS = {"lang": pa.string(), "words": pa.list_(pa.string()), "counts": pa.list_(pa.int64())}
ARROW = pa.schema([(c.split()[0], KINDS.get(c.split()[0], pa.binary())) for c in BLOCKS.split(", ")])


def kept_as(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows written to the shared folder, and where."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def numbered(tokens: DataFrame, path: str, level: DataFrame, words: int) -> tuple[DataFrame, str, DataFrame]:
    """Gives every place the number of the phrase of this level that begins there (1 + its slot), and counts by slot.

    Returns the blocks with these places, where they are, and the level with number and f read at each candidate's slot. A
    pass holds the slots of one group of candidates, of bounded size; there are as many groups as the candidates need. The
    blocks it was given are deleted at `path`.
    """
    spark = level.sparkSession
    groups = max(1, -(-level.count() // SLOTS))
    base, parts = 0, []
    for group in range(groups):
        rows = level.where(group_of(groups) == group).select("key", *(["entry"] if words == 1 else [])).toArrow()
        table = Words(rows) if words == 1 else Slots(rows["key"].to_numpy().view(np.uint64))
        known = spark.sparkContext.broadcast((table, base))
        final = group == groups - 1

        def mark(batches: Iterator[pa.RecordBatch], known=known, final=final) -> Iterator[pa.RecordBatch]:
            table, base = known.value
            total = np.zeros(len(table), np.int64)
            for row in rows_of(batches):
                before = integers(row["next"])
                if words == 1:
                    found = table(row["lang"], pa.array(row["words"], pa.string()))
                    np.add.at(total, found[found >= 0], np.array(row["counts"], np.int64)[found >= 0])
                    new = np.concatenate([[0], np.where(found >= 0, found + base + 1, 0)]).astype("<i4")[integers(row["codes"])]
                else:
                    p = places(row)
                    i, keys = p.keys()
                    found = table(keys)
                    total += np.bincount(found[found >= 0], minlength=len(total))
                    new = np.where(found >= 0, found + base + 1, 0).astype("<i4")
                if before is not None:
                    new = np.maximum(new, before)
                if not final:
                    out = row | {"next": new.tobytes()}
                elif words == 1:
                    out = {"last": new.tobytes()}
                elif new.any():
                    hit = new > 0
                    out = {"at": p.at[i[hit]].astype("<i4").tobytes(), "last": new[hit].tobytes(), "tail": p.tail[i[hit] + 1].tobytes()}
                else:
                    continue
                yield pa.RecordBatch.from_pylist([out], ARROW)
            yield pa.RecordBatch.from_pylist([{"total": total.tobytes()}], ARROW)

        marked, new_path = kept_as(tokens.mapInArrow(mark, BLOCKS), f"words-{words}")
        delete(spark, path)  # nothing reads the level before, or the group before, again
        path = new_path
        counts = spark.sparkContext.broadcast(added_up(marked, len(table)))

        def read(batches: Iterator[pa.RecordBatch], known=known, counts=counts) -> Iterator[pa.RecordBatch]:
            table, base = known.value
            for batch in batches:
                slots = table.places(batch.column("key").to_numpy().view(np.uint64))
                yield batch.append_column("number", pa.array(slots + base + 1, pa.int64())).append_column("f", pa.array(counts.value[slots]))

        parts.append(level.where(group_of(groups) == group).mapInArrow(read, T.StructType([*level.schema.fields, T.StructField("number", T.LongType()), T.StructField("f", T.LongType())])))
        base += len(table)
        tokens = marked.where(F.col("total").isNull())
    return tokens, path, written(reduce(DataFrame.unionAll, parts), f"level-{words}")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, first: int | None = FIRST, share: int = 100) -> DataFrame:
    """Each language's phrases of 2 to `longest` words that hold together best: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased in A-Z and split at `.,;:!?` and line ends into pieces, those at blanks and tabs into words. a is how often a phrase
    occurs within pieces (`least` times or more), n how many words its language has. A cut after the first words has l and r,
    how often both sides occur; the cut of least floor(1000 a n / (l r)) counts, of equals the earliest. Phrases inside a
    longer one (up to `longest` words) that occurs in at least `share` percent of their places are dropped. The `first` of each
    language by score, a (both descending) and phrase (by bytes) are returned, all if it is None.

    A null language is `und`; null and empty texts have no words; repeated rows count each; an empty table gives no rows.
    Counts cover all texts; a text of any length is read whole. Other columns are left out, whatever their names.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    blocks, path = kept_as(encode_words(rows), "words")
    sizes = written(blocks.groupBy("lang").agg(F.sum("n").alias("n")), "language-sizes")
    found = blocks.select("lang", F.explode(F.arrays_zip(F.col("words").alias("word"), F.col("counts").alias("m"))).alias("x")).groupBy("lang", "x.word").agg(F.sum("x.m").alias("n"))
    entry = F.concat("lang", F.lit("\t"), "word")
    level = written(found.where(F.col("n") >= least).select("lang", "word", entry.alias("entry"), F.xxhash64(entry).alias("key")), "phrases-1")
    blank = [F.lit(None).cast("binary").alias(c) for c in ("at", "last", "tail", "next", "total")]
    tokens, path, one = numbered(blocks.select("lang", "codes", "words", "counts", *blank), path, level, 1)
    none = F.array().cast("array<long>")
    phrases = one.select("number", "lang", F.col("word").alias("phrase"), F.col("word").alias("tail"), "f", none.alias("left"), none.alias("right"))
    every, before = [], None
    for words in range(2, longest + 1):
        tokens, path, level = numbered(tokens, path, candidates(tokens, words, least), words)
        before = level = written(described(level, before), f"described-{words}")
        if every:
            every[-1] = within(every[-1], level, share)
        side = lambda name: phrases.select(F.col("number").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("lang", "phrase", "tail", "f", "left", "right")])
        phrases = level.join(side("prefix"), "prefix").join(side("suffix"), "suffix").select(
            "number",
            F.col("prefix_lang").alias("lang"),
            F.concat_ws(" ", "prefix_phrase", "suffix_tail").alias("phrase"),
            F.col("suffix_tail").alias("tail"),
            "f",
            F.concat("prefix_left", F.array("prefix_f")).alias("left"),
            F.concat(F.array("suffix_f"), "suffix_right").alias("right"),
        )
        phrases = written(phrases, f"phrases-of-{words}")
        every.append(phrases)
    delete(docs.sparkSession, path)
    kept = reduce(DataFrame.unionAll, [p.select("lang", "phrase", "f", "left", "right") for p in every])
    return ranked(kept.join(sizes, "lang"), first)


def within(phrases: DataFrame, longer: DataFrame, share: int) -> DataFrame:
    """The phrases that aren't almost always inside one that has a word more; if one of several words more holds them, so does one between."""
    inside = longer.select(F.col("prefix").alias("number"), F.col("f").alias("g")).unionAll(longer.select("suffix", "f")).groupBy("number").agg(F.max("g").alias("g"))
    return phrases.join(inside.where(F.col("g").isNotNull()), "number", "left").where(F.col("g").isNull() | (100 * F.col("g") < share * F.col("f"))).drop("g")


def ranked(phrases: DataFrame, first: int | None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of rows lang, phrase, f, left, right, n. Products are decimals of 38 digits, so they are exact."""
    cuts = F.expr(
        "array_min(transform(left, (l, i) -> struct("
        "cast(1000 * cast(f as decimal(19, 0)) * cast(n as decimal(15, 0)) as decimal(38, 0)) div cast(cast(l as decimal(19, 0)) * cast(right[i] as decimal(19, 0)) as decimal(38, 0)) as score, i, l, right[i] as r)))"
    )
    rows = phrases.withColumn("cut", cuts).select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    rows = rows.withColumn("rank", place.cast("long"))
    rows = rows if first is None else rows.where(F.col("rank") <= first)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")



def _sql() -> str:
    upper = "".join(map(chr, range(65, 91)))
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[\\x20\\x09]+') IF x <> ''] AS ws FROM p),
n AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
s AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w WHERE len(ws) > 0),
g AS (SELECT lang, ws, i, unnest(range(1, least({LONGEST}, len(ws) - i + 1) + 1)) AS k FROM s),
f AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {LEAST}),
c AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
b AS (SELECT lang, f, k, ws, unnest(range(1, k + 1)) AS i FROM c WHERE k > 2),
e AS (SELECT lang, f, ws, i, k, unnest(range(i + 1, k + 1)) AS j FROM b),
o AS (SELECT lang, array_to_string(ws[i:j], ' ') AS phrase, max(f) AS f FROM e WHERE j - i + 1 < k GROUP BY ALL),
t AS (SELECT c.* FROM c LEFT JOIN o USING (lang, phrase) WHERE o.f IS NULL OR 100 * o.f < 100 * c.f),
u AS (SELECT lang, phrase, f, ws, k, unnest(range(1, k)) AS h FROM t),
v AS (SELECT u.lang, u.phrase, u.f AS a, u.h, x.f AS l, y.f AS r, n.n, (1000::HUGEINT * u.f * n.n) // (x.f::HUGEINT * y.f) AS score
      FROM u JOIN f x ON x.lang = u.lang AND x.phrase = array_to_string(ws[1:h], ' ') JOIN f y ON y.lang = u.lang AND y.phrase = array_to_string(ws[h + 1:u.k], ' ') JOIN n ON n.lang = u.lang),
q AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, h) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM q)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM r WHERE rank <= {FIRST}"""


SQL = _sql()
