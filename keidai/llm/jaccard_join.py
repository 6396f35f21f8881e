"""N-gram Jaccard join: MinHash bands bring similar texts together, whole n-gram sets decide."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keidai.llm.common import ship, small, written
from keidai.llm.token_files import blocks

WORDS = 5  # words of an n-gram
THRESHOLD = 0.8
#: Of pairs just at the threshold, the share that shares a band.
RECALL = 0.999
#: Hashes a signature may have, at most: more of them would tell dissimilar texts apart better.
HASHES = 150
#: Texts of a bucket whose signatures are held against each other at once, about.
BUCKET_TEXTS = 2_000
#: Candidates whose signatures agree less are told apart without their sets: so many standard errors under the threshold, which loses one pair of three million.
DEVIATIONS = 5.0
#: n-grams of a block of texts, about: two blocks are compared at a time.
BLOCK_GRAMS = 150_000
#: A text counts as so many, at least, so that a block has few hundred texts.
LEAST_GRAMS = 300
SEED = 20240229

_BYTE = np.full(256, 255, np.uint8)  # bytes that aren't in words
_BYTE[128:] = np.arange(128, 256)
for _c in range(256):
    if chr(_c).isalnum() and _c < 128:
        _BYTE[_c] = ord(chr(_c).lower())
_WORD = np.zeros(256, bool)
_WORD[128:] = True
for _c in range(128):
    _WORD[_c] = chr(_c).isalnum()


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows with which 1 - (1 - threshold^rows)^bands reaches `recall` within `hashes`."""
    best = (max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold))), 1)
    for rows in range(2, hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows > hashes:
            break
        best = (bands, rows)
    return best


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word: a run of ASCII letters, digits and non-ASCII characters, with A-Z read as a-z."""
    word = _WORD[data]
    edges = np.diff(word.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    # Eight bytes at a time, each mixed with its place: sums over a word are then the hash of its bytes.
    low = _BYTE[data].astype(np.uint64)
    owner = np.repeat(np.arange(len(starts)), ends - starts)
    at = np.flatnonzero(word)
    place = (at - starts[owner]).astype(np.uint64)
    each = _mix(low[at] + (place + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    total = np.add.reduceat(each, np.concatenate([[0], np.cumsum(ends - starts)[:-1]]))
    return _mix(total + (ends - starts).astype(np.uint64)), starts


def gram_sets(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, sorted, one text after another; and where each begins. A shorter text is one n-gram."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    hashes, starts = word_hashes(data)
    edges = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    firsts = np.searchsorted(starts, edges)
    out, sizes = [], np.zeros(len(texts) + 1, np.int64)
    for i in range(len(texts)):
        h = hashes[firsts[i] : firsts[i + 1]]
        if not len(h):
            continue
        k = min(words, len(h))
        g = h[: len(h) - k + 1].copy()
        for j in range(1, k):
            g = _mix(g) * np.uint64(3) + h[j : len(h) - k + 1 + j]
        g = np.unique(_mix(g + np.uint64(k)))
        out.append(g)
        sizes[i + 1] = len(g)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.cumsum(sizes)


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int, bands: int, rows: int) -> DataFrame:
    """id, text_h, set_a, set_b (128 bits of the n-gram set), n_grams, bands (array of 64-bit band hashes), sig (a byte of each MinHash) of every text that has a word."""
    rng = np.random.default_rng(SEED)
    odd = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in blocks(batch, "text", 1_000_000):
                part = batch.slice(a, b - a)
                sets, at = gram_sets(part.column("text").to_pylist(), words)
                full = np.flatnonzero(np.diff(at))
                if not len(full):
                    continue
                first = at[:-1][full]
                mins = np.empty((len(full), bands * rows), np.uint64)
                for k in range(bands * rows):
                    mins[:, k] = np.minimum.reduceat(sets * odd[k] + add[k], first)
                keys = np.zeros((len(full), bands), np.uint64)
                for r in range(rows):
                    keys = _mix(keys * np.uint64(5) + _mix(mins[:, r::rows] + np.uint64(r)))
                keys = _mix(keys + np.arange(bands, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15))
                values = pa.array(keys.astype(np.int64).ravel())
                ends = pa.py_buffer((np.arange(len(full) + 1, dtype=np.int32) * bands * rows).tobytes())
                sig = pa.Array.from_buffers(pa.binary(), len(full), [None, ends, pa.py_buffer(_mix(mins).astype(np.uint8).tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(pa.array(full)),
                        part.column("text_h").take(pa.array(full)),
                        pa.array(np.add.reduceat(_mix(sets), first).astype(np.int64)),
                        pa.array(np.add.reduceat(_mix(sets ^ np.uint64(SEED)), first).astype(np.int64)),
                        pa.array(np.diff(at)[full]),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * bands), values),
                        sig,
                    ],
                    names=["id", "text_h", "set_a", "set_b", "n_grams", "bands", "sig"],
                )

    schema = T.StructType(
        [T.StructField("id", docs.schema[id_col].dataType)]
        + [T.StructField(c, T.LongType()) for c in ("text_h", "set_a", "set_b", "n_grams")]
        + [T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())]
    )
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_h"), F.col(text_col).alias("text")).mapInArrow(sketch, schema)


def alike(sigs: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Edges enough to connect all rows of which at least this share of places is equal, in any number of steps: a search that holds each row it comes to against those it hasn't come to."""
    left, out = np.arange(len(sigs)), []
    while len(left) > 1:
        waiting, left = [left[0]], left[1:]
        while waiting and len(left):
            x = waiting.pop()
            near = (sigs[left] == sigs[x]).sum(1) >= least * sigs.shape[1]
            if near.any():
                out += [(int(x), int(y)) for y in left[near]]
                waiting += left[near].tolist()
                left = left[~near]
    return out


def candidate_edges(sketched: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """a, b: edges that connect the texts of a bucket whose signatures agree in at least this share, as many as texts at most.

    `sketched` holds a row (rep, bands, sig) for each n-gram set. Buckets of the same texts are looked at once. Those of a large bucket are dealt
    into blocks and each pair of blocks is a group of its own, so no group grows with its bucket.
    """
    one = sketched.join(sets.select("rep", "rep_h"), (F.col("id") == F.col("rep")) & (F.col("text_h") == F.col("rep_h")))
    banded = one.select("rep", F.explode_outer("bands").alias("band")).where("band IS NOT NULL").distinct()
    buckets = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("least"), F.bit_xor(F.xxhash64("rep")).alias("texts")).where("n > 1")
    kept = written(buckets.groupBy("n", "least", "texts").agg(F.min("band").alias("band")).select("band", F.ceil(F.col("n") / BUCKET_TEXTS).cast("int").alias("blocks")), "jaccard-buckets")
    entries = banded.join(kept, "band").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks").cast("long")).cast("int"))
    signed = entries.join(one.groupBy(F.col("rep").alias("s_rep")).agg(F.min("sig").alias("sig")), F.col("rep") == F.col("s_rep"))
    # A pair of blocks also holds the pairs within each, so only a bucket of one block is paired with itself.
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("block"))))
    tiles = signed.select("*", other.alias("with")).select("band", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "rep", "sig")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def edges(rows: pa.RecordBatch) -> pa.RecordBatch:
            """Of whole groups."""
            reps = rows.column("rep").to_numpy()
            sigs = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint8).reshape(len(reps), -1)
            new = new_group(rows)
            edges = np.append(np.flatnonzero(new), len(reps))
            two = edges[:-1][np.diff(edges) == 2]
            two = two[(sigs[two] == sigs[two + 1]).sum(1) >= least * sigs.shape[1]]
            pairs = [np.stack([reps[two], reps[two + 1]], 1)]
            for a, b in zip(edges, edges[1:]):
                if b - a > 2 and (found := alike(sigs[a:b], least)):
                    pairs.append(reps[a:b][np.array(found)])
            pairs = np.concatenate(pairs)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], names=["a", "b"])

        def new_group(rows: pa.RecordBatch) -> np.ndarray:
            keys = [rows.column(c).to_numpy() for c in ("band", "i", "j")]
            return np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], 0)])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.concat_batches([*held, batch])
            last = int(np.flatnonzero(new_group(rows))[-1])  # the last group may go on in the next batch
            if last:
                yield edges(rows.slice(0, last))
            held = [rows.slice(last)]
        if held:
            yield edges(held[0])

    return tiles.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(link, "a long, b long")


def components(edges: DataFrame, name: str) -> DataFrame:
    """node, root: the least node of each connected component, for all nodes of `edges` (a, b).

    Alternates large-star and small-star steps until no edge changes; every step is a grouping and a join of two tables,
    written between steps. A step makes no more edges than it had, and only counts come to the driver.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = small(written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{name}-least"))
        large = written(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), f"{name}-large")
        low = small(written(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}-low"))
        linked = large.join(low, "a")
        now = written(linked.select("a", F.col("m").alias("b")).unionByName(linked.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct(), f"{name}-small")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionByName(now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))


def compare(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Which texts of `left` and `right` (None: `left` again) have n-gram sets of at least this Jaccard similarity."""
    same = right is None
    sets = left if same else left + right
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    column = np.cumsum(np.concatenate([[0], every[1:] != every[:-1]]))
    shared = np.bincount(column)[column] > 1  # an n-gram of one text joins no two
    column, owner = column[shared], owner[shared]
    n, m = len(left), len(left) if same else len(right)
    common = np.zeros((n, m), np.float32)
    for a in _runs(column, 2048):
        cols = column[a] - column[a.start]
        dense = np.zeros((len(sets), int(cols[-1]) + 1), np.float32)
        dense[owner[a], cols] = 1
        common += dense[:n] @ (dense[:n] if same else dense[n:]).T
    union = sizes[:n, None] + (sizes[None, :n] if same else sizes[None, n:]) - common
    found = common >= threshold * union - 1e-6
    if same:
        np.fill_diagonal(found, False)
    return found


def _runs(column: np.ndarray, width: int) -> Iterator[slice]:
    """Slices of sorted columns that span fewer than `width` values each."""
    a = 0
    while a < len(column):
        b = int(np.searchsorted(column, column[a] + width))
        yield slice(a, b)
        a = b


def forest(found: np.ndarray, left: list[int], right: list[int]) -> list[tuple[int, int]]:
    """Edges enough to connect what the links connect: at most one for each text."""
    parent = {x: x for x in [*left, *right]}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(found)):
        a, b = root(left[i]), root(right[j])
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((max(a, b), min(a, b)))
    return out


def verified(members: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, threshold: float) -> DataFrame:
    """node, links, other: for each text of a candidate component the links found in one pair of blocks, or (links 0) an edge to `other`.

    `members` (node, root, text_h, n_grams): the texts of each component are dealt into blocks of about BLOCK_GRAMS n-grams, and
    each pair of blocks meets in one group, so a component of any size is spread over tasks of equal, bounded work. In components of
    several blocks, texts are dealt by size first: sets whose sizes differ by more than the threshold allows can't be similar, so a
    size class meets itself and the next one only.
    """
    columns = ["node", "root", "class", "block", "blocks", "up", "down"]

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in blocks(batch, "text"):
                part = batch.slice(a, b - a)
                sets, at = gram_sets(part.column("text").to_pylist(), words)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(sets.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), lists], names=[*columns, "grams"])

    weight = F.sum(F.greatest("n_grams", F.lit(LEAST_GRAMS)))
    width = -math.log(min(0.999 * threshold, 0.999))
    whole = small(written(members.groupBy("root").agg(weight.alias("weight")), "jaccard-weights"))
    by_size = F.when(F.col("weight") <= BLOCK_GRAMS, F.lit(0)).otherwise(F.floor(F.log(F.col("n_grams").cast("double")) / width)).cast("int")
    classed = members.join(whole, "root").withColumn("class", by_size).drop("weight")
    sizes = written(classed.groupBy("root", "class").agg(F.ceil(weight / BLOCK_GRAMS).cast("int").alias("blocks")), "jaccard-classes-of-size")
    next_to = lambda step, name: small(sizes.select("root", (F.col("class") - step).alias("class"), F.col("blocks").alias(name)))
    sized = classed.join(small(sizes), ["root", "class"]).join(next_to(1, "up"), ["root", "class"], "left").join(next_to(-1, "down"), ["root", "class"], "left").fillna(0, ["up", "down"])
    dealt = written(sized.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")).select(*columns, "text_h"), "jaccard-members")
    texts = docs.select(F.col(id_col).alias("d_id"), F.col(text_col).alias("text")).join(small(dealt), (F.col("d_id") == F.col("node")) & (F.xxhash64("text") == F.col("text_h")))
    sets = texts.select(*columns, "text").mapInArrow(sets_of, "node long, root long, class int, block int, blocks int, up int, down int, grams array<long>")

    def meets(with_class: int, number: str, first: bool | None) -> Column:
        """Groups that a text is in with the blocks of a size class: class and block of both, and whether the text is on the second side."""
        others = F.when(F.col(number) > 0, F.sequence(F.lit(0), F.greatest(F.col(number) - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        own, other = (F.col("class"), F.col("block")), lambda x: (F.col("class") + with_class, x)
        group = lambda a, b, second: F.struct(a[0].alias("ca"), a[1].alias("i"), b[0].alias("cb"), b[1].alias("j"), second.alias("second"))
        if first is None:
            return F.transform(others, lambda x: group((own[0], F.least(own[1], x)), (own[0], F.greatest(own[1], x)), own[1] > x))
        return F.transform(others, lambda x: group(own, other(x), F.lit(False)) if first else group(other(x), own, F.lit(True)))

    tiles = sets.select("root", "node", "grams", F.explode(F.concat(meets(0, "blocks", None), meets(1, "up", True), meets(-1, "down", False))).alias("t")).select("root", "t.*", "node", "grams")
    key = ["root", "ca", "i", "cb", "j"]

    def tile(rows: list[dict]) -> list[tuple[int, int, int]]:
        rows = list({r["node"]: r for r in rows}.values())  # repeated rows
        same = rows[0]["key"][1:3] == rows[0]["key"][3:]
        left, right = [r for r in rows if not r["second"]], [r for r in rows if r["second"]]
        if len(left) < 2 if same else not left or not right:
            return []
        found = compare([r["grams"] for r in left], None if same else [r["grams"] for r in right], threshold)
        nodes, others = [r["node"] for r in left], [r["node"] for r in (left if same else right)]
        out = [(n, int(k), n) for n, k in zip(nodes, found.sum(1)) if k]
        if not same:
            out += [(n, int(k), n) for n, k in zip(others, found.sum(0)) if k]
        return out + [(x, 0, y) for x, y in forest(found, nodes, others)]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        out: list[tuple[int, int, int]] = []

        def emit():
            batch = pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], names=["node", "links", "other"])
            out.clear()
            return batch

        for batch in batches:
            grams = batch.column("grams")
            values, offsets = grams.values.to_numpy(zero_copy_only=False), grams.offsets.to_numpy()
            keys = zip(*(batch.column(c).to_pylist() for c in key))
            for k, (group, node, second) in enumerate(zip(keys, batch.column("node").to_pylist(), batch.column("second").to_pylist())):
                if held and held[0]["key"] != group:
                    out += tile(held)
                    held = []
                held.append({"key": group, "node": node, "second": second, "grams": values[offsets[k] : offsets[k + 1]].copy()})
            if len(out) > 50_000:
                yield emit()
        if held:
            out += tile(held)
        yield emit()

    return tiles.repartition(*key).sortWithinPartitions(*key).mapInArrow(check, "node long, links long, other long")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Near-duplicate classes: one row an id with class_id, n_links (to other texts) and n_copies (texts of the same n-grams).

    Texts are compared as sets of 5-word n-grams (words: runs of ASCII letters and digits and of non-ASCII characters, A-Z
    as a-z; a text of fewer words is one n-gram). Two texts are linked if their sets' Jaccard similarity reaches the
    threshold; class_id is the least id that links, in any number of steps, lead to. Texts of equal sets are one text: one
    stands for all (n_copies, itself included), and n_links counts the different linked sets, each once. Candidates share one
    of the MinHash bands that bands_for() gives and agree in enough of all MinHashes, or are connected by such pairs; whole sets decide
    over all pairs of a component.

    Null, empty and wordless texts are classes of their own with n_copies 1. Rows of a null id are left out. Ids must be
    whole numbers; rows of one id count once, by one of its texts. Other columns are left out, whatever their names.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("jj_id"), F.col(text_col).alias("jj_text"))
    bands, rows = bands_for(threshold, recall)
    sketched = written(sketches(docs, "jj_id", "jj_text", words, bands, rows), "jaccard-sketches")
    one = sketched.groupBy("id").agg(F.min(F.struct("text_h", "set_a", "set_b", "n_grams")).alias("s")).select("id", "s.*")
    # Copies: a row a set. Grouping combines before the shuffle, so a third of all rows in one group is a row a task.
    sets = written(
        one.groupBy("set_a", "set_b")
        .agg(F.min(F.struct("id", "text_h")).alias("r"), F.count(F.lit(1)).alias("copies"), F.max("n_grams").alias("n_grams"))
        .select("set_a", "set_b", F.col("r.id").alias("rep"), F.col("r.text_h").alias("rep_h"), "copies", "n_grams"),
        "jaccard-sets",
    )
    reps = sets.select(F.col("rep").alias("node"), F.col("rep_h").alias("text_h"), "n_grams")
    least = threshold - DEVIATIONS * math.sqrt(threshold * (1 - threshold) / (bands * rows))
    candidates = components(candidate_edges(sketched, sets, least), "candidates")
    members = reps.join(written(candidates, "jaccard-candidates"), "node").select("node", "root", "text_h", "n_grams")
    found = written(verified(members, docs, "jj_id", "jj_text", words, threshold), "jaccard-found")
    links = found.where("links > 0").groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(found.where("links = 0").select(F.col("node").alias("a"), F.col("other").alias("b")), "classes")
    known = written(
        sets.join(links.withColumnRenamed("node", "rep"), "rep", "left").join(classes.withColumnRenamed("node", "rep"), "rep", "left").select("set_a", "set_b", "rep", "copies", "root", "links"), "jaccard-classes"
    )
    by_id = sketched.select("id", "text_h", "set_a", "set_b").join(known, ["set_a", "set_b"]).groupBy(F.col("id").alias("k_id"))
    by_id = by_id.agg(F.min(F.struct("text_h", F.coalesce("root", "rep").alias("root"), "links", "copies")).alias("k"))
    return (
        docs.where(F.col("jj_id").isNotNull())
        .select("jj_id")
        .distinct()
        .join(by_id, F.col("jj_id") == F.col("k_id"), "left")
        .select(
            F.col("jj_id").alias(id_col),
            F.coalesce("k.root", "jj_id").alias("class_id"),
            F.coalesce("k.links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("k.copies", F.lit(1)).cast("long").alias("n_copies"),
        )
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose id is the least of its class, with all their columns; rows of a null id stay."""
    gone = "jj_gone"
    while gone in (c.lower() for c in docs.columns):
        gone += "_"
    joined = jaccard_join(docs, id_col, text_col).where(F.col("class_id") != F.col(id_col)).select(F.col(id_col).cast("long").alias(gone))
    return docs.join(small(written(joined, "jaccard-gone")), F.col(id_col) == F.col(gone), "left_anti")
