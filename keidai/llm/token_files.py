"""Token-ID output: flat files of unsigned integers with 64-bit document offsets, read back through memory maps."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keidai.llm.common import fresh_path, ship, written

END_ID = 2
#: Bytes of text that are encoded at once, about: the more, the fewer words are met again.
BLOCK = 8 << 20


def opened(uri: str):
    """The file system of a folder's URI, and its path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def mapped(files, path: str):
    """A file's bytes: through a memory map where the file system is local, else read whole."""
    from pyarrow import fs

    if isinstance(files, fs.LocalFileSystem):
        return pa.memory_map(path).read_buffer() if os.path.getsize(path) else pa.py_buffer(b"")
    with files.open_input_file(path) as f:
        return f.read_buffer()


#: Words of letters that are one piece of the splitter by any Unicode version, and the run of marks at their end, a piece of its own.
SIMPLE = r"^(?P<core>(?:[A-Za-zÀ-ÖØ-öø-ÿ])+)(?P<tail>[!\"#$%&()*+,\-./:;=>?@\[\]^_`{}~]*)$"
# What a vocabulary file must say for its words to be encoded on their own.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def splits_words(described: dict) -> bool:
    """Whether white space always ends a word in a vocabulary, runs of letters are whole pieces, and each piece's last id says so."""
    steps = (described.get("normalizer") or {}).get("normalizers") or []
    pre = (described.get("pre_tokenizer") or {}).get("pretokenizers") or []
    return (
        [x["type"] for x in steps] == NORMALIZERS
        and steps[1]["pattern"] == {"Regex": r"\s+"}
        and steps[1]["content"] == " "
        and [x["type"] for x in pre] == ["Split", "ByteLevel"]
        and (pre[0]["pattern"], pre[0]["behavior"], pre[0]["invert"]) == ({"Regex": SPLIT}, "Removed", True)
        and not pre[1]["add_prefix_space"]
        and not pre[1]["use_regex"]
        and described["model"]["type"] == "BPE"
        and described["model"]["end_of_word_suffix"] == "</w>"
        and not described["model"]["dropout"]
        and all(x["content"].startswith("<|") and x["content"].endswith("|>") and not re.search(r"\s", x["content"]) for x in described["added_tokens"])
    )


def spread(starts: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the elements of the pieces `which`, one piece after another, and where each ends."""
    n = lengths[which]
    ends = np.cumsum(n)
    return np.repeat(starts[which] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0), ends


class WordEncoder:
    """Ids of whole texts. If the vocabulary lets words be told apart, each distinct word of a block is encoded once; else texts are encoded as they are."""

    def __init__(self, vocabulary: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(vocabulary)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        described = json.loads(vocabulary)
        self.by_word = splits_words(described)
        if self.by_word:
            last = [i for piece, i in described["model"]["vocab"].items() if piece.endswith("</w>")]
            self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
            self.ends[last] = True

    def each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for x in found for i in x), self.kind, int(lengths.sum())), lengths

    def pieces(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of distinct words of letters: as one text, since white space ends a word and a word's last id says that it ends there."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words.to_pylist())], add_special_tokens=False)[0].ids, self.kind)
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words):
            raise ValueError("a word without an end of its own: the vocabulary isn't what it says")
        return ids, np.diff(stops, prepend=0)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text begins and the last ends."""
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            ids, lengths = self.each(texts.to_pylist())
            return ids, np.concatenate([[0], np.cumsum(lengths)])
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        core, tail = pc.extract_regex(words.dictionary, SIMPLE).flatten()
        simple = core.is_valid().to_numpy(zero_copy_only=False)
        tailed = pc.fill_null(pc.greater(pc.binary_length(tail), 0), False).to_numpy(zero_copy_only=False)
        cores = pc.utf8_lower(core.filter(pa.array(simple))).dictionary_encode()
        others = pa.concat_arrays([words.dictionary.filter(pa.array(~simple)), tail.filter(pa.array(tailed))]).dictionary_encode()
        parts = [self.pieces(cores.dictionary), self.each(others.dictionary.to_pylist())]
        ids, lengths = (np.concatenate(x) for x in zip(*parts))
        # Each word is a piece, or one and its tail.
        at = np.concatenate([[0], np.cumsum(1 + tailed)]).astype(np.int64)
        which = np.empty(at[-1], np.int64)
        rest = len(cores.dictionary) + others.indices.to_numpy()
        which[at[:-1][simple]] = cores.indices.to_numpy()
        which[at[:-1][~simple]] = rest[: len(rest) - tailed.sum()]
        which[at[1:][tailed] - 1] = rest[len(rest) - tailed.sum() :]
        places, ends = spread(np.cumsum(lengths) - lengths, lengths, which)
        ids, ends = ids[places], np.concatenate([[0], ends])[at]
        places, ends = spread(ends[:-1], np.diff(ends), words.indices.to_numpy())
        return ids[places], np.concatenate([[0], ends])[split.offsets.to_numpy()]


def file_bytes(path: str) -> bytes:
    """A vocabulary file, read on the driver; it is broadcast, so executors need no copy of it."""
    with open(path, "rb") as f:
        return f.read()


def blocks(batch: pa.RecordBatch, text_col: str, size: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch that hold about `size` bytes of text, or one longer text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > size:
            yield start, i
            start, held = i, 0
        held += int(n)
    if start < len(sizes):
        yield start, len(sizes)


def gathered(batches: Iterator[pa.RecordBatch], text_col: str, size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about so many bytes of text, or of one longer text."""
    held, n = [], 0
    for batch in batches:
        for a, b in blocks(batch, text_col, size):
            held.append(batch.slice(a, b - a))
            n += held[-1].column(text_col).nbytes
            if n >= size:
                yield pa.concat_batches(held)
                held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def write_tokens(docs: DataFrame, vocabulary: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Encodes all texts and writes them in ascending id order; returns the manifest.

    Each task writes `part-N.bin` (ids, unsigned 16-bit if the vocabulary fits, else 32-bit, little-endian), `part-N.idx`
    (document starts within the part and its end, 64-bit) and `part-N.doc` (validity and id, 64-bit each). Files are written
    under a name of their own and renamed, so a repeated attempt replaces them with the same bytes. The manifest has a
    row a part: part, n_docs, n_tokens, and base, the ids in all parts before it, by a prefix sum.
    """
    spark = docs.sparkSession
    ship(spark)
    words = spark.sparkContext.broadcast(file_bytes(vocabulary))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        encode = WordEncoder(words.value)  # goes with the task
        files, path = opened(folder)
        lengths, ids, n, out = [np.zeros(1, "<i8")], [], 0, None
        name = f"{path}/part-{part:05d}"
        for rows in gathered(batches, "text", BLOCK):
            if out is None:
                out = files.open_output_stream(f"{name}.bin.{attempt}")
            encoded, at = encode(rows.column("text"))
            out.write(np.insert(encoded, at[1:], end_id).tobytes())
            lengths.append((np.diff(at) + 1).astype("<i8"))
            valid = rows.column("id").is_valid().to_numpy(zero_copy_only=False).astype("<i8")
            ids.append(np.stack([valid, pc.fill_null(rows.column("id"), 0).to_numpy(zero_copy_only=False).astype("<i8")], 1))
            n += rows.num_rows
        if out is None:
            return
        out.close()
        starts = np.cumsum(np.concatenate(lengths)).astype("<i8")
        for ending, content in (("idx", starts), ("doc", np.concatenate(ids))):
            with files.open_output_stream(f"{name}.{ending}.{attempt}") as f:
                f.write(content.tobytes())
        for ending in ("bin", "idx", "doc"):
            files.move(f"{name}.{ending}.{attempt}", f"{name}.{ending}")
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array([part], pa.int32()), "width": pa.array([encode.kind.itemsize], pa.int32()), "n_docs": pa.array([n], pa.int64()), "n_tokens": pa.array([int(starts[-1])], pa.int64())}
        )

    files, path = opened(folder)
    files.create_dir(path, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    parts = written(rows.repartitionByRange("id").sortWithinPartitions("id", "text").mapInArrow(write, "part int, width int, n_docs long, n_tokens long"), "token-parts")
    # A row a file, not a document: one window over them all stays small.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    manifest = parts.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))
    manifest = written(manifest, "token-manifest")
    return manifest


def read_tokens(manifest: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """Documents from the files: id, start (ids of all documents before it), n_tokens, ids_crc32 of the ids as unsigned 32-bit integers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = opened(folder)
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{path}/part-{row['part']:05d}"
                ids = np.frombuffer(mapped(files, f"{name}.bin"), f"<u{row['width']}")
                starts = np.frombuffer(mapped(files, f"{name}.idx"), "<i8")
                docs = np.frombuffer(mapped(files, f"{name}.doc"), "<i8").reshape(-1, 2)
                for a in range(0, len(docs), 10_000):
                    b = min(a + 10_000, len(docs))
                    crc = [zlib.crc32(ids[starts[i] : starts[i + 1]].astype("<u4").tobytes()) for i in range(a, b)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(docs[a:b, 1], pa.int64(), mask=docs[a:b, 0] == 0),
                            pa.array(starts[a:b] + row["base"], pa.int64()),
                            pa.array(starts[a + 1 : b + 1] - starts[a:b], pa.int64()),
                            pa.array(crc, pa.int64()),
                        ],
                        names=[id_col, "start", "n_tokens", "ids_crc32"],
                    )

    return manifest.repartition("part").mapInArrow(read, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Writes all documents' ids to files in the shared folder and returns what reading them back gives.

    Null and empty texts are the end id alone. A null id comes before all others; rows of one id follow in the order of
    their texts, repeated rows each on their own. An empty table gives no files and no rows. Strings of special tokens in
    a text are read as the vocabulary file says. Ids must be integers; other columns are left out.
    """
    folder = fresh_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, vocabulary, folder, id_col, text_col, end_id), folder, id_col)
