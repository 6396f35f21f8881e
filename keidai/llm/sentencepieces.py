"""SentencePiece encoding and decoding: distinct marked words are sorted into a trie and walked depth-first, so words
share the forward states of their common prefixes."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from keidai.llm.common import ship, without
from keidai.llm.token_files import blocks, file_bytes

MARK = "▁"
#: Bytes of words and their ids that a task remembers, about; then it starts anew.
MEMO_BYTES = 64 << 20
ENTRY_BYTES = 180  # of two objects and their place in a dict
#: Pairs of pieces that a task remembers, at most; then it starts anew.
MEMO_PAIRS = 400_000


class Memo(dict):
    """Encoded words, of about MEMO_BYTES at most; a word that is not there is noted and reads as empty."""

    def __init__(self):
        self.noted: list = []
        self.held = 0

    def __missing__(self, word):
        self.noted.append(word)
        return b""

    def add(self, words, ids):
        for w, x in zip(words, ids):
            self[w] = x
            self.held += len(w) + len(x) + ENTRY_BYTES

    def clear(self):
        dict.clear(self)
        self.held = 0


def joined(memo: Memo, learn, split: list[list]) -> list[bytes]:
    """The encoded words of each text, one after another; `learn` is given the distinct words that the memo lacks."""
    get = memo.__getitem__
    out, incomplete, missing = [], [], set()
    for i, words in enumerate(split):
        out.append(b"".join(map(get, words)))
        if memo.noted:
            missing.update(memo.noted)
            memo.noted.clear()
            incomplete.append(i)
    if missing:
        if memo.held > MEMO_BYTES:
            memo.clear()
            missing.update(*[split[i] for i in incomplete])
        learn(missing)
        for i in incomplete:
            out[i] = b"".join(map(get, split[i]))
    return out


def bpe(word: str, score: dict[str, float]) -> list[str]:
    """Merges the adjacent pair of best score, leftmost first, until none is left. For single words and pairs of pieces."""
    parts = list(word)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            s = score.get(parts[i] + parts[i + 1])
            if s is not None and (best is None or s > best):
                best, at = s, i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Lattice:
    """Forward states over the prefixes of words.

    kind "unigram": the state of a prefix is its best log probability, and where the piece that ends it starts. kind "bpe":
    the state is the piece that ends the prefix's own encoding. That piece is the one whose pair with the state before it
    stays two pieces when merged on its own; a sequence of pieces is what merging gives if, and only if, all its pairs are.
    """

    def __init__(self, pieces: dict[str, int], scores: dict[str, float], kind: str):
        self.pieces, self.scores, self.kind = pieces, scores, kind
        self.spelled = {i: p for p, i in pieces.items()}
        self.pairs: dict[int, bool] = {}
        self.alone = {i: len(bpe(p, scores)) == 1 for p, i in pieces.items()} if kind == "bpe" else {}
        #: Pieces by their characters from the last to the first; the id of a whole piece stands under "".
        self.ending: dict = {}
        for p, i in pieces.items():
            node = self.ending
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = i

    def apart(self, left: int, right: int) -> bool:
        """Whether merging keeps these two pieces apart and whole."""
        if len(self.pairs) >= MEMO_PAIRS:
            self.pairs.clear()
        a, b = self.spelled[left], self.spelled[right]
        found = self.pairs[left << 32 | right] = bpe(a + b, self.scores) == [a, b]
        return found

    def encode_sorted(self, words: list[str]) -> Iterator[list[int]]:
        """Piece ids of each word, in sorted order; every character is a piece."""
        unigram, ending, pairs, apart, alone = self.kind == "unigram", self.ending, self.pairs, self.apart, self.alone
        score = {i: self.scores[p] for p, i in self.pieces.items()} if unigram else {}
        states: list = [0.0 if unigram else -1]  # of each prefix of the word before
        back: list[int] = [0]
        last: list[int] = [-1]
        before = ""
        for word in words:
            depth = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                depth += 1
            del states[depth + 1 :], back[depth + 1 :], last[depth + 1 :]
            for i in range(depth + 1, len(word) + 1):
                node, j, best = ending, i, None
                while j:
                    j -= 1
                    node = node.get(word[j])
                    if node is None:
                        break
                    piece = node.get("")
                    if piece is None:
                        continue
                    if unigram:
                        s = states[j] + score[piece]
                        if best is None or s >= best[0]:
                            best = (s, j, piece)
                        continue
                    left = states[j]
                    if left < 0:
                        ok = alone[piece]
                    else:
                        ok = pairs.get(left << 32 | piece)
                        if ok is None:
                            ok = apart(left, piece)
                    if ok:
                        best = (piece, j, piece)
                        break
                states.append(best[0])
                back.append(best[1])
                last.append(best[2])
            ids, i = [], len(word)
            while i:
                ids.append(last[i])
                i = back[i]
            ids.reverse()
            yield ids
            before = word


class Codec:
    """Encodes and decodes with a SentencePiece model file of byte fallback and identity normalisation."""

    def __init__(self, model: bytes, kind: str = "bpe"):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_proto=model)
        every = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        plain = [i for i in range(len(every)) if not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i) or m.is_byte(i))]
        if any(MARK in every[i].lstrip(MARK) for i in plain):
            raise ValueError("pieces with a mark inside: words can't be encoded on their own")
        pieces = {every[i]: i for i in plain}
        scores = {every[i]: m.get_score(i) for i in plain}
        self.pieces = pieces
        self.bytes = {int(every[i][3:5], 16): i for i in range(len(every)) if m.is_byte(i)}
        self.lattice = Lattice(pieces, scores, kind)
        self.chars = {p for p in pieces if len(p) == 1}
        self.outside = re.compile("([^" + "".join(re.escape(c) for c in sorted(self.chars)) + "])")
        self.spelled = [
            bytes([int(p[3:5], 16)]) if m.is_byte(i) else b"" if m.is_control(i) else "⁇".encode() if m.is_unknown(i) else p.replace(MARK, " ").encode() for i, p in enumerate(every)
        ]
        # A character that is no piece never merges: it ends a word on both sides. The line feed is by far the most frequent.
        self.words = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if "\n" not in self.chars else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.known = Memo()

    def learn(self, words: set[str]) -> None:
        """Encodes distinct marked words, the sorted ones along their trie."""
        odd = {w: self.outside.split(w) for w in words if self.outside.search(w)}
        plain = {w for w in words if w not in odd}
        for parts in odd.values():
            plain.update(p for p in parts[::2] if p)
        ties = {w for w in plain if w.startswith(MARK * 2) and self.lattice.kind == "bpe"}  # runs of marks have equal scores: the library decides
        ids = {w: self.model.encode(w[1:].replace(MARK, " ")) for w in ties}
        order = sorted(plain - ties)
        ids.update(zip(order, self.lattice.encode_sorted(order)))
        for w, parts in odd.items():
            out: list[int] = []
            for k, p in enumerate(parts):
                out += [self.bytes[b] for b in p.encode("utf-8", "replace")] if k % 2 else ids[p] if p else []
            ids[w] = out
        self.known.add(words, (array("i", ids[w]).tobytes() for w in words))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """32-bit ids of each text, as bytes; none for null or empty texts."""
        return joined(self.known, self.learn, [self.words.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts])

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes of byte pieces, marks as blanks, without the mark put before the first word."""
        return b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


def encode_pieces(docs: DataFrame, model: str, text_col: str = "text", kind: str = "bpe", decoded: str | None = None) -> DataFrame:
    """Adds ids (array<int>) and n_tokens (long) of every whole text, and with a name in `decoded` the text that the ids give.

    Null texts have null ids and no tokens, empty ones an empty array. Every other column stays; columns named as the new
    ones are replaced. Rows are encoded each on its own, repeated ones alike. Decoding here, not in a step of its own, spares
    each task a second Python worker.
    """
    ship(docs.sparkSession)
    content = docs.sparkSession.sparkContext.broadcast(file_bytes(model))
    made = ["ids", "n_tokens", *([decoded] if decoded else [])]
    docs = without(docs, made)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_pieces = Codec(content.value, kind)  # goes with the task
        for batch in batches:
            for a, b in blocks(batch, text_col):
                rows = batch.slice(a, b - a)
                texts = rows.column(text_col).to_pylist()
                found = with_pieces.encode(texts)
                counts = np.fromiter((len(x) // 4 for x in found), "<i8", len(found))
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype("<i4")
                null = np.fromiter((t is None for t in texts), bool, len(texts))
                lists = pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(null, False)) if null.any() else pa.array(offsets), pa.array(np.frombuffer(b"".join(found), "<i4")))
                columns = [*rows.columns, lists, pa.array(counts)]
                if decoded:
                    columns.append(pa.array([None if t is None else with_pieces.decode(memoryview(x).cast("i").tolist()) for t, x in zip(texts, found)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*rows.schema.names, *made])

    kinds = [T.ArrayType(T.IntegerType()), T.LongType(), T.StringType()]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, k) for c, k in zip(made, kinds)]])
    return docs.mapInArrow(encode, schema)


def decode_pieces(encoded: DataFrame, model: str, ids_col: str = "ids", out: str = "decoded", kind: str = "bpe") -> DataFrame:
    """Adds the text of the ids; null for null ids. A column named `out` is replaced."""
    ship(encoded.sparkSession)
    content = encoded.sparkSession.sparkContext.broadcast(file_bytes(model))
    encoded = without(encoded, [out])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_pieces = Codec(content.value, kind)  # goes with the task
        for batch in batches:
            column = batch.column(ids_col)
            values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            texts = [with_pieces.decode(values[offsets[i] : offsets[i + 1]].tolist()) if column[i].is_valid else None for i in range(len(column))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return encoded.mapInArrow(decode, T.StructType([*encoded.schema.fields, T.StructField(out, T.StringType())]))
