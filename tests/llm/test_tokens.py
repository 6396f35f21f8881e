import zlib

import numpy as np
import pyarrow as pa
import pytest

from keidai.llm import sentencepieces, token_files
from keidai.llm.registry import vocabulary

TEXTS = [None, "", "Hello, world! it's", "a b  c\n\nd", "Σας ΣΑΣ é é ≠ ²x", "1234 x1.", "<|endoftext|> x", "\x1c!\x1c!", "😀" * 300, "word " * 20_000]


def expected(rows):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = tk.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def run(df):
    rows = [tuple(r) for r in token_files.token_files(df, vocabulary("word_bpe_49k.json")).collect()]
    return sorted(rows, key=lambda r: r[1])


def test_files_read_back(make):
    rows = list(enumerate(TEXTS))[::-1]
    assert run(make(rows)) == expected(rows)


def test_null_ids_come_first_and_repeated_rows_each_count(make):
    rows = [(3, "b"), (None, "x y"), (3, "a"), (3, "a"), (1, "c")]
    assert run(make(rows)) == expected(rows)
    assert run(make(rows).limit(0)) == []


def test_many_parts(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert run(documents.repartition(7)) == expected(rows)


def test_pieces_equal_the_library(make):
    import random

    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    rng = random.Random(4)
    alphabet = "abcdefghi the and ing  \n\tñéß😀中の.,()12<>'Ж\x00"
    texts = [t for t in TEXTS if t is not None] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(2000)] + ["   lead", "trail   ", "a▁b"]
    encoded = sentencepieces.encode_pieces(make(texts), vocabulary("piece_bpe_32k.model"))
    rows = sentencepieces.decode_pieces(encoded, vocabulary("piece_bpe_32k.model")).collect()
    for r in rows:
        t = texts[r["doc_id"]]
        assert r["ids"] == library.encode(t) and r["n_tokens"] == len(r["ids"])
        assert r["decoded"] == t.replace("▁", " ")
    at_once = sentencepieces.encode_pieces(make(texts), vocabulary("piece_bpe_32k.model"), decoded="decoded").collect()
    assert [(r["doc_id"], r["ids"], r["decoded"]) for r in at_once] == [(r["doc_id"], r["ids"], r["decoded"]) for r in rows]


def test_null_texts_and_columns_of_pieces(make):
    model = vocabulary("piece_bpe_32k.model")
    out = sentencepieces.decode_pieces(sentencepieces.encode_pieces(make([None, "", "x"]), model), model)
    found = {r["doc_id"]: (r["ids"], r["n_tokens"], r["decoded"], r["word"]) for r in out.collect()}
    assert found[0] == (None, 0, None, "x") and found[1] == ([], 0, "", "x") and found[2][2] == "x"
    assert sentencepieces.encode_pieces(out, model).columns.count("ids") == 1
    assert sentencepieces.encode_pieces(make(["x"]).limit(0), model).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_unigram_lattice_is_the_best_segmentation(seed):
    import random

    rng = random.Random(seed)
    pieces = {c: i for i, c in enumerate("abc")}
    while len(pieces) < 14:
        pieces.setdefault("".join(rng.choice("abc") for _ in range(rng.randint(2, 4))), len(pieces))
    scores = {p: -rng.random() * len(p) ** 0.5 for p in pieces}
    back = {i: p for p, i in pieces.items()}

    def best(w):
        if not w:
            return 0.0
        return max(scores[w[:k]] + best(w[k:]) for k in range(1, min(4, len(w)) + 1) if w[:k] in pieces)

    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(60)})
    for w, ids in zip(words, sentencepieces.Lattice(pieces, scores, "unigram").encode_sorted(words)):
        assert "".join(back[i] for i in ids) == w
        assert sum(scores[back[i]] for i in ids) == pytest.approx(best(w))


def encoded(encoder, texts):
    ids, at = encoder(pa.array(texts, pa.string()))
    return [ids[a:b].tobytes() for a, b in zip(at, at[1:])]


def test_words_equal_the_library_for_odd_capitals_and_marks():
    import random

    from tokenizers import Tokenizer

    rng = random.Random(11)
    alphabet = "abcsti \n.,;:!?'-1\u0130\u0131\u017f\u212a\u00df\u00c4\u00e9\u03a3\u03c2\ufb01\u01c5\u0307\u0301\u0308\u00a0\u200d\u2028\u4e2d\U0001f600\u00d7\u00f7\u00aa\u00b2\x1c\x00"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(60_000)]
    texts += ["\u0130. \u0130, a\u0130!", "don't we'll I'M 's'", "<|endoftext|>. a<|startoftext|>b", "<|ENDOFTEXT|>,"]
    content = token_files.file_bytes(vocabulary("word_bpe_49k.json"))
    encoder = token_files.WordEncoder(content)
    assert encoder.by_word
    library = Tokenizer.from_buffer(content)
    want = [np.array(e.ids, encoder.kind).tobytes() for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    got = [x for i in range(0, len(texts), 500) for x in encoded(encoder, texts[i : i + 500])]
    assert [t for t, a, b in zip(texts, got, want) if a != b] == []


def test_a_vocabulary_whose_words_cant_be_told_apart_is_given_whole_texts():
    from tokenizers import Tokenizer

    content = token_files.file_bytes(vocabulary("byte_bpe_50k.json"))
    encoder = token_files.WordEncoder(content)
    assert not encoder.by_word
    library = Tokenizer.from_buffer(content)
    for t, got in zip(TEXTS, encoded(encoder, TEXTS)):
        assert np.frombuffer(got, encoder.kind).tolist() == library.encode(t or "", add_special_tokens=False).ids


def test_memos_start_anew_within_their_bytes(monkeypatch):
    content = token_files.file_bytes(vocabulary("piece_bpe_32k.model"))
    texts = [f"word{i} {'abcdefghij'[i % 10]}{'xyz'[i % 3]}, Stop." for i in range(3000)]
    whole = sentencepieces.Codec(content).encode(texts)
    monkeypatch.setattr(sentencepieces, "MEMO_BYTES", 20_000)
    small = sentencepieces.Codec(content)
    assert [x for i in range(0, 3000, 7) for x in small.encode(texts[i : i + 7])] == whole
    assert len(small.known) < 1000


def test_blocks_of_any_size_give_the_same_files(documents, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in documents.limit(60).collect()]
    batch = pa.record_batch([pa.array([r[1] for r in rows], pa.string())], names=["text"])
    for size in (1, 1000, 10_000, 1 << 30):
        found = list(token_files.gathered(iter([batch, batch.slice(0, 0), batch.slice(10, 5)]), "text", size))
        assert [t for b in found for t in b.column("text").to_pylist()] == [r[1] for r in rows] + [r[1] for r in rows[10:15]]
