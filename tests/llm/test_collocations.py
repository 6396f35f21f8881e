"""Phrases against plain counts, and the hash that counts them."""

import collections
import re

import numpy as np
import pytest

from keidai.llm import collocations
from keidai.llm.slots import Slots

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, longest=5, first=2000, share=100):
    """rows (lang, text); every phrase of every piece is counted, and every longer candidate looked at."""
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = tuple(w for w in re.split("[ \t]+", piece) if w)
            n[lang] += len(words)
            f.update((lang, words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    found = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    inside = {(lang, w[i:j]) for (lang, w), a in found.items() for i in range(len(w)) for j in range(i + 2, len(w) + 1) if j - i < len(w) and 100 * a >= share * f[lang, w[i:j]]}
    out, ranks = [], collections.Counter()
    rows = []
    for (lang, w), a in found.items():
        if (lang, w) not in inside:
            score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            rows.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    for lang, score, a, phrase, left, right in sorted(rows):
        ranks[lang] += 1
        if ranks[lang] <= first:
            out.append((lang, ranks[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return out


def mined(spark, rows, **more):
    df = spark.createDataFrame([(lang, text, 7, "x", 0.5) for lang, text in rows], "lang string, text string, n long, word string, score double")
    return sorted(tuple(r) for r in collocations.collocations(df, **more).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


TEXTS = [
    ("en", "The cat sat. The cat sat on the mat, the cat sat; A\tb  c d e f g"),
    ("en", "a b c d e f g! a b c d e\x0ba b c"),
    ("de", "der Hund, der HUND der Hund Äpfel äpfel"),
    (None, "x y x y x y"),
    ("und", "x y"),
    ("en", None),
    ("en", ""),
    ("en", " \t ..,\n"),
    ("en", "aa aa aa aa aa aa aa"),
]


@pytest.mark.parametrize("least", [1, 2, 3])
def test_phrases_equal_plain_counts(spark, least):
    assert mined(spark, TEXTS, least=least) == sorted(plain(TEXTS, least))


def test_documents_equal_plain_counts(spark, documents):
    rows = [(r["lang"], r["text"]) for r in documents.select("lang", "text").collect()]
    assert mined(spark, rows, least=12, first=50, share=95) == sorted(plain(rows, 12, first=50, share=95))


def test_groups_of_candidates_and_small_blocks_give_the_same(spark, documents, monkeypatch):
    rows = [(r["lang"], r["text"]) for r in documents.select("lang", "text").collect()]
    monkeypatch.setattr(collocations, "SLOTS", 400)
    monkeypatch.setattr(collocations, "BLOCK", 4096)
    monkeypatch.setattr(collocations, "GATHER", 300)
    assert mined(spark, rows, least=20) == sorted(plain(rows, 20))


def test_empty_tables_and_texts_without_phrases(spark):
    assert mined(spark, []) == mined(spark, [("en", None), (None, "")]) == mined(spark, [("en", "one two three")]) == []


def test_long_text_and_many_copies(spark):
    rows = [("en", "alpha beta gamma " * 60_000)] + [("en", "delta epsilon zeta")] * 150
    assert mined(spark, rows) == sorted(plain(rows, 100))


def test_products_of_over_64_bits_are_exact(spark):
    n, a, left, right = 3 * 10**13, 7 * 10**11 + 3, 9 * 10**11 + 1, 8 * 10**11 + 7
    df = spark.createDataFrame([("en", "p q", a, [left], [right], n)], "lang string, phrase string, f long, left array<long>, right array<long>, n long")
    assert collocations.ranked(df, 5).first()["score"] == 1000 * a * n // (left * right)


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 5000])
def test_slots_are_minimal_perfect_and_verified(n):
    keys = np.random.default_rng(n).integers(-(2**63), 2**63 - 1, n).view(np.uint64)
    slots = Slots(keys)
    assert sorted(slots(keys).tolist()) == list(range(n)) == sorted(np.argsort(slots.keys[slots(keys)]) * 0 + slots(keys))
    others = np.setdiff1d(np.arange(20_000, dtype=np.uint64), keys)
    assert (slots(others) == -1).all()


def test_slots_tell_repeated_keys():
    with pytest.raises(ValueError, match="distinct"):
        Slots(np.array([5, 5, 6], np.uint64))
