from keidai.llm.lang_id import Classifier, identify, predict_fold


def test_held_out_accuracy(spark, sf, documents):
    rows = predict_fold(documents).join(documents.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.9
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_no_letters_nulls_and_nothing_learned(make):
    docs = make([None, "", "123 !!", "the house"])
    labelled = docs.where("doc_id = 3")
    found = {r["doc_id"]: (r["lang_pred"], r["rejected"]) for r in identify(docs, labelled).collect()}
    assert found[0] == found[1] == found[2] == ("und", True) and found[3][0] == "en"
    assert {r["lang_pred"] for r in identify(docs, docs.limit(0)).collect()} == {"und"}
    assert identify(docs.limit(0), labelled).count() == 0


def test_columns_are_kept_and_replaced(make):
    docs = make(["the house"])
    out = identify(docs, docs)
    assert out.columns == [c for c in docs.columns if c != "score"] + ["lang_pred", "score", "rejected"]


def test_equal_sizes_go_by_alphabet_and_long_texts_are_whole():
    same = Classifier({"b": b"xyz", "a": b"xyz"})
    assert same("hello world") == ("a", 0.0)
    by = Classifier({"de": b"der die das und nicht aber schon wieder " * 20, "en": b"the and not but again already house " * 20})
    assert by("the house " + "und nicht aber schon wieder die das " * 2000)[0] == "de"


def test_against_plain_compression(spark, documents):
    """Every prediction and score equals what one-shot compression with the sampled documents' whole texts gives."""
    import zstandard
    from pyspark.sql import functions as F

    from keidai.llm import lang_id
    from keidai.llm.common import held_out

    learn = documents.where(~held_out("doc_id", 4, 2) & F.col("lang").isNotNull())
    by = {}
    for r in learn.select("lang", "text", F.xxhash64("text").alias("h")).collect():
        if r["text"] and lang_id.LETTER.search(r["text"]):
            by.setdefault(r["lang"], []).append((len(r["text"].encode()) > lang_id.SAMPLE_BYTES // 8, r["h"], r["text"]))
    content = {}
    for lang, rows in by.items():
        taken, size = [], 0
        for _, _, t in sorted(set(rows))[: lang_id.SAMPLE_DOCS]:
            size += len(t.encode())
            if size <= lang_id.SAMPLE_BYTES or not taken:
                taken.append(t)
        content[lang] = "\n".join(lang_id.plain(t) for t in taken).encode()
    assert content == lang_id.dictionaries(learn, "text", "lang")

    def size(lang, text):
        d = zstandard.ZstdCompressionDict(content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=lang_id.LEVEL)
        c = zstandard.ZstdCompressor(level=lang_id.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        text = lang_id.plain(text)
        return sum(len(c.compress(text[i : i + lang_id.PIECE].encode() + lang_id.PAD)) for i in range(0, len(text), lang_id.PIECE))

    texts = {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
    for r in predict_fold(documents).collect():
        text = texts[r["doc_id"]]
        if not text or not lang_id.LETTER.search(text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        sizes = sorted((size(lang, text), lang) for lang in content)
        assert (r["lang_pred"], r["score"]) == (sizes[0][1], max(0.0, (sizes[1][0] - sizes[0][0]) / sizes[1][0]))


def test_repeated_rows_null_ids_and_long_texts_in_the_sample(make, monkeypatch):
    from keidai.llm import lang_id

    monkeypatch.setattr(lang_id, "SAMPLE_BYTES", 1000)
    docs = make([(None, "the house"), (None, "the house"), (4, None), (5, "the " * 100_000), (6, "word " * 20)])
    content = lang_id.dictionaries(docs, "text", "lang")["en"]
    assert content.count(b"the house") == 1 and b"word" in content and len(content) < 1000  # copies are one text; the long one comes last and doesn't fit
    assert lang_id.dictionaries(docs.withColumn("doc_id", docs["doc_id"] + 1_000_000), "text", "lang")["en"] == content  # ids decide nothing
    assert len(lang_id.dictionaries(docs.where("doc_id = 5"), "text", "lang")["en"]) == 400_000  # alone it is taken whole
    found = identify(docs, docs).collect()
    assert len(found) == 5 and len({(r["lang_pred"], r["score"]) for r in found if r["text"] == "the house"}) == 1
