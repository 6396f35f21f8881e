"""Language identification by compression: the language whose dictionary makes a text smallest."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keidai.llm.common import held_out, ship, small, without, written

#: Documents of each language that are sampled, with their whole texts, and bytes of these texts: what bounds the dictionaries.
SAMPLE_DOCS = 160
SAMPLE_BYTES = 1 << 20
#: Characters compressed at once: short enough that the dictionary, not the text itself, explains a piece.
PIECE = 2000
LEVEL = 3
#: A text is rejected if its second-best language makes it less than this share larger than the best.
MARGIN = 0.005
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
OTHERS = re.compile(r"[\W\d_]+")
#: Put after every piece: zstd looks for no match in the last bytes of its input.
PAD = b"\n" * 16


def plain(text: str) -> str:
    """Words alone, in lower case: how a text is punctuated or capitalised says little of its language."""
    return OTHERS.sub(" ", text.lower())


def dictionaries(docs: DataFrame, text_col: str, lang_col: str) -> dict[str, bytes]:
    """Raw-content dictionaries by language, of a bounded sample: of the different texts that have letters those of least hash, SAMPLE_DOCS at
    most and no more than fill SAMPLE_BYTES. Whole texts are taken, one at least; texts over an eighth of these bytes come after all others.

    The sample depends on texts and languages alone, and copies of a text are one. Hashes are ranked first, so that texts are moved for the sample only.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("h"), F.octet_length(text_col).cast("long").alias("size"), F.col(text_col).alias("text")
    )
    in_order = Window.partitionBy("lang").orderBy("long", "h")
    chosen = (
        labelled.groupBy("lang", "h")
        .agg(F.max("size").alias("size"))
        .withColumn("long", F.col("size") > SAMPLE_BYTES // 8)
        .withColumn("nth", F.row_number().over(in_order))
        .where(F.col("nth") <= SAMPLE_DOCS)
        .withColumn("total", F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
        .where((F.col("total") <= SAMPLE_BYTES) | (F.col("nth") == 1))
        .select("lang", "h", "nth")
    )
    texts = labelled.join(small(written(chosen, "language-sample")), ["lang", "h"]).groupBy("lang", "nth").agg(F.min("text").alias("text"))
    parts: dict[str, list[str]] = {}
    for r in texts.orderBy("lang", "nth").collect():  # languages x SAMPLE_BYTES, or one longer text
        parts.setdefault(r["lang"], []).append(r["text"])
    return {lang: "\n".join(map(plain, x)).encode("utf-8", "replace") for lang, x in sorted(parts.items())}


class Classifier:
    """Compressors for each language; made once in a task."""

    def __init__(self, content: dict[str, bytes]):
        import zstandard

        self.langs = sorted(content)
        self.by = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def __call__(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not LETTER.search(text):
            return UNKNOWN, 0.0
        text = plain(text)
        pieces = [text[i : i + PIECE].encode("utf-8", "replace") + PAD for i in range(0, len(text), PIECE)]
        sizes = [sum(len(c.compress(p)) for p in pieces) for c in self.by]
        order = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))
        best = sizes[order[0]]
        second = sizes[order[1]] if len(order) > 1 else 2 * best
        return self.langs[order[0]], max(0.0, min(1.0, (second - best) / second))


def identify(docs: DataFrame, learn_from: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", margin: float = MARGIN) -> DataFrame:
    """Adds lang_pred, score (0 to 1: by how much the runner-up is larger) and rejected to `docs`.

    Learns from `learn_from` (text, lang), a bounded sample of each language; predicts from the whole text alone.
    Null or letterless texts, and all texts if nothing could be learned, are `und` with score 0. `rejected` is true for
    `und` and for scores under `margin`. Equal sizes go to the language first in alphabet. Rows are kept as they are,
    repeated ones and null ids too; columns named as the new ones, in whatever case, are replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    content = spark.sparkContext.broadcast(dictionaries(learn_from, text_col, lang_col))
    made = ["lang_pred", "score", "rejected"]
    docs = without(docs, made)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(content.value)
        for batch in batches:
            found = [classify(t.as_py()) for t in batch.column(text_col)]
            columns = [
                *batch.columns,
                pa.array([x[0] for x in found], pa.string()),
                pa.array([x[1] for x in found], pa.float64()),
                pa.array([x[0] == UNKNOWN or x[1] < margin for x in found], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *made])

    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    schema = T.StructType([*docs.schema.fields, *new])
    return docs.mapInArrow(predict, schema)


def predict_fold(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Predictions for every document, learned outside the fold crc32(id) mod 4 = 2."""
    out = held_out(id_col, 4, 2)
    labelled = docs.where(~out).select(id_col, text_col, lang_col)
    found = identify(docs.select(id_col, text_col), labelled, id_col, text_col, lang_col)
    return found.select(id_col, out.alias("held_out"), "lang_pred", "score", "rejected")
