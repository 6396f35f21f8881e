"""From raw documents to token ids in five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keidai.llm import decontaminate, jaccard_join, lang_id, line_dedup, sentencepieces
from keidai.llm.common import delete, fresh_path, held_out, scratch, table
from keidai.llm.registry import vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; those rejected (no letters, or a narrow margin) go. Learns outside the fold crc32(id) mod 4 = 2."""
    found = lang_id.identify(docs, docs.where(~held_out("doc_id", 4, 2)))
    return found.where(~F.col("rejected")).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier three-line window; documents of which nothing is left go, null texts stay."""
    found = line_dedup.line_dedup(docs)
    left = found.where(F.col("text").isNull() | (F.col("n_removed") == 0) | (F.trim(F.col("text")) != ""))
    return left.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar texts the document of least id."""
    return jaccard_join.keep_one(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by benchmark items."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).where(~F.col("contaminated")).select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text that decoding gives."""
    return sentencepieces.encode_pieces(docs, vocabulary("piece_bpe_32k.model"), decoded="decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("benchmarks", benchmarks),
    ("pieces", pieces),
]

#: Compression sizes are no SQL; tests hold the rows against a plain Python version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over `documents`. What a stage wrote goes when the next one is done, or when one fails; the last one's table stays."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        try:
            with scratch(spark):
                stage(spark, docs, sf_dir).write.parquet(path)
        except BaseException:
            delete(spark, path)
            raise
        finally:
            if before:
                delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
