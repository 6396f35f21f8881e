"""Registered queries over the corpus operators, and the SQL of those that SQL expresses."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keidai.llm import collocations, decontaminate, html_extract, jaccard_join, lang_id, line_dedup, lm_score, nearest, quality, secrets, sentencepieces, token_files, vector_codes
from keidai.llm.common import table


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is; KEIDAI_TOKENIZERS names another folder."""
    folder = os.environ.get("KEIDAI_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepieces.encode_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("piece_bpe_32k.model"), decoded="decoded")
    return coded.select("doc_id", "n_tokens", "ids", "decoded", F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.predict_fold(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_fold(table(spark, sf_dir, "documents"))


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (op1_sentencepiece, op2_line_dedup, op3_html_extract, op4_ngram_jaccard_join, op5_language_id, op6_quality_rules, op7_secret_scan, op8_token_files, op9_decontaminate, op10_lm_score, op11_nearest_neighbours, op12_collocations, op13_vector_codes)
}

ORACLE_SQL = {
    "op2_line_dedup": line_dedup.SQL,
    "op6_quality_rules": quality.SQL,
    "op7_secret_scan": secrets.SQL,
    "op9_decontaminate": decontaminate.SQL,
    "op12_collocations": collocations.SQL,
    "op13_vector_codes": vector_codes.SQL,
}
