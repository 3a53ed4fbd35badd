"""The subpackage's registered queries and their SQL, by name. Each query is thin: its rows
come from its operator, at production parameters, over the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import align, audit, bpe, chat, decontam, lines, lm, packing, pii, quality, simhash, tiff, toxicity
from .common import read


def _tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(read(spark, sf_dir, "documents", "doc_id", "text"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return decontam.digest(decontam.decontaminate(docs, read(spark, sf_dir, "benchmark", "item_id", "text"), texts=False))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return quality.scored(docs, quality.fit(docs, read(spark, sf_dir, "labels", "doc_id", "quality")))


def op5_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.digest(read(spark, sf_dir, "documents", "doc_id", "text"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(read(spark, sf_dir, "documents", "doc_id", "text"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents", "doc_id", "text"), _tokenizer())


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preference_rows(chat.swapped_pairs(read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return toxicity.scored(docs, toxicity.fit(docs, read(spark, sf_dir, "labels", "doc_id", "toxic")))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return pii.personal_data(docs, pii.fit(docs))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return audit.audit(docs, read(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(bpe.encoded(read(spark, sf_dir, "documents", "doc_id", "text"), _tokenizer("word_bpe_49k.json")))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.aligned(read(spark, sf_dir, "documents", "doc_id", "text"), _tokenizer(), _tokenizer("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_decontamination": op2_decontamination,
    "op3_simhash": op3_simhash,
    "op4_quality": op4_quality,
    "op5_tiff": op5_tiff,
    "op6_line_dedup": op6_line_dedup,
    "op7_packing": op7_packing,
    "op8_chat": op8_chat,
    "op9_toxicity": op9_toxicity,
    "op10_personal_data": op10_personal_data,
    "op11_filter_audit": op11_filter_audit,
    "op12_bpe": op12_bpe,
    "op13_alignment": op13_alignment,
}

ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": decontam.ORACLE,
    "op6_line_dedup": lines.ORACLE,
    "op8_chat": chat.ORACLE,
    "op11_filter_audit": audit.ORACLE,
}
