"""One query per operator, with production parameters, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import bpe, jaccard_join, line_dedup, media, packing, pii, quality_pu, quality_rules, toxicity, warc
from quern.llm.common import table


def vocabulary(name: str) -> str:
    """Path of a public vocabulary; on a cluster the same package is installed on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("byte_bpe_50k.tiktoken"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("byte_bpe_50k.json"), public_tokenizers.PATTERN, added=True)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_pu.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality_rules.fertility(docs, vocabulary("piece_bpe_32k.model"), ranks_path=vocabulary("byte_bpe_multi_50k.tiktoken")).drop("text", "lang")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_bpe": op2_bpe,
    "op3_packing": op3_packing,
    "op4_media": op4_media,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_quality_pu": op6_quality_pu,
    "op7_line_dedup": op7_line_dedup,
    "op8_warc": op8_warc,
    "op9_toxicity": op9_toxicity,
    "op10_quality_rules": op10_quality_rules,
}

ORACLE_SQL: dict[str, str] = {
    "op5_jaccard_join": jaccard_join.SQL.format(docs="documents"),
    "op7_line_dedup": line_dedup.SQL.format(docs="documents"),
    "op8_warc": warc.SQL,
}
