"""The queries opN_<name> of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cuelattice.llm import ann, audit, bpe, decontam, huffman, langid, merkle, mixing, neardup, ogg, passages, spans, toolcalls, urlrep
from cuelattice.llm.shared import table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op3_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), n_words=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op4_lsh_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op5_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.deduplicated(table(spark, sf_dir, "documents"))


def op5_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not bound to the SQL of op5_span_dedup, which knows only runs of two sentences."""
    return passages.deduplicated(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrep.judged(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predicted(table(spark, sf_dir, "documents"))


def op8_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.linked(*toolcalls.calls_of(table(spark, sf_dir, "conversations")))


def op9_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_features(table(spark, sf_dir, "documents"))


def op10_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.stored_ids(table(spark, sf_dir, "documents"), WORD_BPE)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_byte_bpe, op2_source_mixing, op3_minhash_neardup, op4_lsh_neighbours, op5_span_dedup, op5_passage_dedup, op6_url_filter, op7_language_id, op8_tool_calls, op9_ogg_media, op10_huffman_ids, op11_filter_audit, op12_merkle_manifest, op13_decontamination)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op2_source_mixing": mixing.SQL, "op5_span_dedup": spans.SQL, "op6_url_filter": urlrep.SQL, "op8_tool_calls": toolcalls.SQL, "op11_filter_audit": audit.SQL, "op12_merkle_manifest": merkle.SQL, "op13_decontamination": decontam.SQL}
