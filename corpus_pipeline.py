"""A training corpus from `documents`: language ID, near-dedup, span dedup, source mixing, tokens.

Each stage gets what the one before wrote, and returns the columns of documents but for the last, which returns the
tokens' digests. A stage removes only what it is there for: texts without a language, all but one of each group of
near-duplicates, repeated passages (and documents of which nothing else is left); mixing removes nothing, it repeats
small sources.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelattice.llm import bpe, langid, mixing, neardup, passages
from cuelattice.llm.shared import table, written

#: A document goes if its language's probability is below; one word is enough for more.
LEAST_SCORE = 0.3
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without any labelled text to learn from, only texts without a letter go."""
    net = langid.fit(docs)
    if net is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole_row"), "text")
    judged = langid.with_language(rows, net).where((F.col("language.lang_pred") != langid.UNKNOWN) & (F.col("language.score") >= LEAST_SCORE))
    return judged.select("whole_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, that with the smallest doc_id; rows that repeat both doc_id and text count once, those that repeat a doc_id
    with another text are documents of their own. Rows without doc_id stay."""
    found = neardup.near_duplicates(docs, n_words=5, percent=80).where("kept AND doc_id IS NOT NULL")
    first = found.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("first")).select("first.*")
    kept = first.unionByName(found.where("root IS NULL").select("doc_id", "text_hash").distinct())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole_row"), F.col("doc_id").alias("own_id"), neardup.text_hash().alias("own_hash"))
    kept = kept.select(F.col("doc_id").alias("own_id"), F.col("text_hash").alias("own_hash"))
    named = rows.where("own_id IS NOT NULL").join(kept.hint("merge"), ["own_id", "own_hash"], "left_semi").dropDuplicates(["own_id", "own_hash"])
    return named.select("whole_row.*").unionByName(docs.where("doc_id IS NULL"))


def span_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = passages.without_repeats(docs)
    touched = F.col("removed.n_removed") > 0
    out = out.where(~touched | (F.length(F.trim("doc.text")) > 0))
    n_chars = F.when(touched, F.length("doc.text").cast("long")).otherwise(F.col("doc.n_chars")).alias("n_chars")
    return out.select(*[n_chars if c == "n_chars" else F.col("doc")[c].alias(c) for c in docs.columns])


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, BYTE_BPE, public_tokenizers.PATTERN)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("span_dedup", span_dedup), ("source_mixing", source_mixing), ("tokens", tokens)]
#: Language ID and near-dedup have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
