"""Queries of the library's own operators, by name, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cuelattice.plans import book, caption_queries, cue_queries, file_queries, fold_queries, hallucination_queries, interval_queries, layout_queries, match_queries, more_queries, report_queries, stream_queries, tag_queries, text_queries, timing_queries, triage_queries, vote_queries  # noqa: F401  (they register their queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vote_queries.a12_engine_leaderboard(spark, sf_dir)


def queries() -> dict[str, book.Query]:
    return dict(book.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(book.SQL)
