"""Queries of grouping under a budget, caption lines, speech-free words, and calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelattice.operators import budget as B
from cuelattice.operators import cues as C
from cuelattice.plans import cue_queries as Q
from cuelattice.plans import fixtures as X
from cuelattice.plans.book import query
from cuelattice.plans.match_queries import a33_calibration_examples


def _grouped_sql(gap_ms: int, most_ms: int) -> str:
    """CTEs over sg (job_id, start_ms, end_ms), and the groups: one segment of every part at a time."""
    fits = f"gp.end_ms - gf.opened <= {most_ms}"
    return f"""gp AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY job_id, part ORDER BY start_ms, end_ms) AS rn FROM (SELECT job_id, start_ms, end_ms, sum(fresh) OVER (PARTITION BY job_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING)::BIGINT AS part
 FROM (SELECT *, coalesce((start_ms - lag(end_ms) OVER (PARTITION BY job_id ORDER BY start_ms, end_ms) > {gap_ms})::INT, 0) AS fresh FROM sg))),
gf AS (SELECT job_id, part, rn, 0 AS place, start_ms AS opened, end_ms AS until FROM gp WHERE rn = 1 UNION ALL SELECT gp.job_id, gp.part, gp.rn, CASE WHEN {fits} THEN place ELSE place + 1 END, CASE WHEN {fits} THEN opened ELSE gp.start_ms END, gp.end_ms FROM gf JOIN gp ON gp.job_id = gf.job_id AND gp.part = gf.part AND gp.rn = gf.rn + 1)
SELECT job_id, part, place::INT AS place, min(opened) AS start_ms, max(until) AS end_ms, count(*)::INT AS n FROM gf GROUP BY 1, 2, 3"""


@query(f"{Q._SENT.replace('WITH', 'WITH RECURSIVE', 1)}, sg AS (SELECT job_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM s GROUP BY job_id, sentence), {_grouped_sql(2000, 28000)}")
def w02_speech_groups(spark: SparkSession, d: str) -> DataFrame:
    """Sentences as speech segments, in groups without a gap over two seconds and of at most 28 seconds."""
    s = Q._sentences(spark, d).groupBy("job_id", "sentence").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    return B.grouped(s, gap_ms=2000, most_ms=28000)


@query(f"WITH RECURSIVE {X.TOK}, sg AS (SELECT job_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM tok GROUP BY job_id, chunk_id), {_grouped_sql(2500, 30000)}")
def w41_joined_windows(spark: SparkSession, d: str) -> DataFrame:
    """Voted chunks joined to windows of at most 30 seconds."""
    c = X.tok(spark, d).groupBy("job_id", "chunk_id").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    return B.grouped(c, gap_ms=2500, most_ms=30000)


@query(f"""WITH {X.TOK}, v AS (SELECT job_id, idx, word, norm, (job_id * 11 + idx * 17) % 100 AS p FROM tok) SELECT job_id, count(*) AS words, count(CASE WHEN greatest(p, coalesce(pp, 0), coalesce(np, 0)) < 12 THEN 1 END) AS without_speech
 FROM (SELECT *, lag(p) OVER (PARTITION BY job_id ORDER BY idx) AS pp, lead(p) OVER (PARTITION BY job_id ORDER BY idx) AS np FROM v) GROUP BY 1""")
def w19_speechless_words(spark: SparkSession, d: str) -> DataFrame:
    """Words beneath which no frame has a speech probability of 12 per cent; a derived frame per word, its neighbours' count too."""
    w = W.partitionBy("job_id").orderBy("idx")
    v = X.tok(spark, d).select("job_id", "idx", ((F.col("job_id") * 11 + F.col("idx") * 17) % 100).alias("p"))
    v = v.withColumn("top", F.max("p").over(w.rowsBetween(-1, 1)))
    return v.groupBy("job_id").agg(F.count("*").alias("words"), F.count(F.when(F.col("top") < 12, 1)).alias("without_speech"))


@query(f"{Q._SENT}, b AS (SELECT *, sum(coalesce(start_ms - pe > 600, false)::INT) OVER (PARTITION BY job_id ORDER BY idx) AS piece FROM (SELECT *, lag(end_ms) OVER (PARTITION BY job_id ORDER BY idx) AS pe FROM s)), k AS (SELECT job_id, sentence, piece, list_reduce(list_prepend('', list(word ORDER BY idx)), lambda a, x: CASE WHEN a = '' THEN x WHEN length(regexp_extract(a, '[^\n]*$')) + 1 + length(x) <= 42 THEN a || ' ' || x ELSE a || chr(10) || x END) AS text FROM b GROUP BY 1, 2, 3) SELECT job_id, sentence, piece, len(string_split(text, chr(10))) AS lines, text FROM k")
def w16_caption_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of at most 42 characters that end at sentences' ends and pauses over 0.6 s (a sentence has 60 words at most, so folds stay short)."""
    w = W.partitionBy("job_id").orderBy("idx")
    s = Q._sentences(spark, d).withColumn("piece", C.running(F.coalesce(F.col("start_ms") - F.lag("end_ms").over(w) > 600, F.lit(False)), w))
    s = s.groupBy("job_id", "sentence", "piece").agg(F.sort_array(F.collect_list(F.struct("idx", "word"))).alias("ws"))
    text = C.wrapped(F.array_join(F.transform("ws", lambda x: x["word"]), " "), 42)
    return s.select("job_id", "sentence", "piece", text.alias("text")).select("job_id", "sentence", "piece", F.size(F.split("text", "\n")).alias("lines"), "text")


@query()
def a32_calibrated_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights of the triage risk fitted to corrections, pulled towards the present ones."""
    names = ["text_error", "disputed_any", "unheard_any"]
    return B.calibrated(a33_calibration_examples(spark, d), names, "label", [C.WEIGHTS[n] for n in names], C.BIAS)
