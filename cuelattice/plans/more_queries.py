"""Queries of set operations, lookups, smoothing and job recovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelattice.operators import intervals as I
from cuelattice.plans import fixtures as X
from cuelattice.plans import lists as L
from cuelattice.plans.book import query
from cuelattice.plans.interval_queries import _WINDOWS


@query(f"WITH {X.HYP} SELECT job_id, engine, count(*) AS n FROM (SELECT job_id, engine FROM hyp UNION ALL SELECT job_id, 'ref' FROM tok) GROUP BY 1, 2")
def u01_union_with_provenance(spark: SparkSession, d: str) -> DataFrame:
    ref = X.tok(spark, d).select("job_id", F.lit("ref").alias("engine"))
    return X.hyp(spark, d).select("job_id", "engine").unionByName(ref, allowMissingColumns=True).groupBy("job_id", "engine").agg(F.count("*").alias("n"))


@query(f"WITH {X.HYP}, m AS (SELECT job_id, norm FROM tok EXCEPT ALL SELECT job_id, norm FROM hyp WHERE engine = 'a'), e AS (SELECT job_id, norm FROM hyp WHERE engine = 'a' EXCEPT ALL SELECT job_id, norm FROM tok) SELECT job_id, norm, 'missing' AS kind, count(*) AS n FROM m GROUP BY 1, 2 UNION ALL SELECT job_id, norm, 'extra', count(*) FROM e GROUP BY 1, 2")
def u02_missing_and_extra_words(spark: SparkSession, d: str) -> DataFrame:
    """Differences of the two multisets of words, by signed counts: one shuffle, and rows that cancel never leave their task's sums."""
    both = X.tok(spark, d).select("job_id", "norm", F.lit(1).alias("s")).unionByName(X.hyp(spark, d).where("engine = 'a'").select("job_id", "norm", F.lit(-1).alias("s")))
    g = both.groupBy("job_id", "norm").agg(F.sum("s").alias("s")).where("s <> 0")
    return g.select("job_id", "norm", F.when(F.col("s") > 0, "missing").otherwise("extra").alias("kind"), F.abs("s").alias("n"))


@query(f"WITH {X.TOK}, {_WINDOWS} SELECT t.job_id, idx, min(window_id) AS window_id, count(*) AS windows FROM tok t JOIN wi ON t.job_id = wi.job_id AND t.start_ms >= from_ms - 20000 AND t.start_ms < to_ms + 20000 WHERE length(norm) > 9 GROUP BY 1, 2")
def u04_distinct_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings (here: long words) in windows that overlap by their context: each word once, as its first window has it."""
    t = X.tok(spark, d)
    windows = I.fixed_chunks(t.groupBy("job_id").agg(F.max("end_ms").alias("duration_ms")), 90000).select("job_id", F.col("chunk_id").alias("window_id"), (F.col("start_ms") - 20000).alias("start_ms"), (F.col("start_ms") + 110000).alias("end_ms"))
    found = t.where(F.length("norm") > 9).select("job_id", "idx", "start_ms", (F.col("start_ms") + 1).alias("end_ms"))
    return I.interval_join(found, windows, 30000).groupBy("l.job_id", "l.idx").agg(F.min("r.window_id").cast("long").alias("window_id"), F.count("*").alias("windows"))


@query("WITH e AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS warnings FROM e GROUP BY 1")
def u05_ordered_warnings(spark: SparkSession, d: str) -> DataFrame:
    e = X.read(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    return e.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "event_type"))), lambda x: x["event_type"]), ",").alias("warnings"))


@query(f"WITH {X.TOK} SELECT job_id, lang, count(*) AS words, count(DISTINCT norm) AS vocabulary FROM tok GROUP BY 1, 2")
def a28_language_counts(spark: SparkSession, d: str) -> DataFrame:
    return X.tok(spark, d).groupBy("job_id", "lang").agg(F.count("*").alias("words"), F.count_distinct("norm").alias("vocabulary"))


_SPK = "CASE WHEN (job_id + idx // 7) % 3 = 0 THEN 'A' WHEN (job_id + idx // 5) % 2 = 0 THEN 'B' ELSE 'C' END"


def _speaker() -> F.Column:
    j, i = F.col("job_id"), F.col("idx")
    return F.when((j + F.floor(i / 7)) % 3 == 0, "A").when((j + F.floor(i / 5)) % 2 == 0, "B").otherwise("C")


@query(f"WITH {X.TOK}, s AS (SELECT job_id, chunk_id, {_SPK} AS speaker, count(*) AS n, min(idx) AS first FROM tok GROUP BY 1, 2, 3) SELECT job_id, chunk_id, speaker, n FROM s QUALIFY row_number() OVER (PARTITION BY job_id, chunk_id ORDER BY n DESC, first) = 1")
def a31_majority_speaker(spark: SparkSession, d: str) -> DataFrame:
    s = X.tok(spark, d).groupBy("job_id", "chunk_id", _speaker().alias("speaker")).agg(F.count("*").alias("n"), F.min("idx").alias("first"))
    g = s.groupBy("job_id", "chunk_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "first", "speaker", "n")).alias("b"))
    return g.select("job_id", "chunk_id", "b.speaker", "b.n")


@query(f"WITH {X.TOK}, s AS (SELECT job_id, idx, {_SPK} AS own FROM tok), c AS (SELECT *, count(CASE WHEN own = 'A' THEN 1 END) OVER w AS a, count(CASE WHEN own = 'B' THEN 1 END) OVER w AS b, count(CASE WHEN own = 'C' THEN 1 END) OVER w AS c FROM s WINDOW w AS (PARTITION BY job_id ORDER BY idx ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)) SELECT job_id, idx, CASE WHEN greatest(a, b, c) = CASE own WHEN 'A' THEN a WHEN 'B' THEN b ELSE c END THEN own WHEN a >= b AND a >= c THEN 'A' WHEN b >= c THEN 'B' ELSE 'C' END AS smooth FROM c")
def w24_smoothed_labels(spark: SparkSession, d: str) -> DataFrame:
    """Majority of the labels over four words on both sides; a tie keeps the own label."""
    w = W.partitionBy("job_id").orderBy("idx").rowsBetween(-4, 4)
    s = X.tok(spark, d).select("job_id", "idx", _speaker().alias("own"))
    c = s.select("*", *[F.count(F.when(F.col("own") == k, 1)).over(w).alias(k.lower() + "_") for k in "ABC"])
    a, b, k = F.col("a_"), F.col("b_"), F.col("c_")
    own = F.when(F.col("own") == "A", a).when(F.col("own") == "B", b).otherwise(k)
    return c.select("job_id", "idx", F.when(F.greatest(a, b, k) == own, F.col("own")).when((a >= b) & (a >= k), "A").when(b >= k, "B").otherwise("C").alias("smooth"))


@query(f"""WITH {X.TOK}, a AS (SELECT DISTINCT norm, norm || '*' AS common FROM tok WHERE length(norm) = 4 AND idx < 50), p AS (SELECT DISTINCT norm, lang, '<' || norm || '>' AS own FROM tok WHERE length(norm) = 4 AND idx < 5)
SELECT t.job_id, t.idx, coalesce(own, common) AS shown FROM tok t LEFT JOIN a ON t.norm = a.norm LEFT JOIN p ON t.norm = p.norm AND t.lang = p.lang WHERE coalesce(own, common) IS NOT NULL""")
def j17_glossary(spark: SparkSession, d: str) -> DataFrame:
    """Terms from a project's glossary (here: a language's) before those of the common one. Glossaries grow with the corpus here, so they are joined, not broadcast by force."""
    t = X.tok(spark, d).where("length(norm) = 4")
    common = t.where("idx < 50").select(F.col("norm"), F.concat("norm", F.lit("*")).alias("common")).distinct()
    project = t.where("idx < 5").select("norm", "lang", F.concat(F.lit("<"), "norm", F.lit(">")).alias("own")).distinct()
    shown = t.join(common, "norm", "left").join(project, ["norm", "lang"], "left")
    return shown.select("job_id", "idx", F.coalesce("own", "common").alias("shown")).where("shown IS NOT NULL")


@query(f"WITH {X.ALIGNED}, v AS (SELECT t.job_id, t.idx, t.norm IS DISTINCT FROM h.norm AS changed FROM tok t LEFT JOIN am h ON t.job_id = h.job_id AND t.idx = h.idx AND h.engine = 'a'), r AS (SELECT *, idx - row_number() OVER (PARTITION BY job_id ORDER BY idx) AS g FROM v WHERE changed) SELECT job_id, min(idx) AS first, max(idx) AS last FROM r GROUP BY job_id, g")
def j20_edited_spans(spark: SparkSession, d: str) -> DataFrame:
    """Runs of words at which two versions differ, by their alignment."""
    v = L.beside(spark, d, ["job_id", "idx", "norm"], ["norm"], "a").where(~F.col("norm").eqNullSafe(F.col("a_norm"))).select("job_id", "idx")
    r = v.withColumn("g", F.col("idx") - F.row_number().over(W.partitionBy("job_id").orderBy("idx")))
    return r.groupBy("job_id", "g").agg(F.min("idx").alias("first"), F.max("idx").alias("last")).drop("g")


@query("""WITH s AS (SELECT user_id AS job_id, event_type AS stage, epoch_us(ts) AS us, event_id FROM events), n AS (SELECT max(us) AS now FROM s), live AS (SELECT DISTINCT job_id FROM s, n WHERE us > now - 1800000000),
l AS (SELECT job_id, max(us) AS last, max_by(stage, (us, event_id)) = 'error' AS interrupted, max_by(stage, CASE WHEN stage <> 'error' THEN (us, event_id) END) AS last_stage, count(CASE WHEN stage <> 'error' THEN 1 END) AS completed, count(*) AS stages FROM s GROUP BY 1)
SELECT job_id, last_stage, completed, stages, (now - last) // 1000000 AS age_s FROM l, n WHERE (interrupted OR now - last >= 21600000000) AND job_id NOT IN (SELECT job_id FROM live)""")
def j21_resume_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Jobs that were interrupted (their last stage failed), or had no event for six hours, and are not live (an event in the last half hour), with
    the last stage that completed. The log's end is one row."""
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    s = X.read(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("stage"), us.alias("us"), "event_id").withColumn("done", F.col("stage") != "error")
    end = F.broadcast(s.agg(F.max("us").alias("now")).withColumn("one", F.lit(1)))
    at = F.struct("us", "event_id")
    last = s.groupBy("job_id").agg(F.max("us").alias("last"), (~F.max_by("done", at)).alias("interrupted"), F.max_by("stage", F.when(F.col("done"), at)).alias("last_stage"), F.count_if("done").alias("completed"), F.count("*").alias("stages"))
    live = s.withColumn("one", F.lit(1)).join(end, "one").where("us > now - 1800000000").select("job_id").distinct()
    jobs = last.withColumn("one", F.lit(1)).join(end, "one").where("interrupted OR now - last >= 21600000000").join(live, "job_id", "left_anti")
    return jobs.select("job_id", "last_stage", "completed", "stages", F.floor((F.col("now") - F.col("last")) / 1000000).alias("age_s"))


@query(f"WITH {X.CUE}, t AS (SELECT job_id, start_ms - 300 AS start_ms, '[' || role || ']' AS text, 1 AS tag FROM cue WHERE cue_id % 2 = 0 UNION ALL SELECT job_id, start_ms, text, 0 FROM cue) SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY start_ms, tag, text) AS place, start_ms, text FROM t")
def o05_merged_tags(spark: SparkSession, d: str) -> DataFrame:
    c = X.cue(spark, d)
    tags = c.where("cue_id % 2 = 0").select("job_id", (F.col("start_ms") - 300).alias("start_ms"), F.concat(F.lit("["), "role", F.lit("]")).alias("text"), F.lit(1).alias("tag"))
    t = tags.unionByName(c.select("job_id", "start_ms", "text", F.lit(0).alias("tag")))
    return t.select("job_id", F.row_number().over(W.partitionBy("job_id").orderBy("start_ms", "tag", "text")).cast("long").alias("place"), "start_ms", "text")
