"""Queries of reports: review and job summaries as JSON, triage quality, window checks, provisional times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelattice.plans import cue_queries as Q
from cuelattice.plans import fixtures as X
from cuelattice.plans import lists as L
from cuelattice.plans import vote_queries as V
from cuelattice.plans.book import query


@query(f"""{Q._REVIEW} SELECT job_id, '{{"job":' || job_id || ',"summary":{{"cues":' || count(*) || ',"accept":' || count(CASE WHEN tier = 'accept' THEN 1 END) || ',"redo":' || count(CASE WHEN tier = 'redo' THEN 1 END) || '}},"queue":[' || coalesce(string_agg(CASE WHEN tier <> 'accept' THEN chunk_id::VARCHAR END, ',' ORDER BY round(risk, 9) DESC, start_ms, chunk_id), '')
 || '],"cues":[' || string_agg('{{"cue":' || chunk_id || ',"tier":"' || tier || '"}}', ',' ORDER BY chunk_id) || ']}}' AS review FROM t GROUP BY 1""")
def s17_review_json(spark: SparkSession, d: str) -> DataFrame:
    """Each job's review: summary, queue of the cues to look at by falling risk, and all cues."""
    n = lambda t: F.count(F.when(F.col("tier") == t, 1)).alias(t)
    waiting = F.when(F.col("tier") != "accept", F.struct((-F.round("risk", 9)).alias("r"), "start_ms", "chunk_id"))
    g = Q._review(spark, d).groupBy("job_id").agg(F.count("*").alias("cues"), n("accept"), n("redo"), F.sort_array(F.collect_list(waiting)).alias("queue"), F.sort_array(F.collect_list(F.struct("chunk_id", "tier"))).alias("all"))
    whole = F.struct(F.col("job_id").alias("job"), F.struct("cues", "accept", "redo").alias("summary"), F.transform("queue", lambda x: x["chunk_id"]).alias("queue"), F.transform("all", lambda x: F.struct(x["chunk_id"].alias("cue"), x["tier"].alias("tier"))).alias("cues"))
    return g.select("job_id", F.to_json(whole).alias("review"))


_DONE = "CASE WHEN event_type = 'error' THEN 'failed' ELSE 'done' END"


@query(f"""SELECT user_id, '{{"job":' || user_id || ',"counts":{{"done":' || count(CASE WHEN event_type <> 'error' THEN 1 END) || ',"failed":' || count(CASE WHEN event_type = 'error' THEN 1 END) || '}},"files":[' || string_agg('{{"file":' || event_id || ',"stage":"' || event_type || '","status":"' || {_DONE} || '"}}', ',' ORDER BY event_id) || ']}}' AS manifest FROM events GROUP BY 1""")
def s18_job_manifest(spark: SparkSession, d: str) -> DataFrame:
    """A job's manifest: counts by status and an entry per file, in order."""
    status = F.when(F.col("event_type") == "error", "failed").otherwise("done")
    n = lambda s: F.count_if(status == s).alias(s)
    entry = F.struct(F.col("event_id").alias("file"), F.col("event_type").alias("stage"), status.alias("status"))
    g = X.read(spark, d, "events").groupBy("user_id").agg(n("done"), n("failed"), F.sort_array(F.collect_list(entry)).alias("files"))
    return g.select("user_id", F.to_json(F.struct(F.col("user_id").alias("job"), F.struct("done", "failed").alias("counts"), "files")).alias("manifest"))


@query(f"""{Q._REVIEW.replace(f"WITH {X.TOK}", f"WITH {X.ALIGNED}", 1)}, x AS (SELECT t.job_id, t.chunk_id, count(CASE WHEN t.norm IS DISTINCT FROM h.norm THEN 1 END) > 2 AS wrong FROM tok t LEFT JOIN am h ON t.job_id = h.job_id AND t.idx = h.idx AND h.engine = 'a' GROUP BY 1, 2)
SELECT t.job_id, count(*) AS cues, count(CASE WHEN wrong THEN 1 END) AS wrong, count(CASE WHEN wrong AND tier <> 'accept' THEN 1 END) AS found, count(CASE WHEN wrong AND tier = 'accept' THEN 1 END) AS accepted FROM t JOIN x USING (job_id, chunk_id) GROUP BY 1""")
def a10_triage_quality(spark: SparkSession, d: str) -> DataFrame:
    """Cues with errors, those that triage flagged, and those that it accepted."""
    bad = ~F.col("norm").eqNullSafe(F.col("a_norm"))
    x = L.beside(spark, d, ["job_id", "chunk_id", "norm"], ["norm"], "a").groupBy("job_id", "chunk_id").agg((F.count(F.when(bad, 1)) > 2).alias("wrong"))
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    both = Q._review(spark, d).select("job_id", "chunk_id", "tier").join(x, ["job_id", "chunk_id"])
    return both.groupBy("job_id").agg(F.count("*").alias("cues"), n(F.col("wrong"), "wrong"), n(F.col("wrong") & (F.col("tier") != "accept"), "found"), n(F.col("wrong") & (F.col("tier") == "accept"), "accepted"))


@query(f"WITH {X.ALIGNED}, j AS (SELECT job_id, max(end_ms) AS ms, sum(end_ms - start_ms)::BIGINT AS spoken FROM tok GROUP BY 1), i AS (SELECT job_id, engine, count(*) AS n FROM heard h WHERE norm <> '' AND NOT EXISTS (SELECT 1 FROM al WHERE al.job_id = h.job_id AND al.engine = h.engine AND al.pos = h.pos) GROUP BY 1, 2) SELECT i.job_id, engine, n, n * 600000 // greatest(1, ms - spoken) AS per_ten_minutes FROM i JOIN j USING (job_id)")
def a07_invented_words(spark: SparkSession, d: str) -> DataFrame:
    """Words that no reference has, per ten minutes without speech."""
    j = L.tok(spark, d, "job_id", "start_ms", "end_ms").groupBy("job_id").agg((F.max("end_ms") - F.sum(F.col("end_ms") - F.col("start_ms"))).alias("quiet"))
    i = L.alone(spark, d, "job_id", "engine", "norm").where("norm <> ''").groupBy("job_id", "engine").agg(F.count("*").alias("n"))
    return i.join(j, "job_id").select("job_id", "engine", "n", F.floor(F.col("n") * 600000 / F.greatest(F.lit(1), F.col("quiet"))).alias("per_ten_minutes"))


@query(f"""WITH {X.ALIGNED}, w AS (SELECT t.job_id, t.chunk_id, count(*) AS words, count(h.idx) AS timed, count(CASE WHEN h.end_ms - h.start_ms <= 10 THEN 1 END) AS tiny, count(DISTINCT h.start_ms // 10) AS starts, median(abs(h.start_ms - t.start_ms)) AS deviation FROM tok t LEFT JOIN am h ON t.job_id = h.job_id AND t.idx = h.idx AND h.engine = 'b' AND h.same GROUP BY 1, 2)
SELECT job_id, chunk_id, words, timed, deviation, CASE WHEN timed < greatest(1, words * 7 // 10) THEN 'few' WHEN tiny * 10 > 3 * timed THEN 'zero_length' WHEN timed >= 5 AND starts * 2 < timed THEN 'repeated' WHEN timed >= 3 AND deviation > 300 THEN 'deviates' ELSE 'ok' END AS verdict FROM w""")
def w42_window_check(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with an aligned window: under 70 % of its words have times, over 30 % of those have none of length, under half of their starts
    differ, or by the median they are more than 300 ms from the expected ones."""
    h = L.beside(spark, d, ["job_id", "chunk_id", "start_ms"], ["same", "start_ms", "end_ms"], "b")
    w = h.withColumns({"at": F.when(F.col("b_same"), F.col("b_start_ms")), "until": F.when(F.col("b_same"), F.col("b_end_ms"))}).groupBy("job_id", "chunk_id")
    tiny, starts = F.count(F.when(F.col("until") - F.col("at") <= 10, 1)).alias("tiny"), F.count_distinct(F.floor(F.col("at") / 10)).alias("starts")
    w = w.agg(F.count("*").alias("words"), F.count("at").alias("timed"), tiny, starts, F.percentile(F.abs(F.col("at") - F.col("start_ms")), F.lit(0.5)).alias("deviation"))
    few = F.col("timed") < F.greatest(F.lit(1), F.floor(F.col("words") * 7 / 10))
    wrong = F.when(few, "few").when(F.col("tiny") * 10 > 3 * F.col("timed"), "zero_length").when((F.col("timed") >= 5) & (F.col("starts") * 2 < F.col("timed")), "repeated")
    return w.select("job_id", "chunk_id", "words", "timed", "deviation", wrong.when((F.col("timed") >= 3) & (F.col("deviation") > 300), "deviates").otherwise("ok").alias("verdict"))


@query(f"{V._GAPS} SELECT job_id, idx, p + (nx - p) * j // (n + 1) AS start_ms FROM k WHERE p IS NOT NULL AND nx IS NOT NULL")
def w48_provisional_times(spark: SparkSession, d: str) -> DataFrame:
    """Even steps between the timed neighbours."""
    r = V.untimed_runs(V._untimed(spark, d)).where("p IS NOT NULL AND nx IS NOT NULL")
    return r.select("job_id", "idx", (F.col("p") + F.floor((F.col("nx") - F.col("p")) * F.col("j") / (F.col("n") + 1))).alias("start_ms"))


@query(f"WITH {X.CUE}, g AS (SELECT job_id, cue_id, start_ms, role, CASE WHEN lead(role) OVER {Q._ORDER} <> role AND lead(start_ms) OVER {Q._ORDER} - end_ms < 500 AND length(text) < 400 THEN 1 ELSE 0 END AS quick FROM cue) SELECT job_id, role, sum(quick)::BIGINT AS dash_candidates, count(*) AS cues FROM g GROUP BY 1, 2")
def w38_dash_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Cues that two quick speakers could share with the next one."""
    w = W.partitionBy("job_id").orderBy("start_ms", "cue_id")
    quick = (F.lead("role").over(w) != F.col("role")) & (F.lead("start_ms").over(w) - F.col("end_ms") < 500) & (F.length("text") < 400)
    g = X.cue(spark, d).withColumn("quick", F.when(quick, 1).otherwise(0))
    return g.groupBy("job_id", "role").agg(F.sum("quick").alias("dash_candidates"), F.count("*").alias("cues"))
