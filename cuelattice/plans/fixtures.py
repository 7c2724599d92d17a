"""Alignment tables derived from the given tables by integer rules, in Spark and as SQL for comparison.

tok: one row per word of each document (a job), timed. hyp: three engines' versions of it with dropped, reversed and inserted words.
iv: events as labelled intervals per user. fr: events as a frame series per user (values in per cent). cue: conversation turns as cues.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelattice.functions import text as T

CHUNK = 40


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def tok(spark: SparkSession, d: str) -> DataFrame:
    words = read(spark, d, "documents").select(F.col("doc_id").alias("job_id"), "lang", F.posexplode(T.tokens(F.col("text"))).alias("idx", "word"))
    dur = T.spoken_ms(F.col("word"))
    pause = F.when(F.col("word").rlike("[.!?]$"), 700).when((F.col("idx") + 1) % 25 == 0, 2500).otherwise(30)
    before = W.partitionBy("job_id").orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(dur + pause).over(before), F.lit(0)).cast("long")
    timed = words.withColumn("start_ms", start).withColumn("end_ms", F.col("start_ms") + dur)
    return timed.withColumn("norm", T.normalize_word(F.col("word"))).withColumn("chunk_id", F.floor(F.col("idx") / CHUNK).cast("int"))


def hyp(spark: SparkSession, d: str) -> DataFrame:
    engines = F.array(*[F.struct(F.lit(e).alias("engine"), F.lit(k).alias("k")) for e, k in (("a", 1), ("b", 2), ("c", 3))])
    rows = tok(spark, d).select("*", F.explode(engines).alias("e")).select("*", "e.engine", "e.k").withColumn("r", (F.col("job_id") * 7 + F.col("idx") * 13 + F.col("k")) % 31)
    rows = rows.where("r <> 0").withColumn("heard", F.when(F.col("r") == 1, F.array(F.reverse("word"))).when(F.col("r") == 2, F.array("word", F.lit("uh"))).otherwise(F.array("word")))
    rows = rows.select("*", F.posexplode("heard").alias("sub", "said"))
    shift = ((F.col("job_id") + F.col("idx") * 31) % 7 - 3) * 40 + F.col("sub") * 100
    conf = (F.col("job_id") * 3 + F.col("idx") * 5 + F.col("k") * 7) % 1000
    return rows.select("job_id", "lang", "chunk_id", "engine", "idx", "sub", F.col("said").alias("word"), T.normalize_word(F.col("said")).alias("norm"), (F.col("start_ms") + shift).alias("start_ms"), (F.col("end_ms") + shift).alias("end_ms"), conf.alias("conf"))


def heard(spark: SparkSession, d: str) -> DataFrame:
    """hyp as an engine delivers it: words by their own positions, without any of the reference's."""
    pos = F.row_number().over(W.partitionBy("job_id", "engine").orderBy("idx", "sub")) - 1
    return hyp(spark, d).select("job_id", "lang", "engine", pos.alias("pos"), "word", "norm", "start_ms", "end_ms", "conf")


def aligned(spark: SparkSession, d: str) -> DataFrame:
    """What each engine heard, aligned with the transcript, with the heard words' columns."""
    from cuelattice.plans import lists

    return lists.aligned(spark, d)


def iv(spark: SparkSession, d: str) -> DataFrame:
    start = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) div 1000")
    length = 200 + F.floor(F.col("value") * 1000000) % 36000000
    return read(spark, d, "events").select(F.col("event_id").alias("iv_id"), F.col("user_id").alias("job_id"), start.alias("start_ms"), (start + length).alias("end_ms"), F.col("event_type").alias("label"), (F.col("event_id") % 100).alias("score"))


def fr(spark: SparkSession, d: str) -> DataFrame:
    rn = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return read(spark, d, "events").select(F.col("user_id").alias("job_id"), rn.alias("frame"), (F.floor("value") % 100).alias("p"))


def cue(spark: SparkSession, d: str) -> DataFrame:
    """Turns as cues: time follows length; every 7th has a tag in front."""
    c = read(spark, d, "conversations").where("role <> 'system'")
    text = F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, F.concat(F.lit("[music] "), F.col("text"))).otherwise(F.col("text"))
    ms = F.length("text") * 40 + 500
    before = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(ms + (F.col("turn") * 370) % 1500 - 100).over(before), F.lit(0)).cast("long")
    return c.select(F.col("conv_id").alias("job_id"), F.col("turn").cast("int").alias("cue_id"), "role", text.alias("text"), start.alias("start_ms"), (start + ms).alias("end_ms"))


NORM = r"lower(regexp_replace({}, '[^\p{{L}}\p{{N}}_\s]', '', 'g'))"
TOK = rf"""tok0 AS (SELECT doc_id AS job_id, lang, unnest(range(0, len(ws))) AS idx, unnest(ws) AS word FROM (SELECT doc_id, lang, regexp_extract_all(text, '[^ \n\t\r]+') AS ws FROM documents)),
tok AS MATERIALIZED (SELECT *, start_ms + dur AS end_ms, {NORM.format("word")} AS norm, idx // {CHUNK} AS chunk_id FROM (SELECT *, coalesce(sum(dur + pause) OVER (PARTITION BY job_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms
 FROM (SELECT *, least(800, greatest(150, 70 * length(word) + 50)) AS dur, CASE WHEN regexp_matches(word, '[.!?]$') THEN 700 WHEN (idx + 1) % 25 = 0 THEN 2500 ELSE 30 END AS pause FROM tok0)))"""
HYP = rf"""{TOK}, hyp0 AS (SELECT *, (job_id * 7 + idx * 13 + k) % 31 AS r FROM tok, (VALUES ('a', 1), ('b', 2), ('c', 3)) e(engine, k)),
hyp AS MATERIALIZED (SELECT job_id, lang, chunk_id, engine, idx, sub, said AS word, {NORM.format("said")} AS norm, start_ms + shift AS start_ms, end_ms + shift AS end_ms, conf FROM (
 SELECT *, ((job_id + idx * 31) % 7 - 3) * 40 + sub * 100 AS shift, (job_id * 3 + idx * 5 + k * 7) % 1000 AS conf, CASE WHEN sub = 1 THEN 'uh' WHEN r = 1 THEN reverse(word) ELSE word END AS said FROM hyp0, (VALUES (0), (1)) s(sub) WHERE r <> 0 AND (sub = 0 OR r = 2)))"""
#: hyp by each engine's own positions.
HEARD = f"{HYP}, heard AS MATERIALIZED (SELECT job_id, lang, engine, row_number() OVER (PARTITION BY job_id, engine ORDER BY idx, sub) - 1 AS pos, word, norm, start_ms, end_ms, conf FROM hyp)"


def aligned_sql(ref: str, heard: str, name: str = "al") -> str:
    """CTEs whose last, name, aligns ref (job_id, idx, norm) with heard (job_id, engine, pos, norm), as operators.align.aligned does."""
    gram = "SELECT {0}, g, min({1}) AS {1} FROM (SELECT {0}, {1}, norm || chr(10) || lead(norm, 1) OVER w || chr(10) || lead(norm, 2) OVER w AS g FROM {2} WINDOW w AS (PARTITION BY {0} ORDER BY {1})) WHERE g IS NOT NULL GROUP BY {0}, g HAVING count(*) = 1"
    clean = "SELECT job_id, engine, idx, pos FROM (SELECT *, max(pos) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mx, min(pos) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS mn FROM {} WINDOW w AS (PARTITION BY job_id, engine ORDER BY idx, pos)) WHERE coalesce(mx, -1) < pos AND coalesce(mn, pos + 1) > pos"
    around = "last_value(CASE WHEN {1} IS NOT NULL THEN w1.idx END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {0}i, last_value({1} IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {0}p, first_value(CASE WHEN {1} IS NOT NULL THEN w1.idx END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS {0}j, first_value({1} IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS {0}q"
    n = name
    equal = "SELECT job_id, engine, n, m, coalesce(min(CASE WHEN norm IS DISTINCT FROM said THEN place END), count(*)) AS {0} FROM (SELECT s.job_id, s.engine, n, m, h.norm, r.norm AS said, {1} AS place FROM {2} s JOIN {3} h ON h.job_id = s.job_id AND h.engine = s.engine LEFT JOIN {4} r ON r.job_id = s.job_id AND r.idx = {5}) GROUP BY ALL"
    return f"""{n}_s AS (SELECT h.job_id, h.engine, any_value(k.n) AS n, count(*) AS m FROM {heard} h JOIN (SELECT job_id, count(*) AS n FROM {ref} GROUP BY 1) k ON k.job_id = h.job_id GROUP BY 1, 2),
{n}_e AS (SELECT job_id, engine, n, m, p, least(q, n - p, m - p) AS q FROM ({equal.format("p", "h.pos", n + "_s", heard, ref, "h.pos")}) JOIN ({equal.format("q", "m - 1 - h.pos", n + "_s", heard, ref, "n - m + h.pos")}) USING (job_id, engine, n, m)),
{n}_1 AS MATERIALIZED (SELECT job_id, engine, idx, min(pos) AS pos FROM (SELECT job_id, engine, p - 1 AS idx, p - 1 AS pos FROM {n}_e WHERE p > 0 UNION SELECT job_id, engine, n - q, m - q FROM {n}_e WHERE q > 0 UNION SELECT a.job_id, b.engine, a.idx, b.pos FROM ({gram.format("job_id", "idx", ref)}) a JOIN ({gram.format("job_id, engine", "pos", heard)}) b ON a.job_id = b.job_id AND a.g = b.g) GROUP BY 1, 2, 3),
{n}_2 AS MATERIALIZED ({clean.format(n + "_1")}), {n}_w AS MATERIALIZED (SELECT r.job_id, e.engine, r.idx, r.norm FROM {ref} r JOIN (SELECT DISTINCT job_id, engine FROM {heard}) e ON r.job_id = e.job_id),
{n}_3 AS MATERIALIZED (SELECT job_id, engine, idx, norm, CASE WHEN idx - li + lp < coalesce(lq, idx - li + lp + 1) THEN idx - li + lp END AS x, CASE WHEN idx - lj + lq > coalesce(lp, -1) THEN idx - lj + lq END AS y
 FROM (SELECT w1.*, {around.format("l", "a.pos")} FROM {n}_w w1 LEFT JOIN {n}_2 a USING (job_id, engine, idx) WINDOW w AS (PARTITION BY w1.job_id, w1.engine ORDER BY w1.idx))),
{n}_4 AS MATERIALIZED (SELECT c.job_id, c.engine, c.idx, coalesce(h.pos, k.pos) AS pos FROM {n}_3 c LEFT JOIN {heard} h ON h.job_id = c.job_id AND h.engine = c.engine AND h.pos = c.x AND h.norm = c.norm LEFT JOIN {heard} k ON k.job_id = c.job_id AND k.engine = c.engine AND k.pos = c.y AND k.norm = c.norm WHERE h.pos IS NOT NULL OR k.pos IS NOT NULL),
{n}_5 AS MATERIALIZED ({clean.format(n + "_4")}),
{n} AS MATERIALIZED (SELECT job_id, engine, idx, coalesce(pos, swapped) AS pos, pos IS NOT NULL AS same FROM (SELECT job_id, engine, idx, pos, CASE WHEN gj - gi = gq - gp THEN gp + idx - gi END AS swapped
 FROM (SELECT w1.*, m.pos, {around.format("g", "m.pos")} FROM {n}_w w1 LEFT JOIN {n}_5 m USING (job_id, engine, idx) WINDOW w AS (PARTITION BY w1.job_id, w1.engine ORDER BY w1.idx))) WHERE coalesce(pos, swapped) IS NOT NULL)"""


#: What each engine heard, aligned with the transcript.
ALIGNED = f"{HEARD}, {aligned_sql('tok', 'heard')}, am AS MATERIALIZED (SELECT al.*, h.norm, h.start_ms, h.end_ms, h.conf FROM al JOIN heard h USING (job_id, engine, pos))"
IV = "iv AS (SELECT event_id AS iv_id, user_id AS job_id, s AS start_ms, s + 200 + floor(value * 1000000)::BIGINT % 36000000 AS end_ms, event_type AS label, event_id % 100 AS score FROM (SELECT *, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000 AS s FROM events))"
FR = "fr AS (SELECT user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, floor(value)::BIGINT % 100 AS p FROM events)"
CUE = """cue AS (SELECT conv_id AS job_id, turn::INT AS cue_id, role, CASE WHEN (conv_id + turn) % 7 = 0 THEN '[music] ' || text ELSE text END AS text, s AS start_ms, s + ms AS end_ms FROM (
 SELECT *, coalesce(sum(ms + (turn * 370) % 1500 - 100) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM (SELECT *, length(text) * 40 + 500 AS ms FROM conversations WHERE role <> 'system')))"""
