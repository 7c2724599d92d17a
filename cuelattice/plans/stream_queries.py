"""Batch twins of the streaming jobs, and monitors over the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelattice.plans import fixtures as X
from cuelattice.plans.book import query
from cuelattice.sources import files
from cuelattice.streaming import live


def timed(events: DataFrame) -> DataFrame:
    """events with `at`, an instant: the given time is without zone and taken as UTC."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return events.withColumn("at", F.timestamp_micros(micros))


@query("WITH e AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), g AS (SELECT *, sum(CASE WHEN ts - p < INTERVAL 2 HOURS THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM g GROUP BY user_id, s")
def t01_utterances(spark: SparkSession, d: str) -> DataFrame:
    return live.utterances(timed(X.read(spark, d, "events")))


@query("SELECT epoch_us(ts) // 3600000000 * 3600000000 AS start_us, count(*) AS n, count(CASE WHEN event_type = 'error' THEN 1 END) AS errors FROM events GROUP BY 1")
def t03_error_rates(spark: SparkSession, d: str) -> DataFrame:
    return live.rates(timed(X.read(spark, d, "events")))


@query("SELECT s AS start_us, count(*) AS n, count(CASE WHEN event_type = 'error' THEN 1 END) AS errors FROM (SELECT event_type, unnest([epoch_us(ts) // 1800000000 * 1800000000, epoch_us(ts) // 1800000000 * 1800000000 - 1800000000]) AS s FROM events) GROUP BY 1")
def t03_sliding_rates(spark: SparkSession, d: str) -> DataFrame:
    return live.rates(timed(X.read(spark, d, "events")), slide="30 minutes")


@query("SELECT a.user_id, a.event_type AS gram, a.event_id AS first, b.event_id AS again FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 30 MINUTES")
def t04_repetitions(spark: SparkSession, d: str) -> DataFrame:
    """Batch twin of the repetition detector: the same kind of event of a user again within half an hour."""
    return live.repeated_again(timed(X.read(spark, d, "events")).withColumn("gram", F.col("event_type")), "30 minutes")


@query("WITH l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1), n AS (SELECT max(ts) AS now FROM events) SELECT user_id, (epoch_us(now) - epoch_us(last)) // 60000000 AS silent_min FROM l, n WHERE epoch_us(now) - epoch_us(last) > 6 * 3600000000")
def t05_stale_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Jobs without an event for six hours; their last events and the log's end are small aggregates."""
    us = F.unix_micros("at")
    last = timed(X.read(spark, d, "events")).groupBy("user_id").agg(F.max(us).alias("last"))
    now = last.agg(F.max("last").alias("now")).withColumn("one", F.lit(1))
    quiet = F.col("now") - F.col("last")
    return last.withColumn("one", F.lit(1)).join(F.broadcast(now), "one").where(quiet > 6 * 3600 * 1_000_000).select("user_id", F.floor(quiet / 60_000_000).alias("silent_min"))


@query("WITH e AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx, event_id FROM events), g AS (SELECT *, coalesce(sum((nx IS NULL OR nx - ts >= INTERVAL 6 HOURS)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM e) SELECT user_id, epoch_us(max(ts)) AS last_us, count(*) AS n FROM g GROUP BY user_id, s")
def t05_silences(spark: SparkSession, d: str) -> DataFrame:
    """Batch twin of the alerts that a job went silent for six hours."""
    return live.silences(timed(X.read(spark, d, "events")))


@query("WITH e AS (SELECT user_id AS job_id, event_type AS stage, epoch_us(ts) AS us, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS nx FROM events) SELECT job_id, stage, count(*) AS runs, coalesce(sum(nx - us), 0)::BIGINT AS took_us, count(nx) AS ended FROM e GROUP BY 1, 2")
def a29_stage_durations(spark: SparkSession, d: str) -> DataFrame:
    """A stage lasts until the job's next event; how often each ran, and ended."""
    e = timed(X.read(spark, d, "events")).select(F.col("user_id").alias("job_id"), F.col("event_type").alias("stage"), F.unix_micros("at").alias("us"), F.unix_micros(F.lead("at").over(W.partitionBy("user_id").orderBy("ts", "event_id"))).alias("nx"))
    return e.groupBy("job_id", "stage").agg(F.count("*").alias("runs"), F.coalesce(F.sum(F.col("nx") - F.col("us")), F.lit(0)).alias("took_us"), F.count("nx").alias("ended"))


@query("WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT user_id, event_type, event_id, value FROM e WHERE rn = 1")
def s19_store_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A store of the first events, one row per job and kind, upserted with the later ones."""
    e = X.read(spark, d, "events").select("user_id", "event_type", "event_id", "ts", "value")
    key, order = ["user_id", "event_type"], ["ts", "event_id"]
    early = F.col("event_id") % 2 == 0
    store = files.upserted(e.where(early).limit(0), e.where(early), key, order)
    return files.upserted(store, e.where(~early), key, order).select("user_id", "event_type", "event_id", "value")


@query("SELECT event_id, user_id, ts::VARCHAR AS at FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def o03_recent_jobs(spark: SparkSession, d: str) -> DataFrame:
    """The 20 most recent entries: a top-k report."""
    return X.read(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "user_id", F.col("ts").cast("string").alias("at"))


#: Weights of an issue's risk, in tenths; repetition has none, so it never counts.
_W = {"agreement": 10, "confidence": 8, "timing": 6, "acoustic": 5, "semantic": 7}
_R = "(SELECT event_id, event_id % 100 AS agreement, (event_id * 7) % 50 AS confidence, CASE WHEN event_id % 3 = 0 THEN 0 ELSE (event_id * 11) % 100 END AS timing, (event_id * 13) % 3 * 40 AS acoustic, (event_id * 17) % 5 * 20 AS semantic FROM events)"
_ACTIVE = "(" + " + ".join(f"CASE WHEN {k} > 0 THEN {w} ELSE 0 END" for k, w in _W.items()) + ")"
_SUM = "(" + " + ".join(f"{k} * {w}" for k, w in _W.items()) + ")"


@query(f"SELECT event_id, CASE WHEN {_ACTIVE} = 0 THEN 0 ELSE {_SUM} * 10 // {_ACTIVE} END AS overall, CASE WHEN {_ACTIVE} > 0 AND {_SUM} >= 70 * {_ACTIVE} THEN 'high' WHEN {_ACTIVE} > 0 AND {_SUM} >= 40 * {_ACTIVE} THEN 'medium' ELSE 'low' END AS severity FROM {_R}")
def a30_issue_risk(spark: SparkSession, d: str) -> DataFrame:
    """Weighted mean over the risks that are not zero, per mille, and its severity."""
    i = F.col("event_id")
    parts = {"agreement": i % 100, "confidence": i * 7 % 50, "timing": F.when(i % 3 == 0, 0).otherwise(i * 11 % 100), "acoustic": i * 13 % 3 * 40, "semantic": i * 17 % 5 * 20}
    e = X.read(spark, d, "events").select("event_id", *[v.alias(k) for k, v in parts.items()])
    active, total = F.lit(0), F.lit(0)
    for k, w in _W.items():
        active = active + F.when(F.col(k) > 0, w).otherwise(0)
        total = total + F.col(k) * w
    severity = F.when((active > 0) & (total >= 70 * active), "high").when((active > 0) & (total >= 40 * active), "medium").otherwise("low")
    return e.select("event_id", F.when(active == 0, 0).otherwise(F.floor(total * 10 / active)).cast("long").alias("overall"), severity.alias("severity"))
