"""Joins and sweeps over intervals (start_ms, end_ms), for all jobs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def interval_join(left: DataFrame, right: DataFrame, bucket_ms: int, on: str = "job_id", within_ms: int = 0) -> DataFrame:
    """Pairs (l, r: structs) of a job whose intervals overlap, the left one widened by within_ms on both sides.

    Both sides are dealt to time buckets and meet in an equi-join; a pair counts only in its first shared bucket, so
    none comes twice. A long interval costs one row per bucket; a crowded job is spread over its buckets."""
    cut = lambda df, name, by: df.select(F.struct("*").alias(name), F.col(on).alias("k_"), F.explode(F.sequence(F.floor((F.col("start_ms") - by) / bucket_ms), F.floor((F.col("end_ms") + by) / bucket_ms))).alias("b_"))
    both = cut(left, "l", within_ms).join(cut(right, "r", 0), ["k_", "b_"])
    begin = F.greatest(F.col("l.start_ms") - within_ms, F.col("r.start_ms"))
    return both.where((begin < F.least(F.col("l.end_ms") + within_ms, F.col("r.end_ms"))) & (F.floor(begin / bucket_ms) == F.col("b_"))).select("l", "r")


def overlap(l: Column, r: Column) -> Column:
    return F.greatest(F.lit(0), F.least(l["end_ms"], r["end_ms"]) - F.greatest(l["start_ms"], r["start_ms"]))


def gap(l: Column, r: Column) -> Column:
    return F.greatest(F.lit(0), l["start_ms"] - r["end_ms"], r["start_ms"] - l["end_ms"])


def at_midpoint(df: DataFrame) -> DataFrame:
    """Intervals shrunk to one millisecond at their middle."""
    mid = F.floor((F.col("start_ms") + F.col("end_ms")) / 2)
    return df.withColumns({"start_ms": mid, "end_ms": mid + 1})


def nearest(left: DataFrame, right: DataFrame, key: str, name: str, bucket_ms: int, within_ms: int) -> DataFrame:
    """key, name: of each left interval the right one with the most overlap, else the nearest within the tolerance; null without any.
    Ties go to the earlier start, then the smaller name."""
    pairs = interval_join(left, right, bucket_ms, within_ms=within_ms)
    order = F.struct((-overlap(F.col("l"), F.col("r"))).alias("o"), gap(F.col("l"), F.col("r")).alias("g"), F.col("r.start_ms").alias("s"), F.col("r")[name].alias("n"))
    best = pairs.groupBy(F.col("l")[key].alias(key)).agg(F.min(order)["n"].alias(name))
    return left.select(key).join(best, key, "left")


def islands(df: DataFrame, by: list[str], gap_ms: int) -> DataFrame:
    """df with `island`: intervals of a group belong together while none starts later than gap_ms after the latest end so far."""
    w = W.partitionBy(*by).orderBy("start_ms", "end_ms")
    latest = F.max("end_ms").over(w.rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn("new_", F.when(F.col("start_ms") > latest + gap_ms, 1).otherwise(0)).withColumn("island", F.sum("new_").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("new_")


def crowded(df: DataFrame, at_least: int, merge_ms: int, min_ms: int, on: str = "job_id") -> DataFrame:
    """Regions of a job that at_least intervals cover: sweep over starts and ends, merged over short gaps, long enough."""
    steps = df.select(on, F.col("start_ms").alias("t"), F.lit(1).alias("d")).unionByName(df.select(on, F.col("end_ms").alias("t"), F.lit(-1).alias("d"))).groupBy(on, "t").agg(F.sum("d").alias("d"))
    w = W.partitionBy(on).orderBy("t")
    depth = steps.withColumn("depth", F.sum("d").over(w)).withColumn("until", F.lead("t").over(w)).where((F.col("depth") >= at_least) & F.col("until").isNotNull())
    regions = islands(depth.select(on, F.col("t").alias("start_ms"), F.col("until").alias("end_ms")), [on], merge_ms)
    return regions.groupBy(on, "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).where(F.col("end_ms") - F.col("start_ms") >= min_ms).drop("island")


def speech_segments(frames: DataFrame, hop_ms: int, on: int = 50, off: int = 35, quiet_ms: int = 100, min_ms: int = 250) -> DataFrame:
    """Segments by hysteresis from (job_id, frame, p). Between two frames >= on, a segment ends at the first frame < off if that and the last one < off are
    quiet_ms apart; frames between off and on change nothing. Stateless: one window per job over frames, then one over groups."""
    w = W.partitionBy("job_id").orderBy("frame")
    low = F.when(F.col("p") < off, F.col("frame"))
    g = frames.withColumn("grp", F.sum(F.when(F.col("p") >= on, 1).otherwise(0)).over(w)).where("grp > 0")
    g = g.groupBy("job_id", "grp").agg(F.min("frame").alias("high"), F.max("frame").alias("last"), F.min(low).alias("f"), F.max(low).alias("l"))
    v = W.partitionBy("job_id").orderBy("grp")
    g = g.withColumn("cut", F.coalesce((F.col("l") + 1 - F.col("f")) * hop_ms >= quiet_ms, F.lit(False)))
    g = g.withColumn("seg", F.coalesce(F.sum(F.col("cut").cast("int")).over(v.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    s = g.groupBy("job_id", "seg").agg((F.min("high") * hop_ms).alias("start_ms"), (F.coalesce(F.min(F.when(F.col("cut"), F.col("f"))), F.max("last") + 1) * hop_ms).alias("end_ms"))
    return s.where(F.col("end_ms") - F.col("start_ms") >= min_ms).drop("seg")


def padded(segments: DataFrame, pad_ms: int) -> DataFrame:
    """Segments widened by pad_ms; two neighbours share a shorter gap at its middle."""
    w = W.partitionBy("job_id").orderBy("start_ms")
    before, after = F.lag("end_ms").over(w), F.lead("start_ms").over(w)
    start = F.greatest(F.col("start_ms") - pad_ms, F.coalesce(F.floor((before + F.col("start_ms")) / 2), F.lit(0)), F.lit(0))
    end = F.least(F.col("end_ms") + pad_ms, F.coalesce(F.floor((F.col("end_ms") + after) / 2), F.col("end_ms") + pad_ms))
    return segments.select("job_id", start.alias("start_ms"), end.alias("end_ms"))


def fixed_chunks(jobs: DataFrame, length_ms: int) -> DataFrame:
    """(job_id, chunk_id, start_ms, end_ms) of equal chunks over each job's duration_ms."""
    c = jobs.select("job_id", "duration_ms", F.posexplode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("duration_ms") - 1), F.lit(length_ms))).alias("chunk_id", "start_ms"))
    return c.select("job_id", "chunk_id", "start_ms", F.least(F.col("start_ms") + length_ms, "duration_ms").alias("end_ms"))


def context_windows(jobs: DataFrame, length_ms: int, context_ms: int) -> DataFrame:
    """Windows with context on both sides: start_ms and end_ms with it, from_ms and to_ms without."""
    c = fixed_chunks(jobs, length_ms).withColumnsRenamed({"start_ms": "from_ms", "end_ms": "to_ms", "chunk_id": "window_id"})
    return c.withColumn("start_ms", F.greatest(F.lit(0), F.col("from_ms") - context_ms)).withColumn("end_ms", F.col("to_ms") + context_ms)
