"""Live word and event streams with Structured Streaming. Each job has a batch twin; a replay of the same rows gives the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def utterances(events: DataFrame, gap: str = "2 hours", late: str | None = None) -> DataFrame:
    """Pause-based utterances (user_id, start, n): sessions of a user's events. events: user_id, at (timestamp)."""
    events = events.withWatermark("at", late) if late else events
    g = events.groupBy("user_id", F.session_window("at", gap).alias("s")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.unix_micros("s.start").alias("start_us"), "n")


def rates(events: DataFrame, length: str = "1 hour", late: str | None = None, slide: str | None = None) -> DataFrame:
    """Events and errors per window (start_us, n, errors); windows are tumbling, or slide."""
    events = events.withWatermark("at", late) if late else events
    g = events.groupBy(F.window("at", length, slide).alias("w")).agg(F.count("*").alias("n"), F.count(F.when(F.col("event_type") == "error", 1)).alias("errors"))
    return g.select(F.unix_micros("w.start").alias("start_us"), "n", "errors")


def repeated_again(events: DataFrame, within: str = "30 seconds", late: str | None = None) -> DataFrame:
    """Repetition with a memory: each event with the same (user_id, event_type, gram) as an earlier one of at most `within` before it (user_id, gram, first,
    again: event ids). A self-join with a time bound, so a stream keeps no more than `within` and `late` of events. events: user_id, at, event_id, gram."""
    a, b = ((events.withWatermark("at", late) if late else events).select(*[F.col(c).alias(f"{c}_{k}") for c in ("user_id", "gram", "at", "event_id")]) for k in "ab")
    near = (F.col("at_b") > F.col("at_a")) & (F.col("at_b") <= F.col("at_a") + F.expr(f"INTERVAL {within}"))
    both = a.join(b, (F.col("user_id_a") == F.col("user_id_b")) & (F.col("gram_a") == F.col("gram_b")) & near)
    return both.select(F.col("user_id_a").alias("user_id"), F.col("gram_a").alias("gram"), F.col("event_id_a").alias("first"), F.col("event_id_b").alias("again"))


def latest(events: DataFrame) -> DataFrame:
    """Last state per job of an event log (user_id, state, n)."""
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("at", "event_id")).alias("state"), F.count("*").alias("n"))


def replayed(stream: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Run a complete-mode stream over all that is there, into Parquet files beside the checkpoint. Each batch's result replaces the one before, so a batch
    that is run again after a loss changes nothing, and no result gathers on the driver."""
    out = f"{checkpoint}-{name}"
    stream.sparkSession.createDataFrame([], stream.schema).write.mode("ignore").parquet(out)
    q = stream.writeStream.outputMode("complete").foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def silences(events: DataFrame, after: str = "6 hours", late: str | None = None) -> DataFrame:
    """Alerts that a job went silent (user_id, last_us, events since it last spoke up): a session that the gap closed. As a stream in append mode each comes once, when the
    watermark passes the end of the gap, so a session's end is the timer. `late`: how long rows may lag (0 seconds by default, in streams)."""
    at = events.withWatermark("at", late or "0 seconds") if events.isStreaming else events
    g = at.groupBy("user_id", F.session_window("at", after).alias("s")).agg(F.count("*").alias("n"), F.max("at").alias("last"))
    return g.select("user_id", F.unix_micros("last").alias("last_us"), "n")


def latest_edits(edits: DataFrame, late: str = "1 hour") -> DataFrame:
    """The latest edit of each cue of an edit log, and how many there were: (job_id, cue, edit, amount, edits). A batch that is written again counts once: rows with an id
    seen before are dropped, as a stream for as long as `late` after it. edits: job_id, cue, event_id, amount, at."""
    if edits.isStreaming:
        once = edits.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])
    else:
        once = edits.dropDuplicates(["event_id"])
    g = once.groupBy("job_id", "cue").agg(F.max(F.struct("at", "event_id", "amount")).alias("o"), F.count("*").alias("edits"))
    return g.select("job_id", "cue", F.col("o.event_id").alias("edit"), "o.amount", "edits")


def written_to(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run an append-mode stream over all that is there, into Parquet files, and read them. Commits are Spark's, so a restart from the checkpoint writes nothing twice."""
    q = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
