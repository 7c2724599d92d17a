"""Words that an engine made up: loops of a phrase, stock phrases in silence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelattice.operators import intervals as I
from cuelattice.operators.align import backwards

# Longest repeated phrase; repeats by words of the phrase that are a loop where there is little speech (gated), and whatever the audio (sure).
MOST_WORDS, GATED, GATED_ELSE, SURE, SURE_ELSE = 8, {1: 4}, 3, {1: 7, 2: 5}, 4
# Mean speech below which a span has little, in per cent, and the silence on both sides of a phrase that stands alone.
LOW_SPEECH, ISLAND_MS = 35, 800
# Phrases that engines make up, as normalized words.
STOCK = [
    "thank you", "thank you very much", "thank you so much", "thanks", "thanks for watching", "thank you for watching", "thanks for listening", "thank you for listening",
    "thank you for your attention", "please subscribe", "subscribe", "like and subscribe", "please like and subscribe", "dont forget to subscribe", "subscribe to my channel",
    "subscribe to the channel", "see you next time", "see you in the next video", "see you later", "bye", "bye bye", "goodbye", "you", "the end", "so", "okay", "oh", "music", "applause",
    "laughter", "silence", "subtitles by the amaraorg community", "subtitles by", "transcribed by", "transcription by", "captions by", "translated by", "amaraorg", "merci", "merci beaucoup",
    "gracias", "muchas gracias", "danke", "vielen dank", "grazie", "obrigado", "obrigada", "شكرا", "شكرا لكم", "اشترك في القناة", "谢谢", "谢谢观看", "ご視聴ありがとうございました",
]


def _by(n: Column, some: dict[int, int], other: int) -> Column:
    return F.coalesce(*[F.when(n == k, v) for k, v in some.items()], F.lit(other))


def _resolved(candidates: DataFrame, by: list[str]) -> DataFrame:
    """Of candidates that overlap the first, then the first that begins after its end, and so on. candidates: by, first, until, ... Those that no chain of overlaps
    joins are apart, so only such chains are folds."""
    rest = [c for c in candidates.columns if c not in by]
    w = W.partitionBy(*by).orderBy("first")
    reach = F.max("until").over(w.rowsBetween(W.unboundedPreceding, -1))
    c = candidates.withColumn("new_", F.when(F.col("first") < reach, 0).otherwise(1)).withColumn("chain_", F.sum("new_").over(w))
    listed = c.groupBy(*by, "chain_").agg(F.sort_array(F.collect_list(F.struct("first", *[x for x in rest if x != "first"]))).alias("c"))
    kind = listed.schema["c"].dataType
    step = lambda acc, x: F.when(x["first"] >= acc["until"], F.struct(x["until"].cast("long").alias("until"), F.concat(acc["kept"], F.array(x)).alias("kept"))).otherwise(acc)
    start = F.struct(F.lit(-(1 << 60)).cast("long").alias("until"), F.array().cast(kind).alias("kept"))
    return listed.select(*by, F.explode(F.aggregate("c", start, step, lambda a: a["kept"])).alias("x")).select(*by, *[F.col(f"x.{r}").alias(r) for r in rest])


def loops(words: DataFrame) -> DataFrame:
    """(job_id, first, n, repeats, until): phrases of 1 to 8 words said several times back to back. Of several at one place that which covers most words, then the shortest;
    of overlapping ones the first. words: job_id, idx (0, 1, ...), norm.

    A word that equals the one n places before goes on with a loop of n words; the next word that does not ends it. One sort by job serves all n."""
    w, behind = W.partitionBy("job_id").orderBy("idx"), backwards(["job_id"], "idx")
    t = words.select("job_id", "idx", "norm", F.coalesce((F.col("norm") != "").cast("int"), F.lit(0)).alias("said"), F.max("idx").over(W.partitionBy("job_id")).alias("last"))
    t = t.select("*", *[F.when(~F.col("norm").eqNullSafe(F.lag("norm", n).over(w)), F.col("idx")).alias(f"b{n}") for n in range(1, MOST_WORDS + 1)])
    # The first place after this word where the loop is broken; for a phrase that begins here that is asked n - 1 words on.
    t = t.select("job_id", "idx", "said", "last", *[F.coalesce(F.last(f"b{n}", ignorenulls=True).over(behind), F.col("last") + 1).alias(f"b{n}") for n in range(1, MOST_WORDS + 1)])
    many = []
    for n in range(1, MOST_WORDS + 1):
        stop = F.lead(f"b{n}", n - 1).over(w) if n > 1 else F.col(f"b{n}")
        repeats = F.floor((stop - F.col("idx")) / n)
        spoken = F.sum("said").over(w.rowsBetween(0, n - 1)) > 0
        many.append(F.when(spoken & (repeats >= GATED.get(n, GATED_ELSE)), F.struct((repeats * n).alias("size"), F.lit(-n).alias("n"), repeats.alias("repeats"))))
    best = t.select("job_id", "idx", F.array_max(F.array_compact(F.array(*many))).alias("x")).where("x IS NOT NULL")
    c = best.select("job_id", F.col("idx").cast("long").alias("first"), (-F.col("x.n")).alias("n"), F.col("x.repeats").alias("repeats"), (F.col("idx") + F.col("x.size")).alias("until"))
    return _resolved(c, ["job_id"])


def speech_under(spans: DataFrame, frames: DataFrame, bucket_ms: int = 2000) -> DataFrame:
    """spans with `speech`, the mean of the frames that overlap them (null without any). spans: key, job_id, start_ms, end_ms; frames: job_id, start_ms, end_ms, p."""
    met = I.interval_join(spans.select("key", "job_id", "start_ms", "end_ms"), frames, bucket_ms).groupBy("l.key").agg(F.avg("r.p").alias("speech"))
    return spans.join(met, "key", "left")


def _spanned(parts: DataFrame, words: DataFrame, frames: DataFrame) -> DataFrame:
    """parts (job_id, first, until, ...) with start_ms, end_ms of their words and the speech beneath."""
    at = parts.select("job_id", "first", F.explode(F.sequence("first", F.col("until") - 1)).alias("idx"))
    times = at.join(words.select("job_id", F.col("idx").cast("long").alias("idx"), "start_ms", "end_ms"), ["job_id", "idx"]).groupBy("job_id", "first").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    return speech_under(parts.join(times, ["job_id", "first"]).withColumn("key", F.struct("job_id", "first")), frames).drop("key")


def loop_removals(words: DataFrame, frames: DataFrame) -> DataFrame:
    """(job_id, idx, repeats): words of loops after the first time: all where the repeats are so many that it is a loop for sure, else each time that has little speech
    beneath. words: job_id, idx, norm, start_ms, end_ms; frames: job_id, start_ms, end_ms, p (per cent)."""
    found = loops(words)
    times = found.select("job_id", "n", "repeats", F.explode(F.sequence(F.col("first") + F.col("n"), F.col("until") - F.col("n"), F.col("n").cast("long"))).alias("first"))
    times = times.withColumn("until", F.col("first") + F.col("n")).withColumn("sure", F.col("repeats") >= _by(F.col("n"), SURE, SURE_ELSE))
    gated = _spanned(times.where("NOT sure"), words, frames).where(F.col("speech") < LOW_SPEECH)
    gone = times.where("sure").select("job_id", "first", "until", "repeats").unionByName(gated.select("job_id", "first", "until", "repeats"))
    return gone.select("job_id", F.explode(F.sequence("first", F.col("until") - 1)).alias("idx"), "repeats")


def stock_removals(words: DataFrame, frames: DataFrame, phrases: list[str] = STOCK) -> DataFrame:
    """(job_id, idx, phrase): words of stock phrases that stand alone, with silence on both sides, and have little speech beneath. At a place the longest phrase counts,
    and of overlapping ones the first, also where it is kept."""
    w = W.partitionBy("job_id").orderBy("idx")
    sizes: dict[int, list[str]] = {}
    for p in phrases:
        sizes.setdefault(len(p.split(" ")), []).append(p)
    ahead = [F.col("norm"), *[F.lead("norm", k).over(w) for k in range(1, max(sizes))]]
    t = words.select("job_id", F.col("idx").cast("long").alias("idx"), "start_ms", "end_ms", F.array(*ahead).alias("ahead"), F.lag("end_ms").over(w).alias("p"), *[F.lead("start_ms", n).over(w).alias(f"nx{n}") for n in sizes])
    text = lambda n: F.array_join(F.slice("ahead", 1, n), " ", "\n")
    hit = F.coalesce(*[F.when(text(n).isin(sizes[n]), F.struct(F.lit(n).alias("n"), text(n).alias("phrase"), F.col(f"nx{n}").alias("nx"))) for n in sorted(sizes, reverse=True)])
    c = t.select("job_id", F.col("idx").alias("first"), "p", hit.alias("h")).where("h IS NOT NULL").select("job_id", "first", (F.col("first") + F.col("h.n")).alias("until"), "p", "h.phrase", "h.nx")
    alone = _spanned(_resolved(c, ["job_id"]), words, frames)
    alone = alone.where((F.col("p").isNull() | (F.col("start_ms") - F.col("p") >= ISLAND_MS)) & (F.col("nx").isNull() | (F.col("nx") - F.col("end_ms") >= ISLAND_MS)) & (F.col("speech") < LOW_SPEECH))
    return alone.select("job_id", F.explode(F.sequence("first", F.col("until") - 1)).alias("idx"), "phrase")
