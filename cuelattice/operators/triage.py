"""Review of cues: all features of a cue's risk, its tier and what the reviewer is told, and the risk's weights fitted to corrections.

Confidences are whole per cents, times whole milliseconds, so the sums behind shares are exact. Each side (words, conditions, removed words) is summed up
by cue before it meets the cues, so no join has more rows than its cues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelattice.functions import text as T
from cuelattice.operators import budget as B
from cuelattice.operators import cues as C
from cuelattice.operators import intervals as I

# Thresholds of low confidence, the confidences of words without any, least and greatest length of a word, how near a removed word counts.
LOW_TEXT, WEAK_TIMING, NO_TEXT_CONF, NO_TIMING_CONF = 60, 50, 100, 75
LEAST_WORD_MS, MOST_WORD_MS, REMOVED_WITHIN_MS = 30, 2500, 250
#: Conditions of the sound in the order in which reasons name them, with what the reviewer reads.
CONDITIONS = {
    "overlap": "overlapping speakers",
    "music": "music under speech",
    "crowd": "crowd noise under speech",
    "very_low_snr": "very noisy audio",
    "low_snr": "noisy audio",
    "noise": "background noise",
    "narrowband": "telephone-band audio",
    "clipping": "clipped (distorted) audio",
    "beside_tag": "next to a sound tag: words under applause or laughter are often mistimed",
}
FEATURES = list(C.WEIGHTS)


def _beside_tag() -> Column:
    """A sound tag in the cue or a neighbour of it; a cue that is nothing but its tag has no words to mistime."""
    w = W.partitionBy("job_id").orderBy("start_ms", "cue_id")
    has = F.exists(F.regexp_extract_all("text", F.lit(f"({T.TAG})"), F.lit(1)), T.sound_tag)
    near = F.coalesce(has, F.lit(False)) | F.coalesce(F.lag(has).over(w), F.lit(False)) | F.coalesce(F.lead(has).over(w), F.lit(False))
    return near & ~F.coalesce(T.sound_tag(F.trim("text")) & T.isolated_tag(F.col("text")), F.lit(False))


def features(cues: DataFrame, words: DataFrame, conditions: DataFrame, removed: DataFrame, mode: str = "reference") -> DataFrame:
    """Each cue with a column for every feature of the risk, and the counts that reasons name.

    cues (job_id, cue_id, start_ms, end_ms, text); words of cues (job_id, cue_id, start_ms, end_ms, text_conf, timing_conf, heard_by, interpolated);
    conditions of the sound (job_id, start_ms, end_ms, label) and words that a filter removed (job_id, start_ms). Mode: `reference` (the words are a given
    transcript's, so words that no engine heard matter) or `ensemble` (they are voted for). Nulls: a word without confidences has 100 and 75, one without
    heard_by was heard, one without times is not implausible; a cue without words has shares of zero; other labels count for nothing."""
    yes = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("int")), F.lit(0))
    tc, mc, ms = F.coalesce("text_conf", F.lit(NO_TEXT_CONF)), F.coalesce("timing_conf", F.lit(NO_TIMING_CONF)), F.col("end_ms") - F.col("start_ms")
    w = words.groupBy("job_id", "cue_id").agg(
        F.count("*").alias("n"), F.sum(100 - tc).alias("doubt"), yes(tc < LOW_TEXT).alias("disputed"), yes(mc < WEAK_TIMING).alias("weak"),
        yes((mc < WEAK_TIMING) & ~F.coalesce("interpolated", F.lit(False))).alias("uncertain"), yes(F.col("heard_by") == 0).alias("not_heard"),
        yes(F.col("interpolated")).alias("placed"), F.coalesce(F.sum(F.when(F.col("interpolated"), ms)), F.lit(0)).alias("placed_ms"),
        yes(~ms.between(LEAST_WORD_MS, MOST_WORD_MS)).alias("odd"),
    )
    spans = cues.select("job_id", "cue_id", "start_ms", F.greatest("end_ms", F.col("start_ms") + 1).alias("end_ms"))
    heard = [c for c in CONDITIONS if c != "beside_tag"]
    c = I.interval_join(spans, conditions.where(F.col("label").isin(heard)).select("job_id", "start_ms", "end_ms", "label"), 10000)
    c = c.groupBy("l.job_id", "l.cue_id").agg(*[F.max((F.col("r.label") == name).cast("int")).alias(name) for name in heard])
    gone = removed.select("job_id", "start_ms", (F.col("start_ms") + 1).alias("end_ms"))
    ends = cues.select("job_id", "cue_id", "start_ms", "end_ms")
    r = I.interval_join(ends, gone, 10000, within_ms=REMOVED_WITHIN_MS + 1)
    r = r.where(F.col("r.start_ms").between(F.col("l.start_ms") - REMOVED_WITHIN_MS, F.col("l.end_ms") + REMOVED_WITHIN_MS)).groupBy("l.job_id", "l.cue_id").agg(F.count("*").alias("removed"))
    by = ["job_id", "cue_id"]
    f = cues.select(*by, "start_ms", "end_ms", "text", _beside_tag().cast("int").alias("beside_tag")).join(w, by, "left").join(c, by, "left").join(r, by, "left")
    f = f.fillna(0, ["n", "doubt", "disputed", "weak", "uncertain", "not_heard", "placed", "placed_ms", "odd", *heard, "removed"])
    return rated(f, mode)


def rated(sums: DataFrame, mode: str = "reference") -> DataFrame:
    """`features` of cues from their sums: n, doubt, disputed, weak, uncertain, not_heard, placed, placed_ms, odd of their words, conditions (each 0 or 1) and removed words."""
    n, unheard = F.greatest(F.lit(1), "n"), F.col("not_heard") if mode == "reference" else F.lit(0)
    return sums.withColumns({
        "text_error": F.col("doubt") / (100 * n), "low_text": F.col("disputed") / n, "disputed_any": (F.col("disputed") > 0).cast("int"),
        "weak_timing": F.col("weak") / n, "weak_timing_any": (F.col("weak") > 0).cast("int"), "interpolated": F.col("placed") / n,
        "unheard": unheard / n, "unheard_any": (unheard > 0).cast("int"), "hallucination": F.least(F.lit(1.0), F.col("removed") / 3), "implausible": F.col("odd") / n,
    })


def _words(n: Column) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, " word").otherwise(" words"))


def reasons(mode: str = "reference") -> Column:
    """What the reviewer is told of a cue with `features`, in a fixed order. Tenths of seconds are rounded half up."""
    tenths = F.floor((F.col("placed_ms") + 50) / 100)
    secs = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"))
    # The wording.
    own = [F.when(F.col("disputed") > 0, F.concat(F.lit("voters disagree on "), _words(F.col("disputed"))))] if mode == "ensemble" else []
    own += [F.when(F.col("not_heard") > 0, F.concat(F.lit("no engine heard "), _words(F.col("not_heard")), F.lit(" (check the transcript)")))] if mode == "reference" else []
    told = [F.when(F.col(name) > 0, text) for name, text in CONDITIONS.items()] + own
    told += [
        F.when(F.col("placed") > 0, F.concat(secs, F.lit(" s interpolated ("), _words(F.col("placed")), F.lit(")"))),
        F.when(F.col("uncertain") > 0, F.concat(F.lit("uncertain timing on "), _words(F.col("uncertain")))),
        F.when(F.col("removed") > 0, F.concat(F.lit("hallucination filter removed "), _words(F.col("removed")), F.lit(" here"))),
        F.when(F.col("odd") > 0, "implausible word durations"),
    ]
    return F.array_compact(F.array(*told))


def scored(featured: DataFrame, mode: str = "reference", weights: dict[str, float] | None = None) -> DataFrame:
    """Cues with `features`, and risk, est_error, tier and reasons. The predicted share of errors says whether mending still beats typing anew, the risk
    whether the cue needs a look. Of a transcript's words one that no engine heard is let pass as a name. weights: as `fitted` gives them, with `bias`."""
    n = F.greatest(F.lit(1), "n")
    est = F.greatest(F.lit(0.0), F.col("unheard") - 1 / n) if mode == "reference" else F.col("text_error") * 1.25 + 0.5 * F.col("unheard")
    out = featured.withColumn("risk", C.risk(FEATURES, weights)).withColumn("est_error", F.least(F.lit(1.0), est)).withColumn("reasons", reasons(mode))
    return out.withColumn("tier", F.when(F.col("est_error") >= C.REDO, "redo").when(F.col("risk") < C.ACCEPT, "accept").otherwise("quick_check"))


def fitted(examples: DataFrame, label: str = "label", l2: float = 0.05) -> DataFrame:
    """(feature, weight), the bias among them: a logistic model of `label` over all features, pulled towards the present weights by l2 a row, so that a few
    corrected jobs move the weights a little. Without rows, the present weights."""
    return B.calibrated(examples, FEATURES, label, [C.WEIGHTS[n] for n in FEATURES], C.BIAS, pull=0.0, pull_each=l2)
