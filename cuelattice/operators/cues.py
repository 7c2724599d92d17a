"""Caption cues: grouping of words, timing of cues, checks, review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelattice.functions import text as T


def running(flag: Column, w: W) -> Column:
    """Group number from a flag that opens a group."""
    return F.sum(flag.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))


def sentences(words: DataFrame, most: int = 60, speaker: str | None = None) -> DataFrame:
    """words (job_id, idx, word, ...) with `sentence`: closed by terminal punctuation, after `most` words or, if both are known, where
    another speaker begins."""
    w = W.partitionBy("job_id").orderBy("idx")
    close = F.lag(T.sentence_end(F.col("word"))).over(w)
    if speaker:
        close = close | F.coalesce(F.lag(speaker).over(w) != F.col(speaker), F.lit(False))
    s = words.withColumn("part_", running(F.coalesce(close, F.lit(False)), w))
    n = F.row_number().over(W.partitionBy("job_id", "part_").orderBy("idx"))
    s = s.withColumn("cap_", F.floor((n - 1) / most))
    return s.withColumn("sentence", F.dense_rank().over(W.partitionBy("job_id").orderBy("part_", "cap_")) - 1).drop("part_", "cap_")


def paragraphs(spoken: DataFrame, pause_ms: int = 1750, most: int = 8) -> DataFrame:
    """Sentences (job_id, sentence, start_ms, end_ms, speaker) with `part`, opened by a longer pause or another speaker, and `block`, every `most` sentences
    of a part: a paragraph is a block."""
    w = W.partitionBy("job_id").orderBy("sentence")
    new = (F.col("start_ms") - F.lag("end_ms").over(w) > pause_ms) | (F.col("speaker").isNotNull() & ~F.lag("speaker").over(w).eqNullSafe(F.col("speaker")) & F.lag("sentence").over(w).isNotNull())
    g = spoken.withColumn("part", running(F.coalesce(new, F.lit(False)), w))
    return g.withColumn("block", F.floor((F.row_number().over(W.partitionBy("job_id", "part").orderBy("sentence")) - 1) / most))


def speaker_runs(cues: DataFrame, speaker: str, gap_ms: int) -> DataFrame:
    """cues with `run`: a new one at another speaker (none is one, too) or after a pause longer than gap_ms."""
    w = W.partitionBy("job_id").orderBy("start_ms", "cue_id")
    other = F.lag("cue_id").over(w).isNotNull() & ~F.lag(speaker).over(w).eqNullSafe(F.col(speaker))
    return cues.withColumn("run", running(other | F.coalesce(F.col("start_ms") - F.lag("end_ms").over(w) > gap_ms, F.lit(False)), w))


def without_overlap(cues: DataFrame, gap_ms: int = 1) -> DataFrame:
    """An earlier cue ends gap_ms before the next one starts, but not before its own start."""
    after = F.lead("start_ms").over(W.partitionBy("job_id").orderBy("start_ms", "cue_id"))
    return cues.withColumn("end_ms", F.greatest(F.col("start_ms"), F.least(F.col("end_ms"), F.coalesce(after - gap_ms, F.col("end_ms")))))


def chained(cues: DataFrame, bridge_ms: int = 1000, linger_ms: int = 250, most_ms: int = 7000) -> DataFrame:
    """Short pauses are bridged to the next cue; else a cue lingers; none lasts longer than most_ms."""
    after = F.lead("start_ms").over(W.partitionBy("job_id").orderBy("start_ms", "cue_id"))
    pause = after - F.col("end_ms")
    end = F.when((pause > 0) & (pause <= bridge_ms), after - 1).otherwise(F.least(F.col("end_ms") + linger_ms, F.when(after.isNotNull(), F.greatest(F.col("end_ms"), after - 1))))
    return cues.withColumn("end_ms", F.greatest(F.col("end_ms"), F.least(end, F.col("start_ms") + most_ms)))


def dash_joined(cues: DataFrame, cpl: int = 42, gap_ms: int = 300, most_ms: int = 7000, style: str = "-") -> DataFrame:
    """cues (job_id, cue_id, start_ms, end_ms, text, speaker) with quick exchanges joined, and `dash`: two neighbours by different speakers, at most gap_ms apart, become one cue of
    a line each if both lines and the whole fit. From the first on no cue is joined twice: of neighbours that could all be joined, the first with the second, the third with the
    fourth, and so on, which their place in the run tells without a loop."""
    w = W.partitionBy("job_id").orderBy("start_ms", "cue_id")
    flat = F.array_join(T.tokens(F.col("text")), " ")
    c = cues.withColumn("line", F.concat(F.lit(style), flat))
    c = c.withColumn("b", F.lead(F.struct("start_ms", "end_ms", "line", "speaker")).over(w))
    end = F.greatest("end_ms", "b.end_ms")
    joins = (F.col("speaker") != F.col("b.speaker")) & (F.col("b.start_ms") - F.col("end_ms") <= gap_ms) & (F.length("line") <= cpl) & (F.length("b.line") <= cpl) & (end - F.col("start_ms") <= most_ms)
    c = c.withColumn("joins", F.coalesce(joins, F.lit(False)))
    c = c.withColumn("run", F.coalesce(F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    c = c.withColumn("dash", F.col("joins") & (F.row_number().over(W.partitionBy("job_id", "run").orderBy("start_ms", "cue_id")) % 2 == 1))
    c = c.withColumn("gone", F.coalesce(F.lag("dash").over(w), F.lit(False))).where("NOT gone")
    pick = lambda a, b: F.when(F.col("dash"), a).otherwise(b)
    return c.select("job_id", "cue_id", "start_ms", pick(F.greatest("end_ms", "b.end_ms"), F.col("end_ms")).alias("end_ms"), pick(F.concat("line", F.lit("\n"), "b.line"), F.col("text")).alias("text"), pick(F.concat("speaker", F.lit(" / "), "b.speaker"), F.col("speaker")).alias("speaker"), "dash")


def offences(cues: DataFrame, cpl: int = 42, lines: int = 2, most_ms: int = 7000, least_ms: int = 700, cps: int = 20) -> DataFrame:
    """One row per cue and layout or timing rule that it breaks."""
    after = F.lead("start_ms").over(W.partitionBy("job_id").orderBy("start_ms", "cue_id"))
    cues = cues.withColumn("next_", after)
    after, ms, text = F.col("next_"), F.col("end_ms") - F.col("start_ms"), F.col("text")
    rules = F.array(
        F.when(T.longest_line(text) > cpl, "long_line"), F.when(F.size(F.split(text, "\n")) > lines, "many_lines"), F.when(ms > most_ms, "long_cue"), F.when(ms < least_ms, "short_cue"),
        F.when(T.visible_chars(text) * 1000 > cps * ms, "fast"), F.when(after < F.col("end_ms"), "overlap"), F.when(after - F.col("end_ms") > 5000, "gap"),
    )
    return cues.withColumn("rule", F.explode(F.filter(rules, lambda r: r.isNotNull()))).drop("next_")


def repeats(words: DataFrame, least: int = 3, most: int = 8, within_ms: int = 30000) -> DataFrame:
    """The first time that each n-gram of least to most words comes again within the time: (job_id, n, first, again), positions of both. Grams meet by
    their 64-bit hashes."""
    w = W.partitionBy("job_id").orderBy("idx")
    ahead = [F.lead("norm", k).over(w) if k else F.col("norm") for k in range(most)]
    grams = F.filter(F.array(*[F.when(ahead[n - 1].isNotNull(), F.struct(F.lit(n).alias("n"), F.xxhash64(F.lit(n), *ahead[:n]).alias("gram"))) for n in range(least, most + 1)]), lambda g: g.isNotNull())
    g = words.select("job_id", "idx", "start_ms", grams.alias("grams")).select("job_id", "idx", "start_ms", F.explode("grams").alias("g")).select("job_id", "idx", "start_ms", "g.n", "g.gram")
    v = W.partitionBy("job_id", "n", "gram").orderBy("idx")
    again = g.withColumn("first", F.lag("idx").over(v)).withColumn("gone", F.col("start_ms") - F.lag("start_ms").over(v)).where(F.col("gone") <= within_ms)
    found = again.groupBy("job_id", "n", "gram").agg(F.min(F.struct(F.col("idx").alias("again"), "first")).alias("m"))
    return found.select("job_id", "n", "m.first", "m.again")


def loops(words: DataFrame, n: int) -> DataFrame:
    """Runs of an n-gram back to back: (job_id, first, repeats)."""
    w = W.partitionBy("job_id").orderBy("idx")
    same = words.withColumn("same", F.coalesce(F.col("norm") == F.lag("norm", n).over(w), F.lit(False)))
    run = same.withColumn("g", F.col("idx") - F.row_number().over(W.partitionBy("job_id", "same").orderBy("idx"))).where("same")
    return run.groupBy("job_id", "g").agg((F.min("idx") - n).alias("first"), (F.floor(F.count("*") / n) + 1).alias("repeats")).drop("g").where("repeats > 1")


#: Bias and weights of the logistic triage risk, and the tiers' borders.
BIAS, ACCEPT, REDO = -3.2, 0.25, 0.30
WEIGHTS = {"text_error": 6.0, "low_text": 2.0, "disputed_any": 2.6, "weak_timing": 2.2, "weak_timing_any": 1.5, "interpolated": 3.0, "unheard": 2.5, "unheard_any": 2.4, "overlap": 1.4, "music": 0.7, "crowd": 0.7, "very_low_snr": 1.1, "low_snr": 0.45, "noise": 0.3, "narrowband": 0.5, "clipping": 0.4, "hallucination": 0.8, "implausible": 0.8, "beside_tag": 1.8}


def risk(features: list[str], weights: dict[str, float] | None = None) -> Column:
    known = {"bias": BIAS} | WEIGHTS | (weights or {})
    z = F.lit(known["bias"])
    for name in features:
        z = z + F.lit(known[name]) * F.col(name)
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def srt(cues: DataFrame) -> DataFrame:
    """(job_id, srt): each job's cues as SubRip text, in order."""
    n = F.row_number().over(W.partitionBy("job_id").orderBy("start_ms", "cue_id"))
    block = F.concat(n.cast("string"), F.lit("\n"), T.timecode(F.col("start_ms")), F.lit(" --> "), T.timecode(F.col("end_ms")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    rows = cues.select("job_id", n.alias("n"), block.alias("block"))
    return rows.groupBy("job_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "block"))), lambda x: x["block"]), "\n").alias("srt"))


def from_srt(files: DataFrame) -> DataFrame:
    """(job_id, n, start_ms, end_ms, text) of SubRip texts (job_id, srt)."""
    blocks = files.select("job_id", F.explode(F.split("srt", r"\n\n(?=[0-9]+\n[0-9:]+,[0-9]{3} --> )")).alias("b"))
    part = lambda k: F.regexp_extract("b", r"(?s)^([0-9]+)\n([0-9:,]+) --> ([0-9:,]+)\n(.*?)\n*$", k)
    return blocks.select("job_id", part(1).cast("int").alias("n"), T.to_ms(part(2)).alias("start_ms"), T.to_ms(part(3)).alias("end_ms"), part(4).alias("text"))


def vtt(cues: DataFrame, speaker: str) -> DataFrame:
    """(job_id, vtt): WebVTT text. Cues are numbered; text and speaker are escaped, lines stripped, blank ones dropped; the first line of a cue with text
    names the speaker, if there is one."""
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.filter(F.transform(F.split(escaped(F.coalesce("text", F.lit(""))), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    voice = F.when((F.size(lines) > 0) & (F.col(speaker) != ""), F.concat(F.lit("<v "), escaped(F.col(speaker)), F.lit(">")))
    body = F.concat(F.coalesce(voice, F.lit("")), F.array_join(lines, "\n"), F.when(F.size(lines) > 0, "\n").otherwise(""))
    n = F.row_number().over(W.partitionBy("job_id").orderBy("start_ms", "cue_id"))
    block = F.concat(n.cast("string"), F.lit("\n"), T.timecode(F.col("start_ms"), "."), F.lit(" --> "), T.timecode(F.col("end_ms"), "."), F.lit("\n"), body)
    rows = cues.select("job_id", F.struct(n.alias("n"), block.alias("b")).alias("r"))
    return rows.groupBy("job_id").agg(F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda x: x["b"]), "\n")).alias("vtt"))


def wrapped(text: Column, cpl: int) -> Column:
    """Words in lines of at most cpl characters, greedily; a longer word has its own line."""
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("line"))

    def add(a: Column, w: Column) -> Column:
        fits = (a["line"] == "") | (F.length(a["line"]) + 1 + F.length(w) <= cpl)
        line = F.when(a["line"] == "", w).when(fits, F.concat(a["line"], F.lit(" "), w)).otherwise(w)
        return F.struct(F.when(fits, a["done"]).otherwise(F.concat(a["done"], a["line"], F.lit("\n"))).alias("done"), line.alias("line"))

    return F.aggregate(T.tokens(text), start, add, lambda a: F.concat(a["done"], a["line"]))


def grown(cues: DataFrame, least_ms: int = 700, cps: int = 20) -> DataFrame:
    """Cues too short to be read grow into the free time before the next one."""
    after = F.lead("start_ms").over(W.partitionBy("job_id").orderBy("start_ms", "cue_id"))
    want = F.col("start_ms") + F.greatest(F.lit(least_ms), F.floor(T.visible_chars(F.col("text")) * 1000 / cps) + 1)
    return cues.withColumn("end_ms", F.greatest(F.col("end_ms"), F.least(want, F.coalesce(after - 1, want))))


# Head of a SubStation file.
ASS_HEAD = """[Script Info]
Title: {title}
ScriptType: v4.00+
WrapStyle: 2
ScaledBorderAndShadow: yes
PlayResX: 1920
PlayResY: 1080

[V4+ Styles]
Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding
Style: Default,Arial,59,&H00FFFFFF,&H000000FF,&H00000000,&H80000000,0,0,0,0,100,100,0,0,1,3,1,2,60,60,49,1

[Events]
Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text
"""


def ass_events(cues: DataFrame, speaker: str) -> DataFrame:
    """(job_id, events): SubStation event lines in order; centiseconds are cut off, braces escaped, blank lines dropped."""
    two = lambda x: F.lpad(x.cast("string"), 2, "0")

    def at(name: str) -> Column:
        part = lambda size: F.floor(F.col(name) / size)
        return F.concat(part(3600000).cast("string"), F.lit(":"), two(part(60000) % 60), F.lit(":"), two(part(1000) % 60), F.lit("."), two(part(10) % 100))

    safe = F.replace(F.replace("text", F.lit("{"), F.lit("\\{")), F.lit("}"), F.lit("\\}"))
    safe = F.array_join(F.transform(F.filter(F.split(safe, "\n"), lambda x: F.trim(x) != ""), lambda x: F.trim(x)), "\\N")
    who = F.replace(F.coalesce(speaker, F.lit("")), F.lit(","), F.lit(" "))
    line = F.concat(F.lit("Dialogue: 0,"), at("start_ms"), F.lit(","), at("end_ms"), F.lit(",Default,"), who, F.lit(",0,0,0,,"), safe)
    rows = cues.select("job_id", F.struct("start_ms", "cue_id", line.alias("line")).alias("r"))
    return rows.groupBy("job_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda x: x["line"]), "\n").alias("events"))


def ass(cues: DataFrame, speaker: str, title: str) -> DataFrame:
    """(job_id, ass): whole SubStation files."""
    return ass_events(cues, speaker).select("job_id", F.concat(F.lit(ASS_HEAD.format(title=title)), "events", F.lit("\n")).alias("ass"))


def joined_runs(cues: DataFrame, speaker: str) -> DataFrame:
    """One row per `run` (see speaker_runs): speaker, start_ms (not below 0), text in order."""
    rows = F.sort_array(F.collect_list(F.struct("start_ms", "cue_id", F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")).alias("t"))))
    g = cues.groupBy("job_id", "run").agg(F.min(speaker).alias(speaker), F.greatest(F.lit(0), F.min("start_ms")).alias("start_ms"), rows.alias("rows"))
    return g.select("job_id", "run", speaker, "start_ms", F.array_join(F.transform("rows", lambda x: x["t"]), " ").alias("text"))


def transcript(cues: DataFrame, speaker: str) -> DataFrame:
    """(job_id, txt): a paragraph per run with its time and speaker."""
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    s = F.floor(F.col("start_ms") / 1000)
    line = F.concat(F.lit("["), two(F.floor(s / 3600)), F.lit(":"), two(F.floor(s / 60) % 60), F.lit(":"), two(s % 60), F.lit("] "), F.coalesce(F.concat(speaker, F.lit(": ")), F.lit("")), F.coalesce("text", F.lit("")))
    p = joined_runs(cues, speaker).select("job_id", F.struct("run", line.alias("line")).alias("r"))
    return p.groupBy("job_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda x: x["line"]), "\n\n").alias("txt"))
