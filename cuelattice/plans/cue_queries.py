"""Queries of cues: grouping, timing, checks, review, subtitle files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelattice.functions import text as T
from cuelattice.operators import cues as C
from cuelattice.plans import fixtures as X
from cuelattice.plans import lists as L
from cuelattice.plans.book import query

_ORDER = "(PARTITION BY job_id ORDER BY start_ms, cue_id)"
_IS_END = """(ends_with(regexp_replace(word, '["''”’»）】]*$', ''), '--') OR (regexp_matches(word, '[.!?…。！？‥]+["''”’»）】]?$') AND NOT (ends_with(regexp_replace(word, '["''”’»）】]*$', ''), '.') AND regexp_replace(lower(regexp_replace(word, '["''”’»）】]*$', '')), '\\.+$', '') IN ({}))))"""


def _abbreviations() -> str:
    from cuelattice.functions.text import ABBREVIATIONS

    return ", ".join(f"'{w}'" for w in ABBREVIATIONS)


_SENT = f"""WITH {X.TOK}, e AS (SELECT *, 'S' || (job_id + idx // 90) % 3 AS speaker, {_IS_END.format(_abbreviations())} AS fin FROM tok), p AS (SELECT *, sum(coalesce(pf OR ps <> speaker, false)::INT) OVER (PARTITION BY job_id ORDER BY idx) AS part FROM (SELECT *, lag(fin) OVER (PARTITION BY job_id ORDER BY idx) AS pf, lag(speaker) OVER (PARTITION BY job_id ORDER BY idx) AS ps FROM e)),
q AS (SELECT *, (row_number() OVER (PARTITION BY job_id, part ORDER BY idx) - 1) // 60 AS cap FROM p), s AS (SELECT *, dense_rank() OVER (PARTITION BY job_id ORDER BY part, cap) - 1 AS sentence FROM q)"""


@query(f"{_SENT} SELECT job_id, sentence, min(idx) AS first, max(idx) AS last, min(start_ms) AS start_ms, max(end_ms) AS end_ms, min(speaker) AS speaker FROM s GROUP BY 1, 2")
def w14_sentences(spark: SparkSession, d: str) -> DataFrame:
    return _sentences(spark, d).groupBy("job_id", "sentence").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.min("speaker").alias("speaker"))


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    """Words with speakers (by turns of 90 words) and sentences."""
    return C.sentences(X.tok(spark, d).withColumn("speaker", F.concat(F.lit("S"), ((F.col("job_id") + F.floor(F.col("idx") / 90)) % 3).cast("string"))), speaker="speaker")


_PARA = f"{_SENT}, t AS (SELECT job_id, sentence, min(start_ms) AS s, max(end_ms) AS e, min(speaker) AS speaker, string_agg(word, ' ' ORDER BY idx) AS text FROM s GROUP BY 1, 2), g AS (SELECT *, sum(coalesce(s - pe > 1750 OR speaker <> ps, false)::INT) OVER (PARTITION BY job_id ORDER BY sentence) AS part FROM (SELECT *, lag(e) OVER (PARTITION BY job_id ORDER BY sentence) AS pe, lag(speaker) OVER (PARTITION BY job_id ORDER BY sentence) AS ps FROM t)), pa AS (SELECT *, (row_number() OVER (PARTITION BY job_id, part ORDER BY sentence) - 1) // 8 AS block FROM g)"


@query(f"{_PARA} SELECT job_id, part, block, sentence FROM pa")
def w15_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs: a pause over 1.75 s or another speaker opens a part, every eighth sentence a block in it."""
    return C.paragraphs(w14_sentences(spark, d)).select("job_id", "part", "block", "sentence")


@query(f"WITH {X.CUE}, r AS (SELECT *, sum(coalesce(pr <> role OR start_ms - pe > 800, false)::INT) OVER (PARTITION BY job_id ORDER BY start_ms, cue_id ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(role) OVER {_ORDER} AS pr, lag(end_ms) OVER {_ORDER} AS pe FROM cue)) SELECT job_id, run, min(role) AS role, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS cues FROM r GROUP BY 1, 2")
def w13_speaker_runs(spark: SparkSession, d: str) -> DataFrame:
    return C.speaker_runs(X.cue(spark, d), "role", 800).groupBy("job_id", "run").agg(F.min("role").alias("role"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("cues"))


@query(f"WITH {X.CUE} SELECT job_id, cue_id, CASE WHEN lag(role) OVER {_ORDER} IS DISTINCT FROM role THEN role || ': ' || text ELSE text END AS text FROM cue")
def s12_speaker_prefix(spark: SparkSession, d: str) -> DataFrame:
    same = F.lag("role").over(W.partitionBy("job_id").orderBy("start_ms", "cue_id")).eqNullSafe(F.col("role"))
    return X.cue(spark, d).select("job_id", "cue_id", F.when(same, F.col("text")).otherwise(F.concat("role", F.lit(": "), "text")).alias("text"))


_FIX = "greatest(start_ms, least(end_ms, coalesce(lead(start_ms) OVER (PARTITION BY job_id ORDER BY start_ms, cue_id) - 1, end_ms)))"


@query(f"WITH {X.CUE} SELECT job_id, cue_id, start_ms, {_FIX} AS end_ms FROM cue")
def w31_overlap_resolution(spark: SparkSession, d: str) -> DataFrame:
    return C.without_overlap(X.cue(spark, d)).select("job_id", "cue_id", "start_ms", "end_ms")


@query(f"""WITH {X.CUE}, f AS (SELECT job_id, cue_id, start_ms, {_FIX} AS end_ms, lead(start_ms) OVER {_ORDER} AS nx FROM cue)
SELECT job_id, cue_id, start_ms, greatest(end_ms, least(start_ms + 7000, CASE WHEN nx - end_ms > 0 AND nx - end_ms <= 1000 THEN nx - 1 ELSE least(end_ms + 250, CASE WHEN nx IS NOT NULL THEN greatest(end_ms, nx - 1) END) END)) AS end_ms FROM f""")
def w32_chained_cues(spark: SparkSession, d: str) -> DataFrame:
    return C.chained(C.without_overlap(X.cue(spark, d))).select("job_id", "cue_id", "start_ms", "end_ms")


_RULES = "list_filter([CASE WHEN list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) > 42 THEN 'long_line' END, CASE WHEN len(string_split(text, chr(10))) > 2 THEN 'many_lines' END, CASE WHEN end_ms - start_ms > 7000 THEN 'long_cue' END, CASE WHEN end_ms - start_ms < 700 THEN 'short_cue' END, CASE WHEN length(replace(text, chr(10), '')) * 1000 > 20 * (end_ms - start_ms) THEN 'fast' END, CASE WHEN nx < end_ms THEN 'overlap' END, CASE WHEN nx - end_ms > 5000 THEN 'gap' END], lambda x: x IS NOT NULL)"
_OFF = f"WITH {X.CUE}, o AS (SELECT *, unnest({_RULES}) AS rule FROM (SELECT *, lead(start_ms) OVER {_ORDER} AS nx FROM cue))"


@query(f"{_OFF} SELECT job_id, rule, count(*) AS n FROM o GROUP BY 1, 2")
def a26_rule_counts(spark: SparkSession, d: str) -> DataFrame:
    return C.offences(X.cue(spark, d)).groupBy("job_id", "rule").agg(F.count("*").alias("n"))


@query(f"{_OFF} SELECT rule, count(*) AS n, count(DISTINCT job_id) AS jobs FROM o GROUP BY 1")
def a27_validator_counts(spark: SparkSession, d: str) -> DataFrame:
    return C.offences(X.cue(spark, d)).groupBy("rule").agg(F.count("*").alias("n"), F.count_distinct("job_id").alias("jobs"))


@query(f"{_OFF} SELECT job_id, rule, cue_id FROM (SELECT *, row_number() OVER (PARTITION BY job_id, rule ORDER BY cue_id) AS rn FROM o) WHERE rn <= 2")
def o04_first_offenders(spark: SparkSession, d: str) -> DataFrame:
    rn = F.row_number().over(W.partitionBy("job_id", "rule").orderBy("cue_id"))
    return C.offences(X.cue(spark, d)).withColumn("rn", rn).where("rn <= 2").select("job_id", "rule", "cue_id")


@query(f"WITH {X.CUE}, s AS (SELECT job_id, length(replace(text, chr(10), '')) * 1000 // (end_ms - start_ms) AS cps FROM cue) SELECT job_id, list_sort(list(cps))[count(*) // 2 + 1] AS median, max(cps) AS most, count(CASE WHEN cps > 20 THEN 1 END) AS over_20, count(CASE WHEN cps > 24 THEN 1 END) AS over_most, count(*) AS n FROM s GROUP BY 1")
def a25_reading_speed(spark: SparkSession, d: str) -> DataFrame:
    """Characters a second; of an even number of cues the upper median."""
    cps = F.floor(F.length(F.replace("text", F.lit("\n"), F.lit(""))) * 1000 / (F.col("end_ms") - F.col("start_ms")))
    g = X.cue(spark, d).select("job_id", cps.alias("cps")).groupBy("job_id")
    return g.agg(F.get(F.sort_array(F.collect_list("cps")), F.floor(F.count("*") / 2).cast("int")).alias("median"), F.max("cps").alias("most"), F.count(F.when(F.col("cps") > 20, 1)).alias("over_20"), F.count(F.when(F.col("cps") > 24, 1)).alias("over_most"), F.count("*").alias("n"))


_GRAMS = " ".join(f"WHEN {n} THEN norm || " + " || ".join(f"chr(10) || l{k}" for k in range(1, n)) for n in range(3, 9))


@query(f"""WITH {X.TOK}, w AS (SELECT job_id, idx, start_ms, norm, {', '.join(f'lead(norm, {k}) OVER v AS l{k}' for k in range(1, 8))} FROM tok WINDOW v AS (PARTITION BY job_id ORDER BY idx)), g AS (SELECT job_id, idx, start_ms, n, CASE n {_GRAMS} END AS gram FROM w, range(3, 9) r(n)),
l AS (SELECT *, lag(idx) OVER v AS first, start_ms - lag(start_ms) OVER v AS gone FROM g WHERE gram IS NOT NULL WINDOW v AS (PARTITION BY job_id, n, gram ORDER BY idx)) SELECT job_id, n::INT AS n, first, idx AS again FROM l WHERE gone <= 30000 QUALIFY row_number() OVER (PARTITION BY job_id, n, gram ORDER BY idx) = 1""")
def w20_ngram_repetition(spark: SparkSession, d: str) -> DataFrame:
    return L.repeats(spark, d)


@query(f"WITH {X.TOK}, s AS (SELECT *, coalesce(norm = lag(norm) OVER (PARTITION BY job_id ORDER BY idx), false) AS same FROM tok), r AS (SELECT *, idx - row_number() OVER (PARTITION BY job_id, same ORDER BY idx) AS g FROM s) SELECT job_id, min(idx) - 1 AS first, count(*) + 1 AS repeats FROM r WHERE same GROUP BY job_id, g")
def w17_repeat_loops(spark: SparkSession, d: str) -> DataFrame:
    return C.loops(X.tok(spark, d), 1)


@query(f"WITH {X.HEARD}, n AS (SELECT *, lead(start_ms) OVER (PARTITION BY job_id, engine ORDER BY pos) AS nx FROM (SELECT * REPLACE (CASE WHEN conf % 50 = 0 THEN start_ms + 60 ELSE end_ms END AS end_ms) FROM heard)) SELECT job_id, engine, pos, end_ms - start_ms < 100 AND length(word) > 2 AS short, coalesce(end_ms - nx > 50, false) AS overlapping FROM n WHERE (end_ms - start_ms < 100 AND length(word) > 2) OR end_ms - nx > 50")
def w21_timing_anomalies(spark: SparkSession, d: str) -> DataFrame:
    """Words under 100 ms of more than two letters, and those that overlap the next by more than 50 ms. Some words are cut short here."""
    h = X.heard(spark, d).withColumn("end_ms", F.when(F.col("conf") % 50 == 0, F.col("start_ms") + 60).otherwise(F.col("end_ms")))
    nx = F.lead("start_ms").over(W.partitionBy("job_id", "engine").orderBy("pos"))
    short = (F.col("end_ms") - F.col("start_ms") < 100) & (F.length("word") > 2)
    return h.select("job_id", "engine", "pos", short.alias("short"), F.coalesce(F.col("end_ms") - nx > 50, F.lit(False)).alias("overlapping")).where("short OR overlapping")


_FEATS = ["text_error", "low_text", "disputed_any", "weak_timing", "unheard", "unheard_any"]
_REVIEW = f"""WITH {X.TOK}, w AS (SELECT job_id, chunk_id, start_ms, end_ms, ((job_id * 3 + idx * 5) % 100) AS tc, ((job_id + idx * 7) % 100) AS mc, (job_id + idx) % 37 = 0 AS unheard FROM tok),
f AS (SELECT job_id, chunk_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n, sum(100 - tc) / (100.0::DOUBLE * count(*)) AS text_error, sum((tc < 60)::INT) / count(*)::DOUBLE AS low_text, max((tc < 60)::INT) AS disputed_any, sum((mc < 50)::INT) / count(*)::DOUBLE AS weak_timing, sum(unheard::INT) / count(*)::DOUBLE AS unheard, max(unheard::INT) AS unheard_any FROM w GROUP BY 1, 2),
z AS (SELECT *, 1 / (1 + exp(-greatest(-30, least(30, {C.BIAS} + {' + '.join(f'{C.WEIGHTS[k]} * {k}' for k in _FEATS)})))) AS risk, greatest(0, unheard - 1 / n) AS est FROM f),
t AS (SELECT *, CASE WHEN est >= {C.REDO} THEN 'redo' WHEN risk < {C.ACCEPT} THEN 'accept' ELSE 'quick_check' END AS tier FROM z)"""


def _review(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as cues with features, risk and tier, from derived confidences in per cent."""
    w = L.tok(spark, d, "job_id", "chunk_id", "idx", "start_ms", "end_ms").select("job_id", "chunk_id", "start_ms", "end_ms", ((F.col("job_id") * 3 + F.col("idx") * 5) % 100).alias("tc"), ((F.col("job_id") + F.col("idx") * 7) % 100).alias("mc"), ((F.col("job_id") + F.col("idx")) % 37 == 0).cast("int").alias("gone"))
    low, n = (F.col("tc") < 60).cast("int"), F.count("*")
    f = w.groupBy("job_id", "chunk_id").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), n.alias("n"), (F.sum(100 - F.col("tc")) / (100.0 * n)).alias("text_error"), (F.sum(low) / n).alias("low_text"), F.max(low).alias("disputed_any"), (F.sum((F.col("mc") < 50).cast("int")) / n).alias("weak_timing"), (F.sum("gone") / n).alias("unheard"), F.max("gone").alias("unheard_any"))
    f = f.withColumn("risk", C.risk(_FEATS)).withColumn("est", F.greatest(F.lit(0.0), F.col("unheard") - 1 / F.col("n")))
    return f.withColumn("tier", F.when(F.col("est") >= C.REDO, "redo").when(F.col("risk") < C.ACCEPT, "accept").otherwise("quick_check"))


@query(f"{_REVIEW} SELECT job_id, chunk_id, n, round(text_error, 6) AS text_error, round(low_text, 6) AS low_text, disputed_any, round(weak_timing, 6) AS weak_timing, unheard_any FROM t")
def a22_cue_features(spark: SparkSession, d: str) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)
    return _review(spark, d).select("job_id", "chunk_id", "n", r("text_error"), r("low_text"), "disputed_any", r("weak_timing"), "unheard_any")


@query(f"{_REVIEW} SELECT job_id, chunk_id, round(risk, 6) AS risk, tier FROM t")
def w45_risk_tiers(spark: SparkSession, d: str) -> DataFrame:
    return _review(spark, d).select("job_id", "chunk_id", F.round("risk", 6).alias("risk"), "tier")


_TIERS = ("accept", "quick_check", "redo")


@query(f"""{_REVIEW} SELECT job_id, {', '.join(f"count(CASE WHEN tier = '{t}' THEN 1 END) AS {t}, coalesce(sum(CASE WHEN tier = '{t}' THEN end_ms - start_ms END), 0)::BIGINT AS {t}_ms" for t in _TIERS)}, count(*) AS cues, (sum(CASE WHEN tier <> 'accept' THEN end_ms - start_ms ELSE 0 END) * 1000 // greatest(1, sum(end_ms - start_ms)))::BIGINT AS to_review FROM t GROUP BY 1""")
def a23_review_summary(spark: SparkSession, d: str) -> DataFrame:
    """Cues and time per tier, and the share of time to review, per mille."""
    ms, own = F.col("end_ms") - F.col("start_ms"), lambda t: F.col("tier") == t
    tiers = [c for t in _TIERS for c in (F.count(F.when(own(t), 1)).alias(t), F.coalesce(F.sum(F.when(own(t), ms)), F.lit(0)).alias(f"{t}_ms"))]
    to_review = F.floor(F.sum(F.when(own("accept"), 0).otherwise(ms)) * 1000 / F.greatest(F.lit(1), F.sum(ms)))
    return _review(spark, d).groupBy("job_id").agg(*tiers, F.count("*").alias("cues"), to_review.alias("to_review"))


@query(f"{_REVIEW} SELECT job_id, chunk_id, place FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY round(risk, 9) DESC, start_ms) AS place FROM t WHERE tier <> 'accept') WHERE place <= 5")
def o01_review_queue(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(W.partitionBy("job_id").orderBy(F.round("risk", 9).desc(), "start_ms"))
    return _review(spark, d).where("tier <> 'accept'").withColumn("place", place.cast("long")).where("place <= 5").select("job_id", "chunk_id", "place")


_TC = lambda c: f"lpad(({c} // 3600000)::VARCHAR, 2, '0') || ':' || lpad(({c} // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad(({c} // 1000 % 60)::VARCHAR, 2, '0') || ',' || lpad(({c} % 1000)::VARCHAR, 3, '0')"
_POS = X.CUE + ", pc AS (SELECT job_id, cue_id, role, text, greatest(0, start_ms) AS start_ms, greatest(0, end_ms) AS end_ms FROM cue)"


def _positive(spark: SparkSession, d: str) -> DataFrame:
    return X.cue(spark, d).withColumns({"start_ms": F.greatest(F.lit(0), "start_ms"), "end_ms": F.greatest(F.lit(0), "end_ms")})


@query(f"WITH {_POS}, n AS (SELECT *, row_number() OVER {_ORDER} AS n FROM pc) SELECT job_id, string_agg(n || chr(10) || {_TC('start_ms')} || ' --> ' || {_TC('end_ms')} || chr(10) || text || chr(10), chr(10) ORDER BY n) AS srt FROM n GROUP BY 1")
def s11_srt_sink(spark: SparkSession, d: str) -> DataFrame:
    return C.srt(_positive(spark, d))


@query(f"WITH {_POS} SELECT job_id, (row_number() OVER {_ORDER})::INT AS n, start_ms, end_ms, trim(text, chr(10)) AS text FROM pc")
def s04_srt_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """What the sink writes, the reader reads."""
    return C.from_srt(C.srt(_positive(spark, d))).withColumn("text", F.btrim("text", F.lit("\n")))


_ESC = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(f"""WITH {_POS}, v AS (SELECT *, row_number() OVER {_ORDER} AS n, list_filter(list_transform(string_split({_ESC.format('text')}, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM pc)
SELECT job_id, 'WEBVTT' || chr(10) || chr(10) || string_agg(n || chr(10) || replace({_TC('start_ms')}, ',', '.') || ' --> ' || replace({_TC('end_ms')}, ',', '.') || chr(10) || CASE WHEN len(ls) > 0 AND role <> '' THEN '<v ' || {_ESC.format('role')} || '>' ELSE '' END || array_to_string(ls, chr(10)) || CASE WHEN len(ls) > 0 THEN chr(10) ELSE '' END, chr(10) ORDER BY n) AS vtt FROM v GROUP BY 1""")
def s13_vtt_sink(spark: SparkSession, d: str) -> DataFrame:
    return C.vtt(_positive(spark, d), "role")


@query(f"WITH {X.CUE}, k AS (SELECT job_id, cue_id, len(regexp_extract_all(regexp_replace(text, '\\[[^\\]]*\\]', ' ', 'g'), '[^ \\n\\t\\r]+')) AS n FROM cue) SELECT job_id, cue_id, (sum(n) OVER (PARTITION BY job_id ORDER BY cue_id) - n)::BIGINT AS first, sum(n) OVER (PARTITION BY job_id ORDER BY cue_id)::BIGINT AS until FROM k")
def s05_cue_word_ranges(spark: SparkSession, d: str) -> DataFrame:
    from cuelattice.functions.text import TAG, tokens

    n = F.size(tokens(F.regexp_replace("text", TAG, " ")))
    until = F.sum(n).over(W.partitionBy("job_id").orderBy("cue_id"))
    return X.cue(spark, d).select("job_id", "cue_id", (until - n).alias("first"), until.alias("until"))


@query(f"WITH {X.CUE} SELECT job_id, cue_id, start_ms + (end_ms - start_ms) * (i - 1) // n AS start_ms, w AS word FROM (SELECT *, len(ws) AS n, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w FROM (SELECT *, regexp_extract_all(text, '[^ \\n\\t\\r]+') AS ws FROM cue))")
def s06_even_word_times(spark: SparkSession, d: str) -> DataFrame:
    from cuelattice.functions.text import tokens

    c = X.cue(spark, d).withColumn("ws", tokens(F.col("text"))).select("job_id", "cue_id", "start_ms", "end_ms", F.size("ws").alias("n"), F.posexplode("ws").alias("i", "word"))
    return c.select("job_id", "cue_id", (F.col("start_ms") + F.floor((F.col("end_ms") - F.col("start_ms")) * F.col("i") / F.col("n"))).alias("start_ms"), "word")


@query(f"WITH {X.CUE}, e AS (SELECT job_id, cue_id, cue_id % 3 AS kind FROM cue WHERE (job_id + cue_id) % 2 = 0), a AS (SELECT c.job_id, c.cue_id, c.start_ms, CASE kind WHEN 0 THEN upper(substr(text, 1, 3)) WHEN 1 THEN '' ELSE text END AS text FROM cue c LEFT JOIN e USING (job_id, cue_id)) SELECT job_id, cue_id, text, row_number() OVER (PARTITION BY job_id ORDER BY start_ms, cue_id) AS place FROM a WHERE text <> ''")
def j19_edits_applied(spark: SparkSession, d: str) -> DataFrame:
    """Edits on cues: new text where there is one, emptied cues go, the rest is numbered anew."""
    c = X.cue(spark, d)
    edits = c.where((F.col("job_id") + F.col("cue_id")) % 2 == 0).select("job_id", "cue_id", (F.col("cue_id") % 3).alias("kind"))
    new = F.when(F.col("kind") == 0, T.upper(F.substring("text", 1, 3))).when(F.col("kind") == 1, "").otherwise(F.col("text"))
    a = c.join(edits, ["job_id", "cue_id"], "left").select("job_id", "cue_id", "start_ms", new.alias("text")).where("text <> ''")
    return a.select("job_id", "cue_id", "text", F.row_number().over(W.partitionBy("job_id").orderBy("start_ms", "cue_id")).cast("long").alias("place"))


_SOUND = rf"len(list_filter(regexp_extract_all({{}}, '\[[^\]]+\]'), lambda x: NOT regexp_matches(lower(x), '{T.NO_SOUND.replace('{', '{{').replace('}', '}}')}'))) > 0"


@query(f"WITH {X.CUE} SELECT job_id, cue_id, coalesce({_SOUND.format('lag(text) OVER w')}, false) OR {_SOUND.format('text')} OR coalesce({_SOUND.format('lead(text) OVER w')}, false) AS beside_tag FROM cue WINDOW w AS {_ORDER}")
def j22_beside_tag(spark: SparkSession, d: str) -> DataFrame:
    """Is there a sound tag in the cue or next to it?"""
    w = W.partitionBy("job_id").orderBy("start_ms", "cue_id")
    has = F.size(F.filter(F.regexp_extract_all("text", F.lit(r"\[[^\]]+\]"), F.lit(0)), T.sound_tag)) > 0
    c = X.cue(spark, d).withColumn("has", has)
    near = lambda c: F.coalesce(c, F.lit(False))
    return c.select("job_id", "cue_id", (near(F.lag("has").over(w)) | F.col("has") | near(F.lead("has").over(w))).alias("beside_tag"))


@query("SELECT user_id, event_type, max_by(event_id, (ts, event_id)) AS last, epoch_us(max(ts)) - epoch_us(min(ts)) AS span_us, count(*) AS n FROM events GROUP BY 1, 2")
def t02_stage_progress(spark: SparkSession, d: str) -> DataFrame:
    """Last event of each stage of a job, and the time since its first one; the batch twin of the streaming job."""
    e = X.read(spark, d, "events").withColumn("us", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"))
    return e.groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("last"), (F.max("us") - F.min("us")).alias("span_us"), F.count("*").alias("n"))


@query("SELECT user_id, max_by(event_type, (ts, event_id)) AS state, count(*) AS n FROM events GROUP BY 1")
def t02_latest_state(spark: SparkSession, d: str) -> DataFrame:
    """Last state per job of the event log; the batch twin of the streaming job."""
    return X.read(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.count("*").alias("n"))
