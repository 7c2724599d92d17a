"""Queries of the text layer: P01-P21 over words, cue texts and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelattice.functions import text as T
from cuelattice.plans import fixtures as X
from cuelattice.plans import lists as L
from cuelattice.plans.book import query

_list = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)
#: Some lines with tags, made from the turns, for the tag predicates.
_TAGGED = "t AS (SELECT job_id, cue_id, CASE cue_id % 4 WHEN 0 THEN text WHEN 1 THEN '[applause] [00:01:02] ' || text WHEN 2 THEN '[loud noise]' ELSE text || ' [?] [END OF AUDIO]' END AS text FROM cue)"


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("cue_id") % 4
    text = F.when(k == 0, F.col("text")).when(k == 1, F.concat(F.lit("[applause] [00:01:02] "), "text")).when(k == 2, F.lit("[loud noise]")).otherwise(F.concat("text", F.lit(" [?] [END OF AUDIO]")))
    return X.cue(spark, d).select("job_id", "cue_id", text.alias("text"))


@query(f"WITH {X.TOK} SELECT norm, count(*) AS n FROM tok GROUP BY norm")
def p01_normalize_word(spark: SparkSession, d: str) -> DataFrame:
    return X.tok(spark, d).groupBy("norm").agg(F.count("*").alias("n"))


@query(f"WITH {X.CUE}, {_TAGGED} SELECT job_id, cue_id, trim(regexp_replace(regexp_replace(text, '\\[[^\\]]*\\]', ' ', 'g'), ' +', ' ', 'g')) AS bare, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '\\[([^\\]]*)\\]', 1), lambda x: trim(x)), lambda x: NOT regexp_matches(x, '{T.TIMECODE}') AND NOT contains(x, '{T.END_MARK}')))), '|') AS tags FROM t")
def p02_tags(spark: SparkSession, d: str) -> DataFrame:
    return _tagged(spark, d).select("job_id", "cue_id", T.strip_tags(F.col("text")).alias("bare"), F.array_join(F.sort_array(T.extract_tags(F.col("text"))), "|").alias("tags"))


@query(f"""WITH {X.TOK}, b AS (SELECT *, regexp_replace(word, '["''”’»）】]*$', '') AS bare FROM tok)
SELECT job_id, idx FROM b WHERE ends_with(bare, '--') OR (regexp_matches(word, '[.!?…。！？‥]+["''”’»）】]?$') AND NOT (ends_with(bare, '.') AND regexp_replace(lower(bare), '\\.+$', '') IN ({_list(T.ABBREVIATIONS)})))""")
def p03_sentence_end(spark: SparkSession, d: str) -> DataFrame:
    return X.tok(spark, d).where(T.sentence_end(F.col("word"))).select("job_id", "idx")


@query(f"WITH {X.CUE} SELECT job_id, cue_id, length(replace(text, chr(10), '')) AS chars, list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS longest, len(regexp_extract_all(text, '[^ \\n\\t\\r\\[]*\\[[^\\]]*\\][^ \\n\\t\\r]*|[^ \\n\\t\\r]+')) AS n_tokens FROM cue")
def p04_visible_chars(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return X.cue(spark, d).select("job_id", "cue_id", T.visible_chars(t).alias("chars"), T.longest_line(t).alias("longest"), F.size(T.caption_tokens(t)).alias("n_tokens"))


@query(f"WITH {X.CUE}, {_TAGGED} SELECT job_id, cue_id, regexp_matches(trim(text), '^\\[[^\\]]*\\]$') AS isolated, regexp_matches(trim(text), '^(\\[[^\\]]*\\][ \\n]*)+$') AS only_tags, len(list_filter(regexp_extract_all(text, '\\[[^\\]]*\\]'), lambda x: regexp_matches(x, '^\\[[^\\]]+\\]$') AND NOT regexp_matches(lower(x), '{T.NO_SOUND}'))) AS sounds, contains(text, '[') AND len(list_filter(list_transform(regexp_extract_all(text, '\\[([^\\]]*)\\]', 1), lambda x: trim(x)), lambda x: x = '' OR regexp_matches(x, '{T.TIMECODE}') OR contains(upper(x), '{T.END_MARK}'))) = 0 AS keepable FROM t")
def p05_tag_predicates(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    sounds = F.size(F.filter(F.regexp_extract_all(t, F.lit(T.TAG), F.lit(0)), T.sound_tag))
    return _tagged(spark, d).select("job_id", "cue_id", T.isolated_tag(t).alias("isolated"), T.tags_only(t).alias("only_tags"), sounds.alias("sounds"), T.keepable_tags(t).alias("keepable"))


@query(f"WITH {X.HYP} SELECT engine, count(*) AS kept FROM hyp WHERE start_ms >= 0 AND end_ms - start_ms BETWEEN 20 AND 3000 GROUP BY engine")
def p06_plausible_words(spark: SparkSession, d: str) -> DataFrame:
    return X.hyp(spark, d).where(T.plausible(F.col("start_ms"), F.col("end_ms"))).groupBy("engine").agg(F.count("*").alias("kept"))


def _metric_sql() -> str:
    t = r"regexp_replace(lower(replace(text, '’', '''')), '\[.*?\]|\(.*?\)', ' ', 'g')"
    for old, new in T.CONTRACTIONS.items():
        t = f"replace({t}, {_list([old])}, '{new}')"
    numbers = "CASE x " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.NUMBERS.items()) + " ELSE x END"
    return rf"array_to_string(list_filter(list_transform(regexp_extract_all(replace(regexp_replace({t}, '[^\p{{L}}\p{{N}}_\s'']', ' ', 'g'), '''', ''), '[^ \n\t\r]+'), lambda x: {numbers}), lambda x: x NOT IN ({_list(T.FILLERS)})), ' ')"


@query(f"WITH {X.CUE} SELECT job_id, cue_id, {_metric_sql()} AS words FROM cue")
def p07_metric_text(spark: SparkSession, d: str) -> DataFrame:
    return X.cue(spark, d).select("job_id", "cue_id", F.array_join(T.metric_words(F.col("text")), " ").alias("words"))


@query(f"WITH {X.CUE}, {_TAGGED}, s AS (SELECT job_id, cue_id, regexp_extract_all(text, '\\[[^\\]]*\\]|[^ \\n\\t\\r\\[]+') AS p FROM t) SELECT job_id, cue_id, len(p) AS items, len(list_filter(p, lambda x: starts_with(x, '['))) AS tags FROM s")
def p08_transcript_stream(spark: SparkSession, d: str) -> DataFrame:
    parts = F.regexp_extract_all("text", F.lit(r"\[[^\]]*\]|[^ \n\t\r\[]+"), F.lit(0))
    return _tagged(spark, d).select("job_id", "cue_id", F.size(parts).alias("items"), F.size(F.filter(parts, lambda x: x.startswith("["))).alias("tags"))


_CLEAN = "trim(lower(word), '.,;:!?\"''()[]{}')"
_LANG = f"CASE WHEN NOT regexp_matches(word, '\\p{{L}}') THEN lang {' '.join(f'''WHEN regexp_matches(word, '{p}') THEN '{code}' ''' for code, p in T.SCRIPTS)} WHEN {_CLEAN} IN ({_list(T.STOPWORDS)}) THEN 'en' ELSE lang END"


@query(f"WITH {X.TOK} SELECT lang, {_LANG} AS word_lang, count(*) AS n FROM tok GROUP BY 1, 2")
def p09_word_language(spark: SparkSession, d: str) -> DataFrame:
    return X.tok(spark, d).groupBy("lang", T.word_language(F.col("word"), F.col("lang")).alias("word_lang")).agg(F.count("*").alias("n"))


@query(f"WITH {X.TOK} SELECT job_id, sum(least(800, greatest(150, 70 * length(word) + 50)))::BIGINT AS spoken_ms FROM tok GROUP BY job_id")
def p10_spoken_ms(spark: SparkSession, d: str) -> DataFrame:
    return X.tok(spark, d).groupBy("job_id").agg(F.sum(T.spoken_ms(F.col("word"))).alias("spoken_ms"))


@query(f"""WITH {X.CUE}, p AS (SELECT job_id, cue_id, regexp_replace(trim(text), '\\bi\\b', 'I', 'g') AS t FROM cue),
q AS (SELECT *, array_to_string(list_transform(regexp_extract_all(t, '[^.!?]*[.!?]+ *|[^.!?]+'), lambda x: upper(substr(x, 1, 1)) || substr(x, 2)), '') AS u FROM p)
SELECT job_id, cue_id, CASE WHEN u = '' OR regexp_matches(u, '[.!?]$') THEN u ELSE u || '.' END AS text FROM q""")
def p12_polish(spark: SparkSession, d: str) -> DataFrame:
    return X.cue(spark, d).select("job_id", "cue_id", T.polished(F.col("text")).alias("text"))


_WORDS = "list_filter(list_transform(regexp_extract_all({}, '[^ \\n\\t\\r]+'), lambda x: lower(regexp_replace(x, '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'))), lambda x: x <> '')"


@query(f"WITH {X.CUE}, r AS (SELECT *, CASE WHEN cue_id % 2 = 0 THEN replace(text, ' ', ', ') || '!' ELSE replace(text, ' la ', ' le ') END AS other FROM cue) SELECT job_id, cue_id, {_WORDS.format('text')} = {_WORDS.format('other')} AND len({_WORDS.format('text')}) > 0 AS same FROM r")
def p14_same_words(spark: SparkSession, d: str) -> DataFrame:
    other = F.when(F.col("cue_id") % 2 == 0, F.concat(F.replace("text", F.lit(" "), F.lit(", ")), F.lit("!"))).otherwise(F.replace("text", F.lit(" la "), F.lit(" le ")))
    return X.cue(spark, d).select("job_id", "cue_id", T.same_words(F.col("text"), other).alias("same"))


#: Chunks with measures, from the interval table, all in whole numbers (per cent, tenths of a decibel, per mille).
_CHUNK = "ch AS (SELECT job_id, iv_id, score AS music, (score * 7) % 100 AS crowd, (score * 13) % 100 AS noise, (iv_id * 37) % 400 - 20 AS snr, iv_id % 11 = 0 AS narrowband, (iv_id * 3) % 5 AS clipping, (iv_id * 17) % 100 AS overlap FROM iv WHERE label = 'view')"
_COND = "list_filter([CASE WHEN overlap >= 15 THEN 'overlap' END, CASE WHEN music >= 35 THEN 'music' END, CASE WHEN crowd >= 35 THEN 'crowd' END, CASE WHEN snr < 30 THEN 'very_low_snr' WHEN snr < 100 THEN 'low_snr' END, CASE WHEN noise >= 45 AND snr < 250 THEN 'noise' END, CASE WHEN narrowband THEN 'narrowband' END, CASE WHEN clipping >= 1 THEN 'clipping' END], lambda x: x IS NOT NULL)"


def chunk_measures(spark: SparkSession, d: str) -> DataFrame:
    i, s = F.col("iv_id"), F.col("score")
    return X.iv(spark, d).where("label = 'view'").select("job_id", "iv_id", "start_ms", "end_ms", s.alias("music"), (s * 7 % 100).alias("crowd"), (s * 13 % 100).alias("noise"), (i * 37 % 400 - 20).alias("snr"), (i % 11 == 0).alias("narrowband"), (i * 3 % 5).alias("clipping"), (i * 17 % 100).alias("overlap"))


def conditions(music: str = "music", crowd: str = "crowd", noise: str = "noise", snr: str = "snr") -> F.Column:
    """Condition flags of a chunk: probabilities and overlap in per cent, SNR in tenths of dB, clipping in per mille."""
    c = F.col
    flags = F.array(
        F.when(c("overlap") >= 15, "overlap"), F.when(c(music) >= 35, "music"), F.when(c(crowd) >= 35, "crowd"), F.when(c(snr) < 30, "very_low_snr").when(c(snr) < 100, "low_snr"),
        F.when((c(noise) >= 45) & (c(snr) < 250), "noise"), F.when(c("narrowband"), "narrowband"), F.when(c("clipping") >= 1, "clipping"),
    )
    return F.filter(flags, lambda x: x.isNotNull())


def cleanup(mode: str) -> F.Column:
    """Cleanup of a chunk with `conditions`: vocals, crowd, denoise or null. mode: off, auto or all."""
    c = F.col
    music, crowd = c("music") >= 35, c("crowd") >= 35
    if mode == "off":
        return F.lit(None).cast("string")
    if mode == "all":
        plan = F.when(music, "vocals").when(crowd, "crowd").when(c("snr") < 100, "denoise")
    else:
        plan = F.when(music & (c("snr") < 80), "vocals").when(crowd & (c("snr") < 30), "crowd").when(~music & ~crowd & (c("snr") < 100), "denoise")
    return F.when(~F.arrays_overlap("conditions", F.array(F.lit("narrowband"), F.lit("clipping"))), plan)


@query(f"WITH {X.IV}, {_CHUNK} SELECT job_id, iv_id, array_to_string({_COND}, ',') AS conditions FROM ch")
def p16_conditions(spark: SparkSession, d: str) -> DataFrame:
    return chunk_measures(spark, d).select("job_id", "iv_id", F.array_join(conditions(), ",").alias("conditions"))


_AUTO = "CASE WHEN narrowband OR clipping >= 1 THEN NULL WHEN music >= 35 AND snr < 80 THEN 'vocals' WHEN crowd >= 35 AND snr < 30 THEN 'crowd' WHEN music < 35 AND crowd < 35 AND snr < 100 THEN 'denoise' END"
_ALL = "CASE WHEN narrowband OR clipping >= 1 THEN NULL WHEN music >= 35 THEN 'vocals' WHEN crowd >= 35 THEN 'crowd' WHEN snr < 100 THEN 'denoise' END"


@query(f"WITH {X.IV}, {_CHUNK} SELECT job_id, iv_id, {_AUTO} AS auto_plan, {_ALL} AS all_plan FROM ch")
def p17_cleanup(spark: SparkSession, d: str) -> DataFrame:
    return chunk_measures(spark, d).withColumn("conditions", conditions()).select("job_id", "iv_id", cleanup("auto").alias("auto_plan"), cleanup("all").alias("all_plan"))


@query(f"WITH {X.TOK}, j AS (SELECT job_id, count(*) AS words, max(end_ms) // 2 AS media_ms, sum(end_ms - start_ms)::BIGINT AS expected_ms FROM tok GROUP BY job_id) SELECT job_id, words >= 200 AND (words * 1000 > 8 * media_ms OR expected_ms > 3 * media_ms + 15000) AS mismatch FROM j")
def p18_mismatch_guard(spark: SparkSession, d: str) -> DataFrame:
    """A transcript that cannot belong to its media: at least 200 words, over 8 a second, or more than three times as long when spoken."""
    j = X.tok(spark, d).groupBy("job_id").agg(F.count("*").alias("words"), F.floor(F.max("end_ms") / 2).alias("media_ms"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("expected_ms"))
    return j.select("job_id", ((F.col("words") >= 200) & ((F.col("words") * 1000 > 8 * F.col("media_ms")) | (F.col("expected_ms") > 3 * F.col("media_ms") + 15000))).alias("mismatch"))


@query(f"WITH {X.IV} SELECT iv_id, label IN ('click', 'view', 'purchase') AND start_ms >= 0 AND end_ms - 300000 > start_ms AS valid FROM iv")
def p19_edit_validation(spark: SparkSession, d: str) -> DataFrame:
    ok = F.col("label").isin("click", "view", "purchase") & (F.col("start_ms") >= 0) & (F.col("end_ms") - 300000 > F.col("start_ms"))
    return X.iv(spark, d).select("iv_id", ok.alias("valid"))


@query(f"WITH {X.HYP} SELECT engine, lang, count(*) AS words FROM hyp WHERE (engine, lang) IN (('a', 'en'), ('a', 'de'), ('b', 'en'), ('c', 'fr')) GROUP BY 1, 2")
def p20_voter_languages(spark: SparkSession, d: str) -> DataFrame:
    able = [("a", "en"), ("a", "de"), ("b", "en"), ("c", "fr")]
    return L.language_counts(spark, d, able).groupBy("engine", "lang").agg(F.sum("words").alias("words"))


@query(f"WITH {X.CUE} SELECT job_id, cue_id, start_ms, lpad((start_ms // 3600000)::VARCHAR, 2, '0') || ':' || lpad((start_ms // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((start_ms // 1000 % 60)::VARCHAR, 2, '0') || ',' || lpad((start_ms % 1000)::VARCHAR, 3, '0') AS code, start_ms AS back FROM (SELECT job_id, cue_id, greatest(start_ms, 0) AS start_ms FROM cue)")
def f10_timecodes(spark: SparkSession, d: str) -> DataFrame:
    c = X.cue(spark, d).select("job_id", "cue_id", F.greatest("start_ms", F.lit(0)).alias("start_ms"))
    return c.withColumn("code", T.timecode(F.col("start_ms"))).withColumn("back", T.to_ms(F.col("code")))


@query(f"WITH {X.TOK} SELECT norm, min(word) AS shown, count(*) AS n FROM tok WHERE norm NOT IN (SELECT lower(regexp_replace(w, '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')) FROM (SELECT unnest(regexp_extract_all(text, '[^ \\n\\t\\r]+')) AS w FROM benchmark)) GROUP BY norm")
def u06_out_of_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    known = X.read(spark, d, "benchmark").select(F.explode(T.tokens(F.col("text"))).alias("w")).select(T.normalize_word(F.col("w")).alias("norm")).distinct()
    return X.tok(spark, d).groupBy("norm").agg(F.min("word").alias("shown"), F.count("*").alias("n")).join(known, "norm", "left_anti")
