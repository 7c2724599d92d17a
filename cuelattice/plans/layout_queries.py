"""Queries of layout, timing repair, tags and further files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelattice.functions import text as T
from cuelattice.operators import align as A
from cuelattice.operators import cues as C
from cuelattice.plans import cue_queries as Q
from cuelattice.plans import fixtures as X
from cuelattice.plans.book import query
from cuelattice.streaming import live

_BY = "PARTITION BY job_id ORDER BY"


@query(f"WITH {X.CUE} SELECT job_id, cue_id, list_reduce(list_prepend('', regexp_extract_all(text, '[^ \\n\\t\\r]+')), lambda a, x: CASE WHEN a = '' THEN x WHEN length(regexp_extract(a, '[^\\n]*$')) + 1 + length(x) <= 42 THEN a || ' ' || x ELSE a || chr(10) || x END) AS text FROM cue")
def p13_greedy_wrap(spark: SparkSession, d: str) -> DataFrame:
    return X.cue(spark, d).select("job_id", "cue_id", C.wrapped(F.col("text"), 42).alias("text"))


@query(f"""WITH {X.TOK}, g AS (SELECT *, sum((norm <> '')::INT) OVER ({_BY} idx) AS grp FROM tok) SELECT job_id, grp, string_agg(word, '' ORDER BY idx) AS word, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM g GROUP BY 1, 2 HAVING count(*) > 1""")
def w39_attached_punctuation(spark: SparkSession, d: str) -> DataFrame:
    """Words with the lone punctuation after them; those that change."""
    g = X.tok(spark, d).withColumn("grp", C.running(F.col("norm") != "", W.partitionBy("job_id").orderBy("idx")))
    g = g.groupBy("job_id", "grp").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("idx", "word"))).alias("ws"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).where("n > 1")
    return g.select("job_id", "grp", F.array_join(F.transform("ws", lambda x: x["word"]), "").alias("word"), "start_ms", "end_ms")


@query(f"""WITH {X.CUE}, n AS (SELECT *, lead(start_ms) OVER {Q._ORDER} AS nx, greatest(700, length(replace(text, chr(10), '')) * 1000 // 20 + 1) AS want FROM cue)
SELECT job_id, cue_id, start_ms, greatest(end_ms, least(start_ms + want, coalesce(nx - 1, start_ms + want))) AS end_ms FROM n""")
def w33_grown_cues(spark: SparkSession, d: str) -> DataFrame:
    return C.grown(X.cue(spark, d)).select("job_id", "cue_id", "start_ms", "end_ms")


_STRONG = "s AS (SELECT t.job_id, t.idx, t.start_ms AS expected, a.start_ms AS heard, a.end_ms AS until, b.start_ms AS other, abs(a.start_ms - b.start_ms) <= 80 AS strong FROM tok t LEFT JOIN am a ON t.job_id = a.job_id AND t.idx = a.idx AND a.engine = 'a' AND a.same LEFT JOIN am b ON t.job_id = b.job_id AND t.idx = b.idx AND b.engine = 'b' AND b.same)"


@query(f"""WITH {X.ALIGNED}, {_STRONG}, r AS (SELECT *, max(CASE WHEN strong THEN until END) OVER ({_BY} idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low, min(CASE WHEN strong THEN heard END) OVER ({_BY} idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS high FROM s)
SELECT job_id, idx, greatest(coalesce(low, 0), least(coalesce(heard, other, expected), coalesce(high, coalesce(heard, other, expected)))) AS start_ms, CASE WHEN strong THEN 90 WHEN heard IS NOT NULL THEN 75 WHEN other IS NOT NULL THEN 50 ELSE 20 END AS confidence FROM r""")
def w43_best_times(spark: SparkSession, d: str) -> DataFrame:
    """Each word's best time, kept between the strong anchors around it, with its confidence in per cent."""
    h = X.aligned(spark, d).where("same")
    at = h.where("engine = 'a'").select("job_id", "idx", F.col("start_ms").alias("at"), F.col("end_ms").alias("until"))
    other = h.where("engine = 'b'").select("job_id", "idx", F.col("start_ms").alias("other"))
    s = X.tok(spark, d).select("job_id", "idx", "norm", F.col("start_ms").alias("expected")).join(at, ["job_id", "idx"], "left").join(other, ["job_id", "idx"], "left")
    s = s.withColumn("strong", F.abs(F.col("at") - F.col("other")) <= 80)
    w = W.partitionBy("job_id").orderBy("idx")
    low = F.max(F.when(F.col("strong"), F.col("until"))).over(w.rowsBetween(W.unboundedPreceding, -1))
    high = F.min(F.when(F.col("strong"), F.col("at"))).over(A.backwards(["job_id"], "idx"))
    r = s.withColumn("low", low).withColumn("high", high).withColumn("t", F.coalesce("at", "other", "expected"))
    confidence = F.when(F.col("strong"), 90).when(F.col("at").isNotNull(), 75).when(F.col("other").isNotNull(), 50).otherwise(20)
    return r.select("job_id", "idx", F.greatest(F.coalesce("low", F.lit(0)), F.least("t", F.coalesce("high", "t"))).alias("start_ms"), confidence.alias("confidence"))


@query(f"""WITH {X.ALIGNED}, v AS (SELECT t.job_id, t.idx, t.start_ms, t.end_ms, t.norm IS DISTINCT FROM h.norm AS changed FROM tok t LEFT JOIN am h ON t.job_id = h.job_id AND t.idx = h.idx AND h.engine = 'a'),
n AS (SELECT *, lag(end_ms) OVER ({_BY} idx) AS p, lead(start_ms) OVER ({_BY} idx) AS nx FROM v), r AS (SELECT *, idx - row_number() OVER ({_BY} idx) AS g FROM n WHERE changed),
k AS (SELECT *, row_number() OVER (PARTITION BY job_id, g ORDER BY idx) - 1 AS j, count(*) OVER (PARTITION BY job_id, g) AS n, coalesce(first_value(p) OVER (PARTITION BY job_id, g ORDER BY idx), 0) AS a, coalesce(last_value(nx) OVER (PARTITION BY job_id, g ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), max(end_ms) OVER (PARTITION BY job_id, g)) AS b FROM r)
SELECT job_id, idx, a + (b - a) * j // n AS start_ms, a + (b - a) * (j + 1) // n AS end_ms FROM k""")
def w47_retimed_edits(spark: SparkSession, d: str) -> DataFrame:
    """Words of edited spans share the time between the unchanged neighbours evenly."""
    h = X.aligned(spark, d).where("engine = 'a'").select("job_id", "idx", F.col("norm").alias("other"))
    w = W.partitionBy("job_id").orderBy("idx")
    v = X.tok(spark, d).join(h, ["job_id", "idx"], "left").select("job_id", "idx", "end_ms", F.lag("end_ms").over(w).alias("p"), F.lead("start_ms").over(w).alias("nx"), (~F.col("norm").eqNullSafe(F.col("other"))).alias("changed"))
    r = v.where("changed").withColumn("g", F.col("idx") - F.row_number().over(w))
    span = W.partitionBy("job_id", "g").orderBy("idx")
    whole = span.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    k = r.select("job_id", "idx", (F.row_number().over(span) - 1).alias("j"), F.count("*").over(whole).alias("n"), F.coalesce(F.first("p").over(whole), F.lit(0)).alias("a"), F.coalesce(F.last("nx").over(whole), F.max("end_ms").over(whole)).alias("b"))
    part = lambda j: F.col("a") + F.floor((F.col("b") - F.col("a")) * j / F.col("n"))
    return k.select("job_id", "idx", part(F.col("j")).alias("start_ms"), part(F.col("j") + 1).alias("end_ms"))


_TAGS = "tg AS (SELECT event_id AS tag_id, user_id AS job_id, event_type AS tag, s AS start_ms, s + 2000 + floor(value * 1000)::BIGINT % 3000 AS end_ms FROM (SELECT *, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000 AS s FROM events))"


@query(f"""WITH {_TAGS}, l AS (SELECT *, lag(tag) OVER (PARTITION BY job_id ORDER BY start_ms, tag_id) AS pt FROM tg), g AS (SELECT *, sum((pt IS DISTINCT FROM tag)::INT) OVER (PARTITION BY job_id ORDER BY start_ms, tag_id ROWS UNBOUNDED PRECEDING) AS run FROM l)
SELECT job_id, run, min(tag) AS tag, count(*) AS n, min(start_ms) AS start_ms, least(max(end_ms), min(start_ms) + 6000) AS end_ms FROM g WHERE tag <> 'purchase' GROUP BY 1, 2""")
def w27_merged_tags(spark: SparkSession, d: str) -> DataFrame:
    """The same tag again without anything else between is one tag, of at most six seconds. Purchases stand for dialogue."""
    length = 2000 + F.floor(F.col("value") * 1000) % 3000
    start = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) div 1000")
    t = X.read(spark, d, "events").select(F.col("event_id").alias("tag_id"), F.col("user_id").alias("job_id"), F.col("event_type").alias("tag"), start.alias("start_ms"), (start + length).alias("end_ms"))
    w = W.partitionBy("job_id").orderBy("start_ms", "tag_id")
    t = t.withColumn("run", C.running(~F.lag("tag").over(w).eqNullSafe(F.col("tag")), w)).where("tag <> 'purchase'")
    g = t.groupBy("job_id", "run").agg(F.min("tag").alias("tag"), F.count("*").alias("n"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    return g.withColumn("end_ms", F.least(F.col("end_ms"), F.col("start_ms") + 6000))


@query("""WITH l AS (SELECT doc_id AS job_id, unnest(range(0, len(ls))) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
w AS (SELECT job_id, line_no, unnest(range(0, len(ws))) AS k, unnest(ws) AS word FROM (SELECT *, regexp_extract_all(regexp_replace(line, '\\[[^\\]]*\\]', ' ', 'g'), '[^ \\n\\t\\r]+') AS ws FROM l))
SELECT job_id, line_no, row_number() OVER (PARTITION BY job_id ORDER BY line_no, k) - 1 AS idx, word FROM w""")
def s09_transcript_words(spark: SparkSession, d: str) -> DataFrame:
    """Lines of transcripts, their words without tags, numbered through."""
    lines = X.read(spark, d, "documents").select(F.col("doc_id").alias("job_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    words = lines.select("job_id", "line_no", F.posexplode(T.tokens(F.regexp_replace("line", T.TAG, " "))).alias("k", "word"))
    return words.select("job_id", "line_no", (F.row_number().over(W.partitionBy("job_id").orderBy("line_no", "k")) - 1).alias("idx"), "word")


_CS = lambda c: f"({c} // 3600000)::VARCHAR || ':' || lpad(({c} // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad(({c} // 1000 % 60)::VARCHAR, 2, '0') || '.' || lpad(({c} // 10 % 100)::VARCHAR, 2, '0')"


@query(f"""WITH {Q._POS} SELECT job_id, string_agg('Dialogue: 0,' || {_CS('start_ms')} || ',' || {_CS('end_ms')} || ',Default,' || role || ',0,0,0,,' || array_to_string(list_transform(list_filter(string_split(replace(replace(text, '{{', '\\{{'), '}}', '\\}}'), chr(10)), lambda x: trim(x) <> ''), lambda x: trim(x)), '\\N'), chr(10) ORDER BY start_ms, cue_id) AS events FROM pc GROUP BY 1""")
def s14_ass_events(spark: SparkSession, d: str) -> DataFrame:
    """The event lines of SubStation files; `cues.ass` puts the fixed head before them."""
    return C.ass_events(Q._positive(spark, d), "role")


@query(f"""{Q._PARA}, pp AS (SELECT job_id, part, block, min(s) // 1000 AS s, min(speaker) AS speaker, string_agg(text, ' ' ORDER BY sentence) AS text FROM pa GROUP BY 1, 2, 3)
SELECT job_id, string_agg('[' || lpad((s // 3600)::VARCHAR, 2, '0') || ':' || lpad((s // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') || '] ' || speaker || ': ' || text, chr(10) || chr(10) ORDER BY part, block) AS txt FROM pp GROUP BY 1""")
def s15_transcript_text(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of sentences with their time and speaker. A sentence has 60 words at most, a paragraph eight sentences, so both lists are short."""
    words = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "word"))), lambda x: x["word"]), " ")
    s = Q._sentences(spark, d).groupBy("job_id", "sentence").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.min("speaker").alias("speaker"), words.alias("text"))
    p = C.paragraphs(s).withColumn("run", F.col("part") * 1000000 + F.col("block")).withColumn("cue_id", F.col("sentence"))
    return C.transcript(p, "speaker")


@query(f"""WITH {X.CUE}, r AS (SELECT *, sum(coalesce(pr <> role OR start_ms - pe > 800, false)::INT) OVER (PARTITION BY job_id ORDER BY start_ms, cue_id ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(role) OVER {Q._ORDER} AS pr, lag(end_ms) OVER {Q._ORDER} AS pe FROM cue)),
p AS (SELECT job_id, run, min(role) AS role, greatest(0, min(start_ms)) AS s, string_agg(replace(text, chr(10), ' '), ' ' ORDER BY start_ms, cue_id) AS text FROM r GROUP BY 1, 2)
SELECT job_id, run, '[' || s // 1000 || '.' || s // 100 % 10 || '] ' || role || ': ' || text AS line FROM p""")
def s16_speaker_lines(spark: SparkSession, d: str) -> DataFrame:
    g = C.joined_runs(C.speaker_runs(X.cue(spark, d), "role", 800), "role")
    tenths = F.concat(F.floor(F.col("start_ms") / 1000).cast("string"), F.lit("."), (F.floor(F.col("start_ms") / 100) % 10).cast("string"))
    return g.select("job_id", "run", F.concat(F.lit("["), tenths, F.lit("] "), "role", F.lit(": "), "text").alias("line"))


_STEM = "regexp_extract(url, '^[^:]*://[^/?#]*/?([^?#]*)', 1)"


@query(f"WITH f AS (SELECT page_id, regexp_extract(url, '^[^:]*://([^/?#]*)', 1) AS dir, regexp_replace({_STEM}, '\\.[^./]*$', '') AS stem FROM pages WHERE url IS NOT NULL) SELECT page_id FROM f QUALIFY row_number() OVER (PARTITION BY dir, stem ORDER BY page_id) > 1")
def s02_name_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Files whose output an earlier one of the same folder and stem would take."""
    stem = F.regexp_replace(F.regexp_extract("url", r"^[^:]*://[^/?#]*/?([^?#]*)", 1), r"\.[^./]*$", "")
    f = X.read(spark, d, "pages").where("url IS NOT NULL").select("page_id", F.regexp_extract("url", r"^[^:]*://([^/?#]*)", 1).alias("dir"), stem.alias("stem"))
    return f.withColumn("n", F.row_number().over(W.partitionBy("dir", "stem").orderBy("page_id"))).where("n > 1").select("page_id")


@query("""WITH t AS (SELECT doc_id, 'labels' AS kind, 1 AS p FROM labels UNION ALL SELECT doc_id, 'lang', 2 FROM documents WHERE lang IS NOT NULL UNION ALL SELECT doc_id, 'text', 3 FROM documents WHERE text IS NOT NULL) SELECT doc_id, min_by(kind, p) AS truth, count(*) AS sources FROM t GROUP BY 1""")
def s03_truth_source(spark: SparkSession, d: str) -> DataFrame:
    """Where each item's truth comes from: the first kind of source that has it."""
    docs = X.read(spark, d, "documents")
    kinds = (X.read(spark, d, "labels").select("doc_id"), "labels"), (docs.where("lang IS NOT NULL").select("doc_id"), "lang"), (docs.where("text IS NOT NULL").select("doc_id"), "text")
    rows = None
    for p, (df, kind) in enumerate(kinds):
        df = df.select("doc_id", F.lit(kind).alias("kind"), F.lit(p).alias("p"))
        rows = df if rows is None else rows.unionByName(df)
    return rows.groupBy("doc_id").agg(F.min_by("kind", "p").alias("truth"), F.count("*").alias("sources"))


@query("""WITH s AS (SELECT DISTINCT source, lang, substr(md5(source), 1, 1) >= '8' AS male FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY lang, male ORDER BY md5(source || '/' || lang)) AS k FROM s),
c AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY k, male) AS place FROM r), u AS (SELECT d.doc_id, d.source, d.lang, male, row_number() OVER (PARTITION BY d.source, d.lang ORDER BY d.doc_id) AS n FROM documents d JOIN c ON d.source = c.source AND d.lang = c.lang AND place <= 4) SELECT doc_id, source, lang, male FROM u WHERE n <= 4""")
def s10_balanced_sample(spark: SparkSession, d: str) -> DataFrame:
    """A balanced sample: per language four speakers (sources) in hashed order, the sexes by turns (here by hash), of each the first four items."""
    docs = X.read(spark, d, "documents").select("doc_id", "source", "lang")
    s = docs.where("source IS NOT NULL AND lang IS NOT NULL").select("source", "lang").distinct().withColumn("male", F.substring(F.md5("source"), 1, 1) >= "8")
    r = s.withColumn("k", F.row_number().over(W.partitionBy("lang", "male").orderBy(F.md5(F.concat_ws("/", "source", "lang")))))
    c = r.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy("k", "male"))).where("place <= 4").select("source", "lang", "male")
    return docs.join(c, ["source", "lang"]).withColumn("n", F.row_number().over(W.partitionBy("source", "lang").orderBy("doc_id"))).where("n <= 4").select("doc_id", "source", "lang", "male")


@query("""WITH e AS (SELECT user_id AS job_id, event_type AS cue, event_id, floor(value * 100)::BIGINT AS amount, ts FROM events) SELECT job_id, cue, max_by(event_id, (ts, event_id)) AS edit, max_by(amount, (ts, event_id)) AS amount, count(*) AS edits FROM e GROUP BY 1, 2""")
def t06_latest_edits(spark: SparkSession, d: str) -> DataFrame:
    """Batch twin of the edit log: the latest edit of each cue."""
    return live.latest_edits(X.read(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("cue"), "event_id", F.floor(F.col("value") * 100).alias("amount"), F.col("ts").alias("at")))


@query(f"""WITH {X.TOK}, c AS (SELECT job_id, chunk_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(norm, ' ' ORDER BY idx) FILTER (WHERE norm <> '') AS said, (job_id * 13 + chunk_id * 7) % 100 AS speech FROM tok GROUP BY 1, 2), ph AS (SELECT said FROM c GROUP BY 1 HAVING count(DISTINCT job_id) > 1)
SELECT job_id, chunk_id, speech FROM c WHERE speech < 35 AND said IN (SELECT said FROM ph)""")
def p21_stock_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of low speech that only hold a stock phrase: here a chunk's text that several jobs have."""
    t = X.tok(spark, d)
    c = t.groupBy("job_id", "chunk_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("norm") != "", F.struct("idx", "norm")))), lambda x: x["norm"]), " ").alias("said"))
    c = c.withColumn("speech", (F.col("job_id") * 13 + F.col("chunk_id") * 7) % 100)
    stock = c.where("said <> ''").groupBy("said").agg(F.count_distinct("job_id").alias("jobs")).where("jobs > 1")
    return c.where("speech < 35").join(stock, "said", "left_semi").select("job_id", "chunk_id", "speech")
