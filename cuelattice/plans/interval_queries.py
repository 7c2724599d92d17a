"""Queries over intervals and frame series: interval joins, sweeps, gaps and islands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelattice.operators import intervals as I
from cuelattice.operators import signals as S
from cuelattice.plans import fixtures as X
from cuelattice.plans import text_queries as P
from cuelattice.plans.book import query

B = 10_000_000
_SPLIT = f"WITH {X.IV}, l AS (SELECT * FROM iv WHERE label IN ('click', 'error')), r AS (SELECT * FROM iv WHERE label = 'view')"
_MID = "m AS (SELECT *, (start_ms + end_ms) // 2 AS mid FROM l)"


def _l(spark: SparkSession, d: str) -> DataFrame:
    return X.iv(spark, d).where("label IN ('click', 'error')")


def _r(spark: SparkSession, d: str) -> DataFrame:
    return X.iv(spark, d).where("label = 'view'")


@query(f"{_SPLIT} SELECT l.iv_id AS l_id, r.iv_id AS r_id FROM l JOIN r ON l.job_id = r.job_id AND l.start_ms < r.end_ms AND r.start_ms < l.end_ms")
def j00_interval_join(spark: SparkSession, d: str) -> DataFrame:
    return I.interval_join(_l(spark, d), _r(spark, d), B).select(F.col("l.iv_id").alias("l_id"), F.col("r.iv_id").alias("r_id"))


_NEAR = "greatest(0, mid - r.end_ms, r.start_ms - mid)"


@query(f"""{_SPLIT}, {_MID}, k AS (SELECT m.iv_id, r.iv_id AS chunk, row_number() OVER (PARTITION BY m.iv_id ORDER BY -greatest(0, least(mid + 1, r.end_ms) - greatest(mid, r.start_ms)), greatest(0, mid - r.end_ms, r.start_ms - mid - 1), r.start_ms, r.iv_id) AS rn
 FROM m JOIN r ON m.job_id = r.job_id AND mid - 6000000 < r.end_ms AND r.start_ms < mid + 6000001) SELECT m.iv_id, k.chunk FROM m LEFT JOIN k ON m.iv_id = k.iv_id AND rn = 1""")
def j01_words_to_chunks(spark: SparkSession, d: str) -> DataFrame:
    return I.nearest(I.at_midpoint(_l(spark, d)), _r(spark, d).withColumnRenamed("iv_id", "chunk"), "iv_id", "chunk", B, 6_000_000)


@query(f"""{_SPLIT}, k AS (SELECT l.iv_id, r.iv_id AS turn, row_number() OVER (PARTITION BY l.iv_id ORDER BY -greatest(0, least(l.end_ms, r.end_ms) - greatest(l.start_ms, r.start_ms)), greatest(0, l.start_ms - r.end_ms, r.start_ms - l.end_ms), r.start_ms, r.iv_id) AS rn
 FROM l JOIN r ON l.job_id = r.job_id AND l.start_ms - 1000000 < r.end_ms AND r.start_ms < l.end_ms + 1000000) SELECT l.iv_id, k.turn FROM l LEFT JOIN k ON l.iv_id = k.iv_id AND rn = 1""")
def j02_words_to_speakers(spark: SparkSession, d: str) -> DataFrame:
    return I.nearest(_l(spark, d), _r(spark, d).withColumnRenamed("iv_id", "turn"), "iv_id", "turn", 2 * B, 1_000_000)


@query(f"{_SPLIT}, {_MID} SELECT r.iv_id AS cue, count(*) AS words, min(m.iv_id) AS first FROM m JOIN r ON m.job_id = r.job_id AND mid - 10 < r.end_ms AND r.start_ms < mid + 11 GROUP BY r.iv_id")
def j03_words_to_cues(spark: SparkSession, d: str) -> DataFrame:
    return I.interval_join(I.at_midpoint(_l(spark, d)), _r(spark, d), B, within_ms=10).groupBy(F.col("r.iv_id").alias("cue")).agg(F.count("*").alias("words"), F.min("l.iv_id").alias("first"))


@query(f"""WITH {X.IV}, {P._CHUNK}, c AS (SELECT ch.*, start_ms, end_ms, {P._COND} AS conds FROM ch JOIN iv USING (iv_id)), l AS (SELECT * FROM iv WHERE label IN ('click', 'error')),
p AS (SELECT l.iv_id, conds, greatest(0, least(l.end_ms, c.end_ms) - greatest(l.start_ms, c.start_ms)) * 100 >= 15 * (l.end_ms - l.start_ms) AS much FROM l JOIN c ON l.job_id = c.job_id AND l.start_ms < c.end_ms AND c.start_ms < l.end_ms)
SELECT iv_id, array_to_string(list_sort(list_distinct(flatten(list(conds)))), ',') AS conditions, bool_or(much) AS much FROM p GROUP BY iv_id""")
def j04_cue_conditions(spark: SparkSession, d: str) -> DataFrame:
    c = P.chunk_measures(spark, d).withColumn("conds", P.conditions())
    p = I.interval_join(_l(spark, d), c, B)
    much = I.overlap(F.col("l"), F.col("r")) * 100 >= 15 * (F.col("l.end_ms") - F.col("l.start_ms"))
    return p.groupBy(F.col("l.iv_id").alias("iv_id")).agg(F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list("r.conds")))), ",").alias("conditions"), F.bool_or(much).alias("much"))


@query(f"{_SPLIT} SELECT l.iv_id, count(r.iv_id) AS removed FROM l LEFT JOIN r ON l.job_id = r.job_id AND l.start_ms - 250 < r.end_ms AND r.start_ms < l.end_ms + 250 GROUP BY l.iv_id")
def j05_removals_near_cues(spark: SparkSession, d: str) -> DataFrame:
    n = I.interval_join(_l(spark, d), _r(spark, d), B, within_ms=250).groupBy(F.col("l.iv_id").alias("iv_id")).agg(F.count("*").alias("n"))
    return _l(spark, d).select("iv_id").join(n, "iv_id", "left").select("iv_id", F.coalesce("n", F.lit(0)).alias("removed"))


@query(f"WITH {X.HYP}, h AS (SELECT *, (start_ms + end_ms) // 2 AS mid FROM hyp WHERE sub = 0) SELECT b.job_id, b.idx, h.engine, max(1000 - abs(h.mid - b.mid) * 1000 // 400) AS weight FROM h b JOIN h ON b.job_id = h.job_id AND b.norm = h.norm AND abs(b.mid - h.mid) <= 400 WHERE b.engine = 'a' AND h.engine <> 'a' GROUP BY 1, 2, 3")
def j06_time_proximity(spark: SparkSession, d: str) -> DataFrame:
    """Words of other engines within 400 ms of a backbone word, the weight falling with distance; the word is part of the bucket's key."""
    h = X.hyp(spark, d).where("sub = 0").withColumn("mid", F.floor((F.col("start_ms") + F.col("end_ms")) / 2))
    back = h.where("engine = 'a'").select("job_id", "norm", "idx", F.col("mid").alias("at"), F.explode(F.sequence(F.floor((F.col("mid") - 400) / 400), F.floor((F.col("mid") + 400) / 400))).alias("b"))
    near = h.where("engine <> 'a'").select("job_id", "norm", "engine", "mid", F.floor(F.col("mid") / 400).alias("b"))
    far = F.abs(F.col("mid") - F.col("at"))
    return back.join(near, ["job_id", "norm", "b"]).where(far <= 400).groupBy("job_id", "idx", "engine").agg(F.max(1000 - F.floor(far * 1000 / 400)).alias("weight"))


@query(f"WITH {X.IV} SELECT job_id, label, dense_rank() OVER (PARTITION BY job_id ORDER BY first, label) AS speaker FROM (SELECT job_id, label, min(start_ms) AS first FROM iv GROUP BY 1, 2)")
def w25_speaker_names(spark: SparkSession, d: str) -> DataFrame:
    g = X.iv(spark, d).groupBy("job_id", "label").agg(F.min("start_ms").alias("first"))
    return g.select("job_id", "label", F.dense_rank().over(W.partitionBy("job_id").orderBy("first", "label")).cast("long").alias("speaker"))


@query(f"""WITH {X.IV}, s AS (SELECT job_id, t, sum(d) AS d FROM (SELECT job_id, start_ms AS t, 1 AS d FROM iv UNION ALL SELECT job_id, end_ms, -1 FROM iv) GROUP BY 1, 2),
p AS (SELECT job_id, t, sum(d) OVER (PARTITION BY job_id ORDER BY t) AS depth, lead(t) OVER (PARTITION BY job_id ORDER BY t) AS u FROM s), q AS (SELECT * FROM p WHERE depth >= 2 AND u IS NOT NULL),
i AS (SELECT *, sum(CASE WHEN t > pu + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY t) AS g FROM (SELECT *, lag(u) OVER (PARTITION BY job_id ORDER BY t) AS pu FROM q))
SELECT job_id, min(t) AS start_ms, max(u) AS end_ms FROM i GROUP BY job_id, g HAVING max(u) - min(t) >= 100""")
def w26_overlap_regions(spark: SparkSession, d: str) -> DataFrame:
    return I.crowded(X.iv(spark, d), 2, 50, 100)


_SEG = f"""WITH {X.FR}, g0 AS (SELECT *, sum(CASE WHEN p >= 50 THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY frame) AS grp FROM fr),
g AS (SELECT job_id, grp, min(frame) AS high, max(frame) AS last, min(CASE WHEN p < 35 THEN frame END) AS f, max(CASE WHEN p < 35 THEN frame END) AS l FROM g0 WHERE grp > 0 GROUP BY 1, 2),
c AS (SELECT *, coalesce((l + 1 - f) * 32 >= 100, false) AS cut FROM g),
s AS (SELECT *, coalesce(sum(cut::INT) OVER (PARTITION BY job_id ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM c),
seg AS (SELECT job_id, min(high) * 32 AS start_ms, coalesce(min(CASE WHEN cut THEN f END), max(last) + 1) * 32 AS end_ms FROM s GROUP BY job_id, seg HAVING coalesce(min(CASE WHEN cut THEN f END), max(last) + 1) * 32 - min(high) * 32 >= 250)"""


@query(f"{_SEG} SELECT * FROM seg")
def w01_speech_segments(spark: SparkSession, d: str) -> DataFrame:
    return I.speech_segments(X.fr(spark, d), 32)


@query(f"{_SEG} SELECT job_id, greatest(start_ms - 30, coalesce((lag(end_ms) OVER w + start_ms) // 2, 0), 0) AS start_ms, least(end_ms + 30, coalesce((end_ms + lead(start_ms) OVER w) // 2, end_ms + 30)) AS end_ms FROM seg WINDOW w AS (PARTITION BY job_id ORDER BY start_ms)")
def w04_padded_segments(spark: SparkSession, d: str) -> DataFrame:
    return I.padded(I.speech_segments(X.fr(spark, d), 32), 30)


_JOBS = f"WITH {X.FR}, j AS (SELECT job_id, count(*) * 32 AS duration_ms FROM fr GROUP BY 1)"


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    return X.fr(spark, d).groupBy("job_id").agg((F.count("*") * 32).alias("duration_ms"))


@query(f"{_JOBS} SELECT job_id, (s // 500)::INT AS chunk_id, s AS start_ms, least(s + 500, duration_ms) AS end_ms FROM (SELECT *, unnest(range(0, duration_ms, 500)) AS s FROM j)")
def w05_fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    return I.fixed_chunks(_jobs(spark, d), 500)


@query(f"{_JOBS} SELECT job_id, (s // 900)::INT AS window_id, s AS from_ms, least(s + 900, duration_ms) AS to_ms, greatest(0, s - 200) AS start_ms, least(s + 900, duration_ms) + 200 AS end_ms FROM (SELECT *, unnest(range(0, duration_ms, 900)) AS s FROM j)")
def w46_context_windows(spark: SparkSession, d: str) -> DataFrame:
    return I.context_windows(_jobs(spark, d), 900, 200).select("job_id", "window_id", "from_ms", "to_ms", "start_ms", "end_ms")


@query(f"{_JOBS}, c AS (SELECT job_id, s // 500 AS chunk_id, s AS start_ms, least(s + 500, duration_ms) AS end_ms FROM (SELECT *, unnest(range(0, duration_ms, 500)) AS s FROM j)) SELECT c.job_id, chunk_id::INT AS chunk_id, count(*) AS frames, sum(p)::BIGINT AS total, max(p) AS most FROM c JOIN fr ON c.job_id = fr.job_id AND frame * 32 < end_ms AND start_ms < frame * 32 + 32 GROUP BY 1, 2")
def a16_chunk_means(spark: SparkSession, d: str) -> DataFrame:
    frames = X.fr(spark, d).select("job_id", (F.col("frame") * 32).alias("start_ms"), (F.col("frame") * 32 + 32).alias("end_ms"), "p")
    g = I.interval_join(frames, I.fixed_chunks(_jobs(spark, d), 500), 500).groupBy(F.col("r.job_id").alias("job_id"), F.col("r.chunk_id").alias("chunk_id"))
    return g.agg(F.count("*").alias("frames"), F.sum("l.p").alias("total"), F.max("l.p").alias("most"))


@query(f"WITH {X.IV}, {P._CHUNK}, c AS (SELECT ch.job_id, end_ms - start_ms AS ms, snr, unnest(list_append({P._COND}, 'any')) AS cond FROM ch JOIN iv USING (iv_id)) SELECT job_id, cond, sum(ms)::BIGINT AS ms, median(snr) AS snr FROM c GROUP BY 1, 2")
def a17_quality_summary(spark: SparkSession, d: str) -> DataFrame:
    c = P.chunk_measures(spark, d).select("job_id", (F.col("end_ms") - F.col("start_ms")).alias("ms"), "snr", F.explode(F.array_append(P.conditions(), "any")).alias("cond"))
    return c.groupBy("job_id", "cond").agg(F.sum("ms").alias("ms"), F.percentile("snr", F.lit(0.5)).alias("snr"))


@query(f"""WITH {X.FR}, h AS (SELECT *, frame - row_number() OVER (PARTITION BY job_id ORDER BY frame) AS g FROM fr WHERE p >= 40), e AS (SELECT job_id, min(frame) AS a, max(frame) + 1 AS b, sum(p) AS total, count(*) AS n FROM h GROUP BY job_id, g),
i AS (SELECT *, sum(CASE WHEN a > pb + 2 THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY a) AS m FROM (SELECT *, lag(b) OVER (PARTITION BY job_id ORDER BY a) AS pb FROM e))
SELECT job_id, min(a) * 40 AS start_ms, max(b) * 40 AS end_ms, sum(total)::BIGINT AS total, sum(n)::BIGINT AS frames FROM i GROUP BY job_id, m HAVING (max(b) - min(a)) * 40 >= 120""")
def w06_sound_events(spark: SparkSession, d: str) -> DataFrame:
    """Frames over the threshold as events, merged over gaps of two frames, of three frames at least."""
    h = X.fr(spark, d).where("p >= 40").select("job_id", (F.col("frame") * 40).alias("start_ms"), (F.col("frame") * 40 + 40).alias("end_ms"), "p")
    g = I.islands(h, ["job_id"], 80).groupBy("job_id", "island")
    e = g.agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sum("p").alias("total"), F.count("*").alias("frames"))
    return e.where("end_ms - start_ms >= 120").drop("island")


@query(f"""WITH {X.FR}, en AS (SELECT job_id, min_by(p, frame) AS a, max_by(p, frame) AS z, count(*) AS n FROM fr GROUP BY 1),
w AS (SELECT job_id, frame, p FROM fr UNION ALL SELECT job_id, -k, a FROM en, range(1, 4) r(k) WHERE n >= 3 UNION ALL SELECT job_id, n - 1 + k, z FROM en, range(1, 4) r(k) WHERE n >= 3),
m AS (SELECT job_id, frame, p, median(p) OVER (PARTITION BY job_id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS smooth FROM w)
SELECT job_id, frame, CASE WHEN n >= 3 THEN smooth ELSE p::DOUBLE END AS smooth FROM m JOIN en USING (job_id) WHERE frame >= 0 AND frame < n""")
def w07_running_median(spark: SparkSession, d: str) -> DataFrame:
    return S.running_median(X.fr(spark, d), 3)


# Captions of sound classes, and least lengths of some; others need 400 ms.
CAPTIONS = {"Music": "music", "Singing": "singing", "Choir": "choir singing", "Humming": "humming", "Whistling": "whistling", "Laughter": "laughter", "Applause": "applause", "Clapping": "clapping", "Cheering": "cheering", "Crowd": "crowd chatter", "Crying, sobbing": "crying", "Screaming": "screaming", "Gasp": "gasps", "Sigh": "sighs", "Cough": "coughs", "Sneeze": "sneezes", "Dog": "dog barking", "Bark": "dog barking", "Telephone bell ringing": "phone ringing", "Ringtone": "phone ringing", "Doorbell": "doorbell", "Knock": "knocking", "Gunshot, gunfire": "gunshot", "Explosion": "explosion", "Siren": "siren", "Thunder": "thunder", "Rain": "rain", "Helicopter": "helicopter", "Typing": "typing", "Fireworks": "fireworks"}
LEAST_MS = {"music": 2000, "singing": 1500, "rain": 2000, "crowd chatter": 1500}
#: The kinds of events stand for sound classes; two of them are the same caption.
CLASSES = {"click": "Dog", "view": "Music", "purchase": "Bark", "signup": "Rain", "error": "Static"}
_MAP = ", ".join(f"('{kind}', '{CAPTIONS[c]}', {LEAST_MS.get(CAPTIONS[c], 400)})" for kind, c in CLASSES.items() if c in CAPTIONS)


@query(f"""WITH {X.IV}, e AS (SELECT iv.*, m.tag FROM iv JOIN (VALUES {_MAP}) m(label, tag, least) USING (label) WHERE score >= 60 AND end_ms - start_ms >= least), i AS (SELECT *, sum(CASE WHEN start_ms >= pe + 1000 THEN 1 ELSE 0 END) OVER (PARTITION BY job_id, tag ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, max(end_ms) OVER (PARTITION BY job_id, tag ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM e))
SELECT job_id, tag, min(start_ms) AS start_ms, least(max(end_ms), min(start_ms) + 6000) AS end_ms, count(*) AS events FROM i GROUP BY job_id, tag, g""")
def w28_tag_proposals(spark: SparkSession, d: str) -> DataFrame:
    """Sound events of a class with a caption, sure and long enough, as tags: merged over gaps below a second, six seconds at most. The map is a literal."""
    rows = [(kind, CAPTIONS[c], LEAST_MS.get(CAPTIONS[c], 400)) for kind, c in CLASSES.items() if c in CAPTIONS]
    captions = spark.createDataFrame(rows, "label string, tag string, least int")
    e = X.iv(spark, d).join(F.broadcast(captions), "label").where("score >= 60 AND end_ms - start_ms >= least")
    g = I.islands(e, ["job_id", "tag"], 999).groupBy("job_id", "tag", "island")
    return g.agg(F.min("start_ms").alias("start_ms"), F.least(F.max("end_ms"), F.min("start_ms") + 6000).alias("end_ms"), F.count("*").alias("events")).drop("island")


@query(f"WITH {X.IV}, e AS (SELECT *, lag(label) OVER w AS pl, lag(end_ms) OVER w AS pe FROM iv WINDOW w AS (PARTITION BY job_id ORDER BY start_ms, iv_id)), i AS (SELECT *, sum(CASE WHEN pl = label AND start_ms - pe < 72000 THEN 0 ELSE 1 END) OVER (PARTITION BY job_id ORDER BY start_ms, iv_id ROWS UNBOUNDED PRECEDING) AS g FROM e) SELECT job_id, any_value(label) AS label, min(start_ms) AS start_ms, least(max_by(end_ms, (start_ms, iv_id)), min(start_ms) + 6000) AS end_ms, count(*) AS n FROM i GROUP BY job_id, g")
def w30_frame_tags(spark: SparkSession, d: str) -> DataFrame:
    """Only consecutive frames of one tag merge; the last one ends the tag, after six seconds at most."""
    w = W.partitionBy("job_id").orderBy("start_ms", "iv_id")
    same = (F.lag("label").over(w) == F.col("label")) & (F.col("start_ms") - F.lag("end_ms").over(w) < 72000)
    e = X.iv(spark, d).withColumn("new", F.when(same, 0).otherwise(1)).withColumn("g", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    end = F.least(F.max_by("end_ms", F.struct("start_ms", "iv_id")), F.min("start_ms") + 6000)
    return e.groupBy("job_id", "g").agg(F.first("label").alias("label"), F.min("start_ms").alias("start_ms"), end.alias("end_ms"), F.count("*").alias("n")).drop("g")


@query(f"WITH {X.FR} SELECT job_id, frame // 16 AS bucket, min(p) AS low, max(p) AS high FROM fr WHERE frame // 16 < 2000 GROUP BY 1, 2")
def a20_peaks_per_bucket(spark: SparkSession, d: str) -> DataFrame:
    return S.peaks(X.fr(spark, d).select("job_id", F.col("frame").alias("at"), F.col("p").alias("x")), ["job_id"], 16)


_TABLE = "[" + ", ".join(f"{v}::DOUBLE" for v in S.SNR_STATISTIC) + "]"


@query(f"""WITH s AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings), p AS (SELECT vec_id, max(abs(x)) AS peak FROM s GROUP BY 1),
m AS (SELECT vec_id, 10 * log10(avg(x * x) + 1e-12) AS rms, CASE WHEN max(peak) >= {S.SILENT} THEN ln(avg(greatest(abs(x / peak), {S.LEAST}))) - avg(ln(greatest(abs(x / peak), {S.LEAST}))) END AS g FROM s JOIN p USING (vec_id) GROUP BY 1),
t AS (SELECT *, len(list_filter(tb, lambda v: v <= g)) AS k FROM m, (SELECT {_TABLE} AS tb))
SELECT vec_id, round(rms, 3) AS rms_db, round(CASE WHEN g IS NULL THEN NULL WHEN k = 0 THEN -20 WHEN k = 121 THEN 100 ELSE -21 + k + (g - tb[k]) / (tb[k + 1] - tb[k]) END, 3) AS snr_db FROM t""")
def a18_signal_measures(spark: SparkSession, d: str) -> DataFrame:
    """Level and blind SNR of blocks of samples."""
    s = X.read(spark, d, "embeddings").select("vec_id", F.explode("embedding").alias("v")).select("vec_id", F.col("v").cast("double").alias("x"))
    return S.blind_snr(s, ["vec_id"]).select("vec_id", F.round("rms_db", 3).alias("rms_db"), F.round("snr_db", 3).alias("snr_db"))


@query(f"""WITH {X.FR}, f AS (SELECT job_id, frame, p // 20 AS x FROM fr), k AS (SELECT job_id, count(*) AS n, max(x) AS peak FROM f GROUP BY 1), t AS (SELECT job_id, frame - row_number() OVER (PARTITION BY job_id ORDER BY frame) AS g FROM f JOIN k USING (job_id) WHERE x = peak AND peak > 0),
r AS (SELECT job_id, sum(c)::BIGINT AS clipped FROM (SELECT job_id, g, count(*) AS c FROM t GROUP BY 1, 2 HAVING count(*) >= 3) GROUP BY 1) SELECT k.job_id, n, coalesce(clipped, 0) AS clipped FROM k LEFT JOIN r USING (job_id)""")
def a19_clipping(spark: SparkSession, d: str) -> DataFrame:
    """Samples in runs of three at a job's own peak; the series is coarse, so that there are some."""
    return S.clipped(X.fr(spark, d).select("job_id", F.col("frame").alias("at"), F.floor(F.col("p") / 20).alias("x")), ["job_id"])


@query("""WITH s AS (SELECT vec_id, i, embedding[i + 1]::DOUBLE * (0.5 - 0.5 * cos(2 * pi() * i / 63)) AS x FROM (SELECT vec_id, embedding, unnest(range(0, 64)) AS i FROM embeddings WHERE len(embedding) >= 64)),
b AS (SELECT vec_id, k, pow(sum(x * cos(2 * pi() * i * k / 64)), 2) + pow(sum(x * sin(2 * pi() * i * k / 64)), 2) AS power FROM s, (SELECT unnest(range(0, 33)) AS k) GROUP BY 1, 2)
SELECT e.vec_id, round(sum(CASE WHEN k >= 16 THEN power END) / nullif(sum(power), 0), 6) AS share FROM (SELECT DISTINCT vec_id FROM embeddings) e LEFT JOIN b USING (vec_id) GROUP BY 1""")
def a21_high_share(spark: SparkSession, d: str) -> DataFrame:
    """Share of energy in the upper half of the band of blocks of samples."""
    frames = X.read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("frame"))
    return S.high_share(frames, "vec_id", 64).select("vec_id", F.round("share", 6).alias("share"))


_WINDOWS = "wi AS (SELECT job_id, s // 90000 AS window_id, s AS from_ms, s + 90000 AS to_ms FROM (SELECT job_id, unnest(range(0, max(end_ms), 90000)) AS s FROM tok GROUP BY 1))"


@query(f"""WITH {X.TOK}, {_WINDOWS} SELECT wi.job_id, window_id, CASE WHEN t.start_ms < from_ms THEN 'before' WHEN t.start_ms >= to_ms THEN 'after' ELSE 'center' END AS role, count(*) AS words, min(idx) AS first, max(idx) AS last FROM tok t JOIN wi ON t.job_id = wi.job_id AND t.start_ms >= from_ms - 20000 AND t.start_ms < to_ms + 20000 GROUP BY 1, 2, 3""")
def w46_window_words(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 90 s, each with the words of 20 s before and after it, by their role."""
    t = X.tok(spark, d)
    jobs = t.groupBy("job_id").agg(F.max("end_ms").alias("duration_ms"))
    windows = I.fixed_chunks(jobs, 90000).select("job_id", F.col("chunk_id").alias("window_id"), F.col("start_ms").alias("from_ms"), (F.col("start_ms") - 20000).alias("start_ms"), (F.col("start_ms") + 110000).alias("end_ms"))
    words = t.select("job_id", "idx", "start_ms", (F.col("start_ms") + 1).alias("end_ms"))
    at, begin = F.col("l.start_ms"), F.col("r.from_ms")
    role = F.when(at < begin, "before").when(at >= begin + 90000, "after").otherwise("center")
    return I.interval_join(words, windows, 30000).groupBy("l.job_id", "r.window_id", role.alias("role")).agg(F.count("*").alias("words"), F.min("l.idx").alias("first"), F.max("l.idx").alias("last"))
