"""Queries of made-up words: loops and stock phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelattice.operators import align as A
from cuelattice.operators import hallucinations as H
from cuelattice.plans import fixtures as X
from cuelattice.plans import lists as L
from cuelattice.plans.book import query

#: Transcripts with "thank you" in each long pause, and a series of speech probabilities: one value per word and pause.
_SAID = f"""WITH {X.TOK}, ws AS MATERIALIZED (SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY idx, sub) - 1 AS idx, norm, start_ms, end_ms, p FROM (SELECT job_id, idx, 0 AS sub, norm, start_ms, end_ms, (job_id * 11 + idx * 17) % 100 AS p FROM tok
 UNION ALL SELECT job_id, idx, sub, CASE sub WHEN 1 THEN 'thank' ELSE 'you' END, end_ms + 600 + sub * 300, end_ms + 800 + sub * 300, (job_id * 13 + idx * 7) % 60 FROM tok, (VALUES (1), (2)) v(sub) WHERE (idx + 1) % 25 = 0)),
fm AS (SELECT job_id, start_ms, end_ms, p FROM ws)"""


def _said(spark: SparkSession, d: str) -> DataFrame:
    t = A.spread(X.tok(spark, d), "job_id")
    spoken = t.select("job_id", "idx", F.lit(0).alias("sub"), "norm", "start_ms", "end_ms", ((F.col("job_id") * 11 + F.col("idx") * 17) % 100).alias("p"))
    made = t.where("(idx + 1) % 25 = 0").select("*", F.posexplode(F.array(F.lit("thank"), F.lit("you"))).alias("at", "said"))
    start = F.col("end_ms") + 900 + F.col("at") * 300
    made = made.select("job_id", "idx", (F.col("at") + 1).alias("sub"), F.col("said").alias("norm"), start.alias("start_ms"), (start + 200).alias("end_ms"), ((F.col("job_id") * 13 + F.col("idx") * 7) % 60).alias("p"))
    place = F.row_number().over(W.partitionBy("job_id").orderBy("idx", "sub")) - 1
    return spoken.unionByName(made).select("job_id", place.cast("long").alias("idx"), "norm", "start_ms", "end_ms", "p")


_KEPT = "unnest(list_reduce(list_prepend([]::STRUCT(f BIGINT, u BIGINT, n BIGINT, r BIGINT, t VARCHAR)[], list_transform(list({0} ORDER BY f), lambda x: [x])), lambda a, x: CASE WHEN len(a) = 0 OR x[1].f >= a[-1].u THEN list_concat(a, x) ELSE a END)) AS k"
#: Equal words n places apart in runs; a loop of n words begins n before such a run or later within it.
_LOOPS = f"""{_SAID}, en AS (SELECT ws.job_id, n, ws.idx, ws.idx - row_number() OVER (PARTITION BY ws.job_id, n ORDER BY ws.idx) AS g FROM ws JOIN (SELECT unnest(range(1, 9)) AS n) ON true JOIN ws b ON b.job_id = ws.job_id AND b.idx = ws.idx - n AND b.norm = ws.norm),
rn AS (SELECT job_id, n, min(idx) AS lo, max(idx) AS hi FROM en GROUP BY job_id, n, g), cn AS (SELECT job_id, n, i AS first, 1 + (hi - (i + n) + 1) // n AS repeats FROM (SELECT *, unnest(range(lo - n, hi - n + 1)) AS i FROM rn)),
cd AS (SELECT * FROM (SELECT DISTINCT cn.job_id, first, n, repeats FROM cn JOIN ws ON ws.job_id = cn.job_id AND ws.idx >= first AND ws.idx < first + n AND ws.norm <> '' WHERE repeats >= CASE WHEN n = 1 THEN 4 ELSE 3 END) QUALIFY row_number() OVER (PARTITION BY job_id, first ORDER BY repeats * n DESC, n) = 1),
lp AS (SELECT job_id, k.f AS first, k.n AS n, k.r AS repeats, k.u AS until FROM (SELECT job_id, {_KEPT.format("{'f': first::BIGINT, 'u': (first + n * repeats)::BIGINT, 'n': n::BIGINT, 'r': repeats::BIGINT, 't': ''}").replace("ORDER BY f", "ORDER BY first")} FROM cd GROUP BY 1))"""


@query(f"{_LOOPS} SELECT job_id, first, n::INT AS n, repeats, until FROM lp")
def w17_loops(spark: SparkSession, d: str) -> DataFrame:
    """Phrases of one to eight words said several times back to back."""
    return H.loops(_said(spark, d))


_SPEECH = "SELECT s.job_id, s.first, avg(fm.p) AS speech, any_value(s0) AS s0, any_value(e0) AS e0 FROM (SELECT {0}.job_id, first, min(start_ms) AS s0, max(end_ms) AS e0 FROM {0} JOIN ws ON ws.job_id = {0}.job_id AND ws.idx >= first AND ws.idx < until GROUP BY 1, 2) s JOIN fm ON fm.job_id = s.job_id AND fm.start_ms < e0 AND s0 < fm.end_ms GROUP BY 1, 2"


@query(f"""{_LOOPS}, tm AS (SELECT job_id, i AS first, i + n AS until, repeats, repeats >= CASE n WHEN 1 THEN 7 WHEN 2 THEN 5 ELSE 4 END AS sure FROM (SELECT *, unnest(range(first + n, until, n)) AS i FROM lp)),
sp AS ({_SPEECH.format("tm")}) SELECT job_id, unnest(range(first, until)) AS idx, repeats FROM tm LEFT JOIN sp USING (job_id, first) WHERE sure OR speech < 35""")
def w17_loop_removals(spark: SparkSession, d: str) -> DataFrame:
    """Words of loops to remove: sure ones, and others where there is little speech."""
    return L.loop_removals(spark, d)


_PHRASES = ", ".join("'" + p + "'" for p in H.STOCK)


@query(f"""{_SAID}, ph AS (SELECT p AS phrase, len(string_split(p, ' ')) AS n FROM (SELECT unnest([{_PHRASES}]) AS p)), fw AS (SELECT job_id, idx, n, string_agg(b, ' ' ORDER BY j) AS text FROM (SELECT ws.job_id, ws.idx, n, b.idx AS j, b.norm AS b FROM ws JOIN (SELECT DISTINCT n FROM ph) ON true JOIN ws b ON b.job_id = ws.job_id AND b.idx >= ws.idx AND b.idx < ws.idx + n WHERE ws.norm IN (SELECT string_split(phrase, ' ')[1] FROM ph)) GROUP BY 1, 2, 3 HAVING count(*) = n),
cd AS (SELECT job_id, idx AS first, fw.n AS n, phrase FROM fw JOIN ph ON ph.n = fw.n AND ph.phrase = fw.text QUALIFY row_number() OVER (PARTITION BY job_id, idx ORDER BY fw.n DESC) = 1),
kp AS (SELECT job_id, k.f AS first, k.u AS until, k.t AS phrase FROM (SELECT job_id, {_KEPT.format("{'f': first::BIGINT, 'u': (first + n)::BIGINT, 'n': n::BIGINT, 'r': 0::BIGINT, 't': phrase}").replace("ORDER BY f", "ORDER BY first")} FROM cd GROUP BY 1)),
sp AS ({_SPEECH.format("kp")}), al AS (SELECT kp.*, s0 - b.end_ms AS back, a.start_ms - e0 AS ahead, speech FROM kp JOIN sp USING (job_id, first) LEFT JOIN ws b ON b.job_id = kp.job_id AND b.idx = first - 1 LEFT JOIN ws a ON a.job_id = kp.job_id AND a.idx = until)
SELECT job_id, unnest(range(first, until)) AS idx, phrase FROM al WHERE coalesce(back >= 800, true) AND coalesce(ahead >= 800, true) AND speech < 35""")
def w18_stock_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Words of stock phrases that stand alone in silence."""
    s = _said(spark, d)
    return H.stock_removals(s, s.select("job_id", "start_ms", "end_ms", "p"))
