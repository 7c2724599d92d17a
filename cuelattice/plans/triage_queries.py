"""Queries of review: all features of cues, tiers with reasons, examples of corrections and weights fitted to them.

Cues are eight words of a transcript, aligned with three engines. A word lies where the first words equal to it were heard, and ends where the next begins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelattice.operators import cues as C
from cuelattice.operators import triage as R
from cuelattice.plans import fixtures as X
from cuelattice.plans import lists as L
from cuelattice.plans.book import query

CUE_WORDS, SOUND_MS = 8, 6000
_HEARD = L.HEARD


def _featured(spark: SparkSession, d: str) -> DataFrame:
    return R.rated(L.cue_sums(spark, d, CUE_WORDS, SOUND_MS))


_COUNTS = {"disputed": f"coalesce(text_conf, {R.NO_TEXT_CONF}) < {R.LOW_TEXT}", "weak": f"coalesce(timing_conf, {R.NO_TIMING_CONF}) < {R.WEAK_TIMING}", "uncertain": f"coalesce(timing_conf, {R.NO_TIMING_CONF}) < {R.WEAK_TIMING} AND NOT interpolated", "not_heard": "heard_by = 0", "placed": "interpolated", "odd": f"NOT (end_ms - start_ms BETWEEN {R.LEAST_WORD_MS} AND {R.MOST_WORD_MS})"}
_SOUNDING = "lambda x: NOT regexp_matches(lower(x), '\\?|inaudible|unintelligible|[0-9]{2}:[0-9]{2}')"
_FEATURED = f"""WITH {X.ALIGNED}, a AS (SELECT job_id, idx, count(CASE WHEN same THEN 1 END) AS heard_by, min(CASE WHEN same THEN start_ms END) AS said_ms, sum(CASE WHEN same THEN conf END) // (10 * count(CASE WHEN same THEN 1 END)) AS timing_conf FROM am GROUP BY 1, 2),
w0 AS (SELECT t.job_id, t.idx, t.word, t.idx // {CUE_WORDS} AS cue_id, coalesce(a.said_ms, t.start_ms) AS start_ms, t.end_ms, coalesce(heard_by, 0) AS heard_by, timing_conf FROM tok t LEFT JOIN a USING (job_id, idx)),
w AS (SELECT job_id, idx, word, cue_id, start_ms, heard_by, timing_conf, heard_by * 100 // 3 AS text_conf, heard_by = 0 AS interpolated, coalesce(lead(start_ms) OVER (PARTITION BY job_id ORDER BY idx), end_ms) AS end_ms FROM w0),
c0 AS (SELECT job_id, cue_id, (job_id + cue_id) AS key, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(word, ' ' ORDER BY idx) AS text FROM w GROUP BY 1, 2),
c AS (SELECT * REPLACE (CASE WHEN key % 17 = 0 THEN '[music]' WHEN key % 9 = 0 THEN '[applause] ' || text WHEN key % 5 = 0 THEN text || ' [inaudible 00:01:02]' ELSE text END AS text) FROM c0),
b AS (SELECT *, len(list_filter(regexp_extract_all(text, '\\[[^\\]]+\\]'), {_SOUNDING})) > 0 AS has FROM c),
b2 AS (SELECT job_id, cue_id, start_ms, end_ms, ((has OR coalesce(lag(has) OVER v, false) OR coalesce(lead(has) OVER v, false)) AND NOT (has AND regexp_matches(text, '^\\[[^\\]]*\\]$')))::INT AS beside_tag FROM b WINDOW v AS (PARTITION BY job_id ORDER BY start_ms, cue_id)),
s AS (SELECT DISTINCT job_id, start_ms // {SOUND_MS} AS k FROM tok), so AS (SELECT job_id, k * {SOUND_MS} AS s0, (k + 1) * {SOUND_MS} AS s1, [{', '.join(f"'{c}'" for c in _HEARD)}][((job_id * 5 + k * 3) % 23 + 1)::INT] AS label FROM s WHERE (job_id * 5 + k * 3) % 23 < {len(_HEARD)}),
co AS (SELECT c.job_id, c.cue_id, {', '.join(f"max((label = '{n}')::INT) AS {n}" for n in _HEARD)} FROM c JOIN so ON so.job_id = c.job_id AND s1 > c.start_ms AND s0 < greatest(c.end_ms, c.start_ms + 1) GROUP BY 1, 2),
g AS (SELECT c.job_id, c.cue_id, count(*) AS removed FROM c JOIN (SELECT job_id, engine, pos, start_ms AS said_ms FROM heard ANTI JOIN am USING (job_id, engine, pos)) h ON h.job_id = c.job_id AND said_ms BETWEEN c.start_ms - {R.REMOVED_WITHIN_MS} AND c.end_ms + {R.REMOVED_WITHIN_MS} GROUP BY 1, 2),
n AS (SELECT job_id, cue_id, count(*) AS n, sum(100 - coalesce(text_conf, 100)) AS doubt, {', '.join(f"sum(({e})::INT) AS {k}" for k, e in _COUNTS.items())}, coalesce(sum(CASE WHEN interpolated THEN end_ms - start_ms END), 0)::BIGINT AS placed_ms FROM w GROUP BY 1, 2),
f AS (SELECT b2.*, n.* EXCLUDE (job_id, cue_id), {', '.join(f"coalesce({c}, 0) AS {c}" for c in _HEARD)}, coalesce(removed, 0) AS removed, doubt / (100.0::DOUBLE * n) AS text_error, disputed / n::DOUBLE AS low_text, (disputed > 0)::INT AS disputed_any, weak / n::DOUBLE AS weak_timing, (weak > 0)::INT AS weak_timing_any,
 placed / n::DOUBLE AS interpolated, not_heard / n::DOUBLE AS unheard, (not_heard > 0)::INT AS unheard_any, least(1, coalesce(removed, 0) / 3.0::DOUBLE) AS hallucination, odd / n::DOUBLE AS implausible FROM b2 JOIN n USING (job_id, cue_id) LEFT JOIN co USING (job_id, cue_id) LEFT JOIN g USING (job_id, cue_id))"""
_SHOWN = ["text_error", "low_text", "weak_timing", "interpolated", "unheard", "hallucination", "implausible"]


@query(f"{_FEATURED} SELECT job_id, cue_id, n, {', '.join(f'round({k}, 6) AS {k}' if k in _SHOWN else k for k in R.FEATURES)} FROM f")
def a22_triage_features(spark: SparkSession, d: str) -> DataFrame:
    """Every cue with all 19 features of its risk."""
    return _featured(spark, d).select("job_id", "cue_id", "n", *[F.round(k, 6).alias(k) if k in _SHOWN else F.col(k) for k in R.FEATURES])


_NUMBER = "{0} || CASE WHEN {0} = 1 THEN ' word' ELSE ' words' END".format
_SCORED = f"""{_FEATURED}, z AS (SELECT *, 1 / (1 + exp(-greatest(-30, least(30, {C.BIAS} + {' + '.join(f'{C.WEIGHTS[k]} * {k}' for k in R.FEATURES)})))) AS risk, least(1, greatest(0, unheard - 1 / n)) AS est FROM f),
t AS (SELECT *, CASE WHEN est >= {C.REDO} THEN 'redo' WHEN risk < {C.ACCEPT} THEN 'accept' ELSE 'quick_check' END AS tier, concat_ws('; ', {', '.join(f"CASE WHEN {k} > 0 THEN '{v}' END" for k, v in R.CONDITIONS.items())}, CASE WHEN not_heard > 0 THEN 'no engine heard ' || {_NUMBER('not_heard')} || ' (check the transcript)' END,
 CASE WHEN placed > 0 THEN (placed_ms + 50) // 1000 || '.' || ((placed_ms + 50) // 100) % 10 || ' s interpolated (' || {_NUMBER('placed')} || ')' END, CASE WHEN uncertain > 0 THEN 'uncertain timing on ' || {_NUMBER('uncertain')} END, CASE WHEN removed > 0 THEN 'hallucination filter removed ' || {_NUMBER('removed')} || ' here' END, CASE WHEN odd > 0 THEN 'implausible word durations' END) AS reasons FROM z)"""


@query(f"{_SCORED} SELECT job_id, cue_id, round(risk, 6) AS risk, round(est, 6) AS est_error, tier, reasons FROM t")
def w45_triage_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Every cue's risk by all features, predicted share of errors, tier, and what the reviewer is told."""
    return R.scored(_featured(spark, d)).select("job_id", "cue_id", F.round("risk", 6).alias("risk"), F.round("est_error", 6).alias("est_error"), "tier", F.array_join("reasons", "; ").alias("reasons"))


_LABELS = "y AS (SELECT t.job_id, t.idx // {0} AS cue_id, (count(CASE WHEN NOT coalesce(h.same, false) THEN 1 END) > 0 OR coalesce(abs(min(h.start_ms) - min(t.start_ms)) > 150, false))::INT AS label FROM tok t LEFT JOIN am h ON h.job_id = t.job_id AND h.idx = t.idx AND h.engine = 'a' GROUP BY 1, 2)".format(CUE_WORDS)


def _examples(spark: SparkSession, d: str) -> DataFrame:
    """All features, and whether the transcript corrects what engine a delivered for the cue: a word of it, or its start by over 150 ms."""
    return _featured(spark, d)


@query(f"{_FEATURED}, {_LABELS} SELECT job_id, cue_id, label, {', '.join(f'round({k}, 6) AS {k}' if k in _SHOWN else k for k in R.FEATURES)} FROM f JOIN y USING (job_id, cue_id)")
def a33_triage_examples(spark: SparkSession, d: str) -> DataFrame:
    return _examples(spark, d).select("job_id", "cue_id", "label", *[F.round(k, 6).alias(k) if k in _SHOWN else F.col(k) for k in R.FEATURES])


@query()
def a32_triage_weights(spark: SparkSession, d: str) -> DataFrame:
    """All 19 weights and the bias, fitted to what corrections say of the cues."""
    return R.fitted(_examples(spark, d))
