"""Queries of sound tags: what they stand for, and where they are shown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelattice.functions import text as T
from cuelattice.operators import tags as G
from cuelattice.plans import fixtures as X
from cuelattice.plans.book import query
from cuelattice.plans.layout_queries import _TAGS

#: The given events stand for detected sounds.
SOUNDS = {"laughs": "click", "music": "view"}


@query(f"""WITH {X.CUE}, {X.IV}, t AS (SELECT job_id, cue_id AS tag_id, CASE role WHEN 'user' THEN 'Laughs' ELSE 'loud music' END AS tag, row_number() OVER (PARTITION BY job_id, role = 'user' ORDER BY cue_id) AS k, CASE role WHEN 'user' THEN 'click' ELSE 'view' END AS label FROM cue WHERE (job_id + cue_id) % 3 = 0),
e AS (SELECT *, row_number() OVER (PARTITION BY job_id, label ORDER BY start_ms, iv_id) AS k FROM iv) SELECT t.job_id, tag_id, tag, iv_id AS event_id, start_ms, end_ms FROM t LEFT JOIN e ON e.job_id = t.job_id AND e.label = t.label AND e.k = t.k""")
def j11_matched_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags of every third turn, and the events of the same job that they stand for, one to one and in order."""
    c = X.cue(spark, d).where("(job_id + cue_id) % 3 = 0")
    tags = c.select("job_id", F.col("cue_id").alias("tag_id"), F.when(F.col("role") == "user", "Laughs").otherwise("loud music").alias("tag"))
    return G.matched(tags, X.iv(spark, d).select("job_id", F.col("iv_id").alias("event_id"), "label", "start_ms", "end_ms"), SOUNDS)


_STEP = "CASE WHEN a.s < x.c[1] AND a.e > x.c[1] THEN x.c[1] - 50 ELSE a.e END"


@query(f"""WITH {_TAGS}, dl AS (SELECT job_id, start_ms AS a, end_ms AS b FROM tg WHERE tag = 'purchase'),
n AS (SELECT t.tag_id, list({{'s': 0::BIGINT, 'e': 0::BIGINT, 'c': [a, b]}} ORDER BY a, b) AS cs, bool_or(a <= start_ms AND b >= end_ms) AS own FROM tg t JOIN dl ON dl.job_id = t.job_id AND a < end_ms AND start_ms < b WHERE tag <> 'purchase' GROUP BY 1),
f AS (SELECT job_id, t.tag_id, tag, start_ms, end_ms, CASE WHEN own OR cs IS NULL THEN {{'s': start_ms::BIGINT, 'e': end_ms::BIGINT, 'c': []::BIGINT[]}} ELSE list_reduce(list_prepend({{'s': start_ms::BIGINT, 'e': end_ms::BIGINT, 'c': []::BIGINT[]}}, cs), lambda a, x: {{'s': CASE WHEN a.s < x.c[2] AND ({_STEP}) > x.c[2] THEN x.c[2] + 50 ELSE a.s END, 'e': {_STEP}, 'c': []::BIGINT[]}}) END AS m FROM tg t LEFT JOIN n USING (tag_id) WHERE tag <> 'purchase')
SELECT job_id, tag_id, tag, CASE WHEN m.e <= m.s AND m.e <> end_ms THEN greatest(0, m.e - (end_ms - start_ms)) ELSE m.s END AS start_ms, CASE WHEN m.e <= m.s AND m.e = end_ms AND m.s <> start_ms THEN m.s + (end_ms - start_ms) ELSE m.e END AS end_ms FROM f""")
def w29_tags_beside_dialogue(spark: SparkSession, d: str) -> DataFrame:
    """Events as tags, moved out of purchases, which stand for dialogue."""
    length = 2000 + F.floor(F.col("value") * 1000) % 3000
    start = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) div 1000")
    t = X.read(spark, d, "events").select(F.col("event_id").alias("tag_id"), F.col("user_id").alias("job_id"), F.col("event_type").alias("tag"), start.alias("start_ms"), (start + length).alias("end_ms"))
    return G.beside_dialogue(t.where("tag <> 'purchase'"), t.where("tag = 'purchase'").select("job_id", "start_ms", "end_ms"))


@query()
def w37_placed_tags(spark: SparkSession, d: str) -> DataFrame:
    """Turns with their tags, one or two before every seventh, as cues of their own or within their neighbours."""
    c = X.cue(spark, d)
    tagged, at = F.col("text").startswith("[music] "), F.col("cue_id").cast("long") * 4
    speech = c.select("job_id", (at + 2).alias("place"), T.strip_tags(F.col("text")).alias("text"), "start_ms", "end_ms", F.lit(False).alias("is_tag"))
    names = F.when((F.col("job_id") + F.col("cue_id")) % 2 == 0, F.array(F.lit("[music]"), F.lit("[applause]"))).otherwise(F.array(F.lit("[music]")))
    tags = c.where(tagged).select("job_id", "cue_id", F.posexplode(names).alias("k", "text"))
    none = F.lit(None).cast("long")
    tags = tags.select("job_id", (F.col("cue_id").cast("long") * 4 + F.col("k")).alias("place"), "text", none.alias("start_ms"), none.alias("end_ms"), F.lit(True).alias("is_tag"))
    return G.placed(speech.unionByName(tags))
