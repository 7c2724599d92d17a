"""URL filters: explicit rules first, then empirical-Bayes host reputation. DataFrame functions only.

Labelled page outcomes (bad or not) are counted per host, registered domain (the host's last two labels) and
suffix (its last label). From the top down, each level's bad rate is shrunk towards its parent's posterior mean
through a beta-binomial prior. A level's prior strength M comes from the data by moments: with the parent's mean m,
k bad of n varies by n m (1-m) (1 + (n-1) rho), rho = 1 / (M+1). A host whose posterior mean less z standard
deviations exceeds the limit is blocked.

Defined cases: a null url, or one without '://', has empty host and path and belongs to the host ''; a page
without an outcome is judged by its host all the same; without any outcome every host has bad rate 0 and is
allowed; several outcomes of a page count once, as bad if any is; repeated pages each give a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, start of path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Posterior standard deviations that the bound keeps from the mean; bad rate from which a host is blocked.
Z, LIMIT = 1.0, 0.5
#: Bounds of rho, the correlation of outcomes below one parent; they keep prior strengths between 1 and 999.
RHO_LEAST, RHO_MOST = 0.001, 0.5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def first_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null if none does. Of equally long ones, the longer host's."""
    fits = [(h + p, v, ((host == h) | host.endswith("." + h)) & path.startswith(p)) for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r))]
    pick = lambda k: F.coalesce(*[F.when(fit[2], F.lit(fit[k])) for fit in fits], F.lit(None).cast("string"))
    return pick(0), pick(1)


def outcomes(labels: DataFrame) -> DataFrame:
    """page_id, bad (0 or 1): low quality or toxic, by the labels of the same id."""
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    return labels.where(F.col("doc_id").isNotNull() & (F.col("quality").isNotNull() | F.col("toxic").isNotNull())).groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad).alias("bad"))


def _shrunk(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """children with `mean`, `m_up` and `strength` from their parents' posterior means. key: the parent's name in both."""
    both = children.join(parents.select(key, F.col("mean").alias("m_up")), key)
    v = F.col("m_up") * (1 - F.col("m_up"))
    over = F.sum((F.col("k") - F.col("n") * F.col("m_up")) ** 2 - F.col("n") * v)
    rho = F.greatest(F.lit(RHO_LEAST), F.least(F.lit(RHO_MOST), F.coalesce(over / F.nullif(F.sum(F.col("n") * (F.col("n") - 1) * v), F.lit(0.0)), F.lit(RHO_MOST))))
    fitted = both.groupBy("root").agg((1 / rho - 1).alias("strength"))
    both = both.join(F.broadcast(fitted), "root")  # one row
    return both.withColumn("mean", (F.col("k") + F.col("strength") * F.col("m_up")) / (F.col("n") + F.col("strength")))


def host_reputation(pages: DataFrame, outcome: DataFrame) -> DataFrame:
    """host, n labelled pages, k bad ones, posterior mean and lower bound of its bad rate. pages: page_id, host."""
    seen = pages.join(outcome, "page_id", "left")
    tail = lambda n: F.substring_index("host", ".", -n)
    count = lambda df, *by: df.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    hosts = seen.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    hosts = hosts.select(F.lit(0).alias("root"), tail(1).alias("suffix"), tail(2).alias("domain"), "host", "n", "k")
    domains = count(hosts, "root", "suffix", "domain")
    suffixes = count(domains, "root", "suffix")
    world = count(suffixes, "root").select("root", (F.coalesce(F.col("k") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0))).alias("mean"))
    suffixes = _shrunk(suffixes, world, "root")
    domains = _shrunk(domains, suffixes, "suffix")
    hosts = _shrunk(hosts, domains, "domain")
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("strength") + 1))
    return hosts.select("host", "n", "k", "mean", (F.col("mean") - Z * sd).alias("bound"))


def judged(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, limit: float = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict of every page. A hot host is one row on the reputation side of the last
    join; its pages are dealt anew by adaptive skew handling, and counted per map task before the first shuffle."""
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    bad = host_reputation(urls.select("page_id", "host"), outcomes(labels)).where(F.col("bound") > limit).select("host", F.lit("block").alias("by_host"))
    rule, verdict = first_rule(F.col("host"), F.col("path"), rules)
    return urls.join(bad, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("by_host"), F.lit("allow")).alias("verdict"))


def _shrunk_sql(name: str, children: str, parents: str, key: str) -> str:
    return f"""
{name}0 AS (SELECT c.*, p.mean AS m_up FROM {children} c JOIN {parents} p ON c.{key} = p.{key}),
{name}1 AS (SELECT 1 / greatest({RHO_LEAST}, least({RHO_MOST}, coalesce(sum((k - n * m_up) * (k - n * m_up) - n * m_up * (1 - m_up)) / nullif(sum(n * (n - 1) * m_up * (1 - m_up)), 0), {RHO_MOST}))) - 1 AS strength FROM {name}0),
{name} AS (SELECT c.*, s.strength, (k + strength * m_up) / (n + strength) AS mean FROM {name}0 c, {name}1 s)"""


def _sql() -> str:
    fits = [(h + p, v, f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')") for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
    case = lambda k: "CASE " + " ".join(f"WHEN {f[2]} THEN '{f[k]}'" for f in fits) + " END"
    return f"""WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '{URL}', 1), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(url, '{URL}', 2), '') AS path FROM pages),
o AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY 1),
h AS (SELECT host, regexp_extract(host, '([^.]*)$', 1) AS suffix, regexp_extract(host, '([^.]*\\.)?[^.]*$', 0) AS domain, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS k, 0 AS root FROM u LEFT JOIN o USING (page_id) GROUP BY 1, 2, 3),
d AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k, 0 AS root FROM h GROUP BY 1, 2),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k, 0 AS root FROM d GROUP BY 1),
w AS (SELECT 0 AS root, coalesce(sum(k) / nullif(sum(n), 0), 0) AS mean FROM s),{_shrunk_sql("sp", "s", "w", "root")},{_shrunk_sql("dp", "d", "sp", "suffix")},{_shrunk_sql("hp", "h", "dp", "domain")},
b AS (SELECT host FROM hp WHERE mean - {Z} * sqrt(mean * (1 - mean) / (n + strength + 1)) > {LIMIT})
SELECT page_id, host, path, {case(0)} AS rule, coalesce({case(1)}, CASE WHEN host IN (SELECT host FROM b) THEN 'block' ELSE 'allow' END) AS verdict FROM u"""


SQL = _sql()
