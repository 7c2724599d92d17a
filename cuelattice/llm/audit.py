"""Filter interaction audit: what every filter removes in every order of the filters, from one pass over the texts.

What becomes of a document at each step of each order depends only on its mask, the set of filters that it fails. A mask is mapped to
one big integer with a field of 64 bits per order, step and outcome: 1 where that is what happens to such a document. The integers of a
part's documents are summed, so that the fields are counts; no field overflows, as a part has less than 2^63 documents. Documents are
counted per part and mask first (at most 32 rows a part, whatever its size), so a sum is that of each mask's integer times its count.

E asks for the smallest doc_id of the same text table-wide. Rows are counted by (sha256 of text, part, mask) before they meet by text,
so a text that a third of all rows repeat is a few rows there.

Defined cases: a null text is the empty text, a null source the part ''. A row without doc_id fails no E and is no one's smaller copy;
rows that repeat a doc_id count each, and none of them is smaller than the other. A document is good (toxic) if any label row of its
doc_id says so. An empty table has no part and gives no row.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FILTERS = "ABCDE"
ORDERS = ["".join(o) for o in itertools.permutations(FILTERS)]
#: What can become of a document at a step: it is left after it, goes there, would have gone there, or goes there and nowhere else.
OUTCOMES = ("kept", "removed", "redundant", "unique_fails")
#: Bits of a field.
WIDTH = 64
SPACE = r"\x20\x09-\x0D"
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def outcome_fields(mask: int) -> np.ndarray:
    """0 or 1 by (order, step, outcome) for documents that fail the filters of mask (bit 0: A)."""
    out = np.zeros((len(ORDERS), len(FILTERS), len(OUTCOMES)), "<u8")
    for i, order in enumerate(ORDERS):
        gone = False
        for k, letter in enumerate(order):
            bit = 1 << FILTERS.index(letter)
            fails = bool(mask & bit)
            out[i, k] = (not gone and not fails, fails and not gone, fails and gone, mask == bit)
            gone |= fails
    return out


def packed(mask: int) -> int:
    """The fields as one big integer, the first in the lowest bits."""
    return int.from_bytes(outcome_fields(mask).tobytes(), "little")


def unpacked(total: int) -> np.ndarray:
    """Counts by (order, step, outcome)."""
    n = len(ORDERS) * len(FILTERS) * len(OUTCOMES)
    return np.frombuffer(total.to_bytes(n * WIDTH // 8, "little"), "<u8").reshape(len(ORDERS), len(FILTERS), len(OUTCOMES)).astype("int64")


def text_mask(text: Column) -> Column:
    """Bits of A to D. A column of its own holds the words, so that texts are split once."""
    n, upper = F.col("n_words"), F.regexp_count(text, F.lit("[A-Z]"))
    fails = (n < 50, F.col("n_distinct") * 100 < n * 65, upper * 100 > F.length(text) * 5, text.rlike("[#$%&*|]"))
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails[1:], 1)), F.when(fails[0], 1).otherwise(0))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n documents, good and toxic ones: at most 32 rows a part."""
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id"))
    marks = marks.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).withColumn("named", F.lit(True))
    rows = docs.select(F.coalesce("source", F.lit("")).alias("part"), "doc_id", F.coalesce("text", F.lit("")).alias("t"))
    bare = F.btrim(F.col("t"), F.lit(" \t\n\x0b\f\r"))
    rows = rows.select("*", F.when(F.length(bare) > 0, F.split(bare, f"[{SPACE}]+")).otherwise(F.array().cast("array<string>")).alias("words"))
    rows = rows.select("part", "doc_id", "t", F.size("words").alias("n_words"), F.size(F.array_distinct("words")).alias("n_distinct"))
    rows = rows.select("part", "doc_id", F.unhex(F.sha2("t", 256)).alias("h"), text_mask(F.col("t")).alias("mask"))
    # Rows without doc_id meet no label; their key is spread by the text.
    key = F.coalesce("doc_id", F.xxhash64("h")).alias("id"), F.col("doc_id").isNotNull().alias("named")
    rows = rows.select("*", *key).join(marks, ["id", "named"], "left").na.fill(0, ["good", "toxic"])
    alike = ["h", "part", "mask", "good", "toxic"]
    same = rows.groupBy("id", "named", *alike).agg(F.count("*").alias("n"))
    # Of rows alike, how many there are, the smallest doc_id, and how many have it.
    least = F.min(F.when(F.col("named"), F.struct("id", "n"))).alias("least")
    same = same.groupBy(*alike).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(~F.col("named"), F.col("n"))), F.lit(0)).alias("nameless"), least)
    same = same.withColumn("first", F.min("least.id").over(W.partitionBy("h")))
    firsts = F.col("nameless") + F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0)
    both = F.explode(F.array(F.struct("mask", firsts.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - firsts).alias("n")))).alias("g")
    c = same.select("part", "good", "toxic", both).where("g.n > 0")
    return c.groupBy("part", F.col("g.mask").alias("mask")).agg(F.sum("g.n").alias("n"), F.sum(F.col("g.n") * F.col("good")).alias("good"), F.sum(F.col("g.n") * F.col("toxic")).alias("toxic"))


def audited(counts: DataFrame) -> DataFrame:
    """Per part 600 rows, from `masks`."""

    def steps(rows: pd.DataFrame) -> pd.DataFrame:
        integers = [packed(m) for m in rows["mask"]]
        every, good, toxic = (unpacked(sum(int(n) * p for n, p in zip(rows[c], integers, strict=True))) for c in ("n", "good", "toxic"))
        gone = OUTCOMES.index("removed")
        order = [o for o in ORDERS for _ in FILTERS]
        letter = np.array([FILTERS.index(x) for o in ORDERS for x in o])
        removed = every[..., gone].ravel()
        share = np.zeros(len(FILTERS), np.int64)
        np.add.at(share, letter, removed)
        out = {"part": rows["part"].iloc[0], "filter_order": order, "step": np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS))}
        out |= {name: every[..., k].ravel() for k, name in enumerate(OUTCOMES)}
        return pd.DataFrame(out | {"good_lost": good[..., gone].ravel(), "toxic_lost": toxic[..., gone].ravel(), "shapley": share[letter]})

    return counts.groupBy("part").applyInPandas(steps, SCHEMA)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audited(masks(docs, labels))


SQL = r"""WITH d AS (SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > first, false)] AS fails FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f), o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f, list_transform(range(1, step), lambda i: strpos('ABCDE', substr(filter_order, i, 1))) AS earlier, strpos('ABCDE', substr(filter_order, step, 1)) AS own FROM o, (SELECT unnest(range(1, 6)) AS step)),
g AS (SELECT part, filter_order, step, f, n, good, toxic, fails[own] AS here, len(list_filter(earlier, lambda i: fails[i])) > 0 AS gone, len(list_filter(fails, lambda y: y)) = 1 AS alone FROM c, s),
r AS (SELECT part, filter_order, step, f, sum(CASE WHEN NOT here AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN here AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN here AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
 sum(CASE WHEN here AND alone THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN here AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN here AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM g GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r"""
