"""Mixing sources to target weights by temperature. DataFrame functions only.

Weights: a source's share of all tokens to the power of an exponent between 0 (all equal) and 1 (as they are),
normalised. The exponent is bisected on a grid of 2**-STEPS: the largest that reaches a target entropy (as a share of the
greatest possible), or else the smallest under which no source is repeated more than `repetition` times. The budget
is the smallest with which every source is used up once, so no document is lost: the largest source is taken once, others
more often.

Realisation: a source's budget in tokens is so many whole epochs and a rest. Documents stand in blocks; an epoch's order
is the blocks' order by a keyed hash, and by another one within a block. The rest takes the blocks of one more epoch
in that order until its tokens are used; of the block that crosses the border, documents that begin before it.
Sums run over at most 4096 groups of blocks per source, then only within the group, and the block, that crosses: no window
holds a source's rows.

Defined cases: a null source is a source of its own; null and empty texts have no tokens and come in every whole epoch;
a source without tokens is taken once; rows that repeat a doc_id are each a document; a row without doc_id goes by its text's hash, so such rows
spread over blocks too; other columns, whatever their names, are ignored (`repeated` returns them as they are); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelattice.llm.shared import written

STEPS, BLOCK_DOCS, SEED = 20, 64, "mix"
REPETITION = 2.0


def n_tokens(text: Column) -> Column:
    """Words between white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f\v]+")), F.lit(0)).cast("long")


def _hash(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(SEED), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]))


def source_weights(sizes: DataFrame, repetition: float = REPETITION, entropy: float | None = None) -> DataFrame:
    """source, tokens, docs, exponent, weight, budget, epochs, rest. sizes: source, tokens, docs. One row per source, so the
    fold sees as many numbers as there are sources."""
    some = F.sort_array(F.collect_list(F.when(F.col("tokens") > 0, F.col("tokens").cast("double"))))
    alpha = lambda m: m / F.lit(float(1 << STEPS))
    total = lambda a: F.aggregate("t", F.lit(0.0), lambda s, x: s + F.pow(x, a))
    if entropy is None:
        # With the least budget that uses up every source, the smallest source is repeated (largest / smallest) ** (1 - a) times.
        holds = lambda m: F.pow(F.array_max("t") / F.array_min("t"), 1 - alpha(m)) <= repetition
    else:
        h = lambda a: F.aggregate("t", F.lit(0.0), lambda s, x: s - F.pow(x, a) / total(a) * F.ln(F.pow(x, a) / total(a)))
        holds = lambda m: h(alpha(m)) < entropy * F.ln(F.size("t").cast("double"))  # noqa: E731  (then the exponent is too large)
    # Bisection: the smallest m that holds is the number of those that do not.
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(STEPS))])
    found = sizes.agg(some.alias("t")).withColumn("m", F.aggregate(steps, F.lit(0), lambda m, step: F.when(holds(m + step - 1), m).otherwise(m + step)))
    top = F.lit(1 << STEPS)
    if entropy is None:
        at = F.when(holds(F.col("m")), F.col("m")).otherwise(top)
    else:
        at = F.when(holds(F.col("m")), F.greatest(F.lit(0), F.col("m") - 1)).when(holds(top), F.col("m")).otherwise(top)
    found = found.withColumn("exponent", alpha(at.cast("double")))
    found = found.select(F.lit(0).alias("one"), "exponent", F.array_max("t").alias("largest"), F.aggregate("t", F.lit(0.0), lambda s, x: s + F.pow(x, F.col("exponent"))).alias("total"))
    each = sizes.withColumn("one", F.lit(0)).join(F.broadcast(found), "one").drop("one")  # one row
    tokens = F.col("tokens").cast("double")
    weight = F.when(F.col("tokens") > 0, F.pow(tokens, "exponent") / F.col("total")).otherwise(0.0)
    # largest source once: budget = largest / its weight
    budget = F.greatest(F.col("tokens"), F.floor(F.pow(tokens, "exponent") * F.pow("largest", 1 - F.col("exponent")) + 1e-6))
    each = each.select("source", "tokens", "docs", "exponent", weight.alias("weight"), F.when(F.col("tokens") > 0, budget).otherwise(F.lit(0)).cast("long").alias("budget"))
    epochs = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(1).cast("long")
    return each.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.when(F.col("tokens") > 0, F.col("epochs") * F.col("tokens")).otherwise(0))


def planned(docs: DataFrame, repetition: float = REPETITION, entropy: float | None = None, carry: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, source, n_tokens, name, block, copies of every row, and carry: further columns of docs by the names that they get."""
    carry = carry or {}
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit(""))
    own = lambda *more: docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), n_tokens(F.col("text")).alias("n_tokens"), name.alias("name"), *more)
    small, _ = written(own(), "mix-sizes")
    sizes = small.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    weights, _ = written(source_weights(sizes, repetition, entropy), "mix-weights")
    # One row per source: a plain join would deal the largest source to one task, so its side stays small and skew is dealt anew.
    block = F.conv(F.substring(F.md5("name"), 1, 8), 16, 10).cast("long") % F.ceil(F.col("docs") / BLOCK_DOCS)
    place = lambda rows: rows.join(weights.select("source", "docs", "epochs", "rest"), "source").select("doc_id", "source", "n_tokens", "name", "epochs", "rest", block.alias("block"), *carry_of(rows))
    carry_of = lambda rows: [c for c in carry if c in rows.columns]
    placed = place(small)
    blocks = placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens"), F.first("rest").alias("rest"), F.first("epochs").alias("epochs")).withColumn("key", _hash("source", "epochs", "block")).withColumn("part", F.substring("key", 1, 3))
    before = lambda *by: W.partitionBy(*by[:-1]).orderBy(*by[-1]).rowsBetween(W.unboundedPreceding, -1)
    parts = blocks.groupBy("source", "part").agg(F.sum("tokens").alias("part_tokens"))
    parts = parts.withColumn("part_before", F.coalesce(F.sum("part_tokens").over(before("source", ["part"])), F.lit(0)))
    blocks = blocks.join(parts, ["source", "part"])
    crossing = (F.col("part_before") < F.col("rest")) & (F.col("part_before") + F.col("part_tokens") >= F.col("rest"))
    inner = blocks.where(crossing)
    inner = inner.withColumn("start", F.col("part_before") + F.coalesce(F.sum("tokens").over(before("source", "part", ["key", "block"])), F.lit(0)))
    outer = blocks.where(~crossing).withColumn("start", F.col("part_before"))
    # left: tokens of the rest that remain at the block's start; a block outside the crossing group is taken whole or not at all.
    whole = F.col("part_before") + F.col("part_tokens") < F.col("rest")
    left = outer.select("source", "block", F.when(whole, F.col("tokens") + 1).otherwise(0).alias("left")).unionByName(inner.select("source", "block", F.greatest(F.lit(0), F.col("rest") - F.col("start")).alias("left")))
    rows = place(own(*[column.alias(c) for c, column in carry.items()])) if carry else placed
    docs_in = rows.join(left, ["source", "block"])
    order = before("source", "block", [F.md5(F.concat_ws(":", F.lit(SEED), F.col("name"))), F.col("name"), F.col("n_tokens")])
    start = F.coalesce(F.sum("n_tokens").over(order), F.lit(0))
    return docs_in.select("doc_id", "source", "n_tokens", "name", "block", *carry, (F.col("epochs") + (start < F.col("left")).cast("long")).alias("copies"))


def repeated(docs: DataFrame, repetition: float = REPETITION) -> DataFrame:
    """docs with each row as often as the mixture takes it, copies side by side. The whole rows move once, to their blocks."""
    plan = planned(docs, repetition, carry={"whole_row": F.struct(*[F.col(f"`{c}`") for c in docs.columns])})
    return plan.select("whole_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("whole_row.*")


def stream(plan: DataFrame) -> DataFrame:
    """One row per copy: doc_id, source, n_tokens, epoch, block, and order, by which a reader sorts a source's epoch."""
    copies = plan.select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("nth")).withColumn("epoch", F.col("nth") - 1)
    key = F.concat_ws("/", F.format_string("%06d", F.col("epoch")), _hash("source", "epoch", "block"), F.md5(F.concat_ws(":", F.lit(SEED), F.col("name"))))
    return copies.select("doc_id", "source", "n_tokens", "epoch", "block", key.alias("order"))


def mixed(docs: DataFrame, repetition: float = REPETITION) -> DataFrame:
    return stream(planned(docs, repetition))


SQL = rf"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, md5(text), '') AS name, coalesce(source, '') AS source, coalesce(len(regexp_extract_all(text, '[^ \t\n\r\f\v]+')), 0)::BIGINT AS n_tokens FROM documents),
s AS (SELECT source, sum(n_tokens)::BIGINT AS tokens, count(*) AS docs FROM d GROUP BY 1),
x AS (SELECT max(tokens)::DOUBLE AS largest, min(tokens)::DOUBLE AS smallest FROM s WHERE tokens > 0),
g AS (SELECT min(m) / {1 << STEPS}.0::DOUBLE AS exponent, any_value(largest) AS largest FROM x, range(0, {(1 << STEPS) + 1}) r(m) WHERE pow(largest / smallest, 1 - m / {1 << STEPS}.0::DOUBLE) <= {REPETITION}),
w AS (SELECT s.*, CASE WHEN tokens > 0 THEN greatest(tokens, floor(pow(tokens::DOUBLE, exponent) * pow(largest, 1 - exponent) + 1e-6)::BIGINT) ELSE 0 END AS budget FROM s, g),
e AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS epochs, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest FROM w),
p AS (SELECT d.*, epochs, rest, ('0x' || substr(md5(name), 1, 8))::BIGINT % ceil(docs / {BLOCK_DOCS}.0)::BIGINT AS block FROM d JOIN e USING (source)),
b AS (SELECT source, block, any_value(rest) AS rest, sum(n_tokens) AS tokens, md5(concat_ws(':', '{SEED}', source, any_value(epochs), block)) AS key FROM p GROUP BY 1, 2),
c AS (SELECT *, rest - coalesce(sum(tokens) OVER (PARTITION BY source ORDER BY key, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining FROM b),
t AS (SELECT p.*, remaining, coalesce(sum(n_tokens) OVER (PARTITION BY p.source, p.block ORDER BY md5(concat_ws(':', '{SEED}', name)), name, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM p JOIN c ON p.source = c.source AND p.block = c.block),
n AS (SELECT *, epochs + CASE WHEN start < greatest(0, remaining) THEN 1 ELSE 0 END AS copies FROM t)
SELECT doc_id, source, n_tokens, (i - 1)::BIGINT AS epoch, block, concat_ws('/', lpad((i - 1)::VARCHAR, 6, '0'), md5(concat_ws(':', '{SEED}', source, i - 1, block)), md5(concat_ws(':', '{SEED}', name))) AS "order"
FROM (SELECT *, unnest(range(1, copies + 1)) AS i FROM n)"""
