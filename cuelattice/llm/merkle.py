"""Merkle manifest of a table: a tree of hashes per source, one over the sources, and a proof for every document.

Leaves are numbered per source by one range sort; from there on every level has its nodes numbered, so that runs of 16 are known
without a search. Per level, lag and lead columns at fixed offsets 1 to 15, masked by a node's slot in its run and the run's length, are
its siblings; the first child of each run hashes its parent from its own digest and its leads. Windows hold blocks of 256 neighbouring
nodes, so a source with a third of all rows is many windows. Each level is a table 16 times smaller than the one below; parents' paths
are then joined downwards by (source, run).

Defined cases: rows of a source with the same doc_id, or none (before all others), follow one another by leaf; equal rows have equal
leaves, but proofs of their own. A row without doc_id is not tampered with. A null text stays null. An empty table has no root and gives
no row. A table of one source has no level above its subroot.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelattice.llm.shared import dropped, written

#: Children of a node; nodes of a window.
FAN, BLOCK = 16, 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """`-` if null, else its UTF-8 byte count, `:` and it."""
    s = value.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(text: Column) -> Column:
    return F.sha2(F.concat(field(F.col("doc_id")), field(F.col("source")), field(F.col("lang")), field(F.col("n_chars")), field(text)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, key (the source; orders null first, then by bytes), leaf, changed (the leaf after tampering, null if there was none)."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    return docs.select("doc_id", key.alias("key"), leaf(F.col("text")).alias("leaf"), F.when(hit, leaf(F.translate("text", UPPER, LOWER))).alias("changed"))


class Scratch:
    """Tables that one manifest writes on its way, so that no plan holds more than one level; those that nothing reads any more can be dropped."""

    def __init__(self):
        self.paths: dict[str, str] = {}

    def put(self, df: DataFrame, tag: str) -> DataFrame:
        out, self.paths[tag] = written(df, tag)
        return out

    def drop_all_but(self, spark: SparkSession, *tags: str) -> None:
        dropped(spark, *[p for t, p in self.paths.items() if t not in tags])


def numbered(rows: DataFrame, order: list[str], scratch: Scratch, tag: str) -> DataFrame:
    """rows with place (0-based, within key) and n (rows of the key). One range sort by key and order; places within a range come from the rows'
    position there, those of ranges from their counts. Equal rows are split at will, so none of them holds a range together."""
    tie = F.monotonically_increasing_id()
    sort = rows.withColumn("tie", tie).repartitionByRange("key", *order, "tie").sortWithinPartitions("key", *order, "tie").drop("tie")
    kept = scratch.put(sort.withColumn("at", F.monotonically_increasing_id()), f"{tag}-sorted")
    area = F.shiftright("at", 33)
    starts = kept.groupBy("key", area.alias("area")).agg(F.min("at").alias("first"), F.count("*").alias("c"))
    w = W.partitionBy("key").orderBy("area")
    starts = starts.select("key", "area", "first", F.coalesce(F.sum("c").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("c").over(W.partitionBy("key")).alias("n"))
    placed = kept.withColumn("area", area).join(starts, ["key", "area"]).withColumn("place", F.col("before") + F.col("at") - F.col("first")).drop("area", "at", "first", "before")
    return scratch.put(placed, tag)


def with_siblings(nodes: DataFrame) -> DataFrame:
    """nodes (key, place, n, digest) with left and right: the digests of a node's run before and after it."""
    w = W.partitionBy("key", F.floor(F.col("place") / BLOCK)).orderBy("place")
    slot = F.col("place") % FAN
    length = F.least(F.lit(FAN), F.col("n") - (F.col("place") - slot))
    lags = [F.when(slot >= k, F.lag("digest", k).over(w)) for k in range(FAN - 1, 0, -1)]
    leads = [F.when(slot + k < length, F.lead("digest", k).over(w)) for k in range(1, FAN)]
    return nodes.withColumn("left", F.concat_ws("", *lags)).withColumn("right", F.concat_ws("", *leads))


def climbed(nodes: DataFrame, scratch: Scratch, tag: str) -> list[DataFrame]:
    """The tables of nodes (key, place, n, digest) level by level, up to where every key has one node. Above the lowest they are written."""
    levels = [nodes.select("key", "place", "n", "digest")]
    most = levels[0].agg(F.max("n")).first()[0] or 0
    while most > 1:
        runs = with_siblings(levels[-1].where("n > 1")).where(F.col("place") % FAN == 0)
        up = runs.select("key", F.floor(F.col("place") / FAN).alias("place"), F.ceil(F.col("n") / FAN).alias("n"), F.sha2(F.concat("digest", "right"), 256).alias("digest"))
        levels.append(scratch.put(up, f"{tag}-{len(levels)}"))
        most = -(-most // FAN)
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """key, digest: the single node that remains of every key."""
    return reduce(DataFrame.unionByName, [x.where("n = 1").select("key", "digest") for x in levels])


def descended(levels: list[DataFrame], tops: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """The lowest nodes' columns with subroot and path: (left, right) of their ancestors and themselves, from the bottom up. tops: key, subroot, path
    above the key's root. Paths of the levels above are written, each 16 times smaller than the one below."""
    found = None
    for i, level in reversed(list(enumerate(levels))):
        here = level.where("n = 1").join(tops, "key")
        if found is not None:
            run = F.floor(F.col("place") / FAN).alias("run")
            above = found.select("key", F.col("place").alias("run"), "subroot", F.col("path").alias("above"))
            grown = with_siblings(level.where("n > 1")).select("*", run).join(above, ["key", "run"])
            grown = grown.withColumn("path", F.concat(F.array(F.struct("left", "right")), "above"))
            here = here.unionByName(grown.select(*here.columns))
        found = scratch.put(here.select("key", "place", "subroot", "path"), f"{tag}-{i}") if i else here
    return found


def folded(path: Column, digest: Column) -> Column:
    """The root that a leaf's digest and its path lead to."""
    return F.aggregate(path, digest, lambda own, x: F.sha2(F.concat(x["left"], own, x["right"]), 256))


def proof(path: Column) -> Column:
    """All siblings of a path in one text: level by level, left to right."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), "")


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, changed, subroot, root, path of every row."""
    scratch = Scratch()
    rows = numbered(leaves(docs), ["doc_id", "leaf"], scratch, "merkle-leaves")
    levels = climbed(rows.withColumnRenamed("leaf", "digest"), scratch, "merkle-nodes")
    sources = roots(levels).select(F.lit("").alias("key"), F.col("key").alias("source"), "digest")
    ranked = numbered(sources, ["source"], scratch, "merkle-sources")
    above = climbed(ranked, scratch, "merkle-source-nodes")
    root = roots(above).select("digest").first()
    above[0] = ranked.select("key", "place", "n", "digest", "source")
    top = ranked.where("place = 0").select("key", F.lit("").alias("subroot"), F.array().cast(PATH).alias("path"))
    tops = descended(above, top, scratch, "merkle-source-paths").select(F.col("source").alias("key"), F.col("digest").alias("subroot"), "path")
    tops = scratch.put(tops, "merkle-tops")
    levels[0] = rows.select("key", "place", "n", F.col("leaf").alias("digest"), F.struct("doc_id", "changed").alias("own"))
    found = descended(levels, tops, scratch, "merkle-paths")
    scratch.drop_all_but(docs.sparkSession, "merkle-leaves", "merkle-tops", "merkle-paths-1")
    return found.select("own.doc_id", F.col("digest").alias("leaf"), "own.changed", "subroot", F.lit(root["digest"] if root else None).cast("string").alias("root"), "path")


def verified(docs: DataFrame) -> DataFrame:
    again = folded(F.col("path"), F.coalesce("changed", "leaf"))
    m = manifest(docs).select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), again.alias("folded_root"))
    return m.withColumn("verified", F.col("folded_root") == F.col("root"))


_HASH = "list_reduce(list_prepend({first}, list_transform(str_split({s}, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"
_CRC = f"xor(4294967295, {_HASH.format(first='4294967295::BIGINT', s='doc_id::VARCHAR')})"
_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
_UP = "SELECT l + 1, k, p // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY p)) FROM {0} WHERE n > 1 GROUP BY l, k, p // 16, n"
_FOLD = "SELECT id, f.l + 1, f.k, p // 16, sha256(array_to_string(list_concat(hs[1:p % 16], [own], hs[p % 16 + 2:]), '')), proof || array_to_string(list_concat(hs[1:p % 16], hs[p % 16 + 2:]), '') FROM {0} f JOIN {1} r ON r.l = f.l AND r.k = f.k AND r.run = f.p // 16"
SQL = f"""WITH RECURSIVE d AS (SELECT *, row_number() OVER () AS id, coalesce('=' || source, '-') AS k, {_LEAF.format('text')} AS leaf, CASE WHEN {_CRC} % 5 = 0 THEN {_LEAF.format(f"translate(text, '{UPPER}', '{LOWER}')")} END AS changed FROM documents),
b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY k) AS n FROM d),
lv(l, k, p, n, h) AS (SELECT 0, k, p, n, leaf FROM b UNION ALL {_UP.format('lv')}),
s AS (SELECT k AS source_key, h AS subroot, '' AS k, row_number() OVER (ORDER BY k) - 1 AS p, count(*) OVER () AS n FROM lv WHERE n = 1),
tv(l, k, p, n, h) AS (SELECT 0, k, p, n, subroot FROM s UNION ALL {_UP.format('tv')}),
lr AS (SELECT l, k, p // 16 AS run, list(h ORDER BY p) AS hs FROM lv WHERE n > 1 GROUP BY ALL), tr AS (SELECT l, k, p // 16 AS run, list(h ORDER BY p) AS hs FROM tv WHERE n > 1 GROUP BY ALL),
lf(id, l, k, p, own, proof) AS (SELECT id, 0, k, p, coalesce(changed, leaf), '' FROM b UNION ALL {_FOLD.format('lf', 'lr')}),
le AS (SELECT * FROM lf QUALIFY row_number() OVER (PARTITION BY id ORDER BY l DESC) = 1),
tf(id, l, k, p, own, proof) AS (SELECT id, 0, s.k, s.p, own, proof FROM le JOIN s ON le.k = s.source_key UNION ALL {_FOLD.format('tf', 'tr')}),
te AS (SELECT * FROM tf QUALIFY row_number() OVER (PARTITION BY id ORDER BY l DESC) = 1), root AS (SELECT h AS root FROM tv WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, own AS folded_root, own = root AS verified FROM b JOIN te USING (id) JOIN s ON b.k = s.source_key, root"""
