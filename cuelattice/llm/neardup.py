"""Near-duplicate classes by bottom-k sketches.

A document's set holds a 64-bit hash of each distinct run of N words; its sketch is the smallest of them, so one hash
function serves all. Documents with the same set are one class from the start. Then:

1. Active classes. Each class enters the inverted list of each of its FIRST smallest values. A class goes on only if as many
   of them have another member as a link needs (`needed`); a link fails that with a chance below MISS.
2. Inverted lists of the active ones' K smallest values. Two linked sets share `needed` of them at least. Each class orders
   its values by (size of the value's list, value), the same order for all, and enters only the lists of its rarest ones: of k values of which
   c must be shared, the first k - c + 1 of both must have one in common. What thousands of otherwise different documents share is thus
   listed by none of them.
3. In each list the hub, the set whose values are the most common, meets every member: no list emits the square of its size. The
   union sketch (the K smallest values of both) drops pairs whose estimate is far below the threshold, and full sets verify the rest.
4. Members linked with the same hub are in one component, whatever else links them. An open member, not linked with its hub, may be
   linked with any other member of that hub's lists. Blocks of open members meet blocks of all members, and a matrix product over the
   values that occur more than once gives all intersections; of each pair of blocks only links that join components go on. Work within a hub's
   lists thus grows with (open members) x (members), in blocks, and with their number otherwise.
5. Components by alternating large and small stars, written to the shared folder each round.

Steps 1 to 4 are a fixed number of jobs, however large or many the groups are.

Defined cases: null, empty and blank texts have an empty set and link with nothing; a row without doc_id links with nothing,
has component_id null and is kept; rows that repeat a doc_id are each compared by their own text, and component_id is the smallest doc_id of the
rows that are reachable; very long texts are hashed STEP bytes at a time and hold 8 bytes a word; other columns, whatever their names, are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelattice.llm.shared import bound_batches, dropped, written

FIRST, K, MISS = 20, 128, 1e-7
#: Standard deviations below the threshold at which the union-sketch estimate still lets a pair pass.
SLACK = 5
#: Members that meet one copy of a hub's set; a block holds so many sets, and values, at most (or one larger set).
SALTED, BLOCK, BLOCK_VALUES, COLUMNS = 1024, 1024, 1 << 19, 4096
#: Bytes of text hashed at a time.
STEP = 1 << 20

LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BLANKS = bytes(np.flatnonzero(SPACE).tolist())
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(20).integers(1, 1 << 64, 256, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit over the word."""
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, as many as were ever needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            m = max(n, STEP + 2)
            make = lambda base: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(m - 1, base, np.uint64)]))
            cls.up, cls.down = make(_BASE), make(pow(_BASE, -1, 1 << 64))
        return cls.up[:n], cls.down[:n]


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of data, which begins and ends with a blank."""
    buf = np.frombuffer(data.translate(LOWER), np.uint8)
    word = ~SPACE[buf]
    edges = np.flatnonzero(word[1:] != word[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    up, down = _Powers.to(len(buf))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[buf] * up)])
    return starts, _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _chained(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words."""
    out = words[: max(0, len(words) - n + 1)].copy()
    for k in range(1, n):
        out = _mixed(out * _U(_BASE) + words[k : k + len(out)])
    return out


def _own_set(words: np.ndarray, n: int) -> np.ndarray:
    return np.unique(_chained(words, min(n, len(words)))) if len(words) else words


def _sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    starts, words = _words(b" " + b" ".join(texts) + b" ")
    chained = _chained(words, n)
    borders = np.searchsorted(starts, np.cumsum([1] + [len(t) + 1 for t in texts]))
    for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
        yield np.unique(chained[a : b - n + 1]) if b - a >= n else _own_set(words[a:b], n)


def _long_set(text: bytes, n: int) -> np.ndarray:
    """Set of a text that is hashed in parts, each cut at white space."""
    parts, at = [], 0
    while at < len(text):
        end = at + STEP
        while end < len(text) and text[end] not in _BLANKS:
            end += 1
        parts.append(_words(b" " + text[at:end] + b" ")[1])
        at = end
    return _own_set(np.concatenate(parts), n)


def shingle_sets(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's runs of n words (of all its words, if fewer)."""
    held, size = [], 0
    for t in texts:
        data = (t or "").encode()
        if held and size + len(data) > STEP:
            yield from _sets(held, n)
            held, size = [], 0
        if len(data) > STEP:
            yield _long_set(data, n)
        else:
            held.append(data)
            size += len(data)
    if held:
        yield from _sets(held, n)


def _signed(s: np.ndarray) -> np.ndarray:
    """As 64-bit integers whose order is the unsigned one."""
    return (s ^ _U(1 << 63)).view(np.int64)


def text_hash() -> Column:
    return F.xxhash64("text")


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, digest of the set (null if nothing can link with it) and its FIRST smallest values, of every row."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, digests, low = [], [], []
            for i, s in zip(b.column(0).to_pylist(), shingle_sets(b.column(2).to_pylist(), n), strict=True):
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) and i is not None else None)
                low.append(_signed(s[:FIRST]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(low, pa.list_(pa.int64()))], ["doc_id", "text_hash", "n_shingles", "digest", "low"])

    return docs.select("doc_id", text_hash().alias("h"), "text").mapInArrow(run, "doc_id long, text_hash long, n_shingles long, digest binary, low array<long>")


def full_sets(docs: DataFrame, chosen: DataFrame, n: int) -> DataFrame:
    """id, n, s (packed sorted hashes) and sketch of the rows in chosen (id, doc_id, text_hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = list(shingle_sets(b.column(1).to_pylist(), n))
            cols = [pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([_signed(s[:K]) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["id", "n", "s", "sketch"])

    named = docs.where("doc_id IS NOT NULL").select("doc_id", text_hash().alias("text_hash"), "text")
    own = named.join(chosen.hint("merge"), ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])
    return own.select("id", "text").mapInArrow(run, "id long, n long, s binary, sketch array<long>")


# --- lists and hubs --------------------------------------------------------------------------------------------------


def least_common(k: int, t: float, miss: float = MISS) -> int:
    """Values of their k smallest that two sets of similarity t share at least, but for a chance of miss: of the union's k smallest each is
    shared with probability t."""
    c, below = 0, (1 - t) ** k
    while below <= miss:
        c += 1
        below += math.comb(k, c) * t**c * (1 - t) ** (k - c)
    return c


def needed(size: Column, k: int, percent: int) -> Column:
    """Of its k smallest values, how many a set of this size shares with a linked one at least. Where both must be whole in k, exactly."""
    exact = F.ceil(size * percent / 100).cast("int")
    return F.when(size * 100 <= k * percent, exact).otherwise(F.least(exact, F.lit(least_common(k, percent / 100))))


def _shared(values: DataFrame) -> DataFrame:
    """values (id, n, v) that several ids have, with their number (size)."""
    return values.join(values.groupBy("v").agg(F.count("*").alias("size")).where("size > 1"), "v")


def list_entries(sets: DataFrame, percent: int) -> DataFrame:
    """id, weight (how common its values are), keys (the lists that it enters)."""
    mine = _shared(sets.select("id", "n", F.explode("sketch").alias("v"))).groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("size", "v"))).alias("vs"), F.sum("size").alias("weight"))
    rare = F.size("vs") - needed(F.col("n"), K, percent) + 1  # values that no one shares are the rarest
    return mine.where(rare > 0).select("id", "weight", F.slice("vs", 1, rare)["v"].alias("keys"))


def hub_pairs(entries: DataFrame) -> DataFrame:
    """Distinct pairs (a, b): a is the hub of a list that b is in."""
    each = entries.select("id", "weight", F.explode("keys").alias("key"))
    hubs = each.groupBy("key").agg(F.min(F.struct(-F.col("weight"), F.col("id"))).alias("hub"), F.count("*").alias("size")).where("size > 1")
    return each.join(hubs.select("key", F.col("hub.id").alias("a")), "key").where("id != a").select("a", F.col("id").alias("b")).distinct()


def _linked(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(one), len(other)))
    if 100 * small < percent * large:
        return False
    t = percent / 100
    union = np.union1d(one[:K], other[:K])[:K]
    if large > K:
        both = np.isin(union, one[:K], assume_unique=True) & np.isin(union, other[:K], assume_unique=True)
        if both.mean() < t - SLACK * math.sqrt(t * (1 - t) / K):
            return False
    common = len(np.intersect1d(one, other, assume_unique=True))
    return 100 * common >= percent * (small + large - common)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, n of b, good): whether 100 * intersection >= percent * union. A hub's set comes once for each SALTED of its members, at their head."""
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALTED).cast("int").alias("parts"))
    salted = pairs.join(shares.hint("merge"), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("salt"))
    heads = shares.select("a", F.col("a").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    both = salted.withColumn("member", F.lit(1)).unionByName(heads.withColumn("member", F.lit(0)))
    rows = both.join(sets.select(F.col("id").alias("b"), "s").hint("merge"), "b").repartition("a", "salt").sortWithinPartitions("a", "salt", "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = np.zeros(0, np.uint64)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for a, b, member, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(s, np.uint64)
                if not member:
                    hub = own
                    continue
                for col, v in zip(out, (a, b, len(own), _linked(hub, own, percent)), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["a", "b", "n", "good"])

    return rows.select("a", "b", "member", "s").mapInArrow(run, "a long, b long, n long, good boolean")


def _intersections(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, (len(xs), len(ys)), from the values that occur more than once, COLUMNS of them at a time."""
    every = [*xs, *ys]
    rows = np.repeat(np.arange(len(every)), [len(s) for s in every])
    _, at, counts = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    often = counts > 1
    keep = often[at]
    rows, at = rows[keep], (np.cumsum(often) - 1)[at[keep]]
    order = np.argsort(at, kind="stable")
    rows, at = rows[order], at[order]
    total = np.zeros((len(xs), len(ys)))
    for first in range(0, int(often.sum()), COLUMNS):
        a, b = np.searchsorted(at, (first, first + COLUMNS))
        dense = np.zeros((len(every), COLUMNS), np.float32)
        dense[rows[a:b], at[a:b] - first] = 1
        total += dense[: len(xs)] @ dense[len(xs) :].T
    return total.round().astype(np.int64)


def _new_links(x: list[tuple], y: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links between open members x (id, set, good) and members y that their components need."""
    both = _intersections([r[1] for r in x], [r[1] for r in y])
    sizes = np.array([len(r[1]) for r in x])[:, None] + np.array([len(r[1]) for r in y])[None]
    ids_y, linked = np.array([r[0] for r in y]), np.array([r[2] for r in y])
    link = (100 * both >= percent * (sizes - both)) & (np.array([r[0] for r in x])[:, None] != ids_y[None])
    out, up = [], {}  # None stands for the hub

    def root(i: int | None) -> int | None:
        while up.get(i, i) != i:
            up[i] = i = up.get(up[i], up[i])
        return i

    for i in np.flatnonzero(link.any(1)).tolist():
        first = np.flatnonzero(link[i] & linked)[:1].tolist()  # those are connected through the hub already
        for j in first + np.flatnonzero(link[i] & ~linked).tolist():
            ra, rb = root(x[i][0]), root(None if linked[j] else int(ids_y[j]))
            if ra != rb:
                up[ra] = rb
                out.append((x[i][0], int(ids_y[j])))
    return out


def within_groups(done: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of a hub's lists of which at least one is open. done: as verified gives it."""
    blocks = lambda size, values: F.greatest(F.ceil(size / BLOCK), F.ceil(values / BLOCK_VALUES)).cast("int")
    is_open = F.col("good") == F.lit(False)
    groups = done.groupBy("a").agg(F.count("*").alias("size"), F.sum("n").alias("values"), F.count_if(is_open).alias("open"), F.sum(F.when(is_open, F.col("n"))).alias("open_values")).where("open > 0 AND size > 1")
    groups = groups.select("a", blocks(F.col("open"), F.col("open_values")).alias("x_blocks"), blocks(F.col("size"), F.col("values")).alias("y_blocks"))
    members = done.join(groups.hint("merge"), "a").join(sets.select(F.col("id").alias("b"), "s").hint("merge"), "b")
    place = lambda of: F.pmod(F.xxhash64("b"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    xs = members.where(is_open).select("a", place("x_blocks").alias("i"), every("y_blocks").alias("j"), F.lit(0).alias("side"), "b", "good", "s")
    ys = members.select("a", every("x_blocks").alias("i"), place("y_blocks").alias("j"), F.lit(1).alias("side"), "b", "good", "s")
    cells = xs.unionByName(ys).repartition("a", "i", "j").sortWithinPartitions("a", "i", "j", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, x, y, links = None, [], [], []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in links], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for a, i, j, side, b, good, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (a, i, j) != cell:
                    links += _new_links(x, y, percent) if x and y else []
                    cell, x, y = (a, i, j), [], []
                (y if side else x).append((b, np.frombuffer(s, np.uint64), good))
            yield out()
            links = []
        links = _new_links(x, y, percent) if x and y else []
        yield out()

    return cells.select("a", "i", "j", "side", "b", "good", "s").mapInArrow(run, "a long, b long")


# --- components ------------------------------------------------------------------------------------------------------


def components(links: DataFrame) -> tuple[DataFrame, str]:
    """(id, root) of every linked id but the roots; root: the smallest id that is reachable. links: (a, b)."""
    edges, path = written(links.select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("root")).where("id != root").distinct(), "edges")
    mark = None
    while True:
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("id", "root").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            return edges, path
        mark = seen
        # Large star: every larger neighbour goes to the smallest neighbour; small star: so does every smaller one.
        ways = edges.unionByName(edges.select(F.col("root").alias("id"), F.col("id").alias("root")))
        least = ways.groupBy("id").agg(F.least(F.min("root"), F.first("id")).alias("m"))
        large = ways.join(least, "id").where("root > id").select(F.col("root").alias("id"), F.col("m").alias("root")).distinct()
        least = large.groupBy("id").agg(F.min("root").alias("m"))
        small = large.join(least, "id")
        small = small.where("root != m").select(F.col("root").alias("id"), F.col("m").alias("root")).unionByName(least.select("id", F.col("m").alias("root"))).distinct()
        before = path
        edges, path = written(small, "edges")
        dropped(links.sparkSession, before)


def near_duplicates(docs: DataFrame, n_words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept, root of every row; root: the same number for all rows of a component, null for empty sets
    and rows without doc_id."""
    spark = docs.sparkSession
    made, made_at = written(sketches(docs, n_words), "sketches")
    named = made.where("digest IS NOT NULL")
    # A class goes by its smallest doc_id, or by its digest where a doc_id has several sets.
    mark = F.xxhash64("digest")
    twins, twins_at = written(named.groupBy("doc_id").agg(F.min(mark).alias("least"), F.max(mark).alias("most")).where("least != most").select("doc_id", F.lit(True).alias("twin")), "twins")
    repeated = not twins.isEmpty()
    if repeated:
        named = named.join(twins.hint("merge"), "doc_id", "left").withColumn("name", F.when(F.col("twin"), mark).otherwise(F.col("doc_id")))
    else:
        named = named.withColumn("name", F.col("doc_id"))
    classes = named.groupBy("digest").agg(F.min("name").alias("id"), F.min(F.struct("doc_id", "text_hash")).alias("first"), F.first("n_shingles").alias("n"), F.first("low").alias("low"))
    classes, classes_at = written(classes, "classes")
    active = _shared(classes.select("id", "n", F.explode("low").alias("v"))).groupBy("id", "n").count().where(F.col("count") >= needed(F.col("n"), FIRST, percent))
    chosen = classes.select("id", "first.doc_id", "first.text_hash").join(active.select("id").hint("merge"), "id", "left_semi")
    sets, sets_at = written(full_sets(docs, chosen, n_words), "sets")
    entries, entries_at = written(list_entries(sets, percent), "entries")
    pairs, pairs_at = written(hub_pairs(entries), "pairs")
    dropped(spark, entries_at)
    done, done_at = written(verified(pairs, sets, percent), "verified")
    roots, roots_at = components(done.where("good").select("a", "b").unionByName(within_groups(done, sets, percent)))
    dropped(spark, sets_at, pairs_at, done_at)
    of_class = classes.select("digest", "id", "first.doc_id").join(roots, "id", "left").select("digest", "doc_id", F.coalesce("root", "id").alias("root"))
    if repeated:
        least = of_class.groupBy("root").agg(F.min("doc_id").alias("component"))
        of_class = of_class.join(least, "root")
    else:
        of_class = of_class.withColumn("component", F.col("root"))
    found = made.select("doc_id", "text_hash", "n_shingles", "digest").join(of_class.select("digest", "root", "component"), "digest", "left")
    component = F.coalesce("component", "doc_id")
    out, _ = written(found.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), "root"), "components")
    dropped(spark, made_at, twins_at, classes_at, roots_at)
    return out
