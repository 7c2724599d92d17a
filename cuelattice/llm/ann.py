"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of TABLES hash tables has M Gaussian projections; a vector's bucket is floor((a.x + b) / width) for each of them.
A query visits, in every table, its own bucket and then perturbed ones: moving one coordinate by +1 or -1 costs the
squared distance to that border, and sets of moves are visited in order of the sum of their costs, which is the order of
estimated success. The candidates of all tables are merged and ranked by exact distance.

M and the width are fitted together on a bounded sample of SAMPLE vectors: of all numbers of projections up to MOST and of WIDTHS times the sample's
distance to the 10th neighbour, those with which CALIBRATE queries, compared once with every row, find at least GOAL of their true neighbours; of these the
pair whose buckets hold the least share of the sample (`candidate_share`). Data with clear neighbours get many small buckets, data without few large ones.
Where no pair reaches GOAL, one projection gets wider and wider, until it does: at last a bucket holds all. Every vector is indexed. Equal vectors are one
entry that carries its TOP + 1 smallest ids; no more of them can be among the nearest TOP, so this loses nothing. Buckets are stored in
blocks of about BLOCK entries, and blocks of queries meet blocks of entries, whose best TOP alone go on: no bucket,
however full, is held whole.

Defined cases: vectors that are null, empty, zero, or with null or non-finite components take no part; rows without
vec_id neither; vectors of different lengths are no candidates of each other; rows that repeat a vec_id count once if equal, else each vector by itself;
fewer candidates than TOP give fewer rows; ties go to the smaller vec_id, at the last rank too; other columns, whatever their names, are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from heapq import heappop, heappush
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelattice.llm.shared import bound_batches, written

TOP, TABLES, PROBES, BLOCK, QUERIES, SEED = 10, 3, 60, 256, 64, 7
#: Bucket widths tried, as multiples of the sample's median distance to the 10th neighbour.
WIDTHS, SAMPLE, CALIBRATE, GOAL, MOST = (0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0), 2000, 48, 0.97, 32


#: Candidates that a task holds before it keeps each query's best alone.
HELD = 200_000


class Hashes:
    """The projections of all tables; equal on every worker."""

    def __init__(self, dims: int, m: int, width: float, tables: int = TABLES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.tables, self.m, self.width = tables, m, width
        self.a = rng.normal(0, 1, (dims, tables * m))
        self.b = rng.uniform(0, width, tables * m)
        self.mix = rng.integers(1, 1 << 62, m, dtype=np.int64) | 1

    def places(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket coordinates (n, tables, m) and how far into its bucket each value lies (0 to 1)."""
        z = ((x @ self.a + self.b) / self.width).reshape(len(x), self.tables, self.m)
        low = np.floor(z)
        return low.astype(np.int64), z - low

    def keys(self, places: np.ndarray) -> np.ndarray:
        """One 64-bit key per bucket: the table in it, too."""
        h = (places * self.mix).sum(-1, dtype=np.int64)
        h ^= h >> 29
        return h * np.int64(0x369DEA0F31A53F85) + np.arange(self.tables, dtype=np.int64) * np.int64(0x1E35A7BD1E35A7B9)

    def probes(self, inside: np.ndarray, n: int) -> list[list[tuple[int, int]]]:
        """Sets of moves (coordinate, -1 or +1) for one table, cheapest first; the first is no move."""
        cost = sorted([(f * f, j, -1) for j, f in enumerate(inside.tolist())] + [((1 - f) ** 2, j, 1) for j, f in enumerate(inside.tolist())])
        out: list[list[tuple[int, int]]] = [[]]
        heap = [(cost[0][0], (0,))] if cost else []
        while heap and len(out) < n:
            total, at = heappop(heap)
            last = at[-1]
            if last + 1 < len(cost):  # shift the last move, or add the next one
                heappush(heap, (total - cost[last][0] + cost[last + 1][0], (*at[:-1], last + 1)))
                heappush(heap, (total + cost[last + 1][0], (*at, last + 1)))
            moves = [cost[i][1:] for i in at]
            if len({j for j, _ in moves}) == len(moves):  # not both ways at once
                out.append(moves)
        return out


    def visits(self, q: np.ndarray, n: int = PROBES) -> np.ndarray:
        """Keys of the buckets that a query visits, n in each table."""
        places, inside = self.places(q[None])
        out = []
        for t in range(self.tables):
            moves = self.probes(inside[0, t], n)
            full = np.repeat(places, len(moves), 0)
            for i, own in enumerate(moves):
                for j, step in own:
                    full[i, t, j] += step
            out.append(self.keys(full)[:, t])
        return np.unique(np.concatenate(out))


@functools.lru_cache(maxsize=32)
def hashes(dims: int, m: int, width: float) -> Hashes:
    return Hashes(dims, m, width)


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, x (doubles): the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(x, lambda v: v != 0)
    return rows.where(F.col("vec_id").isNotNull() & fine).select("vec_id", x.alias("x"))


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = x - q
    return np.sqrt((d * d).sum(1))


def closest(x: np.ndarray, names: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of q the k nearest rows of x, ties to smaller names: (row of q, row of x, distance). A matrix product, on vectors less their
    mean, finds who can be among them: rounding is bounded by the vectors' lengths, and the bound is widened by more than that. The distances
    returned are computed term by term."""
    if x.shape[0] > k:
        middle = x.mean(0)
        xs, qs = x - middle, q - middle
        xx, qq = (xs * xs).sum(1), (qs * qs).sum(1)
        rough = qq[:, None] + xx[None] - 2 * (qs @ xs.T)
        most = qq + xx.max()
        slack = 64 * np.finfo(float).eps * (x.shape[1] + 4) * (most + np.sqrt(most) * np.abs(middle).max())
        bound = np.partition(rough, k - 1, axis=1)[:, k - 1]
        i, j = np.nonzero(rough <= (bound + slack)[:, None])
    else:
        i, j = (v.reshape(-1) for v in np.indices((len(q), len(x))))
    d = distances(x[j], q[i])
    order = np.lexsort((names[j], d, i))
    i, j, d = i[order], j[order], d[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    return i[rank < k], j[rank < k], d[rank < k]


class Fit(NamedTuple):
    m: int
    width: float
    #: Of the calibrating queries' true neighbours, and of the sample's vectors, the share in buckets that the queries visit.
    recall: float
    candidate_share: float


def fit_of(x: np.ndarray, asked: np.ndarray, owner: np.ndarray, theirs: np.ndarray, unit: float) -> Fit:
    """The cheapest fit that reaches GOAL. x: the sample; theirs: true neighbours, each of the query asked[owner]."""

    def tried(m: int, width: float) -> Fit:
        h = hashes(x.shape[1], m, width)
        visited = [h.visits(q) for q in asked]
        own = h.keys(h.places(theirs)[0])
        recall = float(np.mean([np.isin(k, visited[q]).any() for q, k in zip(owner.tolist(), own, strict=True)]))
        keys = h.keys(h.places(x)[0]) if recall >= GOAL else None
        return Fit(m, width, recall, 1.0 if keys is None else float(np.mean([np.isin(keys, v).any(1).mean() for v in visited])))

    good = []
    for times in WIDTHS:
        low, high = 1, MOST  # fewer projections only add candidates, so the most that reach GOAL are found by halving
        while low <= high:
            m = (low + high) // 2
            fit = tried(m, times * unit)
            if fit.recall >= GOAL:
                good.append(fit)
                low = m + 1
            else:
                high = m - 1
    if good:
        return min(good, key=lambda f: (f.candidate_share, -f.m, f.width))
    width = WIDTHS[-1] * unit
    while (fit := tried(1, width)).recall < GOAL:
        width *= 2
    return fit


def fitted(classes: DataFrame, dims: int) -> Fit:
    """Projections per table and bucket width. classes: cls, x (all of the same length)."""
    rows = classes.orderBy(F.xxhash64("cls"), "cls").limit(SAMPLE).select("x").collect()
    x = np.array([r.x for r in rows])
    near = np.sort(np.stack([distances(x, q) for q in x[:200]]), axis=1)
    unit = float(np.median(near[:, min(TOP, near.shape[1] - 1)])) or 1.0
    asked = x[:CALIBRATE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own, names = b.column(1).flatten().to_numpy().reshape(-1, dims), b.column(0).to_numpy()
                i, j, d = closest(own, names, asked, TOP + 1)
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(d), pa.array(names[j]), pa.array([own[k].tobytes() for k in j], pa.binary())], ["q", "d", "cls", "x"])

    found = classes.select("cls", "x").mapInArrow(run, "q int, d double, cls long, x binary")
    found = found.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy("d", "cls"))).where(F.col("r") <= TOP + 1).select("q", "x").collect()
    truth = [(r.q, np.frombuffer(r.x)) for r in found]  # CALIBRATE * (TOP + 1) rows
    return fit_of(x, asked, np.array([q for q, _ in truth]), np.stack([v for _, v in truth]), unit)


def nearest(rows: DataFrame, every: int = 100, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score for queries whose vec_id is divisible by `every`."""
    bound_batches(rows.sparkSession)
    vectors = usable(rows)
    # Of equal vectors only the smallest ids matter; the ranked window is cut short before the shuffle.
    rank = F.dense_rank().over(W.partitionBy("x").orderBy("vec_id"))
    members = vectors.withColumn("r", rank).where(F.col("r") <= top + 1).groupBy("x").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    classes, _ = written(members.withColumn("cls", F.element_at("ids", 1)), "vectors")
    out = None
    # Vectors of different lengths have no distance; each length is a search of its own.
    for dims in sorted(r.dims for r in classes.select(F.size("x").alias("dims")).distinct().collect()):
        found = _nearest(vectors.where(F.size("x") == dims), classes.where(F.size("x") == dims), dims, every, top)
        out = found if out is None else out.unionByName(found)
    return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double") if out is None else out


def _nearest(vectors: DataFrame, classes: DataFrame, dims: int, every: int, top: int) -> DataFrame:
    """vectors: vec_id, x; classes: x, ids, cls."""
    m, width, _, _ = fitted(classes, dims)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = hashes(dims, m, width)
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy().reshape(-1, dims)
                keys = h.keys(h.places(x)[0])
                cls = np.repeat(b.column(0).to_numpy(), h.tables)
                packed = [v.tobytes() for v in x for _ in range(h.tables)]
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(cls), pa.array(packed, pa.binary())], ["key", "cls", "x"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = hashes(dims, m, width)
        for b in batches:
            for q, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.array(raw)
                keys = h.visits(x)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([q] * len(keys), pa.int64()), pa.array([x.tobytes()] * len(keys), pa.binary())], ["key", "query", "q"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], []]
        size = 0

        def reduced() -> list[np.ndarray]:
            """The nearest top + 1 of each query among those held, each class once."""
            query, cls, score = (np.concatenate(c) for c in held)
            order = np.lexsort((cls, score, query))
            query, cls, score = query[order], cls[order], score[order]
            new = np.ones(len(query), bool)
            new[1:] = (query[1:] != query[:-1]) | (cls[1:] != cls[:-1])
            query, cls, score = query[new], cls[new], score[new]
            few = np.arange(len(query)) - np.searchsorted(query, query) <= top
            return [query[few], cls[few], score[few]]

        for b in batches:
            for asking, qs, names, xs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x, q, names = np.frombuffer(b"".join(xs)).reshape(-1, dims), np.frombuffer(b"".join(qs)).reshape(-1, dims), np.array(names)
                i, j, d = closest(x, names, q, top + 1)
                for col, v in zip(held, (np.array(asking)[i], names[j], d), strict=True):
                    col.append(v)
                size += len(i)
                if size > HELD:
                    out = reduced()
                    held, size = [[c] for c in out], len(out[0])
                    if size > HELD // 2:  # many queries, rather than many candidates of each
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["query", "cls", "score"])
                        held, size = [[], [], []], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in reduced()], ["query", "cls", "score"])

    def blocked(rows: DataFrame, name: str, data: str, size: int) -> DataFrame:
        """Rows of a key in blocks of about `size`, each an array of names and one of vectors."""
        sizes = rows.groupBy("key").agg(F.count("*").alias("size"))
        cut = rows.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64(name), F.ceil(F.col("size") / size)))
        packed = cut.groupBy("key", "block").agg(F.collect_list(F.struct(name, data)).alias("e"))
        return packed.select("key", F.col("e")[name].alias(f"{name}s"), F.col("e")[data].alias(f"{data}s"))

    entries = classes.select("cls", "x").mapInArrow(index, "key long, cls long, x binary")
    asked = classes.where(F.exists("ids", lambda i: i % every == 0) | (F.size("ids") > top)).select("cls", "x")
    visits = asked.mapInArrow(probe, "key long, query long, q binary")
    found = blocked(visits, "query", "q", QUERIES).join(blocked(entries, "cls", "x", BLOCK), "key").select("querys", "qs", "clss", "xs").mapInArrow(best, "query long, cls long, score double")
    order = W.partitionBy("query").orderBy("score", "cls")
    merged = found.distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= top + 1)
    # From classes back to vectors: every query of the class meets the members of the nearest classes.
    hits = merged.join(classes.select("cls", "ids"), "cls").select("query", "score", F.explode("ids").alias("vec_id"))
    queries = vectors.where(F.col("vec_id") % every == 0).join(classes.select("x", F.col("cls").alias("query")), "x").select("query", F.col("vec_id").alias("query_id")).distinct()
    pairs = queries.join(hits, "query").where("query_id != vec_id")
    final = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return pairs.withColumn("rank", final).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
