"""Sequence alignment of word lists, for all chunks at once."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

#: Weighted costs of one integer: errors in the high part, substitutions in the low one.
EDIT, SUBSTITUTION = 1 << 24, (1 << 24) + 1
#: Cost of a word without partner beside similarity_cost.
LONE = 1000
#: Words that a kernel matches at a time, or one job where that has more.
STEP = 200_000


def words_apart(x: list[str], y: list[str]) -> int:
    """Word edit distance. A column of the cost table is two integers of a bit per word of x: where costs rise by one downwards, and where they fall. So a
    word of y takes a few operations on long integers, and lists of any length and any number of distinct words do."""
    while x and y and x[-1] == y[-1]:
        x, y = x[:-1], y[:-1]
    if not x or not y:
        return len(x) + len(y)
    places: dict[str, int] = {}
    for i, w in enumerate(x):
        places[w] = places.get(w, 0) | 1 << i
    every, last, cost = (1 << len(x)) - 1, 1 << (len(x) - 1), len(x)
    rise, fall = every, 0
    for w in y:
        same = places.get(w, 0)
        diagonal = (((same & rise) + rise) ^ rise) | same | fall
        up, down = fall | every & ~(diagonal | rise), rise & diagonal
        cost += bool(up & last) - bool(down & last)
        up, down = up << 1 | 1, down << 1
        rise, fall = (down | ~(same | fall | up)) & every, up & (same | fall) & every
    return cost


def distance(a: Column, b: Column) -> Column:
    """Word edit distance of two whole lists."""

    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([words_apart(x or [], y or []) for x, y in zip(left.to_pylist(), right.to_pylist(), strict=True)], pa.int32())

    return F.when(a == b, 0).otherwise(F.arrow_udf(run, "int")(a, b))


def errors(a: str, b: str) -> Column:
    """Least edit cost of word list a (reference) and b in one integer: `div EDIT` errors, `% EDIT` substitutions, fewest first. The built-in
    distance has no such split, and folds over arrays are interpreted; a kernel does many pairs of lists at a time."""

    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        (x, y), x0, y0 = coded(left.flatten(), right.flatten())[1], ends_of(left), ends_of(right)
        wrong, changed = edit_costs(x, x0, y, y0, reached(x, x0, y, y0))
        return pa.array(wrong * EDIT + changed)

    return F.arrow_udf(run, "long")(a, b)


def reached(ref: np.ndarray, r0: np.ndarray, heard: np.ndarray, h0: np.ndarray) -> np.ndarray:
    """A number of errors that suffices, for each pair of lists: that between their matched words, or of changing every word."""
    return np.minimum(block_errors(ref, r0, heard, h0)[0], np.maximum(np.diff(r0), np.diff(h0)))


def edit_costs(ref: np.ndarray, r0: np.ndarray, heard: np.ndarray, h0: np.ndarray, upper: np.ndarray, split: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(errors, substitutions) of many pairs of lists of codes: fewest errors, and of these fewest substitutions (all zero without split). upper: errors that suffice.

    A table's cell on a diagonal that no path of so few errors reaches is left out, which drops no best path. A diagonal across the table depends on the two before
    it only, so it is computed at once, for pairs of about the same size together. Work is the lists' length times the errors that suffice, memory the errors."""
    n, m = np.diff(r0), np.diff(h0)
    band = np.abs(n - m) + np.maximum(upper - np.abs(n - m), 0) // 2
    wrong, changed = np.where((n == 0) | (m == 0), n + m, 0), np.zeros(len(n), np.int64)
    todo = np.flatnonzero((n > 0) & (m > 0) & (upper > 0))
    todo = todo[np.argsort(np.maximum(n, m)[todo], kind="stable")]
    at = 0
    while at < len(todo):
        # So many cells at a time, of lists that differ by a quarter in length at most.
        size = np.maximum(n, m)[todo[at:]]
        wide = np.maximum.accumulate(band[todo[at:]])
        fits = (size <= 8 + size[0] * 5 // 4) & ((np.arange(len(size)) + 1) * (wide + 1) <= CELLS)
        group = todo[at : at + max(1, int(np.argmin(fits)) if not fits.all() else len(fits))]
        wrong[group], changed[group] = _across(ref, r0, heard, h0, group, int(band[group].max()), int(upper[group].max()), split)
        at += len(group)
    return wrong, changed


#: Cells of a diagonal across the tables that are computed together.
CELLS = 40_000


def _across(ref: np.ndarray, r0: np.ndarray, heard: np.ndarray, h0: np.ndarray, group: np.ndarray, b: int, most: int, split: bool) -> tuple[np.ndarray, np.ndarray]:
    n, m, b = r0[group + 1] - r0[group], h0[group + 1] - h0[group], b + b % 2
    small = most < 15_000
    kind, unit = (np.int32 if small else np.int64, 1 << 15 if small else 1 << 31) if split else (np.int16 if small else np.int32, 1)
    far, change = kind(np.iinfo(kind).max // 2), unit + split
    # The reference backwards: both sides' words of a diagonal are then slices; pairs side by side in memory. Places outside hold what equals nothing.
    size, count = int(max(n.max(), m.max())) + b + 2, len(group)
    x, y = np.full((size + b + 2, count), -2, np.int32), np.full((size + b + 2, count), -3, np.int32)
    for table, codes, begin, lengths, turn in ((x, ref, r0[group], n, (size - 1, -1)), (y, heard, h0[group], m, (b + 1, 1))):
        k = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        table[turn[0] + turn[1] * k, np.repeat(np.arange(count), lengths)] = codes[np.repeat(begin, lengths) + k]
    # even, odd: costs on the diagonals -b, -b + 2, ..., b and those between.
    even, odd, out = np.full((b + 1, count), far, kind), np.full((b + 2, count), far, kind), np.zeros(count, np.int64)
    even[b // 2] = 0
    due: dict[int, list[int]] = {}
    for g, t in enumerate((n + m).tolist()):
        due.setdefault(t, []).append(g)
    other, near = np.empty((b + 2, count), kind), np.empty((b + 2, count), kind)
    for t in range(1, int((n + m).max()) + 1):
        # Cell k is diagonal 2k - b (odd t: 2k + 1 - b), in row top - k and column left + k.
        top, left, w = ((t + b - 1) // 2, (t - b + 1) // 2, b) if t % 2 else ((t + b) // 2, (t - b) // 2, b + 1)
        # Rows and columns beyond the lists' ends are never come back from; those before their beginnings stay far.
        lo, hi = max(0, -left, top - size + 1), min(w, top + 1, size - left)
        if lo < hi:
            old, own = (even, odd[1:-1]) if t % 2 else (odd, even)
            cells, o, q = own[lo:hi], other[: hi - lo], near[: hi - lo]
            np.minimum(old[lo:hi], old[lo + 1 : hi + 1], out=q)
            q += kind(unit)
            np.not_equal(x[size - top + lo : size - top + hi], y[b + left + lo : b + left + hi], out=o, casting="unsafe")
            if change != 1:
                o *= kind(change)
            cells += o
            np.minimum(cells, q, out=cells)
            np.minimum(cells, far, out=cells)
        if t in due:
            g = np.array(due[t])
            out[g] = (odd[1:-1] if t % 2 else even)[(m[g] - n[g] + b) // 2, g]
    return out // unit, out % unit


def similarity_cost(a: Column, b: Column) -> Column:
    """Cost of hearing word b for a, per mille of a missing word's (LONE): 0 for the same, else 500 to 1000, less the more characters they share in place."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 0).when((a == "") | (b == ""), 1000).otherwise((F.lit(1000) - F.floor((longest - F.levenshtein(a, b)) * 500 / longest)).cast("int"))


def exact_cost(a: Column, b: Column) -> Column:
    """Cost of another word: a little over that of a missing one, so that of equally many errors those with fewer changed words are chosen."""
    return F.when(a == b, 0).otherwise(SUBSTITUTION)


PAIRS = "array<struct<a:int,b:int,same:boolean>>"


def cheapest_path(n: int, m: int, costs: np.ndarray, lone: int) -> list[dict]:
    """Pairs (a, b, same) of an alignment of least cost. costs: of every pair, n rows of m; lone: of a word without partner. From the end backwards, of equal
    costs a pair goes before a missing word, that before an extra one."""
    costs, steps = costs.reshape(n, m), np.arange(m + 1) * lone
    rows = np.empty((n + 1, m + 1), np.int64)
    rows[0] = steps
    for i in range(n):
        here = rows[i] + lone
        here[1:] = np.minimum(here[1:], rows[i, :-1] + costs[i])
        rows[i + 1] = np.minimum.accumulate(here - steps) + steps
    i, j, found, price, table = n, m, [], costs.tolist(), rows.tolist()
    while i or j:
        if i and j and table[i][j] == table[i - 1][j - 1] + price[i - 1][j - 1]:
            i, j = i - 1, j - 1
            found.append({"a": i, "b": j, "same": price[i][j] == 0})
        elif i and table[i][j] == table[i - 1][j] + lone:
            i -= 1
            found.append({"a": i, "b": None, "same": False})
        else:
            j -= 1
            found.append({"a": None, "b": j, "same": False})
    return found[::-1]


#: Costs of pairs of words that a task keeps.
MOST_COSTS = 500_000
#: Least cost of one word for another by similarity_cost.
LEAST_CHANGE = 501


class Similar:
    """Alignments of least cost by similarity_cost and LONE, as cheapest_path finds them. Only cells of the cost table that a path of least cost can reach are
    looked at, and words are compared only where taking one for the other can be as cheap as leaving both alone."""

    def __init__(self) -> None:
        self.costs: dict[tuple[str, str], int] = {}

    def cost(self, v: str, w: str) -> int:
        if not v or not w:
            return LONE
        found = self.costs.get((v, w))
        if found is None:
            if len(self.costs) > MOST_COSTS:
                self.costs.clear()
            longest = max(len(v), len(w))
            found = self.costs[v, w] = LONE - (longest - words_apart(v, w)) * 500 // longest
        return found

    def path(self, x: list[str], y: list[str]) -> list[tuple[int | None, int | None, bool]]:
        n, m = len(x), len(y)
        equal = 0
        while equal < min(n, m) and x[n - 1 - equal] == y[m - 1 - equal]:
            equal += 1
        n, m = n - equal, m - equal
        # A path that leaves the band leaves at least so many words alone; from its cost follows a band that holds every best path.
        width = 2
        rows = self._table(x, y, n, m, width)
        most = (rows[n][m] // LONE - abs(n - m)) // 2
        if most > width:
            rows = self._table(x, y, n, m, most)
        i, j, found = n, m, []
        while i or j:
            here, back = rows[i][j], rows[i - 1].get(j - 1) if i and j else None
            if back is not None and back <= here and ((x[i - 1] == y[j - 1] and back == here) or (x[i - 1] != y[j - 1] and back + LEAST_CHANGE <= here and back + self.cost(x[i - 1], y[j - 1]) == here)):
                i, j = i - 1, j - 1
                found.append((i, j, x[i] == y[j]))
            elif i and rows[i - 1].get(j, -1) + LONE == here:
                i -= 1
                found.append((i, None, False))
            else:
                j -= 1
                found.append((None, j, False))
        return found[::-1] + [(n + k, m + k, True) for k in range(equal)]

    def _table(self, x: list[str], y: list[str], n: int, m: int, width: int) -> list[dict[int, int]]:
        """Costs by row, of columns within the band."""
        low, high = min(0, m - n) - width, max(0, m - n) + width
        row = {j: j * LONE for j in range(min(m, high) + 1)}
        rows = [row]
        for i in range(1, n + 1):
            v, new, left = x[i - 1], {}, FAR
            for j in range(max(0, i + low), min(m, i + high) + 1):
                best = min(left, row.get(j, FAR)) + LONE
                if j:
                    back = row.get(j - 1)
                    if back is not None and back < best:
                        if v == y[j - 1]:
                            best = back
                        elif back + LEAST_CHANGE <= best:
                            best = min(best, back + self.cost(v, y[j - 1]))
                new[j] = left = best
            rows.append(new)
            row = new
        return rows


def _with_similar_pairs(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    at, to = df.columns.index(a), df.columns.index(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        similar = Similar()
        for whole in batches:
            for begin in range(0, whole.num_rows, 1000):
                batch = whole.slice(begin, 1000)
                found = [similar.path(x or [], y or []) for x, y in zip(batch.column(at).to_pylist(), batch.column(to).to_pylist(), strict=True)]
                sides = list(zip(*itertools.chain.from_iterable(found), strict=True)) or [(), (), ()]
                pairs = pa.StructArray.from_arrays([pa.array(sides[0], pa.int32()), pa.array(sides[1], pa.int32()), pa.array(sides[2], pa.bool_())], ["a", "b", "same"])
                ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pairs)], [*batch.schema.names, name])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(name, df.sparkSession.createDataFrame([], f"p {PAIRS}").schema[0].dataType)]))


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df by keys over as many partitions as the session's shuffles have, and no fewer: what follows is heavy for its bytes, and adaptive execution would put
    small partitions together."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def with_pairs(df: DataFrame, a: str, b: str, name: str, cost: Callable[[Column, Column], Column] = exact_cost, lone: int = EDIT) -> DataFrame:
    """df with the column name: array of (a, b, same), an edit-distance alignment of the word lists a and b; positions or null, in order. Costs of all pairs, beside lone
    for a word without partner, are a column of Spark's; a kernel walks through them. Work and memory are the lists' lengths multiplied, so lists should be
    chunks; by similarity_cost and LONE only what the best paths can reach is looked at. Null lists are empty."""
    if cost is similarity_cost and lone == LONE:
        return _with_similar_pairs(df, a, b, name)
    none = F.array().cast("array<string>")
    x, y = F.coalesce(a, none), F.coalesce(b, none)

    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("same", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables, out = batch.column(batch.num_columns - 1), []
            values, ends = tables.values.to_numpy(zero_copy_only=False), tables.offsets.to_pylist()
            for at, end in itertools.pairwise(ends):
                n, m = values[at : at + 2].tolist()
                out.append(cheapest_path(n, m, values[at + 2 : end], lone))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, kind)], [*batch.schema.names[:-1], name])

    # Not a column function: lambdas in such a one's arguments would be merged into it, and are not taken out of it.
    costs = F.flatten(F.transform(x, lambda v: F.transform(y, lambda w: cost(v, w).cast("int"))))
    table = df.withColumn("cost_table", F.concat(F.array(F.size(x), F.size(y)), costs))
    return table.mapInArrow(run, StructType([*df.schema.fields, StructField(name, df.sparkSession.createDataFrame([], f"p {PAIRS}").schema[0].dataType)]))


def _grams(df: DataFrame, by: list[str], at: str, n: int) -> DataFrame:
    """by, g (hash of n words), at: runs of n words that occur once per `by`. Each side is counted by its own keys before any join, so a frequent run
    never meets itself."""
    w = W.partitionBy(*by).orderBy(at)
    words = [F.lead("norm", k).over(w) if k else F.col("norm") for k in range(n)]
    g = df.select(*by, at, F.xxhash64(*words).alias("g"), words[-1].alias("last")).where("last IS NOT NULL")
    return g.groupBy(*by, "g").agg(F.count("*").alias("c"), F.min(at).alias(at)).where("c = 1").drop("c")


def anchors(a: DataFrame, b: DataFrame, n: int = 3) -> DataFrame:
    """(job_id, a_idx, b_idx): n-grams that occur once on both sides. a, b: job_id, idx, norm. A hash join on the n-grams' 64-bit hashes."""
    side = lambda df, name: _grams(df.select("job_id", F.col("idx").alias(name), "norm"), ["job_id"], name, n)
    return side(a, "a_idx").join(side(b, "b_idx"), ["job_id", "g"]).drop("g")


def backwards(by: list[str], *order: str) -> W:
    """All rows after this one, as those before it in the reverse order: Spark adds to such a frame row by row, while it computes one that begins at the
    row and has no end afresh for each row, which takes the square of a job's length."""
    return W.partitionBy(*by).orderBy(*[F.desc(c) for c in order]).rowsBetween(W.unboundedPreceding, -1)


FAR = 1 << 40


def lone(codes: np.ndarray, begin: np.ndarray, n: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-grams that occur once in their list, ascending, and where. begin: where each list begins, and the end of the last."""
    unit, until = np.repeat(np.arange(len(begin) - 1), np.diff(begin)), np.repeat(begin[1:], np.diff(begin))
    whole = np.arange(len(codes)) + n <= until
    whole[: len(codes) - n + 1] &= codes[n - 1 :] >= 0
    at = np.flatnonzero(whole)
    key = unit[at].astype(np.uint64)
    for k in range(n):
        key = key * np.uint64(0x9E3779B97F4A7C15) + codes[at + k].astype(np.uint64)
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(key)
    key, at = key[order], at[order]
    new = np.ones(len(key) + 1, bool)
    new[1:-1] = key[1:] != key[:-1]
    once = new[1:] & new[:-1]
    return key[once], at[once]


def _in_order(place: np.ndarray, pos: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of matches (place in the reference, pos) of units those that no other of their unit crosses."""
    x = pos + unit * FAR
    ok = np.ones(len(x), bool)
    ok[1:] = np.maximum.accumulate(x)[:-1] < x[1:]
    ok[:-1] &= np.minimum.accumulate(x[::-1])[::-1][1:] > x[:-1]
    return place[ok], pos[ok]


def _around(place: np.ndarray, pos: np.ndarray, start: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each word of the reference the last match up to it and the first after it: (place, pos) each, place -1 for none in the word's unit."""
    found = np.zeros(len(start), np.int64)
    found[place] = 1
    found = np.cumsum(found)
    places, values = np.concatenate([place, [-1]]), np.concatenate([pos, [-1]])
    low, high = places[found - 1], places[found]
    low_ok, high_ok = (found > 0) & (low >= start), (found < len(place)) & (high < until)
    return np.where(low_ok, low, -1), values[found - 1], np.where(high_ok, high, -1), values[found]


def matched(ref: np.ndarray, r0: np.ndarray, heard: np.ndarray, h0: np.ndarray, n: int = 3, ref_grams: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(pos, same) of each word of the reference, as `aligned` says, pos -1 for none. ref, heard: words' codes (one code a norm; -1 for none) of many units one after the
    other; r0, h0: where each unit begins, and the end of the last. ref_grams: the reference's `lone`, where several hear it."""
    sizes, lengths = np.diff(r0), np.diff(h0)
    every = np.arange(len(sizes))
    unit, mine = np.repeat(every, sizes), np.repeat(every, lengths)
    place, pos = np.empty(0, np.int64), np.empty(0, np.int64)
    if len(ref) and len(heard):
        rk, ra = ref_grams or lone(ref, r0, n)
        hk, ha = lone(heard, h0, n)
        i = np.searchsorted(rk, hk)
        both = np.append(rk, 0)[i] == hk
        both &= i < len(rk)
        ra, ha = ra[i[both]], ha[both]
        # Words of equal keys are compared themselves.
        real = unit[ra] == mine[ha]
        for k in range(n):
            real &= ref[ra + k] == heard[ha + k]
        place, pos = ra[real], ha[real] - h0[mine[ha[real]]]
    # Equal words that both sides begin and end with.
    at = np.arange(len(heard)) - h0[mine]
    back = sizes[mine] - lengths[mine] + at
    differs = lambda k: np.where((k >= 0) & (k < sizes[mine]), np.append(ref, -2)[np.clip(r0[mine] + k, 0, len(ref))] != heard, True)
    full = lengths > 0
    p, q = lengths.copy(), lengths.copy()
    if len(heard):
        own, starts = lengths[mine], h0[:-1][full]
        p[full] = np.minimum.reduceat(np.where(differs(at), at, own), starts)
        q[full] = np.minimum.reduceat(np.where(differs(back), own - 1 - at, own), starts)
    p = np.minimum(p, sizes)
    q = np.minimum(q, np.minimum(sizes, lengths) - p)
    u, v = every[p > 0], every[q > 0]
    first = np.full(len(ref), FAR)
    first[place] = pos
    for where, what in ((r0[u] + p[u] - 1, p[u] - 1), (r0[v + 1] - q[v], lengths[v] - q[v])):
        first[where] = np.minimum(first[where], what)
    place = np.flatnonzero(first < FAR)
    place, pos = _in_order(place, first[place], unit[place])
    # On from the match before, and else from the one after, at the same distance.
    here, start, until = np.arange(len(ref)), r0[unit], r0[unit + 1]
    low, low_pos, high, high_pos = _around(place, pos, start, until)
    ahead, behind = here - low + low_pos, here - high + high_pos
    ahead_ok = (low >= 0) & ((high < 0) | (ahead < high_pos))
    behind_ok = (high >= 0) & ((low < 0) | (behind > low_pos))
    said = np.append(heard, -2)
    equal = lambda k, ok: ok & (k >= 0) & (k < lengths[unit]) & (ref >= 0) & (said[np.where(ok & (k >= 0) & (k < lengths[unit]), h0[unit] + k, len(heard))] == ref)
    ahead_ok, behind_ok = equal(ahead, ahead_ok), equal(behind, behind_ok)
    place = np.flatnonzero(ahead_ok | behind_ok)
    place, pos = _in_order(place, np.where(ahead_ok, ahead, behind)[place], unit[place])
    # Between neighbouring matches place and pos both advance by as much, so distances are equal there.
    low, low_pos, high, high_pos = _around(place, pos, start, until)
    out = np.where((low >= 0) & (high >= 0) & (high - low == high_pos - low_pos), low_pos + here - low, -1)
    same = np.zeros(len(ref), bool)
    out[place], same[place] = pos, True
    return out, same


def coded(*lists: pa.Array) -> tuple[pa.Array, list[np.ndarray]]:
    """The distinct words of arrays, and each array as places in them; -1 for null."""
    d = pa.concat_arrays([x.cast(pa.string()) for x in lists]).dictionary_encode()
    codes, ends = d.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum([0, *map(len, lists)])
    return d.dictionary, [codes[a:b] for a, b in itertools.pairwise(ends)]


def ends_of(lists: pa.Array) -> np.ndarray:
    """Where each list begins among all elements, and the end of the last; null lists are empty."""
    return np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)


def aligned(ref: DataFrame, heard: DataFrame, n: int = 3) -> DataFrame:
    """(job_id, engine, idx, pos, same): which word of what an engine heard stands for which word of the reference. ref: job_id, idx, norm;
    heard: job_id, engine, pos, norm; each side has its own positions, from 0 on.

    Runs of n words that are unique on both sides are anchors, and so are the ends of what both begin and end with; those that others cross go. From the anchor before, and else from the one after, words
    match on at the same distance as long as they are equal (same). Between matches, equally many words on both sides stand for each other (not same);
    any other word has no partner. Each side is shuffled once, as lists; a kernel matches many jobs' lists at a time."""
    def make(r: np.ndarray, r0: np.ndarray, h: np.ndarray, h0: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        pos, same = matched(r, r0, h, h0, n)
        hit = np.flatnonzero(pos >= 0)
        unit = np.repeat(np.arange(len(r0) - 1), np.diff(r0))[hit]
        return unit, [hit - r0[unit], pos[hit], same[hit]]

    return over_lists(ref, heard, [ref.schema["idx"], StructField("pos", LongType()), StructField("same", BooleanType())], make)


Make = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, list[np.ndarray]]]


def over_lists(ref: DataFrame, heard: DataFrame, fields: list[StructField], make: Make) -> DataFrame:
    """(job_id, engine, *fields): what make finds in many pairs of lists at a time, of the reference's words and of what an engine heard of the job. make: codes and beginnings of
    both sides to rows' pairs and columns. ref: job_id, idx, norm; heard: job_id, engine, pos, norm. Each side is shuffled once, as lists."""
    listed = lambda at: F.transform(F.sort_array(F.collect_list(F.struct(at, "norm"))), lambda x: x["norm"])
    ref_lists = ref.groupBy("job_id").agg(listed("idx").alias("ref"))
    heard_lists = heard.groupBy("job_id", "engine").agg(listed("pos").alias("heard")).groupBy("job_id").agg(F.collect_list(F.struct("engine", "heard")).alias("by_engine"))
    both = ref_lists.join(heard_lists, "job_id").select("job_id", "ref", F.explode("by_engine").alias("e")).select("job_id", "e.engine", "ref", "e.heard")
    names, types = [f.name for f in fields], [{"int": pa.int32(), "boolean": pa.bool_()}.get(f.dataType.simpleString(), pa.int64()) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            words = np.cumsum(np.diff(ends_of(whole.column(2))) + np.diff(ends_of(whole.column(3))))
            cuts = [0, *(np.flatnonzero(np.diff(words // STEP)) + 1).tolist(), whole.num_rows]
            for a, b in itertools.pairwise(cuts):
                part = whole.slice(a, b - a)
                r, h = coded(part.column(2).flatten(), part.column(3).flatten())[1]
                unit, columns = make(r, ends_of(part.column(2)), h, ends_of(part.column(3)))
                keys = [part.column(k).take(pa.array(unit)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, *[pa.array(c).cast(t) for c, t in zip(columns, types, strict=True)]], ["job_id", "engine", *names])

    return both.mapInArrow(run, StructType([ref.schema["job_id"], heard.schema["engine"], *fields]))


def block_errors(ref: np.ndarray, r0: np.ndarray, heard: np.ndarray, h0: np.ndarray, match: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(errors, blocks) of many pairs of lists: matched words cut both sides into gaps, whose distances are summed. match: what `matched` found, where that is known."""
    pos, same = match or matched(ref, r0, heard, h0)
    unit, mine = np.repeat(np.arange(len(r0) - 1), np.diff(r0)), np.repeat(np.arange(len(h0) - 1), np.diff(h0))
    taken = np.zeros(len(heard), bool)
    taken[(h0[unit] + pos)[same]] = True
    # Gaps are numbered by the matches before them; each pair of lists begins a gap, too.
    x, y = (np.cumsum(same) + unit)[~same], (np.cumsum(taken) + mine)[~taken]
    gaps = int(same.sum()) + len(r0)
    begin = lambda k: np.searchsorted(k, np.arange(gaps + 1))
    n, m = np.bincount(x, minlength=gaps), np.bincount(y, minlength=gaps)
    wrong, _ = edit_costs(ref[~same], begin(x), heard[~taken], begin(y), np.maximum(n, m), split=False)
    owner = np.zeros(gaps, np.int64)
    owner[np.cumsum(same)[same] + unit[same]] = unit[same]
    first = np.concatenate([[0], np.cumsum(same)])[r0[:-1]] + np.arange(len(r0) - 1)
    owner[first] = np.arange(len(r0) - 1)
    total = lambda v: np.bincount(owner, v, len(r0) - 1).astype(np.int64)
    return total(wrong), total((n > 0) | (m > 0))


def extended(pairs: DataFrame, n: int = 3) -> DataFrame:
    """Anchors' n-grams as pairs of single words (job_id, a_idx, b_idx)."""
    return pairs.select("job_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"), "a_idx", "b_idx").select("job_id", (F.col("a_idx") + F.col("k")).alias("a_idx"), (F.col("b_idx") + F.col("k")).alias("b_idx")).distinct()
