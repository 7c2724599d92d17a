"""Benchmark decontamination: words of documents inside any n-gram of the benchmark's items.

The windows of the items' normalised words go to all tasks as a sorted set of 64-bit hashes with the words themselves. A task walks over the words of
its documents, looks up the hash of every window and compares the words of each hit, so equal hashes of different words count for nothing.
A window is n words; an item of fewer, but not none, is one window of all its words.

The set is broadcast only while it has at most MOST_WINDOWS windows. A larger benchmark is cut into pieces of at most PIECE windows, dealt
to as many slices as keep each below that bound, and the documents are walked over once a slice; what the slices found is joined by
(doc_id, hash of text). So memory is bounded whatever the benchmark, and no window is left out.

Texts are read as UTF-8, in units of at most UNIT bytes, and batches of rows are bounded by bytes; words may span units.

Defined cases: a null or wordless document has no words and no hits; a null or wordless item has no window. Repeated items are one item if they
have the same item_id (a null one counts as the id ''); repeated documents are judged one by one. An empty benchmark leaves everything clean.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelattice.llm.shared import bound_batches

N = 10
MOST_WINDOWS, PIECE = 1 << 20, 4096
UNIT = 1 << 20
#: Most leading bits of a hash that a first table answers for.
LEAD = 22
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
FOUND = "n_words long, n_hit long, items array<string>, runs array<struct<first:long,last:long,start:long,end:long>>"

_B, _C = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_ALL = (1 << 64) - 1
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Roll:
    """Sums of x[i] base^(i - from) over ranges of positions, modulo 2^64, for up to n positions at a time."""

    def __init__(self, base: int, n: int):
        self.base, self.up, self.down = base, powers(base, n), powers(pow(base, -1, 1 << 64), n)

    def sums(self, x: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * self.up[: len(x)], out=total[1:])
        return (total[end] - total[first]) * self.down[first]


class Reader:
    """Words of texts in one buffer of bytes."""

    def __init__(self):
        self.roll, self.words = Roll(_B, UNIT), Roll(_C, UNIT)

    def split(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and hashes of the words, and for each text the number of words before it and at last of all. ends: where each text ends."""
        starts_at, ends_at, hashes = [], [], []
        for low in range(0, len(data), UNIT):
            part = _FOLD[data[low : low + UNIT]]
            inside = _IS_WORD[part]
            opens = inside.copy()
            opens[1:] &= ~inside[:-1]
            cuts = ends[np.searchsorted(ends, low) : np.searchsorted(ends, low + len(part))] - low
            opens[cuts] |= inside[cuts]
            s = np.flatnonzero(opens)
            closed = np.append(~inside[1:], True)
            closed[cuts[cuts > 0] - 1] = True
            e = np.flatnonzero(inside & closed) + 1
            h = self.roll.sums(part.astype(np.uint64), s, e)
            if len(s) and s[0] == 0 and low and ends_at and ends_at[-1][-1:].tolist() == [low] and low not in cuts + low:
                # The unit begins inside a word: join its halves.
                length = int(low - starts_at[-1][-1])
                hashes[-1][-1] = np.uint64((int(hashes[-1][-1]) + int(h[0]) * pow(_B, length, 1 << 64)) & _ALL)
                ends_at[-1][-1] = e[0] + low
                s, e, h = s[1:], e[1:], h[1:]
            if len(s):
                starts_at.append(s + low)
                ends_at.append(e + low)
                hashes.append(h)
        put = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
        s, e, h = put(starts_at, np.int64), put(ends_at, np.int64), put(hashes, np.uint64)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        return s, e, h, np.searchsorted(s, np.concatenate([[0], ends]))

    def windows(self, hashes: np.ndarray, n: int) -> np.ndarray:
        """Hash of every n words in a row, across texts too."""
        out = []
        for low in range(0, len(hashes) - n + 1, UNIT - n):
            part = hashes[low : low + UNIT]
            first = np.arange(len(part) - n + 1)[: UNIT - n]
            out.append(self.words.sums(part, first, first + n))
        h = np.concatenate(out) if out else np.zeros(0, np.uint64)
        return h ^ (h >> np.uint64(31))


class Windows:
    """The windows of items by length: sorted hashes, where the words are, and which items have them."""

    def __init__(self, items: list[tuple[str, str]], n: int = N):
        reader = Reader()
        blobs = [text.encode() for _, text in items]
        self.names, self.n = [name for name, _ in items], n
        self.data = _FOLD[np.frombuffer(b"\n".join(blobs) + b"\n", np.uint8)]
        ends = np.cumsum([len(b) + 1 for b in blobs]) if blobs else np.zeros(0, np.int64)
        s, e, h, first = reader.split(self.data, ends)
        self.starts, self.ends = s, e
        count = np.diff(first)
        self.sets = {}
        for length in sorted({min(int(c), n) for c in count if c}):
            of = np.flatnonzero(count >= n) if length == n else np.flatnonzero(count == length)
            at = np.concatenate([np.arange(first[i], first[i] + count[i] - length + 1) for i in of])
            item = np.repeat(of, count[of] - length + 1)
            keys = reader.windows(h, length)[at]
            order = np.argsort(keys, kind="stable")
            self.sets[length] = self._distinct(keys[order], at[order], item[order], length)

    def text(self, at: int, length: int) -> list[bytes]:
        return [self.data[a:b].tobytes() for a, b in zip(self.starts[at : at + length].tolist(), self.ends[at : at + length].tolist(), strict=True)]

    def _distinct(self, keys: np.ndarray, at: np.ndarray, item: np.ndarray, length: int) -> tuple:
        """Distinct hashes and the table of their leading bits; for each hash its different windows (their words' place), for each of those its items. Flat
        arrays with offsets, as a Python object per window would be many times larger."""
        values, begin, size = np.unique(keys, return_index=True, return_counts=True)
        label = np.zeros(len(keys), np.int64)
        for a, c in zip(begin[size > 1].tolist(), size[size > 1].tolist(), strict=True):
            seen: dict[tuple[bytes, ...], int] = {}
            label[a : a + c] = [seen.setdefault(tuple(self.text(i, length)), len(seen)) for i in at[a : a + c].tolist()]
        rank = np.repeat(np.arange(len(values)), size)
        order = np.lexsort((item, label, rank))
        rank, label, at, item = rank[order], label[order], at[order], item[order]
        fresh = np.append(True, (np.diff(rank) != 0) | (np.diff(label) != 0))
        other = fresh | np.append(True, np.diff(item) != 0)
        windows = np.searchsorted(rank[fresh], np.arange(len(values) + 1))
        items = np.append(np.cumsum(other)[fresh] - 1, other.sum())
        lead = min(LEAD, max(8, int(len(values) * 8).bit_length()))
        table = np.zeros(1 << lead, bool)
        table[(values >> np.uint64(64 - lead)).astype(np.int64)] = True
        return values, table, lead, windows, at[fresh], items, item[other]

    def hits(self, reader: Reader, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list]:
        """Words of each text, and for each text None or (words hit, items' numbers, runs of hit words). data: folded bytes."""
        s, e, h, first = reader.split(data, ends)
        of = np.repeat(np.arange(len(ends)), np.diff(first))
        cover, who = np.zeros(len(s) + 1, np.int64), {}
        for length, (values, table, lead, windows, places, firsts, items) in self.sets.items():
            keys = reader.windows(h, length)
            near = np.flatnonzero(table[(keys >> np.uint64(64 - lead)).astype(np.int64)])
            rank = np.minimum(np.searchsorted(values, keys[near]), len(values) - 1)
            ok = (values[rank] == keys[near]) & (of[near] == of[near + length - 1])
            met = set()
            for i, r in zip(near[ok].tolist(), rank[ok].tolist(), strict=True):
                own = [data[a:b].tobytes() for a, b in zip(s[i : i + length].tolist(), e[i : i + length].tolist(), strict=True)]
                for v in range(windows[r], windows[r + 1]):
                    if self.text(int(places[v]), length) == own:
                        cover[i] += 1
                        cover[i + length] -= 1
                        met.add((int(of[i]), v))
            for t, v in met:
                who.setdefault(t, set()).update(items[firsts[v] : firsts[v + 1]].tolist())
        hit = np.cumsum(cover[:-1]) > 0
        out = [None] * len(ends)
        for t, numbers in who.items():
            own = hit[first[t] : first[t + 1]]
            edge = np.diff(np.concatenate([[False], own, [False]]).astype(np.int8))
            a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
            low = int(ends[t - 1]) if t else 0
            runs = [{"first": int(x), "last": int(y), "start": int(s[first[t] + x]) - low, "end": int(e[first[t] + y]) - low} for x, y in zip(a, b, strict=True)]
            out[t] = (int(own.sum()), sorted({self.names[i] for i in numbers}), runs)
        return np.diff(first), out


def pieces(benchmark: DataFrame, n: int = N) -> DataFrame:
    """item_id (text), words, n_windows: the items' words in pieces of at most PIECE windows; neighbours share n - 1 words, so no window is lost."""
    words = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"({WORD})"), 1)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words.alias("words")).where("size(words) > 0")
    begins = F.sequence(F.lit(0), F.greatest(F.size("words") - n, F.lit(0)), F.lit(PIECE))
    cut = items.select("item_id", F.explode(F.transform(begins, lambda i: F.slice("words", i + 1, PIECE + n - 1))).alias("words"))
    return cut.select("item_id", F.array_join("words", " ").alias("words"), F.greatest(F.size("words") - n + 1, F.lit(1)).alias("n_windows"))


def slices(benchmark: DataFrame, n: int = N) -> Iterator[Windows]:
    """Sets of at most MOST_WINDOWS windows (PIECE more at the edges) that together hold every window; one if the benchmark is no larger."""
    parts = pieces(benchmark, n).distinct()
    total = parts.agg(F.sum("n_windows")).first()[0] or 0
    # Dealt by hash, so slices are planned half full and each is measured before it is fetched.
    count = 1 if total <= MOST_WINDOWS else -(-2 * total // MOST_WINDOWS)
    dealt = parts.withColumn("slice", F.pmod(F.xxhash64("item_id", "words"), F.lit(count)))
    for k in range(count):
        own = dealt.where(F.col("slice") == k)
        size = own.agg(F.sum("n_windows")).first()[0] or 0
        if size > 2 * MOST_WINDOWS:
            raise ValueError(f"{size} windows in one slice of the benchmark")
        yield Windows([(r.item_id, r.words) for r in own.select("item_id", "words").collect()], n)


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a batch's texts and where each ends; nulls are empty."""
    blob = column.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(blob.buffers()[1], np.int64)[blob.offset : blob.offset + len(blob) + 1]
    data = np.frombuffer(blob.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return data, ends[1:] - ends[0]


def _walked(docs: DataFrame, windows: Windows, only_hits: bool) -> DataFrame:
    """docs (its last column `text` goes) with the columns FOUND."""
    spark = docs.sparkSession
    bound_batches(spark, size=8 << 20)
    shared = spark.sparkContext.broadcast(windows)
    kept = [c for c in docs.columns if c != "text"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, own = Reader(), shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            data, ends = _texts(batch.column("text"))
            n_words, found = own.hits(reader, _FOLD[data], ends)
            columns = [pa.array(n_words, pa.int64()), pa.array([x[0] if x else 0 for x in found], pa.int64()), pa.array([x[1] if x else [] for x in found], pa.list_(pa.string()))]
            columns.append(pa.array([x[2] if x else [] for x in found], pa.list_(pa.struct([(c, pa.int64()) for c in ("first", "last", "start", "end")]))))
            out = pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + columns, [*kept, "n_words", "n_hit", "items", "runs"])
            yield out.filter(pa.array([x is not None for x in found])) if only_hits else out

    schema = docs.drop("text").schema
    for f in spark.createDataFrame([], FOUND).schema:
        schema = schema.add(f)
    return docs.mapInArrow(walk, schema)


def _merged(runs: Column) -> Column:
    """Union of runs of words, in order."""
    last = lambda acc: F.element_at(acc, -1)
    join = lambda acc, x: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["first"].alias("first"), F.greatest(last(acc)["last"], x["last"]).alias("last"), last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], x["end"]).alias("end"))))
    step = lambda acc, x: F.when((F.size(acc) > 0) & (x["first"] <= F.try_element_at(acc, F.lit(-1))["last"] + 1), join(acc, x)).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(F.array_sort(runs), F.array().cast("array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>"), step)


def scanned(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """docs with the column `leak`: n_words, n_hit, items (sorted ids as texts), runs of hit words (first and last word, start and end byte)."""
    sets = slices(benchmark, n)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole_row"), F.col("text"))
    leak = F.struct("n_words", "n_hit", "items", "runs").alias("leak")
    first = next(sets)
    others = list(_walked_slices(docs, sets))
    found = _walked(rows, first, False)
    if others:
        key = [F.col("whole_row.doc_id").alias("doc_id"), F.sha2(F.coalesce("whole_row.text", F.lit("")), 256).alias("h")]
        more = reduce(DataFrame.unionByName, others).groupBy("doc_id", "h").agg(F.flatten(F.collect_list("items")).alias("more_items"), F.flatten(F.collect_list("runs")).alias("more_runs"))
        named = F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("nameless"), "h"
        found = found.select("*", *key).select("whole_row", "n_words", "items", "runs", *named).join(more.select(*named, "more_items", "more_runs"), ["id", "nameless", "h"], "left")
        runs = _merged(F.concat("runs", F.coalesce("more_runs", F.array())))
        hit = F.aggregate("runs", F.lit(0).cast("long"), lambda a, x: a + x["last"] - x["first"] + 1).alias("n_hit")
        items = F.array_sort(F.array_distinct(F.concat("items", F.coalesce("more_items", F.array()))))
        found = found.select("whole_row", "n_words", items.alias("items"), runs.alias("runs")).select("*", hit)
    return found.select("whole_row.*", leak)


def _walked_slices(docs: DataFrame, sets: Iterator[Windows]) -> Iterator[DataFrame]:
    for windows in sets:
        rows = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"), "text")
        # Copies under one doc_id would find the same once each.
        yield _walked(rows, windows, True).dropDuplicates(["doc_id", "h"])


def without_runs(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """docs with the hit words cut out of `text`, from the first to the last of each run; the blanks around them stay."""
    found = scanned(docs, benchmark, n)
    raw = F.col("text").cast("binary")
    kept = F.aggregate("leak.runs", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts")), lambda a, x: F.struct(x["end"].alias("at"), F.concat(a["parts"], F.array(F.substring(raw, a["at"].cast("int") + 1, (x["start"] - a["at"]).cast("int")).cast("string"))).alias("parts")))
    tail = F.substring(raw, F.col("kept.at").cast("int") + 1, F.octet_length("text")).cast("string")
    cut = F.when(F.col("leak.n_hit") > 0, F.concat(F.array_join("kept.parts", ""), tail)).otherwise(F.col("text"))
    return found.withColumn("kept", kept).select(*[cut.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def without_documents(docs: DataFrame, benchmark: DataFrame, least_share: float = 0.0, n: int = N) -> DataFrame:
    """docs without those of which more than least_share of the words are hit (0: any)."""
    bad = F.col("leak.n_hit") > least_share * F.col("leak.n_words")
    return scanned(docs, benchmark, n).where(~bad).drop("leak")


def audited(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = scanned(docs.select("doc_id", "text"), benchmark)
    items = F.sha2(F.array_join("leak.items", ","), 256)
    return found.select("doc_id", "leak.n_words", "leak.n_hit", F.size("leak.items").cast("long").alias("n_items"), items.alias("items_sha256"), (F.col("leak.n_hit") > 0).alias("contaminated"))


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')"
SQL = rf"""WITH i AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, {_WORDS} AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(ws), {N}) AS k, array_to_string(ws[p:p + least(len(ws), {N}) - 1], ' ') AS w FROM (SELECT *, unnest(range(1, greatest(len(ws) - {N}, 0) + 2)) AS p FROM i WHERE len(ws) > 0)),
d AS (SELECT row_number() OVER () AS id, doc_id, {_WORDS} AS ws FROM documents),
dw AS (SELECT id, p, k, array_to_string(ws[p:p + k - 1], ' ') AS w FROM (SELECT d.*, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM iw) WHERE len(ws) >= k)),
h AS (SELECT id, p, dw.k, item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.w = iw.w),
n AS (SELECT id, count(DISTINCT x) AS n_hit FROM (SELECT id, unnest(range(p, p + k)) AS x FROM h) GROUP BY 1),
t AS (SELECT id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256 FROM (SELECT DISTINCT id, item_id FROM h) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (id) LEFT JOIN t USING (id)"""
