"""Substring dedup of passages, wherever they begin and whatever sentences they have.

A text is cut into tokens, words with the white space after them, so that the tokens joined are the text; in scripts
without blanks each character is a word. Sentences end at stops (also non-Latin ones) and line ends. From each sentence
a run grows until it has SPAN sentences and MIN_WORDS words, and to each sentence's end one grows backwards, so that the runs
within a repeated passage of whole sentences cover all of it. Sentences of more than WINDOW words are cut further by content alone: of any
WINDOW pairs of neighbouring words the one with the smallest hash (the last of equal ones) gets a cut. Cuts by windows within a repeated passage
are the same wherever it is pasted; so a passage of n >= 2 * WINDOW + 19 words (51) loses all but WINDOW words at each end at most, whatever its
punctuation. A text that is one unit is a run by itself. Runs are hashed (96 bits, over lower-cased words). A run's
first occurrence is the one in the smallest doc_id, and there the earliest; the words that any other covers are removed.

Defined cases: as in spans.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelattice.llm.shared import bound_batches, dropped, written
from cuelattice.llm.spans import MIN_WORDS, SPAN, repeated, with_covered

WINDOW = 16
STOPS = ".!?。！？．｡।॥؟۔։።၊။។…"
#: Scripts without blanks: Thai, Lao, Myanmar, Khmer, kana, Han and their extensions.
DENSE = "฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ\U00020000-\U0003ffff"
_TOKENS = re.compile(rf"[{DENSE}]?[{STOPS}]+\s*|[{DENSE}]\s*|[^\s{STOPS}{DENSE}]+[{STOPS}]*\s*|\s+").findall
_ENDS = frozenset(STOPS)


def tokens(text: str | None) -> list[str]:
    return _TOKENS(text) if text else []


def _grown(ends: list[int], span: int, min_words: int, lead: int) -> Iterator[tuple[int, int]]:
    """(first token, token after the last) of the shortest runs of units that have enough units and words, from each unit on
    and up to each; ends are the units' ends, and lead is the number of tokens at the start that are no words."""
    cuts, n = [0, *ends], len(ends)
    words = [max(0, c - lead) for c in cuts]
    j = 0
    for i in range(n):
        j = max(j, i + span)
        while j <= n and words[j] - words[i] < min_words:
            j += 1
        if j > n:
            break
        yield cuts[i], cuts[j]
    i = n
    for j in range(n, 0, -1):
        i = min(i, j - span)
        while i >= 0 and words[j] - words[i] < min_words:
            i -= 1
        if i < 0:
            break
        yield cuts[i], cuts[j]


def content_cuts(plain: list[str]) -> list[int]:
    """Tokens before which a unit ends by content."""
    h = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in plain), np.uint64, len(plain))
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    pairs = (pairs ^ (pairs >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    pairs ^= pairs >> np.uint64(32)
    if len(pairs) < WINDOW:
        return []
    last = np.lib.stride_tricks.sliding_window_view(pairs[::-1], WINDOW).argmin(1)
    return np.unique(len(pairs) - np.arange(len(last)) - last).tolist()


def cut_long(ends: list[int], plain: list[str]) -> list[int]:
    """ends, and the content's cuts in sentences of more than WINDOW words."""
    starts = [0, *ends][: len(ends)]
    if all(b - a <= WINDOW for a, b in zip(starts, ends, strict=True)):
        return ends
    at, stop = np.array(content_cuts(plain), np.int64), np.array(ends)
    k = np.searchsorted(stop, at, "left")
    return np.union1d(stop, at[(stop - starts)[k] > WINDOW]).tolist()


def runs(parts: list[str], span: int = SPAN, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, bytes]]:
    """(first token, token after the last, hash) of each run, in order."""
    plain = [p.strip().lower() for p in parts]
    lead = int(bool(plain) and not plain[0])
    ends = [i for i, (p, w) in enumerate(zip(parts, plain, strict=True), 1) if w[-1:] in _ENDS or "\n" in p]
    if parts and ends[-1:] != [len(parts)]:
        ends.append(len(parts))
    ends = cut_long(ends, plain)
    whole = [(0, len(parts))] if len(ends) == 1 and len(parts) - lead >= min_words else []
    # Ranges that differ only in white space at the text's start are the same run.
    every = sorted([*_grown(ends, span, min_words, lead), *whole], reverse=True)
    found = {(max(a, lead), b): a for a, b in every}
    for (a, b), at in sorted(found.items()):
        yield at, b, hashlib.blake2b(" ".join(plain[a:b]).encode(), digest_size=12).digest()


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for at, until in sorted(ranges):
        if out and at <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], until))
        else:
            out.append((at, until))
    return out


def run_table(docs: DataFrame, span: int, min_words: int) -> DataFrame:
    """doc_id, own (hash of the text), at and until (its tokens), h1 and h2 (the hash) of each run that is new in its document; and, with null hashes,
    the merged ranges of those that the document had before."""
    bound_batches(docs.sparkSession)
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for doc, own, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                seen, again = set(), []
                for at, until, h in runs(tokens(text), span, min_words):
                    if h in seen:
                        again.append((at, until))
                        continue
                    seen.add(h)
                    for col, v in zip(cols, (doc, own, at, until, int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)), strict=True):
                        col.append(v)
                for at, until in merged(again):
                    for col, v in zip(cols, (doc, own, at, until, None, None), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "own", "at", "until", "h1", "h2"])

    return docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("own"), "text").mapInArrow(run, "doc_id long, own long, at int, until int, h1 long, h2 int")


def kept_text(text: Column, covered: Column) -> Column:
    """struct(text, n_words, n_removed, removed) without the tokens in the ranges of covered (null: none)."""

    def run(texts: pa.Array, ranges: pa.Array) -> pa.Array:
        cols: list[list] = [[], [], [], []]
        for t, gone in zip(texts.to_pylist(), ranges.to_pylist(), strict=True):
            parts, gone = tokens(t), merged([(r["at"], r["until"]) for r in gone or ()])
            left = [] if gone else [t]
            for (_, a), (b, _) in zip([(0, 0), *gone], [*gone, (len(parts), 0)], strict=True) if gone else ():
                left += parts[a:b]
            row = ("".join(left) if gone else t, len(parts), sum(b - a for a, b in gone), ",".join(f"{a}-{b - 1}" for a, b in gone))
            for col, v in zip(cols, row, strict=True):
                col.append(v)
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["text", "n_words", "n_removed", "removed"])

    # Else a filter on what is left is pushed below, and each task evaluates this twice, in two Python workers that the executor keeps.
    once = F.arrow_udf(run, "text string, n_words long, n_removed long, removed string").asNondeterministic()
    return once(text, covered)


def without_repeats(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS) -> DataFrame:
    """doc (docs' columns, with the text that is left) and removed (n_words, n_removed, removed) of every row."""
    table, at = written(run_table(docs, span, min_words), "runs")
    covered, _ = written(repeated(table, "at", "until").groupBy("doc_id", "own").agg(F.collect_set(F.struct("at", "until")).alias("covered")), "covered")
    dropped(docs.sparkSession, at)
    both = with_covered(docs, covered).select("doc", kept_text(F.col("doc.text"), F.col("covered")).alias("kept"))
    return both.select(F.struct(*[F.col("kept.text").alias("text") if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns]).alias("doc"), F.struct("kept.n_words", "kept.n_removed", "kept.removed").alias("removed"))


def deduplicated(docs: DataFrame) -> DataFrame:
    return without_repeats(docs.select("doc_id", "text")).select("doc.doc_id", "removed.n_words", "removed.n_removed", "removed.removed", "doc.text")
