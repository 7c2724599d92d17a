"""Substring dedup by sliding sentence spans.

A text is cut into sentences, with their closing marks and the white space after them, so that the pieces joined are
the text. Every run of SPAN consecutive sentences with at least MIN_WORDS words is hashed (128 bits, over lower-cased words with single
blanks). A run's first occurrence is the one in the smallest doc_id, and there the earliest. The sentences that any
other occurrence covers are removed.

Repeats within a document are found while it is read. Across documents only each document's first occurrence counts:
the smallest doc_id per hash is an aggregate with partial sums on the map side, so a run that a third of all documents
share is one row per task; the join back deals such a hash anew by adaptive skew handling.

Defined cases: null texts stay null and empty ones empty; a row without doc_id is neither first nor changed; rows that
repeat doc_id and text are the same document, so none of them is a repeat of the other; of rows that repeat a doc_id with different texts, that
with the smaller hash of its text comes first; very long texts are cut whole, and hold one row a run; further columns stay as they are, whatever their
names; an empty table gives no rows. Runs with fewer than MIN_WORDS words are no passage and are not looked for.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelattice.llm.shared import bound_batches, dropped, written

SPAN, MIN_WORDS = 2, 12
SENTENCE = r"[^.!?\n]*[.!?\n]+[ \t\r\n\f\v]*|[^.!?\n]+"
_SPLIT = re.compile(SENTENCE).findall


def sentences(text: str | None) -> list[str]:
    return _SPLIT(text) if text else []


def runs(parts: list[str], span: int, min_words: int) -> Iterator[tuple[int, bytes]]:
    """(first sentence, hash) of each run that has enough words."""
    words = [p.lower().split() for p in parts]
    sizes, plain = [len(w) for w in words], [" ".join(w) for w in words]
    for i in range(len(parts) - span + 1):
        if sum(sizes[i : i + span]) >= min_words:
            yield i, hashlib.blake2b("\n".join(plain[i : i + span]).encode(), digest_size=16).digest()


def span_table(docs: DataFrame, span: int, min_words: int) -> DataFrame:
    """doc_id, own (hash of the text), at (first sentence), h1 and h2 (the hash) of each run that is new in its document; and, with null hashes, of
    each that the document had before."""
    bound_batches(docs.sparkSession)
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for doc, own, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                seen = set()
                for at, h in runs(sentences(text), span, min_words):
                    again = h in seen
                    seen.add(h)
                    for col, v in zip(cols, (doc, own, at, *((None, None) if again else (int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)))), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "own", "at", "h1", "h2"])

    return docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("own"), "text").mapInArrow(run, "doc_id long, own long, at int, h1 long, h2 long")


def repeated(runs: DataFrame, *where: str) -> DataFrame:
    """doc_id, own and the columns `where` of every run (h1, h2) that is not the first of its kind. A run comes at most once a document, but for
    null hashes, which are repeats within the document."""
    new = runs.where("h1 IS NOT NULL")
    again = runs.where("h1 IS NULL").select("doc_id", "own", *where)
    first = F.min("doc_id").alias("first")
    if runs.groupBy("doc_id").agg(F.min("own").alias("least"), F.max("own").alias("most")).where("least != most").isEmpty():
        least = new.groupBy("h1", "h2").agg(first, F.max("doc_id").alias("last")).where("first < last").drop("last")
        return new.join(least, ["h1", "h2"]).where("doc_id > first").select("doc_id", "own", *where).unionByName(again)
    # Some doc_id has several texts: the first run is that of the smallest (doc_id, hash of the text).
    least = new.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "own")).alias("first"), F.max(F.struct("doc_id", "own")).alias("last")).where("first < last").drop("last")
    return new.join(least, ["h1", "h2"]).where(F.struct("doc_id", "own") > F.col("first")).select("doc_id", "own", *where).unionByName(again)


def kept_text(text: Column, covered: Column) -> Column:
    """struct(text, n_sentences) without the sentences whose numbers are in covered (null: none)."""

    def run(texts: pa.Array, numbers: pa.Array) -> pa.Array:
        out, n = [], []
        for t, gone in zip(texts.to_pylist(), numbers.to_pylist(), strict=True):
            parts = sentences(t)
            n.append(len(parts))
            skip = set(gone or ())
            out.append("".join(p for i, p in enumerate(parts) if i not in skip) if skip else t)
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(n, pa.int64())], ["text", "n_sentences"])

    return F.arrow_udf(run, "text string, n_sentences long")(text, covered)


def covered_sentences(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS) -> tuple[DataFrame, str]:
    """(doc_id, own, covered: sorted numbers of the sentences to remove), and the path of the scratch table behind it."""
    table, path = written(span_table(docs, span, min_words), "spans")
    numbers = F.flatten(F.collect_set(F.sequence("at", F.col("at") + span - 1)))
    return repeated(table, "at").groupBy("doc_id", "own").agg(F.sort_array(F.array_distinct(numbers)).alias("covered")), path


def with_covered(docs: DataFrame, covered: DataFrame) -> DataFrame:
    """doc (all of docs' columns) and covered, by row. covered grows with the corpus, so it is never broadcast, however small it looks."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").alias("id_"), F.xxhash64("text").alias("own_"))
    found = covered.select(F.col("doc_id").alias("id_"), F.col("own").alias("own_"), "covered")
    return rows.join(found.hint("merge"), ["id_", "own_"], "left").select("doc", "covered")


def without_repeats(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS) -> DataFrame:
    """doc (docs' columns, with the text that is left) and removed (n_sentences, covered) of every row."""
    covered, at = covered_sentences(docs, span, min_words)
    covered, _ = written(covered, "covered")
    dropped(docs.sparkSession, at)
    both = with_covered(docs, covered)
    both = both.select("doc", "covered", kept_text(F.col("doc.text"), F.col("covered")).alias("kept"))
    return both.select(F.struct(*[F.col("kept.text").alias("text") if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns]).alias("doc"), F.struct(F.col("kept.n_sentences"), F.coalesce("covered", F.array().cast("array<int>")).alias("covered")).alias("removed"))


def deduplicated(docs: DataFrame) -> DataFrame:
    out = without_repeats(docs.select("doc_id", "text"))
    return out.select("doc.doc_id", "removed.n_sentences", F.size("removed.covered").cast("long").alias("n_removed"), F.array_join(F.col("removed.covered").cast("array<string>"), ",").alias("removed"), "doc.text")


_PLAIN = "trim(regexp_replace(lower(s), '[ \\t\\r\\n\\f\\v]+', ' ', 'g'))"
#: Runs of two sentences, by their text.
SQL = rf"""WITH p AS (SELECT doc_id, text, regexp_extract_all(text, '{SENTENCE}') AS parts FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(parts) + 1)) - 1 AS pos, unnest(parts) AS s FROM p),
w AS (SELECT doc_id, pos, {_PLAIN} AS s FROM s),
v AS (SELECT doc_id, pos, s, lead(s) OVER (PARTITION BY doc_id ORDER BY pos) AS t FROM w),
r AS (SELECT doc_id, pos, s || chr(10) || t AS run FROM v WHERE t IS NOT NULL AND len(list_filter(string_split(s, ' '), lambda x: x <> '')) + len(list_filter(string_split(t, ' '), lambda x: x <> '')) >= {MIN_WORDS}),
k AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS rank FROM r),
c AS (SELECT DISTINCT doc_id, pos + d AS pos FROM k, (VALUES (0), (1)) g(d) WHERE rank > 1)
SELECT p.doc_id, len(parts)::BIGINT AS n_sentences, count(c.pos) AS n_removed, coalesce(string_agg(c.pos::VARCHAR, ',' ORDER BY c.pos), '') AS removed,
  coalesce((SELECT string_agg(s.s, '' ORDER BY s.pos) FROM s WHERE s.doc_id = p.doc_id AND NOT EXISTS (SELECT 1 FROM c c2 WHERE c2.doc_id = s.doc_id AND c2.pos = s.pos)), '') AS text
FROM p LEFT JOIN c ON c.doc_id = p.doc_id GROUP BY p.doc_id, p.parts"""
