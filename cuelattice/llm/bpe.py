"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Pre-tokens are linked lists of symbols; many of them stand one behind the other and share one queue, as no pair crosses their
borders. Every adjacent pair that a vocabulary entry spells waits in the bucket of its merge rank; a two-level bitmap of 256-bit
words says which buckets hold entries, so find-first-set gives the next rank in constant time, however long a pre-token is. Entries
whose pair has changed meanwhile are stale and are skipped when they come up. Within a bucket the leftmost position goes
first, as the merge rule asks; should a merge make a pair of lower rank, the rest of the bucket waits again.

A task keeps the ids of stretches between blanks that it met lately; of a batch only the new ones go through the queue, and texts that
repeat in a batch are encoded once.

Defined cases: null and empty texts give no ids; a vocabulary that lacks a needed byte raises KeyError; very long texts are split at blanks
UNIT characters at a time, and one pre-token is always merged as a whole; rows are independent, so repeated rows, null ids and further
columns, whatever their names, change nothing; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import re
from array import array
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelattice.llm.shared import bound_batches

#: Stretches between blanks that a task keeps with their ids: so many new ones beside as many older ones.
KEPT = 200_000
#: Longer stretches are encoded afresh each time.
CACHE_CHARS = 64
#: Characters of text split, and bytes of pre-tokens merged, at a time (or one longer text, or pre-token).
UNIT, MERGED = 1 << 18, 1 << 16
#: The two levels hold ranks below 2 ** 18.
BITS = [1 << i for i in range(1024)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Vocabulary file of lines 'base64 rank'."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Ranks(dict):
    """Token -> rank, which is its id; and the ranks of single bytes and of pairs of bytes as arrays (-1: none)."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__(ranks)
        self.single = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)
        self.double = np.full(1 << 16, -1, np.int64)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.double[token[0] << 8 | token[1]] = rank


def merged(ranks: Ranks, pieces: Sequence[bytes]) -> list[bytes]:
    """Packed ids of each (non-empty) pre-token: its pairs merged in order of rank, leftmost first."""
    data = b"".join(pieces)
    n = len(data)
    ends = np.cumsum([len(p) for p in pieces])
    buf = np.frombuffer(data, np.uint8)
    border = np.zeros(n + 1, bool)  # where a pre-token begins, or the last one ends
    border[0] = True
    border[ends] = True
    pairs = np.full(n, -1, np.int64)
    pairs[:-1] = np.where(border[1:-1], -1, ranks.double[buf[:-1].astype(np.int64) << 8 | buf[1:]])
    pair = pairs.tolist()  # rank of the pair that starts here; -1: none, or the symbol was merged away
    first = border.tobytes()
    # The list is linked by lengths, which stay small numbers: of the symbol that starts here, and of the one to its left.
    own, left = [1] * n, [1] * n
    single = ranks.single[buf]
    if (single < 0).any():
        raise KeyError(bytes([buf[int((single < 0).argmax())]]))
    ids = single.tolist()  # -1: merged away
    buckets: dict[int, list[int]] = {}
    low: dict[int, int] = {}
    top = 0
    waiting = np.flatnonzero(pairs >= 0)
    waiting = waiting[np.argsort(pairs[waiting], kind="stable")]
    kinds, starts = np.unique(pairs[waiting], return_index=True)
    for rank, group in zip(kinds.tolist(), np.split(waiting, starts[1:]), strict=False):
        buckets[rank] = group.tolist()
        low[rank >> 8] = low.get(rank >> 8, 0) | BITS[rank & 255]
        top |= BITS[rank >> 8]
    get, held = ranks.get, buckets.get
    while top:  # find-first-set on both levels
        word = (top & -top).bit_length() - 1
        bits = low[word]
        lowest = bits & -bits
        rank = (word << 8) + lowest.bit_length() - 1
        if bits == lowest:
            top ^= BITS[word]
        low[word] = bits ^ lowest
        bucket = buckets.pop(rank)
        bucket.sort()
        for nth, i in enumerate(bucket):
            if pair[i] != rank:  # stale
                continue
            j = i + own[i]
            k = j + own[j]
            own[i] = size = k - i
            pair[j] = ids[j] = -1
            ids[i] = rank
            least = rank
            if first[k]:
                pair[i] = -1
            else:
                left[k] = size
                new = get(data[i : k + own[k]])
                if new is None:
                    pair[i] = -1
                else:
                    pair[i] = new
                    waits = held(new)
                    if waits is not None:
                        waits.append(i)
                    else:
                        buckets[new] = [i]
                        word = new >> 8
                        low[word] = low.get(word, 0) | BITS[new & 255]
                        top |= BITS[word]
                    if new < least:
                        least = new
            if not first[i]:
                p = i - left[i]
                new = get(data[p:k])
                if new is None:
                    pair[p] = -1
                else:
                    pair[p] = new
                    waits = held(new)
                    if waits is not None:
                        waits.append(p)
                    else:
                        buckets[new] = [p]
                        word = new >> 8
                        low[word] = low.get(word, 0) | BITS[new & 255]
                        top |= BITS[word]
                    if new < least:
                        least = new
            if least < rank:
                rest = bucket[nth + 1 :]
                if rest:
                    waits = held(rank)
                    if waits is not None:
                        waits += rest
                    else:
                        buckets[rank] = rest
                        word = rank >> 8
                        low[word] = low.get(word, 0) | BITS[rank & 255]
                        top |= BITS[word]
                break
    every = np.array(ids)
    alive = every >= 0
    packed = memoryview(every[alive].astype("<u4").tobytes())
    cuts = [0, *(4 * np.cumsum(alive)[ends - 1]).tolist()]
    return [bytes(packed[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def merge_ids(ranks: dict[bytes, int], piece: bytes) -> list[int]:
    """Ids of one pre-token."""
    return list(array("I", encoded_pieces(Ranks(ranks), [piece])[0]))


def encoded_pieces(ranks: Ranks, pieces: Sequence[bytes]) -> list[bytes]:
    """Packed ids of each pre-token; one that is a vocabulary entry is just that."""
    whole = [ranks.get(p) for p in pieces]
    groups: list[list[bytes]] = [[]]
    size = 0
    for piece, rank in zip(pieces, whole, strict=True):
        if rank is None:
            if groups[-1] and size + len(piece) > MERGED:
                groups.append([])
                size = 0
            groups[-1].append(piece)
            size += len(piece)
    made = (ids for group in groups if group for ids in merged(ranks, group))
    return [next(made) if rank is None else rank.to_bytes(4, "little") for rank in whole]


#: White space beside a blank or line end, or one of those at the end of the text: matches of the pattern may cross it.
_CROSSED = re.compile(r"\s[ \n]|[ \n]\s|[ \n]\Z").search

_LINE_END = ("\n",)


class Codec:
    """Between two other non-space characters a blank always starts a match of the pattern, and a line end is one, so what stands
    between those is matched, and kept, by itself."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, keep: int = KEPT):
        self.ranks, self.split, self.keep = Ranks(ranks), regex.compile(pattern).findall, keep
        #: Stretch -> packed ids. A stretch after a blank goes without it; any other is a tuple of one.
        self.known: dict[str | tuple[str], bytes] = {}
        self.older: dict[str | tuple[str], bytes] = {}
        self.tokens = {i: token for token, i in ranks.items()}

    def _stretches(self, text: str) -> list[str | tuple[str]]:
        if not _CROSSED(text):
            out = []
            for line in text.split("\n"):
                first, *parts = line.split(" ")
                out += [_LINE_END, (first,), *parts] if out else [(first,), *parts]
            return out
        first, *parts = text.split(" ")
        out = [first]
        for part in parts:
            before = out[-1]
            if not part or part[0].isspace() or not before or before[-1].isspace():
                out[-1] = before + " " + part
            else:
                out.append(" " + part)
        return [(x,) for x in out]

    def _learn(self, stretches: set[str | tuple[str]]) -> None:
        known, split, ids = self.known, {}, {}
        for s in stretches:
            kept = self.older.get(s)
            if kept is not None:
                known[s] = kept
                continue
            pieces = split[s] = self.split(s[0]) if type(s) is tuple else [" " + s] if s.isalpha() else self.split(" " + s)
            for p in pieces:
                if p not in ids:  # a piece after a blank may be known as a stretch
                    ids[p] = known.get(p[1:]) if p[0] == " " else None
        new = [p for p, known_ids in ids.items() if known_ids is None]
        ids.update(zip(new, encoded_pieces(self.ranks, [p.encode() for p in new]), strict=True))
        for s, pieces in split.items():
            known[s] = ids[pieces[0]] if len(pieces) == 1 else b"".join([ids[p] for p in pieces])

    def _unit(self, texts: list[str]) -> list[bytes]:
        parts = [self._stretches(t) for t in texts]
        known = self.known
        new = set().union(*parts).difference(known)
        self._learn(new)
        out = [b"".join(map(known.__getitem__, p)) for p in parts]
        for s in new:
            if len(s if type(s) is str else s[0]) > CACHE_CHARS:
                del known[s]
        if len(known) > self.keep:
            self.older, self.known = known, {}
        return out

    def _cut(self, text: str) -> Iterable[str]:
        """Parts of a very long text, cut where a match begins."""
        at = 0
        while len(text) - at > UNIT:
            end = text.find(" ", at + UNIT)
            while end >= 0 and (text[end - 1].isspace() or text[end + 1 : end + 2].isspace() or end + 1 == len(text)):
                end = text.find(" ", end + 1)
            if end < 0:
                break
            yield text[at:end]
            at = end
        yield text[at:]

    def encode_all(self, texts: Sequence[str | None]) -> list[bytes]:
        """Packed ids (little-endian unsigned 32-bit integers) of each text."""
        out: dict[str | None, bytes] = {None: b"", "": b""}
        held: list[str] = []
        size = 0
        for text in dict.fromkeys(texts):
            if not text:
                continue
            if held and size + len(text) > UNIT:
                out.update(zip(held, self._unit(held), strict=True))
                held, size = [], 0
            if len(text) > UNIT:
                out[text] = b"".join([self._unit([part])[0] for part in self._cut(text)])
            else:
                held.append(text)
                size += len(text)
        if held:
            out.update(zip(held, self._unit(held), strict=True))
        return [out[t] for t in texts]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, packed: bytes | None) -> bytes:
        ids = array("I")
        ids.frombytes(packed or b"")
        return b"".join(map(self.tokens.__getitem__, ids))

    def decode_all(self, packed: Sequence[bytes | None]) -> list[bytes]:
        out = {p: self.decode(p) for p in dict.fromkeys(packed)}
        return [out[p] for p in packed]


    def forget(self) -> None:
        self.known, self.older = {}, {}


@functools.lru_cache(maxsize=1)
def codec(path: str, pattern: str) -> Codec:
    """One per worker process; what it keeps is for one task, so that idle workers hold the vocabulary alone."""
    return Codec(read_ranks(path), pattern)


def tokenized(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (packed), n_tokens and the decoded bytes of every whole text. No shuffle: rows are independent."""
    bound_batches(docs.sparkSession, 500, 4 << 20)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            ids = own.encode_all(b.column(1).to_pylist())
            cols = [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(own.decode_all(ids), pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "ids", "n_tokens", "decoded"])
        own.forget()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary, n_tokens long, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    return tokenized(docs, path, pattern).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
