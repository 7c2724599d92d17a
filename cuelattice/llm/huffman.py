"""Token-id files: canonical length-limited Huffman codes in independent blocks with bit-offset checkpoints.

Code lengths come from the ids' counts over the whole corpus by package-merge, so they are optimal under the
limit; codes are canonical, so the lengths alone define them. A block holds some whole documents' ids as one bit
stream (most significant bit first), and the bit offset of every 256th id. A reader needs only the block and the
code lengths; it decodes all checkpoints of a block side by side, one table look-up per id.

Documents stand in ascending doc_id order: range partitions, sorted within, and the running number of ids carried
from the sums per partition. The driver sees the counts per id (bounded by the vocabulary) and one sum per partition.

Defined cases: null and empty texts hold just the end id; documents without doc_id come first; rows that repeat
a doc_id are each written, next to each other, in the order of their ids' hash; a very long text is one document of one block; a text that spells one of
the tokenizer's special tokens gets that token's id, as from the library; other columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelattice.llm.shared import bound_batches, dropped, written

LIMIT, EVERY, BLOCK_IDS = 20, 256, 1 << 18
MAGIC = b"HUF1"
HEADER = struct.Struct("<4sBxxxIII")  # magic, longest code, ids, documents, checkpoints
#: Chunks between white space whose ids a worker keeps; beyond it the cache starts anew.
CACHE_ENTRIES, CACHE_CHARS = 1_300_000, 64


# --- codes -----------------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code length of each id, at most limit; 0 for ids that do not occur."""
    ids = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(ids)
    if n < 2:
        lengths[ids] = 1
        return lengths
    if n > 1 << limit:
        raise ValueError(f"{n} ids need codes longer than {limit}")
    ids = ids[np.lexsort((ids, counts[ids]))]
    leaves = counts[ids].astype(np.float64)
    # Package-merge: each level merges the leaves with pairs of the level below; a leaf's length is the number of
    # levels on which it is among those taken.
    level, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        order = np.argsort(both, kind="stable")
        level = both[order]
        is_leaf.append(order < n)
    take = 2 * n - 2
    got = np.zeros(n, np.uint8)
    for leaf in reversed(is_leaf):
        own = int(leaf[:take].sum())
        got[:own] += 1
        take = 2 * (take - own)
    lengths[ids] = got
    return lengths


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code of each id (uint32), and the ids in code order."""
    ids = np.flatnonzero(lengths)
    ids = ids[np.lexsort((ids, lengths[ids]))]
    own = lengths[ids].astype(np.int64)
    longest = int(own.max(initial=1))
    starts = np.cumsum(np.int64(1) << (longest - own)) - (np.int64(1) << (longest - own))
    codes = np.zeros(len(lengths), np.uint32)
    codes[ids] = starts >> (longest - own)
    return codes, ids


class Code:
    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.codes, order = canonical(lengths)
        self.longest = int(lengths.max(initial=1)) or 1
        spans = np.int64(1) << (self.longest - self.lengths[order])
        #: For each string of `longest` bits: the id whose code begins it, times 32, plus that code's length.
        self.look = np.zeros(1 << self.longest, np.uint32)
        filled = np.repeat(order.astype(np.uint32) * 32 + self.lengths[order].astype(np.uint32), spans)
        self.look[: len(filled)] = filled

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bit stream of ids, and the bit offset of every EVERY-th one."""
        own = self.lengths[ids]
        ends = np.cumsum(own)
        begins = ends - own
        words = np.zeros((int(ends[-1]) >> 5) + 2 if len(ids) else 1, np.uint64)
        # A code touches at most two 32-bit words; both halves are summed, as no two codes share a bit.
        shifted = self.codes[ids].astype(np.uint64) << (64 - (begins & 31) - own).astype(np.uint64)
        at = begins >> 5
        firsts = np.flatnonzero(np.diff(at, prepend=-1))
        if len(ids):
            words[at[firsts]] += np.bitwise_or.reduceat(shifted >> np.uint64(32), firsts)
            words[at[firsts] + 1] += np.bitwise_or.reduceat(shifted & np.uint64(0xFFFFFFFF), firsts)
        return words.astype(">u4").tobytes()[: (int(ends[-1]) + 7) // 8 if len(ids) else 0], begins[::EVERY]

    def unpack(self, stream: bytes, offsets: np.ndarray, n: int) -> np.ndarray:
        """n ids from their bit stream and checkpoints; all runs of EVERY ids advance together."""
        raw = np.frombuffer(stream + b"\0" * 8, np.uint8).astype(np.uint32)
        window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        bits, runs = offsets.astype(np.int64), len(offsets)
        out = np.empty((EVERY, runs), np.uint32)
        keep, last = 32 - self.longest, n - (runs - 1) * EVERY
        for step in range(EVERY):
            if step == last:  # the last run is shorter
                bits = bits[:-1]
            if not len(bits):
                break
            found = self.look[(window[bits >> 3] << (bits & 7).astype(np.uint32)) >> np.uint32(keep)]
            out[step, : len(bits)] = found >> 5
            bits = bits + (found & 31)
        return out.T.reshape(-1)[:n]


def write_block(code: Code, ids: np.ndarray, sizes: np.ndarray) -> bytes:
    """A block of whole documents: header, ids per document, checkpoints, bit stream, checksum."""
    stream, offsets = code.pack(ids)
    body = HEADER.pack(MAGIC, code.longest, len(ids), len(sizes), len(offsets)) + sizes.astype("<u4").tobytes() + offsets.astype("<u8").tobytes() + stream
    return body + struct.pack("<I", zlib.crc32(body))


def read_block(code: Code, block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """ids and ids per document of a block."""
    magic, longest, n, docs, runs = HEADER.unpack_from(block)
    if magic != MAGIC or longest != code.longest or zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("damaged block, or other codes than it was written with")
    at = HEADER.size
    sizes = np.frombuffer(block, "<u4", docs, at)
    offsets = np.frombuffer(block, "<u8", runs, at + 4 * docs)
    return code.unpack(block[at + 4 * docs + 8 * runs : -4], offsets, n), sizes


# --- token ids -------------------------------------------------------------------------------------------------------


class Words:
    """The tokenizer's ids, kept per lower-cased stretch between white space: its split never joins across white space,
    and its normalizer composes nothing across it and lower-cases. A stretch of letters with one mark behind it is
    looked up as the letters and the mark, as the split parts those."""

    #: str.split() parts at the first four too, while the tokenizer does not count them as white space; str.lower() looks around
    #: the last, while the tokenizer does not.
    ODD = "\x1c\x1d\x1e\x1f\u03a3"
    MARKS = frozenset(".,;:!?")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: The tokenizer looks for these before it splits, so a text that has one goes through it whole.
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Bytes of one id in the scratch table.
        self.width = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.known: dict[str, bytes] = {}

    def _plain(self, texts: list[str]) -> list[bytes]:
        kind = "H" if self.width == "<u2" else "I"
        return [array(kind, x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: set[str]) -> None:
        known = self.known
        marked = {c for c in chunks if c[-1] in self.MARKS and c[:-1].isalpha()}
        new = [c for c in (chunks - marked).union((c[:-1] for c in marked), (c[-1] for c in marked)) if c not in known]
        known.update(zip(new, self._plain(new), strict=True))
        for c in marked:
            known[c] = known[c[:-1]] + known[c[-1]]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        known, lower = self.known, [(x or "").lower() for x in texts]
        odd = [i for i, x in enumerate(texts) if x and (any(c in x for c in self.ODD) or any(c in lower[i] for c in self.special))]
        parts = [x.split() for x in lower]
        for i in odd:
            parts[i] = []
        every = set().union(*parts)
        new = every.difference(known)
        if len(known) + 2 * len(new) > CACHE_ENTRIES:
            known.clear()
            new = every
        self._learn(new)
        out = [b"".join(map(known.__getitem__, p)) for p in parts]
        for chunk in new:
            if len(chunk) > CACHE_CHARS:
                del known[chunk]
        for i, packed in zip(odd, self._plain([texts[i] for i in odd]), strict=True):
            out[i] = packed
        return out


@functools.lru_cache(maxsize=2)
def words_of(path: str) -> Words:
    return Words(path)


def id_table(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id and ids (packed, two bytes each if the vocabulary fits, else four) of every whole text, with the end id."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(path)
        end = np.array([end_id], words.width).tobytes()
        for b in batches:
            packed = words.encode(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x + end for x in packed], pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def id_counts(ids: DataFrame, width: str) -> np.ndarray:
    """Occurrences of each id over the whole corpus; as many rows reach the driver as there are different ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for b in batches:
            got = np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), width))
            if len(got) > len(total):
                total, got = got, total
            total[: len(got)] += got
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    rows = ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max([r.id for r in rows], default=0) + 1, np.int64)
    for r in rows:
        counts[r.id] = r.n
    return counts


def _blocks(code_of, width: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, doc_id, ids) in order -> rows (part, ids before in this part, doc_ids, n_ids, block)."""
    part, inside, names, held, size = None, 0, [], [], 0
    code, each = code_of(), np.dtype(width).itemsize

    def out() -> pa.RecordBatch:
        ids = np.frombuffer(b"".join(held), width)
        block = write_block(code, ids, np.array([len(x) // each for x in held]))
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([inside], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([size], pa.int64()), pa.array([block], pa.binary())], ["part", "inside", "doc_ids", "n_ids", "block"])

    for b in batches:
        for p, name, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and (p != part or size >= BLOCK_IDS):
                yield out()
                inside, names, held, size = inside + size if p == part else 0, [], [], 0
            part = p
            names.append(name)
            held.append(ids)
            size += len(ids) // each
    if held:
        yield out()


def write_files(docs: DataFrame, path: str, end_id: int = 1) -> tuple[DataFrame, DataFrame]:
    """Write the corpus' ids; returns the blocks' table (as read back) and the code lengths' (id, length) table."""
    spark = docs.sparkSession
    ids, at = written(id_table(docs, path, end_id), "ids")
    width = words_of(path).width
    lengths = code_lengths(id_counts(ids, width))
    shared = spark.sparkContext.broadcast(lengths)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    hashed = ids.withColumn("h", F.xxhash64("ids"))  # parts rows of the same doc_id, or of none
    ordered = hashed.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h", "ids").select(F.spark_partition_id().alias("part"), "doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _blocks(lambda: Code(shared.value), width, batches)

    blocks, _ = written(ordered.mapInArrow(run, "part int, inside long, doc_ids array<long>, n_ids long, block binary"), "huffman")
    codes = spark.createDataFrame(pa.table({"id": np.flatnonzero(lengths).astype(np.int64), "length": lengths[lengths > 0].astype(np.int32)}))
    codes, _ = written(codes, "huffman-lengths")
    dropped(spark, at)
    return blocks, codes


def read_files(blocks: DataFrame, codes: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document in the files."""
    spark = blocks.sparkSession
    rows = codes.collect()  # bounded by the vocabulary
    lengths = np.zeros(max([r.id for r in rows], default=0) + 1, np.uint8)
    for r in rows:
        lengths[r.id] = r.length
    sums = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # one row per partition
    before, total = {}, 0
    for r in sums:
        before[r.part], total = total, total + r.n
    shared = spark.sparkContext.broadcast((lengths, before))
    read = blocks.select("part", "inside", "doc_ids", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(shared.value[0])
        for b in batches:
            for part, inside, names, block in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids, sizes = read_block(code, block)
                ends = np.cumsum(sizes.astype(np.int64))
                begins = ends - sizes
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(begins + inside + shared.value[1][part]), pa.array(sizes.astype(np.int64)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def stored_ids(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    return read_files(*write_files(docs, path, end_id))
