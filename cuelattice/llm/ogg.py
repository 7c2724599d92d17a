"""Media column: payloads stored as Ogg files (RFC 3533) and read back from their pages.

Writer: a payload is cut into packets of 576 bytes (one byte is one 8-bit sample) that alternate between two
logical streams; pages of the two streams are interleaved, and a page's granule position is the number of the
payload's samples up to the end of the last packet that ends on it. Reader: finds pages by their capture pattern, verifies
each page's checksum, reassembles packets from lacing values (also over page borders), demultiplexes the logical
streams by serial number, and derives times from granule positions.

Defined cases: null and empty texts store one unit of padding; pages with a wrong checksum or cut short are
skipped and counted; a stream whose last page (by its end flag) is missing counts as open, so a file cut at a page's border is told from a whole one; packets of lost pages, of streams without a head, or that lose a part are left out of the payload and counted; bytes
that are no Ogg file give an empty payload; equal payloads give equal bytes; a very long text is one file, held whole by its task; repeated rows, null
ids and other columns, whatever their names, change nothing; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelattice.llm.shared import bound_batches, written

UNIT, RATE, PAGE_PACKETS = 576, 8000, 80
HEADER = struct.Struct("<4sBBqIIIB")
#: First packet of each logical stream: magic, packet size, sample rate, number of streams, index of this one.
HEAD = struct.Struct("<8sHIBB")
MAGIC, SERIALS = b"TextPCM8", (0x54585430, 0x54585431)
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(data: bytes) -> int:
    """Ogg's checksum: polynomial 0x04c11db7, most significant bit first, start and end 0. It is zlib's CRC-32 with
    the bits of every byte, and of the result, in mirrored order."""
    crc = zlib.crc32(data.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_MIRROR), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    parts = HEADER.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body
    return parts[:22] + struct.pack("<I", page_crc(parts)) + parts[26:]


def lacing_of(packet: bytes) -> bytes:
    return b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])


def padded(data: bytes) -> bytes:
    return data + b"\xff" * (UNIT - len(data) % UNIT if len(data) % UNIT or not data else 0)


def mux(payload: bytes) -> bytes:
    """The Ogg file of a payload whose length is a multiple of UNIT."""
    n = len(SERIALS)
    pages = [_page(2, 0, s, 0, lacing_of(h := HEAD.pack(MAGIC, UNIT, RATE, n, i)), h) for i, s in enumerate(SERIALS)]
    packets = [payload[i : i + UNIT] for i in range(0, len(payload), UNIT)]
    for number, first in enumerate(range(0, max(1, len(packets)), PAGE_PACKETS * n), 1):
        last = first + PAGE_PACKETS * n >= len(packets)
        for i, serial in enumerate(SERIALS):
            own = packets[first + i : first + PAGE_PACKETS * n : n]
            end = (first + i + n * (len(own) - 1) + 1) * UNIT if own else -1
            pages.append(_page(4 * last, end, serial, number, b"".join(map(lacing_of, own)), b"".join(own)))
    return b"".join(pages)


class Packet(NamedTuple):
    serial: int
    data: bytes
    #: The page's granule position, for the last packet that ends on a page; else -1.
    granule: int


class Ogg(NamedTuple):
    packets: list[Packet]
    pages: int
    bad_pages: int
    lost_packets: int
    #: Logical streams without a page that bears the end flag.
    open_streams: int


def demux(media: bytes) -> Ogg:
    """Packets of all logical streams, in the order in which they end."""
    packets: list[Packet] = []
    partial: dict[int, bytes | None] = {}
    expected: dict[int, int] = {}
    closed: set[int] = set()
    at = pages = bad = lost = 0
    while (at := media.find(b"OggS", at)) >= 0 and at + HEADER.size <= len(media):
        _, _, flags, granule, serial, number, crc, n = HEADER.unpack_from(media, at)
        lacing = media[at + HEADER.size : at + HEADER.size + n]
        end = at + HEADER.size + n + sum(lacing)
        whole = media[at:end]
        if len(lacing) < n or end > len(media) or page_crc(whole[:22] + b"\0\0\0\0" + whole[26:]) != crc:
            bad, at = bad + 1, at + 4
            continue
        pages += 1
        if flags & 4:
            closed.add(serial)
        held = partial.pop(serial, None)
        gap = number != expected.get(serial, number)
        expected[serial] = number + 1
        lost += held is not None and (gap or not flags & 1)
        parts = held if flags & 1 and not gap else None
        skip = bool(flags & 1) and parts is None  # the first packet's beginning is missing
        lost += skip and held is None
        first, body, ended = len(packets), HEADER.size + n + at, []
        size, begun = 0, body
        for x in lacing:
            size += x
            if x < 255:
                data = media[begun : begun + size]
                if not skip:
                    packets.append(Packet(serial, data if parts is None else parts + data, -1))
                ended.append(len(packets))
                begun, size, parts, skip = begun + size, 0, None, False
        if n and lacing[-1] == 255 and not skip:
            partial[serial] = (parts or b"") + media[begun : begun + size]
        if ended and len(packets) > first:
            packets[-1] = packets[-1]._replace(granule=granule)
        at = end
    return Ogg(packets, pages, bad, lost + len(partial), len(expected.keys() - closed))


def payload_of(ogg: Ogg) -> tuple[bytes, str]:
    """The payload, and a line of features. A page's granule position says where its last packet ends, so each packet has its place, whatever
    else was lost; packets that are lost, have no head of their stream or no place are left out and counted."""
    heads: dict[int, tuple[int, int]] = {}  # serial -> (number of streams, index of this one)
    places: dict[int, bytes] = {}
    lost, marks, at = ogg.lost_packets, 0, {}
    for p in reversed(ogg.packets):  # from each page's last packet backwards
        if p.data[:8] == MAGIC and len(p.data) == HEAD.size:
            _, _, _, n, index = HEAD.unpack(p.data)
            heads[p.serial] = n, index
            continue
        marks += p.granule >= 0
        if p.granule >= 0:
            at[p.serial] = p.granule // UNIT - 1
        elif p.serial in at:
            at[p.serial] -= len(SERIALS)
        if at.get(p.serial, -1) >= 0 and len(p.data) == UNIT:
            places[at[p.serial]] = p.data
        else:
            lost += 1
    known = {index for _, index in heads.values()}
    kept = {i: data for i, data in places.items() if i % len(SERIALS) in known}
    end = max(places, default=-1) + 1
    lost += end - len(kept)
    payload = b"".join(kept[i] for i in sorted(kept))
    return payload, f"streams={len(known)};pages={ogg.pages};bad={ogg.bad_pages};lost={lost};open={ogg.open_streams};packets={len(kept)};marks={marks};samples={end * UNIT};ms={end * UNIT * 1000 // RATE}"


def stored(text: Column) -> Column:
    """Text column -> Ogg bytes."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([mux(padded((x.as_py() or "").encode())) for x in texts], pa.binary())

    return F.arrow_udf(run, "binary")(text)


def features(media: Column) -> Column:
    """Ogg bytes -> struct(payload_bytes, payload_sha256, tail_crc32, feature)."""

    def run(files: pa.Array) -> pa.Array:
        rows = []
        for x in files:
            payload, line = payload_of(demux(x.as_py()))
            rows.append({"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:]), "feature": line})
        return pa.array(rows, pa.struct([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("feature", pa.string())]))

    return F.arrow_udf(run, "payload_bytes long, payload_sha256 string, tail_crc32 long, feature string")(media)


def media_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the media column of every document, written to the shared folder and read from there."""
    bound_batches(docs.sparkSession)
    made = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), stored(F.col("text")).alias("media"))
    return written(made, "ogg")[0]


def media_features(docs: DataFrame) -> DataFrame:
    read = media_table(docs).select("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), features(F.col("media")).alias("f"))
    return read.select("doc_id", "n_bytes", "f.payload_bytes", "f.payload_sha256", "f.tail_crc32", "media_bytes", "media_sha256", "f.feature")
