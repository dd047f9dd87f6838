"""Ogg media columns: pages with checksums and lacing values, packets, logical streams, granule timestamps.

``encode_column`` stores bytes losslessly as unsigned 8-bit PCM in an Ogg file of two logical
streams (even bytes left, odd bytes right, as two mono tracks of one recording), in the layout of
the public OggPCM draft: a main header packet, a comment packet, then data packets. ``read_ogg``
knows nothing of that use: it verifies each page's checksum, finds the next capture pattern after
damage, reassembles packets from lacing values across pages, keeps streams apart by serial number
and derives packet times from granule positions.

Defined cases: a null text is empty; an empty text gives one block of 192 spaces; a page with a
wrong checksum is dropped and counted, and a packet that touches a lost page is dropped and counted
as well; null or empty media decode to zero pages and a null payload. Rows are independent, so ties
and repeated rows need no rule; columns that the operator adds replace columns of the same name.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

BLOCK = 192
RATE = 8000
#: Samples in a data packet: 20 lacing values each, so that a page of 255 holds 12 whole packets and part of the next.
PACKET = 5000
MAGIC = b"PCM     "
SERIALS = (1, 2)
CONTINUED, FIRST, LAST = 1, 2, 4

_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(page: bytes) -> int:
    """Ogg's checksum: CRC-32 with polynomial 04c11db7, most significant bit first, start 0, no final inversion.

    zlib's CRC has the same polynomial with mirrored bits, so mirrored bytes go in and the result is mirrored back.
    """
    raw = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(_MIRROR), "big")


def make_page(serial: int, seq: int, granule: int, flags: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack("<4sBBqIII", b"OggS", 0, flags, granule, serial, seq, 0) + bytes([len(lacing)]) + lacing
    crc = page_crc(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


def stream_pages(serial: int, packets: list[tuple[bytes, int]], headers: int) -> list[tuple[int, bytes]]:
    """(granule, page) of one logical stream. Each of the first ``headers`` packets has a page of its own."""
    pages: list[tuple[int, bytes]] = []
    lacing, body, granule, flags = bytearray(), [], -1, 0

    def flush(last: bool) -> None:
        nonlocal lacing, body, granule, flags
        kind = flags | (FIRST if not pages else 0) | (LAST if last else 0)
        pages.append((granule, make_page(serial, len(pages), granule, kind, bytes(lacing), b"".join(body))))
        lacing, body, granule, flags = bytearray(), [], -1, 0

    for n, (packet, end) in enumerate(packets):
        values = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        at = 0
        while at < len(values):
            if len(lacing) == 255:
                flush(False)
                flags = CONTINUED if at else 0
            take = values[at : at + 255 - len(lacing)]
            body.append(packet[at * 255 : at * 255 + sum(take)])
            lacing += take
            at += len(take)
        granule = end
        if n < headers and n + 1 < len(packets):
            flush(False)
    flush(True)
    return pages


def write_ogg(payload: bytes, n_bytes: int) -> bytes:
    """Two mono tracks; pages are interleaved by granule position, the first pages first."""
    head = MAGIC + struct.pack(">HHIIBBHI", 0, 0, 1, RATE, 8, 1, PACKET, 0)
    tracks = []
    for serial, track in zip(SERIALS, (payload[0::2], payload[1::2]), strict=True):
        note = f"track={serial}".encode(), f"bytes={n_bytes}".encode()
        comment = struct.pack("<I", 7) + b"pelagos" + struct.pack("<I", len(note)) + b"".join(struct.pack("<I", len(x)) + x for x in note)
        packets = [(head, 0), (comment, 0)]
        packets += [(track[i : i + PACKET], min(i + PACKET, len(track))) for i in range(0, len(track), PACKET)]
        tracks.append(stream_pages(serial, packets, headers=2))
    merged, time = [], 0
    for k, pages in enumerate(tracks):
        time = 0
        for n, (granule, page) in enumerate(pages):
            time = max(time, granule)
            merged.append(((n > 0, time, n, k), page))
    return b"".join(page for _, page in sorted(merged, key=lambda x: x[0]))


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    #: Granule position at each packet's end; -1 where no page states it.
    ends: list[int] = field(default_factory=list)
    lost: int = 0
    next_seq: int = 0
    partial: list[bytes] | None = None
    closed: bool = False


@dataclass
class Ogg:
    streams: dict[int, Stream]
    pages: int
    bad_pages: int
    gaps: int


def read_ogg(data: bytes) -> Ogg:
    """Demultiplex ``data``: verified pages only, packets put together again, lost ones counted."""
    out = Ogg({}, 0, 0, 0)
    at, size, view = 0, len(data), memoryview(data)
    while (at := data.find(b"OggS", at)) >= 0:
        if at + 27 > size:
            break
        _, version, flags, granule, serial, seq, crc = struct.unpack_from("<4sBBqIII", data, at)
        n = data[at + 26]
        start = at + 27 + n
        lacing = data[at + 27 : start]
        end = start + sum(lacing)
        if version or end > size or len(lacing) < n or page_crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            out.bad_pages += 1
            at += 4
            continue
        out.pages += 1
        s = out.streams.get(serial)
        if s is None:
            s = out.streams[serial] = Stream(serial)
            if not flags & FIRST:
                s.next_seq = -1
        if seq != s.next_seq:
            out.gaps += 1
            s.lost += s.partial is not None
            s.partial = None
        s.next_seq = seq + 1
        if s.partial is not None and not flags & CONTINUED:
            s.lost += 1
            s.partial = None
        skip = bool(flags & CONTINUED) and s.partial is None  # the packet's beginning is lost
        pos = begin = start
        last = -1
        for value in lacing:
            pos += value
            if value < 255:
                piece = bytes(view[begin:pos])
                if skip:
                    s.lost += 1
                    skip = False
                else:
                    s.packets.append(b"".join([*s.partial, piece]) if s.partial else piece)
                    s.ends.append(-1)
                    last = len(s.ends) - 1
                s.partial, begin = None, pos
        if begin < pos or (lacing and lacing[-1] == 255):
            if not skip:
                s.partial = [*(s.partial or []), bytes(view[begin:pos])]
        if last >= 0 and granule >= 0:
            s.ends[last] = granule
        s.closed |= bool(flags & LAST)
        at = end
    for s in out.streams.values():
        s.lost += s.partial is not None
    return out


def packet_ends(stream: Stream, samples: list[int]) -> list[int]:
    """Fill the granule positions that pages leave out, counting back from the next one that is stated, else on from the last."""
    ends = list(stream.ends)
    for i in range(len(ends) - 2, -1, -1):
        if ends[i] < 0 <= ends[i + 1]:
            ends[i] = ends[i + 1] - samples[i + 1]
    for i in range(1, len(ends)):
        if ends[i] < 0:
            ends[i] = ends[i - 1] + samples[i]
    return ends


@dataclass
class Recording:
    payload: bytes | None
    n_bytes: int | None
    duration_us: int
    ogg: Ogg


def read_recording(media: bytes | None) -> Recording:
    """Decode what ``write_ogg`` made. The payload is null unless both tracks are whole."""
    ogg = read_ogg(media or b"")
    tracks, n_bytes, longest = [], None, 0
    for serial in sorted(ogg.streams):
        s = ogg.streams[serial]
        if len(s.packets) < 2 or not s.packets[0].startswith(MAGIC):
            continue
        rate = struct.unpack_from(">I", s.packets[0], 16)[0] or RATE
        ends = packet_ends(s, [0, 0, *map(len, s.packets[2:])])
        longest = max(longest, ends[-1] * 1_000_000 // rate)
        at = s.packets[1].find(b"bytes=")
        if at >= 0:
            n_bytes = int(s.packets[1][at + 6 :].decode("ascii"))
        track = b"".join(s.packets[2:])
        if s.closed and not s.lost and ends[-1] == len(track):
            tracks.append(track)
    if len(tracks) != len(SERIALS) or ogg.bad_pages or ogg.gaps or len({*map(len, tracks)}) > 1:
        return Recording(None, n_bytes, longest, ogg)
    both = np.empty(sum(map(len, tracks)), np.uint8)
    for k, track in enumerate(tracks):
        both[k :: len(tracks)] = np.frombuffer(track, np.uint8)
    return Recording(both.tobytes(), n_bytes, longest, ogg)


def pad(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8")
    return raw + b" " * (max(1, -(-len(raw) // BLOCK)) * BLOCK - len(raw)), len(raw)


def encode_column(df: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """``df`` with ``media_col``, the Ogg file that holds ``text_col``."""
    keep = df.drop(media_col) if media_col != text_col else df
    at, schema = keep.columns.index(text_col), f"{_ddl(keep)}, `{media_col}` binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 256):
            media = pa.array([write_ogg(*pad(t)) for t in b.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, media], names=[*b.schema.names, media_col])

    return keep.mapInArrow(run, schema)


#: What ``decode_column`` adds, in this order.
DECODED = (
    ("payload", "binary"), ("n_bytes", "long"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string"),
    ("n_pages", "long"), ("bad_pages", "long"), ("n_streams", "long"), ("n_packets", "long"), ("lost_packets", "long"), ("duration_us", "long"),
)
_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def features(samples: bytes, n_packets: int, duration_us: int) -> str:
    """Peak, mean and energy of the signal around 128 and its sign changes, in whole numbers."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero(np.signbit(x[1:]) != np.signbit(x[:-1])))
    return f"packets={n_packets};us={duration_us};peak={int(np.abs(x).max())};sum={int(x.sum())};energy={int((x * x).sum())};crossings={crossings}"


def decode_column(df: DataFrame, media_col: str = "media", payload: bool = True) -> DataFrame:
    """``df`` with the columns DECODED, read from the stored bytes. ``payload=False`` leaves the payload out."""
    new = [x for x in DECODED if payload or x[0] != "payload"]
    keep = df.drop(*(c for c, _ in new if c != media_col))
    at, schema = keep.columns.index(media_col), ", ".join([_ddl(keep), *(f"`{c}` {t}" for c, t in new)])

    def one(media: bytes | None) -> dict:
        r = read_recording(media)
        streams = r.ogg.streams.values()
        n_packets = sum(len(s.packets) for s in streams)
        row = {"payload": r.payload, "n_bytes": r.n_bytes, "media_bytes": len(media or b""), "media_sha256": hashlib.sha256(media or b"").hexdigest(), "n_pages": r.ogg.pages, "bad_pages": r.ogg.bad_pages, "n_streams": len(r.ogg.streams), "n_packets": n_packets, "lost_packets": sum(s.lost for s in streams), "duration_us": r.duration_us}
        if r.payload is not None:
            row |= {"payload_bytes": len(r.payload), "payload_sha256": hashlib.sha256(r.payload).hexdigest(), "tail_crc32": zlib.crc32(r.payload[-16:]), "feature": features(r.payload, n_packets, r.duration_us)}
        return row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 256):
            rows = [one(m) for m in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([r.get(c) for r in rows], _ARROW[t]) for c, t in new)], names=[*b.schema.names, *(c for c, _ in new)])

    return keep.mapInArrow(run, schema)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields)


def op1_ogg_media(spark, sf_dir: str) -> DataFrame:
    """Every document's text as an Ogg file and what is read back from it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    stored = encode_column(docs).select("doc_id", "media")
    names = [c for c, _ in DECODED if c != "payload"]
    return decode_column(stored, payload=False).select("doc_id", *(F.col(c) for c in names))
