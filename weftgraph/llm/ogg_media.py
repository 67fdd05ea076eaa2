"""Media columns in the Ogg container (operator 9).

Samples are split into packets, dealt over logical streams, cut into lacing segments and
written as pages with checksums. Reading verifies every page's checksum, joins segments to
packets, separates the streams by serial number and derives each packet's time from the
granule positions.

Defined cases: a null text counts as empty; an empty text stores one unit of spaces; very
long texts spread over as many pages as needed; repeated rows give equal media; an empty
table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import column

UNIT = 192
PACKET = 10 * UNIT
SAMPLE_RATE = 8000
STREAMS = 2
MAGIC = b"\x7fPCM8U"

# Header fields of an Ogg page, fixed by the container format (RFC 3533).
CAPTURE, CONTINUED, FIRST, LAST = b"OggS", 1, 2, 4
HEAD = struct.Struct("<4sBBqIIIB")

_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_checksum(page: bytes) -> int:
    """The container's CRC-32 (polynomial 0x04c11db7, unreflected, zero start) of a page.

    zlib computes the mirrored form of this polynomial, so bits are mirrored before and after.
    """
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    page = HEAD.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body
    return page[:22] + page_checksum(page).to_bytes(4, "little") + page[26:]


def _stream_pages(serial: int, header: bytes, packets: list[bytes]) -> list[bytes]:
    """Pages of one logical stream: the header alone, then full pages of 255 segments."""
    lacing, ends, at = bytearray(), [], 0
    for packet in packets:
        lacing += b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        at += len(packet)
        ends.append((len(lacing), at))
    body, pages = b"".join(packets), [_page(FIRST | (0 if packets else LAST), 0, serial, 0, bytes([len(header)]), header)]
    start = done = 0
    for low in range(0, len(lacing), 255):
        part = bytes(lacing[low : low + 255])
        granule = -1
        while done < len(ends) and ends[done][0] <= low + len(part):
            granule, done = ends[done][1], done + 1
        flags = (CONTINUED if low and lacing[low - 1] == 255 else 0) | (LAST if low + 255 >= len(lacing) else 0)
        pages.append(_page(flags, granule, serial, len(pages), part, body[start : start + sum(part)]))
        start += sum(part)
    return pages


def write_ogg(payload: bytes, streams: int = STREAMS, packet: int = PACKET) -> bytes:
    """``payload`` as 8-bit samples: packet i goes to logical stream i mod ``streams``."""
    packets = [payload[i : i + packet] for i in range(0, len(payload), packet)]
    seed = zlib.crc32(payload)
    ways = [_stream_pages((seed + k) & 0xFFFFFFFF, MAGIC + struct.pack("<BBI", k, streams, SAMPLE_RATE), packets[k::streams]) for k in range(streams)]
    out = [way[0] for way in ways]  # every stream's first page comes before any other page
    for i in range(1, max(map(len, ways))):
        out += [way[i] for way in ways if i < len(way)]
    return b"".join(out)


def read_pages(media: bytes) -> Iterator[tuple[int, int, int, int, bytes, bytes] | None]:
    """(flags, granule, serial, number, lacing, body) of each sound page; None for a damaged one."""
    at = 0
    while (at := media.find(CAPTURE, at)) >= 0 and at + HEAD.size <= len(media):
        _, _, flags, granule, serial, number, crc, segments = HEAD.unpack_from(media, at)
        lacing = media[at + HEAD.size : at + HEAD.size + segments]
        end = at + HEAD.size + segments + sum(lacing)
        page = media[at:end]
        if end > len(media) or page_checksum(page[:22] + bytes(4) + page[26:]) != crc:
            yield None
            at += 4
            continue
        yield flags, granule, serial, number, lacing, media[end - sum(lacing) : end]
        at = end


def read_ogg(media: bytes) -> tuple[bytes, dict[str, int]]:
    """The samples in time order and what the container says about them.

    Packets touching a damaged or missing page are left out; ``damaged`` counts those pages.
    """
    headers: dict[int, tuple[int, int, int]] = {}
    open_packets: dict[int, bytes] = {}
    expected: dict[int, int] = {}
    timed: list[tuple[int, int, bytes]] = []
    pages = damaged = ended = 0
    for page in read_pages(media):
        pages += 1
        if page is None:
            damaged += 1
            continue
        flags, granule, serial, number, lacing, body = page
        whole = number == expected.get(serial, 0)
        expected[serial] = number + 1
        ended += bool(flags & LAST)
        damaged += not whole
        held = open_packets.pop(serial, b"") if whole and flags & CONTINUED else b""
        skip = bool(flags & CONTINUED) and not whole
        done, at, start = [], 0, 0
        for value in lacing:
            at += value
            if value < 255:
                done.append(None if skip else held + body[start:at])
                held, skip, start = b"", False, at
        if lacing and lacing[-1] == 255 and not skip:
            open_packets[serial] = held + body[start:]
        if flags & FIRST and done and done[0] is not None and done[0].startswith(MAGIC):
            headers[serial] = struct.unpack("<BBI", done[0][len(MAGIC) :])
            continue
        end = granule
        for packet in reversed(done):  # the granule is the end of the last packet that the page completes
            if packet is not None:
                timed.append((end - len(packet), headers.get(serial, (0, 1, 0))[0], packet))
                end -= len(packet)
    timed.sort(key=lambda x: x[:2])
    rate = max((h[2] for h in headers.values()), default=0)
    samples = sum(len(x[2]) for x in timed)
    longest = max((x[0] + len(x[2]) for x in timed), default=0)
    return b"".join(x[2] for x in timed), {"streams": len(headers), "pages": pages, "packets": len(timed), "damaged": damaged, "ended": ended, "samples": samples, "rate": rate, "last_ms": longest * 1000 // rate if rate else 0}


def features(payload: bytes, info: dict[str, int]) -> str:
    """Level features of the samples around their middle value, as integers, and the container's counts."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    n = max(len(x), 1)
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    parts = {"streams": info["streams"], "packets": info["packets"], "pages": info["pages"], "damaged": info["damaged"], "last_ms": info["last_ms"], "mean_milli": int(x.sum()) * 1000 // n, "energy": int((x * x).sum()) // n, "peak": int(np.abs(x).max(initial=0)), "crossings": crossings}
    return ";".join(f"{k}={v}" for k, v in parts.items())


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def to_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's samples as an Ogg file: (doc_id, n_bytes, media)."""

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [padded(x.as_py()) for x in batch["text"]]
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "n_bytes": pa.array([n for n, _ in made], pa.int64()), "media": pa.array([write_ogg(p) for _, p in made], pa.binary())})

    picked = docs.select(column(docs, key, "long").alias("doc_id"), column(docs, text, "string").alias("text"))
    return picked.mapInArrow(write, "doc_id long, n_bytes long, media binary")


def media_digests(media: DataFrame) -> DataFrame:
    """Reads each stored file back and describes it: sizes, digests, features."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for stored in batch["media"]:
                stored = stored.as_py()
                payload, info = read_ogg(stored)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), features(payload, info)))
            ways = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "n_bytes": batch["n_bytes"]} | {n: pa.array(v, k) for n, v, k in zip(names, ways, kinds, strict=True)})

    return media.select("doc_id", "n_bytes", F.col("media")).mapInArrow(read, schema)


def op9_ogg_media(spark, sf_dir):
    from weftgraph.llm.common import table

    return media_digests(to_media(table(spark, sf_dir, "documents")))
