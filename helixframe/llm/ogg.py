"""Media columns: text payloads in Ogg containers, written and read back.

A file has two logical streams: serial 1 holds the payload as 8-bit mono samples in packets of PACKET bytes, serial 2
one marker packet for each MARK samples. Pages of the two interleave; packets larger than a page continue on the next.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_right
from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.sql import DataFrame

from helixframe.llm.common import map_rows

#: The container's fixed values: capture pattern and header flags.
CAPTURE, CONTINUED, FIRST, LAST = b"OggS", 1, 2, 4
NO_GRANULE = 2**64 - 1
HEADER = struct.Struct("<4sBBQIIIB")
RATE, PACKET, MARK = 8000, 4096, 65536
PAGE_SEGMENTS = 255
DATA, MARKS = 1, 2
MAGIC = {DATA: b"\x80pcm8", MARKS: b"\x80mark"}
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(page: bytes) -> int:
    """The container's CRC-32 (polynomial 0x04C11DB7, not reflected, zero start), by zlib's reflected one on mirrored bits."""
    return int(f"{zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF:032b}"[::-1], 2)


@dataclass
class Stream:
    """A logical stream being written: whole packets become pages of at most 255 segments."""

    serial: int
    sequence: int = 0
    pages: list[bytes] = field(default_factory=list)

    def write(self, packets: list[bytes], positions: list[int], last: bool = False) -> None:
        """Appends pages with the packets, the first of which starts a page and the last of which ends one.

        A page's granule position is that of the last packet that ends on it, NO_GRANULE if none does.
        """
        sizes = [len(p) // 255 + 1 for p in packets]
        lacing = b"".join(b"\xff" * (n - 1) + bytes([len(p) % 255]) for n, p in zip(sizes, packets))
        ends = list(accumulate(sizes))
        body, at = b"".join(packets), 0
        for i in range(0, len(lacing), PAGE_SEGMENTS):
            part = lacing[i : i + PAGE_SEGMENTS]
            j = i + len(part)
            ended = bisect_right(ends, j)
            granule = positions[ended - 1] if ended and ends[ended - 1] > i else NO_GRANULE
            flags = CONTINUED * (i > 0 and lacing[i - 1] == 255) | FIRST * (self.sequence == 0) | LAST * (last and j == len(lacing))
            size = sum(part)
            page = HEADER.pack(CAPTURE, 0, flags, granule, self.serial, self.sequence, 0, len(part)) + part + body[at : at + size]
            self.pages.append(page[:22] + struct.pack("<I", checksum(page)) + page[26:])
            at += size
            self.sequence += 1


def encode(payload: bytes) -> bytes:
    """An Ogg file with the payload as samples; granule positions count samples."""
    data, marks = Stream(DATA), Stream(MARKS)
    data.write([MAGIC[DATA] + struct.pack("<IQ", RATE, len(payload))], [0])
    marks.write([MAGIC[MARKS] + struct.pack("<I", MARK)], [0])
    out = [*data.pages, *marks.pages]
    data.pages, marks.pages = [], []
    for at in range(0, len(payload), MARK):
        block = payload[at : at + MARK]
        end, last = at + len(block), at + MARK >= len(payload)
        # 15 packets of 4096 bytes have 255 segments and so fill a page; the 16th of a block is on the next
        starts = range(0, len(block), PACKET)
        data.write([block[i : i + PACKET] for i in starts], [min(end, at + i + PACKET) for i in starts], last)
        marks.write([struct.pack("<II", at // MARK, zlib.crc32(block))], [end], last)
        out += [*data.pages, *marks.pages]
        data.pages, marks.pages = [], []
    return b"".join(out)


@dataclass
class Logical:
    """A logical stream as read: packets, and for each page on which a packet ends its granule position and packets so far."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    pages: int = 0
    expected: int = 0
    open: bytearray | None = None
    ended: bool = False


def demultiplex(media: bytes) -> dict[int, Logical]:
    """Logical streams by serial number.

    Raises ValueError on a bad capture pattern, checksum, gap or continuation, and on a granule position that is missing
    where a packet ends, given where none does, or less than the one before.
    """
    streams: dict[int, Logical] = {}
    at = 0
    while at < len(media):
        if len(media) - at < HEADER.size:
            raise ValueError(f"byte {at}: the page header is cut off")
        capture, version, flags, granule, serial, sequence, crc, n = HEADER.unpack_from(media, at)
        lacing = media[at + HEADER.size : at + HEADER.size + n]
        body = at + HEADER.size + n
        end = body + sum(lacing)
        if capture != CAPTURE or version or len(lacing) < n or end > len(media):
            raise ValueError(f"byte {at}: no whole page")
        if checksum(media[at : at + 22] + bytes(4) + media[at + 26 : end]) != crc:
            raise ValueError(f"byte {at}: the checksum differs")
        if flags & FIRST:
            if serial in streams:
                raise ValueError(f"byte {at}: stream {serial} begins twice")
            streams[serial] = Logical()
        s = streams.get(serial)
        if s is None or s.ended or s.expected != sequence or bool(flags & CONTINUED) != (s.open is not None):
            raise ValueError(f"byte {at}: a page of stream {serial} is missing")
        part, i = s.open, body
        for size in lacing:
            part = bytearray() if part is None else part
            part += media[i : i + size]
            i += size
            if size < 255:
                s.packets.append(bytes(part))
                part = None
        finished = any(size < 255 for size in lacing)
        if finished != (granule != NO_GRANULE) or finished and s.granules and granule < s.granules[-1]:
            raise ValueError(f"byte {at}: the granule position is wrong")
        s.open = part
        s.expected, s.pages, s.ended = sequence + 1, s.pages + 1, bool(flags & LAST)
        if finished:
            s.granules.append(granule)
            s.ends.append(len(s.packets))
        at = end
    for serial, s in streams.items():
        if s.open is not None or not s.ended:
            raise ValueError(f"stream {serial} doesn't end")
    return streams


def decode(media: bytes) -> tuple[bytes, str]:
    """The payload and a feature string: pages, packets, markers, end time, a digest of all pages' times, sample sum, peak and zero crossings.

    A page's time, in ms, is its granule position, the samples up to the end of its last packet, over the rate. Every
    position must equal the samples that the packets so far hold.
    """
    import numpy as np

    streams = demultiplex(media)
    data, marks = streams[DATA], streams[MARKS]
    head = data.packets[0]
    if not head.startswith(MAGIC[DATA]) or not marks.packets[0].startswith(MAGIC[MARKS]):
        raise ValueError("a stream has another codec")
    rate, total = struct.unpack_from("<IQ", head, len(MAGIC[DATA]))
    payload = b"".join(data.packets[1:])
    so_far = [0, *accumulate(map(len, data.packets[1:]))]
    if len(payload) != total or data.granules != [so_far[n - 1] for n in data.ends] or so_far[-1] != total or marks.granules != [0, *(min(total, x + MARK) for x in range(0, total, MARK))]:
        raise ValueError("granule positions and samples differ")
    for k, p in enumerate(marks.packets[1:]):
        if struct.unpack("<II", p) != (k, zlib.crc32(payload[k * MARK : (k + 1) * MARK])):
            raise ValueError(f"marker {k} differs")
    x = np.frombuffer(payload, np.uint8)
    crossings = int(np.count_nonzero((x[1:] > 127) != (x[:-1] > 127)))
    times = [g * 1000 // rate for g in data.granules]
    return payload, f"pages={data.pages}+{marks.pages};packets={len(data.packets) - 1};marks={len(marks.packets) - 1};end_ms={times[-1]};times={zlib.crc32(",".join(map(str, times)).encode()):08x};sum={int(x.sum(dtype=np.int64))};peak={int(x.max())};crossings={crossings}"


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 with bytes 0 up to a positive multiple of 64, and the length without them."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64)), len(raw)


def encode_media(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, media binary, n_bytes): the Ogg files themselves, for writing to a table."""

    def make():
        def f(doc_id, text):
            payload, n = payload_of(text)
            return [(doc_id, encode(payload), n)]

        return f

    return map_rows(docs.select("doc_id", "text"), make, "doc_id long, media binary, n_bytes long")


def media_features(media: DataFrame) -> DataFrame:
    """(doc_id, media, n_bytes) to features of what the stored bytes hold; a broken file raises, naming the byte.

    Null texts count as empty and are 64 zero bytes; equal texts have equal values; repeated rows stay; other columns
    are not read; an empty table gives an empty result. A document is one task's memory: a few times its length.
    """

    def make():
        def f(doc_id, stored, n):
            payload, feature = decode(stored)
            sha = hashlib.sha256(payload).hexdigest()
            return [(doc_id, n, len(payload), sha, zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature)]

        return f

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_rows(media.select("doc_id", "media", "n_bytes"), make, schema)


def round_trip(docs: DataFrame) -> DataFrame:
    """encode_media and media_features."""
    return media_features(encode_media(docs))
