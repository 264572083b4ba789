"""Media columns: Ogg streams of 8-bit samples, written and read back.

Reading verifies page checksums, reassembles packets from lacing values, separates the logical streams and derives
times from granule positions.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stored

UNIT = 64
RATE = 8000
#: Samples in one packet, and packets after which the index stream gets its turn; 12 packets need more than one page.
PACKET, TURN = 8000, 12
CONTINUED, FIRST, LAST = 1, 2, 4
#: Serial numbers of the sample stream and of the index stream that is multiplexed with it.
SAMPLES, INDEX = 1, 2
MAGIC = {SAMPLES: b"PCM8\0\0\0\1", INDEX: b"INDX\0\0\0\1"}
HEADER = struct.Struct("<4sBBqIIIB")

_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def ogg_crc(data: bytes) -> int:
    """Ogg's checksum: the polynomial of CRC-32 with unreflected bits, zero at the start and no final inversion.

    That is CRC-32 of the bytes with their bits reversed, from a cleared register, with the result's bits reversed.
    """
    crc = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_REVERSED), "big")


def page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    """One page with its checksum."""
    parts = ["OggS".encode(), 0, flags, granule, serial, number]
    blank = HEADER.pack(*parts, 0, len(lacing)) + lacing + body
    return HEADER.pack(*parts, ogg_crc(blank), len(lacing)) + lacing + body


def lace(packet: bytes) -> bytes:
    """Lacing values: 255 for each full segment, then the rest, which may be 0."""
    return b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])


class _Stream:
    """Pages of one logical stream; a packet whose lacing does not fit goes on in the next page."""

    def __init__(self, serial: int):
        self.serial, self.number, self.lacing, self.body, self.granule, self.continued = serial, 0, b"", b"", -1, False

    def add(self, packet: bytes, granule: int) -> Iterator[bytes]:
        lacing = lace(packet)
        while lacing:
            room = 255 - len(self.lacing)
            now, lacing = lacing[:room], lacing[room:]
            self.lacing += now
            size = sum(now)
            self.body, packet = self.body + packet[:size], packet[size:]
            if not lacing:
                self.granule = granule
            elif len(self.lacing) == 255:
                yield self.flush()
                self.continued = True

    def flush(self, last: bool = False) -> bytes:
        flags = CONTINUED * self.continued | FIRST * (self.number == 0) | LAST * last
        out = page(self.serial, self.number, flags, self.granule, self.lacing, self.body)
        self.number, self.lacing, self.body, self.granule, self.continued = self.number + 1, b"", b"", -1, False
        return out


def encode(payload: bytes, rate: int = RATE) -> bytes:
    """payload as an Ogg file: a stream of 8-bit samples, and an index of byte sums multiplexed with it."""
    samples, index = _Stream(SAMPLES), _Stream(INDEX)
    out = []
    for s in (samples, index):
        out += s.add(MAGIC[s.serial] + struct.pack("<IQ", rate, len(payload)), 0)
        out.append(s.flush())
    step = PACKET * TURN
    for start in range(0, len(payload), step):
        group = payload[start : start + step]
        for at in range(0, len(group), PACKET):
            out += samples.add(group[at : at + PACKET], start + min(at + PACKET, len(group)))
        end = start + len(group)
        out.append(samples.flush(last=end == len(payload)))
        out += index.add(struct.pack("<QI", end, sum(group)), end)
        out.append(index.flush(last=end == len(payload)))
    return b"".join(out)


@dataclass
class Logical:
    """A logical stream: its packets, each with the seconds at which it ends (None inside a page)."""

    packets: list[bytes] = field(default_factory=list)
    ends: list[float | None] = field(default_factory=list)
    pages: int = 0
    open: bytes | None = None
    closed: bool = False
    rate: int = 0


def decode(data: bytes) -> dict[int, Logical]:
    """The logical streams by serial number.

    An error is raised for a wrong checksum, version, page number or continuation flag, for a stream that begins
    without FIRST or goes on after LAST, and for data that ends within a page, packet or stream.
    """
    streams: dict[int, Logical] = {}
    at = 0
    while at < len(data):
        if len(data) - at < HEADER.size:
            raise ValueError("the file ends within a page header")
        magic, version, flags, granule, serial, number, crc, segments = HEADER.unpack_from(data, at)
        lacing = data[at + HEADER.size : at + HEADER.size + segments]
        begin = at + HEADER.size + segments
        end = begin + sum(lacing)
        if magic != b"OggS" or version or end > len(data):
            raise ValueError("not a page of Ogg")
        if ogg_crc(data[at : at + 22] + bytes(4) + data[at + 26 : end]) != crc:
            raise ValueError("a page checksum is wrong")
        s = streams.setdefault(serial, Logical())
        if s.pages != number or s.closed or bool(flags & FIRST) != (number == 0) or bool(flags & CONTINUED) != (s.open is not None):
            raise ValueError("a page is missing or out of order")
        part, where = s.open or b"", begin
        run = 0
        done = 0
        for value in lacing:
            run += value
            if value < 255:
                s.packets.append(part + data[where : where + run])
                s.ends.append(None)
                part, where, run, done = b"", where + run, 0, done + 1
        s.open = part + data[where:end] if run or (part and not done) else None
        if not s.rate:
            s.rate = struct.unpack_from("<I", s.packets[0], 8)[0]
        if granule >= 0 and done:
            s.ends[-1] = granule / s.rate
        s.pages, s.closed, at = s.pages + 1, bool(flags & LAST), end
    if any(s.open is not None or not s.closed for s in streams.values()):
        raise ValueError("a stream ends within a packet or without its last page")
    return streams


def payload_of(data: bytes) -> tuple[bytes, dict[int, Logical]]:
    """The samples of a file that encode wrote, checked against the index stream and the declared length."""
    streams = decode(data)
    samples, index = streams[SAMPLES], streams[INDEX]
    if not (samples.packets[0].startswith(MAGIC[SAMPLES]) and index.packets[0].startswith(MAGIC[INDEX])):
        raise ValueError("not the streams of this format")
    payload, start = b"".join(samples.packets[1:]), 0
    for entry in index.packets[1:]:
        end, total = struct.unpack("<QI", entry)
        if sum(payload[start:end]) != total:
            raise ValueError("the samples differ from their index")
        start = end
    if len(payload) != struct.unpack_from("<Q", samples.packets[0], 12)[0]:
        raise ValueError("samples are missing")
    return payload, streams


def feature(payload: bytes, streams: dict[int, Logical]) -> str:
    """Exact features of the samples: pages and packets of the sample stream, its seconds, least, greatest, sum, sum of
    squares, mean crossings and a 16-bin histogram."""
    x, s = np.frombuffer(payload, np.uint8), streams[SAMPLES]
    wide = x.astype(np.int64)
    total = int(wide.sum())
    above = wide * len(x) > total
    bins = np.bincount(x >> 4, minlength=16)
    seconds = max(e for e in s.ends if e is not None)
    return f"pages={s.pages};packets={len(s.packets)};seconds={seconds:.6f};min={x.min()};max={x.max()};sum={total};squares={int((wide * wide).sum())};crossings={int((above[1:] != above[:-1]).sum())};bins={','.join(map(str, bins))}"


def padded(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text in UTF-8, and these with zeros up to a positive multiple of UNIT."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % UNIT or UNIT * (not raw))


#: Rows that are in their media form at once in a task.
ROWS = 256


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS):
            part = batch.slice(first, ROWS)
            sized = [padded(t.as_py()) for t in part.column("text")]
            media = pa.array([encode(payload) for _, payload in sized], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([n for n, _ in sized], pa.int64()), media], names=["doc_id", "n_bytes", "media"])


def to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every row's whole text as a media column, and its bytes before padding."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(_encoded, "doc_id long, n_bytes long, media binary")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS):
            part, out = batch.slice(first, ROWS), []
            for doc_id, n, media in zip(*(part.column(k) for k in range(3))):
                data = media.as_py()
                payload, streams = payload_of(data)
                out.append((doc_id.as_py(), n.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload, streams)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _SCHEMA.types)], schema=_SCHEMA)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def read_media(media: DataFrame) -> DataFrame:
    """What is read back of a media column (doc_id, n_bytes, media): its payload, verified, and features."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_digests, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def texts_as_media(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes and what is read back of its text's media form.

    The media column is written as a table in the shared folder, and what is returned is read from there. A null text
    counts as empty, whose payload is 64 zero bytes; null and repeated doc_ids are allowed and other columns ignored.
    Each row is encoded, and later decoded, in one task, a few hundred rows at a time; nothing is shuffled.
    """
    return read_media(stored(to_media(docs)))
