"""Media columns (operator 6): MPEG audio streams.

`probe` walks a stream: it skips and parses an ID3v2 tag, finds frame headers again after damage, reads a Xing, Info
or VBRI table, verifies frame checksums, and returns exact durations and frame seek offsets. `carry` stores bytes in
such a stream without loss: each frame holds 192 of them where the main data of a silent Layer III frame would be.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import ship, small_batches, table, text_or_empty

UNIT = 192
#: Fixed values of the MPEG audio standard: kbit/s by (MPEG-1?, layer), Hz by version bits, samples by frame.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SAMPLES = {(True, 1): 384, (True, 2): 1152, (True, 3): 1152, (False, 1): 384, (False, 2): 1152, (False, 3): 576}
VERSIONS = {3: "1", 2: "2", 0: "2.5"}
#: Fixed values, Layer II: bits of a subband's allocation, as (subbands, bits) from the lowest on, by table.
ALLOCATION = {
    "a": ((11, 4), (12, 3), (4, 2)),
    "b": ((11, 4), (12, 3), (7, 2)),
    "c": ((2, 4), (6, 3)),
    "d": ((2, 4), (10, 3)),
    "low rates": ((4, 4), (7, 3), (19, 2)),
}
#: Frames from one seek offset to the next.
SEEK_EVERY = 32


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    protected: bool
    bitrate: int
    rate: int
    mono: bool
    length: int
    samples: int
    side: int

    @classmethod
    @lru_cache(maxsize=4096)
    def parse(cls, b: bytes) -> Header | None:
        if len(b) < 4 or b[0] != 0xFF or b[1] & 0xE0 != 0xE0:
            return None
        version, layer = b[1] >> 3 & 3, 4 - (b[1] >> 1 & 3)
        rate_no, bit_no, padding = b[2] >> 2 & 3, b[2] >> 4, b[2] >> 1 & 1
        if version == 1 or layer == 4 or rate_no == 3 or bit_no in (0, 15):
            return None
        one = version == 3
        bits, rate = BITRATES[one, layer][bit_no] * 1000, RATES[version][rate_no]
        samples = SAMPLES[one, layer]
        slot = 4 if layer == 1 else 1
        length = (samples // 8 // slot * bits // rate + padding) * slot
        mono = b[3] >> 6 == 3
        side = 0 if layer != 3 else (17 if mono else 32) if one else (9 if mono else 17)
        return cls(version, layer, not b[1] & 1, bits, rate, mono, length, samples, side)


def _crc_table() -> np.ndarray:
    """Of the polynomial x^16 + x^15 + x^2 + 1, high bit first."""
    t = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        t = np.where(t & 0x8000, (t << 1) ^ 0x8005, t << 1) & 0xFFFF
    return t.astype(np.uint32)


CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """Of each row of bytes."""
    c = np.full(len(rows), 0xFFFF, np.uint32)
    for k in range(rows.shape[1]):
        c = ((c << 8) & 0xFFFF) ^ CRC[(c >> 8) ^ rows[:, k]]
    return c


@dataclass
class Stream:
    tags: dict[str, str] = field(default_factory=dict)
    first: Header | None = None
    frames: int = 0
    samples: int = 0
    duration: Fraction = Fraction(0)
    bad_crc: int = 0
    #: Frames too short for what their checksum covers: not part of bad_crc.
    unverified: int = 0
    skipped: int = 0
    table: tuple[str, int, int] | None = None
    seek: list[int] = field(default_factory=list)
    #: (offset, frames, header) of each run of frames with one header.
    runs: list[tuple[int, int, Header]] = field(default_factory=list)


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _text(body: bytes) -> str:
    """A text frame's or field's value; a description before it is joined by =."""
    text = body[1:].decode({0: "latin-1", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "utf-16"), "replace")
    return text.replace("\0", "=").strip("=\ufeff")


def _tags(data: bytes) -> tuple[dict[str, str], int]:
    """The text frames of an ID3v2.2, .3 or .4 tag, and where the tag ends (0: there is none).

    Unsynchronisation is undone, an extended header skipped, and a footer counted. Compressed and encrypted frames,
    and what a damaged tag has after its damage, give no text.
    """
    if data[:3] != b"ID3" or len(data) < 10 or data[3] not in (2, 3, 4):
        return {}, 0
    version, flags, size = data[3], data[5], _syncsafe(data[6:10])
    end = min(len(data), 10 + size + (10 if version == 4 and flags & 0x10 else 0))
    tag, at, tags = data[10 : 10 + size], 0, {}
    if flags & 0x80 and version < 4:
        tag = tag.replace(b"\xff\0", b"\xff")
    if flags & 0x40 and version > 2 and len(tag) >= 4:
        at = _syncsafe(tag) if version == 4 else 4 + struct.unpack(">I", tag[:4])[0]
    head = 6 if version == 2 else 10
    while at + head <= len(tag) and tag[at] != 0:
        name = tag[at : at + head // 2 - (head == 10)].decode("latin-1")
        if version == 2:
            n, packed, doubled = int.from_bytes(tag[at + 3 : at + 6], "big"), False, False
        else:
            raw = tag[at + 4 : at + 8]
            n = _syncsafe(raw) if version == 4 else struct.unpack(">I", raw)[0]
            own = tag[at + 9]
            packed, doubled = bool(own & (0x0C if version == 4 else 0xC0)), version == 4 and bool(own & 0x02)
        body = tag[at + head : at + head + n]
        if doubled:
            body = body.replace(b"\xff\0", b"\xff")
        if version == 4 and tag[at + 9] & 0x01:  # the length that the data would have otherwise
            body = body[4:]
        if name[0] == "T" and body and not packed:
            tags[name] = _text(body)
        at += head + n
    return tags, end


#: Fields of an ID3v1 tag: name, place, length.
OLD_TAG = (("title", 3, 30), ("artist", 33, 30), ("album", 63, 30), ("year", 93, 4), ("comment", 97, 30))


def _old_tags(data: bytes) -> dict[str, str]:
    """Of the ID3v1 tag in the last 128 bytes, as id3v1:title and so on."""
    tag = data[-128:]
    if len(tag) < 128 or tag[:3] != b"TAG":
        return {}
    found = {f"id3v1:{n}": tag[at : at + k].split(b"\0")[0].decode("latin-1").strip() for n, at, k in OLD_TAG}
    if tag[125] == 0 and tag[126]:
        found["id3v1:track"] = str(tag[126])
    return {k: v for k, v in found.items() if v}


def _vbr(frame: bytes, h: Header) -> tuple[str, int, int] | None:
    """(kind, frames, bytes) of a table in a frame that has one instead of audio."""
    at = 4 + 2 * h.protected + h.side
    for kind, place in (("Xing", at), ("Info", at), ("Xing", 4 + h.side), ("Info", 4 + h.side)):
        if frame[place : place + 4] == kind.encode() and len(frame) >= place + 16:
            flags = struct.unpack(">I", frame[place + 4 : place + 8])[0]
            values = struct.unpack(">2I", frame[place + 8 : place + 16])
            return kind, values[0] if flags & 1 else 0, values[flags & 1] if flags & 2 else 0
    if frame[36:40] == b"VBRI" and len(frame) >= 54:
        return ("VBRI", *struct.unpack(">2I", frame[46:54])[::-1])
    return None


#: Frames whose checksums are taken at once.
CHECKED = 1 << 14


def allocation_bits(h: Header) -> list[int]:
    """Of a Layer II frame: bits of each subband's allocation, by version, rate, and bit rate of a channel."""
    each = h.bitrate // (1000 if h.mono else 2000)
    if h.version != 3:
        name = "low rates"
    elif each <= 48:
        name = "d" if h.rate == 32000 else "c"
    else:
        name = "a" if each <= 80 or h.rate == 48000 else "b"
    return [bits for n, bits in ALLOCATION[name] for _ in range(n)]


def covered_bits(frame: bytes, h: Header) -> int:
    """Of a protected Layer II frame: bits after the checksum that it covers. These are the allocations, and two bits of
    scale factor choice for each channel of a subband that has any."""
    bits, at, data = allocation_bits(h), 0, int.from_bytes(frame[6 : 6 + 64], "big")
    whole = 8 * len(frame[6 : 6 + 64])
    joint = frame[3] >> 6 == 1
    shared_from = 4 * ((frame[3] >> 4 & 3) + 1) if joint else len(bits)
    choices = 0
    for band, n in enumerate(bits):
        own = 1 if h.mono or band >= shared_from else 2
        for _ in range(own):
            if data >> max(0, whole - at - n) & (1 << n) - 1:
                choices += 2 if own == 2 or h.mono else 4
            at += n
    return at + choices


def crc16_bits(data: bytes, n: int) -> int:
    """Of the first n bits."""
    c = int(crc16(np.frombuffer(data, np.uint8, n // 8)[None])[0])
    for k in range(n // 8 * 8, n):
        bit = data[k // 8] >> 7 - k % 8 & 1
        c = (c << 1 & 0xFFFF) ^ (0x8005 if (c >> 15) ^ bit else 0)
    return c


def _check(raw: np.ndarray, runs: list[tuple[int, int, Header]]) -> tuple[int, int]:
    """(frames with a wrong checksum, frames whose checksum is not verified) of all runs.

    What is covered has a fixed length in Layers I and III; Layer II's frames are read one by one. A frame that is too
    short for what its checksum covers is not verified.
    """
    bad, unverified, kinds = 0, 0, defaultdict(list)
    for at, n, h in runs:
        if not h.protected:
            continue
        if h.layer == 2:
            for k in range(n):
                frame = raw[at + k * h.length : at + (k + 1) * h.length].tobytes()
                bits = covered_bits(frame, h)
                if 48 + bits > 8 * len(frame):
                    unverified += 1
                else:
                    bad += crc16_bits(frame[2:4] + frame[6:], 16 + bits) != int.from_bytes(frame[4:6], "big")
            continue
        covered = (16 if h.mono else 32) if h.layer == 1 else h.side
        if h.length < 6 + covered:
            unverified += n
        else:
            kinds[covered].append((at, n, h.length))
    for covered, own in kinds.items():
        at, n, length = np.array(own, np.int64).T
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        starts = np.repeat(at, n) + nth * np.repeat(length, n)
        for k in range(0, len(starts), CHECKED):
            rows = raw[starts[k : k + CHECKED, None] + np.arange(6 + covered)]
            stated = rows[:, 4].astype(np.uint32) << 8 | rows[:, 5]
            bad += int((crc16(np.hstack([rows[:, 2:4], rows[:, 6:]])) != stated).sum())
    return bad, unverified


def _run(data: bytes, raw: np.ndarray, at: int, length: int) -> int:
    """How many whole frames from here on have the same header. Looks ahead by doubling steps, so a run costs its length."""
    head, many = data[at : at + 4], (len(data) - at) // length
    n, step = 1, 1
    while n < many:
        if step == 1:  # headers that change at each frame are the rule in some streams
            if data[at + n * length : at + n * length + 4] != head:
                return n
            n, step = n + 1, 2
            continue
        k = min(step, many - n)
        start = at + n * length
        block = raw[start : start + k * length].reshape(k, length)[:, :4]
        other = np.flatnonzero((block != raw[at : at + 4]).any(1))
        if len(other):
            return n + int(other[0])
        n, step = n + k, step * 2
    return max(n, 1)


def probe(data: bytes) -> Stream:
    """Walks the whole stream. A header counts if another one, or the end, follows its frame; else it is skipped.

    Time and memory grow with the stream's bytes, whatever its headers are. Bytes without a frame give no frames.
    """
    out, seen, samples = Stream(), 0, Counter()
    out.tags, at = _tags(data)
    out.tags |= _old_tags(data)
    raw, size = np.frombuffer(data, np.uint8), len(data)
    while at + 4 <= size:
        h = Header.parse(data[at : at + 4])
        after = at + (h.length if h else 0)
        follows = h and h.length >= 4 and after <= size
        if follows and after + 4 <= size and not Header.parse(data[after : after + 4]):
            follows = data[after : after + 3] == b"TAG"
        if not follows:
            if data[at : at + 3] == b"TAG" and size - at == 128:
                break
            nxt = data.find(b"\xff", at + 1)
            nxt = size if nxt < 0 else nxt
            out.skipped += nxt - at
            at = nxt
            continue
        if not out.first:
            out.first = h
            out.table = _vbr(data[at:after], h)
            if out.table:
                at = after
                continue
        n = _run(data, raw, at, h.length)
        out.runs.append((at, n, h))
        out.seek += [at + k * h.length for k in range(-seen % SEEK_EVERY, n, SEEK_EVERY)]
        seen += n
        samples[h.rate] += n * h.samples
        at += n * h.length
    out.frames, out.samples = seen, sum(samples.values())
    out.duration = sum((Fraction(n, rate) for rate, n in samples.items()), Fraction(0))
    out.bad_crc, out.unverified = _check(raw, out.runs)
    return out


def _frame_head() -> tuple[bytes, Header]:
    """MPEG-1 Layer III, protected, 80 kbit/s at 48 kHz, mono: 240 bytes, the side information all 0."""
    head = bytes((0xFF, 0xFA, 6 << 4 | 1 << 2, 3 << 6))
    side = bytes(17)
    crc = int(crc16(np.frombuffer(head[2:] + side, np.uint8)[None])[0])
    return head + struct.pack(">H", crc) + side, Header.parse(head)


HEAD, CARRIER = _frame_head()


def padded(payload: bytes) -> bytes:
    return payload + b" " * (-len(payload) % UNIT or (UNIT if not payload else 0))


def carry(payload: bytes) -> bytes:
    """A stream that holds the payload, padded by bytes 32 to a positive multiple of UNIT."""
    whole = padded(payload)
    n = len(whole) // UNIT
    frames = np.zeros((n + 1, CARRIER.length), np.uint8)
    frames[:, : len(HEAD)] = np.frombuffer(HEAD, np.uint8)
    frames[1:, len(HEAD) : len(HEAD) + UNIT] = np.frombuffer(whole, np.uint8).reshape(n, UNIT)
    toc = bytes(i * 256 // 100 for i in range(100))
    info = b"Info" + struct.pack(">3I", 7, n, (n + 1) * CARRIER.length) + toc
    frames[0, len(HEAD) : len(HEAD) + len(info)] = np.frombuffer(info, np.uint8)
    body = b"\x03BYTES\x00" + str(len(payload)).encode()
    tag = b"TXXX" + struct.pack(">I", len(body)) + b"\0\0" + body
    size = bytes(len(tag) >> s & 0x7F for s in (21, 14, 7, 0))
    return b"ID3\x03\0\0" + size + tag + frames.tobytes()


def carried(data: bytes, stream: Stream) -> tuple[bytes, int] | None:
    """The padded payload of a stream made by `carry`, and its length without the padding; None for other streams."""
    stated = stream.tags.get("TXXX", "")
    if not stated.startswith("BYTES=") or not stated[6:].isdigit() or any(h != CARRIER for _, _, h in stream.runs):
        return None
    raw = np.frombuffer(data, np.uint8)
    parts = [
        raw[at : at + n * h.length].reshape(n, h.length)[:, len(HEAD) : len(HEAD) + UNIT].tobytes()
        for at, n, h in stream.runs
    ]
    payload, n = b"".join(parts), int(stated[6:])
    return (payload, n) if n <= len(payload) else None


def feature(s: Stream) -> str:
    h = s.first
    kind = f"mpeg{VERSIONS[h.version]}-layer{h.layer};{h.rate}Hz;{'mono' if h.mono else 'stereo'}" if h else "none"
    table_ = ":".join(map(str, s.table)) if s.table else "none"
    return (
        f"{kind};frames={s.frames};samples={s.samples};seconds={s.duration};bad_crc={s.bad_crc};"
        f"skipped={s.skipped};table={table_};seek={','.join(map(str, s.seek))}"
    )


READ_COLUMNS = (
    "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, duration_s double, seek_offsets array<long>, tags map<string,string>"
)
_READ_TYPES = (
    pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(),
    pa.list_(pa.int64()), pa.map_(pa.string(), pa.string()),
)
_NOTHING = (None,) * len(_READ_TYPES)


def _facts(data: bytes | None) -> tuple:
    if data is None:
        return _NOTHING
    s = probe(data)
    held = carried(data, s)
    mine = (None, None, None, None)
    if held:
        payload, n = held
        mine = (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    return (*mine, len(data), hashlib.sha256(data).hexdigest(), feature(s), float(s.duration), s.seek, list(s.tags.items()))


# Ids never leave Arrow: as pandas numbers a null among them would make all of them doubles.


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = [carry(t.encode("utf-8", "surrogatepass")) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], ["doc_id", "media"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in READ_COLUMNS.split(", ")]
    for b in batches:
        rows = [_facts(data) for data in b.column(1).to_pylist()]
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(_READ_TYPES)]
        yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", *names])


def store(docs: DataFrame) -> DataFrame:
    """doc_id and media, a binary column with each whole text; other columns are ignored.

    A null text counts as empty: 192 bytes of padding. Null ids stay null. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    small_batches(docs.sparkSession, 256)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("carried_text")).mapInArrow(_store, f"doc_id {kind}, media binary")


def read(media: DataFrame) -> DataFrame:
    """What streams hold, for each row of doc_id, media; other columns are ignored. Equal streams have equal values.

    Any bytes can be read: those of other makers have null payload columns, bytes without a frame the feature
    "none;frames=0...", and a null stream nulls only. An empty table gives an empty result.
    """
    ship(media.sparkSession)
    small_batches(media.sparkSession, 256)
    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "media").mapInArrow(_read, f"doc_id {kind}, {READ_COLUMNS}")


def op6_mpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(store(table(spark, sf_dir, "documents"))).drop("tags")
