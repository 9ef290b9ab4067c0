"""MPEG audio in a binary column: writing a lossless stream and reading streams back.

``encode`` stores a payload as a Layer III stream: an ID3v2 tag, a variable-bitrate table frame, then frames of 44.1 kHz mono whose granules are
empty, so that all bytes after the side information are ancillary data; each carries 576 payload bytes there. A frame's checksum covers what the
standard has it cover, header and side information; the payload has its own digests beside it.
``parse`` reads a stream of any MPEG version and layer at the bitrates of the tables (not those of free format): it reads tags (ID3v1; text frames of
ID3v2.2 to 2.4, with extended headers and unsynchronisation), finds frame headers again after damage (a header counts only if another one, a tag or
the end follows where its length says), reads the table of variable bitrates and compares its seek points with the offsets found, verifies checksums
(header with side information in Layer III, with allocation in Layer I, with allocation and scale-factor selection in Layer II), and gives the exact
duration, each frame's samples over its own rate, and the offset of each frame.

Defined cases: a null text is an empty one; an empty payload is one unit of padding; bytes that hold no frame parse to no frames; trailing
garbage and truncated frames are counted as skipped bytes; equal texts give equal streams; repeated rows get a result each; very long texts are long
streams; an empty table has no streams; a column named like a result is replaced, other columns are kept whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .words import pieces

#: Payload bytes in a frame.
UNIT = 576

# Fixed values of ISO/IEC 11172-3 and 13818-3. Bitrates in kbit/s by (MPEG-1?, layer), then index 1 to 14; rates in Hz by version bits.
BITRATES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

_CRC = []
for _b in range(256):
    _c = _b << 8
    for _ in range(8):
        _c = (_c << 1) ^ 0x8005 if _c & 0x8000 else _c << 1
    _CRC.append(_c & 0xFFFF)


def crc16(data: bytes, more_bits: int = 0) -> int:
    """The frame checksum: polynomial 0x8005, all ones at first; of all bytes, or of the first ``more_bits`` bits alone of the last."""
    c = 0xFFFF
    for b in data[:-1] if more_bits else data:
        c = (c << 8 & 0xFF00) ^ _CRC[c >> 8 ^ b]
    for k in range(more_bits):
        c = (c << 1 & 0xFFFF) ^ (0x8005 if c >> 15 ^ data[-1] >> 7 - k & 1 else 0)
    return c


@dataclass(frozen=True)
class Header:
    mpeg1: bool
    layer: int
    protected: bool
    kbps: int
    rate: int
    mode: int
    extension: int
    length: int

    @property
    def mono(self) -> bool:
        return self.mode == 3

    @property
    def samples(self) -> int:
        return 384 if self.layer == 1 else 1152 if self.layer == 2 or self.mpeg1 else 576

    @property
    def side(self) -> int:
        """Bytes of side information of Layer III."""
        return (17 if self.mono else 32) if self.mpeg1 else (9 if self.mono else 17)


#: Bits of allocation of Layer II, as (subbands, bits) from the lowest on, by the standard's tables a, b, c, d and that of lower rates.
ALLOCATION = {
    "a": ((11, 4), (12, 3), (4, 2)),
    "b": ((11, 4), (12, 3), (7, 2)),
    "c": ((2, 4), (6, 3)),
    "d": ((2, 4), (10, 3)),
    "low": ((4, 4), (7, 3), (19, 2)),
}


def _allocation_table(h: Header) -> str:
    if not h.mpeg1:
        return "low"
    each = h.kbps // (1 if h.mono else 2)
    if each <= 48:
        return "d" if h.rate == 32000 else "c"
    return "a" if each <= 80 or h.rate == 48000 else "b"


def checked_bits(frame: bytes, h: Header) -> int:
    """How many bits after the checksum it covers."""
    if h.layer == 3:
        return 8 * h.side
    channels, bound = (1 if h.mono else 2), (4 + 4 * h.extension if h.mode == 1 else 32)
    if h.layer == 1:
        return 4 * (channels * bound + (32 - bound))
    bits = [n for count, n in ALLOCATION[_allocation_table(h)] for _ in range(count)]
    stream, at, chosen = int.from_bytes(frame[6:70].ljust(64, b"\0"), "big"), 0, 0
    for band, n in enumerate(bits):
        for _ in range(channels if band < bound else 1):
            used = stream >> 512 - at - n & (1 << n) - 1
            at += n
            chosen += (1 if band < bound else channels) if used else 0
    return at + 2 * chosen


def intact(frame: bytes, h: Header) -> bool:
    """Whether a protected frame agrees with its checksum."""
    n = checked_bits(frame, h)
    return crc16(frame[2:4] + frame[6 : 6 + -(-n // 8)], n % 8) == int.from_bytes(frame[4:6], "big")


_headers: dict[bytes, Header | None] = {}


def header(four: bytes) -> Header | None:
    if four not in _headers:
        if len(_headers) > 10_000:
            _headers.clear()
        _headers[four] = _header(four)
    return _headers[four]


def _header(four: bytes) -> Header | None:
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    bits, rate = four[2] >> 4, four[2] >> 2 & 3
    if version == 1 or layer == 4 or bits in (0, 15) or rate == 3:
        return None
    mpeg1 = version == 3
    kbps, hz, pad = BITRATES[mpeg1, layer][bits - 1], RATES[version][rate], four[2] >> 1 & 1
    if layer == 1:
        length = (12000 * kbps // hz + pad) * 4
    else:
        length = (144000 if layer == 2 or mpeg1 else 72000) * kbps // hz + pad
    return Header(mpeg1, layer, not four[1] & 1, kbps, hz, four[3] >> 6, four[3] >> 4 & 3, length)


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _tag(n_bytes: int) -> bytes:
    body = b"\x03n_bytes\x00" + str(n_bytes).encode()
    frame = b"TXXX" + _syncsafe(len(body)) + b"\x00\x00" + body
    return b"ID3\x04\x00\x00" + _syncsafe(len(frame)) + frame


_SIDE = bytes(17)
#: Headers without and with a padding byte: MPEG-1 Layer III, checksum, 192 kbit/s, 44.1 kHz, mono.
_PLAIN, _PADDED = b"\xff\xfa\xb0\xc0", b"\xff\xfa\xb2\xc0"
_HEADS = {p: h + crc16(h[2:] + _SIDE).to_bytes(2, "big") + _SIDE for p, h in ((0, _PLAIN), (1, _PADDED))}
_SPARE = {p: bytes(626 + p - len(_HEADS[p]) - UNIT) for p in (0, 1)}
#: The table frame: without checksum, 64 kbit/s.
_TABLE_HEAD, _TABLE_BYTES = b"\xff\xfb\x50\xc0", 208


def padded(payload: bytes) -> bytes:
    """With bytes 255 up to a positive multiple of the unit."""
    return payload + b"\xff" * (UNIT - len(payload) if len(payload) < UNIT else -len(payload) % UNIT)


def encode(payload: bytes) -> bytes:
    data = padded(payload)
    n = len(data) // UNIT
    # the k-th frame begins at 144 * 192000 * k // 44100 bytes: padding bytes keep the bitrate exact
    starts = [144 * 192000 * k // 44100 for k in range(n + 1)]
    frames = []
    for k in range(n):
        p = starts[k + 1] - starts[k] - 626
        frames.append(_HEADS[p] + data[k * UNIT : (k + 1) * UNIT] + _SPARE[p])
    total = _TABLE_BYTES + starts[n]
    toc = bytes(min(255, 256 * (_TABLE_BYTES + starts[n * x // 100]) // total) for x in range(100))
    table = _TABLE_HEAD + _SIDE + b"Xing" + struct.pack(">III", 7, n, total) + toc
    return _tag(len(payload)) + table.ljust(_TABLE_BYTES, b"\0") + b"".join(frames)


@dataclass
class Stream:
    offsets: list[int] = field(default_factory=list)
    samples: int = 0
    seconds: Fraction = Fraction(0)
    #: Where the sound begins, with the table frame if there is one, and ends; and how far, in 256ths, the table's seek points are from the offsets at most.
    begins: int | None = None
    ends: int = 0
    seek_error: int | None = None
    rate: int = 0
    checked: int = 0
    damaged: int = 0
    skipped: int = 0
    bits: int = 0
    kbps: set = field(default_factory=set)
    table_frames: int | None = None
    table_bytes: int | None = None
    toc: bytes = b""
    tags: dict = field(default_factory=dict)
    ancillary: list[bytes] = field(default_factory=list)


#: How text is encoded, by the first byte of a text frame.
_ENCODINGS = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}


def _text(body: bytes) -> list[str]:
    """The strings of a text frame."""
    how = _ENCODINGS.get(body[0], "latin-1") if body else "latin-1"
    return body[1:].decode(how, "replace").rstrip("\0").split("\0")


def _id3(data: bytes, at: int, out: Stream) -> int:
    """Bytes of the ID3v2 tag at ``at``, or 0. User texts are known by their names, others by the names of their frames."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10 or any(b & 0x80 for b in data[at + 6 : at + 10]):
        return 0
    whole = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3] if len(b) == 4 else 0
    version, flags, size = data[at + 3], data[at + 5], whole(data[at + 6 : at + 10])
    tag = data[at + 10 : at + 10 + size]
    if flags & 0x80 and version < 4:
        tag = tag.replace(b"\xff\0", b"\xff")
    k = 0
    if flags & 0x40 and version > 2:
        k = whole(tag[:4]) if version == 4 else 4 + int.from_bytes(tag[:4], "big")
    head = 6 if version == 2 else 10
    while k + head <= len(tag) and tag[k]:
        if version == 2:
            name, n, marks = tag[k : k + 3], int.from_bytes(tag[k + 3 : k + 6], "big"), 0
        else:
            name, marks = tag[k : k + 4], tag[k + 9]
            n = whole(tag[k + 4 : k + 8]) if version == 4 else int.from_bytes(tag[k + 4 : k + 8], "big")
        body = tag[k + head : k + head + n]
        if version == 4:
            body = body[4:] if marks & 1 else body
            body = body.replace(b"\xff\0", b"\xff") if marks & 2 else body
        if name[:1] == b"T" and body:
            found = _text(body)
            if name in (b"TXXX", b"TXX"):
                out.tags[found[0]] = found[1].lstrip("\ufeff") if len(found) > 1 else ""
            else:
                out.tags[name.decode("latin-1")] = found[0]
        k += head + n
    return 10 + size + (10 if version == 4 and flags & 0x10 else 0)


def _id3v1(tag: bytes, out: Stream) -> None:
    """The fields of a tag of the first version, which do not replace those of later versions."""
    places = {"title": (3, 33), "artist": (33, 63), "album": (63, 93), "year": (93, 97), "comment": (97, 127)}
    for name, (a, b) in places.items():
        out.tags.setdefault(name, tag[a:b].split(b"\0")[0].decode("latin-1").strip())


def _table(frame: bytes, h: Header, out: Stream) -> bool:
    """Whether the frame is a variable-bitrate table (Xing, Info or VBRI), which has no sound."""
    at = 4 + 2 * h.protected + h.side
    if h.layer == 3 and frame[at : at + 4] in (b"Xing", b"Info"):
        flags, at = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
        if flags & 1:
            out.table_frames, at = int.from_bytes(frame[at : at + 4], "big"), at + 4
        if flags & 2:
            out.table_bytes, at = int.from_bytes(frame[at : at + 4], "big"), at + 4
        if flags & 4:
            out.toc = frame[at : at + 100]
        return True
    if h.layer == 3 and frame[36:40] == b"VBRI" and len(frame) >= 54:
        out.table_bytes, out.table_frames = struct.unpack(">II", frame[46:54])
        return True
    return False


def _seek_error(out: Stream) -> int | None:
    """How far, in 256ths of the stream, the table's hundred seek points are from the frames at those shares of the time."""
    if len(out.toc) != 100 or not out.offsets or not out.table_bytes:
        return None
    n, size = len(out.offsets), out.table_bytes
    found = [min(255, 256 * (out.offsets[min(n - 1, n * x // 100)] - out.begins) // size) for x in range(100)]
    return max(abs(a - b) for a, b in zip(found, out.toc, strict=True))


def parse(data: bytes) -> Stream:
    out, at, n, rates = Stream(), 0, len(data), {}
    trusted, kind = False, None  # right after a frame, one of its kind is taken even if damage follows it
    while at < n:
        if size := _id3(data, at, out):
            at += size
            trusted = False
            continue
        if data[at : at + 3] == b"TAG" and at + 128 == n:
            _id3v1(data[at:], out)
            break
        h = header(data[at : at + 4])
        end = at + h.length if h else 0
        if not h or end > n or not (trusted and (h.mpeg1, h.layer, h.rate) == kind or end == n or header(data[end : end + 4]) or data[end : end + 3] in (b"TAG", b"ID3")):
            nxt = data.find(b"\xff", at + 1)
            tag = data.find(b"ID3", at + 1, nxt if nxt >= 0 else n)
            nxt = n if nxt < 0 else nxt
            nxt = tag if tag >= 0 else nxt
            out.skipped += nxt - at
            at, trusted = nxt, False
            continue
        frame = data[at:end]
        out.begins, out.ends = (at if out.begins is None else out.begins), end
        if not (not out.offsets and out.table_frames is None and _table(frame, h, out)):
            out.offsets.append(at)
            out.samples += h.samples
            rates[h.rate] = rates.get(h.rate, 0) + h.samples
            out.rate = out.rate or h.rate
            out.bits += 8 * h.length
            out.kbps.add(h.kbps)
            body = 4 + 2 * h.protected + (h.side if h.layer == 3 else 0)
            if h.protected:
                out.checked += 1
                out.damaged += not intact(frame, h)
            out.ancillary.append(frame[body:])
        at, trusted, kind = end, True, (h.mpeg1, h.layer, h.rate)
    out.seconds = sum((Fraction(k, r) for r, k in rates.items()), Fraction(0))
    out.seek_error = _seek_error(out)
    return out


def payload(stream: Stream) -> bytes:
    """What ``encode`` stored: a unit from each frame."""
    return b"".join([x[:UNIT] for x in stream.ancillary])


MEDIA = T.StructType([T.StructField("media", T.BinaryType())])
FEATURES = T.StructType(
    [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("feature", T.StringType()),
        T.StructField("frames", T.LongType()),
        T.StructField("samples", T.LongType()),
        T.StructField("sample_rate", T.IntegerType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("seek_error", T.IntegerType()),
        T.StructField("seek_offsets", T.ArrayType(T.LongType())),
    ]
)


def media_column(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` of ``docs`` (all if None) and ``media``, the text's UTF-8 bytes stored as MPEG audio."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "media"]
    schema = T.StructType([*(docs.schema[c] for c in keep), *MEDIA])
    made = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, len(keep)):
            texts = b.column(len(keep)).cast(pa.binary()).to_pylist()
            media = pa.array([encode(x or b"") for x in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], media], schema=made)

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def _features(data: bytes) -> tuple:
    s = parse(data)
    own = payload(s)
    kind = f"frames={len(s.offsets)};samples={s.samples};rate={s.rate};bits={s.bits};kbps={','.join(map(str, sorted(s.kbps)))}"
    kind += f";crc={s.checked - s.damaged}/{s.checked};table={s.table_frames},{s.table_bytes};skipped={s.skipped};first={s.offsets[0] if s.offsets else -1};last={s.offsets[-1] if s.offsets else -1}"
    n = s.tags.get("n_bytes", "")
    return (
        int(n) if n.isdigit() else len(own), len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-32:]), len(data), hashlib.sha256(data).hexdigest(),
        kind, len(s.offsets), s.samples, s.rate, float(s.seconds), s.seek_error, s.offsets,
    )


def media_features(media: DataFrame, column: str = "media", keep: list[str] | None = None) -> DataFrame:
    """``keep`` of ``media`` (all but the column itself if None) and what the stored stream tells; a null stream is an empty one."""
    keep = [c for c in (media.columns if keep is None else keep) if c not in {column, *FEATURES.names}]
    schema = T.StructType([*(media.schema[c] for c in keep), *FEATURES])
    made = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, len(keep)):
            found = list(zip(*(_features(x or b"") for x in b.column(len(keep)).to_pylist()), strict=True))
            cols = [pa.array(v, made.field(len(keep) + k).type) for k, v in enumerate(found)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *cols], schema=made)

    return media.select(*keep, F.col(column).alias("__media")).mapInArrow(run, schema)
