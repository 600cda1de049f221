"""MPEG audio columns: byte strings as frames of MPEG-1 Layer III, and a reader of such streams.

`store` puts a payload into the ancillary bytes of silent frames behind an ID3v2 tag and a
variable-bitrate table. `read` finds frames by resynchronising on headers, parses ID3v2 and ID3v1 tags
and Xing or VBRI tables with their seek entries, verifies each frame's CRC-16 (Layer III over its side information, Layer
I over its allocation; protected frames of Layer II are counted as unverified), and gives the exact duration and the
offset of every frame. Each row is handled alone, so partitions are as large as Spark makes them.

Defined cases: a null text is empty; a stream without a valid frame has no frames, duration 0 and no
payload; bytes that are no frame are skipped and counted; frames whose checksum fails are counted and
their payload is left out; equal texts give equal streams; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import tidied

# Fixed values of ISO/IEC 11172-3 and 13818-3: kilobits a second by index, of MPEG-1 layers I to III and of MPEG-2 layers I, and II with III.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
# Hertz by index, of MPEG-1, MPEG-2 and MPEG-2.5.
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 3: (11025, 12000, 8000)}
SYNC = 0xFFE0


class Header(NamedTuple):
    version: int  # 1, 2, or 3 for MPEG-2.5
    layer: int
    protected: bool
    kbps: int
    rate: int
    mono: bool
    size: int  # bytes of the frame
    samples: int

    @property
    def side(self) -> int:
        """Bytes of side information in Layer III."""
        if self.version == 1:
            return 17 if self.mono else 32
        return 9 if self.mono else 17


@lru_cache(8192)
def header(four: bytes) -> Header | None:
    """The header of a frame, or None if these four bytes aren't a valid one."""
    word = int.from_bytes(four, "big")
    if len(four) < 4 or word >> 16 & SYNC != SYNC:
        return None
    version, layer = {0: 3, 2: 2, 3: 1}.get(word >> 19 & 3), 4 - (word >> 17 & 3)
    index, rate = word >> 12 & 15, word >> 10 & 3
    if version is None or layer == 4 or index in (0, 15) or rate == 3 or word & 3 == 2:
        return None
    kbps, hertz, padding = BITRATES[min(version, 2), layer][index], RATES[version][rate], word >> 9 & 1
    samples = 384 if layer == 1 else 576 if layer == 3 and version > 1 else 1152
    size = (12000 * kbps // hertz + padding) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hertz + padding
    return Header(version, layer, not word >> 16 & 1, kbps, hertz, word >> 6 & 3 == 3, size, samples)


@lru_cache(65536)
def crc16(data: bytes) -> int:
    """CRC of polynomial x8005, begun at xFFFF, as frames hold it."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1
        crc &= 0xFFFF
    return crc


def _frame_kind(index: int) -> tuple[bytes, int, bytes]:
    """Header bytes, size, and the head (header, CRC, empty side information) of a mono frame at 32 kHz."""
    four = bytes([0xFF, 0xFA, index << 4 | 2 << 2, 0xC0])
    side = bytes(17)
    return four, header(four).size, four + crc16(four[2:] + side).to_bytes(2, "big") + side


_KINDS = [_frame_kind(i) for i in range(1, 15)]
_OWN = 4 + 2 + 17 + 2  # and the count of payload bytes
_FULL = _KINDS[-1][1] - _OWN
_TAG_MARK = b"TXXX"


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def _id3v2(size: int) -> bytes:
    body = b"\x03payload_bytes\0" + str(size).encode()
    frame = _TAG_MARK + _syncsafe(len(body)) + b"\0\0" + body
    return b"ID3\x04\0\0" + _syncsafe(len(frame)) + frame


def store(payload: bytes) -> bytes:
    """A stream of full frames and one of the least size that holds the rest, behind a tag and a Xing table."""
    frames = []
    for at in range(0, len(payload), _FULL):
        piece = payload[at : at + _FULL]
        _, size, head = next(k for k in _KINDS if k[1] - _OWN >= len(piece))
        frames.append(head + len(piece).to_bytes(2, "big") + piece + bytes(size - _OWN - len(piece)))
    audio = sum(map(len, frames))
    _, size, head = _KINDS[8]
    total = size + audio
    # The place of each hundredth of the duration in 256ths of the bytes; all frames last equally long.
    ends = [0]
    for f in frames:
        ends.append(ends[-1] + len(f))
    seek = bytes(min(255, 256 * (size + ends[len(frames) * i // 100]) // total) for i in range(100))
    table = b"Xing" + (7).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + total.to_bytes(4, "big") + seek
    first = (head + table).ljust(size, b"\0")
    return _id3v2(len(payload)) + first + b"".join(frames)


class Found(NamedTuple):
    frames: int
    offsets: list[int]
    samples: int
    rate: int
    duration: Fraction
    kbps: dict[int, int]
    checked: int
    failed: int
    skipped: int
    tags: dict[str, str]
    table: dict[str, int | list[int]]
    payload: bytes
    unverified: int = 0


def _tag_text(body: bytes) -> str:
    codec = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0] if body else 0, "latin-1")
    return body[1:].decode(codec, "replace").rstrip("\0")


def parse_tags(media: bytes) -> tuple[int, int, dict[str, str]]:
    """Where audio begins and ends, and the text frames of ID3v2 with the fields of ID3v1."""
    begin, end, tags = 0, len(media), {}
    if media[:3] == b"ID3" and len(media) >= 10:
        number = lambda x: x[0] << 21 | x[1] << 14 | x[2] << 7 | x[3]
        begin = min(10 + number(media[6:10]), len(media))
        at = 10
        while at + 10 <= begin and media[at : at + 1] != b"\0":
            name, size = media[at : at + 4].decode("latin-1"), number(media[at + 4 : at + 8]) if media[3] == 4 else int.from_bytes(media[at + 4 : at + 8], "big")
            if name[0] == "T":
                text = _tag_text(media[at + 10 : min(at + 10 + size, begin)])
                key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
                tags[key] = value
            at += 10 + size
    if end - begin >= 128 and media[end - 128 : end - 125] == b"TAG":
        end -= 128
        for key, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            if text := media[end + a : end + b].split(b"\0")[0].decode("latin-1").strip():
                tags[f"v1_{key}"] = text
    return begin, end, tags


def parse_table(frame: bytes, head: Header) -> dict[str, int | list[int]]:
    """The Xing, Info or VBRI table of a first frame; empty if it has none. seek: its entries, 256ths of the bytes (Xing) or bytes (VBRI)."""
    at = 4 + 2 * head.protected + head.side
    if frame[at : at + 4] in (b"Xing", b"Info"):
        flags, at, out = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8, {}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name], at = int.from_bytes(frame[at : at + 4], "big"), at + 4
        return out | {"seek": list(frame[at : at + 100]) if flags & 4 else []}
    if frame[36:40] == b"VBRI":
        n, scale, size = (int.from_bytes(frame[a : a + 2], "big") for a in (54, 56, 58))
        entries = [scale * int.from_bytes(frame[62 + i * size : 62 + (i + 1) * size], "big") for i in range(n if 62 + n * size <= len(frame) else 0)]
        return {"bytes": int.from_bytes(frame[46:50], "big"), "frames": int.from_bytes(frame[50:54], "big"), "seek": entries}
    return {}


def allocation(four: bytes) -> int:
    """Bytes of the bit allocation of a Layer I frame: four bits for each subband and channel; joint ones share those above a bound."""
    mode, extension = four[3] >> 6, four[3] >> 4 & 3
    return 16 if mode == 3 else 16 + 2 * (extension + 1) if mode == 1 else 32


def read(media: bytes) -> Found:
    """Everything the stream holds. Synchronisation asks for a header where the next frame should begin, or the end there."""
    begin, end, tags = parse_tags(media)
    at, synced, skipped, unverified = begin, False, 0, 0
    offsets, samples, rate, duration, kbps, checked, failed, table, payload = [], 0, 0, Fraction(0), {}, 0, 0, {}, []
    ticks: dict[int, int] = {}
    first = True
    while at + 4 <= end:
        head = header(media[at : at + 4])
        if head is not None:
            stop = at + head.size
            if stop > end or not (synced or stop == end or header(media[stop : stop + 4]) is not None):
                head = None
        if head is None:
            synced = False
            after = media.find(b"\xff", at + 1, end)
            after = end if after < 0 else after
            skipped += after - at
            at = after
            continue
        synced = True
        good = True
        body = at + 4
        if head.protected:
            body += 2
            if head.layer != 2:
                checked += 1
                covered = head.side if head.layer == 3 else allocation(media[at : at + 4])
                good = crc16(media[at + 2 : at + 4] + media[body : body + covered]) == int.from_bytes(media[at + 4 : at + 6], "big")
                failed += not good
            unverified += head.layer == 2
        found = parse_table(media[at:stop], head) if first and head.layer == 3 else {}
        first = False
        if found:
            table = found
        else:
            offsets.append(at)
            samples += head.samples
            ticks[head.rate] = ticks.get(head.rate, 0) + head.samples
            rate = rate or head.rate
            kbps[head.kbps] = kbps.get(head.kbps, 0) + 1
            if head.layer == 3 and good:
                body += head.side
                size = int.from_bytes(media[body : body + 2], "big")
                if body + 2 + size <= stop:
                    payload.append(media[body + 2 : body + 2 + size])
        at = stop
    skipped += end - at if at < end else 0
    for hertz, n in ticks.items():
        duration += Fraction(n, hertz)
    return Found(len(offsets), offsets, samples, rate, duration, kbps, checked, failed, skipped, tags, table, b"".join(payload), unverified)


def padded(text: str | None) -> tuple[int, bytes]:
    """Bytes of a text, and they with zeros up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes of each whole text, and media: the stream that holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                raw = [padded(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in raw], pa.int64()), pa.array([store(p) for _, p in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), "doc_id long, n_bytes long, media binary")


_LONG, _TEXT = ("long", pa.int64()), ("string", pa.string())
#: Columns of what is read: name, type in Spark, type in Arrow. The payload or its digests come between these two lists.
_BEFORE = [("doc_id", *_LONG), ("n_bytes", *_LONG), ("media_bytes", *_LONG), ("media_sha256", *_TEXT)]
_AFTER = [
    ("frames", *_LONG),
    ("frame_offsets", "array<long>", pa.list_(pa.int64())),
    ("samples", *_LONG),
    ("sample_rate", "int", pa.int32()),
    ("duration_s", "double", pa.float64()),
    ("kbps", "map<int, long>", pa.map_(pa.int32(), pa.int64())),
    ("checked", *_LONG),
    ("failed", *_LONG),
    ("skipped_bytes", *_LONG),
    ("tags", "map<string, string>", pa.map_(pa.string(), pa.string())),
    ("table_frames", *_LONG),
    ("table_bytes", *_LONG),
    ("table_seek", "array<long>", pa.list_(pa.int64())),
    ("unverified", *_LONG),
]
_PAYLOAD = [("payload", "binary", pa.binary())]
_DIGESTS = [("payload_bytes", *_LONG), ("payload_sha256", *_TEXT), ("tail_crc32", *_LONG)]


def read_media(stored: DataFrame, keep_payload: bool = True) -> DataFrame:
    """What each stream holds; stored has doc_id, n_bytes and media. duration_s is samples over sample_rate, by frame."""
    columns = [*_BEFORE, *(_PAYLOAD if keep_payload else _DIGESTS), *_AFTER]
    schema = pa.schema([(name, kind) for name, _, kind in columns])

    def digests(x: bytes) -> list:
        return [len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-64:])]

    def one(doc_id: int, n: int, media: bytes | None) -> list:
        media = media or b""
        f = read(media)
        own = [f.payload] if keep_payload else digests(f.payload)
        table = [f.table.get("frames"), f.table.get("bytes"), f.table.get("seek")]
        return [doc_id, n, len(media), hashlib.sha256(media).hexdigest(), *own, f.frames, f.offsets, f.samples, f.rate, float(f.duration), list(f.kbps.items()), f.checked, f.failed, f.skipped, list(f.tags.items()), *table, f.unverified]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                rows = [one(*x) for x in zip(*(c.to_pylist() for c in batch.slice(a, 256).columns), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for f, v in zip(schema, zip(*rows, strict=True), strict=True)], schema=schema)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(tidied(run), ", ".join(f"{name} {kind}" for name, kind, _ in columns))
