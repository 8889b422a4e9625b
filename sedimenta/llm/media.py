"""MPEG audio columns: a writer and a reader of MPEG-1 Layer III streams that carry a payload without loss.

The writer makes an ID3v2 tag (payload length), a frame with the variable-bitrate table, and CRC-protected frames at the highest bitrate,
the last one at the lowest that fits. Side information is all zero (a decoder plays silence), and the payload stands in the frames' main
data as ancillary bytes. The reader finds frames by their headers, resynchronises after foreign bytes, verifies checksums, and gives
exact duration (samples over rate) and the byte offset of each frame for seeking.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm.common import batches_of, clean_name, table

#: Fixed values of MPEG-1 Layer III: kbit/s by index, samples a second by index, samples a frame, mono side information bytes.
BITRATES = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
RATES = (44100, 48000, 32000)
SAMPLES, SIDE, HEAD = 1152, 17, 4 + 2 + 17
#: Ticks a second in which a sample of every rate has a whole length.
TICKS = 14_112_000
RATE = 1  # 48 kHz: frames need no padding


def frame_bytes(bitrate: int, rate: int, padding: int) -> int:
    return 144 * BITRATES[bitrate] * 1000 // RATES[rate] + padding


def _crc_table() -> list[int]:
    out = []
    for k in range(256):
        v = k << 8
        for _ in range(8):
            v = (v << 1) ^ 0x8005 if v & 0x8000 else v << 1
        out.append(v & 0xFFFF)
    return out


_CRC = _crc_table()


def crc16(data: bytes) -> int:
    v = 0xFFFF
    for b in data:
        v = ((v << 8) & 0xFFFF) ^ _CRC[(v >> 8) ^ b]
    return v


def _head(bitrate: int, rate: int = RATE) -> bytes:
    """Header, checksum and empty side information of a protected mono frame."""
    header = bytes([0xFF, 0xFA, bitrate << 4 | rate << 2, 0xC0])
    side = bytes(SIDE)
    return header + struct.pack(">H", crc16(header[2:] + side)) + side


_HEADS = {b: _head(b) for b in range(1, 15)}
_ROOM = {b: frame_bytes(b, RATE, 0) - HEAD for b in range(1, 15)}
_FULL = _ROOM[14]


def _tag(length: int) -> bytes:
    """ID3v2.3 with one user text frame."""
    body = b"\x00payload_bytes\x00" + str(length).encode()
    frame = b"TXXX" + struct.pack(">I", len(body)) + b"\x00\x00" + body
    n = len(frame)
    return b"ID3\x03\x00\x00" + bytes([(n >> 21) & 127, (n >> 14) & 127, (n >> 7) & 127, n & 127]) + frame


def encode(payload: bytes) -> bytes:
    """An MPEG audio stream that holds the payload; an empty one has the tag and the table frame only."""
    frames, at = [], 0
    while at < len(payload):
        left = len(payload) - at
        b = 14 if left >= _FULL else next(k for k in range(1, 15) if _ROOM[k] >= left)
        frames.append((_HEADS[b] + payload[at : at + _ROOM[b]]).ljust(HEAD + _ROOM[b], b"\x00"))
        at += _ROOM[b]
    info_size = frame_bytes(9, RATE, 0)
    total = info_size + sum(map(len, frames))
    toc = bytes(min(255, 256 * min(total, info_size + (len(frames) * k // 100) * (HEAD + _FULL)) // total) for k in range(100))
    info = (_HEADS[9] + b"Xing" + struct.pack(">III", 7, len(frames), total) + toc).ljust(info_size, b"\x00")
    return _tag(len(payload)) + info + b"".join(frames)


def _syncsafe(x: bytes) -> int:
    n = 0
    for b in x:
        n = n << 7 | b & 127
    return n


def parse_tag(data: bytes) -> tuple[dict[str, str], int]:
    """User text and text frames of a leading ID3v2.2, 2.3 or 2.4 tag, and where the audio begins; a broken tag is skipped as far as it says."""
    tags: dict[str, str] = {}
    if data[:3] != b"ID3" or len(data) < 10:
        return tags, 0
    major, flags, size = data[3], data[5], _syncsafe(data[6:10])
    end, at = min(len(data), 10 + size), 10
    if flags & 0x40 and major >= 3 and end >= 14:  # extended header: 2.4 counts its own four bytes and is syncsafe
        at += _syncsafe(data[10:14]) if major >= 4 else int.from_bytes(data[10:14], "big") + 4
    wide = 3 if major == 2 else 4
    head = 2 * wide + (0 if major == 2 else 2)
    while at + head <= end and data[at] != 0:
        name, length = data[at : at + wide].decode("latin-1"), data[at + wide : at + 2 * wide]
        n = _syncsafe(length) if major >= 4 else int.from_bytes(length, "big")
        body = data[at + head : min(end, at + head + n)]
        if name[:1] == "T" and body:
            text = body[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[body[0] & 3], "replace")
            key, _, value = text.partition("\x00") if name in ("TXXX", "TXX") else (name, "", text)
            tags[key] = value.rstrip("\x00")
        at += head + n
    return tags, 10 + size + (10 if flags & 0x10 else 0)


def parse_vbr(data: bytes, at: int, body: int) -> tuple[int | None, int | None] | None:
    """(frames, bytes) of a Xing or Info table behind the side information, or of a VBRI table 32 bytes behind the header, else None."""
    if data[body : body + 4] in (b"Xing", b"Info") and len(data) >= body + 8:
        flags, k, out = int.from_bytes(data[body + 4 : body + 8], "big"), body + 8, []
        for bit in (1, 2):
            here = flags & bit and len(data) >= k + 4
            out.append(int.from_bytes(data[k : k + 4], "big") if here else None)
            k += 4 if flags & bit else 0
        return out[0], out[1]
    if data[at + 36 : at + 40] == b"VBRI" and len(data) >= at + 54:
        return int.from_bytes(data[at + 50 : at + 54], "big"), int.from_bytes(data[at + 46 : at + 50], "big")
    return None


def header_size(data: bytes, at: int) -> int:
    """Bytes of the MPEG-1 Layer III frame whose header stands at `at`, or 0."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xFE != 0xFA:
        return 0
    bitrate, rate = data[at + 2] >> 4, data[at + 2] >> 2 & 3
    return 0 if bitrate in (0, 15) or rate == 3 else frame_bytes(bitrate, rate, data[at + 2] >> 1 & 1)


def decode(data: bytes) -> dict:
    """Payload and features. A frame counts if it is whole and another header or the stream's end follows it; else the search goes on one byte later."""
    tags, at = parse_tag(data)
    out: dict = {"offsets": [], "frames": 0, "bad_crc": 0, "skipped": 0, "samples": 0, "ticks": 0, "rate": 0, "kbit": 0, "vbr_frames": None, "vbr_bytes": None, "tags": tags}
    parts, good, first = [], set(), True
    while at < len(data):
        n = header_size(data, at)
        if not n or at + n > len(data) or (at + n < len(data) and not header_size(data, at + n) and data[at + n : at + n + 3] != b"TAG"):
            nxt = data.find(b"\xff", at + 1)
            nxt = len(data) if nxt < 0 else nxt
            out["skipped"] += nxt - at
            at = nxt
            continue
        protected = not data[at + 1] & 1
        side = at + (6 if protected else 4)
        mono = data[at + 3] >> 6 == 3
        body = side + (17 if mono else 32)
        if protected and (seen := data[at + 2 : body]) not in good:
            if crc16(data[at + 2 : at + 4] + data[side:body]) == int.from_bytes(data[at + 4 : at + 6], "big"):
                good.add(seen)
            else:
                out["bad_crc"] += 1
        if first and (vbr := parse_vbr(data, at, body)):
            out["vbr_frames"], out["vbr_bytes"] = vbr
        else:
            out["offsets"].append(at)
            out["frames"] += 1
            out["samples"] += SAMPLES
            rate = RATES[data[at + 2] >> 2 & 3]
            out["rate"] = out["rate"] or rate
            out["ticks"] += SAMPLES * (TICKS // rate)
            out["kbit"] += BITRATES[data[at + 2] >> 4]
            parts.append(data[body : at + n])
        first = False
        at += n
    payload = b"".join(parts)
    stated = tags.get("payload_bytes", "")
    length = int(stated) if stated.isascii() and stated.isdigit() and len(stated) < 19 else len(payload)
    out["payload"] = payload[:length]
    return out


def feature(found: dict) -> str:
    return (
        f"mpeg1-l3;frames={found['frames']};samples={found['samples']};rate={found['rate']};kbit={found['kbit']};crc_errors={found['bad_crc']};"
        f"skipped={found['skipped']};vbr={found['vbr_frames']}/{found['vbr_bytes']}"
    )


def _fields(df: DataFrame) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields)


def encode_column(df: DataFrame, payload: str, media: str = "media") -> DataFrame:
    """df with the stream of each payload (binary; null is empty) in a new binary column, named with a leading _ if df has one of that name."""
    name, at = clean_name(df, media), df.columns.index(payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([encode(x or b"") for x in b.column(at).to_pylist()], pa.binary())], names=[*b.schema.names, name])

    return batches_of(df, run, f"{_fields(df)}`{name}` binary")


_DECODED = [("payload_bytes", pa.int64(), "long"), ("payload_sha256", pa.string(), "string"), ("tail_crc32", pa.int64(), "long"), ("media_bytes", pa.int64(), "long"), ("media_sha256", pa.string(), "string"), ("feature", pa.string(), "string"),
            ("n_frames", pa.int64(), "long"), ("duration_samples", pa.int64(), "long"), ("duration_ticks", pa.int64(), "long"), ("sample_rate", pa.int64(), "long"), ("seek_offsets", pa.list_(pa.int64()), "array<long>"), ("crc_errors", pa.int64(), "long")]


def decode_column(df: DataFrame, media: str = "media") -> DataFrame:
    """df without the media column, with what the stored bytes hold: digests of the payload read back, exact duration, frame offsets.

    New columns get a leading _ where df has one of that name. Null and empty media have no frames and an empty payload; foreign bytes are
    skipped and counted; rows that repeat come back as often as they are there; an empty table gives an empty one. Media of any length are
    read whole. duration_ticks counts 1/14112000 of a second and is exact if frames differ in rate; sample_rate is the first frame's.
    """
    rest, at = [c for c in df.columns if c != media], df.columns.index(media)
    names = [clean_name(df.drop(media), n) for n, _, _ in _DECODED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in b.column(at).to_pylist():
                x = x or b""
                d = decode(x)
                p = d["payload"]
                rows.append((len(p), sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(x), sha256(x).hexdigest(), feature(d), d["frames"], d["samples"], d["ticks"], d["rate"], d["offsets"], d["bad_crc"]))
            kept = [c for k, c in enumerate(b.columns) if k != at]
            made = [pa.array([r[k] for r in rows], t) for k, (_, t, _) in enumerate(_DECODED)]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=[*rest, *names])

    return batches_of(df, run, _fields(df.drop(media)) + ", ".join(f"`{n}` {t}" for n, (_, _, t) in zip(names, _DECODED, strict=True)))


def op2_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("utf8"))
    n = F.length("utf8")
    zeros = F.greatest(F.lit(64) - n, F.pmod(-n, F.lit(64)))
    padded = docs.select("doc_id", n.cast("long").alias("n_bytes"), F.concat("utf8", F.unhex(F.expr("repeat('00', 64)")).substr(F.lit(1), zeros)).alias("payload"))
    return decode_column(encode_column(padded, "payload").drop("payload"))
