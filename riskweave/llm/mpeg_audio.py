"""Media columns: MPEG audio. Writes byte payloads as framed audio and reads audio bytes back.

The reader resynchronises on frame headers; parses ID3v2.2 to ID3v2.4 (extended headers and unsynchronisation too) and
ID3v1 tags; parses Xing, Info and VBRI tables with their seek points and the encoder's delay and padding, and compares
their counts with the frames; verifies the CRC-16 of protected frames of all three layers; and keeps exact durations (in
samples, without delay and padding, and in microseconds) and every frame's seek offset. The writer stores a payload in
the bodies of CRC-protected MPEG-1 Layer III mono frames behind an ID3v2 tag and a Xing table: the format's unit is a
frame body, and no body byte is changed.

Defined cases: null or empty media have no frames and a null payload; bytes that no frame covers are counted as skipped;
a frame cut by the end of the data counts as truncated and adds no duration; frames without protection are not checked;
very long media are read whole. Rows are independent, so ties, repeated rows and empty tables need no care; columns of
the input named like an output are replaced, all others kept.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import add_columns, stored, table

# Fixed values of the format: kbit/s by (MPEG-1?, layer), sample rates by version bits.
RATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

UNIT = 64
SIDE = 17  # side information of an MPEG-1 Layer III mono frame
HEAD = 4 + 2 + SIDE


def _crc_table() -> np.ndarray:
    t = np.zeros(256, np.uint16)
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = ((c << 1) ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        t[i] = c
    return t


CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """CRC-16 (0x8005, start 0xFFFF) of each row of a byte matrix."""
    c = np.full(len(rows), 0xFFFF, np.uint16)
    for j in range(rows.shape[1]):
        c = ((c << np.uint16(8)) ^ CRC[(c >> np.uint16(8)) ^ rows[:, j]]).astype(np.uint16)
    return c


# Fixed values of the format: the widths of Layer II's bit allocations, as (subbands, bits) runs.
ALLOCATION = {
    "high": ((11, 4), (12, 3), (4, 2)),
    "full": ((11, 4), (12, 3), (7, 2)),
    "low": ((2, 4), (6, 3)),
    "low32": ((2, 4), (10, 3)),
    "half": ((4, 4), (7, 3), (19, 2)),
}
# The fields of an ID3v1 tag behind its mark, and their lengths.
ID3V1 = (("title", 30), ("artist", 30), ("album", 30), ("year", 4), ("comment", 30))


def crc16_bits(data: bytes, bits: int) -> int:
    """The same CRC over the first `bits` bits."""
    c = 0xFFFF
    for b in data[: bits // 8]:
        c = (c << 8 & 0xFFFF) ^ int(CRC[c >> 8 ^ b])
    for i in range(bits % 8):
        top = c >> 15 ^ data[bits // 8] >> (7 - i) & 1
        c = (c << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return c


def _bits(data: bytes, at: int, n: int) -> int:
    return int.from_bytes(data[at // 8 : (at + n + 7) // 8], "big") >> (-(at + n) % 8) & (1 << n) - 1


def covered_bits(frame: bytes, layer: int, hertz: int, kbps: int) -> int:
    """How many bits behind the CRC of a Layer I or II frame it covers: bit allocations, and Layer II's scale factor selectors."""
    mode, one = frame[3] >> 6, frame[1] >> 3 & 3 == 3
    channels = 1 if mode == 3 else 2
    bound = 4 * ((frame[3] >> 4 & 3) + 1) if mode == 1 else 32
    if layer == 1:
        return 4 * (32 if channels == 1 else bound + 32)
    each = kbps // channels
    kind = "half" if not one else ("low32" if hertz == 32000 else "low") if each <= 48 else "high" if hertz == 48000 or each <= 80 else "full"
    widths = [w for n, w in ALLOCATION[kind] for _ in range(n)]
    at, used = 48, 0
    for band, width in enumerate(widths):
        own = channels if band < bound else 1
        for _ in range(own):
            used += (_bits(frame, at, width) > 0) * (channels if own == 1 else 1)
            at += width
    return at - 48 + 2 * used


def frame_is_whole(frame: bytes, h: tuple) -> bool:
    """Whether a protected Layer I or II frame has the CRC that it states."""
    n = covered_bits(frame, h[6], h[2], h[3])
    return crc16_bits(frame[2:4] + frame[6 : 6 + (n + 7) // 8], 16 + n) == int.from_bytes(frame[4:6], "big")


@lru_cache(65536)
def header(h: bytes):
    """(length, samples, hertz, kbps, protected, side bytes, layer) of a frame header, or None."""
    if len(h) < 4 or h[0] != 0xFF or h[1] & 0xE0 != 0xE0:
        return None
    version, layer, rate, freq = h[1] >> 3 & 3, 4 - (h[1] >> 1 & 3), h[2] >> 4, h[2] >> 2 & 3
    if version == 1 or layer == 4 or rate in (0, 15) or freq == 3:
        return None
    one = version == 3
    hertz, kbps, pad, mono = HERTZ[version][freq], RATES[one, layer][rate], h[2] >> 1 & 1, h[3] >> 6 == 3
    if layer == 1:
        length, samples = (12_000 * kbps // hertz + pad) * 4, 384
    else:
        samples = 1152 if one or layer == 2 else 576
        length = samples // 8 * 1000 * kbps // hertz + pad
    side = ((17 if mono else 32) if one else (9 if mono else 17)) if layer == 3 else 0
    return length, samples, hertz, kbps, not h[1] & 1, side, layer


def _frame_kinds() -> list[tuple[int, bytes]]:
    """(body capacity, header with CRC and side information) of the writer's bitrates, ascending."""
    out = []
    for rate in range(1, 15):
        h = bytes((0xFF, 0xFA, rate << 4 | 1 << 2, 0xC0))  # 48 kHz, mono, protected
        covered = np.frombuffer(h[2:] + bytes(SIDE), np.uint8)[None]
        out.append((header(h)[0] - HEAD, h + int(crc16(covered)[0]).to_bytes(2, "big") + bytes(SIDE)))
    return out


KINDS = _frame_kinds()


def _safe(n: int) -> bytes:
    return bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))


def write_audio(payload: bytes) -> bytes:
    """The payload as an audio file."""
    frames, at, (most, full) = [], 0, KINDS[-1]
    while at < len(payload):
        body = payload[at : at + most]
        size, head = next(k for k in KINDS if k[0] >= len(body)) if len(body) < most else (most, full)
        frames.append(head + body + bytes(size - len(body)))
        at += len(body)
    size, head = next(k for k in KINDS if k[0] >= 144)  # table and encoder field
    first = len(head) + size
    total, starts, at = first + sum(map(len, frames)), [], first
    for f in frames:
        starts.append(at)
        at += len(f)
    toc = bytes(min(255, starts[len(starts) * i // 100] * 256 // total) if starts else 0 for i in range(100))
    xing = b"Xing" + struct.pack(">III", 15, len(frames), total) + toc + struct.pack(">I", 0)
    note = b"TXXX" + _safe(len(text := b"\x03payload_bytes\0" + str(len(payload)).encode())) + b"\0\0" + text
    return b"ID3\x04\0\0" + _safe(len(note)) + note + head + xing + bytes(size - len(xing)) + b"".join(frames)


def _text(body: bytes) -> str:
    return body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace")


def _tag_frames(data: bytes, version: int, flags: int) -> dict[str, str]:
    """The text frames in the body of an ID3v2 tag."""
    if flags & 128:
        data = data.replace(b"\xff\0", b"\xff")
    synchsafe = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    p, found = 0, {}
    if flags & 64 and version >= 3 and len(data) >= 4:  # an extended header, whose size counts itself from version 4 on
        p = synchsafe(data) if version == 4 else 4 + int.from_bytes(data[:4], "big")
    name_size, head = (3, 6) if version == 2 else (4, 10)
    while p + head <= len(data) and data[p]:
        raw = data[p + name_size : p + 2 * name_size]
        n = synchsafe(raw) if version == 4 else int.from_bytes(raw, "big")
        body, name = data[p + head : p + head + n], data[p : p + name_size].decode("latin-1")
        if name[0] == "T" and body:
            key, mark, value = _text(body).partition("\0")
            own = name in ("TXXX", "TXX") and mark
            found[f"{name}:{key}" if own else name] = (value if own else key + mark + value).rstrip("\0")
        p += head + n
    return found


def _tags(data: bytes) -> tuple[int, dict[str, str]]:
    """End of the leading ID3v2 tags and their text frames."""
    at, found = 0, {}
    while data[at : at + 3] == b"ID3" and len(data) >= at + 10:
        v, flags, size = data[at + 3], data[at + 5], int.from_bytes(data[at + 6 : at + 10], "big")
        size = (size >> 24 & 127) << 21 | (size >> 16 & 127) << 14 | (size >> 8 & 127) << 7 | size & 127
        if v in (2, 3, 4):
            found |= _tag_frames(data[at + 10 : at + 10 + size], v, flags)
        at = min(len(data), at + 10 + size + (10 if flags & 16 else 0))
    return at, found


def _last_tag(data: bytes) -> dict[str, str]:
    """The fields of an ID3v1 tag, the last 128 bytes."""
    at, found = 3, {}
    for name, size in ID3V1:
        raw = data[at : at + size]
        if name == "comment" and raw[28] == 0 and raw[29]:
            found["ID3v1:track"], raw = str(raw[29]), raw[:28]
        if value := raw.split(b"\0")[0].decode("latin-1").rstrip():
            found[f"ID3v1:{name}"] = value
        at += size
    if data[at] != 255:
        found["ID3v1:genre"] = str(data[at])
    return found


def _table(frame: bytes, side: int, protected: bool) -> dict | None:
    """The variable-bitrate table of the first frame, if it is one."""
    for p in {4 + side, 4 + side + 2 * protected}:
        if frame[p : p + 4] in (b"Xing", b"Info"):
            flags, q, out = int.from_bytes(frame[p + 4 : p + 8], "big"), p + 8, {"kind": frame[p : p + 4].decode()}
            for bit, key, n in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
                if flags & bit:
                    out[key] = list(frame[q : q + n]) if key == "toc" else int.from_bytes(frame[q : q + n], "big")
                    q += n
            encoder = frame[q : q + 24]
            if encoder[:4] in (b"LAME", b"Lavc", b"Lavf") and len(encoder) == 24:
                both = int.from_bytes(encoder[21:24], "big")
                out |= {"delay": both >> 12, "padding": both & 4095}
            return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        number = lambda at, n: int.from_bytes(frame[at : at + n], "big")
        points, scale, size = number(54, 2), number(56, 2), number(58, 2)
        toc = [number(62 + i * size, size) * scale for i in range(points) if 62 + (i + 1) * size <= len(frame)]
        return {"kind": "VBRI", "quality": number(44, 2), "bytes": number(46, 4), "frames": number(50, 4), "toc": toc}
    return None


def read_audio(data: bytes | None) -> dict:
    """Everything the columns need: frames, tags, table, checks, durations, seek offsets and the payload."""
    data = data or b""
    at, tags = _tags(data)
    first, end = at, len(data)
    if end - at >= 128 and data[-128:-125] == b"TAG":
        end -= 128
        tags |= _last_tag(data[-128:])
    offsets, lengths, infos, skipped, truncated, vbr, synced = [], [], [], 0, 0, None, False
    while at + 4 <= end:
        h = header(data[at : at + 4])
        if h and at + h[0] > end:
            h, truncated = None, truncated + synced
        if h and not synced:  # a header counts after a gap only if another one, or the end, follows it
            synced = at + h[0] >= end - 3 or header(data[at + h[0] : at + h[0] + 4]) is not None
            h = h if synced else None
        if not h:
            nxt = data.find(b"\xff", at + 1, end)
            nxt, synced = end if nxt < 0 else nxt, False
            skipped, at = skipped + nxt - at, nxt
            continue
        if not offsets and vbr is None and h[6] == 3 and (vbr := _table(data[at : at + h[0]], h[5], h[4])):
            at += h[0]
            continue
        offsets.append(at)
        lengths.append(h[0])
        infos.append(h)
        at += h[0]
    out = {"tags": tags, "vbr": vbr, "frames": len(offsets), "skipped": skipped, "truncated": truncated, "offsets": offsets}
    out["samples"] = max(0, sum(h[1] for h in infos) - sum((vbr or {}).get(k, 0) for k in ("delay", "padding")))
    out["us"] = sum(h[1] * 1_000_000 // h[2] for h in infos) if len({h[2] for h in infos}) > 1 else out["samples"] * 1_000_000 // infos[0][2] if infos else 0
    out["hertz"], out["kbps"] = (infos[0][2] if infos else 0), sorted({h[3] for h in infos})
    good = bad = 0
    if offsets:
        raw, start = np.frombuffer(data, np.uint8), np.array(offsets)
        for side in {h[5] for h in infos if h[4] and h[6] == 3}:
            own = start[np.array([h[4] and h[6] == 3 and h[5] == side for h in infos])]
            own = own[own + 6 + side <= len(raw)]
            covered = np.concatenate([raw[own[:, None] + np.array([2, 3])], raw[own[:, None] + np.arange(6, 6 + side)]], 1)
            stated = raw[own + 4].astype(np.uint16) << 8 | raw[own + 5]
            ok = int((crc16(covered) == stated).sum())
            good, bad = good + ok, bad + len(own) - ok
        for a, h in zip(offsets, infos, strict=True):
            if h[4] and h[6] < 3:
                ok = frame_is_whole(data[a : a + h[0]], h)
                good, bad = good + ok, bad + (not ok)
    out["crc_ok"], out["crc_bad"] = good, bad
    out["table_matches"] = None
    if vbr and ("frames" in vbr or "bytes" in vbr):
        out["table_matches"] = vbr.get("frames", len(offsets)) == len(offsets) and vbr.get("bytes", end - first) == end - first
    out["payload"] = None
    if offsets and (n := tags.get("TXXX:payload_bytes", "")).isdigit():
        out["payload"] = b"".join(data[a + 4 + 2 * h[4] + h[5] : a + h[0]] for a, h in zip(offsets, infos, strict=True))[: int(n)]
    return out


MEDIA_FIELDS = [T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("media", T.BinaryType())]


def encode_media(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds media (the text's UTF-8 bytes, padded with bytes 0 to a positive multiple of 64, as audio) and both sizes."""

    def run(texts):
        n, p, m = [], [], []
        for t in texts:
            b = (t or "").encode("utf-8", "surrogatepass")
            n.append(len(b))
            b += bytes(UNIT - len(b) if not b else -len(b) % UNIT)
            p.append(len(b))
            m.append(write_audio(b))
        return n, p, m

    return add_columns(df, [text], MEDIA_FIELDS, run)


READ_FIELDS = [
    *(T.StructField(n, T.LongType()) for n in ("frames", "duration_samples", "duration_us", "sample_rate", "skipped_bytes", "truncated_frames", "crc_ok", "crc_bad", "vbr_frames", "vbr_bytes")),
    T.StructField("vbr_kind", T.StringType()),
    T.StructField("vbr_toc", T.ArrayType(T.IntegerType())),
    T.StructField("table_matches", T.BooleanType()),
    T.StructField("bitrates", T.ArrayType(T.IntegerType())),
    T.StructField("seek_offsets", T.ArrayType(T.LongType())),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    T.StructField("payload", T.BinaryType()),
]


def read_media(df: DataFrame, media: str = "media") -> DataFrame:
    """Adds what the audio bytes hold: durations, seek offsets, checks, tags and the payload."""

    def run(values):
        rows = [read_audio(v) for v in values]
        get = lambda k: [r[k] for r in rows]
        vbr = lambda k: [(r["vbr"] or {}).get(k) for r in rows]
        return [get("frames"), get("samples"), get("us"), get("hertz"), get("skipped"), get("truncated"), get("crc_ok"), get("crc_bad"), vbr("frames"), vbr("bytes"), vbr("kind"), vbr("toc"), get("table_matches"), get("kbps"), get("offsets"), [list(r["tags"].items()) for r in rows], get("payload")]

    return add_columns(df, [media], READ_FIELDS, run)


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = stored(encode_media(table(spark, sf_dir, "documents", "doc_id", "text")).drop("text"), "media")
    read = read_media(media)
    seek = F.crc32(F.concat_ws(",", F.col("seek_offsets").cast("array<string>")))
    feature = F.concat_ws(
        ";",
        F.format_string("frames=%d", "frames"), F.format_string("samples=%d", "duration_samples"), F.format_string("us=%d", "duration_us"),
        F.format_string("hz=%d", "sample_rate"), F.concat(F.lit("kbps="), F.concat_ws("/", F.col("bitrates").cast("array<string>"))),
        F.format_string("crc=%d/%d", F.col("crc_ok"), F.col("crc_ok") + F.col("crc_bad")), F.format_string("vbr=%d", "vbr_frames"), F.concat(F.lit("table="), F.col("table_matches").cast("string")), F.format_string("seek=%08x", seek),
    )
    return read.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -UNIT, UNIT)).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"), "duration_us", "frames",
    )
