"""Media columns: AVI with motion JPEG, written, read back and cut into shots.

A payload is stored as 8-bit grey frames of 16 x 12 samples, each an intra frame of lossless JPEG (process SOF3, left
prediction, one Huffman table over difference categories), in a RIFF file with stream headers, a movi list and an idx1
index. Reading walks the RIFF chunks, takes frames by the index and decodes all frames of many files in step, a sample of
each at a time. Shots end where the histogram of a frame differs from the one before by more than twice the mean of the
differences around it; each shot is a clip with start and end times.

Defined cases: a null or empty text is one frame of spaces; a null doc_id is kept; equal texts give equal files; a file
that isn't of this kind raises ValueError; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, raw
from .substring_dedup import chunks

WIDTH, HEIGHT, RATE = 16, 12, 25
UNIT = WIDTH * HEIGHT
AROUND = 8  # frames before and after whose differences make the threshold
LEAST = 24  # samples of a frame that a shot's end must move between bins, at least
BINS = 16

# Code lengths of the difference categories 0 to 8; text differs mostly by category 3, 4 or 7.
LENGTHS = {7: 2, 4: 2, 3: 3, 2: 3, 5: 3, 1: 4, 0: 5, 6: 6, 8: 7}


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header() -> bytes:
    order = sorted(LENGTHS, key=lambda c: (LENGTHS[c], c))
    bits = bytes(sum(n == k for n in LENGTHS.values()) for k in range(1, 17))
    return (
        b"\xff\xd8"
        + _segment(0xC4, b"\x00" + bits + bytes(order))
        + _segment(0xC3, struct.pack(">BHHB", 8, HEIGHT, WIDTH, 1) + b"\x01\x11\x00")
        + _segment(0xDA, b"\x01\x01\x00\x01\x00\x00")
    )


HEADER = _header()


def codes(bits: bytes, values: bytes) -> dict[int, tuple[int, int]]:
    """category -> (code, length) of a canonical table."""
    out, code, at = {}, 0, 0
    for length in range(1, 17):
        for _ in range(bits[length - 1]):
            out[values[at]] = (code, length)
            code, at = code + 1, at + 1
        code <<= 1
    return out


def parse_header(frame: bytes) -> tuple[int, tuple[bytes, bytes]]:
    """Where the entropy-coded data of a frame starts, and its Huffman table. Markers are read one by one."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at, table, known = 2, None, False
    while at + 4 <= len(frame):
        mark, size = frame[at + 1], int.from_bytes(frame[at + 2 : at + 4], "big")
        body = frame[at + 4 : at + 2 + size]
        if frame[at] != 0xFF:
            break
        if mark == 0xC4:
            table = (body[1:17], body[17:])
        elif mark == 0xC3:
            known = struct.unpack(">BHHB", body[:6]) == (8, HEIGHT, WIDTH, 1)
        elif mark == 0xDA:
            if known and table and body[3:] == b"\x01\x00\x00":
                return at + 2 + size, table
            break
        at += 2 + size
    raise ValueError("not a frame of this kind")


def _encode_table() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number, by difference + 255."""
    table = codes(HEADER[7:23], HEADER[23:32])
    value, size = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        code, n = table[c]
        value[d + 255], size[d + 255] = code << c | (d if d >= 0 else d + (1 << c) - 1), n + c
    return value, size


ENCODE = _encode_table()
_decode_tables: dict[tuple[bytes, bytes], tuple[np.ndarray, np.ndarray]] = {}


def decode_table(table: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Difference and number of bits, by the next 16 bits."""
    if table not in _decode_tables:
        diff, size = np.zeros(1 << 16, np.int16), np.zeros(1 << 16, np.uint8)
        for c, (code, n) in codes(*table).items():
            if n + c > 16:
                raise ValueError("a code of this table is too long")
            for extra in range(1 << c):
                lo = (code << c | extra) << 16 - n - c
                d = extra if c == 0 or extra >> c - 1 else extra - (1 << c) + 1
                diff[lo : lo + (1 << 16 - n - c)], size[lo : lo + (1 << 16 - n - c)] = d, n + c
        _decode_tables[table] = diff, size
    return _decode_tables[table]


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """JPEG frames of samples (frames, HEIGHT, WIDTH)."""
    s = samples.astype(np.int16)
    diff = s.copy()
    diff[:, :, 1:] -= s[:, :, :-1]
    diff[:, 1:, 0] -= s[:, :-1, 0]
    diff[:, 0, 0] -= 128
    at = diff.reshape(len(s), UNIT) + 255
    value, size = ENCODE[0][at], ENCODE[1][at]
    ends = np.cumsum(size, axis=1)
    bits = ends[:, -1]
    length = (bits + 7) // 8
    base = np.cumsum(length) - length
    pos = (ends - size + base[:, None] * 8).ravel()
    word = value.ravel() << (24 - size.ravel() - (pos & 7))
    byte, total = pos >> 3, int(length.sum())
    data = sum(np.bincount(byte + k, word >> 16 - 8 * k & 255, total + 3) for k in range(3))[:total].astype(np.uint8)
    data[base + length - 1] |= ((1 << (-bits & 7)) - 1).astype(np.uint8)  # the last byte is filled with ones
    stream = data.tobytes()
    return [HEADER + stream[a : a + n].replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for a, n in zip(base.tolist(), length.tolist(), strict=True)]


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """Samples (frames, HEIGHT, WIDTH) of frames with one Huffman table."""
    if not frames:
        return np.zeros((0, HEIGHT, WIDTH), np.uint8)
    start, table = parse_header(frames[0])
    head, scans = frames[0][:start], []
    for f in frames:
        if not f.startswith(head):
            own, other = parse_header(f)
            if other != table:
                raise ValueError("frames with different tables")
            scans.append(f[own:-2].replace(b"\xff\x00", b"\xff"))
        else:
            scans.append(f[start:-2].replace(b"\xff\x00", b"\xff"))
    sizes = np.array([len(x) for x in scans])
    data = np.frombuffer(b"".join(scans) + b"\xff" * 8, np.uint8).astype(np.uint32)
    window = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    value, size = decode_table(table)
    pos, out, top = (np.cumsum(sizes) - sizes) * 8, np.empty((UNIT, len(frames)), np.int16), len(window) - 1
    for k in range(UNIT):
        next16 = window[np.minimum(pos >> 3, top)] << (pos & 7).astype(np.uint32) >> 16
        out[k] = value[next16]
        pos += size[next16]
    diff = out.T.reshape(len(frames), HEIGHT, WIDTH).astype(np.int32)
    diff[:, 0, 0] += 128
    diff[:, :, 0] = np.cumsum(diff[:, :, 0], axis=1)
    return (np.cumsum(diff, axis=2) & 255).astype(np.uint8)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) & 1)


def write_avi(frames: list[bytes], n_bytes: int) -> bytes:
    """The file; n_bytes, the length without padding, is kept as a comment."""
    largest = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // RATE, largest * RATE, 0, 0x10, len(frames), 0, 1, largest, WIDTH, HEIGHT, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, RATE, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", UNIT, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", str(n_bytes).encode()))
    sizes = np.array([len(f) for f in frames])
    steps = sizes + (sizes & 1) + 8
    index = np.zeros((len(frames), 4), "<u4")
    index[:, 0], index[:, 1], index[:, 2], index[:, 3] = int.from_bytes(b"00dc", "little"), 0x10, np.cumsum(steps) - steps + 4, sizes
    movi = _chunk(b"LIST", b"movi" + b"".join(_chunk(b"00dc", f) for f in frames))
    return _chunk(b"RIFF", b"AVI " + hdrl + info + movi + _chunk(b"idx1", index.tobytes()))


def read_avi(data: bytes) -> tuple[list[bytes], int]:
    """Frames, taken by the index, and the length without padding."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movi, index, n_bytes, handler = 12, None, None, None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        kind = data[at + 8 : at + 12]
        if name == b"LIST" and kind == b"movi":
            movi = at + 8
        elif name == b"LIST" and kind == b"INFO":
            found = data.index(b"ICMT", at, at + 8 + size)
            n_bytes = int(data[found + 8 : found + 8 + int.from_bytes(data[found + 4 : found + 8], "little")])
        elif name == b"LIST" and kind == b"hdrl":
            found = data.index(b"strh", at, at + 8 + size)
            handler = data[found + 8 : found + 16]
        elif name == b"idx1":
            index = np.frombuffer(data, "<u4", size // 4, at + 8).reshape(-1, 4)
        at += 8 + size + (size & 1)
    if movi is None or index is None or handler != b"vidsMJPG" or n_bytes is None:
        raise ValueError("not an indexed motion-JPEG file of this kind")
    return [data[a : a + n] for a, n in zip((index[:, 2] + movi + 8).tolist(), index[:, 3].tolist(), strict=True)], n_bytes


def payload(text: bytes | None) -> bytes:
    text = text or b""
    return text + b" " * (-len(text) % UNIT if text else UNIT)


def write_all(texts: list[bytes | None]) -> list[bytes]:
    """The file of each text; the frames of all are encoded together."""
    bodies = [payload(t) for t in texts]
    frames = encode_frames(np.frombuffer(b"".join(bodies), np.uint8).reshape(-1, HEIGHT, WIDTH))
    out, at = [], 0
    for t, b in zip(texts, bodies, strict=True):
        n = len(b) // UNIT
        out.append(write_avi(frames[at : at + n], len(t or b"")))
        at += n
    return out


def read_all(files: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Samples of all frames, frames of each file, lengths without padding."""
    read = [read_avi(f) for f in files]
    return decode_frames([x for frames, _ in read for x in frames]), np.array([len(f) for f, _ in read]), [n for _, n in read]


def shots(samples: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(True where a frame starts a shot, histograms of the frames)."""
    n = len(samples)
    hist = np.bincount(np.repeat(np.arange(n) * BINS, UNIT) + (samples.reshape(-1) // (256 // BINS)), minlength=n * BINS).reshape(n, BINS)
    first = np.cumsum(sizes) - sizes
    start, end = np.repeat(first, sizes), np.repeat(first + sizes, sizes)
    diff = np.zeros(n, np.int64)
    diff[1:] = np.abs(hist[1:] - hist[:-1]).sum(axis=1) // 2
    diff[first] = 0
    total, at = np.r_[0, np.cumsum(diff)], np.arange(n)
    lo, hi = np.maximum(at - AROUND, start + 1), np.minimum(at + AROUND, end - 1)
    others = total[np.maximum(hi + 1, lo)] - total[lo] - diff
    cut = (diff >= LEAST) & (hi > lo) & (diff * (hi - lo) > 2 * others)
    cut[first] = True
    return cut, hist


def files(docs: DataFrame) -> DataFrame:
    """doc_id, media binary: the AVI file of each document."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or b"" for t in raw(batch.column(1))]
            media = [m for a, b in chunks(texts) for m in write_all(texts[a:b])]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], names=["doc_id", "media"])

        return each

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, "doc_id long, media binary", 128)


def clips(media: DataFrame) -> DataFrame:
    """doc_id, clip, start_frame, end_frame, start_s, end_s: the shots of each file; null media give none."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [(d, m) for d, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if m is not None]
            out = [[] for _ in range(6)]
            samples, sizes, _ = read_all([m for _, m in rows])
            cut, _ = shots(samples, sizes) if len(samples) else (np.zeros(0, bool), None)
            at = 0
            for (doc, _), n in zip(rows, sizes.tolist(), strict=True):
                edge = [*np.flatnonzero(cut[at : at + n]).tolist(), n]
                for k, (a, b) in enumerate(zip(edge, edge[1:], strict=False)):
                    for o, x in zip(out, (doc, k, a, b, a / RATE, b / RATE), strict=True):
                        o.append(x)
                at += n
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], names=["doc_id", "clip", "start_frame", "end_frame", "start_s", "end_s"])

        return each

    return map_rows(media.select(F.col("doc_id").cast("long"), "media"), make, "doc_id long, clip int, start_frame long, end_frame long, start_s double, end_s double", 128)


def media_digest(docs: DataFrame) -> DataFrame:
    """Writes, reads back and describes the file of each document, without keeping it."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def rows(texts: list[bytes | None]):
        media = write_all(texts)
        samples, sizes, lengths = read_all(media)
        cut, hist = shots(samples, sizes)
        stored, at = samples.tobytes(), 0
        for m, n, n_bytes in zip(media, sizes.tolist(), lengths, strict=True):
            body = stored[at * UNIT : (at + n) * UNIT]
            starts = np.flatnonzero(cut[at : at + n]).tolist()
            feature = f"{n} frames; shots at {','.join(map(str, starts))}; bins {','.join(map(str, hist[at : at + n].sum(axis=0).tolist()))}"
            yield n_bytes, len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature
            at += n

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or b"" for t in raw(batch.column(1))]
            out = [r for a, b in chunks(texts) for r in rows(texts[a:b])]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds))], names=names)

        return each

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
