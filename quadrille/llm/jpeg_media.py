"""Operator 3: media columns as baseline JPEG.

A payload of 64-byte units is stored losslessly as a greyscale baseline JPEG: a unit is an 8x8 block, a byte the entropy-coded bits of one quantised
coefficient in zigzag order (category 8, so the coefficient is the byte, less 255 below 128).  Every block is a restart interval, so a reader can start
anywhere.  Reading parses the markers, takes out stuffed bytes, Huffman-decodes all restart intervals of a batch in step in numpy, and rebuilds
the luminance thumbnail from DC coefficients alone.

The reader takes any baseline sequential JPEG of one interleaved scan.  Null and empty texts: one block of zeros.  Equal texts give equal bytes.
Very long texts: up to 8191 by 8191 blocks (4 GB), an error beyond.  An empty table: no rows.  Repeated rows and extra columns pass through; a column named as a result is replaced.
"""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import struct_udf, table

UNIT = 64
MAX_BLOCKS = 8191  # a side holds 65,535 samples at most


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def pad(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT))


def encode_payload(payload: bytes) -> bytes:
    """A JPEG of the payload, whose length is a positive multiple of 64."""
    n = len(payload) // UNIT
    wide = min(n, MAX_BLOCKS)
    high = -(-n // wide)
    if high > MAX_BLOCKS:
        raise ValueError("payload too large for one image")
    head = (
        b"\xff\xd8"
        + _segment(0xFE, b"units=%d" % n)
        + _segment(0xDB, b"\x00" + b"\x01" * 64)
        + _segment(0xC0, b"\x08" + (8 * high).to_bytes(2, "big") + (8 * wide).to_bytes(2, "big") + b"\x01\x01\x11\x00")
        + _segment(0xC4, b"\x00" + b"\x01" + bytes(15) + b"\x08")
        + _segment(0xC4, b"\x10" + b"\x01" + bytes(15) + b"\x08")
        + _segment(0xDD, b"\x00\x01")
        + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    )
    data = np.zeros(wide * high * UNIT, np.uint8)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    bits = np.zeros((len(data), 9), np.uint8)
    bits[:, 1:] = np.unpackbits(data).reshape(-1, 8)
    blocks = np.packbits(bits).reshape(-1, 72)
    out = np.empty((len(blocks), 74), np.uint8)
    out[:, :72] = blocks
    out[:, 72] = 0xFF
    out[:, 73] = 0xD0 + np.arange(len(blocks)) % 8
    flat = out.reshape(-1)[:-2]
    if (full := np.flatnonzero(blocks.reshape(-1) == 0xFF)).size:
        flat = np.insert(flat, full // 72 * 74 + full % 72 + 1, 0)
    return head + flat.tobytes() + b"\xff\xd9"


class Header:
    """What the markers before the scan say."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        self.quant, self.tables, self.interval, self.comment, at = {}, {}, 0, b"", 2
        while True:
            while data[at + 1] == 0xFF:
                at += 1
            marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = [int.from_bytes(body[1 + k * (wide + 1) : 1 + (k + 1) * (wide + 1)], "big") for k in range(64)]
                    body = body[1 + 64 * (wide + 1) :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.tables[body[0]] = body[1 : 17 + n]
                    body = body[17 + n :]
            elif marker in (0xC0, 0xC1):
                self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                self.parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
            elif 0xC2 <= marker <= 0xCF:
                raise ValueError("not a baseline JPEG")
            elif marker == 0xDD:
                self.interval = int.from_bytes(body, "big")
            elif marker == 0xFE:
                self.comment = body
            elif marker == 0xDA:
                self.scan = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
                if len(self.scan) != len(self.parts):
                    raise ValueError("more than one scan")
                break
        self.at = at
        tall, wide = max(v for _, _, v, _ in self.parts), max(h for _, h, _, _ in self.parts)
        self.scale = (1, 1) if len(self.parts) == 1 else (wide, tall)
        self.wide, self.high = -(-self.width // (8 * self.scale[0])), -(-self.height // (8 * self.scale[1]))
        self.mcu = [k for k, (_, h, v, _) in enumerate(self.parts) for _ in range(1 if len(self.parts) == 1 else h * v)]
        self.mcus = self.wide * self.high

    def key(self):
        return tuple((self.tables[self.scan[c] >> 4], self.tables[0x10 | self.scan[c] & 15]) for c, *_ in self.parts), tuple(self.mcu)


def _lookup(table_: bytes) -> np.ndarray:
    """For each 16 bits that may come: 256 times the code's length, plus its symbol."""
    out, code, at = np.zeros(1 << 16, np.int32), 0, 16
    for size in range(1, 17):
        for _ in range(table_[size - 1]):
            out[code << (16 - size) : (code + 1) << (16 - size)] = size << 8 | table_[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _scan(data: bytes, head: Header) -> list[np.ndarray]:
    """The bytes of each restart interval, without stuffed zeros."""
    raw = np.frombuffer(data, np.uint8, offset=head.at)
    marks = np.flatnonzero(raw[:-1] == 0xFF)
    after = raw[marks + 1]
    ends = marks[(after != 0) & (after != 0xFF)]
    stop = ends[~((raw[ends + 1] >= 0xD0) & (raw[ends + 1] <= 0xD7))][0]
    cuts = ends[ends < stop]
    drop = marks[(after == 0) & (marks < stop)] + 1
    keep = np.ones(stop, bool)
    keep[drop] = False
    keep[cuts] = keep[cuts + 1] = False
    at = np.concatenate([[0], cuts + 2]), np.concatenate([cuts, [stop]])
    size = np.concatenate([[0], np.cumsum(keep)])
    return raw[:stop][keep], size[at[0]], size[at[1]]


def _decode(heads: list[Header], scans: list) -> list[np.ndarray]:
    """The coefficients (blocks x 64, zigzag order) of images that share tables and MCU layout: all restart intervals advance together."""
    head = heads[0]
    luts = [(_lookup(dc), _lookup(ac)) for dc, ac in head.key()[0]]
    starts, counts, where, offset, total = [], [], [], 0, 0
    for h, (raw, begin, _) in zip(heads, scans):
        per = h.interval or h.mcus
        n = np.minimum(per, h.mcus - per * np.arange(len(begin)))
        starts.append((begin + offset) * 8)
        counts.append(n)
        where.append(total + np.concatenate([[0], np.cumsum(n)[:-1]]))
        offset, total = offset + len(raw), total + h.mcus
    data = np.concatenate([*(s[0] for s in scans), np.full(8, 0xFF, np.uint8)]).astype(np.uint64)
    window = data[:-4] << 32 | data[1:-3] << 24 | data[2:-2] << 16 | data[3:-1] << 8 | data[4:]
    window = window.astype(np.int64)
    pos, counts, where = (np.concatenate(x).astype(np.int64) for x in (starts, counts, where))
    per_mcu = len(head.mcu)
    coef = np.zeros((total * per_mcu, 64), np.int16)

    def bits(lane):
        p = pos[lane]
        return window[p >> 3], p & 7

    def number(w, shift, used, size):
        value = (w >> (40 - shift - used - size)) & ((1 << size) - 1)
        return np.where((size > 0) & (value < (1 << np.maximum(size - 1, 0))), value - (1 << size) + 1, value)

    before = np.zeros((len(pos), len(head.parts)), np.int64)
    for m in range(int(counts.max(initial=0))):
        lanes = np.flatnonzero(counts > m)
        for b, part in enumerate(head.mcu):
            dc, ac = luts[part]
            row = (where[lanes] + m) * per_mcu + b
            w, shift = bits(lanes)
            found = dc[(w >> (24 - shift)) & 0xFFFF]
            used, size = found >> 8, found & 255
            before[lanes, part] += number(w, shift, used, size)
            coef[row, 0] = before[lanes, part]
            pos[lanes] += used + size
            live, k, rows = lanes, np.ones(len(lanes), np.int64), row
            while len(live):
                w, shift = bits(live)
                found = ac[(w >> (24 - shift)) & 0xFFFF]
                used, run, size = found >> 8, (found >> 4) & 15, found & 15
                if not used.all():
                    raise ValueError("damaged scan")
                pos[live] += used + size
                k = k + run
                hit = np.flatnonzero(size)
                if len(hit) == len(live):
                    coef[rows, k] = number(w, shift, used, size)
                else:
                    coef[rows[hit], k[hit]] = number(w[hit], shift[hit], used[hit], size[hit])
                    k = np.where((size == 0) & (run < 15), 64, k)
                k = k + 1
                if k.max() > 63:
                    going = k < 64
                    live, k, rows = live[going], k[going], rows[going]
    out, at = [], 0
    for h in heads:
        out.append(coef[at : at + h.mcus * per_mcu])
        at += h.mcus * per_mcu
    return out


def decode_images(images: list[bytes]) -> list[tuple[Header, np.ndarray]]:
    heads = [Header(x) for x in images]
    groups: dict = {}
    for k, h in enumerate(heads):
        groups.setdefault(h.key(), []).append(k)
    out: list = [None] * len(images)
    for ks in groups.values():
        for k, c in zip(ks, _decode([heads[k] for k in ks], [_scan(images[k], heads[k]) for k in ks])):
            out[k] = heads[k], c
    return out


def thumbnail(head: Header, coef: np.ndarray) -> np.ndarray:
    """One luminance sample a block, from the DC coefficient alone."""
    _, h, v, q = head.parts[0]
    n = len(head.mcu)
    if len(head.parts) == 1:
        h = v = 1
    dc = coef[:, 0].reshape(head.high, head.wide, n)[:, :, : h * v].reshape(head.high, head.wide, v, h)
    grid = dc.transpose(0, 2, 1, 3).reshape(head.high * v, head.wide * h).astype(np.float64)
    return np.clip(np.rint(grid * head.quant[q][0] / 8 + 128), 0, 255).astype(np.uint8)


def payload_of(head: Header, coef: np.ndarray) -> bytes:
    """What encode_payload stored."""
    n = int(head.comment.removeprefix(b"units="))
    c = coef[:n].reshape(-1)
    return np.where(c < 0, c + 255, c).astype(np.uint8).tobytes()


def _writer():
    return lambda texts: [[encode_payload(pad((t or "").encode("utf-8", "replace"))) for t in texts.to_pylist()]]


def _reader():
    def work(media: pa.Array):
        rows = []
        images = media.to_pylist()
        for image, (head, coef) in zip(images, decode_images(images)):
            payload, small = payload_of(head, coef), thumbnail(head, coef)
            digest = hashlib.sha256(small.tobytes()).hexdigest()[:16]
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(image), hashlib.sha256(image).hexdigest(), head.width, head.height, digest))
        return [list(c) for c in zip(*rows)] or [[] for _ in range(8)]

    return work


FEATURES = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("thumbnail_sha", pa.string())]


def store(docs: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """docs with a JPEG of each whole text."""
    return docs.withColumn(out, struct_udf(_writer, [("media", pa.binary())])(F.col(text))["media"])


def features(rows: DataFrame, media: str = "media", out: str = "features") -> DataFrame:
    """rows with a struct of what the stored bytes give: the payload's digest, dimensions and the thumbnail's hash."""
    return rows.withColumn(out, struct_udf(_reader, FEATURES)(F.col(media)))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kept = store(docs).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "media")
    f = F.col("features")
    return features(kept).select("doc_id", "n_bytes", *(f[n].alias(n) for n, _ in FEATURES[:5]), F.concat_ws(":", F.concat_ws("x", f["width"], f["height"]), f["thumbnail_sha"]).alias("feature"))
