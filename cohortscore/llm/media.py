"""Media columns: lossless baseline-JPEG samples, DC thumbnails and their hashes.

A payload byte is stored as one quantised coefficient of a greyscale baseline JPEG, 64 to an
8x8 block.  The first byte of a block is its DC coefficient (quantiser 8, so the thumbnail
pixel *is* that byte); the other 63 are AC coefficients (quantiser 1).  AC value 0 would be
swallowed by run-length coding, so bytes 0..127 become -128..-1 and 128..255 become 1..128.
The Huffman table gives size category ``s`` a code of ``9 - s`` bits: code and magnitude bits
together always take nine bits, so a scan has a fixed stride and both coder and decoder are
plain numpy array expressions.  ``decode_jpeg`` reads any greyscale or interleaved baseline
scan; a table without the fixed stride takes the general symbol-by-symbol path.

Defined results: null text is the empty text (64 zero bytes); an image holds at most
8191 x 8191 blocks (4 GB), more than a Spark string can hold.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK = 64
SIDE = 8191  # most blocks along one side: 65535 pixels

SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string, width int, height int, thumb_sha256 string"
)


def _size(v: np.ndarray) -> np.ndarray:
    """Size category: bits of the magnitude."""
    a = np.abs(v)
    return np.ceil(np.log2(a + 1)).astype(np.int64)


def _nine_bit_codes() -> tuple[np.ndarray, int]:
    """Nine-bit words (code, then magnitude bits) of the values -255..255."""
    v = np.arange(-255, 256)
    s = _size(v)
    length = 9 - s
    code = (1 << length) - 2  # 0, 10, 110, ...: the canonical codes of lengths 1, 2, 3, ...
    extra = np.where(v < 0, v + (1 << s) - 1, v)
    return ((code << s) | extra).astype(np.uint16), 255


_WORDS, _ZERO = _nine_bit_codes()
_AC_WORD = _WORDS[np.where(np.arange(256) < 128, np.arange(256) - 128, np.arange(256) - 127) + _ZERO]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _tables() -> bytes:
    """DQT (DC 8, AC 1) and the two Huffman tables."""
    quant = bytes([0, 8] + [1] * 63)
    dc = bytes([0]) + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))
    ac = bytes([0x10]) + bytes([1] * 8 + [0] * 8) + bytes(range(8, 0, -1))
    return _segment(0xDB, quant) + _segment(0xC4, dc) + _segment(0xC4, ac)


_TABLES = _tables()


def pad(raw: bytes, unit: int = BLOCK) -> bytes:
    """Zero bytes up to a positive multiple of ``unit``."""
    return raw + b"\0" * (max(unit, -(-len(raw) // unit) * unit) - len(raw))


def encode_jpeg(payload: bytes) -> bytes:
    """A baseline JPEG whose coefficients are the payload (a positive multiple of 64 bytes)."""
    n = len(payload) // BLOCK
    across = max(min(n, 16), -(-n // SIDE))
    down = -(-n // across)
    full = np.zeros((across * down, BLOCK), np.uint8)
    full.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    words = _AC_WORD[full]
    dc = full[:, 0].astype(np.int32) - 128
    words[:, 0] = _WORDS[np.diff(dc, prepend=0) + _ZERO]
    c = words.reshape(-1, 8)
    out = np.empty((len(c), 9), np.uint8)
    out[:, 0] = c[:, 0] >> 1
    for j in range(1, 8):
        out[:, j] = (c[:, j - 1] << (8 - j)) | (c[:, j] >> (j + 1))
    out[:, 8] = c[:, 7]
    scan = out.tobytes().replace(b"\xff", b"\xff\x00")
    head = _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + _segment(0xFE, b"payload=%d" % len(payload)) + _TABLES
    frame = _segment(0xC0, struct.pack(">BHHB3B", 8, down * 8, across * 8, 1, 1, 0x11, 0))
    return b"\xff\xd8" + head + frame + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])) + scan + b"\xff\xd9"


class _Huffman:
    """One table: a lookup by the next 16 bits, and the fixed stride if it has one."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.symbol = np.zeros(1 << 16, np.int32)
        self.length = np.zeros(1 << 16, np.int32)
        code = at = 0
        strides = set()
        for bits in range(1, 17):
            for _ in range(counts[bits - 1]):
                lo, hi = code << (16 - bits), (code + 1) << (16 - bits)
                self.symbol[lo:hi], self.length[lo:hi] = symbols[at], bits
                strides.add(bits + (symbols[at] & 15))
                code, at = code + 1, at + 1
            code <<= 1
        self.stride = strides.pop() if len(strides) == 1 else 0
        self.runs = any(s >> 4 for s in symbols)
        self.ends = 0 in symbols[:at]


_HUFFMAN: dict[bytes, _Huffman] = {}


def parse(data: bytes) -> dict:
    """Markers of a baseline JPEG: frame, tables, comments and the entropy-coded bytes."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no SOI marker")
    out: dict = {"quant": {}, "huff": {}, "comment": [], "restart": 0}
    at = 2
    while True:
        if data[at] != 0xFF:
            raise ValueError(f"no marker at byte {at}")
        marker = data[at + 1]
        if marker == 0xFF:  # fill byte
            at += 1
            continue
        if marker == 0xD9:
            return out
        (length,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xDB:
            while body:
                wide, key = body[0] >> 4, body[0] & 15
                n = 64 * (1 + wide)
                out["quant"][key] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else "u1").astype(np.int64)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                raw = body[: 17 + n]
                if raw not in _HUFFMAN:
                    if len(_HUFFMAN) > 64:
                        _HUFFMAN.clear()
                    _HUFFMAN[raw] = _Huffman(raw[1:17], raw[17:])
                out["huff"][raw[0]] = _HUFFMAN[raw]
                body = body[17 + n :]
        elif marker == 0xC0 or marker == 0xC1:
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            if bits != 8:
                raise ValueError("only 8-bit samples are baseline")
            out |= {"height": height, "width": width, "parts": [tuple(body[6 + 3 * i : 9 + 3 * i]) for i in range(n)]}
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a baseline frame")
        elif marker == 0xDD:
            (out["restart"],) = struct.unpack(">H", body)
        elif marker == 0xFE:
            out["comment"].append(body)
        elif marker == 0xDA:
            out["scan_parts"] = [tuple(body[1 + 2 * i : 3 + 2 * i]) for i in range(body[0])]
            end = data.rfind(b"\xff\xd9", at)
            out["scan"] = data[at : end if end >= 0 else len(data)]
            return out


def _fixed(scan: bytes, blocks: int) -> np.ndarray:
    """Coefficients of a scan in which every symbol and its magnitude take nine bits."""
    n = blocks * 72
    b = np.frombuffer(scan.replace(b"\xff\x00", b"\xff")[:n], np.uint8).reshape(-1, 9).astype(np.uint16)
    w = np.empty((len(b), 8), np.uint16)
    for j in range(8):
        w[:, j] = ((b[:, j] << (j + 1)) | (b[:, j + 1] >> (7 - j))) & 511
    return w.reshape(blocks, BLOCK)


def _value_of_nine(h: _Huffman) -> np.ndarray:
    w = np.arange(512)
    s = h.symbol[w << 7] & 15
    low = w & ((1 << s) - 1)
    return np.where((s > 0) & (low < (1 << np.maximum(s - 1, 0))), low - (1 << s) + 1, low)


def _general(parts: list[bytes], image: dict, layout: list[tuple[int, _Huffman, _Huffman]], mcus: int) -> list[list[np.ndarray]]:
    """Symbol by symbol, for any baseline tables, sampling and restart intervals."""
    out: list[list[np.ndarray]] = [[] for _ in {p for p, _, _ in layout}]
    done = 0
    for raw in parts:
        data = raw.replace(b"\xff\x00", b"\xff")
        total = len(data) * 8
        data += b"\xff" * 8
        pos, before = 0, [0] * len(out)

        def bits(n: int, at: int) -> int:
            """n bits (at most 16) from bit ``at`` on, of the five bytes around them."""
            return (int.from_bytes(data[at >> 3 : (at >> 3) + 5], "big") >> (40 - (at & 7) - n)) & ((1 << n) - 1)

        for _ in range(min(image["restart"] or mcus, mcus - done)):
            for part, dc, ac in layout:
                block = np.zeros(64, np.int64)
                k = 0
                while k < 64:
                    table = ac if k else dc
                    if pos >= total:
                        raise ValueError("the scan ends within a block")
                    look = bits(16, pos)
                    symbol, n = int(table.symbol[look]), int(table.length[look])
                    if not n:
                        raise ValueError("bad Huffman code")
                    pos += n
                    run, s = symbol >> 4, symbol & 15
                    if k and not s:
                        if run != 15:
                            break
                        k += 16
                        continue
                    v = bits(s, pos) if s else 0
                    pos += s
                    if s and v < 1 << (s - 1):
                        v += 1 - (1 << s)
                    if k:
                        k += run
                    else:
                        before[part] += v
                        v = before[part]
                    block[k] = v
                    k += 1
                out[part].append(block)
            done += 1
    return out


def decode_jpeg(data: bytes) -> tuple[dict, np.ndarray]:
    """The parsed image and its first component's quantised coefficients (blocks x 64, scan order)."""
    image = parse(data)
    blocks_of = {c: (hv >> 4, hv & 15) for c, hv, _ in image["parts"]}
    first = image["scan_parts"][0]
    if len(image["scan_parts"]) == 1:
        dc, ac = image["huff"][first[1] >> 4], image["huff"][0x10 | (first[1] & 15)]
        n = -(-image["width"] // 8) * -(-image["height"] // 8)
        if dc.stride == ac.stride == 9 and not (ac.runs or ac.ends or image["restart"]):
            w = _fixed(image["scan"], n)
            out = _value_of_nine(ac)[w]
            out[:, 0] = np.cumsum(_value_of_nine(dc)[w[:, 0]])
            return image, out
        layout, mcus = [(0, dc, ac)], n
    else:
        across = -(-image["width"] // (8 * max(h for h, _ in blocks_of.values())))
        down = -(-image["height"] // (8 * max(v for _, v in blocks_of.values())))
        layout, mcus = [], across * down
        for i, (c, t) in enumerate(image["scan_parts"]):
            h, v = blocks_of[c]
            layout += [(i, image["huff"][t >> 4], image["huff"][0x10 | (t & 15)])] * (h * v)
    parts, at, scan = [], 0, image["scan"]
    if image["restart"]:
        for i in range(len(scan) - 1):
            if scan[i] == 0xFF and 0xD0 <= scan[i + 1] <= 0xD7:
                parts.append(scan[at:i])
                at = i + 2
    parts.append(scan[at:])
    return image, np.array(_general(parts, image, layout, mcus)[0])


def thumbnail(image: dict, coefficients: np.ndarray) -> np.ndarray:
    """DC-only luminance: one pixel for each 8x8 block, by rows."""
    across = -(-image["width"] // 8)
    h, v = image["parts"][0][1] >> 4, image["parts"][0][1] & 15
    q = image["quant"][image["parts"][0][2]][0]
    level = np.clip(np.rint(coefficients[:, 0] * q / 8 + 128), 0, 255).astype(np.uint8)
    if len(image["scan_parts"]) == 1:
        return level.reshape(-1, across)
    widest, tallest = (max(f) for f in zip(*((p[1] >> 4, p[1] & 15) for p in image["parts"]), strict=True))
    units = -(-image["width"] // (8 * widest))
    whole = level.reshape(-1, units, v, h).transpose(0, 2, 1, 3).reshape(-1, units * h)
    return whole[: -(-image["height"] * v // (8 * tallest)), : -(-image["width"] * h // (8 * widest))]


def average_hash(pixels: np.ndarray, side: int = 8) -> str:
    """64-bit average hash of the thumbnail reduced to 8x8 cells (hex)."""
    rows = np.linspace(0, len(pixels), side + 1).astype(int)
    cols = np.linspace(0, pixels.shape[1], side + 1).astype(int)
    total = np.zeros((len(pixels) + 1, pixels.shape[1] + 1), np.int64)
    total[1:, 1:] = pixels.cumsum(0, dtype=np.int64).cumsum(1)
    r0, r1 = np.minimum(rows[:-1], len(pixels) - 1), np.maximum(rows[1:], np.minimum(rows[:-1], len(pixels) - 1) + 1)
    c0, c1 = np.minimum(cols[:-1], pixels.shape[1] - 1), np.maximum(cols[1:], np.minimum(cols[:-1], pixels.shape[1] - 1) + 1)
    sums = total[r1][:, c1] - total[r1][:, c0] - total[r0][:, c1] + total[r0][:, c0]
    mean = sums / ((r1 - r0)[:, None] * (c1 - c0)[None, :])
    return np.packbits(mean > mean.mean()).tobytes().hex()


def payload_of(image: dict, coefficients: np.ndarray) -> bytes:
    """The bytes that ``encode_jpeg`` stored."""
    n = next(int(c[8:]) for c in image["comment"] if c.startswith(b"payload="))
    out = np.where(coefficients < 0, coefficients + 128, coefficients + 127)
    out[:, 0] = coefficients[:, 0] + 128
    return out.astype(np.uint8).tobytes()[:n]


def describe(text: str | None) -> tuple:
    """Store one text as media, read it back and return its features (the columns after doc_id)."""
    raw = (text or "").encode()
    media = encode_jpeg(pad(raw))
    image, coefficients = decode_jpeg(media)
    payload = payload_of(image, coefficients)
    pixels = thumbnail(image, coefficients)
    thumb = hashlib.sha256(pixels.tobytes()).hexdigest()
    feature = f"jpeg:{image['width']}x{image['height']}:{average_hash(pixels)}:{thumb[:16]}"
    return (
        len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]),
        len(media), hashlib.sha256(media).hexdigest(), feature, image["width"], image["height"], thumb,
    )


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of media features for each document; map-only, one text in memory at a time.

    Null or empty text: 64 zero bytes.  Very long texts make one tall image each, up to the size limit in
    the module's docstring.  Repeated rows stay repeated; an empty table gives no rows; other columns of
    the input are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows = [describe(t.as_py()) for t in part.column(1)]
                cols = [part.column(0), *map(list, zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _ARROW, strict=True)], names=_NAMES)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA)


_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
_ARROW = [_KINDS[c.split()[1]] for c in SCHEMA.split(", ")]
