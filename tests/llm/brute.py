"""Plain reference versions for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


def shingles(t):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def components(sets):
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for i, s in enumerate(sets):
        c = Counter(j for x in s for j in holders[x] if j > i)
        for j, n in c.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def repeats(raws, width=400):
    """Per text: flags of bytes under a string of that width that starts elsewhere too."""
    seen = Counter(r[i : i + width] for r in raws for i in range(len(r) - width + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - width + 1):
            if seen[r[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        out.append(gone)
    return out


def spans(gone):
    return sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))


def media_feature(payload: bytes, width: int, height: int) -> str:
    """The feature of a stored payload, cell by cell: the first byte of each 64 is a pixel, blocks after the last are 0."""
    across, down = width // 8, height // 8
    pixels = list(payload[::64]) + [0] * (across * down - len(payload) // 64)
    means = []
    for i in range(8):
        r0 = min(i * down // 8, down - 1)
        r1 = max((i + 1) * down // 8, r0 + 1)
        for j in range(8):
            c0 = min(j * across // 8, across - 1)
            c1 = max((j + 1) * across // 8, c0 + 1)
            cell = [pixels[r * across + c] for r in range(r0, r1) for c in range(c0, c1)]
            means.append(sum(cell) / len(cell))
    level = float(np.mean(means))
    bits = "".join("1" if m > level else "0" for m in means)
    return f"jpeg:{width}x{height}:{int(bits, 2):016x}:{hashlib.sha256(bytes(pixels)).hexdigest()[:16]}"


def colour_jpeg(width: int, height: int, seed: int, restart: int) -> tuple[bytes, list[np.ndarray], int]:
    """A baseline JPEG of three components (the first sampled twice as densely across), its first component's blocks in scan order, and its DC step.

    Codes are of one length (4 bits for DC, 8 for AC sizes): another coder than the engine's, with end-of-block, runs of 16 zeros,
    stuffed bytes and restart markers.
    """
    rng = np.random.default_rng(seed)
    dc_symbols, ac_symbols = list(range(12)), [0, 0xF0, *[run << 4 | size for run in range(16) for size in range(1, 11)]]
    mcus = -(-width // 16) * -(-height // 8)
    scan, bits, before, first = b"", "", [0, 0, 0], []

    def number(v: int) -> tuple[int, str]:
        size = abs(v).bit_length()
        return size, format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else ""

    for m in range(mcus):
        if restart and m and m % restart == 0:
            bits += "1" * (-len(bits) % 8)
            scan += bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0") + bytes([0xFF, 0xD0 + (m // restart - 1) % 8])
            bits, before = "", [0, 0, 0]
        for part in (0, 0, 1, 2):
            block = np.zeros(64, np.int64)
            block[0] = rng.integers(-300, 300)
            at = rng.choice(np.arange(1, 64), rng.integers(0, 6), replace=False)
            block[at] = rng.integers(-1000, 1000, len(at))
            size, extra = number(int(block[0]) - before[part])
            before[part] = int(block[0])
            bits += format(dc_symbols.index(size), "04b") + extra
            run = 0
            for v in block[1:].tolist():
                if not v:
                    run += 1
                    continue
                while run > 15:
                    bits += format(ac_symbols.index(0xF0), "08b")
                    run -= 16
                size, extra = number(v)
                bits += format(ac_symbols.index(run << 4 | size), "08b") + extra
                run = 0
            if run:
                bits += format(ac_symbols.index(0), "08b")
            if part == 0:
                first.append(block)
    bits += "1" * (-len(bits) % 8)
    scan += bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")

    def segment(marker: int, body: bytes) -> bytes:
        return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body

    def counts(bits: int, n: int) -> bytes:
        return bytes([n if i == bits else 0 for i in range(1, 17)])

    step = 3
    head = segment(0xDB, bytes([0, step] + [1] * 63)) + segment(0xC4, b"\0" + counts(4, 12) + bytes(dc_symbols) + b"\x10" + counts(8, len(ac_symbols)) + bytes(ac_symbols))
    frame = segment(0xC0, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([3, 1, 0x21, 0, 2, 0x11, 0, 3, 0x11, 0]))
    every = segment(0xDD, restart.to_bytes(2, "big")) if restart else b""
    return b"\xff\xd8" + head + frame + every + segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9", first, step
