"""Suffix-array dedup of byte strings by a common-prefix-aware distributed merge sort.

Every byte covered by a string of ``width`` bytes that starts anywhere else too is removed.
Sorting all suffixes would multiply the corpus, so only anchors are sorted: in each window of
``width`` bytes, the ``KMER``-byte string with the smallest hash (a minimizer).  Equal windows have
their anchor at the same offset, so any repeat shows at anchors with equal strings; an anchor whose
string occurs once is dropped, after an exchange of hashes.

An anchor that is left is sorted by the text from it on, then by the text before it, backwards.
Each task sorts its anchors, folds equal contexts into one and front-codes the sorted run (length
of the prefix shared with the one before, and the rest).  Runs are exchanged by anchor hash, so that
all suffixes with an anchor's string meet, and merged by a loser tree that keeps, for each run, the
prefix it shares with the last string put out: longer prefixes win without a look at the bytes, and
bytes known to be equal are never compared again.

Of the merged array the common prefixes give the tree of right extensions; merging children, smaller
into larger, in the order of the left contexts gives each anchor its best left extension at every
depth.  A pair whose extensions make up ``width`` bytes marks its span in both.

An anchor string with ``HOT`` occurrences or more could fill one task of the merge, so its windows are
dealt out instead: of each window, a run sends one context that has it, equal windows of two runs meet by
a 128-bit hash, and what comes back is the first and last window of a context that repeats.  So the
merge by bytes does all but the most frequent anchors, and no task holds what is frequent.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 400
KMER = 200
STEP = 1 << 18
FLUSH = 60_000  # anchors in a sorted run
HOT = 5_000  # occurrences from which an anchor's windows are dealt out one by one
PAD = b"\xff"  # never in UTF-8
NO_ID = -(1 << 63)

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_TABLE, _TABLE2 = np.random.default_rng(11).integers(0, 1 << 64, (2, 256), np.uint64)
_P = _I = np.zeros(0, np.uint64)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values, by prefix and suffix minima of blocks."""
    n = len(x) - w + 1
    rows = -(-len(x) // w)
    padded = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    grid = padded.reshape(rows, w)
    ahead = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    behind = np.minimum.accumulate(grid, axis=1).reshape(-1)
    return np.minimum(ahead[:n], behind[w - 1 : w - 1 + n])


def anchors(raw: np.ndarray, width: int = WIDTH, k: int = KMER) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the minimizers of all windows; long texts are taken in steps."""
    global _P, _I
    if len(_P) < STEP + width:
        _P, _I = _powers(_BASE, STEP + width), _powers(_INVERSE, STEP + width)
    hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for s in range(0, len(raw) - width + 1, STEP):
        part = raw[s : s + STEP + width - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_TABLE[part] * _P[: len(part)], out=sums[1:])
        h = (sums[k:] - sums[:-k]) * _I[: len(part) - k + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        low = _sliding_min((h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64), width - k + 1)
        at = np.unique(low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        hashes.append(h[at])
        places.append(at + s)
    place, first = np.unique(np.concatenate(places), return_index=True)
    return np.concatenate(hashes)[first], place


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)


def context(raw: bytes, at: int, width: int = WIDTH, k: int = KMER) -> bytes:
    """What an anchor is sorted by: ``width`` bytes from it on, then ``width - k`` bytes before it, backwards."""
    ahead, back = raw[at : at + width], raw[max(0, at - width + k) : at][::-1]
    return ahead.ljust(width, PAD) + back.ljust(width - k, PAD)


def shared_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, of which ``start`` bytes are known."""
    n = min(len(a), len(b))
    while start + 64 <= n and a[start : start + 64] == b[start : start + 64]:
        start += 64
    while start + 8 <= n and a[start : start + 8] == b[start : start + 8]:
        start += 8
    while start < n and a[start] == b[start]:
        start += 1
    return start


def front_code(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Prefix lengths shared with the string before, lengths of the rests, and the rests."""
    lcp, rest, before = np.zeros(len(strings), np.uint16), [], b""
    for i, s in enumerate(strings):
        n = shared_prefix(before, s)
        lcp[i] = n
        rest.append(s[n:])
        before = s
    return lcp, np.array([len(x) for x in rest], np.uint16), b"".join(rest)


class Run:
    """A front-coded run, decoded one string at a time."""

    def __init__(self, lcp: np.ndarray, lengths: np.ndarray, rest: bytes):
        self.lcp, self.ends, self.rest = lcp.tolist(), np.cumsum(lengths.astype(np.int64)).tolist(), rest
        self.i, self.string = -1, b""

    def step(self) -> int | None:
        """Go to the next string; its prefix shared with the last one, None at the end."""
        self.i += 1
        if self.i >= len(self.lcp):
            return None
        n = self.lcp[self.i]
        self.string = self.string[:n] + self.rest[self.ends[self.i - 1] if self.i else 0 : self.ends[self.i]]
        return n


def merge(runs: list[Run]) -> Iterator[tuple[int, int, int, bytes]]:
    """Loser tree over sorted runs: (run, its index, prefix shared with the string put out before, string)."""
    size = 1
    while size < max(1, len(runs)):
        size *= 2
    prefix: list[int] = []  # of each run's string with the last one put out; -1: the run is over
    for run in runs:
        prefix.append(-1 if run.step() is None else 0)
    prefix += [-1] * (size - len(runs))
    losers = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's prefix becomes the one shared with the winner, if that is longer."""
        x, y = prefix[a], prefix[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return a, b
        s, t = runs[a].string, runs[b].string
        n = shared_prefix(s, t, x)
        if n == len(t) or (n < len(s) and s[n] > t[n]):
            if n == len(t) == len(s):
                prefix[b] = n
                return a, b
            prefix[a] = n
            return b, a
        prefix[b] = n
        return a, b

    def fill(node: int) -> int:
        if node >= size:
            return node - size
        winner, losers[node] = play(fill(2 * node), fill(2 * node + 1))
        return winner

    best = fill(1) if size > 1 else 0
    while runs and prefix[best] >= 0:
        run = runs[best]
        yield best, run.i, prefix[best], run.string
        n = run.step()
        prefix[best] = -1 if n is None else n
        node = (best + size) // 2
        while node:
            best, losers[node] = play(best, losers[node])
            node //= 2


def spans_of_group(strings: list[bytes], lcps: list[int], many: list[bool], width: int = WIDTH, k: int = KMER) -> list[tuple[int, int] | None]:
    """For distinct sorted contexts with one anchor string: how far left and right of the anchor repeats reach.

    ``lcps[i]`` is the prefix shared by i - 1 and i; ``many[i]``: the context occurs more than once.
    None where no string of ``width`` bytes over this anchor occurs elsewhere.
    """
    m = len(strings)
    own_right = [width - s[:width].count(PAD) for s in strings]
    own_left = [width - k - s[width:].count(PAD) for s in strings]
    left, right = [-1] * m, [-1] * m
    for i in range(m):
        if many[i] and own_left[i] + own_right[i] >= width:
            left[i], right[i] = own_left[i], own_right[i]
    if m > 1:
        bits = 8 * (width - k)
        lefts = [int.from_bytes(s[width:], "big") for s in strings]

        def meet(a: int, b: int, depth: int) -> None:
            n = (bits - (lefts[a] ^ lefts[b]).bit_length()) // 8
            for x in (a, b):
                lx, rx = min(n, own_left[x]), min(depth, own_right[x])
                if lx + rx >= width:
                    left[x], right[x] = max(left[x], lx), max(right[x], rx)

        def join(a: list, b: list, depth: int) -> list:
            if len(a) < len(b):
                a, b = b, a
            for item in b:
                at = bisect_left(a, item)
                if at:
                    meet(item[1], a[at - 1][1], depth)
                if at < len(a):
                    meet(item[1], a[at][1], depth)
                a.insert(at, item)
            return a

        stack: list[tuple[int, list]] = []  # (depth of the edge to what follows, members)
        current = [(lefts[0], 0)]
        for i in range(1, m):
            depth = min(lcps[i], width)
            while stack and stack[-1][0] > depth:
                d, members = stack.pop()
                current = join(members, current, d)
            if stack and stack[-1][0] == depth:
                _, members = stack.pop()
                current = join(members, current, depth)
            stack.append((depth, current))
            current = [(lefts[i], i)]
        while stack:
            d, members = stack.pop()
            current = join(members, current, d)
    return [(left[i], right[i]) if left[i] >= 0 else None for i in range(m)]


def _packed(part: np.ndarray, **cols: np.ndarray) -> dict[str, list]:
    """One row for each part: ``part`` and its slice of every column, as bytes."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1)) if len(part) else np.zeros(1, np.int64)
    both = list(zip(edges, edges[1:], strict=False))
    return {"part": [int(part[lo]) for lo, _ in both]} | {k: [v[order][lo:hi].tobytes() for lo, hi in both] for k, v in cols.items()}


def _packed_batch(rows: dict[str, list]) -> pa.RecordBatch:
    kinds = [pa.int64(), *[pa.binary()] * (len(rows) - 1)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows.values(), kinds, strict=True)], names=list(rows))


def _joined(parts, dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, dtype) for x in parts]) if len(parts) else np.zeros(0, dtype)


def _spans_by_part(spans: np.ndarray, buckets: int) -> pd.DataFrame:
    """Rows d1, d2, from, to, packed by document."""
    key = spans[:, 0].view(np.uint64) * np.uint64(_BASE) ^ spans[:, 1].view(np.uint64)
    key = (key ^ (key >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return pd.DataFrame(_packed(_bucket(key, buckets), spans=spans))


def _by_document(parts: DataFrame) -> DataFrame:
    """``d1, d2, spans`` of packed spans: one row a document."""

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _joined(pdf["spans"].to_list(), np.int64).reshape(-1, 4)
        x = x[np.lexsort((x[:, 2], x[:, 1], x[:, 0]))]
        edges = np.append(np.flatnonzero(np.concatenate([[True], np.any(x[1:, :2] != x[:-1, :2], axis=1)])), len(x))
        both = list(zip(edges, edges[1:], strict=False))
        return pd.DataFrame({"d1": x[edges[:-1], 0], "d2": x[edges[:-1], 1], "spans": [union_spans([x[lo:hi, 2:].tobytes()]).tobytes() for lo, hi in both]})

    return parts.groupBy("part").applyInPandas(gather, "d1 long, d2 long, spans binary")


def _repeated(docs: DataFrame, buckets: int) -> DataFrame:
    """``d1, d2, places, hot``: of each document, the anchors whose hash occurs more than once (parts, little-endian uint32).

    ``hot`` are those with ``HOT`` occurrences or more, ``places`` the others.
    """
    limit = HOT

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, ps, owner, keys, held = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            h, p, o = np.concatenate(hs), np.concatenate(ps), np.concatenate(owner)
            b = _bucket(h, buckets)
            order = np.lexsort((h, b))
            h, p, o, b = h[order], p[order].astype(np.uint32), o[order], b[order]
            edges = np.flatnonzero(np.diff(b, prepend=-1, append=-1))
            d = np.array(keys, np.int64).reshape(-1, 2)
            rows = []
            for lo, hi in zip(edges, edges[1:], strict=False):
                used, local = np.unique(o[lo:hi], return_inverse=True)
                rows.append((int(b[lo]), h[lo:hi].tobytes(), p[lo:hi].tobytes(), local.astype(np.uint32).tobytes(), d[used].tobytes()))
            for x in (hs, ps, owner, keys):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), *[pa.binary()] * 4), strict=True)], names=["bucket", "h", "p", "o", "d"])

        for batch in batches:
            for d1, d2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = np.frombuffer(memoryview(text.as_buffer() or b""), np.uint8)
                if len(raw) < WIDTH:
                    continue
                h, p = anchors(raw)
                hs.append(h)
                ps.append(p)
                owner.append(np.full(len(h), len(keys), np.int64))
                keys.append((d1, d2))
                held += len(h)
                if held > 1_000_000:
                    yield flush()
                    held = 0
        if held:
            yield flush()

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["h"]])
        p = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["p"]])
        d = [np.frombuffer(x, np.int64).reshape(-1, 2) for x in pdf["d"]]
        start = np.cumsum([0, *map(len, d)])
        o = np.concatenate([np.frombuffer(x, np.uint32).astype(np.int64) + s for x, s in zip(pdf["o"], start, strict=False)])
        d = np.concatenate(d)
        order = np.argsort(h, kind="stable")
        hs = h[order]
        same = np.zeros(len(hs) + 1, bool)
        same[1:-1] = hs[1:] == hs[:-1]
        starts = np.flatnonzero(~same[:-1])
        times = np.repeat(np.diff(np.append(starts, len(hs))), np.diff(np.append(starts, len(hs))))
        at, hot = order[times > 1], times[times > 1] >= limit
        if not len(at):
            return pd.DataFrame({"d1": [], "d2": [], "places": [], "hot": []})
        by = np.argsort(o[at], kind="stable")
        at, hot = at[by], hot[by]
        edges = np.flatnonzero(np.diff(o[at], prepend=-1, append=-1))
        who = o[at][edges[:-1]]
        both = list(zip(edges, edges[1:], strict=False))
        return pd.DataFrame({
            "d1": d[who, 0], "d2": d[who, 1],
            "places": [p[at[lo:hi][~hot[lo:hi]]].tobytes() for lo, hi in both], "hot": [p[at[lo:hi][hot[lo:hi]]].tobytes() for lo, hi in both],
        })

    runs = docs.select("d1", "d2", "text").mapInArrow(emit, "bucket long, h binary, p binary, o binary, d binary")
    return runs.groupBy("bucket").applyInPandas(count, "d1 long, d2 long, places binary, hot binary").groupBy("d1", "d2").agg(F.collect_list("places").alias("places"), F.collect_list("hot").alias("hot"))


def _spans(marked: DataFrame, buckets: int) -> DataFrame:
    """Packed repeated spans around the anchors of ``d1, d2, text, places``."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, int, int, int]] = []

        def flush() -> pa.RecordBatch:
            held.sort()
            rows, lo = [], 0
            while lo < len(held):
                hi = lo
                strings, counts, refs = [], [], []
                while hi < len(held) and held[hi][0] == held[lo][0]:
                    if not strings or strings[-1] != held[hi][1]:
                        strings.append(held[hi][1])
                        counts.append(0)
                    counts[-1] += 1
                    refs.append(held[hi][2:])
                    hi += 1
                lcp, lengths, rest = front_code(strings)
                rows.append((held[lo][0], lcp.tobytes(), lengths.tobytes(), rest, np.array(counts, np.uint32).tobytes(), np.array(refs, np.int64).tobytes()))
                lo = hi
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), *[pa.binary()] * 5), strict=True)], names=["bucket", "lcp", "lengths", "rest", "counts", "refs"])

        for batch in batches:
            for d1, d2, text, places in zip(*(batch.column(i) for i in range(4)), strict=True):
                d1, d2, raw = d1.as_py(), d2.as_py(), text.as_buffer().to_pybytes()
                at = np.unique(np.frombuffer(b"".join(places.as_py()), np.uint32))
                for p in at.tolist():
                    c = context(raw, p)
                    key = int.from_bytes(hashlib.blake2b(c[:KMER], digest_size=6).digest(), "big") % buckets
                    held.append((key, c, d1, d2, p))
                    if len(held) >= FLUSH:
                        yield flush()
        if held:
            yield flush()

    def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
        runs = [Run(np.frombuffer(a, np.uint16), np.frombuffer(b, np.uint16), c) for a, b, c in zip(pdf["lcp"], pdf["lengths"], pdf["rest"], strict=True)]
        starts = [np.cumsum(np.concatenate([[0], np.frombuffer(c, np.uint32)])).tolist() for c in pdf["counts"]]
        refs = [np.frombuffer(x, np.int64).reshape(-1, 3) for x in pdf["refs"]]
        out = []
        strings: list[bytes] = []
        lcps: list[int] = []
        owners: list[list[tuple[int, int]]] = []

        def close() -> None:
            many = [sum(starts[r][i + 1] - starts[r][i] for r, i in o) > 1 for o in owners]
            if len(strings) == 1 and not many[0]:
                return
            for o, span in zip(owners, spans_of_group(strings, lcps, many), strict=True):
                if span:
                    for r, i in o:
                        ref = refs[r][starts[r][i] : starts[r][i + 1]]
                        out.append(np.column_stack([ref[:, :2], ref[:, 2] - span[0], ref[:, 2] + span[1]]))

        for run, i, lcp, s in merge(runs):
            if strings and lcp == len(s) == len(strings[-1]):
                owners[-1].append((run, i))
                continue
            if strings and lcp < KMER:
                close()
                strings, lcps, owners = [], [], []
            strings.append(s)
            lcps.append(lcp)
            owners.append([(run, i)])
        if strings:
            close()
        return _spans_by_part(np.concatenate(out) if out else np.zeros((0, 4), np.int64), max(1, buckets // 2))

    runs = marked.select("d1", "d2", "text", "places", "hot", "no_id").mapInArrow(emit, "bucket long, lcp binary, lengths binary, rest binary, counts binary, refs binary")
    return runs.groupBy("bucket").applyInPandas(resolve, "part long, spans binary")


def windows(contexts: list[bytes], width: int = WIDTH, k: int = KMER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (rows of two words) of all windows over each context's anchor, the context's index, and how far left of the anchor they start.

    The hash takes in that offset: one window may hold several anchors, which must not meet each other.
    """
    side = width - k
    raw = np.frombuffer(b"".join(c[: width - 1 - len(c) : -1] + c[:width] for c in contexts), np.uint8).reshape(len(contexts), side + width)
    d = side - np.arange(side + 1)
    words = []
    for table in (_TABLE, _TABLE2):
        sums = np.zeros((len(contexts), side + width + 1), np.uint64)
        np.cumsum(table[raw] * _P[: side + width], axis=1, out=sums[:, 1:])
        h = (sums[:, width:] - sums[:, : side + 1]) * _I[: side + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        words.append(h + d.astype(np.uint64) * np.uint64(_BASE))
    lo, hi = reach(contexts, width, k)
    whole = (d[None, :] >= lo[:, None]) & (d[None, :] <= hi[:, None])
    which, column = np.nonzero(whole)
    return np.column_stack([w[whole] for w in words]), which, d[column]


def _order(x: np.ndarray, *then: np.ndarray) -> np.ndarray:
    """An order of rows of two words, ties by further columns."""
    return np.lexsort((*then[::-1], x[:, 1], x[:, 0]))


def _firsts(x: np.ndarray) -> np.ndarray:
    """Where a new row starts, in sorted rows of two words."""
    return np.flatnonzero(np.concatenate([[True], np.any(x[1:] != x[:-1], axis=1)])) if len(x) else np.zeros(0, np.int64)


def _find(names: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Places of rows of two words among sorted ones; all of them are there."""
    at = np.searchsorted(names[:, 0], asked[:, 0])
    while (off := names[at, 1] != asked[:, 1]).any():
        at[off] += 1
    return at


def reach(contexts: list[bytes], width: int = WIDTH, k: int = KMER) -> tuple[np.ndarray, np.ndarray]:
    """Least and most bytes left of the anchor at which a window lies within the text (none if least > most)."""
    right = np.array([width - c[:width].count(PAD) for c in contexts])
    left = np.array([width - k - c[width:].count(PAD) for c in contexts])
    return width - right, left


def _hot_spans(marked: DataFrame, buckets: int) -> DataFrame:
    """Packed repeated spans around the anchors of ``d1, d2, text, hot``."""
    parts = max(1, buckets // 2)
    kept = marked.where(F.exists("hot", lambda x: F.length(x) > 0)).select("d1", "d2", "text", "places", "hot", "no_id")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
        """Distinct contexts, their names, and the occurrences (d1, d2, place) with their context's index; so many at a time."""
        held: dict[bytes, int] = {}
        refs: list[tuple[int, int, int, int]] = []

        def out() -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
            names = np.frombuffer(b"".join(hashlib.blake2b(c, digest_size=16).digest() for c in held), np.uint64).reshape(-1, 2)
            x = np.array(refs, np.int64)
            return list(held), names, x[:, :3], x[:, 3]

        for batch in batches:
            for d1, d2, text, _, places in zip(*(batch.column(i) for i in range(5)), strict=True):
                d1, d2, raw = d1.as_py(), d2.as_py(), text.as_buffer().to_pybytes()
                for at in np.unique(np.frombuffer(b"".join(places.as_py()), np.uint32)).tolist():
                    refs.append((d1, d2, at, held.setdefault(context(raw, at), len(held))))
                    if len(refs) >= FLUSH:
                        yield out()
                        held, refs = {}, []
        if refs:
            yield out()

    def by_name(c: np.ndarray) -> np.ndarray:
        return _bucket(c[:, 0], parts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One context of each window to where equal windows meet; windows that repeat here straight to their contexts."""
        anchors(np.zeros(WIDTH, np.uint8))  # fills the powers
        for found, names, _, _ in contexts(batches):
            for lo in range(0, len(found), 2000):
                h, which, d = windows(found[lo : lo + 2000])
                order = _order(h)
                h, c, d = h[order], names[lo + which[order]], d[order].astype(np.uint16)
                starts = _firsts(h)
                sizes = np.diff(np.append(starts, len(h)))
                yield _packed_batch(_packed(_bucket(h[starts, 0], parts), h=h[starts], c=c[starts], lo=d[starts], hi=d[starts]))
                twice = np.repeat(sizes > 1, sizes)
                c, least, most = _extremes(c[twice], d[twice], d[twice])
                yield _packed_batch(_packed(by_name(c), h=np.zeros((len(c), 0), np.uint64), c=c, lo=least, hi=most))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf[pdf["h"].str.len() == 0]
        pdf = pdf[pdf["h"].str.len() > 0]
        h, c, d = (_joined(pdf[n].to_list(), t) for n, t in (("h", np.uint64), ("c", np.uint64), ("lo", np.uint16)))
        h, c = h.reshape(-1, 2), c.reshape(-1, 2)
        order = np.lexsort((c[:, 1], c[:, 0], h[:, 1], h[:, 0]))
        h, c, d = h[order], c[order], d[order]
        starts = _firsts(h)
        ends = np.append(starts[1:], len(h)) - 1 if len(h) else starts
        keep = np.repeat(np.any(c[starts] != c[ends], axis=1), ends - starts + 1)  # two contexts at least
        told = _joined(known["c"].to_list(), np.uint64).reshape(-1, 2)
        lo, hi = (np.concatenate([d[keep], _joined(known[n].to_list(), np.uint16)]) for n in ("lo", "hi"))
        c, lo, hi = _extremes(np.concatenate([c[keep], told]), lo, hi)
        return pd.DataFrame(_packed(by_name(c), c=c, lo=lo, hi=hi))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, names, _, which in contexts(batches):
            least, most = reach(found)
            times = np.bincount(which, minlength=len(found)).astype(np.int64)
            yield _packed_batch(_packed(by_name(names), c=names, times=times, least=least.astype(np.int64), most=most.astype(np.int64)))

    def judge(told: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        """First and last repeated window of every context: all, if it occurs more than once."""
        c = _joined(told["c"].to_list(), np.uint64).reshape(-1, 2)
        times, least, most = (_joined(told[n].to_list(), np.int64) for n in ("times", "least", "most"))
        if not len(c):
            return pd.DataFrame({"part": [], "c": [], "first": [], "last": []})
        order = _order(c)
        starts = _firsts(c[order])
        names, many = c[order][starts], np.add.reduceat(times[order], starts) > 1
        first, last = np.full(len(names), WIDTH, np.int64), np.full(len(names), -1, np.int64)
        mc, lo, hi = _extremes(_joined(met["c"].to_list(), np.uint64).reshape(-1, 2), _joined(met["lo"].to_list(), np.uint16), _joined(met["hi"].to_list(), np.uint16))
        place = _find(names, mc)
        first[place], last[place] = lo, hi
        first[many], last[many] = least[order][starts][many], most[order][starts][many]
        return pd.DataFrame({"part": [int(told["part"].iloc[0])], "c": [names.tobytes()], "first": [first.tobytes()], "last": [last.tobytes()]})

    def refer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, names, refs, which in contexts(batches):
            yield _packed_batch(_packed(by_name(names[which]), name=names[which], refs=refs))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.zeros((0, 4), np.int64)]
            for name, refs, c, first, last in zip(*(b.column(i) for i in range(5)), strict=True):
                x, c = np.frombuffer(refs.as_py(), np.int64).reshape(-1, 3), np.frombuffer(c.as_py(), np.uint64).reshape(-1, 2)
                at = _find(c, np.frombuffer(name.as_py(), np.uint64).reshape(-1, 2))
                lo, hi = np.frombuffer(first.as_py(), np.int64)[at], np.frombuffer(last.as_py(), np.int64)[at]
                found.append(np.column_stack([x[:, :2], x[:, 2] - hi, x[:, 2] - lo + WIDTH])[lo <= hi])
            rows = _spans_by_part(np.concatenate(found), parts)
            yield pa.RecordBatch.from_pandas(rows, schema=pa.schema([("part", pa.int64()), ("spans", pa.binary())]), preserve_index=False)

    met = kept.mapInArrow(deal, "part long, h binary, c binary, lo binary, hi binary").groupBy("part").applyInPandas(meet, "part long, c binary, lo binary, hi binary")
    told = kept.mapInArrow(tell, "part long, c binary, times binary, least binary, most binary")
    verdict = told.groupBy("part").cogroup(met.groupBy("part")).applyInPandas(judge, "part long, c binary, first binary, last binary")
    # One row of verdicts for a part meets a row of occurrences for each run: the occurrences of a context are never in one place.
    refs = kept.mapInArrow(refer, "part long, name binary, refs binary")
    return refs.join(verdict, "part").select("name", "refs", "c", "first", "last").mapInArrow(apply, "part long, spans binary")


def _extremes(c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each name once, with its least lo and its greatest hi."""
    if not len(c):
        return c, lo, hi
    order = _order(c)
    c, lo, hi = c[order], lo[order], hi[order]
    starts = _firsts(c)
    return c[starts], np.minimum.reduceat(lo, starts), np.maximum.reduceat(hi, starts)


def union_spans(parts: list[bytes]) -> np.ndarray:
    """Maximal spans (rows: from, to) of little-endian int64 pairs; touching ones are joined."""
    x = np.frombuffer(b"".join(parts), np.int64).reshape(-1, 2)
    if not len(x):
        return x
    x = x[np.argsort(x[:, 0], kind="stable")]
    far = np.maximum.accumulate(x[:, 1])
    new = np.flatnonzero(np.concatenate([[True], x[1:, 0] > far[:-1]]))
    return np.column_stack([x[new, 0], far[np.append(new[1:] - 1, len(x) - 1)]])


def repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """Each row of ``docs`` (doc_id, text): ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept``, binary).

    Null text is the empty text: nothing to remove.  Rows repeated whole are repeats of each other
    (all their windows occur elsewhere).  Texts shorter than 400 bytes keep everything; very long ones
    are hashed in steps.  Kept bytes need not be whole characters, so ``kept`` is binary.  Other
    columns are not read; an empty table gives no rows.
    """
    # Tasks send a row of packed arrays to each bucket: twice the partitions keep groups small and rows few.
    buckets = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    # Both joins below take the same columns, so that the texts are exchanged once.
    d = d.select("text", F.coalesce("doc_id", F.lit(NO_ID)).alias("d1"), F.xxhash64("text").alias("d2"), F.col("doc_id").isNull().alias("no_id"))
    anchored = _repeated(d, buckets)
    marked = d.join(anchored, ["d1", "d2"])
    spans = _by_document(_spans(marked, buckets).unionByName(_hot_spans(marked, buckets)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, parts in zip(batch.column(1), batch.column(2), strict=True):
                raw = text.as_buffer().to_pybytes() if len(text.as_py()) else b""
                gone = np.frombuffer(parts.as_py() or b"", np.int64).reshape(-1, 2)
                edges = [0, *gone.reshape(-1).tolist(), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), *([kept] if keep_text else [])))
            cols = list(zip(*rows, strict=True)) or [()] * (4 + keep_text)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.binary()] if keep_text else [])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], names=names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    names = [c.split()[0] for c in schema.split(", ")]
    return d.join(spans, ["d1", "d2"], "left").select(F.when(~F.col("no_id"), F.col("d1")).alias("doc_id"), "text", "spans").mapInArrow(cut, schema)


def oracle_sql() -> str:
    """DuckDB: digests of all windows of the hexadecimal text, those that occur twice, and their union."""
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
w AS MATERIALIZED (SELECT doc_id, i, md5_number(substr(hx, 2 * i + 1, {2 * WIDTH})) AS m FROM (SELECT doc_id, hx, unnest(range(0, greatest(n - {WIDTH} + 1, 0))) AS i FROM d)),
hit AS (SELECT doc_id, i FROM w SEMI JOIN (SELECT m FROM w GROUP BY m HAVING count(*) > 1) r ON r.m = w.m),
e AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM hit),
g AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + {WIDTH} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM e),
sp AS MATERIALIZED (SELECT doc_id, g, min(i) AS a, max(i) + {WIDTH} AS b FROM g GROUP BY doc_id, g),
pieces AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f, a AS t FROM sp
  UNION ALL SELECT d.doc_id, coalesce(max(sp.b), 0), max(d.n) FROM d LEFT JOIN sp ON sp.doc_id = d.doc_id GROUP BY d.doc_id),
kept AS (SELECT p.doc_id, string_agg(substr(d.hx, 2 * f + 1, 2 * (t - f)), '' ORDER BY f) AS hx FROM pieces p JOIN d ON d.doc_id = p.doc_id GROUP BY p.doc_id),
sums AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM sp GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(kept.hx)) AS kept_sha256
FROM d JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN sums ON sums.doc_id = d.doc_id"""
