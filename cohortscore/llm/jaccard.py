"""Exact Jaccard join of word-shingle sets as a metric-space join.

Jaccard distance is a metric, but of most pairs it is exactly 1, and then a window around a Voronoi
cell holds everything.  So the space is first cut where distances are 1: two sets within ``EPS`` share
one of their first tokens in any common order (a quarter of each set, rare tokens first), and the sets
that share one form a root region.  Stars of tokens, never pairs, say which.

A region of more than ``CHUNK`` members is split into Voronoi cells around ``FAN`` of its members, its
pivots.  Every member goes to the cell of its nearest pivot, and as a guest to those cells before its
own in which it can have a close home member: its distance from the pivot is at most the cell's radius
plus ``EPS``, and at most 2 ``EPS`` more than the distance from its own pivot.  Cells are regions and
are split again, until they are small.  A cell that holds nearly all of its region (all distances
alike) is joined in pairs of blocks instead.  Members known to be connected are never compared, and of
its links a task puts out a spanning forest only.  Links are folded into components by alternating
stars.

Sets equal to each other are one class from the start: a class is a 128-bit hash of the set, a shingle
a 64-bit hash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, stored

WORDS = 5
NUM, DEN = 75, 100  # linked when DEN * intersection >= NUM * union
EPS = 1 - NUM / DEN
CHUNK = 1024  # members, and
CHUNK_TOKENS = 2_000_000  # tokens of a region that is joined in one piece
FAN = 16  # pivots of a region
SHRINK = 0.75  # a cell with a larger share of its region's members is not split again
HEAVY = 200_000  # most tokens that are ordered by their count: 6.4 MB are broadcast
HOT = 4096  # from this count on, tokens have their region named by the census
SEGMENT = 1 << 20
HELD = 500_000  # tokens in a task's memory at once
SENT = 8 << 20  # bytes of sets in a batch that leaves Python
SHORT = 6  # first bytes of a class that stand for it where tokens meet
BITS = 16  # of the bitmap for each document that is wanted, and
MOST_BITS = 1 << 26  # in all
LINK, MOVE = range(2)
MEMBER, PIVOT = range(2)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLE = np.random.default_rng(23).integers(0, 1 << 64, 256, np.uint64)
_BASE = 0xD6E8FEB86659FD93


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_LONG = 4096  # longer words are hashed one by one
_P = _I = np.zeros(0, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def _words(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words, from differences of one running sum."""
    global _P, _I
    if len(_P) < len(b):
        n = max(2 * SEGMENT, len(b))
        _P, _I = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
    edge = np.flatnonzero(np.diff((~_SPACE[b]).view(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_TABLE[b] * _P[: len(b)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * _I[starts]
    for i in np.flatnonzero(ends - starts > _LONG):
        h[i] = int.from_bytes(hashlib.blake2b(b[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return starts, _mix(h)


def _combined(w: np.ndarray, k: int) -> np.ndarray:
    s = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        s = s * np.uint64(0xA0761D6478BD642F) + w[j : len(w) - k + 1 + j]
        s ^= s >> np.uint64(31)
    return _mix(s)


def _long_text(b: np.ndarray) -> np.ndarray:
    """Word hashes of a long text, in segments that end at a blank (or inside no word)."""
    parts, at = [], 0
    while at < len(b):
        end = min(len(b), at + SEGMENT)
        while end < len(b) and not _SPACE[b[end]]:
            step = np.flatnonzero(_SPACE[b[end : end + SEGMENT]])
            end = end + int(step[0]) if len(step) else min(len(b), end + SEGMENT)
        if end - at > 2 * SEGMENT:  # one word reaches beyond all segments
            head = np.flatnonzero(_SPACE[b[at : at + SEGMENT]])
            cut = at + int(head[-1]) + 1 if len(head) else at
            if cut > at:
                end = cut
            else:
                parts.append(_mix(np.array([int.from_bytes(hashlib.blake2b(b[at:end].tobytes(), digest_size=8).digest(), "little")], np.uint64)))
                at = end
                continue
        parts.append(_words(b[at:end])[1])
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingle_sets(raws: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's 5-word shingles; of the whole sequence, if it has fewer words.

    Short texts are hashed together, a megabyte at a time.
    """
    out: list[np.ndarray] = []
    lo = 0
    while lo < len(raws):
        hi, size = lo, 0
        while hi < len(raws) and (hi == lo or size + len(raws[hi]) < SEGMENT):
            size += len(raws[hi]) + 1
            hi += 1
        group = raws[lo:hi]
        lo = hi
        if len(group) == 1 and len(group[0]) > SEGMENT:
            w = _long_text(_LOWER[np.frombuffer(group[0], np.uint8)])
            edges = [0, len(w)]
        else:
            starts, w = _words(_LOWER[np.frombuffer(b" ".join(group), np.uint8)])
            edges = np.searchsorted(starts, np.cumsum([0] + [len(x) + 1 for x in group])).tolist()
        s = _combined(w, WORDS) if len(w) >= WORDS else w
        for a, b in zip(edges, edges[1:], strict=False):
            n = b - a
            if n >= WORDS:
                one = np.sort(s[a : b - WORDS + 1])
                out.append(one[np.concatenate([[True], one[1:] != one[:-1]])])
            else:
                out.append(_combined(w[a:b], n) if n else np.zeros(0, np.uint64))
    return out


def shingles(raw: bytes) -> np.ndarray:
    return shingle_sets([raw])[0]


def _sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The shingle sets of a column of texts, in order, some at a time."""
    for lo in range(0, len(column), 512):
        yield from shingle_sets([_bytes(x) for x in column.slice(lo, 512)])


def _class(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _bytes(text: pa.Scalar) -> bytes:
    buffer = text.as_buffer() if text.is_valid else None
    return buffer.to_pybytes() if buffer else b""


def extra(n: int) -> int:
    """Tokens beyond the shortest prefix that must meet."""
    return max(1, n // 10)


def prefix_length(n: int) -> int:
    """Of their first tokens of this number, two close sets share ``extra`` of the smaller one at least."""
    return min(n, n - -(-NUM * n // DEN) + extra(n))


def least_shared(n):
    """Fewest first tokens that a set of n shares with any close set (which has 3/4 n tokens at least)."""
    return F.greatest(F.lit(1), F.floor(F.floor((n * NUM + DEN - 1) / DEN) / 10)).cast("long")


def _census(docs: DataFrame) -> DataFrame:
    """Rows of documents (doc_id, th, n, cls), and of tokens that are frequent in a task (token, its count in n, a class that holds it in cls)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names, size = [], [], 0
        often: dict[int, tuple[int, bytes]] = {}

        def count() -> None:
            flat, owner = np.concatenate(held), np.repeat(np.arange(len(held)), [len(s) for s in held])
            order = np.argsort(flat, kind="stable")
            t, first, n = np.unique(flat[order], return_index=True, return_counts=True)
            for k, at, v in zip(t[n >= 8].view(np.int64).tolist(), first[n >= 8].tolist(), n[n >= 8].tolist(), strict=True):
                before, name = often.get(k, (0, names[owner[order[at]]]))
                often[k] = before + v, name
            if len(often) > HEAVY:
                for k in sorted(often, key=lambda x: (-often[x][0], x))[HEAVY // 2 :]:
                    del often[k]
            held.clear()
            names.clear()

        for b in batches:
            ns, cs = [], []
            for s in _sets(b.column(1)):
                ns.append(len(s))
                cs.append(_class(s) if len(s) else b"")
                if len(s):
                    held.append(s)
                    names.append(cs[-1])
                    size += len(s)
                    if size > HELD:
                        count()
                        size = 0
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(ns, pa.int64()), pa.array(cs, pa.binary()), pa.nulls(len(ns), pa.int64())], names=columns)
        if held:
            count()
        if often:
            k = len(often)
            n, c = zip(*often.values(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(n, pa.int64()), pa.array(c, pa.binary()), pa.array(list(often), pa.int64())], names=columns)

    columns = ["doc_id", "th", "n", "cls", "token"]
    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(run, "doc_id long, th long, n long, cls binary, token long")


def _planes(x: np.ndarray) -> bytes:
    """The high bytes of all numbers, then the next ones: those of sorted numbers in a narrow range hardly need room when compressed."""
    return np.ascontiguousarray(x.astype(">u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(">u8").reshape(-1).astype(np.uint64)


def _short(names: bytes, size: int) -> np.ndarray:
    """Names of ``size`` bytes as numbers in the order of their bytes."""
    wide = np.zeros((len(names) // size, 8), np.uint8)
    wide[:, 8 - size :] = np.frombuffer(names, np.uint8).reshape(-1, size)
    return wide.view(">u8").reshape(-1).astype(np.uint64)


def _pairs(region: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows of two columns of short names, and how often each comes."""
    order = np.lexsort((member, region))
    region, member = region[order], member[order]
    first = np.flatnonzero(np.concatenate([[True], (region[1:] != region[:-1]) | (member[1:] != member[:-1])]))
    return region[first], member[first], np.diff(np.append(first, len(region))).astype(np.int64)


def _stars(docs: DataFrame, heavy: list[tuple[int, int, bytes]], buckets: int) -> DataFrame:
    """``region, short, shared``: the sets that share first tokens, and how many.

    ``heavy``: tokens, their counts and a class that holds each, most frequent first.  A hot token's
    region is named by that class, so its occurrences need not meet; that of any other token by the
    smallest class that has it among its first tokens.  All names here are the first ``SHORT`` bytes
    of a class: classes that share them are one, with the places and tokens of all of them, so no place
    is lost, and bytes that meet are about half.
    """
    tokens_ = np.array([t for t, _, _ in heavy], np.int64).view(np.uint64)
    order, size = np.argsort(tokens_), SHORT
    names = np.frombuffer(b"".join(c[:size] for _, _, c in heavy), np.uint8).reshape(-1, size)[order]
    hot_ = np.array([n >= HOT for _, n, _ in heavy], bool)[order]
    shared = docs.sparkSession.sparkContext.broadcast((tokens_[order], (len(order) - order).astype(np.uint64), names, hot_))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, place, name, hot = shared.value
        tokens, owner, classes, seen, held, sent = [], [], [], set(), 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal sent
            t, o = np.concatenate(tokens), np.concatenate(owner)
            c = np.frombuffer(b"".join(x[:size] for x in classes), np.uint8).reshape(-1, size)
            rows = []
            if len(known):
                at = np.minimum(np.searchsorted(known, t), len(known) - 1)
                direct = (known[at] == t) & hot[at]
                if direct.any():
                    for lo in range(0, int(direct.sum()), 1 << 16):
                        part = np.flatnonzero(direct)[lo : lo + (1 << 16)]
                        sent += 1
                        rows.append((int(_mix(t[part[:1]] + np.uint64(sent))[0] % np.uint64(buckets)), None, c[o[part]].tobytes(), name[at[part]].tobytes()))
                    t, o = t[~direct], o[~direct]
            t = _mix(t)  # one to one, and even: first tokens are small
            order_ = np.argsort(t)
            t, o = t[order_], o[order_]
            b = ((t >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            edges = np.flatnonzero(np.diff(b, prepend=-1, append=-1)) if len(b) else []
            rows += [(int(b[lo]), _planes(t[lo:hi]), c[o[lo:hi]].tobytes(), None) for lo, hi in zip(edges, edges[1:], strict=False)]
            for x in (tokens, owner, classes):
                x.clear()
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "t", "c", "region"])

        for batch in batches:
            for s in _sets(batch.column(0)):
                if not len(s) or (cls := _class(s)) in seen:
                    continue
                if len(seen) < 200_000:  # saves work only: what comes twice counts once below
                    seen.add(cls)
                p = prefix_length(len(s))
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    often = known[at] == s
                    s = np.concatenate([s[~often], s[often][np.argsort(place[at[often]])]])
                tokens.append(s[:p])
                owner.append(np.full(p, len(classes), np.int64))
                classes.append(cls)
                held += p
                if held > HELD:
                    yield flush()
                    held = 0
        if held:
            yield flush()

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        met = pdf["region"].isna()
        straight = pdf[~met]
        regions, members = [_short(x, size) for x in straight["region"]], [_short(x, size) for x in straight["c"]]
        pdf = pdf[met]
        if len(pdf):
            t, c = np.concatenate([_numbers(x) for x in pdf["t"]]), np.concatenate([_short(x, size) for x in pdf["c"]])
            order_ = np.lexsort((c, t))
            t, c = t[order_], c[order_]
            first = np.ones(len(t), bool)  # a set's copies of a token count once
            first[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
            t, c = t[first], c[first]
            starts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(starts, len(t)))
            keep = np.repeat(sizes > 1, sizes)
            regions.append(np.repeat(c[starts], sizes)[keep])
            members.append(c[keep])
        if not sum(map(len, regions)):
            return pd.DataFrame({"region": [], "short": [], "shared": []}).astype({"shared": "int64"})
        r, c, n = _pairs(np.concatenate(regions), np.concatenate(members))
        spelled = lambda short: [x.to_bytes(size, "big") for x in short.tolist()]
        return pd.DataFrame({"region": spelled(r), "short": spelled(c), "shared": n})

    runs = docs.select("text").mapInArrow(emit, "bucket long, t binary, c binary, region binary")
    return runs.groupBy("bucket").applyInPandas(meet, "region binary, short binary, shared long").groupBy("region", "short").agg(F.sum("shared").alias("shared"))


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b

    def roots(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.up))])


def _forest(links: list[tuple[bytes, bytes]]) -> list[tuple[bytes, bytes]]:
    """A spanning forest of links."""
    places: dict[bytes, int] = {}
    union = _Union(2 * len(links))
    return [(a, b) for a, b in links if union.join(places.setdefault(a, len(places)), places.setdefault(b, len(places)))]


class _Index:
    """Which sets hold each token, for the overlaps of one of them with all."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(s) for s in sets])
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.n)
        order = np.argsort(flat, kind="stable")
        self.holders = owner[order]
        new = np.concatenate([[True], flat[order][1:] != flat[order][:-1]])
        self.first, self.many = np.flatnonzero(new), np.diff(np.append(np.flatnonzero(new), len(flat)))
        self.ids = np.empty(len(flat), np.int64)
        self.ids[order] = np.cumsum(new) - 1
        self.starts = np.concatenate([[0], np.cumsum(self.n)])

    def overlaps(self, q: int) -> np.ndarray:
        """Intersection sizes of set ``q`` with all sets."""
        ids = self.ids[self.starts[q] : self.starts[q + 1]]
        many = self.many[ids]
        at = np.repeat(self.first[ids] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        return np.bincount(self.holders[at], minlength=len(self.n))

    def distances(self, q: int) -> np.ndarray:
        both = self.overlaps(q)
        return 1 - both / (self.n[q] + self.n - both)


def join_region(sets: list[np.ndarray], marks: list | None = None, guests: np.ndarray | None = None, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect all close members: a spanning forest.

    Members with equal ``marks`` are connected already.  Two ``guests`` are not compared, nor two
    members of the same side if there are two ``sides``.  Exact: a pair is left out only if it is in
    one component already, its sizes are too far apart, or its distances from some member differ by
    more than EPS.
    """
    index, m = _Index(sets), len(sets)
    union, links = _Union(m), []
    if marks is not None:
        first: dict = {}
        for i, x in enumerate(marks):
            union.join(first.setdefault(x, i), i)
    roots, every = union.roots(), np.arange(m)
    distances: list[np.ndarray] = []
    n = index.n
    for q in range(m - 1):
        rest = every[q + 1 :]
        rest = rest[roots[rest] != roots[q]]
        rest = rest[(DEN * np.minimum(n[rest], n[q]) >= NUM * np.maximum(n[rest], n[q]))]
        if guests is not None and guests[q]:
            rest = rest[~guests[rest]]
        if sides is not None:
            rest = rest[sides[rest] != sides[q]]
        for d in distances:
            rest = rest[np.abs(d[rest] - d[q]) <= EPS + 1e-9]
        if not len(rest):
            continue
        both = index.overlaps(q)
        if len(distances) < FAN and len(rest) > 8:
            distances.append(1 - both / (n[q] + n - both))
        hit = rest[DEN * both[rest] >= NUM * (n[q] + n[rest] - both[rest])]
        for i in hit.tolist():
            if union.join(q, i):
                links.append((q, i))
        if len(hit):
            roots = union.roots()
    return links


def deal(sets: list[np.ndarray], pivots: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Distances of all sets from the first ``pivots`` of them, and links that connect those within EPS."""
    index, union, links = _Index(sets), _Union(len(sets)), []
    d = np.array([index.distances(q) for q in range(pivots)]).T
    for q in range(pivots):
        both = index.overlaps(q)
        for i in np.flatnonzero(DEN * both >= NUM * (index.n[q] + index.n - both)).tolist():
            if union.join(q, i):
                links.append((q, i))
    return d, links


_PLACED = "region binary, chunk long, chunks long, role int, cls binary, mark binary, guest boolean, k long, set binary"
_FOUND = "kind int, a binary, b binary, region binary, chunk long, cls binary, mark binary, guest boolean, k long, home int, d array<double>, set binary"


def _members(docs: DataFrame, want: DataFrame) -> DataFrame:
    """Rows of ``_PLACED`` for ``want`` (cls, doc_id, places: region, chunk, chunks, role, k)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.bool_(), pa.int64(), pa.binary())
        for b in batches:
            rows, size = [], 0

            def out() -> pa.RecordBatch:
                cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
                return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names=names)

            for s, cls, places in zip(_sets(b.column(0)), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if _class(s) != cls:  # another row with this doc_id
                    continue
                raw = s.tobytes()
                for p in places:
                    rows.append((p["region"], p["chunk"], p["chunks"], p["role"], cls, cls, False, p["k"], raw))
                    size += len(raw)
                    if size > SENT:
                        yield out()
                        rows, size = [], 0
            yield out()

    names = [c.split()[0] for c in _PLACED.split(", ")]
    likely = _sieved(docs.select("doc_id", "text"), want)
    joined = likely.join(want, likely["doc_id"].eqNullSafe(want["doc_id"])).select("text", "cls", "places")
    return joined.mapInArrow(run, _PLACED)


def _sieved(docs: DataFrame, want: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a doc_id of ``want``, and some others: those whose bit is set in a bitmap of bounded size.

    Texts of the rest, most of all, need no shuffle.
    """
    each, bits = 1 << 15, 1 << 15
    n = want.count()
    while bits < min(MOST_BITS, BITS * n):
        bits *= 2
    at = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    page, place = F.floor(at / each).alias("page"), (at % each).alias("place")
    pages = want.select(page, place).groupBy("page").agg(F.bitmap_construct_agg("place").alias("map"))
    byte = "CAST(conv(hex(substring(map, CAST(place DIV 8 AS INT) + 1, 1)), 16, 10) AS INT)"
    found = docs.select("*", page, place).join(F.broadcast(pages), "page").where(F.expr(f"getbit({byte}, CAST(place % 8 AS INT)) = 1"))
    return found.select(docs.columns)


def _bucketed(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(_buckets(rows))))


def _buckets(rows: DataFrame) -> int:
    return 8 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _runs(pdf: pd.DataFrame, key: list[str], order: list[str]) -> Iterator[pd.DataFrame]:
    """Rows by ``key``, each class once, in ``order``."""
    for _, part in pdf.groupby(key, sort=True):
        yield part.sort_values([*order, "cls"]).drop_duplicates("cls")


def _found(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _FOUND.split(", ")]).astype({"kind": "int32"})


def _voronoi(placed: DataFrame) -> DataFrame:
    """``_FOUND`` rows: links of small regions; links to pivots and a MOVE row for each member of large ones."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        links: list[tuple[bytes, bytes]] = []
        out: list[tuple] = []
        for part in _runs(pdf[pdf["chunks"] == 1], ["region"], []):
            sets, names = [np.frombuffer(x, np.uint64) for x in part["set"]], part["cls"].tolist()
            links += [(names[a], names[b]) for a, b in join_region(sets)]
        for _, part in pdf[pdf["chunks"] > 1].groupby(["region", "chunk"]):
            out += moves(part, links)
        return _found([(LINK, a, b, *[None] * 9) for a, b in _forest(links)] + out)

    def moves(part: pd.DataFrame, found: list[tuple[bytes, bytes]]) -> list[tuple]:
        pivots = part[part["role"] == PIVOT].drop_duplicates("cls").sort_values("cls")
        rest = part[part["role"] == MEMBER].drop_duplicates("cls")
        p = len(pivots)
        names, marks = [*pivots["cls"], *rest["cls"]], [*pivots["mark"], *rest["mark"]]
        d, links = deal([np.frombuffer(x, np.uint64) for x in [*pivots["set"], *rest["set"]]], p)
        found += [(names[a], names[b]) for a, b in links]
        out = []
        region, chunk, k = (part[x].iloc[0] for x in ("region", "chunk", "k"))
        for i, (guest, raw) in enumerate(zip(rest["guest"], rest["set"], strict=True), p):
            home = int(d[i].argmin())
            mark = marks[home] if d[i, home] <= EPS - 1e-9 else marks[i]
            out.append((MOVE, None, None, region, int(chunk), names[i], mark, bool(guest), int(k), p if guest else home, d[i].tolist(), raw))
        return out

    return _bucketed(placed, ["region", "chunk"]).groupBy("bucket").applyInPandas(run, _FOUND)


def _cells(moves: DataFrame) -> DataFrame:
    """``region`` (new), cls, mark, guest, k (of the region that was split), n, set``: members and guests of every cell."""
    there = lambda j: F.element_at("d", j + 1)
    radii = moves.where(~F.col("guest")).groupBy("region", "home").agg(F.max(there(F.col("home"))).alias("r")).groupBy("region").agg(F.map_from_entries(F.collect_list(F.struct("home", "r"))).alias("radius"))
    own = F.when(F.col("guest"), F.lit(2.0)).otherwise(there(F.least("home", F.size("d") - 1)))

    def near(j: Column) -> Column:
        r = F.try_element_at("radius", j)
        return (j < F.col("home")) & r.isNotNull() & (there(j) <= r + (EPS + 1e-9)) & (there(j) <= own + (2 * EPS + 1e-9))

    visits = F.transform(F.filter(F.sequence(F.lit(0), F.size("d") - 1), near), lambda j: F.struct(j.alias("j"), F.lit(True).alias("guest")))
    stays = F.when(F.col("guest"), F.array().cast("array<struct<j:int,guest:boolean>>")).otherwise(F.array(F.struct(F.col("home").alias("j"), F.lit(False).alias("guest"))))
    to = moves.join(radii, "region").withColumn("to", F.explode(F.concat(stays, visits)))
    name = F.unhex(F.substring(F.sha2(F.concat("region", F.encode(F.col("to.j").cast("string"), "utf-8")), 256), 1, 32))
    return to.select(name.alias("region"), "cls", "mark", F.col("to.guest").alias("guest"), F.col("k").alias("was"), (F.length("set") / 8).cast("long").alias("n"), "set")


def _pieces(k: Column, n: Column) -> Column:
    return F.greatest(F.ceil(k / CHUNK), F.ceil(n / CHUNK_TOKENS)).cast("long")


def _placed(cells: DataFrame, level: int) -> DataFrame:
    """Members of cells that are split again, dealt to chunks, and their pivots (home members) in every chunk."""
    chunk = F.pmod(F.xxhash64("cls"), F.col("chunks"))
    leads = cells.where(~F.col("guest")).groupBy("region", F.pmod(F.xxhash64(F.lit(level), "cls"), F.lit(FAN))).agg(F.min("cls").alias("cls")).select("region", "cls")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    cols = ["region", "chunk", "chunks", "role", "cls", "mark", "guest", "k", "set"]
    pivots = cells.join(leads, ["region", "cls"]).withColumn("chunk", every).withColumn("role", F.lit(PIVOT))
    return cells.withColumn("chunk", chunk).withColumn("role", F.lit(MEMBER)).select(cols).unionByName(pivots.select(cols))


def _blocks(cells: DataFrame) -> DataFrame:
    """``a, b``: links of cells that are not split again, in pairs of blocks."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for part in _runs(pdf, ["region", "i", "j"], ["guest"]):
            names, marks = part["cls"].tolist(), part["mark"].tolist()
            sides = part["block"].to_numpy() if part["i"].iloc[0] != part["j"].iloc[0] else None
            for a, b in join_region([np.frombuffer(x, np.uint64) for x in part["set"]], marks, part["guest"].to_numpy(bool), sides):
                out.append((names[a], names[b]))
        return pd.DataFrame(_forest(out), columns=["a", "b"])

    block = cells.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("chunks")))
    pair = block.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    rows = pair.select("region", "i", "j", "block", "cls", "mark", "guest", "set")
    return _bucketed(rows, ["region", "i", "j"]).groupBy("bucket").applyInPandas(run, "a binary, b binary")


def _components(links: DataFrame) -> DataFrame:
    """``cls, root`` of all linked classes: alternating large and small stars until nothing changes."""
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        now = tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if now == before:
            return edges.select(F.col("u").alias("cls"), F.col("v").alias("root"))
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        edges = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")


def _bounded(places: DataFrame) -> DataFrame:
    """``places`` with ``shared`` no larger than what some other member of the region shares that is near enough in size; those without one go.

    Sizes of close sets are in one band (a power of 4/3) or in neighbouring ones.
    """
    nth = F.row_number().over(Window.partitionBy("region", "band").orderBy(F.desc("shared")))
    two = places.select("region", "band", "shared").withColumn("nth", nth).where("nth <= 2")
    best = two.groupBy("region", "band").agg(F.max("shared").alias("most"), F.max(F.when(F.col("nth") == 2, F.col("shared"))).alias("second"))
    around = best.withColumn("to", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("band", F.col("band") + F.col("to"))
    here = F.col("to") == 0
    around = around.groupBy("region", "band").agg(F.max(F.when(here, F.col("most"))).alias("most"), F.max(F.when(here, F.col("second"))).alias("second"), F.max(F.when(~here, F.col("most"))).alias("beside"))
    other = F.greatest("beside", F.when(F.col("shared") == F.col("most"), F.col("second")).otherwise(F.col("most")))  # the greatest that is not null
    return places.join(around, ["region", "band"]).withColumn("shared", F.least("shared", F.coalesce(other, F.lit(0)))).where("shared > 0").select(places.columns)


def _needed(stars: DataFrame, reps: DataFrame) -> DataFrame:
    """``region, cls, n``: places that hold all close pairs of classes together in some region.

    Close sets share ``least_shared`` first tokens in all their common regions.  A class with fewer in
    all its places (each bounded by what others share there) has none.  Common regions are no more than
    either has: in some region both have their part of the tokens, least_shared / regions.  All other
    places are needless.
    """
    named = reps.select(F.substring("cls", 1, SHORT).alias("short"), "cls", "n")
    band = F.floor(F.log("n") / math.log(DEN / NUM)).cast("int")
    places = stars.join(named, "short").select("region", "cls", "n", band.alias("band"), "shared")
    own = Window.partitionBy("cls")
    likely = _bounded(places).withColumn("all", F.sum("shared").over(own)).where(F.col("all") >= least_shared(F.col("n")))
    likely = likely.withColumn("regions", F.count("*").over(own)).where(F.col("shared") * F.col("regions") >= least_shared(F.col("n")))
    found = _bounded(stored(likely.select(places.columns), "likely")).select("region", "cls", "n")
    # Classes of one short name did not meet as two: they have a region of their own.
    alike = named.groupBy("short").agg(F.count("*").alias("k")).where("k > 1").select("short")
    return found.unionByName(named.join(alike, "short").select(F.concat("short", F.encode(F.lit("="), "utf-8")).alias("region"), "cls", "n"))


def _links(d: DataFrame, stars: DataFrame, reps: DataFrame) -> DataFrame:
    """``a, b``: links that connect all classes within EPS."""
    needed = _needed(stars, reps)
    sizes = needed.groupBy("region").agg(F.count("*").alias("k"), F.sum("n").alias("tokens")).where(F.col("k") > 1)
    needed = needed.join(sizes, "region").withColumn("chunks", _pieces(F.col("k"), F.col("tokens"))).drop("tokens", "n")
    needed = stored(needed, "regions")
    leads = needed.where("chunks > 1").groupBy("region", "chunks", "k", F.pmod(F.xxhash64("cls"), F.lit(FAN))).agg(F.min("cls").alias("cls"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    cols = ["cls", "region", "chunk", "chunks", "role", "k"]
    places = needed.withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("chunks"))).withColumn("role", F.lit(MEMBER)).select(cols)
    places = places.unionByName(leads.withColumn("chunk", every).withColumn("role", F.lit(PIVOT)).select(cols))
    want = stored(places.groupBy("cls").agg(F.collect_list(F.struct(cols[1:])).alias("places")).join(reps.select("cls", "doc_id"), "cls"), "places")

    found = stored(_voronoi(_members(d, want)), "cells")
    links = found.where(F.col("kind") == LINK).select("a", "b")
    level = 0
    while not (moves := found.where(F.col("kind") == MOVE)).isEmpty():
        level += 1
        cells = stored(_cells(moves), "cells")
        sizes = cells.groupBy("region").agg(F.count("*").alias("k"), F.sum("n").alias("tokens"), F.max("was").alias("was"), F.min("mark").alias("lo"), F.max("mark").alias("hi"))
        open_ = sizes.where("lo <> hi").withColumn("chunks", _pieces(F.col("k"), F.col("tokens")))
        cells = cells.drop("was", "n").join(open_.select("region", "k", "chunks", ((F.col("chunks") > 1) & (F.col("k") <= SHRINK * F.col("was"))).alias("again")), "region")
        links = links.unionByName(stored(_blocks(cells.where(~F.col("again"))), "links"))
        found = stored(_voronoi(_placed(cells.where("again"), level)), "cells")
        links = links.unionByName(found.where(F.col("kind") == LINK).select("a", "b"))
    return links


def _labelled(docs: DataFrame) -> DataFrame:
    """``doc_id, th, n, root`` of every row: a hash of its text, its number of shingles, its component (null without shingles)."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    census = stored(_census(d), "census")
    meta = census.where(F.col("token").isNull()).select("doc_id", "th", "n", "cls")
    often = census.where(F.col("token").isNotNull()).groupBy("token").agg(F.sum("n").alias("n"), F.min("cls").alias("cls")).where(F.col("n") >= 16)
    heavy = [(r["token"], r["n"], bytes(r["cls"])) for r in often.orderBy(F.desc("n"), "token").limit(HEAVY).collect()]
    stars = stored(_stars(d, heavy, _buckets(d)), "stars")
    reps = meta.where(F.col("n") > 0).groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    roots = _components(_links(d, stars, reps))
    return meta.join(roots, "cls", "left").select("doc_id", "th", "n", F.when(F.col("n") > 0, F.coalesce("root", "cls")).alias("root"))


def join(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row.

    Null text and texts without words have no shingles and link with nothing; their component is
    their own doc_id.  Texts of one to four words are one shingle, the whole sequence.  Rows with a
    null doc_id take part; a component's id is its smallest doc_id (null if it has none).  Repeated
    rows are equal sets.  Very long texts are hashed in segments, so a task holds one text and its word
    hashes; their sets are whole.  Other columns are not read; an empty table gives no rows.
    """
    labelled = stored(_labelled(docs), "labelled")
    ids = labelled.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return labelled.join(ids, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the document with the smallest doc_id (null last).

    Rows without shingles all stay.  Of rows that repeat both doc_id and text one stays.
    """
    (key,) = fresh(docs, "doc_key")
    labelled = stored(_labelled(docs), "labelled")
    row = F.struct("doc_id", "th")
    grouped = labelled.where(F.col("root").isNotNull())
    first = grouped.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), row.alias("row"))).alias("m")).select(F.col("m.row").alias(key))
    loose = labelled.where(F.col("root").isNull()).select(row.alias(key)).distinct()
    here = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("th"))
    kept = docs.join(first.unionByName(loose), here == F.col(key), "left_semi")
    twice = grouped.groupBy("doc_id", "th").agg(F.count("*").alias("k")).where(F.col("k") > 1)
    if twice.isEmpty():
        return kept
    many = twice.select(row.alias(key))
    once = kept.join(many, here == F.col(key), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(many, here == F.col(key), "left_anti").unionByName(once)


def oracle_sql() -> str:
    """DuckDB: shingles as text, all pairs that share one, and reachability along links."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
k AS (SELECT doc_id, ws, least({WORDS}, len(ws)) AS k FROM w WHERE len(ws) > 0),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS sh FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM k)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS MATERIALIZED (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE {DEN} * c >= {NUM} * (a.n + b.n - c)),
ways AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.x, e.y FROM reach r JOIN ways e ON e.x = r.y)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = w.doc_id"""
