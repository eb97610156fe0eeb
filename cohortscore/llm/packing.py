"""Best-fit packing by exact complements.

The plan is made on the histogram of piece lengths alone: at most ``size`` numbers, whatever
the corpus.  Every gap that a piece leaves is looked up among the sums of one, two and three
other lengths; combinations that fill it exactly are consumed as often as all their lengths
are available.  Lengths that no combination completes are placed best fit, longest first, on
classes of equally filled sequences.  The plan is a short list of segments (length, range of
ranks, first sequence, offset); pieces then find their place by their rank within their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .tokens import encoder

RANKED = 100_000  # pieces of one length that a task ranks, about
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """Encode each whole text (null: empty), append ``end_id`` and cut what is longer than ``size``.

    Cut pieces are ``size`` tokens, but for the first, which takes the remainder.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), end_id).astype("<u4")
                first = (len(ids) - 1) % size + 1
                edges = [0, *range(first, len(ids) + 1, size)]
                rows += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
            cols = list(map(list, zip(*rows, strict=True))) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, PIECES)


class _Plan:
    def __init__(self, counts: np.ndarray):
        self.left = counts.copy()
        self.used = np.zeros_like(counts)
        self.sequences = 0
        self.segments: list[tuple[int, int, int, int, int]] = []  # length, rank from, rank to, first sequence, offset

    def put(self, length: int, n: int, sequence: int, offset: int) -> None:
        lo = int(self.used[length])
        self.segments.append((length, lo, lo + n, sequence, offset))
        self.used[length] += n
        self.left[length] -= n

    def take(self, lengths: tuple[int, ...], n: int) -> None:
        offset = 0
        for length in lengths:
            self.put(length, n, self.sequences, offset)
            offset += length
        self.sequences += n


def _times(left: np.ndarray, lengths: tuple[int, ...]) -> int:
    return min(int(left[x]) // lengths.count(x) for x in lengths)


def plan(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """Segments (rows: length, rank_lo, rank_hi, first sequence, offset) and the number of sequences.

    ``counts[n]`` is the number of pieces of length n; the last index is the sequence size.
    """
    size = len(counts) - 1
    p = _Plan(np.asarray(counts, np.int64))
    p.take((size,), int(p.left[size]))
    for a in range(size - 1, (size + 1) // 2 - 1, -1):  # one length fills the gap
        if n := _times(p.left, (a, size - a)):
            p.take((a, size - a), n)
    for a in range(size - 2, 0, -1):  # a pair sum fills it
        while p.left[a]:
            gap = size - a
            b = np.arange(1, min(gap // 2, a) + 1)
            b = b[gap - b <= a]
            n = np.minimum(p.left[b], p.left[gap - b])
            if not len(b) or not n.max():
                break
            for i in np.argsort(-n, kind="stable"):
                pick = (a, int(gap - b[i]), int(b[i]))
                if n[i] and (times := _times(p.left, pick)):
                    p.take(pick, times)
                    break
            else:
                break
    for a in range(size - 3, 0, -1):  # a triple sum fills it
        while p.left[a]:
            gap, found = size - a, None
            here = np.flatnonzero(p.left > 0)
            pair = np.zeros(size + 1, bool)
            small = here[here <= min(a, gap)]
            if not len(small):
                break
            hit = np.zeros(size + 1, np.int64)
            hit[small] = 1
            pair[:] = np.rint(np.fft.irfft(np.fft.rfft(hit, 2 * size + 2) ** 2, 2 * size + 2))[: size + 1] > 0
            for b in small[::-1]:
                rest = gap - int(b)
                if rest < 2 or not pair[rest]:
                    continue
                c = small[(small <= b) & (small < rest)]
                for x in c[p.left[rest - c] > 0][::-1]:
                    pick = (a, int(b), int(x), int(rest - x))
                    if pick[3] <= b and (times := _times(p.left, pick)):
                        found = (pick, times)
                        break
                if found:
                    break
            if not found:
                break
            p.take(*found)
    open_: dict[int, list[tuple[int, int]]] = {}  # gap -> classes (first sequence, count)
    for a in range(size, 0, -1):  # best fit, longest first
        while n := int(p.left[a]):
            gap = next((g for g in range(a, size) if open_.get(g)), 0)
            if gap:
                first, have = open_[gap].pop()
                n = min(n, have)
                p.put(a, n, first, size - gap)
                if have > n:
                    open_[gap].append((first + n, have - n))
                open_.setdefault(gap - a, []).append((first, n))
            else:
                fit = size // a
                for k, m in ((fit, n // fit), (n % fit, 1)):
                    if k and m:
                        for j in range(k):
                            p.put(a, m, p.sequences, j * a)
                        open_.setdefault(size - k * a, []).append((p.sequences, m))
                        p.sequences += m
        open_.pop(0, None)
    return np.array(p.segments, np.int64).reshape(-1, 5), p.sequences


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack all documents into sequences of at most ``size`` tokens.

    Null or empty text is one piece that holds ``end_id`` alone.  Repeated rows are packed as
    often as they occur.  An empty table gives no rows.  Columns of the input other than doc_id
    and text are not read.

    Pieces are written once to the shared folder.  The driver sees the histogram of lengths only.
    Ranks within a length are numbered in salted parts of about ``RANKED`` pieces, so a length that a
    third of all pieces have is numbered by many tasks.
    """
    cut = stored(pieces(docs, tokenizer_path, size, end_id), "pieces")
    spark = docs.sparkSession
    counts = np.zeros(size + 1, np.int64)
    for row in cut.groupBy("length").agg(F.count("*").alias("n")).collect():
        counts[row["length"]] = row["n"]
    segments, _ = plan(counts)
    segments = segments[np.lexsort((segments[:, 1], segments[:, 0]))]
    shared = spark.sparkContext.broadcast((((segments[:, 0] << 44) | segments[:, 1]), segments))
    salts = spark.createDataFrame([(k, int(-(-n // RANKED))) for k, n in enumerate(counts) if n], "length long, salts long")
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts"))
    salted = cut.join(F.broadcast(salts), "length").withColumn("salt", salt)  # at most size + 1 rows
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    offsets = stored(parts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank0")), "offsets")
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (
        salted.withColumn("rank1", F.row_number().over(inside) - 1)
        .join(offsets, ["length", "salt"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank0") + F.col("rank1")).alias("rank"))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, seg = shared.value
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5))
            at = np.searchsorted(keys, (length << 44) | rank, side="right") - 1
            cols = [*b.columns[:5], pa.array(seg[at, 3] + rank - seg[at, 1]), pa.array(seg[at, 4])]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")
