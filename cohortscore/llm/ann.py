"""Approximate nearest neighbours: a forest of random-projection trees under one priority queue.

Equal vectors are one class, so a very common vector is searched and scored once.  Trees are
fitted on a bounded sample of classes; every class is then routed through all of them.  For a
query all trees' leaves wait in one queue, by the squared margins their path crosses, and are
opened until they hold ``share`` of all vectors (``least`` at least).  Leaves are scored in
bundles of bounded size, each with the queries that opened one of its leaves; the inner products
are those of the original vectors in double precision.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

TREES = 6
SHARE = 0.8  # of the vectors, counted once for each tree; recall on unstructured vectors needs that much
LEAST = 4000
LEAF = 200
SAMPLE = 16_384
BUNDLE = 16_384
CHUNK = 16_384
LENGTHS = 64  # most lengths of vectors in a table


@dataclass
class Forest:
    """Complete trees of one depth: node k's children are 2 k + 1 and 2 k + 2."""

    depth: int
    weights: np.ndarray  # trees x nodes x dimensions
    cuts: np.ndarray  # trees x nodes

    @classmethod
    def fit(cls, x: np.ndarray, trees: int, depth: int, seed: int = 5) -> Forest:
        rng = np.random.default_rng(seed)
        nodes = (1 << depth) - 1
        w, c = np.zeros((trees, nodes, x.shape[1])), np.zeros((trees, nodes))
        for t in range(trees):
            members = {0: np.arange(len(x))}
            for k in range(nodes):
                at = members.pop(k)
                if len(at) > 1:
                    a, b = x[rng.choice(at, 2, replace=False)]
                    direction = a - b
                else:
                    direction = rng.standard_normal(x.shape[1])
                norm = np.linalg.norm(direction)
                w[t, k] = direction / norm if norm else rng.standard_normal(x.shape[1])
                p = x[at] @ w[t, k]
                c[t, k] = np.median(p) if len(at) else 0.0
                members[2 * k + 1], members[2 * k + 2] = at[p < c[t, k]], at[p >= c[t, k]]
        return cls(depth, w, c)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Rows x trees: the leaf that each vector falls into."""
        out = np.zeros((len(x), len(self.weights)), np.int32)
        for t in range(len(self.weights)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", x, self.weights[t, node]) >= self.cuts[t, node]
                node = 2 * node + 1 + side
            out[:, t] = node - ((1 << self.depth) - 1)
        return out

    def costs(self, q: np.ndarray) -> np.ndarray:
        """Trees x leaves: the sum of squared margins that one must cross from the query's own leaf."""
        cost = np.zeros((len(self.weights), 1))
        for level in range(self.depth):
            lo = (1 << level) - 1
            margin = self.weights[:, lo : 2 * lo + 1] @ q - self.cuts[:, lo : 2 * lo + 1]
            left, right = cost + np.maximum(margin, 0) ** 2, cost + np.minimum(margin, 0) ** 2
            cost = np.stack([left, right], axis=2).reshape(len(cost), -1)
        return cost


def opened(costs: np.ndarray, sizes: np.ndarray, budget: int) -> list[int]:
    """Leaves (tree * leaves + leaf) in the order of the shared queue, until they hold ``budget`` vectors."""
    flat = sizes.reshape(-1)
    queue = [(c, k) for k, c in enumerate(costs.reshape(-1).tolist()) if flat[k]]
    heapq.heapify(queue)
    out, held = [], 0
    while queue and held < budget:
        _, k = heapq.heappop(queue)
        out.append(k)
        held += int(flat[k])
    return out


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _best(q: np.ndarray, v: np.ndarray, ids: np.ndarray, mask: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """For each query the k best masked-in vectors: (query row, id, inner product); ties to smaller ids."""
    out = []
    s = q @ v.T
    s[~mask] = -np.inf
    edge = -np.partition(-s, min(k, s.shape[1]) - 1, axis=1)[:, min(k, s.shape[1]) - 1]
    for i in range(len(q)):
        at = np.flatnonzero((s[i] >= edge[i] - 1e-9 * abs(edge[i]) if np.isfinite(edge[i]) else s[i] > -np.inf))
        exact = (q[i] * v[at]).sum(1)
        order = np.lexsort((ids[at], -exact))[:k]
        out += [(i, int(ids[at[o]]), float(exact[o])) for o in order]
    return out


def search(
    vectors: DataFrame, every: int = 20, k: int = 20, trees: int = TREES, share: float = SHARE, least: int = LEAST, sample: int = SAMPLE
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of each row whose vec_id is divisible by ``every``.

    Candidates are all rows but the query's own; nearness is the inner product, ties go to the
    smaller vec_id; all candidates if there are fewer than k.  Vectors that are null, zero, or hold
    a null or a non-finite component take no part, nor do rows without vec_id.  Vectors of each length
    are searched apart (an inner product needs equal lengths); more than ``LENGTHS`` lengths raise.  A vec_id given twice counts once (its smallest vector).  Empty
    tables give no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & whole)
    good = good.groupBy("vec_id").agg(F.min("v").alias("v"))
    lengths = [r["d"] for r in good.select(F.size("v").alias("d")).distinct().orderBy("d").limit(LENGTHS + 1).collect()]
    if len(lengths) > LENGTHS:
        raise ValueError(f"vectors of more than {LENGTHS} lengths")
    found = [_search(good.where(F.size("v") == d), d, every, k, trees, share, least, sample) for d in lengths]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _search(good: DataFrame, dim: int, every: int, k: int, trees: int, share: float, least: int, sample: int) -> DataFrame:
    """The search among vectors of one length."""
    spark = good.sparkSession
    # A class has at most k + 1 ids that any answer can need; the window limit acts before the shuffle.
    first = Window.partitionBy("v").orderBy("vec_id")
    ids = good.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    classes = stored(ids.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("cls"), "ids", "v"), "classes")
    n = classes.count()
    picked = classes.select("cls", "v").orderBy(F.xxhash64("cls"), "cls").limit(min(sample, max(1024, (64 << 20) // (8 * dim)))).collect()
    x = np.array([r["v"] for r in picked])
    depth = max(0, min(int(np.ceil(np.log2(max(n, 1) / LEAF))), int(np.log2(max(len(x) // 32, 1)))))
    forest = Forest.fit(x, trees, depth)
    n_leaves = 1 << depth
    shared = spark.sparkContext.broadcast(forest)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = shared.value.leaves(_matrix(b.column(1), dim)) + np.arange(trees, dtype=np.int32) * n_leaves
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(leaf), pa.list_(pa.int32()))], names=["cls", "leaves"])

    routed = classes.select("cls", "v").mapInArrow(route, "cls long, leaves array<int>")
    placed = stored(routed.select("cls", F.explode("leaves").alias("leaf")), "placed")
    sizes = np.zeros(trees * n_leaves, np.int64)
    for row in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect():  # trees * leaves rows
        sizes[row["leaf"]] = row["n"]
    # Bundles of neighbouring leaves; a leaf above the bundle size is dealt over several.
    bundle_of, parts_of, bundle, held = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, 0
    for leaf, size in enumerate(sizes):
        parts = max(1, -(-int(size) // BUNDLE))
        if held and (held + size > BUNDLE or parts > 1):
            bundle, held = bundle + 1, 0
        bundle_of[leaf], parts_of[leaf] = bundle, parts
        held += int(size)
        if parts > 1:
            bundle, held = bundle + parts, 0
    layout = spark.sparkContext.broadcast((sizes.reshape(trees, n_leaves), bundle_of, parts_of))
    budget = max(int(share * n), least * trees)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes_, bundles, parts = layout.value
        for b in batches:
            for cls, vec, q in zip(b.column(0).to_pylist(), b.column(1), _matrix(b.column(1), dim), strict=True):
                by: dict[int, list[int]] = {}
                for leaf in opened(shared.value.costs(q), sizes_, budget):
                    for part in range(parts[leaf]):
                        by.setdefault(int(bundles[leaf]) + part, []).append(leaf)
                cols = [pa.array([cls] * len(by), pa.int64()), pa.array(list(by), pa.int64()), pa.array(list(by.values()), pa.list_(pa.int32())), pa.array([vec.as_py()] * len(by), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["query", "bundle", "opened", "v"])

    queries = good.where(F.col("vec_id") % every == 0).join(classes.select("cls", "v"), "v").select("vec_id", "cls")
    queries = stored(queries, "queries")
    chunks = max(1, -(-queries.count() // CHUNK))
    asking = queries.select("cls").distinct().join(classes.select("cls", "v"), "cls").mapInArrow(ask, "query long, bundle long, opened array<int>, v array<double>")
    asking = asking.withColumn("chunk", F.pmod(F.xxhash64("query"), F.lit(chunks)))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, bundles, parts = layout.value
        for b in batches:
            leaf, cls = b.column(1).to_numpy(zero_copy_only=False), b.column(0).to_numpy(zero_copy_only=False)
            at = bundles[leaf] + (cls.astype(np.int64) * 0x9E3779B1 >> 16) % parts[leaf]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at)], names=["cls", "leaf", "bundle"])

    held_ = placed.mapInArrow(spread, "cls long, leaf int, bundle long").groupBy("cls", "bundle").agg(F.collect_list("leaf").alias("leaves"))
    held_ = held_.join(classes.select("cls", "v"), "cls").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))

    def score(have: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple[int, int, float]] = []
        if len(have) and len(want):
            v = np.stack(have["v"].to_numpy()).astype(np.float64)
            ids_ = have["cls"].to_numpy()
            known = {leaf: i for i, leaf in enumerate(sorted({x for xs in have["leaves"] for x in xs}))}
            member = np.zeros((len(known), len(v)), bool)
            for i, xs in enumerate(have["leaves"]):
                member[[known[x] for x in xs], i] = True
            member = member.astype(np.float32)
            names = want["query"].to_numpy()
            q = np.stack(want["v"].to_numpy()).astype(np.float64)
            for lo in range(0, len(q), 128):
                probe = np.zeros((len(q[lo : lo + 128]), len(known)), np.float32)
                for i, xs in enumerate(want["opened"].iloc[lo : lo + 128]):
                    probe[i, [known[x] for x in xs if x in known]] = 1
                rows += [(int(names[lo + i]), c, s) for i, c, s in _best(q[lo : lo + 128], v, ids_, (probe @ member) > 0, k + 1)]
        return pd.DataFrame(rows, columns=["query", "cls", "score"]).astype({"query": "int64", "cls": "int64", "score": "float64"})

    by = ["bundle", "chunk"]
    found = held_.groupBy(*by).cogroup(asking.groupBy(*by)).applyInPandas(score, "query long, cls long, score double")
    pairs = found.groupBy("query", "cls").agg(F.max("score").alias("score"))
    top = Window.partitionBy("query").orderBy(F.desc("score"), "cls")
    pairs = pairs.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k + 1)
    spelled = pairs.join(classes.select("cls", "ids"), "cls").select("query", "score", F.explode("ids").alias("vec_id"))
    near = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    spelled = spelled.withColumn("r", F.row_number().over(near)).where(F.col("r") <= k + 1)
    lists = spelled.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("r", "score", "vec_id"))).alias("near"))
    answer = queries.join(lists, F.col("cls") == F.col("query")).select(F.col("vec_id").alias("query_id"), F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("vec_id")), 1, k).alias("near"))
    return answer.select("query_id", F.posexplode("near").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
