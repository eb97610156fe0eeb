"""Products of the design with blocks of vectors: one pass over the samples each, without any p x p matrix.

A sample's row holds its covariates and its stored cells; all other cells of a variant share one value, which
stays a constant.  So X V, a weight, and X' of that happen where the row lies.  A task adds up one vector of
k + p numbers for each column of V, in blocks of coordinates; the blocks of all tasks meet by their number and
are added on the executors, as they stream by.  The driver gets k + p numbers a column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Coordinates in a block of sums, and cells times columns that one step of a task spreads out.
BLOCK, CELLS = 1 << 15, 1 << 21


@dataclass
class Cells:
    """A slice of samples: covariates, targets, and the stored cells' columns and differences from their column's constant."""

    c: np.ndarray
    y: np.ndarray
    row: np.ndarray
    at: np.ndarray
    z: np.ndarray

    @classmethod
    def of(cls, b: pa.RecordBatch) -> Cells:
        n = b.num_rows
        c = b.column("c").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
        at, z = b.column("at"), b.column("z")
        sizes = pc.fill_null(pc.list_value_length(at), 0).to_numpy(zero_copy_only=False)
        return cls(c, b.column("y").to_numpy(zero_copy_only=False).astype(float), np.repeat(np.arange(n), sizes), at.flatten().to_numpy().astype(np.int64), z.flatten().to_numpy())

    def times(self, v: np.ndarray, zero: np.ndarray) -> np.ndarray:
        """X V of these samples."""
        k, n = self.c.shape[1], len(self.y)
        out = self.c @ v[:k] + zero @ v[k:]
        step = max(1, CELLS // v.shape[1])
        for lo in range(0, len(self.at), step):
            at, z, row = self.at[lo : lo + step], self.z[lo : lo + step] - zero[self.at[lo : lo + step]], self.row[lo : lo + step]
            part = z[:, None] * v[k + at]
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            out[row[first]] += np.add.reduceat(part, first, axis=0)
        return out.reshape(n, -1)

    def squares_times(self, v: np.ndarray, zero: np.ndarray) -> np.ndarray:
        """Sum of the squared cells times v (p numbers), for each sample."""
        z = (self.z**2 - zero[self.at] ** 2) * v[self.at]
        return zero**2 @ v + np.bincount(self.row, z, len(self.y))

    def add_to(self, total: np.ndarray, r: np.ndarray, zero: np.ndarray) -> None:
        """Add X' R of these samples; what the constants of all columns add is told by R's sums, in the last row."""
        k = self.c.shape[1]
        total[:k] += self.c.T @ r
        total[-1] += r.sum(axis=0)
        z = self.z - zero[self.at]
        if r.shape[1] == 1:
            total[k:-1, 0] += np.bincount(self.at, z * r[self.row, 0], len(zero))
            return
        # Cells in the order of their columns: each column's are summed in one go, for all of R.
        order = np.argsort(self.at, kind="stable")
        step = max(1, CELLS // r.shape[1])
        for lo in range(0, len(order), step):
            own = order[lo : lo + step]
            at = self.at[own]
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            total[k + at[first]] += np.add.reduceat(z[own, None] * r[self.row[own]], first, axis=0)


def swept(rows: DataFrame, zero: np.ndarray, k: int, columns: int, visit: Callable[[Cells, np.ndarray], tuple[np.ndarray, np.ndarray]], scalars: int) -> tuple[np.ndarray, np.ndarray]:
    """One pass: ``visit`` gives R (a column for each vector asked for) and some numbers of a slice of samples; X' R and the numbers' sums."""
    spark = rows.sparkSession
    constant = spark.sparkContext.broadcast(zero)
    size = k + len(zero) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zero = constant.value
        total, numbers = np.zeros((size, columns)), np.zeros(scalars)
        seen = False
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                cells = Cells.of(b.slice(lo, 4096))
                r, own = visit(cells, zero)
                cells.add_to(total, r, zero)
                numbers += own
                seen = True
        if seen:
            for i in range(0, size, BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([i // BLOCK], pa.int32()), pa.array([total[i : i + BLOCK].tobytes()], pa.binary())], names=["block", "sums"])
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([numbers.tobytes()], pa.binary())], names=["block", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for block, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                part = np.frombuffer(raw.as_buffer())
                held[block] = held[block] + part if block in held else part.copy()
        for block, sums in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([sums.tobytes()], pa.binary())], names=["block", "sums"])

    kind = "block int, sums binary"
    parts = rows.select("c", "y", "at", "z").mapInArrow(run, kind).repartition("block").mapInArrow(add, kind).collect()
    constant.destroy()
    got = {r["block"]: np.frombuffer(r["sums"]) for r in parts}
    numbers = got.pop(-1, np.zeros(scalars))
    whole = np.concatenate([got[i] for i in sorted(got)]).reshape(size, columns) if got else np.zeros((size, columns))
    out = whole[:-1].copy()
    out[k:] += zero[:, None] * whole[-1][None, :]
    return out, numbers


class Design:
    """The n x (k + p) design of ``rows`` (see ``moments.design``), as what its products need."""

    def __init__(self, rows: DataFrame, zero: np.ndarray, k: int):
        self.rows, self.zero, self.k, self.passes = rows, zero, k, 0
        self._lent: list = []

    @property
    def size(self) -> int:
        return self.k + len(self.zero)

    def _sweep(self, columns: int, visit: Callable, scalars: int = 1) -> tuple[np.ndarray, np.ndarray]:
        self.passes += 1
        try:
            return swept(self.rows, self.zero, self.k, columns, visit, scalars)
        finally:
            while self._lent:
                self._lent.pop().destroy()

    def gram(self, v: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """X' W X V, with the logistic weights at ``at`` or W = 1."""
        both = self._shared(v if at is None else np.column_stack([at, v]))

        def visit(cells: Cells, zero: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            got = cells.times(both.value, zero)
            if at is None:
                return got, np.zeros(1)
            mu = 0.5 * (1 + np.tanh(got[:, :1] / 2))
            return mu * (1 - mu) * got[:, 1:], np.zeros(1)

        return self._sweep(v.shape[1], visit)[0]

    def slope(self, x: np.ndarray) -> tuple[np.ndarray, float, float, int]:
        """X' (y - mu), the log-likelihood, the mean weight of the logistic model at x, and the number of samples."""
        shared = self._shared(x[:, None])

        def visit(cells: Cells, zero: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            eta = cells.times(shared.value, zero)[:, 0]
            mu = 0.5 * (1 + np.tanh(eta / 2))
            return (cells.y - mu)[:, None], np.array([(cells.y * eta - np.logaddexp(0, eta)).sum(), (mu * (1 - mu)).sum(), len(eta)])

        g, (ll, w, n) = self._sweep(1, visit, 3)
        return g[:, 0], float(ll), float(w / max(n, 1)), int(round(n))

    def loss(self, x: np.ndarray, binary: bool) -> tuple[float, int]:
        """Sum of the samples' losses (negative log-likelihoods or squares), and their number."""
        shared = self._shared(x[:, None])

        def visit(cells: Cells, zero: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            eta = cells.times(shared.value, zero)[:, 0]
            lost = np.logaddexp(0, eta) - cells.y * eta if binary else (cells.y - eta) ** 2
            return np.zeros((len(eta), 1)), np.array([lost.sum(), len(eta)])

        _, (total, n) = self._sweep(1, visit, 2)
        return float(total), int(round(n))

    def squares(self) -> np.ndarray:
        """Sum of each variant's squared cells: z^2 of the stored ones, the constant's for all others."""
        before = self.zero

        def visit(cells: Cells, zero: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            # X' R with R = 1 sums cells; z^2 - zero^2 = (z - zero)(z + zero) needs its own weights, so cells are replaced.
            cells.z = cells.z**2 - zero[cells.at] ** 2 + zero[cells.at]
            return np.ones((len(cells.y), 1)), np.array([len(cells.y)])

        sums, (n,) = self._sweep(1, visit)
        return sums[self.k :, 0] - n * before + n * before**2

    def target(self) -> tuple[np.ndarray, float, int]:
        """X' y, y'y and the number of samples."""
        g, (yy, n) = self._sweep(1, lambda cells, _: (cells.y[:, None], np.array([cells.y @ cells.y, len(cells.y)])), 2)
        return g[:, 0], float(yy), int(round(n))

    def bound(self, x: np.ndarray, variance: np.ndarray) -> tuple[float, float]:
        """The variational bound's data terms: of the logistic likelihood at its best local parameters, and the sum of the predictors' variances.

        A sample's local parameter is the root mean square of its predictor, mean x and variants' variances given.
        """
        shared = self._shared(x[:, None])
        own = self._shared(variance)

        def visit(cells: Cells, zero: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            eta = cells.times(shared.value, zero)[:, 0]
            spread = np.maximum(cells.squares_times(own.value, zero), 0.0)
            xi = np.sqrt(eta * eta + spread)
            return np.zeros((len(eta), 1)), np.array([((cells.y - 0.5) * eta - xi / 2 - np.log1p(np.exp(-xi))).sum(), spread.sum()])

        _, (logistic, spread) = self._sweep(1, visit, 2)
        return float(logistic), float(spread)

    def _shared(self, value: np.ndarray):
        """Lent to the next pass: k + p numbers a column, which the driver holds anyway."""
        self._lent.append(self.rows.sparkSession.sparkContext.broadcast(value))
        return self._lent[-1]
