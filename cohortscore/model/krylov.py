"""Iterative solvers whose operator is a Spark job: block conjugate gradients, a trust region, Lanczos quadrature.

The driver keeps blocks of vectors; ``apply`` maps one block to another in one pass over the data.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from enum import IntEnum

import numpy as np

Apply = Callable[[np.ndarray], np.ndarray]


class Status(IntEnum):
    """How a solve of one right side ended."""

    CONVERGED = 0
    STEPS = 1  #: the steps were used up
    STAGNATED = 2  #: no progress any more, above the tolerance
    INDEFINITE = 3  #: a direction of no positive curvature was met


class BlockDiagonal:
    """A preconditioner L L' of dense diagonal blocks, with a plain diagonal in front of and between them.

    ``blocks`` are (members, matrix) pairs; a coordinate in none of them has its own ``diagonal``.
    """

    def __init__(self, diagonal: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]] = ()):
        self.root = np.sqrt(diagonal)
        self.blocks = [(at, np.linalg.cholesky(m)) for at, m in blocks]
        self.inverses = [np.linalg.inv(factor) for _, factor in self.blocks]

    def _mapped(self, x: np.ndarray, plain: np.ndarray, parts: list[np.ndarray]) -> np.ndarray:
        out = x * (plain if x.ndim == 1 else plain[:, None])
        for (at, _), m in zip(self.blocks, parts, strict=True):
            out[at] = m @ x[at]
        return out

    def solve_lower(self, x: np.ndarray) -> np.ndarray:
        return self._mapped(x, 1 / self.root, self.inverses)

    def solve_upper(self, x: np.ndarray) -> np.ndarray:
        return self._mapped(x, 1 / self.root, [m.T for m in self.inverses])

    def upper(self, x: np.ndarray) -> np.ndarray:
        return self._mapped(x, self.root, [factor.T for _, factor in self.blocks])

    def solve(self, x: np.ndarray) -> np.ndarray:
        return self.solve_upper(self.solve_lower(x))

    def times(self, x: np.ndarray) -> np.ndarray:
        """L L' x."""
        return self._mapped(self.upper(x), self.root, [factor for _, factor in self.blocks])

    def inverse_diagonal(self) -> np.ndarray:
        out = 1 / self.root**2
        for (at, _), m in zip(self.blocks, self.inverses, strict=True):
            out[at] = (m**2).sum(axis=0)
        return out

    def log_determinant(self) -> float:
        alone = np.ones(len(self.root), bool)
        for at, _ in self.blocks:
            alone[at] = False
        return float(2 * np.log(self.root[alone]).sum() + sum(2 * np.log(np.diag(factor)).sum() for _, factor in self.blocks))


@dataclass
class Solution:
    x: np.ndarray
    status: list[Status]
    residuals: np.ndarray  #: of each right side, relative to it, preconditioned
    steps: int


def block_cg(apply: Apply, rhs: np.ndarray, preconditioner: BlockDiagonal | None = None, tol: float = 1e-8, steps: int = 500, start: np.ndarray | None = None, patience: int = 20) -> Solution:
    """Solve an SPD system for all columns of ``rhs`` at once, in one search space that they share.

    The residual block is kept as an orthonormal basis times small coefficients, so that right sides that depend on
    each other, equal or zero ones break nothing.  Residuals are those of the preconditioned system, relative to the right side; those that
    are returned are true ones, from a product of their own.
    """
    m = preconditioner or BlockDiagonal(np.ones(len(rhs)))
    lower = lambda x: m.solve_lower(apply(m.solve_upper(x)))
    b = m.solve_lower(rhs)
    size = np.linalg.norm(b, axis=0)
    y = np.zeros_like(b) if start is None else m.upper(start)
    r = b if start is None else b - lower(y)
    q, c = np.linalg.qr(r)
    s, best, since, ended = q, np.inf, 0, Status.STEPS
    step = 0
    while True:
        off = np.linalg.norm(c, axis=0)
        if (off <= tol * size).all():
            ended = Status.CONVERGED
            break
        worst = float(np.max(off / np.where(size > 0, size, 1)))
        if not np.isfinite(worst):
            ended = Status.INDEFINITE
            break
        best, since = (worst, 0) if worst < 0.99 * best else (best, since + 1)
        if since > patience:
            ended = Status.STAGNATED
            break
        if step == steps:
            break
        t = lower(s)
        curve = s.T @ t
        curve = (curve + curve.T) / 2
        values = np.linalg.eigvalsh(curve)
        if values[0] <= 1e-14 * max(abs(values[-1]), 1e-300):
            ended = Status.INDEFINITE
            break
        along = np.linalg.inv(curve)
        y = y + s @ (along @ c)
        q, turn = np.linalg.qr(q - t @ along)
        s, c = q + s @ turn.T, turn @ c
        step += 1
    x = m.solve_upper(y)
    left = np.linalg.norm(m.solve_lower(rhs - apply(x)), axis=0) / np.where(size > 0, size, 1)
    # What the short recurrence believes is held against a product: rounding may have stopped it earlier.
    done = np.linalg.norm(c, axis=0) <= tol * size
    status = [ended if not d else Status.CONVERGED if true <= 10 * tol else Status.STAGNATED for d, true in zip(done, left, strict=True)]
    return Solution(x, status, left, step)


def inner_steps(tolerance: float, condition: float, least: int = 4, most: int = 256) -> int:
    """Conjugate-gradient steps after which the error's energy norm has fallen by ``tolerance``, by the bound for a condition number."""
    if not 0 < tolerance < 1 or condition < 1:
        raise ValueError("the tolerance must lie in (0, 1), the condition be 1 or more")
    return int(np.clip(np.ceil(np.sqrt(condition) / 2 * np.log(2 / tolerance)), least, most))


@dataclass
class Step:
    move: np.ndarray
    model: float  #: by how much the quadratic model falls
    edge: bool  #: whether the region's edge stopped it
    products: int
    condition: float  #: of the preconditioned system, as far as the steps saw it


def region_step(apply: Apply, gradient: np.ndarray, preconditioner: BlockDiagonal, radius: float, tol: float, steps: int) -> Step:
    """Minimize g'd + d'Hd / 2 over |L'd| <= radius by conjugate gradients that end at the edge, or where curvature is lost.

    Works in coordinates u = L'd, where the region is a ball and the residuals are preconditioned ones.
    """
    g = preconditioner.solve_lower(gradient)
    u, hu = np.zeros_like(g), np.zeros_like(g)
    r = -g
    p, rr = r.copy(), float(r @ r)
    stop, lengths, ratios = tol * np.sqrt(rr), [], []
    edge, n = False, 0
    while n < steps and np.sqrt(rr) > stop:
        hp = preconditioner.solve_lower(apply(preconditioner.solve_upper(p)[:, None])[:, 0])
        n += 1
        curve = float(p @ hp)
        length = rr / curve if curve > 0 else np.inf
        if curve <= 0 or np.linalg.norm(u + length * p) >= radius:
            # The positive root of |u + t p| = radius.
            uu, up, pp = float(u @ u), float(u @ p), float(p @ p)
            t = (radius**2 - uu) / (up + np.sqrt(up * up + pp * (radius**2 - uu)))
            u, hu, edge = u + t * p, hu + t * hp, True
            break
        u, hu, r = u + length * p, hu + length * hp, r - length * hp
        new = float(r @ r)
        lengths.append(length)
        ratios.append(new / rr)
        p, rr = r + new / rr * p, new
    return Step(preconditioner.solve_upper(u), -float(g @ u + u @ hu / 2), edge, n, _condition(lengths, ratios))


def _condition(lengths: list[float], ratios: list[float]) -> float:
    """What the steps of conjugate gradients tell of the operator: the spread of their tridiagonal matrix's eigenvalues."""
    if not lengths:
        return 1.0
    inverse, ratios = 1 / np.array(lengths), np.array(ratios)
    diagonal, side = inverse.copy(), np.sqrt(ratios[:-1]) * inverse[:-1]
    diagonal[1:] += ratios[:-1] * inverse[:-1]
    values = np.linalg.eigvalsh(np.diag(diagonal) + np.diag(side, 1) + np.diag(side, -1))
    return float(max(values[-1] / max(values[0], 1e-300), 1.0))


def log_determinant(apply: Apply, n: int, preconditioner: BlockDiagonal | None = None, probes: int = 32, steps: int = 30, seed: int = 0, tol: float = 1e-10) -> tuple[float, float]:
    """log det of an SPD operator and its standard error, by Lanczos quadrature: all probes go on in one product a step.

    With a preconditioner, the quadrature is of what is left of the operator, and its own determinant is added.
    """
    m = preconditioner or BlockDiagonal(np.ones(n))
    rng = np.random.default_rng(seed)
    q = rng.choice([-1.0, 1.0], (n, probes)) / np.sqrt(n)
    basis, a, b = [q], [], []
    alive = np.ones(probes, bool)
    for k in range(min(steps, n)):
        w = m.solve_lower(apply(m.solve_upper(basis[-1])))
        a.append(np.einsum("ij,ij->j", w, basis[-1]))
        for _ in range(2):  # orthogonal to all before, again and again
            for v in basis:
                w = w - v * np.einsum("ij,ij->j", v, w)
        norm = np.linalg.norm(w, axis=0)
        alive &= norm > tol * np.abs(a[0])
        if not alive.any() or k + 1 == min(steps, n):
            break
        b.append(np.where(alive, norm, 0.0))
        basis.append(np.where(alive, w / np.where(norm > 0, norm, 1), 0.0))
    found = []
    for j in range(probes):
        size = next((i + 1 for i, x in enumerate(b) if x[j] == 0.0), len(a))  # a probe that ended early has its own size
        off = np.array([x[j] for x in b[: size - 1]])
        values, vectors = np.linalg.eigh(np.diag([x[j] for x in a[:size]]) + np.diag(off, 1) + np.diag(off, -1))
        if values[0] <= 0:
            raise ValueError("the operator is not positive definite")
        found.append(n * float(vectors[0] ** 2 @ np.log(values)))
    return m.log_determinant() + float(np.mean(found)), float(np.std(found) / np.sqrt(probes))


class Mixing:
    """Anderson mixing of a fixed-point iteration, one proposal a call; the caller judges it, and may take it back.

    ``state`` is what a later process goes on from.
    """

    def __init__(self, memory: int = 8, state: dict | None = None, ridge: float = 1e-2):
        self.memory, self.ridge = memory, ridge
        self.xs = [np.asarray(x, float) for x in (state or {}).get("xs", [])]
        self.fs = [np.asarray(f, float) for f in (state or {}).get("fs", [])]

    def propose(self, x: np.ndarray, f: np.ndarray) -> np.ndarray:
        """The next point, from a point and its image."""
        self.xs, self.fs = [*self.xs, x][-self.memory - 1 :], [*self.fs, f][-self.memory - 1 :]
        if len(self.xs) < 2:
            return f
        left = np.array(self.fs) - np.array(self.xs)
        dr, df = np.diff(left, axis=0), np.diff(np.array(self.fs), axis=0)
        # The ridge keeps differences that hardly differ from being weighed hugely.
        gram = dr @ dr.T
        weights = np.linalg.solve(gram + (self.ridge * np.trace(gram) + 1e-300) * np.eye(len(gram)), dr @ left[-1])
        new = f - weights @ df
        return new if np.isfinite(new).all() else f

    def forget(self) -> None:
        self.xs, self.fs = self.xs[-1:], self.fs[-1:]

    def state(self) -> dict:
        return {"xs": [x.tolist() for x in self.xs], "fs": [f.tolist() for f in self.fs]}
