"""The effects' posterior for given prior scales: from a dense matrix on the driver, or from products alone.

Both give the mode, the variances and the objective.  ``Sparse`` never forms a matrix of all variants: modes are
found by a trust region (binary) or conjugate gradients (quantitative), variances by solves for all unit vectors
where these are few, else by seeded probes of which only what the preconditioner misses is estimated.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from . import krylov
from .moments import moments
from .products import Design

#: Coordinates up to which variances come from solves for every unit vector; beyond, from so many probes.
EXACT, PROBES = 512, 64


@dataclass
class Posterior:
    x: np.ndarray
    variance: np.ndarray  #: of all coordinates, covariates first
    objective: float
    error: float


class Dense:
    """From sums of the whole matrix: one pass for a quantitative target, one for each Newton step of a binary one."""

    def __init__(self, rows: DataFrame, zero: np.ndarray, k: int, binary: bool):
        self.rows, self.zero, self.k, self.binary, self.at = rows, zero, k, binary, None
        if not binary:
            self.m, self.v, self.yy, self.n = moments(rows, zero)

    def first_error(self) -> float:
        return 1.0 if self.binary else max(float(self.yy / self.n - (self.v[0] / self.n) ** 2), 1e-12)

    def solve(self, precision: np.ndarray, x: np.ndarray, error: float, whole: bool) -> Posterior:
        """``whole``: to the tolerance, not only one step from ``x``."""
        if self.binary:
            x, hess, obj, self.at = penalized_logit(self.rows, self.zero, precision, x, steps=25 if whole else 1, at=self.at)
            return Posterior(x, np.diag(np.linalg.inv(hess)), obj, error)
        cov = np.linalg.inv(self.m / error + np.diag(precision))
        x = cov @ (self.v / error)
        ssr = float(self.yy - 2 * x @ self.v + x @ self.m @ x)
        obj = gaussian(self.n, error, ssr) - 0.5 * float(precision @ (x * x))
        return Posterior(x, np.diag(cov), obj, max((ssr + float(np.sum(self.m * cov))) / self.n, 1e-12))


class Sparse:
    """From products; ``blocks`` (places of variants that stand together, their Gram matrix) make the preconditioner."""

    def __init__(self, rows: DataFrame, zero: np.ndarray, k: int, binary: bool, blocks: list[tuple[np.ndarray, np.ndarray]] = (), tol: float = 1e-7, seed: int = 0):
        self.design, self.k, self.binary, self.tol = Design(rows, zero, k), k, binary, tol
        q = self.design.size
        own = self.design.gram(np.eye(q, k))[:k]  # the covariates' own block
        self.squares = np.concatenate([np.diag(own), self.design.squares()])
        self.blocks = [(np.arange(k), own), *[(np.asarray(at) + k, np.asarray(m, float)) for at, m in blocks]]
        self.probes = np.eye(q) if q <= EXACT else np.random.default_rng(seed).choice([-1.0, 1.0], (q, PROBES))
        self.solved: np.ndarray | None = None
        if not binary:
            self.v, self.yy, self.n = self.design.target()

    def first_error(self) -> float:
        return 1.0 if self.binary else max(float(self.yy / self.n - (self.v[0] / self.n) ** 2), 1e-12)

    def preconditioner(self, precision: np.ndarray, weight: float) -> krylov.BlockDiagonal:
        """Of weight X'X + diag(precision), block by block."""
        blocks = [(at, weight * m + np.diag(precision[at] + 1e-9 * weight * max(np.trace(m) / len(at), 1e-300))) for at, m in self.blocks]
        return krylov.BlockDiagonal(weight * self.squares + precision, blocks)

    def solve(self, precision: np.ndarray, x: np.ndarray, error: float, whole: bool) -> Posterior:
        if self.binary:
            got = trust_region(self.design, precision, x, self.preconditioner, steps=50 if whole else 1, tol=self.tol)
            m = self.preconditioner(precision, got.weight)
            return Posterior(got.x, self._variance(lambda v: self.design.gram(v, got.x) + precision[:, None] * v, m), got.objective, error)
        m = self.preconditioner(precision, 1 / error)
        apply = lambda v: self.design.gram(v) / error + precision[:, None] * v
        found = krylov.block_cg(apply, (self.v / error)[:, None], m, tol=self.tol, start=x[:, None])
        if found.status[0] != krylov.Status.CONVERGED:
            raise RuntimeError(f"the solve of the effects ended as {found.status[0].name}, residual {found.residuals[0]:.1e}")
        x = found.x[:, 0]
        variance = self._variance(apply, m)
        ssr = float(self.yy - 2 * x @ self.v + x @ self.design.gram(x[:, None])[:, 0])
        trace = error * float(np.sum(1 - precision * variance))
        return Posterior(x, variance, gaussian(self.n, error, ssr) - 0.5 * float(precision @ (x * x)), max((ssr + trace) / self.n, 1e-12))

    def _variance(self, apply: krylov.Apply, m: krylov.BlockDiagonal) -> np.ndarray:
        """The inverse's diagonal: by unit vectors exactly, else the preconditioner's own plus what probes see beyond it."""
        exact = self.probes.shape[0] == self.probes.shape[1]
        # Probes have their own error, so they need not be solved to the last digit.
        got = krylov.block_cg(apply, self.probes, m, tol=self.tol if exact else 1e-3, start=self.solved)
        if any(s == krylov.Status.INDEFINITE for s in got.status):
            raise RuntimeError("the posterior's precision is not positive definite")
        self.solved = got.x
        if exact:
            return np.diag(got.x)
        beyond = (self.probes * (got.x - m.solve(self.probes))).mean(axis=1)
        known = m.inverse_diagonal()
        return np.clip(known + beyond, 0.05 * known, None)

    def log_determinant(self, precision: np.ndarray, weight_at: np.ndarray | None, error: float = 1.0, probes: int = 32, steps: int = 20) -> tuple[float, float]:
        """log det of the posterior's precision, and its standard error: a pass a step for all probes."""
        w = self.design.slope(weight_at)[2] if weight_at is not None else 1 / error
        scale = 1.0 if weight_at is not None else 1 / error
        apply = lambda v: scale * self.design.gram(v, weight_at) + precision[:, None] * v
        return krylov.log_determinant(apply, self.design.size, self.preconditioner(precision, w), probes, steps)


def gaussian(n: int, error: float, squares: float) -> float:
    """Log-likelihood of n residuals with this sum of squares."""
    return -0.5 * (n * np.log(2 * np.pi * error) + squares / error)


def penalized_logit(rows: DataFrame, zero: np.ndarray, precision: np.ndarray, start: np.ndarray, steps: int = 25, tol: float = 1e-6, at: tuple | None = None) -> tuple[np.ndarray, np.ndarray, float, tuple]:
    """Damped Newton; every step is one pass over the samples. Returns the mode, its Hessian, the objective and the moments there.

    ``at``: the moments at ``start``, if they are known already.
    """
    x = start.copy()
    h, g, ll, _ = at or moments(rows, zero, x)
    obj = ll - 0.5 * float(precision @ (x * x))
    for _ in range(steps):
        hess = h + np.diag(precision) + 1e-9 * np.eye(len(x))
        move = np.linalg.solve(hess, g - precision * x)
        size = 1.0
        while True:
            new = x + size * move
            h2, g2, ll2, _ = moments(rows, zero, new)
            obj2 = ll2 - 0.5 * float(precision @ (new * new))
            if obj2 >= obj - 1e-9 or size < 1e-4:
                break
            size /= 2
        done = np.max(np.abs(new - x)) < tol * (1 + np.max(np.abs(x)))
        x, h, g, ll, obj = new, h2, g2, ll2, obj2
        if done:
            break
    return x, h + np.diag(precision), obj, (h, g, ll, 0)


@dataclass
class Mode:
    x: np.ndarray
    objective: float
    weight: float  #: mean logistic weight there
    gradient: float  #: preconditioned norm, relative to the first
    steps: int
    converged: bool


def trust_region(
    design: Design, precision: np.ndarray, start: np.ndarray, preconditioner: Callable[[np.ndarray, float], krylov.BlockDiagonal],
    steps: int = 50, tol: float = 1e-8, radius: float | None = None, most_products: int = 256,
) -> Mode:
    """Mode of the penalized logistic likelihood: Newton steps within a trust region, by products only.

    A step is as exact as the distance from the mode asks for (the residual falls with the root of the gradient),
    and takes no more products than conjugate gradients need for that at the condition seen so far.  The radius
    shrinks where the quadratic model promised too much, and grows where it held up to the edge.  With more than
    one step allowed, not getting to the tolerance is an error.
    """
    x = start.copy()
    g, ll, w, _ = design.slope(x)
    obj = ll - 0.5 * float(precision @ (x * x))
    m = preconditioner(precision, w)
    down = -(g - precision * x)
    size = float(np.linalg.norm(m.solve_lower(down)))
    first, condition, done = max(size, 1e-300), 10.0, 0
    scale = max(1.0, float(np.sqrt(abs(obj))))
    while size > tol * scale and done < steps:
        if radius is None:
            radius = 2 * size
        forcing = float(np.clip(np.sqrt(size / first) / 2, 1e-10, 0.1)) if steps > 1 else 1e-6
        step = krylov.region_step(lambda v: design.gram(v, x) + precision[:, None] * v, down, m, radius, forcing, krylov.inner_steps(forcing, 4 * condition, most=most_products))
        condition = max(condition, step.condition)
        new = x + step.move
        g2, ll2, w2, _ = design.slope(new)
        obj2 = ll2 - 0.5 * float(precision @ (new * new))
        # Near the mode both differences are rounding: then the model is trusted.
        gain = 1.0 if abs(step.model) <= 1e-12 * abs(obj) else (obj2 - obj) / step.model
        if gain < 0.25:
            radius = 0.25 * float(np.linalg.norm(m.upper(step.move)))
        elif gain > 0.75 and step.edge:
            radius *= 2
        done += 1
        if gain > 1e-4:
            before = m.upper(step.move)
            x, g, ll, w, obj = new, g2, ll2, w2, obj2
            m = preconditioner(precision, w)
            radius = max(radius, float(np.linalg.norm(before)) * 0.25)
            down = -(g - precision * x)
            size = float(np.linalg.norm(m.solve_lower(down)))
        elif radius < 1e-14 * (1 + float(np.linalg.norm(m.upper(x)))):
            break
    if steps > 1 and size > max(1e3 * tol, 1e-5) * scale:
        raise RuntimeError(f"the trust region did not get to the mode: gradient {size:.1e} after {done} steps")
    return Mode(x, obj, w, size / first, done, size <= tol * scale)
