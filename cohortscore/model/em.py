"""Empirical-Bayes regression fitted from sufficient statistics.

y = C a + Z b + e with b_j ~ N(0, (g s_j)^2 l_j).  Local scales l have generalized inverse-Gaussian
posteriors given their auxiliary rates, the global scale g a closed form.  A dense quantitative fit touches the
data once, a dense binary one once for each Newton step; a fit by products once for each of these.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from .blas import one_thread
from .krylov import Mixing
from .moments import moments
from .posterior import Dense, Sparse, gaussian
from .products import Design
from .special import digamma, gig_mean, log_gamma


@dataclass
class Fit:
    alpha: np.ndarray
    beta: np.ndarray
    beta_variance: np.ndarray
    sigma_error2: float
    global_scale: float
    local_scale: np.ndarray
    history: list[float] = field(default_factory=list)
    converged: bool = False
    losses: list[tuple[int, float]] = field(default_factory=list)
    scale_theta: np.ndarray | None = None
    shapes: np.ndarray | None = None


def closed_form_scale(second: np.ndarray, baseline: np.ndarray, local: np.ndarray, shape: float = 0.0, rate: float = 0.0, limits: tuple[float, float] = (1e-8, 1e8)) -> float:
    """Global scale g at the mode of its conditional: g^2 is inverse gamma, with p/2 added to ``shape`` and half the sum of scaled squares to ``rate``."""
    prior_variance = np.square(baseline) * local
    used = prior_variance > 0
    squares = np.divide(second, prior_variance, out=np.zeros(len(second)), where=used).sum()
    mode = (rate + squares / 2) / (shape + used.sum() / 2 + 1)
    return float(min(max(mode**0.5, limits[0]), limits[1]))


def local_step(second: np.ndarray, base2: np.ndarray, delta: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One update of the local scales and their auxiliary rates."""
    lam = np.clip(gig_mean(a - 0.5, np.maximum(second / base2, 1e-12), 2 * np.maximum(delta, 1e-12)), 1e-10, 1e10)
    return lam, (a + b) / (1 + lam)


def fit(
    rows: DataFrame, zero: np.ndarray, k: int, baseline: np.ndarray, a: np.ndarray, b: np.ndarray, binary: bool = False, iterations: int = 30, tol: float = 1e-4,
    scale_design: np.ndarray | None = None, membership: np.ndarray | None = None, validation: DataFrame | None = None, holdout_only: bool = False, validate_every: int = 10,
    state: dict | None = None, keep: Callable[[dict], None] | None = None, keep_every: int = 10,
    products: bool = False, blocks: list[tuple[np.ndarray, np.ndarray]] = (), mixing: int = 0,
) -> Fit:
    """Fit k covariates (intercept first) and p variants; no variants gives the covariates alone.

    ``scale_design`` (p x q, no intercept: the global scale is one) makes prior scales ``baseline * exp(design @ theta)``
    with theta learned; ``membership`` (p x classes, rows that sum to 1) makes each class's two shapes learned, from the
    class's mean of ``a`` and ``b``.  ``validation`` rows are scored every ``validate_every`` iterations and at the end;
    the iterate of the least loss is returned, but for ``holdout_only``, which scores and never selects.  A binary
    iterate is scored with its intercept moved to the training cases' share.  ``keep`` is given what the next iteration
    starts from every ``keep_every`` iterations; as ``state``, it goes on from there.

    ``products`` fits by products of the design alone, without a p x p matrix, preconditioned by ``blocks`` (places of
    variants, their Gram matrix).  ``mixing`` so many past iterations accelerate the outer loop (Anderson); a jump after
    which an iteration moves the scales twice as far as the one before is taken back.  (The local scales' steps climb
    no objective that could be watched instead.)
    """
    one_thread()
    p = len(zero)
    was = state or {}
    lam, delta = np.asarray(was.get("lam", np.ones(p)), float), np.asarray(was.get("delta", (a + b) / 2.0), float)
    # A start far below the effects' size would be a fixed point of its own: begin as if variants explained a quarter.
    g = was.get("g", float(np.sqrt(0.25 / p) / np.sqrt(np.mean(baseline**2))) if p else 0.0)
    alpha, beta, var = np.zeros(k), np.zeros(p), np.full(p, 1e-4)
    history: list[float] = list(was.get("history", []))
    losses: list[tuple[int, float]] = [(int(i), float(x)) for i, x in was.get("losses", [])]
    best = was.get("best")
    theta = np.asarray(was.get("theta", np.zeros(0 if scale_design is None else scale_design.shape[1])), float)
    shapes0 = None if membership is None else (membership.T @ np.column_stack([a, b])) / np.maximum(membership.sum(0), 1e-12)[:, None]
    shapes = np.asarray(was["shapes"], float) if was.get("shapes") is not None else shapes0
    converged = False
    posterior = Sparse(rows, zero, k, binary, list(blocks)) if products else Dense(rows, zero, k, binary)
    err = was.get("err", posterior.first_error())
    mix, plain, level = Mixing(mixing, was.get("mixing")), was.get("plain"), was.get("level") or np.inf
    held = moments(validation, zero) if validation is not None and not binary and not products else None

    def loss(x: np.ndarray) -> float:
        if held is not None:
            vm, vv, vyy, count = held
            return float(vyy - 2 * x @ vv + x @ vm @ x) / count
        moved = x.copy()
        if binary:
            moved[0] += intercept_shift(rows, zero, x)
        total, count = Design(validation, zero, k).loss(moved, binary)
        return total / count

    x = np.asarray(was.get("x", np.zeros(k + p)), float)
    for it in range(was.get("iteration", 0), iterations):
        scales = baseline if scale_design is None else baseline * np.exp(scale_design @ theta)
        if shapes is not None:
            a, b = (membership @ shapes).T
        tau = np.maximum((g * scales) ** 2 * lam, 1e-12)
        precision = np.concatenate([np.full(k, 1e-8), 1 / tau])
        before = x
        # Later iterations move the prior little: one Newton step each, from what is known of the last point.
        started = err
        got = posterior.solve(precision, x, err, whole=it < 3)
        x, obj, err = got.x, got.objective, got.error
        alpha, beta, var = x[:k], x[k:], np.maximum(got.variance[k:], 1e-15)
        history.append(obj)
        converged = bool(it > 2 and np.max(np.abs(x - before)) < tol * (1 + np.max(np.abs(x))))
        if validation is not None and (converged or it + 1 == iterations or (it + 1) % validate_every == 0):
            losses.append((it, loss(x)))
            if best is None or losses[-1][1] < best["loss"]:
                best = {"loss": losses[-1][1], "x": x.tolist(), "var": var.tolist(), "err": err, "g": g, "lam": lam.tolist(), "shapes": None if shapes is None else shapes.tolist(), "theta": theta.tolist()}
        if it >= 1 and p:  # hyperparameters move from the second iteration on
            here = np.log(np.concatenate([lam, delta, [g], [started]]))
            second = beta**2 + var
            lam, delta = local_step(second, (g * scales) ** 2, delta, a, b)
            g = closed_form_scale(second, scales, lam)
            if scale_design is not None:
                theta = scale_weights(scale_design, second / np.maximum((g * baseline) ** 2 * lam, 1e-300), theta)
            if membership is not None:
                shapes = class_shapes(lam, membership, shapes0, shapes)
            if mixing and it >= 2 and not converged:
                image = np.log(np.concatenate([lam, delta, [g], [err]]))
                off = float(np.linalg.norm(image - here))
                if off > 2 * level and plain is not None:
                    # The jump led away from the fixed point: on from the image before it, and the past is forgotten.
                    image = np.asarray(plain)
                    mix.forget()
                    plain, level = None, np.inf
                    jump = image
                else:
                    level, plain = off, image.tolist()
                    jump = np.clip(mix.propose(here, image), image - 0.5, image + 0.5)
                lam, delta, g = np.exp(jump[:p]), np.exp(jump[p : 2 * p]), float(np.exp(jump[-2]))
                err = err if binary else float(np.exp(jump[-1]))
        if converged:
            break
        if keep and (it + 1) % keep_every == 0:
            keep({"iteration": it + 1, "x": x.tolist(), "lam": lam.tolist(), "delta": delta.tolist(), "g": g, "err": err, "theta": theta.tolist(),
                  "shapes": None if shapes is None else shapes.tolist(), "history": history, "losses": losses, "best": best,
                  **({"mixing": mix.state(), "plain": plain, "level": level if np.isfinite(level) else None} if mixing else {})})
    if best is not None and not holdout_only:
        x, var, lam, theta = (np.asarray(best[name], float) for name in ("x", "var", "lam", "theta"))
        alpha, beta, err, g = x[:k], x[k:], best["err"], best["g"]
        shapes = None if best["shapes"] is None else np.asarray(best["shapes"], float)
    return Fit(alpha, beta, var, err, g, lam, history, converged, losses, theta, shapes)


def bound(rows: DataFrame, zero: np.ndarray, x: np.ndarray, variance: np.ndarray, tau: np.ndarray, k: int, error: float | None = None) -> dict[str, float]:
    """The variational bound of a fit: its data term, the effects' prior term, their entropy, and the sum.

    With ``error`` the likelihood is Gaussian, without it logistic, at each sample's best local parameter; the
    samples' predictors and their variances are computed where the rows lie.  ``variance`` and ``tau`` are of the p
    variants; covariates count as known.
    """
    design = Design(rows, zero, k)
    logistic, spread = design.bound(x, variance)
    if error is None:
        data = logistic
    else:
        squares, n = design.loss(x, binary=False)
        data = gaussian(n, error, squares + spread)
    used = variance > 0
    prior = float(-0.5 * np.sum(np.log(2 * np.pi * tau) + (x[k:] ** 2 + variance) / tau))
    entropy = float(0.5 * np.sum(np.log(2 * np.pi * np.e * variance[used])))
    return {"data": data, "prior": prior, "entropy": entropy, "bound": data + prior + entropy}


def scale_weights(design: np.ndarray, ratio: np.ndarray, start: np.ndarray, ridge: float = 1.0, steps: int = 100) -> np.ndarray:
    """theta of log prior scales ``design @ theta``: the mode of sum(-u - ratio exp(-2 u) / 2) - ridge |theta|^2 / 2, which is concave."""
    theta = start.copy()

    def value(t: np.ndarray) -> float:
        u = design @ t
        return float(-(u + 0.5 * ratio * np.exp(np.clip(-2 * u, -700, 700))).sum() - 0.5 * ridge * t @ t)

    now = value(theta)
    for _ in range(steps):
        w = ratio * np.exp(np.clip(-2 * (design @ theta), -700, 700))
        slope = design.T @ (w - 1) - ridge * theta
        move = np.linalg.solve(2 * (design * w[:, None]).T @ design + ridge * np.eye(len(theta)), slope)
        size = 1.0
        while (new := value(theta + size * move)) < now and size > 1e-6:
            size /= 2
        if new <= now + 1e-12 * abs(now):
            break
        theta, now = theta + size * move, new
    return theta


def class_shapes(local: np.ndarray, membership: np.ndarray, prior: np.ndarray, start: np.ndarray, weight: float = 10.0, limits: tuple[float, float] = (0.05, 20.0), steps: int = 100) -> np.ndarray:
    """The two shapes of each class (rows a, b) at the mode given local scales, which have density l^(a-1) (1+l)^-(a+b) / B(a, b).

    A variant counts in each class by its membership; log shapes have normal priors around ``prior`` with precision
    ``weight``, so a class without variants keeps its prior.  Projected gradient steps with halving, within ``limits``.
    """
    n, logs, tails = membership.sum(0), membership.T @ np.log(local), membership.T @ np.log1p(local)
    low, high = np.log(limits)
    centre = np.clip(np.log(prior), low, high)

    def value(u: np.ndarray) -> np.ndarray:
        a, b = np.exp(u).T
        return (a - 1) * logs - (a + b) * tails - n * (log_gamma(a) + log_gamma(b) - log_gamma(a + b)) - 0.5 * weight * ((u - centre) ** 2).sum(1)

    u = np.clip(np.log(start), low, high)
    now, size = value(u), 1 / (n + weight)
    for _ in range(steps):
        a, b = np.exp(u).T
        both = digamma(a + b)
        slope = np.column_stack([a * (logs - tails - n * (digamma(a) - both)), b * (-tails - n * (digamma(b) - both))]) - weight * (u - centre)
        new = np.clip(u + size[:, None] * slope, low, high)
        got = value(new)
        better = got >= now
        moved = np.abs(new - u).max() if better.all() else np.inf
        u, now = np.where(better[:, None], new, u), np.where(better, got, now)
        size = np.where(better, 1.5 * size, size / 2)
        if moved < 1e-8:
            break
    return np.exp(u)


def intercept_shift(rows: DataFrame, zero: np.ndarray, x: np.ndarray, steps: int = 20, tol: float = 1e-9) -> float:
    """What to add to the intercept so that the mean probability equals the cases' share; a pass a step."""
    x, start = x.copy(), x[0]
    design = Design(rows, zero, len(x) - len(zero))
    for _ in range(steps):
        g, _, w, n = design.slope(x)
        x[0] += np.clip(g[0] / max(w * n, 1e-12), -5, 5)
        if abs(g[0]) <= tol * n:
            break
    return float(x[0] - start)
