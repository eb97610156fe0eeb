"""Learned prior scales and shapes, choice of an iterate by validation rows, and going on from a kept state."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortscore.model import em
from cohortscore.model.special import digamma


def test_digamma_is_the_derivative_of_log_gamma():
    x = np.array([0.05, 0.5, 1.0, 3.3, 40.0])
    h = 1e-5 * x
    slope = [(math.lgamma(a + d) - math.lgamma(a - d)) / (2 * d) for a, d in zip(x, h, strict=True)]
    assert np.allclose(digamma(x), slope, rtol=1e-6)
    assert digamma(np.array(1.0)) == pytest.approx(-np.euler_gamma, abs=1e-9)


def test_scale_weights_recovers_theta():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((20_000, 2))
    ratio = np.exp(2 * x @ [0.4, -0.7]) * rng.chisquare(1, 20_000)
    assert np.allclose(em.scale_weights(x, ratio, np.zeros(2)), [0.4, -0.7], atol=0.02)
    assert np.allclose(em.scale_weights(x, ratio, np.array([3.0, 3.0])), [0.4, -0.7], atol=0.02)  # concave: any start


def test_class_shapes_recovers_and_keeps_priors():
    rng = np.random.default_rng(2)
    truth = np.array([[1.5, 0.8], [0.6, 2.0], [1.0, 1.0]])
    lam = np.concatenate([rng.gamma(a, 1, 30_000) / rng.gamma(b, 1, 30_000) for a, b in truth[:2]])
    member = np.zeros((60_000, 3))
    member[:30_000, 0] = member[30_000:, 1] = 1
    got = em.class_shapes(lam, member, np.ones((3, 2)), np.ones((3, 2)))
    assert np.allclose(got[:2], truth[:2], rtol=0.05) and np.allclose(got[2], 1)  # a class without variants
    soft = em.class_shapes(lam, np.full((60_000, 2), 0.5), np.ones((2, 2)), np.ones((2, 2)))
    assert np.allclose(soft[0], soft[1])
    assert (em.class_shapes(lam, member, np.ones((3, 2)), np.ones((3, 2)), limits=(0.9, 1.1)) <= 1.1 + 1e-12).all()


def _rows(spark, n, p, seed, binary):
    """Rows of a design, effects ten times as large where the scale's covariate is 1."""
    rng = np.random.default_rng(seed)
    beta = np.where(np.arange(p) % 2, 0.6, 0.02) * np.random.default_rng(9).choice([-1, 1], p)
    z = rng.standard_normal((n, p))
    eta = 0.3 + z @ beta
    y = (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(float) if binary else eta + rng.standard_normal(n)
    data = [([1.0], float(b), list(range(p)), a.tolist()) for a, b in zip(z, y, strict=True)]
    return spark.createDataFrame(data, "c array<double>, y double, at array<int>, z array<double>").repartition(2).persist(), beta


@pytest.mark.parametrize("binary", [False, True])
def test_learned_scales_validation_and_resuming(spark, binary):
    p = 12
    rows, beta = _rows(spark, 500, p, 4, binary)
    other, _ = _rows(spark, 300, p, 5, binary)
    zero, base, ones = np.zeros(p), np.full(p, 0.1), np.ones(p)
    design, member = (np.arange(p) % 2).astype(float)[:, None], np.eye(2)[np.arange(p) % 2]
    kept = []
    args = {"binary": binary, "iterations": 12, "tol": 0.0, "scale_design": design, "membership": member}
    got = em.fit(rows, zero, 1, base, ones, ones / 2, validation=other, validate_every=4, keep=lambda s: kept.append(json.loads(json.dumps(s))), keep_every=4, **args)
    assert got.scale_theta[0] > 0.2 and got.shapes.shape == (2, 2)
    assert np.corrcoef(got.beta, beta)[0, 1] > 0.9 and len(got.history) == 12
    assert [i for i, _ in got.losses] == [3, 7, 11] and [s["iteration"] for s in kept] == [4, 8, 12]
    again = em.fit(rows, zero, 1, base, ones, ones / 2, validation=other, validate_every=4, state=kept[0], **args)
    assert np.allclose(again.beta, got.beta, atol=1e-8) and np.allclose(again.history, got.history) and np.allclose(again.losses, got.losses)
    # A holdout is scored, and changes nothing.
    alone = em.fit(rows, zero, 1, base, ones, ones / 2, **args)
    watched = em.fit(rows, zero, 1, base, ones, ones / 2, validation=other, holdout_only=True, validate_every=4, **args)
    assert np.allclose(alone.beta, watched.beta, atol=1e-10) and len(watched.losses) == 3


def test_the_iterate_of_least_validation_loss_is_returned(spark):
    rows, _ = _rows(spark, 200, 6, 6, False)
    # Effects of the other sign: the more the fit has learned, the worse it does on these rows.
    wrong = rows.withColumn("y", 0.6 - F.col("y"))
    zero, base, ones = np.zeros(6), np.full(6, 0.001), np.ones(6)
    got = em.fit(rows, zero, 1, base, ones, ones / 2, iterations=9, tol=0.0, validation=wrong, validate_every=1)
    least = min(got.losses, key=lambda x: x[1])[0]
    stopped = em.fit(rows, zero, 1, base, ones, ones / 2, iterations=least + 1, tol=0.0)
    assert np.allclose(got.beta, stopped.beta, atol=1e-10) and got.global_scale > 0
