"""Residuals and marginal scores with any number of covariates, collinear ones included.

The covariates' cross products are a fixed number of sums, taken in one pass and one row on the driver; a
pseudo-inverse solves the small system, and its coefficients go back into expressions.  Per variant only
sums over stored calls are shuffled: those of dosage, residual and each covariate.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Residuals:
    """``frame``: sample_id, r, c (intercept and covariates); the covariates' inverse cross products and sums."""

    frame: DataFrame
    coefficients: np.ndarray
    inverse: np.ndarray
    sums: np.ndarray
    sigma2: float
    n: int


def _weighted(c: Column, w: np.ndarray) -> Column:
    return sum((F.lit(float(x)) * c[i] for i, x in enumerate(w)), F.lit(0.0))


def residualize(samples: DataFrame, target: str, covariates: list[str]) -> Residuals:
    """Least squares of ``target`` on an intercept and ``covariates``; the variance divides by all samples."""
    c = F.array(F.lit(1.0), *[F.col(x).cast("double") for x in covariates])
    d = samples.select("sample_id", F.col(target).cast("double").alias("y"), c.alias("c"))
    k, at = 1 + len(covariates), F.col("c")
    places = [(i, j) for i in range(k) for j in range(i, k)]
    row = d.agg(*[F.sum(at[i] * at[j]) for i, j in places], *[F.sum(at[i] * F.col("y")) for i in range(k)], F.count("*")).first()
    gram = np.zeros((k, k))
    for (i, j), x in zip(places, row, strict=False):
        gram[i, j] = gram[j, i] = x or 0.0
    scale = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))
    inverse = np.linalg.pinv(gram / np.outer(scale, scale), rcond=1e-10, hermitian=True) / np.outer(scale, scale)
    coefficients = inverse @ np.array([x or 0.0 for x in row[len(places) : len(places) + k]])
    frame = d.select("sample_id", (F.col("y") - _weighted(at, coefficients)).alias("r"), "c")
    n = row[-1]
    sigma2 = (frame.agg(F.sum(F.col("r") * F.col("r"))).first()[0] or 0.0) / max(n, 1)
    return Residuals(frame, coefficients, inverse, gram[0], float(sigma2), int(n))


def marginal_z(calls: DataFrame, standardization: DataFrame, fitted: Residuals) -> DataFrame:
    """``variant_id, z``: standardized column times residual, over what the covariates leave of the column; 0 if nothing is left."""
    k, d, missing = len(fitted.sums), F.col("dosage"), F.col("dosage").isNull()
    joined = calls.join(fitted.frame, "sample_id")
    parts = {"r": F.col("r"), **{f"c{i}": F.col("c")[i] for i in range(k)}}
    sums = joined.groupBy("variant_id").agg(
        *[F.coalesce(F.sum(d * x), F.lit(0.0)).alias(f"{name}_dosage") for name, x in parts.items()],
        *[F.coalesce(F.sum(F.when(missing, x)), F.lit(0.0)).alias(f"{name}_missing") for name, x in parts.items()],
    )
    totals = {"r": 0.0, **{f"c{i}": float(x) for i, x in enumerate(fitted.sums)}}  # residuals sum to 0 beside an intercept
    s = sums.join(standardization.select("variant_id", "mean", "scale"), "variant_id")
    x = {name: (F.col(f"{name}_dosage") - F.col("mean") * (F.lit(total) - F.col(f"{name}_missing"))) / F.col("scale") for name, total in totals.items()}
    projection = sum((F.lit(float(fitted.inverse[i, j])) * x[f"c{i}"] * x[f"c{j}"] for i in range(k) for j in range(k)), F.lit(0.0))
    left = F.lit(fitted.sigma2) * (F.lit(float(fitted.n)) - projection)
    return s.select("variant_id", F.when(left <= 0, F.lit(0.0)).otherwise(x["r"] / F.sqrt(left)).alias("z"))
