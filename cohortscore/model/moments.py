"""Sufficient statistics of a regression, summed on the executors.

Samples become rows of a dense design (covariates, then p reduced variants) inside an Arrow batch; each
task returns one (k + p)^2 matrix, tasks are added up in two steps, and only the sum reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def design(calls: DataFrame, standardization: DataFrame, samples: DataFrame, covariates: list[str], target: str, key: str = "long") -> tuple[DataFrame, list[int], np.ndarray]:
    """(rows: c, y, at, z), the variants in column order, and each column's value for an absent call.

    ``standardization`` (variant_id, mean, scale) holds the reduced variants only: it is what the model's
    p x p matrix is made of, so it is small enough to collect.  ``key`` is the type of variant ids.
    """
    kept = sorted(standardization.select("variant_id", "mean", "scale").collect(), key=lambda r: r["variant_id"])
    ids = [r["variant_id"] for r in kept]
    zero = np.array([-r["mean"] / r["scale"] for r in kept])
    spark = calls.sparkSession
    places = spark.createDataFrame([(r["variant_id"], i, r["mean"], r["scale"]) for i, r in enumerate(kept)], f"variant_id {key}, at int, mean double, scale double")
    z = F.coalesce((F.col("dosage") - F.col("mean")) / F.col("scale"), F.lit(0.0))
    sparse = calls.join(places, "variant_id").groupBy("sample_id").agg(F.collect_list(F.struct("at", z.alias("z"))).alias("cells"))
    rows = samples.join(sparse, "sample_id", "left").select(
        "sample_id", F.array(F.lit(1.0), *[F.col(c).cast("double") for c in covariates]).alias("c"), F.col(target).cast("double").alias("y"),
        F.col("cells.at").alias("at"), F.col("cells.z").alias("z"),
    )
    return rows, ids, zero


def _matrix(b: pa.RecordBatch, zero: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    c = np.array(b.column("c").to_pylist(), float)
    x = np.hstack([c, np.tile(zero, (len(c), 1))])
    k = c.shape[1]
    at, z = b.column("at"), b.column("z")
    row = np.repeat(np.arange(len(c)), pc.fill_null(pc.list_value_length(at), 0).to_numpy(zero_copy_only=False))
    x[row, k + at.flatten().to_numpy()] = z.flatten().to_numpy()
    return x, b.column("y").to_numpy(zero_copy_only=False).astype(float)


def moments(rows: DataFrame, zero: np.ndarray, beta: np.ndarray | None = None, parts: int = 16) -> tuple[np.ndarray, np.ndarray, float, int]:
    """X'WX, X'r, objective, n.

    Without ``beta``: W = 1, r = y, objective = y'y.  With it: the logistic weights, residuals and
    log-likelihood at the predictor X beta.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                x, y = _matrix(b.slice(lo, 2048), zero)
                if beta is None:
                    w, r, obj = np.ones(len(y)), y, float(y @ y)
                else:
                    eta = x @ beta
                    mu = 0.5 * (1 + np.tanh(eta / 2))
                    w, r, obj = mu * (1 - mu), y - mu, float((y * eta - np.logaddexp(0, eta)).sum())
                flat = np.concatenate([((x * w[:, None]).T @ x).ravel(), x.T @ r, [obj, len(y)]])
                total = flat if total is None else total + flat
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"m": [sum(np.frombuffer(x) for x in pdf["m"]).tobytes()]})

    sums = rows.mapInArrow(run, "m binary").withColumn("part", F.spark_partition_id() % parts).groupBy("part").applyInPandas(add, "m binary").collect()
    flat = sum(np.frombuffer(r["m"]) for r in sums)
    d = int(round((-1 + np.sqrt(1 + 4 * (len(flat) - 2))) / 2))
    return flat[: d * d].reshape(d, d), flat[d * d : d * d + d], float(flat[-2]), int(round(flat[-1]))
