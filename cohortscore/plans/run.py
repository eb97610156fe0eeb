"""A full run: load, screen, fit, score, evaluate, and keep what is needed to do none of it twice."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortscore.functions import parse  # noqa: F401
from cohortscore.model import em
from cohortscore.model.moments import design
from cohortscore.operators import joins, linalg, metrics, regression, stats  # noqa: F401
from cohortscore.operators.annotations import dense_design
from cohortscore.sources import tables
from cohortscore.sources.dataset import Dataset, contents

from .relation import RELATIONS, build
from . import special
from .special import CLASS_PRIORS

#: Iterations between two kept states of a fit; variants up to which a fit is dense by itself.
KEEP_EVERY, DENSE = 20, 4096


def split(samples: DataFrame, share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and test samples, by a hash of the id."""
    part = F.substring(F.sha2(F.concat(F.lit(f"cohort/split/seed={seed}|"), F.col("sample_id").cast("string")), 256), 1, 15)
    test = F.conv(part, 16, 10).cast("double") < share * float(16**15)
    return samples.where(~test), samples.where(test)


def carved(train: DataFrame, share: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Rows to fit and rows to choose an iterate by, from the training samples alone: the test samples choose nothing."""
    return split(train, share, seed + 1)


def scale_design(classes: list[str], lengths: list[float]) -> np.ndarray:
    """Columns of a variant's class (the most frequent one has none: no intercept) and its standardized log length."""
    names = sorted(set(classes), key=lambda c: (-classes.count(c), c))[1:]
    log = np.log(np.maximum(np.array(lengths, float), 1.0))
    spread = log.std()
    own = (log - log.mean()) / spread if spread > 0 else np.zeros(len(log))
    return np.column_stack([np.array([[float(c == n) for n in names] for c in classes]).reshape(len(classes), len(names)), own])


def keep_state(spark: SparkSession, path: str, settings: dict, state: dict) -> None:
    """Write a fit's state to one of two places in turn, so that a whole one is always there."""
    row = (tables.fingerprint(settings), state["iteration"], json.dumps(state))
    spark.createDataFrame([row], "fingerprint string, iteration long, state string").coalesce(1).write.mode("overwrite").json(f"{path}/{state['iteration'] // KEEP_EVERY % 2}")


def kept_state(spark: SparkSession, path: str, settings: dict) -> dict | None:
    """The latest whole state of a fit with these settings."""
    found = []
    for place in (0, 1):
        try:
            found += spark.read.schema("fingerprint string, iteration long, state string").json(f"{path}/{place}").collect()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    same = [r for r in found if r["fingerprint"] == tables.fingerprint(settings)]
    return json.loads(max(same, key=lambda r: r["iteration"])["state"]) if same else None


def history(spark: SparkSession, fitted: em.Fit) -> DataFrame:
    """``iteration, objective, validation_loss`` (null where none was taken): one row an iteration."""
    losses = dict(fitted.losses)
    return spark.createDataFrame([(i, float(x), losses.get(i)) for i, x in enumerate(fitted.history)], "iteration int, objective double, validation_loss double")


def score(data: Dataset, standardization: DataFrame, coefficients: DataFrame, alpha: list[float], covariates: list[str], samples: DataFrame, binary: bool) -> DataFrame:
    """``sample_id, target, genetic_score, covariate_score, linear_predictor, prediction`` with training means and scales."""
    spark = samples.sparkSession
    effects = coefficients.where("beta <> 0").select("variant_id", "beta")
    calls = data.calls.join(samples.select("sample_id"), "sample_id", "left_semi")
    plain = RELATIONS["score"](spark, {"intercept": 0.0, "slope": 0.0}, samples=samples.select("sample_id", "target", F.col("target").alias("y"), F.lit(0.0).alias("cov")), calls=calls, standardization=standardization, effects=effects)
    own = sum((F.lit(float(a)) * F.col(c) for a, c in zip(alpha[1:], covariates, strict=True)), F.lit(float(alpha[0])))
    both = plain.select("sample_id", "target", F.coalesce("genetic_score", F.lit(0.0)).alias("genetic_score")).join(samples.select("sample_id", own.alias("covariate_score")), "sample_id")
    eta = both.withColumn("linear_predictor", F.col("genetic_score") + F.col("covariate_score"))
    return eta.withColumn("prediction", 1 / (1 + F.exp(-F.col("linear_predictor"))) if binary else F.col("linear_predictor"))


def evaluate(scored: DataFrame, binary: bool) -> DataFrame:
    """One row of measures of ``scored``."""
    spark = scored.sparkSession
    if not binary:
        m = scored.agg(F.avg("target").alias("mean")).first()["mean"] or 0.0
        left, all_ = F.sum((F.col("target") - F.col("prediction")) ** 2), F.sum((F.col("target") - m) ** 2)
        return scored.agg(F.count("*").alias("n"), (1 - left / all_).alias("r2"), F.sqrt(left / F.count("*")).alias("rmse"))
    made = {"predictions_in": scored.select("sample_id", F.col("target").cast("int").alias("target"), F.col("target").alias("y"), F.col("linear_predictor").alias("score"))}
    row = scored.agg(F.count("*").alias("n"))
    for name in ("auc", "average_precision", "binary_metrics", "top_tail"):
        row = row.join(build(spark, "", name, made))
    return row


def evaluate_output(spark: SparkSession, output: str, test_only: bool = True) -> dict:
    """Measures of a complete run's predictions, of its test samples or of all."""
    summary = json.loads(spark.read.json(f"{output}/summary").first()["summary"])
    kept = spark.read.csv(f"{output}/predictions", sep="\t", header=True)
    numbers = [c for c in kept.columns if c != "sample_id"]
    scored = kept.select("sample_id", *[F.col(c).cast("double").alias(c) for c in numbers])
    row = evaluate(split(scored, seed=summary["seed"])[1] if test_only else scored, summary["binary"]).first()
    return row.asDict() if row else {}


def validate(data: Dataset, covariates: list[str]) -> None:
    """Raise on what no fit can use: no samples, numbers that are not finite, calls without keys or beyond 0 to 2."""
    numbers = ["target", *covariates]
    bad = data.samples.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))).alias(f"bad_{i}") for i, c in enumerate(numbers)]).first()
    if not bad["n"]:
        raise ValueError("no samples to fit")
    if lost := [c for i, c in enumerate(numbers) if bad[f"bad_{i}"]]:
        raise ValueError(f"not finite: {', '.join(lost)}")
    calls = RELATIONS["validate_inputs"](data.calls.sparkSession, calls=data.calls).first()
    if calls["n_bad_dosage"] or calls["n_null_keys"]:
        raise ValueError(f"{calls['n_bad_dosage']} calls are beyond 0 to 2, {calls['n_null_keys']} have no sample or variant")


def run(spark: SparkSession, data: Dataset, covariates: list[str], output: str, trait: str = "auto", minimum_maf: float = 0.01, least_z: float = 0.0, iterations: int = 1000, seed: int = 42, validation_share: float = 0.0, learn_priors: bool = False, solver: str = "auto", annotations: DataFrame | None = None) -> dict:
    """Fit on the training samples and write coefficients, scores, history, evaluation and, last, the summary to ``output``.

    A summary of equal settings and inputs (target, call files, sample table, metadata) means that the run is complete:
    then nothing is done again; a run that was broken off goes on from its last kept state.  ``validation_share`` of the training samples choose the iterate;
    ``learn_priors`` learns prior scales from class and length, and each class's shapes; with ``annotations``
    (variant_id and columns of any kind), from class and these instead.  ``solver`` is ``dense`` (the
    matrix of all variants on the driver), ``products`` (none, but more passes over the samples) or ``auto``: dense up
    to ``DENSE`` variants.
    """
    settings = {"covariates": covariates, "trait": trait, "minimum_maf": minimum_maf, "least_z": least_z, "iterations": iterations, "seed": seed, "validation_share": validation_share, "learn_priors": learn_priors, "solver": solver, "inputs": data.origin, "annotations": contents(annotations) if annotations is not None else None}
    try:
        kept = spark.read.json(f"{output}/summary").first()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        kept = None
    if kept and kept["fingerprint"] == tables.fingerprint(settings):
        return json.loads(kept["summary"])
    validate(data, covariates)
    train, test = split(data.samples, seed=seed)
    train, chosen_by = carved(train, validation_share, seed) if validation_share > 0 else (train, None)
    binary = trait == "binary" or (trait == "auto" and data.samples.where(~F.col("target").isin(0.0, 1.0)).isEmpty())
    made = {"calls": data.calls.join(train.select("sample_id"), "sample_id", "left_semi"), "samples": train}
    standardization = build(spark, "", "standardization", made)
    made["sites"] = data.variants.select("variant_id")
    keep = RELATIONS["maf_filter"](spark, {"threshold": minimum_maf}, maf=build(spark, "", "maf", made)).select("variant_id")
    if least_z > 0:
        z = regression.marginal_z(made["calls"], standardization, regression.residualize(train, "target", covariates))
        screen = RELATIONS["marginal_screen"](spark, {"least": least_z, "protect_structural": True}, z_scores=z, variants=data.variants)
        keep = keep.join(screen.select("variant_id"), "variant_id", "left_semi")
    few = standardization.join(keep, "variant_id", "left_semi")
    rows, ids, zero = design(made["calls"], few, train, covariates, "target", key="string")
    rows = rows.persist()
    known = {r["variant_id"]: r for r in data.variants.join(few, "variant_id", "left_semi").select("variant_id", "variant_class", F.col("length").cast("double").alias("length")).collect()}
    classes = [known[v]["variant_class"] or "snv" for v in ids]
    shapes = np.array([CLASS_PRIORS[c] for c in classes]).reshape(-1, 3)
    more = {}
    if (learn_priors or annotations is not None) and ids:
        names = sorted(set(classes))
        features = scale_design(classes, [known[v]["length"] or 1.0 for v in ids])
        if annotations is not None:
            features = np.column_stack([features[:, :-1], dense_design(annotations, ids)[0]])
        more = {"scale_design": features, "membership": np.array([[float(c == n) for n in names] for c in classes])}
    if chosen_by is not None:
        seen = data.calls.join(chosen_by.select("sample_id"), "sample_id", "left_semi")
        more["validation"] = design(seen, few, chosen_by, covariates, "target", key="string")[0].persist()
    products = solver == "products" or (solver == "auto" and len(ids) > DENSE)
    if products:
        more["blocks"] = special.gram_blocks(spark, made["calls"], few, train, ids)
    fitted = em.fit(
        rows, zero, 1 + len(covariates), np.exp(shapes[:, 0]), shapes[:, 1], shapes[:, 2], binary=binary, iterations=iterations, products=products, mixing=special.MIXED, **more,
        state=kept_state(spark, f"{output}/state", settings), keep=lambda s: keep_state(spark, f"{output}/state", settings, s), keep_every=KEEP_EVERY,
    )
    if "validation" in more:
        more["validation"].unpersist()
    alpha = list(map(float, fitted.alpha))
    if binary:
        alpha[0] += em.intercept_shift(rows, zero, np.concatenate([fitted.alpha, fitted.beta]))
    class_scale = np.exp(shapes[:, 0]) * (np.exp(more["scale_design"] @ fitted.scale_theta) if "scale_design" in more else 1.0)
    elbo = em.bound(rows, zero, np.concatenate([alpha, fitted.beta]), fitted.beta_variance, np.maximum((fitted.global_scale * class_scale) ** 2 * fitted.local_scale, 1e-12), 1 + len(covariates), None if binary else fitted.sigma_error2)
    rows.unpersist()
    coefficients = spark.createDataFrame([(v, float(b), float(s)) for v, b, s in zip(ids, fitted.beta, fitted.beta_variance, strict=True)], "variant_id string, beta double, beta_variance double")
    tables.save_artifact(f"{output}/artifact", coefficients, settings | {"alpha": alpha})
    scored = score(data, few, coefficients, alpha, covariates, data.samples, binary)
    tables.write_table(scored, f"{output}/predictions")
    tables.write_table(history(spark, fitted), f"{output}/history")
    measures = evaluate(scored.join(test.select("sample_id"), "sample_id", "left_semi"), binary)
    measures.coalesce(1).write.mode("overwrite").json(f"{output}/evaluation")
    found = spark.read.json(f"{output}/evaluation").first()
    summary = {"binary": binary, "seed": seed, "n_train": train.count(), "n_test": test.count(), "n_variants": len(ids), "iterations": len(fitted.history), "converged": fitted.converged, "alpha": alpha, "elbo": elbo, "solver": "products" if products else "dense", "test": found.asDict() if found else {}}
    done = spark.createDataFrame([(tables.fingerprint(settings), json.dumps(summary))], "fingerprint string, summary string")
    done.coalesce(1).write.mode("overwrite").json(f"{output}/summary")
    return summary
