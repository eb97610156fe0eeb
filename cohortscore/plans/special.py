"""Queries that are not one SQL text: iterative, sequential or file-shaped operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortscore.model import em, krylov
from cohortscore.model.moments import design
from cohortscore.model.posterior import Sparse
from cohortscore.model.products import Design
from cohortscore.operators import annotations, components, regression
from cohortscore.sources import bed, vcf

from .relation import RELATIONS, build, oracle, relation

#: Log baseline scale and the two shapes of each variant class's prior.
CLASS_PRIORS = {
    "snv": (-4.5, 1.0, 0.5),
    "small_indel": (-4.2, 0.9, 0.5),
    "deletion_short": (-3.8, 0.7, 0.45),
    "deletion_long": (-3.3, 0.6, 0.4),
    "duplication_short": (-3.7, 0.7, 0.45),
    "duplication_long": (-3.3, 0.6, 0.4),
    "insertion_mei": (-3.6, 0.65, 0.42),
    "inversion_bnd_complex": (-3.1, 0.55, 0.38),
    "str_vntr_repeat": (-3.5, 0.6, 0.4),
    "other_complex_sv": (-3.3, 0.6, 0.4),
}

#: The fit's MAF filter (the reference's default; the query maf_filter has its own), and when a fit that meets no tolerance raises.
MINIMUM_MAF, MOST_ITERATIONS = 0.01, 1000
#: Past iterations that accelerate a fit's outer loop.
MIXED = 8
#: Sample ids whose places are ranked together.
PLACE_RANGE = 4096


def sv_event_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    made: dict[str, DataFrame] = {}
    return components.clusters(build(spark, sf_dir, "events_sv", made), build(spark, sf_dir, "sv_event_edges", made)).select("variant_id", "cluster", "representative")


def sv_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sv_event_clusters(spark, sf_dir).select(F.col("representative").alias("variant_id")).distinct()


def places(samples: DataFrame) -> DataFrame:
    """``sample_id, ordinal``: places from 0 by id; ids are counted by ranges, and ranked within one."""
    ids = samples.select("sample_id", F.floor(F.col("sample_id") / PLACE_RANGE).alias("range"))
    counts = ids.groupBy("range").agg(F.count("*").alias("n"))
    before = counts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("range").orderBy("sample_id"))
    return ids.join(before, "range").select("sample_id", (F.col("before") + rank - 1).alias("ordinal"))


def vcf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call-file lines of all variants (the inverse of the scan); a line is filled from its carriers and missing calls."""
    made: dict[str, DataFrame] = {}
    calls, samples = build(spark, sf_dir, "calls", made), build(spark, sf_dir, "samples", made)
    tokens = np.frombuffer(b"\t0/0:9\t0/1:9\t1|1:9\t./.:0", np.uint8).reshape(4, -1)  # of 0, 1, 2 and missing
    n = samples.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for v, d in bed.filled(batches, n):
            body = pa.array([tokens[d].tobytes()[1:]], pa.string())
            yield pa.RecordBatch.from_arrays([v.cast(pa.int64()), body], names=["variant_id", "body"])

    body = bed.together(calls, places(samples)).mapInArrow(run, "variant_id long, body string")
    line = F.concat_ws("\t", F.lit("1"), (F.col("variant_id") + 1).cast("string"), F.concat(F.lit("v"), "variant_id"), F.lit("A"), F.lit("G"), F.lit("50"), F.lit("PASS"), F.lit("AF=0.1"), F.lit("GT:DP"), "body")
    return body.select(line.alias("value"))


def scan_vcf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed calls; sample_index is the sample's place by id."""
    return vcf.calls(vcf_text(spark, sf_dir)).select("variant_id", F.col("sample_index").cast("long").alias("sample_index"), "dosage")


def scan_bim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variant records parsed from .bim lines of the variants."""
    v = build(spark, sf_dir, "variants")
    alleles = F.when(F.col("variant_id") % 3 == 0, "A G").when(F.col("variant_id") % 3 == 1, "<DUP> N").otherwise("AT A")
    line = F.concat_ws("\t", F.concat(F.lit("chr"), "chrom"), F.concat(F.lit("v"), "variant_id"), F.lit("0"), F.col("pos").cast("string"), alleles)
    return bed.bim(v.select(line.alias("value"))).select("chrom", "variant_id", "pos", "variant_class")


def pack_2bit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls packed two bits each and unpacked again."""
    made: dict[str, DataFrame] = {}
    calls, samples = build(spark, sf_dir, "calls", made), places(build(spark, sf_dir, "samples", made))
    return bed.unpack_calls(bed.pack_calls(calls, samples), samples.count())


def reduced_variants(spark: SparkSession, sf_dir: str, made: dict[str, DataFrame]) -> DataFrame:
    """``variant_id, mean, scale`` of the variants to fit: those that pass the MAF filter, one of each tie group."""
    common = build(spark, sf_dir, "maf", made).where(F.col("maf") >= MINIMUM_MAF).select("variant_id")
    states = build(spark, sf_dir, "states", made).join(common, "variant_id", "left_semi")
    signatures = RELATIONS["signatures"](spark, tied_states=states)
    lead = RELATIONS["tie_map"](spark, signatures=signatures).where("variant_id = group_id").select("variant_id")
    return build(spark, sf_dir, "standardization", made).join(lead, "variant_id", "left_semi")


def gram_blocks(spark: SparkSession, calls: DataFrame, standardization: DataFrame, samples: DataFrame, ids: list, size: int = 20) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, Gram matrix) of each run of ``size`` variants in the order of ``ids``: a preconditioner's blocks, p x size numbers in all."""
    kind = dict(standardization.dtypes)["variant_id"]
    assigned = spark.createDataFrame([(v, i // size) for i, v in enumerate(ids)], f"variant_id {kind}, block_id long")
    own = calls.join(assigned.select("variant_id"), "variant_id", "left_semi")
    at = {v: i for i, v in enumerate(ids)}
    blocks = [(np.arange(lo, min(lo + size, len(ids))), np.zeros((min(size, len(ids) - lo),) * 2)) for lo in range(0, len(ids), size)]
    for u, v, g in RELATIONS["block_gram"](spark, calls=own, assigned=assigned, standardization=standardization, samples=samples).toLocalIterator():
        i, j = at[u], at[v]
        blocks[i // size][1][i % size, j % size] = blocks[i // size][1][j % size, i % size] = g
    return blocks


def _designed(spark: SparkSession, sf_dir: str, target: str, covariates: list[str]) -> tuple[DataFrame, list, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray], list]:
    """Rows, variants, constants, prior scales and shapes, and Gram blocks of the reduced variants."""
    made: dict[str, DataFrame] = {}
    # Statistics, ties, rows and Gram blocks all start from the calls, and each reads the reduced variants: both are made once.
    made["calls"] = components.kept(build(spark, sf_dir, "calls", made))
    few = components.kept(reduced_variants(spark, sf_dir, made))
    samples = build(spark, sf_dir, "samples", made).withColumn("y_scaled", F.col("y") / 1000)
    calls = build(spark, sf_dir, "calls", made)
    rows, ids, zero = design(calls, few, samples, covariates, target)
    known = build(spark, sf_dir, "variants", made).select("variant_id", "variant_class").join(few, "variant_id", "left_semi").collect()
    classes = {r["variant_id"]: r["variant_class"] for r in known}  # of the reduced variants only
    shapes = np.array([CLASS_PRIORS[classes.get(v, "snv")] for v in ids]).reshape(-1, 3)
    return rows.persist(), ids, zero, (np.exp(shapes[:, 0]), shapes[:, 1], shapes[:, 2]), [calls, few, samples]


def _fit(spark: SparkSession, sf_dir: str, target: str, covariates: list[str], binary: bool) -> DataFrame:
    rows, ids, zero, (base, a, b), _ = _designed(spark, sf_dir, target, covariates)
    got = em.fit(rows, zero, 1 + len(covariates), base, a, b, binary=binary, iterations=MOST_ITERATIONS, mixing=MIXED)
    rows.unpersist()
    if not got.converged:
        raise RuntimeError(f"the fit of {target} did not meet its tolerance in {MOST_ITERATIONS} iterations")
    return spark.createDataFrame([(int(v), float(x), float(s)) for v, x, s in zip(ids, got.beta, got.beta_variance, strict=True)], "variant_id long, beta double, beta_variance double")


def cg_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(Z'Z / 4 + 1 / scale^2) x = Z'r for three right sides r at once, by products: ``variant_id, of_y, of_cov, of_target, status``."""
    k = 3  # the target goes as a covariate, so that one design has all three right sides
    rows, ids, zero, (base, _, _), inputs = _designed(spark, sf_dir, "y_scaled", ["cov", "target"])
    whole = Design(rows, zero, k)
    of_y, _, _ = whole.target()
    rhs = np.column_stack([of_y[k:], whole.gram(np.eye(whole.size, k)[:, 1:])[k:]])
    ridge, blocks = 1 / base**2, gram_blocks(spark, *inputs, ids)
    lift = lambda v: np.vstack([np.zeros((k, v.shape[1])), v])
    m = krylov.BlockDiagonal(whole.squares() / 4 + ridge, [(at, g / 4 + np.diag(ridge[at])) for at, g in blocks])
    got = krylov.block_cg(lambda v: whole.gram(lift(v))[k:] / 4 + ridge[:, None] * v, rhs, m, tol=1e-10)
    rows.unpersist()
    out = [(int(v), *map(float, x), max(got.status).name) for v, x in zip(ids, got.x, strict=True)]
    return spark.createDataFrame(out, "variant_id long, of_y double, of_cov double, of_target double, status string")


def posterior_logdet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log det of the effects' posterior precision at prior scales of 1, by stochastic quadrature over products, and its standard error: one row."""
    rows, ids, zero, (base, _, _), inputs = _designed(spark, sf_dir, "target", ["cov"])
    sparse = Sparse(rows, zero, 2, True, gram_blocks(spark, *inputs, ids))
    value, error = sparse.log_determinant(np.concatenate([[1e-8, 1e-8], 1 / base**2]), np.zeros(sparse.design.size), probes=16, steps=12)
    rows.unpersist()
    return spark.createDataFrame([(len(ids), value, error)], "n_variants long, logdet double, standard_error double")


def fit_quantitative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(spark, sf_dir, "y_scaled", ["cov"], binary=False)


def fit_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(spark, sf_dir, "target", ["cov"], binary=True)


def info_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed values of INFO fields whose keys are data."""
    return annotations.info_entries(build(spark, sf_dir, "info_rows"))


def design_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored cells of the prior design of an annotation table."""
    return annotations.design_cells(build(spark, sf_dir, "annotation_table")).withColumn("value", F.round("value", 6))


def design_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The design's features with what centres and scales them."""
    table = build(spark, sf_dir, "annotation_table")
    return annotations.feature_scales(annotations.design_cells(table), table.count()).select("feature", "n_cells", F.round("mean", 6).alias("mean"), F.round("rms", 4).alias("rms"))


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of counts and scores of a run."""
    made: dict[str, DataFrame] = {}
    n = build(spark, sf_dir, "samples", made).agg(F.count("*").alias("n_samples"))
    v = build(spark, sf_dir, "maf_filter", made).agg(F.count("*").alias("n_variants"))
    return n.join(v).join(build(spark, sf_dir, "auc", made))


def _four(samples: DataFrame) -> regression.Residuals:
    """Residuals of y on four covariates, of which one says nothing new."""
    more = samples.withColumns({"squared": F.col("cov") * F.col("cov"), "status": F.col("target").cast("double"), "again": 2 * F.col("cov") + 1})
    return regression.residualize(more, "y", ["cov", "squared", "status", "again"])


def residualize_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _four(build(spark, sf_dir, "samples")).frame.select("sample_id", (F.round("r", 4) + 0.0).alias("residual"))


def marginal_z_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    made: dict[str, DataFrame] = {}
    fitted = _four(build(spark, sf_dir, "samples", made))
    return regression.marginal_z(build(spark, sf_dir, "calls", made), build(spark, sf_dir, "standardization", made), fitted).select("variant_id", (F.round("z", 6) + 0.0).alias("z"))


#: The same by Gram and Schmidt: each covariate without those before it.
relation("dense_many", """
WITH a AS (SELECT sample_id, y, cov, cov * cov AS q, CAST(target AS DOUBLE) AS t FROM {samples}),
b AS (SELECT a.*, q - (i + k * cov) AS e2 FROM a CROSS JOIN (SELECT regr_intercept(q, cov) AS i, regr_slope(q, cov) AS k FROM a) AS m),
c AS (SELECT b.*, t - (i + k * cov) - k2 * e2 AS e3 FROM b CROSS JOIN (SELECT regr_intercept(t, cov) AS i, regr_slope(t, cov) AS k, sum(t * e2) / sum(e2 * e2) AS k2 FROM b) AS m)
SELECT c.sample_id, cov - mc AS e1, e2, e3, y - (i + k * cov) - k2 * e2 - k3 * e3 AS r FROM c CROSS JOIN (
  SELECT regr_intercept(y, cov) AS i, regr_slope(y, cov) AS k, sum(y * e2) / sum(e2 * e2) AS k2, sum(y * e3) / sum(e3 * e3) AS k3, avg(cov) AS mc FROM c) AS m""")
relation("residualize_many_oracle", "SELECT sample_id, round(r, 4) + 0e0 AS residual FROM {dense_many}")
relation("marginal_z_many_oracle", """
SELECT z.variant_id, round(sum(z.z * d.r) / sqrt(max(t.s) * (max(t.n) - sum(z.z) * sum(z.z) / max(t.n) - sum(z.z * e1) * sum(z.z * e1) / max(t.s1)
  - sum(z.z * e2) * sum(z.z * e2) / max(t.s2) - sum(z.z * e3) * sum(z.z * e3) / max(t.s3))), 6) + 0e0 AS z
FROM {dense_z} z JOIN {dense_many} d ON d.sample_id = z.sample_id
CROSS JOIN (SELECT count(*) AS n, avg(r * r) AS s, sum(e1 * e1) AS s1, sum(e2 * e2) AS s2, sum(e3 * e3) AS s3 FROM {dense_many}) AS t GROUP BY z.variant_id""")
relation("sample_places", "SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS ordinal FROM {samples}")
relation("scan_vcf_oracle", "SELECT concat('v', c.variant_id) AS variant_id, CAST(p.ordinal AS BIGINT) AS sample_index, c.dosage FROM {calls} c JOIN {sample_places} p ON p.sample_id = c.sample_id")
relation("scan_bim_oracle", "SELECT concat('chr', chrom) AS chrom, concat('v', variant_id) AS variant_id, pos, CASE variant_id % 3 WHEN 0 THEN 'snv' WHEN 1 THEN 'duplication_short' ELSE 'small_indel' END AS variant_class FROM {variants}")
relation("pack_2bit_oracle", "SELECT c.variant_id, CAST(p.ordinal AS BIGINT) AS ordinal, c.dosage FROM {calls} c JOIN {sample_places} p ON p.sample_id = c.sample_id")
relation("run_summary_oracle", "SELECT (SELECT count(*) FROM {samples}) AS n_samples, (SELECT count(*) FROM {maf_filter}) AS n_variants, auc FROM {auc}")


def _clusters_sql(last: str) -> str:
    base = oracle("sv_event_edges")
    events = oracle("events_sv")
    return f"""WITH RECURSIVE edges AS MATERIALIZED ({base}), ev AS MATERIALIZED ({events}), both_ways AS MATERIALIZED (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges),
reach(x, y) AS (SELECT variant_id, variant_id FROM ev UNION SELECT r.x, e.b FROM reach r JOIN both_ways e ON e.a = r.y),
lab AS (SELECT x AS variant_id, min(y) AS cluster FROM reach GROUP BY x),
best AS (SELECT cluster, arg_max(ev.variant_id, ev.support * 1000000000 - ev.variant_id) AS representative FROM lab JOIN ev USING (variant_id) GROUP BY cluster) {last}"""


def special_sql() -> dict[str, str]:
    return {
        "sv_event_clusters": _clusters_sql("SELECT variant_id, cluster, representative FROM lab JOIN best USING (cluster)"),
        "sv_representatives": _clusters_sql("SELECT representative AS variant_id FROM best"),
        "scan_vcf": oracle("scan_vcf_oracle"),
        "scan_bim": oracle("scan_bim_oracle"),
        "pack_2bit": oracle("pack_2bit_oracle"),
        "run_summary": oracle("run_summary_oracle"),
        "info_entries": oracle("info_entries_oracle"),
        "design_cells": oracle("design_cells_oracle"),
        "design_features": oracle("design_features_oracle"),
        "residualize_many": oracle("residualize_many_oracle"),
        "marginal_z_many": oracle("marginal_z_many_oracle"),
    }


SPECIAL = {f.__name__: f for f in (sv_event_clusters, sv_representatives, scan_vcf, scan_bim, pack_2bit, fit_quantitative, fit_binary, cg_solve, posterior_logdet, info_entries, design_cells, design_features, run_summary, residualize_many, marginal_z_many)}
