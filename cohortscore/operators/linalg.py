"""Products of the standardized genotype matrix as joins and sums; the mean and scale stay folded into sums.

The checks form the dense matrix, cell by cell.
"""

from cohortscore.plans.relation import relation

#: The dense matrix, for checks: d is null where the call is missing, z is 0 there.
relation("dense_calls", """
SELECT s.sample_id, v.variant_id, CASE WHEN c.sample_id IS NULL THEN 0 ELSE c.dosage END AS d
FROM {samples} s CROSS JOIN (SELECT DISTINCT variant_id FROM {calls}) AS v LEFT JOIN {calls} c ON c.sample_id = s.sample_id AND c.variant_id = v.variant_id""")
relation("dense_scales", """
SELECT variant_id, mean, n_observed, CASE WHEN sd < 1e-6 THEN 1e0 ELSE sd END AS scale FROM (
  SELECT g.variant_id, coalesce(max(m.mean), 0e0) AS mean, count(g.d) AS n_observed, coalesce(sqrt(sum((g.d - m.mean) * (g.d - m.mean)) / count(*)), 0e0) AS sd
  FROM {dense_calls} g JOIN (SELECT variant_id, avg(d) AS mean FROM {dense_calls} GROUP BY variant_id) AS m ON m.variant_id = g.variant_id GROUP BY g.variant_id) AS s""")
relation("dense_z", "SELECT g.sample_id, g.variant_id, g.d, coalesce((g.d - p.mean) / p.scale, 0e0) AS z FROM {dense_calls} g JOIN {dense_scales} p ON p.variant_id = g.variant_id")

#: Sum over carriers, minus the constant of all variants, plus the missing calls' part of it.
matvec = relation("matvec", """
SELECT s.sample_id, round(coalesce(c.part, 0e0) - k.constant, 6) + 0e0 AS product
FROM {samples} s LEFT JOIN (
  SELECT c.sample_id, sum(CASE WHEN c.dosage IS NULL THEN p.mean ELSE c.dosage END * e.beta / p.scale) AS part
  FROM {calls} c JOIN {standardization} p ON p.variant_id = c.variant_id JOIN {effects} e ON e.variant_id = c.variant_id WHERE e.beta <> 0 GROUP BY c.sample_id
) AS c ON c.sample_id = s.sample_id
CROSS JOIN (SELECT sum(p.mean * e.beta / p.scale) AS constant FROM {standardization} p JOIN {effects} e ON e.variant_id = p.variant_id) AS k""",
    check="SELECT z.sample_id, round(sum(z.z * e.beta), 6) + 0e0 AS product FROM {dense_z} z JOIN {effects} e ON e.variant_id = z.variant_id GROUP BY z.sample_id")
rmatvec = relation("rmatvec", """
SELECT c.variant_id, round((sum(c.dosage * s.y) - max(p.mean) * (max(t.total) - coalesce(sum(CASE WHEN c.dosage IS NULL THEN s.y END), 0e0))) / max(p.scale), 4) AS product
FROM {calls} c JOIN {samples} s ON s.sample_id = c.sample_id JOIN {standardization} p ON p.variant_id = c.variant_id
CROSS JOIN (SELECT sum(y) AS total FROM {samples}) AS t GROUP BY c.variant_id""",
    check="SELECT z.variant_id, round(sum(z.z * s.y), 4) + 0e0 AS product FROM {dense_z} z JOIN {samples} s ON s.sample_id = z.sample_id GROUP BY z.variant_id")
assigned = relation("assigned", "SELECT DISTINCT variant_id, CAST(floor(variant_id / 20e0) AS BIGINT) AS block_id FROM {calls}")
#: As matvec, each block with the constant of its own variants: all samples in all blocks.
block_matvec = relation("block_matvec", """
SELECT s.sample_id, k.block_id, round(coalesce(c.part, 0e0) - k.constant, 6) + 0e0 AS product
FROM {samples} s CROSS JOIN (
  SELECT a.block_id, sum(p.mean * e.beta / p.scale) AS constant FROM {standardization} p JOIN {assigned} a ON a.variant_id = p.variant_id JOIN {effects} e ON e.variant_id = p.variant_id GROUP BY a.block_id) AS k
LEFT JOIN (
  SELECT c.sample_id, a.block_id, sum(CASE WHEN c.dosage IS NULL THEN p.mean ELSE c.dosage END * e.beta / p.scale) AS part
  FROM {calls} c JOIN {assigned} a ON a.variant_id = c.variant_id JOIN {standardization} p ON p.variant_id = c.variant_id JOIN {effects} e ON e.variant_id = c.variant_id
  WHERE e.beta <> 0 GROUP BY c.sample_id, a.block_id) AS c ON c.sample_id = s.sample_id AND c.block_id = k.block_id""",
    check="""
SELECT z.sample_id, CAST(floor(z.variant_id / 20e0) AS BIGINT) AS block_id, round(sum(z.z * e.beta), 6) + 0e0 AS product
FROM {dense_z} z JOIN {effects} e ON e.variant_id = z.variant_id GROUP BY z.sample_id, CAST(floor(z.variant_id / 20e0) AS BIGINT)""")
block_transpose_matvec = relation("block_transpose_matvec", "SELECT a.block_id, r.variant_id, r.product FROM {rmatvec} r JOIN {assigned} a ON a.variant_id = r.variant_id")
#: Both variants observed: the sum of products of centred dosages needs only sums over carriers and over either's missing calls.
block_gram = relation("block_gram", """
WITH x AS (SELECT c.sample_id, c.variant_id, a.block_id, coalesce(c.dosage - p.mean, 0e0) / p.scale AS z, -p.mean / p.scale AS z0
  FROM {calls} c JOIN {assigned} a ON a.variant_id = c.variant_id JOIN {standardization} p ON p.variant_id = c.variant_id),
single AS (SELECT variant_id, block_id, sum(z - z0) AS d, max(z0) AS z0, (SELECT count(*) FROM {samples}) AS n FROM x GROUP BY variant_id, block_id),
pairs AS (SELECT u.variant_id AS u, v.variant_id AS v, sum((u.z - u.z0) * (v.z - v.z0)) AS dd
  FROM x u JOIN x v ON u.sample_id = v.sample_id AND u.block_id = v.block_id AND u.variant_id <= v.variant_id GROUP BY u.variant_id, v.variant_id)
SELECT a.variant_id AS u, b.variant_id AS v, round(coalesce(dd, 0e0) + a.z0 * b.d + b.z0 * a.d + a.n * a.z0 * b.z0, 4) + 0e0 AS gram
FROM single a JOIN single b ON a.block_id = b.block_id AND a.variant_id <= b.variant_id LEFT JOIN pairs ON pairs.u = a.variant_id AND pairs.v = b.variant_id""",
    check="""
SELECT a.variant_id AS u, b.variant_id AS v, round(sum(a.z * b.z), 4) + 0e0 AS gram FROM {dense_z} a JOIN {dense_z} b
  ON a.sample_id = b.sample_id AND floor(a.variant_id / 20e0) = floor(b.variant_id / 20e0) AND a.variant_id <= b.variant_id GROUP BY a.variant_id, b.variant_id""")
block_partition = relation("block_partition", """
SELECT block_id, count(*) AS n, [[array_join(sort_array(collect_list(variant_id)), ',')|string_agg(CAST(variant_id AS VARCHAR), ',' ORDER BY variant_id)]] AS members FROM {assigned} GROUP BY block_id""")
score = relation("score", """
SELECT s.sample_id, s.target, s.y, coalesce(c.part, 0e0) - k.constant AS genetic_score, :intercept + :slope * s.cov AS covariate_score
FROM {samples} s LEFT JOIN (
  SELECT c.sample_id, sum(CASE WHEN c.dosage IS NULL THEN p.mean ELSE c.dosage END * e.beta / p.scale) AS part
  FROM {calls} c JOIN {standardization} p ON p.variant_id = c.variant_id JOIN {effects} e ON e.variant_id = c.variant_id WHERE e.beta <> 0 GROUP BY c.sample_id
) AS c ON c.sample_id = s.sample_id
CROSS JOIN (SELECT sum(p.mean * e.beta / p.scale) AS constant FROM {standardization} p JOIN {effects} e ON e.variant_id = p.variant_id) AS k""",
    check="""
SELECT s.sample_id, s.target, s.y, sum(z.z * e.beta) AS genetic_score, :intercept + :slope * any_value(s.cov) AS covariate_score
FROM {samples} s JOIN {dense_z} z ON z.sample_id = s.sample_id JOIN {effects} e ON e.variant_id = z.variant_id GROUP BY s.sample_id, s.target, s.y""",
    intercept=0.2, slope=0.01)
score_samples = relation("score_samples", "SELECT sample_id, round(genetic_score, 6) + 0e0 AS genetic_score, round(covariate_score, 6) AS covariate_score, round(genetic_score + covariate_score, 6) + 0e0 AS linear_predictor FROM {score}")
variance = relation("variance", """
SELECT s.sample_id, coalesce(c.part, 0e0) + k.constant AS variance
FROM {samples} s LEFT JOIN (
  SELECT c.sample_id, sum((CASE WHEN c.dosage IS NULL THEN 0e0 ELSE (c.dosage - p.mean) * (c.dosage - p.mean) END - p.mean * p.mean) / (p.scale * p.scale) * e.beta_variance) AS part
  FROM {calls} c JOIN {standardization} p ON p.variant_id = c.variant_id JOIN {effects} e ON e.variant_id = c.variant_id GROUP BY c.sample_id
) AS c ON c.sample_id = s.sample_id
CROSS JOIN (SELECT sum(p.mean * p.mean / (p.scale * p.scale) * e.beta_variance) AS constant FROM {standardization} p JOIN {effects} e ON e.variant_id = p.variant_id) AS k""",
    check="SELECT z.sample_id, sum(z.z * z.z * e.beta_variance) AS variance FROM {dense_z} z JOIN {effects} e ON e.variant_id = z.variant_id GROUP BY z.sample_id")
predictor_variance = relation("predictor_variance", "SELECT sample_id, round(variance, 6) AS variance FROM {variance}")
posterior_logit = relation("posterior_logit", """
SELECT s.sample_id, round((s.genetic_score + s.covariate_score) / sqrt(1 + 3.141592653589793e0 / 8 * v.variance), 6) AS logit
FROM {score} s JOIN {variance} v ON v.sample_id = s.sample_id""")
#: The file's probability is that of the undamped predictor.
predictions = relation("predictions", """
SELECT sample_id, target, round(genetic_score, 6) + 0e0 AS genetic_score, round(covariate_score, 6) AS covariate_score, round(eta, 6) + 0e0 AS linear_predictor,
  round(p, 6) AS probability, CASE WHEN p >= :threshold THEN 1 ELSE 0 END AS predicted_label
FROM (SELECT *, CASE WHEN eta >= 0 THEN 1 / (1 + exp(-eta)) ELSE exp(eta) / (1 + exp(eta)) END AS p FROM (SELECT *, genetic_score + covariate_score AS eta FROM {score}) AS a) AS b""", threshold=0.5)
predictions_quantitative = relation("predictions_quantitative", "SELECT sample_id, y AS target, round(genetic_score, 6) + 0e0 AS genetic_score, round(covariate_score, 6) AS covariate_score, round(genetic_score + covariate_score, 6) + 0e0 AS prediction FROM {score}")
coefficient_table = relation("coefficient_table", "SELECT variant_id, variant_class, beta, chrom, pos, length, allele_frequency FROM {effects} WHERE abs(beta) > :least", least=0.01)
global_scale = relation("global_scale", """
SELECT round(sqrt(least(greatest((5e-1 * sum((beta * beta + beta_variance) / (s * s * l))) / (5e-1 * count(*) + 1), 1e-16), 1e16)), 6) AS sigma_g
FROM (SELECT beta, beta_variance, exp(-4e0 + length / 1e3) AS s, 5e-1 + support / 1e2 AS l FROM {effects}) AS e""")
elbo_terms = relation("elbo_terms", """
SELECT round(-5e-1 * sum(ln(t) + (beta * beta + beta_variance) / t), 4) AS effect_prior, round(5e-1 * sum(ln(beta_variance) + 1), 4) AS entropy
FROM (SELECT beta, beta_variance, 1e-2 * (5e-1 + support / 1e2) AS t FROM {effects}) AS e""")
#: Data terms of the variational bound at the scores' means and variances: Gaussian, and logistic at each sample's best local parameter.
elbo_data = relation("elbo_data", """
SELECT round(-5e-1 * (count(*) * ln(2 * 3.141592653589793e0 * :error) + sum((y / 1e3 - eta) * (y / 1e3 - eta) + variance) / :error), 4) AS gaussian,
  round(sum((target - 5e-1) * eta - xi / 2 - ln(1 + exp(-xi))), 4) AS logistic, round(sum(variance), 4) AS spread
FROM (SELECT s.target, s.y, s.genetic_score + s.covariate_score AS eta, v.variance, sqrt((s.genetic_score + s.covariate_score) * (s.genetic_score + s.covariate_score) + v.variance) AS xi
  FROM {score} s JOIN {variance} v ON v.sample_id = s.sample_id) AS e""", error=4.0)
prior_design = relation("prior_design", """
SELECT variant_id, CAST(variant_class = 'deletion_short' AS INT) AS is_deletion_short, CAST(variant_class = 'deletion_long' AS INT) AS is_deletion_long,
  CAST(variant_class = 'duplication_short' AS INT) AS is_duplication_short, CAST(variant_class = 'insertion_mei' AS INT) AS is_insertion_mei,
  CAST(variant_class = 'small_indel' AS INT) AS is_small_indel,
  round((ln(length) - m.mean) / nullif(m.deviation, 0), 6) + 0e0 AS log_length
FROM {effects} CROSS JOIN (SELECT avg(ln(length)) AS mean, stddev_pop(ln(length)) AS deviation FROM {effects}) AS m""")
