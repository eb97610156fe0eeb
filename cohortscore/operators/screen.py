"""Association screening: residuals, projections and marginal z scores from sums per variant."""

from cohortscore.plans.relation import relation

residualized = relation("residualized", """
SELECT s.sample_id, s.y - (m.my + m.b * (s.cov - m.mc)) AS r, s.cov - m.mc AS centred, m.n, m.mc, m.scc
FROM {samples} s CROSS JOIN (
  SELECT count(*) AS n, avg(y) AS my, avg(cov) AS mc, sum(cov * cov) - count(*) * avg(cov) * avg(cov) AS scc,
    CASE WHEN sum(cov * cov) - count(*) * avg(cov) * avg(cov) < 1e-12 THEN 0e0
      ELSE (sum(cov * y) - count(*) * avg(cov) * avg(y)) / (sum(cov * cov) - count(*) * avg(cov) * avg(cov)) END AS b
  FROM {samples}) AS m""")
relation("residualize", "SELECT sample_id, round(r, 6) AS residual FROM {residualized}")

#: One pass over calls: count, sum, squares, dosage times residual and residual over observed samples.
screen_sums = relation("screen_sums", """
SELECT c.variant_id, count(*) FILTER (WHERE c.dosage > 0) AS carriers, CAST(coalesce(sum(c.dosage), 0) AS DOUBLE) AS dosage_sum,
  CAST(coalesce(sum(c.dosage * c.dosage), 0) AS DOUBLE) AS dosage_squares, coalesce(sum(c.dosage * r.r), 0e0) AS dosage_rhs,
  coalesce(sum(c.dosage * r.centred), 0e0) AS dosage_cov, coalesce(sum(CASE WHEN c.dosage IS NULL THEN r.r END), 0e0) AS missing_rhs,
  coalesce(sum(CASE WHEN c.dosage IS NULL THEN r.centred END), 0e0) AS missing_cov
FROM {calls} c JOIN {residualized} r ON r.sample_id = c.sample_id GROUP BY c.variant_id""")
screen_partials = relation("screen_partials", """
SELECT variant_id, carriers, dosage_sum, dosage_squares, round(dosage_rhs, 4) AS dosage_rhs,
  round((SELECT sum(r) FROM {residualized}) - missing_rhs, 4) + 0e0 AS observed_rhs FROM {screen_sums}""")
screen_values = relation("screen_values", """
SELECT q.variant_id, t.n, (q.dosage_rhs - p.mean * (t.sum_r - q.missing_rhs)) / p.scale AS sum_xy,
  (q.dosage_cov - p.mean * (t.sum_c - q.missing_cov)) / p.scale AS x_cov, (q.dosage_sum - p.mean * p.n_observed) / p.scale AS x_one, t.scc, t.sigma2
FROM {screen_sums} q JOIN {standardization} p ON p.variant_id = q.variant_id
CROSS JOIN (SELECT count(*) AS n, sum(r) AS sum_r, sum(centred) AS sum_c, max(scc) AS scc, sum(r * r) / count(*) AS sigma2 FROM {residualized}) AS t""")
screen_finalize = relation("screen_finalize", "SELECT variant_id, round(sum_xy, 4) AS standardized_rhs FROM {screen_values}")
proj = relation("proj", "SELECT variant_id, sum_xy, n, sigma2, x_one * x_one / n + CASE WHEN scc < 1e-12 THEN 0e0 ELSE x_cov * x_cov / scc END AS proj FROM {screen_values}")
proj_diag = relation("proj_diag", "SELECT variant_id, round(proj, 6) + 0e0 AS projection FROM {proj}")
#: The check regresses the dense columns.
relation("dense_residuals", "SELECT s.sample_id, s.cov, s.y - (m.a + m.b * s.cov) AS r FROM {samples} s CROSS JOIN (SELECT regr_intercept(y, cov) AS a, regr_slope(y, cov) AS b FROM {samples}) AS m")
z_scores = relation("z_scores", "SELECT variant_id, CASE WHEN sigma2 * (n - proj) <= 0 THEN 0e0 ELSE sum_xy / sqrt(sigma2 * (n - proj)) END AS z FROM {proj}",
    check="""
SELECT z.variant_id, CASE WHEN max(t.sigma2) * (sum(z.z * z.z) * 0 + count(*) - sum(z.z) * sum(z.z) / count(*) - covar_pop(z.z, r.cov) * covar_pop(z.z, r.cov) / var_pop(r.cov) * count(*)) <= 0 THEN 0e0
  ELSE sum(z.z * r.r) / sqrt(max(t.sigma2) * (count(*) - sum(z.z) * sum(z.z) / count(*) - covar_pop(z.z, r.cov) * covar_pop(z.z, r.cov) / var_pop(r.cov) * count(*))) END AS z
FROM {dense_z} z JOIN {dense_residuals} r ON r.sample_id = z.sample_id CROSS JOIN (SELECT avg(r * r) AS sigma2 FROM {dense_residuals}) AS t GROUP BY z.variant_id""".replace("sum(z.z * z.z) * 0 + ", ""))
marginal_z = relation("marginal_z", "SELECT variant_id, round(z, 6) AS z FROM {z_scores}")
#: If no variant passes, the screen is off. Structural variants can be kept whatever their score.
marginal_screen = relation("marginal_screen", """
SELECT q.variant_id, round(q.z, 6) AS z FROM {z_scores} q LEFT JOIN {variants} v ON v.variant_id = q.variant_id
CROSS JOIN (SELECT count(*) AS n FROM {z_scores} WHERE abs(z) >= :least) AS k
WHERE abs(q.z) >= :least OR k.n = 0 OR (:protect_structural AND coalesce(v.variant_class, 'snv') NOT IN ('snv', 'small_indel'))""", least=1.5, protect_structural=False)
relation("marginal_screen_protected", marginal_screen.text, least=1.5, protect_structural=True)
#: Carriers only, another denominator: x'x times the residual's population variance.
sparse_marginal_z = relation("sparse_marginal_z", """
SELECT q.variant_id, round(CASE WHEN xx * t.var_r <= 0 THEN 0e0 ELSE ((q.dosage_rhs - p.mean * t.sum_r) / p.scale) / sqrt(xx * t.var_r) END, 6) AS z
FROM (SELECT q.*, (q.dosage_squares - 2 * p.mean * q.dosage_sum + t.n * p.mean * p.mean) / (p.scale * p.scale) AS xx
  FROM {screen_sums} q JOIN {standardization} p ON p.variant_id = q.variant_id CROSS JOIN (SELECT count(*) AS n FROM {residualized}) AS t) AS q
JOIN {standardization} p ON p.variant_id = q.variant_id CROSS JOIN (SELECT sum(r) AS sum_r, var_pop(r) AS var_r FROM {residualized}) AS t""")
