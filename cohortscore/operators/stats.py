"""Per-variant statistics, standardization and filters over sparse calls.

``calls`` holds carriers (dosage above 0) and explicit missing calls (null dosage); an absent row is
dosage 0.  The number of samples comes from ``samples``.  Every reduction is one hash aggregate with
map-side partial sums on variant_id.
"""

from cohortscore.plans.relation import relation

variant_stats = relation("variant_stats", """
SELECT variant_id, CAST(coalesce(sum(dosage), 0) AS DOUBLE) AS dosage_sum, CAST(coalesce(sum(dosage * dosage), 0) AS DOUBLE) AS dosage_squares,
  count(*) FILTER (WHERE dosage > 0) AS support, (SELECT count(*) FROM {samples}) - count(*) FILTER (WHERE dosage IS NULL) AS n_observed,
  (SELECT count(*) FROM {samples}) AS n_samples
FROM {calls} GROUP BY variant_id""")

#: Support counts |x| above one half; dosage-like means that all values lie in 0..2.
variant_stats_float = relation("variant_stats_float", """
SELECT variant_id, round(sum(x), 6) AS dosage_sum, round(sum(x * x), 6) AS dosage_squares, count(*) FILTER (WHERE abs(x) > 5e-1) AS support,
  CAST(bool_and(x BETWEEN 0 AND 2) AS INT) AS dosage_like
FROM (SELECT variant_id, dosage * 9e-1 + CASE WHEN sample_id % 50 = 0 THEN 5e-1 ELSE 0e0 END AS x FROM {calls} WHERE dosage IS NOT NULL) AS v GROUP BY variant_id""")

#: The mean divides by observed calls, the variance by all samples; a scale below 1e-6 is 1.
standardization = relation("standardization", """
SELECT variant_id, n_samples, n_observed, support, CASE WHEN n_observed = 0 THEN 0e0 ELSE dosage_sum / n_observed END AS mean,
  CASE WHEN n_observed = 0 THEN 1e0
    WHEN sqrt(greatest(dosage_squares - dosage_sum * dosage_sum / n_observed, 0e0) / n_samples) < 1e-6 THEN 1e0
    ELSE sqrt(greatest(dosage_squares - dosage_sum * dosage_sum / n_observed, 0e0) / n_samples) END AS scale
FROM {variant_stats}""",
    check="""
SELECT g.variant_id, (SELECT count(*) FROM {samples}) AS n_samples, max(p.n_observed) AS n_observed, count(*) FILTER (WHERE g.d > 0) AS support, max(p.mean) AS mean, max(p.scale) AS scale
FROM {dense_calls} g JOIN {dense_scales} p ON p.variant_id = g.variant_id GROUP BY g.variant_id""")
relation("standardization_params", "SELECT variant_id, round(mean, 6) AS mean, round(scale, 6) AS scale FROM {standardization}")

allele_freq = relation("allele_freq", """
SELECT variant_id, n_observed, support, CASE WHEN n_observed = 0 THEN 5e-1 ELSE least(greatest(mean / 2, 0e0), 1e0) END AS allele_frequency FROM {standardization}""")
relation("allele_freq_report", "SELECT variant_id, round(allele_frequency, 6) AS allele_frequency FROM {allele_freq}")
maf = relation("maf", """
SELECT variant_id, round(CASE WHEN allele_frequency IS NULL OR isnan(allele_frequency) THEN 0e0
  ELSE least(least(greatest(allele_frequency, 0e0), 1e0), 1 - least(greatest(allele_frequency, 0e0), 1e0)) END, 6) AS maf FROM {allele_freq}""")
relation("maf_filter", "SELECT variant_id, maf FROM {maf} WHERE maf >= :threshold", threshold=0.01)

#: Stored cells, and one row a variant (null sample) for the value of all cells that are not stored.
standardize = relation("standardize", """
SELECT c.sample_id, c.variant_id, round(coalesce((c.dosage - p.mean) / p.scale, 0e0), 6) AS z
FROM {calls} c JOIN {standardization} p ON p.variant_id = c.variant_id
UNION ALL SELECT NULL, variant_id, round(-mean / scale, 6) + 0e0 FROM {standardization}""")
subset_variants = relation("subset_variants", "SELECT c.* FROM {calls} c LEFT SEMI JOIN (SELECT variant_id FROM {maf_filter}) k ON c.variant_id = k.variant_id".replace("LEFT SEMI", "[[LEFT SEMI|SEMI]]"))
subset_samples = relation("subset_samples", "SELECT c.* FROM {calls} c [[LEFT SEMI|SEMI]] JOIN (SELECT sample_id FROM {samples} WHERE target = 1) k ON c.sample_id = k.sample_id")
concat_sources = relation("concat_sources", "SELECT sample_id, variant_id, dosage FROM {calls} UNION ALL SELECT sample_id, variant_id + 1000000, dosage FROM {calls_rare}")
validate_inputs = relation("validate_inputs", """
SELECT count(*) AS n_calls, count(*) FILTER (WHERE dosage < 0 OR dosage > 2) AS n_bad_dosage, count(*) FILTER (WHERE sample_id IS NULL OR variant_id IS NULL) AS n_null_keys,
  count(*) FILTER (WHERE dosage IS NULL) AS n_missing FROM {calls}""")
class_counts = relation("class_counts", """
SELECT variant_class, count(*) AS n, CAST(max(CASE WHEN variant_class IN ('snv', 'small_indel') THEN 0 ELSE 1 END) AS INT) AS structural FROM {variants} GROUP BY variant_class""")
is_structural = relation("is_structural", """
SELECT variant_id, CAST(variant_class IN ('deletion_short', 'deletion_long', 'duplication_short', 'duplication_long', 'insertion_mei', 'inversion_bnd_complex', 'str_vntr_repeat', 'other_complex_sv') AS INT) AS structural,
  CAST(variant_class LIKE 'deletion%' OR variant_class LIKE 'duplication%' OR variant_class LIKE 'insertion%' OR variant_class LIKE 'inversion%' AS INT) AS routed_structural FROM {variants}""")
route_variants = relation("route_variants", """
SELECT variant_id, CASE WHEN structural AND support <= threshold THEN 'sparse_rare_structural' WHEN is_repeat AND support <= threshold THEN 'sparse_rare_repeat'
  WHEN structural THEN 'dense_common_structural' WHEN is_repeat THEN 'dense_common_repeat' ELSE 'dense_snv_like' END AS route
FROM (SELECT variant_id, support, is_repeat, variant_class NOT IN ('snv', 'small_indel') AS structural,
  (SELECT CAST(floor(count(*) / :share) AS BIGINT) FROM {samples}) AS threshold FROM {variants}) AS v""", share=64.0)
route_counts = relation("route_counts", "SELECT route, count(*) AS n FROM {route_variants} GROUP BY route")
