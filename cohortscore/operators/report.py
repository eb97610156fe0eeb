"""Reports on fitted effects: summaries, histograms, curves and top lists."""

from cohortscore.plans.relation import ranged, relation

_P = "[[percentile({x}, {q})|quantile_cont({x}, {q})]]"
nonzero = relation("nonzero", "SELECT *, abs(beta) AS a FROM {effects} WHERE beta <> 0")
effects_by_class = relation("effects_by_class", "SELECT variant_class, count(*) AS n, round(avg(a), 6) AS mean_abs, round(median(a), 6) AS median_abs, round(max(a), 6) AS max_abs FROM {nonzero} GROUP BY variant_class")
effects_by_chrom = relation("effects_by_chrom", "SELECT chrom, count(*) AS n, round(avg(a), 6) AS mean_abs FROM {nonzero} GROUP BY chrom")
class_by_chrom = relation("class_by_chrom", "SELECT chrom, count(*) FILTER (WHERE variant_class = 'snv') AS snv, count(*) FILTER (WHERE variant_class LIKE 'deletion%') AS deletion, count(*) FILTER (WHERE variant_class LIKE 'duplication%') AS duplication, count(*) FILTER (WHERE variant_class = 'insertion_mei') AS insertion FROM {nonzero} GROUP BY chrom")
effect_percentiles = relation("effect_percentiles", "SELECT " + ", ".join(f"round({_P.format(x='a', q=q)}, 6) AS p{str(q)[2:]}" for q in (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) + ", round(avg(a), 6) AS mean, round(stddev_pop(a), 6) AS std, min(a) AS lo, max(a) AS hi FROM {nonzero}")
effect_quartiles = relation("effect_quartiles", "SELECT variant_class, " + ", ".join(f"round({_P.format(x='a', q=q)}, 6) AS q{int(q * 100)}" for q in (0.25, 0.5, 0.75)) + " FROM {nonzero} GROUP BY variant_class")
length_by_class = relation("length_by_class", "SELECT variant_class, median(length) AS median_length, min(length) AS min_length, max(length) AS max_length FROM {nonzero} GROUP BY variant_class")
af_spectrum = relation("af_spectrum", "SELECT round(median(allele_frequency), 6) AS median_af, count(*) FILTER (WHERE allele_frequency < 1e-2) AS n_rare, count(*) FILTER (WHERE allele_frequency >= 5e-2) AS n_common, count(*) AS n FROM {nonzero}")
_VERSUS = "SELECT variant_id, variant_class, {x}, round(a, 6) AS abs_beta FROM (SELECT *, count(*) OVER (PARTITION BY variant_class) AS n FROM {{nonzero}} WHERE {x} > 0) AS v WHERE n > 10"
length_vs_effect = relation("length_vs_effect", _VERSUS.format(x="length"))
af_vs_effect = relation("af_vs_effect", _VERSUS.format(x="allele_frequency"))
#: Bins of equal width; the last one is closed.
effect_histogram = relation("effect_histogram", """
SELECT bin, count(*) AS n FROM (SELECT least(CAST(floor(a / :width) AS INT), :bins - 1) AS bin FROM {nonzero}) AS h GROUP BY bin""", bins=20, width=0.0025)
ranged("effects_down", "nonzero", "-a")
ranged("effects_down_squares", "nonzero", "-a", "a * a")
ranged("effects_up", "nonzero", "a")
rank_curve = relation("rank_curve", "SELECT variant_id, before + row_number() OVER (PARTITION BY bucket ORDER BY a DESC, variant_id) AS place, round(a, 6) AS abs_beta FROM {effects_down}",
    check="SELECT variant_id, row_number() OVER (ORDER BY a DESC, variant_id) AS place, round(a, 6) AS abs_beta FROM {nonzero}")
cumulative = relation("cumulative", """
SELECT s.variant_id, p.place, (s.before + sum(s.a * s.a) OVER (PARTITION BY s.bucket ORDER BY s.a DESC, s.variant_id ROWS UNBOUNDED PRECEDING)) / t.total AS fraction
FROM {effects_down_squares} s JOIN {rank_curve} p ON p.variant_id = s.variant_id CROSS JOIN (SELECT sum(a * a) AS total FROM {nonzero}) AS t""",
    check="""
SELECT variant_id, row_number() OVER (ORDER BY a DESC, variant_id) AS place, sum(a * a) OVER (ORDER BY a DESC, variant_id ROWS UNBOUNDED PRECEDING) / sum(a * a) OVER () AS fraction FROM {nonzero}""")
cumulative_variance = relation("cumulative_variance", "SELECT variant_id, place, round(fraction, 6) AS fraction FROM {cumulative}")
variance_milestones = relation("variance_milestones", "SELECT m.p, min(c.place) AS first_place FROM {cumulative} c JOIN (VALUES (50), (80), (90), (95)) AS m(p) ON c.fraction >= m.p / 1e2 GROUP BY m.p")
effect_cdf = relation("effect_cdf", """
SELECT variant_id, round((before + count(*) OVER (PARTITION BY bucket ORDER BY a)) / t.n, 6) AS cdf FROM {effects_up} CROSS JOIN (SELECT count(*) * 1e0 AS n FROM {nonzero}) AS t""",
    check="SELECT variant_id, round(cume_dist() OVER (ORDER BY a), 6) AS cdf FROM {nonzero}")
manhattan_offsets = relation("manhattan_offsets", "SELECT chrom, coalesce(sum(size) OVER (ORDER BY chrom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS genome_offset FROM (SELECT chrom, max(pos) AS size FROM {nonzero} GROUP BY chrom) AS c")
top_variants = relation("top_variants", "SELECT variant_id, variant_class, beta FROM {nonzero} ORDER BY a DESC, variant_id LIMIT 50")
