"""Evaluation of scores: ranks, AUC, losses, precision, tails and groups."""

from cohortscore.operators import linalg  # noqa: F401  the scores that the suite copies
from cohortscore.plans.relation import RELATIONS, Ranged, ranged, relation

#: People without a score are not ranked: their rank is null, and they count in no curve and no tail.
relation("scored_people", "SELECT * FROM {predictions_in} WHERE score IS NOT NULL AND NOT isnan(score)")
#: Distinct scores are counted first and ranked by ranges of about equally many, so no window holds all people or all scores.
score_counts = relation("score_counts", "SELECT score, sum(target) AS pos, count(*) - sum(target) AS neg FROM {predictions_in} WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY score")
ranged("scores_up", "score_counts", "score", "pos + neg")
ranged("scores_up_neg", "score_counts", "score", "neg")
ranged("scores_down_pos", "score_counts", "-score", "pos")
ranged("scores_down_neg", "score_counts", "-score", "neg")
avg_rank = relation("avg_rank", """
SELECT p.sample_id, r.below + (r.n + 1) / 2e0 AS avg_rank FROM {predictions_in} p LEFT JOIN (
  SELECT score, pos + neg AS n, before + sum(pos + neg) OVER (PARTITION BY bucket ORDER BY score ROWS UNBOUNDED PRECEDING) - pos - neg AS below FROM {scores_up}) AS r ON r.score = p.score""",
    check="""SELECT p.sample_id, r.avg_rank FROM {predictions_in} p LEFT JOIN (
  SELECT sample_id, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2e0 AS avg_rank FROM {predictions_in} WHERE score IS NOT NULL AND NOT isnan(score)) AS r ON r.sample_id = p.sample_id""")
auc_counts = relation("auc_counts", "SELECT score, pos, neg, before + sum(neg) OVER (PARTITION BY bucket ORDER BY score ROWS UNBOUNDED PRECEDING) - neg AS below FROM {scores_up_neg}",
    check="SELECT score, pos, neg, sum(neg) OVER (ORDER BY score ROWS UNBOUNDED PRECEDING) - neg AS below FROM {score_counts}")
auc = relation("auc", "SELECT CASE WHEN sum(pos + neg) < 20 OR sum(pos) = 0 OR sum(neg) = 0 THEN NULL ELSE round(sum(pos * (below + neg / 2e0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)), 6) END AS auc FROM {auc_counts}")
auc_two_group = relation("auc_two_group", """
SELECT n_pos, n_neg, CASE WHEN n_pos < 10 OR n_neg < 10 THEN NULL ELSE a.auc END AS auc, round(mean_pos, 6) AS mean_pos, round(mean_neg, 6) AS mean_neg FROM (
  SELECT count(*) FILTER (WHERE target = 1) AS n_pos, count(*) FILTER (WHERE target = 0) AS n_neg, avg(CASE WHEN target = 1 THEN score END) AS mean_pos, avg(CASE WHEN target = 0 THEN score END) AS mean_neg
  FROM {predictions_in} WHERE NOT isnan(score)) AS m CROSS JOIN {auc} a""")
_GROUPED = """
SELECT {group}, CASE WHEN sum(pos + neg) < 20 OR sum(pos) = 0 OR sum(neg) = 0 THEN NULL ELSE round(sum(pos * (below + neg / 2e0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)), 6) END AS auc, CAST(sum(pos + neg) AS BIGINT) AS n FROM (
  SELECT {group}, score, pos, neg, sum(neg) OVER (PARTITION BY {group} ORDER BY score ROWS UNBOUNDED PRECEDING) - neg AS below FROM (
    SELECT {group}, score, sum(target) AS pos, count(*) - sum(target) AS neg FROM ({source}) AS p GROUP BY {group}, score) AS s) AS t GROUP BY {group}"""
auc_by_group = relation("auc_by_group", _GROUPED.format(group="ancestry_group", source="SELECT CASE WHEN lower(ancestry) IN ('eur', 'european') THEN 'eur' ELSE 'other' END AS ancestry_group, score, target FROM {predictions_in}"))
auc_components = relation("auc_components", _GROUPED.format(group="component", source="SELECT 'genetic' AS component, round(genetic_score, 6) AS score, target FROM {score} UNION ALL SELECT 'covariate', round(covariate_score, 6), target FROM {score}"))
binary_metrics = relation("binary_metrics", """
SELECT round(avg(-(target * ln(p) + (1 - target) * ln(1 - p))), 6) AS log_loss, round(avg(CASE WHEN (p >= :threshold) = (target = 1) THEN 1e0 ELSE 0e0 END), 6) AS accuracy
FROM (SELECT target, least(greatest(1 / (1 + exp(-score)), 1e-15), 1 - 1e-15) AS p FROM {predictions_in}) AS q""", threshold=0.5)
regression_metrics = relation("regression_metrics", """
SELECT round(1 - sum((y - f) * (y - f)) / sum((y - m) * (y - m)), 6) AS r2, round(sqrt(avg((y - f) * (y - f))), 6) AS rmse
FROM (SELECT y, score * 1e3 + 4e3 AS f, m FROM {predictions_in} CROSS JOIN (SELECT avg(y) AS m FROM {predictions_in}) AS t) AS q""")
average_precision = relation("average_precision", """
SELECT round(sum(pos * above_pos / (above_pos + above_neg)) / sum(pos), 6) AS average_precision FROM (
  SELECT p.pos, p.before + sum(p.pos) OVER (PARTITION BY p.bucket ORDER BY p.score DESC ROWS UNBOUNDED PRECEDING) * 1e0 AS above_pos,
    n.before + sum(p.neg) OVER (PARTITION BY p.bucket ORDER BY p.score DESC ROWS UNBOUNDED PRECEDING) * 1e0 AS above_neg FROM {scores_down_pos} p JOIN {scores_down_neg} n ON n.score = p.score) AS t""",
    check="""
SELECT round(sum(pos * above_pos / (above_pos + above_neg)) / sum(pos), 6) AS average_precision FROM (
  SELECT pos, sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) * 1e0 AS above_pos, sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) * 1e0 AS above_neg FROM {score_counts}) AS t""")
ranged("people_down", "scored_people", "-score")
#: The best ``share`` of the people, at least one; ties go by id.
top_tail = relation("top_tail", """
SELECT count(*) AS n_top, round(avg(target * 1e0) / max(base), 6) AS enrichment, round((avg(y) - max(mean_y)) / max(std_y), 6) AS shift FROM (
  SELECT target, y, before + row_number() OVER (PARTITION BY bucket ORDER BY score DESC, sample_id) AS rn FROM {people_down}) AS q
CROSS JOIN (SELECT avg(target * 1e0) AS base, avg(y) AS mean_y, stddev_pop(y) AS std_y, count(*) AS n FROM {scored_people}) AS t
WHERE rn <= greatest(1, ceil(n * :share))""",
    check="""
SELECT count(*) AS n_top, round(avg(target * 1e0) / max(base), 6) AS enrichment, round((avg(y) - max(mean_y)) / max(std_y), 6) AS shift FROM (
  SELECT target, y, avg(target * 1e0) OVER () AS base, avg(y) OVER () AS mean_y, stddev_pop(y) OVER () AS std_y, row_number() OVER (ORDER BY score DESC, sample_id) AS rn, count(*) OVER () AS n FROM {predictions_in} WHERE score IS NOT NULL AND NOT isnan(score)) AS q
WHERE rn <= greatest(1, ceil(n * :share))""", share=0.1)
dose_response = relation("dose_response", "SELECT dose, count(*) AS n, round(avg(score), 6) AS mean_score FROM {predictions_in} GROUP BY dose")


def _with_effects(tag: str, chain: tuple[str, ...]) -> None:
    """Copies of a chain of relations, each over the copies of those before it, under names that end in ``tag``."""
    def own(text: str | None) -> str | None:
        for name in chain:
            text = text and text.replace(f"{{{name}}}", f"{{{name}_{tag}}}")
        return text

    for name in chain[1:]:
        r = RELATIONS[name]
        if isinstance(r, Ranged):
            ranged(f"{name}_{tag}", f"{r.source}_{tag}", r.key, r.n)
            continue
        relation(f"{name}_{tag}", own(r.text), own(r.check), **r.params)


#: AUC and average precision of the whole predictor with all effects, and with those of small variants alone.
relation("effects_all", "SELECT * FROM {effects}")
relation("effects_small", "SELECT * FROM {effects} WHERE variant_class IN ('snv', 'small_indel')")
for _tag in ("all", "small"):
    _with_effects(_tag, ("effects", "score"))
    relation(f"predictions_in_{_tag}", f"SELECT sample_id, target, round(genetic_score + covariate_score, 6) AS score FROM {{score_{_tag}}}")
    _with_effects(_tag, ("predictions_in", "score_counts", "scores_up_neg", "scores_down_pos", "scores_down_neg", "auc_counts", "auc", "average_precision"))
metrics_suite = relation("metrics_suite", """
SELECT 'all' AS subset, a.auc, p.average_precision FROM {auc_all} a CROSS JOIN {average_precision_all} p
UNION ALL SELECT 'small', a.auc, p.average_precision FROM {auc_small} a CROSS JOIN {average_precision_small} p""")
