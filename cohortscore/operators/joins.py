"""Sample alignment, cohort building from clinical events, and set operations."""

from cohortscore.plans.relation import relation

sample_filter = relation("sample_filter", """
SELECT sample_id, round(target, 6) AS target, covariate, ordinal FROM (
  SELECT sample_id, try_cast(target_text AS DOUBLE) AS target, try_cast(covariate_text AS DOUBLE) AS covariate, ordinal FROM {raw_samples}) AS r
WHERE target IS NOT NULL AND NOT isnan(target) AND covariate IS NOT NULL AND NOT isnan(covariate)""")
sample_join = relation("sample_join", """
SELECT g.sample_id, g.source_ordinal, s.target, s.covariate FROM {genotyped} g JOIN {sample_filter} s ON s.sample_id = g.sample_id""")
sample_duplicates = relation("sample_duplicates", "SELECT sample_id, count(*) AS n FROM {sample_join} GROUP BY sample_id HAVING count(*) > 1")
#: Most matches; ties go to sample_id, then research_id, then person_id.
resolve_key = relation("resolve_key", """
SELECT min_by(k.name, k.place) AS key_column, max(k.n) AS matches FROM (
  SELECT name, place, n, max(n) OVER () AS best FROM (
    SELECT 'sample_id' AS name, 1 AS place, count(*) AS n FROM {raw_samples} r [[LEFT SEMI|SEMI]] JOIN {genotyped} g ON g.sample_id = r.sample_id
    UNION ALL SELECT 'research_id', 2, count(*) FROM {raw_samples} r [[LEFT SEMI|SEMI]] JOIN {genotyped} g ON g.sample_id = r.research_id
    UNION ALL SELECT 'person_id', 3, count(*) FROM {raw_samples} r [[LEFT SEMI|SEMI]] JOIN {genotyped} g ON g.sample_id = r.person_id) AS c) AS k WHERE n = best""")
align_samples = relation("align_samples", """
SELECT g.sample_id, r.ordinal, CASE WHEN r.sample_id IS NULL THEN 1 ELSE 0 END AS missing FROM {genotyped} g LEFT JOIN {raw_samples} r ON r.sample_id = g.sample_id""")
sample_intersection = relation("sample_intersection", """
SELECT a.sample_id, min(a.source_ordinal) AS ordinal FROM {genotyped} a JOIN {raw_samples} b ON b.sample_id = a.sample_id JOIN {raw_samples} c ON c.research_id = a.sample_id GROUP BY a.sample_id""")
metadata_join = relation("metadata_join", """
SELECT v.variant_id, v.variant_class, coalesce(try_cast(a.number_text AS DOUBLE), v.length) AS length, coalesce(a.level_text, 'none') AS level_text
FROM {variants} v LEFT JOIN {annotations} a ON a.variant_id = v.variant_id""")
metadata_orphans = relation("metadata_orphans", "SELECT a.variant_id FROM {annotations} a [[LEFT ANTI|ANTI]] JOIN (SELECT variant_id FROM {variants} WHERE support > 40) v ON v.variant_id = a.variant_id")
merge_pcs = relation("merge_pcs", """
SELECT s.sample_id, s.y, round(try_cast(split_part(translate(a.pca_text, '[]', ''), ',', 1) AS DOUBLE), 6) AS pc1, round(try_cast(split_part(translate(a.pca_text, '[]', ''), ',', 2) AS DOUBLE), 6) AS pc2
FROM {samples} s LEFT JOIN {annotations} a ON a.variant_id = s.sample_id""")
concept_closure = relation("concept_closure", "SELECT DISTINCT descendant_id FROM {ancestors} WHERE concept_name IN (:root, :second_root)", root="ASIA", second_root="EUROPE")

#: The cohort query: people with a record period, their visits, matched conditions and consent.
cohort = relation("cohort", """
WITH aggregated AS (SELECT person_id, count(*) AS n_conditions, min(condition_date) AS first_condition_date
  FROM {conditions} c [[LEFT SEMI|SEMI]] JOIN {concept_closure} k ON k.descendant_id = c.concept_id GROUP BY person_id),
visit_counts AS (SELECT person_id, count(*) AS n_visits FROM {visits} GROUP BY person_id),
consent AS (SELECT person_id, min(observation_date) AS primary_consent_date FROM {consents} GROUP BY person_id)
SELECT p.person_id, coalesce(a.n_conditions, 0) AS phenotype_occurrence_count,
  CASE WHEN coalesce(a.n_conditions, 0) >= :least_conditions THEN 1 WHEN coalesce(a.n_conditions, 0) = 0 THEN 0 END AS target,
  a.first_condition_date, p.start_date, p.end_date, c.primary_consent_date, year(p.start_date) - r.year_of_birth AS age,
  [[datediff(p.end_date, p.start_date)|date_diff('day', p.start_date, p.end_date)]] AS observation_days, coalesce(v.n_visits, 0) AS n_visits, r.gender_concept_id
FROM {periods} p JOIN {persons} r ON r.person_id = p.person_id LEFT JOIN visit_counts v ON v.person_id = p.person_id
LEFT JOIN aggregated a ON a.person_id = p.person_id LEFT JOIN consent c ON c.person_id = p.person_id""", least_conditions=2)
cohort_query = relation("cohort_query", """
SELECT CAST(person_id AS [[STRING|VARCHAR]]) AS sample_id, target, phenotype_occurrence_count, CAST(first_condition_date AS [[STRING|VARCHAR]]) AS first_condition_date,
  CAST(start_date AS [[STRING|VARCHAR]]) AS observation_start_date, CAST(end_date AS [[STRING|VARCHAR]]) AS observation_end_date,
  CAST(primary_consent_date AS [[STRING|VARCHAR]]) AS primary_consent_date, gender_concept_id FROM {cohort}""")
cohort_features = relation("cohort_features", """
SELECT person_id, CAST(age AS BIGINT) AS age, CAST(age * age AS BIGINT) AS age_squared, CAST(observation_days AS BIGINT) AS observation_days, round(ln(1 + n_visits), 6) AS log1p_n_visits FROM {cohort}""")
case_control = relation("case_control", "SELECT person_id, target FROM {cohort} WHERE target IS NOT NULL")
cohort_counts = relation("cohort_counts", "SELECT count(*) FILTER (WHERE target = 1) AS n_cases, count(*) FILTER (WHERE target = 0) AS n_controls, count(*) FILTER (WHERE target IS NULL) AS n_excluded_ambiguous FROM {cohort}")
#: The smallest concept id has no column.
one_hot = relation("one_hot", """
SELECT person_id, CAST(gender_concept_id = 1 AS INT) AS gender_concept_id_1, CAST(gender_concept_id = 2 AS INT) AS gender_concept_id_2, CAST(gender_concept_id = 3 AS INT) AS gender_concept_id_3
FROM {cohort} WHERE target IS NOT NULL""")
one_hot_drop_majority = relation("one_hot_drop_majority", """
SELECT name, round(share, 6) AS share, CASE WHEN row_number() OVER (ORDER BY share DESC, name DESC) = 1 THEN 1 ELSE 0 END AS dropped FROM (
  SELECT 'gender_concept_id_1' AS name, avg(gender_concept_id_1 * 1e0) AS share FROM {one_hot} UNION ALL SELECT 'gender_concept_id_2', avg(gender_concept_id_2 * 1e0) FROM {one_hot}
  UNION ALL SELECT 'gender_concept_id_3', avg(gender_concept_id_3 * 1e0) FROM {one_hot}) AS s""")
infer_trait = relation("infer_trait", """
SELECT 'target' AS column_name, CASE WHEN count(*) FILTER (WHERE target NOT IN (0, 1)) = 0 THEN 'binary' ELSE 'quantitative' END AS trait_type FROM {samples}
UNION ALL SELECT 'y', CASE WHEN count(*) FILTER (WHERE y NOT IN (0, 1)) = 0 THEN 'binary' ELSE 'quantitative' END FROM {samples}""")
survey_positive = relation("survey_positive", "SELECT DISTINCT CAST(person_id AS [[STRING|VARCHAR]]) AS person_id FROM {survey} WHERE (lower(question) LIKE '%user%' OR lower(question) LIKE '%human%') AND lower(answer) LIKE '%the%'")
survey_split = relation("survey_split", """
SELECT p.person_id, 1 AS positive FROM (SELECT DISTINCT person_id FROM {survey}) p [[LEFT SEMI|SEMI]] JOIN {survey_positive} s ON s.person_id = CAST(p.person_id AS [[STRING|VARCHAR]])
UNION ALL SELECT p.person_id, 0 FROM (SELECT DISTINCT person_id FROM {survey}) p [[LEFT ANTI|ANTI]] JOIN {survey_positive} s ON s.person_id = CAST(p.person_id AS [[STRING|VARCHAR]])""")
survey_diagnostic = relation("survey_diagnostic", """
SELECT source, lang, text AS answer, count(DISTINCT doc_id) AS n_people FROM {documents} WHERE lower(text) LIKE '%the%'
GROUP BY source, lang, text ORDER BY n_people DESC, source NULLS LAST, lang NULLS LAST, answer LIMIT 30""")
#: Controls, and persons whose phenotype is missing.
eval_pool = relation("eval_pool", "SELECT sample_id FROM {samples} WHERE target = 0 UNION SELECT CAST(person_id AS BIGINT) FROM {cohort} WHERE target IS NULL")
dedupe_first = relation("dedupe_first", """
SELECT chrom, pos, variant_id, source FROM (SELECT *, row_number() OVER (PARTITION BY chrom, pos, variant_id ORDER BY source, ordinal) AS rn FROM (
  SELECT chrom, pos, variant_id, 0 AS source, variant_id AS ordinal FROM {variants} WHERE variant_id % 2 = 0 UNION ALL SELECT chrom, pos, variant_id, 1, variant_id FROM {variants}) AS u) AS r WHERE rn = 1""")
#: First 16 hex digits below the fraction's: 0.2 of 2^64.
hash_split = relation("hash_split", """
SELECT sample_id, CASE WHEN substr([[sha2|sha256]](concat(:seed, CAST(sample_id AS [[STRING|VARCHAR]]))[[, 256|]]), 1, 16) < :threshold THEN 'test' ELSE 'train' END AS part FROM {samples}""", seed="cohort/split/seed=42|", threshold="3333333333333333")
