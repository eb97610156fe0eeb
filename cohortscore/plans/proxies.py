"""Cohort relations over the star-schema test tables."""

from .relation import relation

_CALLS = """SELECT o_custkey AS sample_id, {variant} AS variant_id,
  CASE WHEN (o_custkey + {variant}) % 37 = 0 THEN NULL ELSE CAST(least(count(*), 2) AS INT) END AS dosage
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey GROUP BY o_custkey, {variant}"""

relation("calls", _CALLS.format(variant="l_partkey % 200"))
relation("calls_rare", _CALLS.format(variant="l_partkey"))
relation("sites", "SELECT DISTINCT p_partkey % 200 AS variant_id FROM {part}")
relation("samples", """SELECT c_custkey AS sample_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS target,
  c_acctbal AS y, CAST(c_nationkey AS DOUBLE) AS cov FROM {customer}""")
relation("variants", """SELECT p_partkey AS variant_id, CAST(p_partkey % 22 + 1 AS INT) AS chrom,
  CAST(1000 + 15 * ((p_partkey - p_partkey % 22) / 22) AS BIGINT) AS pos,
  CASE p_type WHEN 'ECONOMY' THEN 'deletion_short' WHEN 'SMALL' THEN 'deletion_long' WHEN 'MEDIUM' THEN 'duplication_short'
    WHEN 'PROMO' THEN 'insertion_mei' WHEN 'STANDARD' THEN 'snv' ELSE 'small_indel' END AS variant_class,
  CAST(500 + 10 * p_size AS DOUBLE) AS length, CAST(4 * p_size AS BIGINT) AS support, p_size % 3 = 0 AS is_repeat FROM {part}""")
relation("effects", """SELECT variant_id, chrom, pos, variant_class, length, support,
  CASE WHEN variant_id % 5 = 0 THEN 0e0 ELSE round(sin(variant_id * 1e0) * 5e-2, 6) END AS beta,
  1e-3 * (1 + support / 4 % 7) AS beta_variance,
  round(abs(cos(variant_id * 1e0)) / 2, 4) AS allele_frequency FROM {variants}""")
relation("blocks", """SELECT c.chrom, CAST(1000 + 200 * k.k AS BIGINT) AS block_start, CAST(1000 + 200 * k.k + 150 AS BIGINT) AS block_end,
  CAST(row_number() OVER (ORDER BY c.chrom, k.k) - 1 AS BIGINT) AS block_id
FROM (SELECT DISTINCT chrom FROM {variants}) AS c CROSS JOIN (SELECT DISTINCT CAST(floor((pos - 1000) / 200e0) AS BIGINT) AS k FROM {variants}) AS k""")
relation("conditions", "SELECT user_id AS person_id, CAST(ts AS DATE) AS condition_date, 100 + user_id % 25 AS concept_id FROM {events} WHERE event_type = 'error'")
relation("visits", "SELECT user_id AS person_id, CAST(ts AS DATE) AS visit_date FROM {events}")
relation("periods", "SELECT user_id AS person_id, min(CAST(ts AS DATE)) AS start_date, max(CAST(ts AS DATE)) AS end_date FROM {events} GROUP BY user_id")
relation("persons", "SELECT c_custkey AS person_id, 1940 + c_nationkey * 2 AS year_of_birth, CAST(c_nationkey % 4 AS BIGINT) AS gender_concept_id FROM {customer}")
relation("consents", "SELECT o_custkey AS person_id, CAST(o_orderdate AS DATE) AS observation_date FROM {orders} WHERE o_orderpriority = '1-URGENT'")
relation("ancestors", "SELECT r_regionkey AS ancestor_id, n_nationkey + 100 AS descendant_id, r_name AS concept_name FROM {region} JOIN {nation} ON n_regionkey = r_regionkey")
relation("survey", "SELECT conv_id AS person_id, role AS question, text AS answer FROM {conversations}")
relation("vcf_rows", """SELECT k.chrom, 100 * p_partkey AS pos, CASE WHEN k.id = '.' THEN '.' ELSE concat(k.id, '_', p_partkey) END AS id, k.ref, k.alt, k.qual,
  replace(replace(k.info, 'LEN', CAST(30 * p_size AS [[STRING|VARCHAR]])), 'LAST', CAST(100 * p_partkey + 30 * p_size AS [[STRING|VARCHAR]])) AS info, k.gt
FROM {part} JOIN (VALUES
  (0, '1', 'rs1', 'A', 'G', '50', 'AF=0.25;DP=10;DB', '0/0'), (1, '1', '.', 'A', 'AT', '.', 'AF=0.1,0.2;SVTYPE=.', '0|1'),
  (2, '2', 'sv1', 'N', '<DEL>', '99', 'SVTYPE=DEL;SVLEN=-LEN;END=LAST', '1/1'), (3, '2', '.', 'N', '<DUP>', '12.5', 'SVTYPE=DUP;END=LAST', './.'),
  (4, 'chrX', '.', 'N', '<INS:ME:ALU>', 'bad', 'SVLEN=LEN', '1'), (5, '22', 'bnd', 'C', '<BND>', '7', '.', '.|1'), (6, '7', '.', 'ATG', 'A', '30', 'AF=.', '0/2')
) AS k(k, chrom, id, ref, alt, qual, info, gt) ON k.k = p_partkey % 7""")
relation("sv_tokens", """SELECT p_partkey AS variant_id, k.token, 25e0 * p_size AS sv_length FROM {part} JOIN (VALUES
  (0, 'DEL'), (1, 'DUP:TANDEM'), (2, 'CNV'), (3, 'INS'), (4, 'LINE_ME'), (5, 'INV'), (6, 'BND'), (7, 'VNTR'), (8, 'STR'), (9, 'XYZ')) AS k(k, token) ON k.k = p_partkey % 10""")
relation("allele_rows", """SELECT p_partkey AS variant_id, k.a1, k.a2 FROM {part} JOIN (VALUES
  (0, 'A', 'G'), (1, 'A', 'AT'), (2, '<DEL>', 'N'), (3, 'N', '<DUP>'), (4, 'N', '<INS:ME>'), (5, 'C', '<INV>')) AS k(k, a1, a2) ON k.k = p_partkey % 6""")
relation("chrom_labels", """SELECT p_partkey AS variant_id, CASE p_size % 5 WHEN 0 THEN concat('chr', p_size) WHEN 1 THEN CAST(p_size AS [[STRING|VARCHAR]]) WHEN 2 THEN concat(' CHR', p_size % 23, ' ')
  WHEN 3 THEN CASE p_partkey % 4 WHEN 0 THEN 'X' WHEN 1 THEN 'chry' WHEN 2 THEN 'MT' ELSE 'chrM' END ELSE p_brand END AS chrom FROM {part}""")
relation("asked_names", """SELECT c_custkey AS person_id, CASE c_nationkey % 5 WHEN 0 THEN 'HTN' WHEN 1 THEN ' high blood pressure ' WHEN 2 THEN 't2d' WHEN 3 THEN 'Sleep-Apnea' ELSE c_mktsegment END AS asked FROM {customer}""")
#: Aliases of phenotypes.
relation("phenotype_names", """SELECT name, canonical FROM (VALUES ('htn', 'hypertension'), ('high_blood_pressure', 'hypertension'), ('hypertension', 'hypertension'),
  ('t2d', 'type2_diabetes'), ('type2_diabetes', 'type2_diabetes'), ('sleep_apnea', 'sleep_apnea'), ('osa', 'sleep_apnea')) AS t(name, canonical)""")
relation("run_settings", """SELECT o_custkey AS run_id, o_orderpriority AS name, min(o_orderstatus) AS wanted, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE max(o_orderstatus) END AS found FROM {orders} GROUP BY o_custkey, o_orderpriority""")
relation("runs", """SELECT c.c_custkey AS run_id, count(o.o_orderkey) FILTER (WHERE o.o_orderstatus = 'F') AS checkpoints, CAST(count(o.o_orderkey) FILTER (WHERE o.o_orderstatus = 'P') > 0 AS INT) AS summary
FROM {customer} c LEFT JOIN {orders} o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey""")
relation("annotations", """SELECT doc_id AS variant_id, CASE WHEN doc_id % 3 = 0 THEN ' Yes ' WHEN doc_id % 3 = 1 THEN 'F' ELSE '1' END AS flag_text,
  CAST(n_chars AS [[STRING|VARCHAR]]) AS number_text, concat('a=', CAST(doc_id % 10 / 10e0 AS [[STRING|VARCHAR]]), ',b=0.5') AS weighted_text,
  concat(source, ' > ', lang, '>x') AS path_text, lang AS level_text,
  concat('[', doc_id % 7, '.5,', doc_id % 3, ',-1.25]') AS pca_text FROM {documents}""")
relation("raw_samples", """SELECT concat('S', c_custkey) AS sample_id, CASE WHEN c_custkey % 11 = 0 THEN 'NaN' WHEN c_custkey % 13 = 0 THEN '' ELSE CAST(c_acctbal AS [[STRING|VARCHAR]]) END AS target_text,
  CASE WHEN c_custkey % 17 = 0 THEN 'x' ELSE CAST(c_nationkey AS [[STRING|VARCHAR]]) END AS covariate_text, concat('S', c_custkey + 5) AS research_id, CAST(c_custkey AS [[STRING|VARCHAR]]) AS person_id, c_custkey AS ordinal FROM {customer}""")
relation("genotyped", "SELECT DISTINCT concat('S', o_custkey) AS sample_id, o_custkey AS source_ordinal FROM {orders}")
relation("predictions_in", """SELECT s.sample_id, s.target, s.y, round(sin(s.sample_id * 1e0) + s.target * 3e-1, 2) AS score,
  CASE WHEN s.sample_id % 4 = 0 THEN 'EUR' WHEN s.sample_id % 4 = 1 THEN 'European' ELSE 'afr' END AS ancestry, CAST(s.sample_id % 6 AS INT) AS dose FROM {samples} s""")
