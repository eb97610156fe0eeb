"""Parsing of call-file and annotation text."""

from cohortscore.plans.relation import relation

decode_gt = relation("decode_gt", """
SELECT chrom, pos, gt, CASE WHEN gt IN ('.', './.', '.|.') OR a1 IN ('.', '') OR (n > 1 AND a2 IN ('.', '')) THEN NULL
  WHEN n = 1 THEN CASE WHEN a1 = '0' THEN 0 ELSE 2 END
  ELSE CASE WHEN a1 <> '0' THEN 1 ELSE 0 END + CASE WHEN a2 <> '0' THEN 1 ELSE 0 END END AS dosage
FROM (SELECT *, split_part(g, '/', 1) AS a1, split_part(g, '/', 2) AS a2, length(g) - length(replace(g, '/', '')) + 1 AS n FROM (SELECT *, replace(gt, '|', '/') AS g FROM {vcf_rows}) AS x) AS y""".replace("'.|.'", "concat('.', chr(124), '.')").replace("'|'", "chr(124)"))
parse_info = relation("parse_info", """
SELECT chrom, pos, ref, alt, id, qual, nullif(regexp_extract(concat(';', info), ';SVTYPE=([^;]*)', 1), '') AS svtype, nullif(regexp_extract(concat(';', info), ';SVLEN=([^;,]*)', 1), '') AS svlen,
  nullif(regexp_extract(concat(';', info), ';END=([^;]*)', 1), '') AS end_text, nullif(regexp_extract(concat(';', info), ';AF=([^;,]*)', 1), '') AS af,
  CAST(concat(';', info, ';') LIKE '%;DB;%' AS INT) AS flag_db FROM {vcf_rows}""")
parse_info_map = relation("parse_info_map", "SELECT chrom, pos, nullif(svtype, '.') AS svtype, try_cast(svlen AS DOUBLE) AS svlen, try_cast(end_text AS BIGINT) AS end_pos, try_cast(af AS DOUBLE) AS af, flag_db FROM {parse_info}")
validate_biallelic = relation("validate_biallelic", "SELECT chrom, pos, CAST(alt NOT LIKE '%,%' AND alt <> '.' AS INT) AS biallelic FROM {vcf_rows}")
variant_lengths = relation("variant_lengths", """
SELECT *, length(ref) = 1 AND length(alt) = 1 AND upper(ref) [[RLIKE|SIMILAR TO]] '[ACGTN]' AND upper(alt) [[RLIKE|SIMILAR TO]] '[ACGT]' AS is_snp,
  upper(alt) [[RLIKE '^[ACGTN]+$'|SIMILAR TO '[ACGTN]+']] AS plain, upper(trim(coalesce(nullif(svtype, '.'), regexp_replace(alt, '^<(.*)>$', [['$1'|'\\1']])))) AS token,
  CASE WHEN try_cast(svlen AS DOUBLE) IS NOT NULL THEN abs(try_cast(svlen AS DOUBLE)) WHEN length(ref) = 1 AND length(alt) = 1 THEN 1e0
    WHEN try_cast(end_text AS BIGINT) >= pos THEN CAST(try_cast(end_text AS BIGINT) - pos + 1 AS DOUBLE)
    ELSE CAST(greatest(length(ref), length(alt)) AS DOUBLE) END AS sv_length FROM {parse_info}""")
_CLASS = """CASE WHEN token LIKE '%DEL%' THEN CASE WHEN sv_length >= 1000 THEN 'deletion_long' ELSE 'deletion_short' END
  WHEN token LIKE '%DUP%' OR token LIKE '%CNV%' THEN CASE WHEN sv_length >= 1000 THEN 'duplication_long' ELSE 'duplication_short' END
  WHEN token LIKE '%INS%' OR token LIKE '%ME%' THEN 'insertion_mei' WHEN token LIKE '%INV%' OR token LIKE '%BND%' THEN 'inversion_bnd_complex'
  WHEN token LIKE '%STR%' OR token LIKE '%VNTR%' OR token LIKE '%REPEAT%' THEN 'str_vntr_repeat' ELSE 'other_complex_sv' END"""
variant_defaults = relation("variant_defaults", f"""
SELECT CASE WHEN id = '.' THEN concat(chrom, ':', pos, ':', ref, ':', alt) ELSE id END AS variant_id, chrom, pos, sv_length AS length,
  CASE WHEN is_snp THEN 'snv' WHEN plain AND svtype IS NULL THEN 'small_indel' ELSE {_CLASS} END AS variant_class,
  coalesce(try_cast(af AS DOUBLE), -1e0) AS allele_frequency, try_cast(qual AS DOUBLE) AS quality FROM {{variant_lengths}}""")
#: Ids by place within a chromosome.
positional_ids = relation("positional_ids", "SELECT pos, CASE WHEN id = '.' THEN concat_ws(':', chrom, CAST(pos AS [[STRING|VARCHAR]]), CAST(row_number() OVER (PARTITION BY chrom ORDER BY pos) - 1 AS [[STRING|VARCHAR]])) ELSE id END AS variant_id FROM {vcf_rows}")
sv_class = relation("sv_class", f"SELECT variant_id, token, sv_length, {_CLASS} AS variant_class FROM {{sv_tokens}}")
infer_class_bim = relation("infer_class_bim", f"""
SELECT variant_id, a1, a2, CASE WHEN token IS NOT NULL THEN {_CLASS} WHEN length(a1) = 1 AND length(a2) = 1 THEN 'snv' ELSE 'small_indel' END AS variant_class
FROM (SELECT variant_id, a1, a2, 1e0 AS sv_length, CASE WHEN regexp_extract(upper(a1), '(DEL|DUP|INS|INV|BND|STR|VNTR|ME)', 1) <> '' THEN upper(a1) WHEN regexp_extract(upper(a2), '(DEL|DUP|INS|INV|BND|STR|VNTR|ME)', 1) <> '' THEN upper(a2) END AS token
  FROM {{allele_rows}}) AS x""")
norm_chrom = relation("norm_chrom", """
SELECT variant_id, chrom, CASE WHEN s = 'X' THEN 23 WHEN s = 'Y' THEN 24 WHEN s IN ('M', 'MT') THEN 25 WHEN try_cast(s AS INT) BETWEEN 1 AND 22 THEN try_cast(s AS INT) END AS chrom_id
FROM (SELECT variant_id, chrom, regexp_replace(upper(trim(chrom)), '^CHR', '') AS s FROM {chrom_labels}) AS u""")
parse_bool = relation("parse_bool", """
SELECT variant_id, CASE WHEN lower(trim(flag_text)) IN ('1', 'true', 't', 'yes') THEN 1 WHEN lower(trim(flag_text)) IN ('0', 'false', 'f', 'no') THEN 0 END AS flag FROM {annotations}""")
parse_numeric = relation("parse_numeric", "SELECT variant_id, try_cast(split_part(number_text, ',', 1) AS DOUBLE) AS number, try_cast(split_part(flag_text, ',', 1) AS BIGINT) AS maybe FROM {annotations}")
parse_weighted = relation("parse_weighted", """
SELECT variant_id, split_part(item, '=', 1) AS level, try_cast(split_part(item, '=', 2) AS DOUBLE) AS weight FROM (SELECT variant_id, [[explode(split(weighted_text, ','))|unnest(string_split(weighted_text, ','))]] AS item FROM {annotations}) AS x""")
parse_nested = relation("parse_nested", """
SELECT variant_id, trim(split_part(path_text, '>', 1)) AS level1, trim(split_part(path_text, '>', 2)) AS level2, trim(split_part(path_text, '>', 3)) AS level3,
  concat_ws('::', trim(split_part(path_text, '>', 1)), trim(split_part(path_text, '>', 2)), trim(split_part(path_text, '>', 3))) AS encoded FROM {annotations}""")
parse_pca = relation("parse_pca", """
SELECT variant_id, try_cast(split_part(p, ',', 1) AS DOUBLE) AS pc1, try_cast(split_part(p, ',', 2) AS DOUBLE) AS pc2, try_cast(split_part(p, ',', 3) AS DOUBLE) AS pc3, try_cast(nullif(split_part(p, ',', 4), '') AS DOUBLE) AS pc4
FROM (SELECT variant_id, CASE WHEN length(pca_text) <= 8192 THEN translate(trim(pca_text), '[]', '') END AS p FROM {annotations}) AS x""")
#: The first rule that all non-blank values satisfy: bool, float, weighted levels, nested path, else categorical.
annotation_kinds = relation("annotation_kinds", """
SELECT name, CASE WHEN bool_and(lower(trim(v)) IN ('1', '0', 'true', 'false', 'yes', 'no')) THEN 'bool' WHEN bool_and(try_cast(v AS DOUBLE) IS NOT NULL) THEN 'float'
  WHEN bool_and(v LIKE '%=%') THEN 'weighted' WHEN bool_and(v LIKE '%>%') THEN 'nested' ELSE 'categorical' END AS kind
FROM (SELECT 'flag_text' AS name, flag_text AS v FROM {annotations} UNION ALL SELECT 'number_text', number_text FROM {annotations} UNION ALL SELECT 'weighted_text', weighted_text FROM {annotations}
  UNION ALL SELECT 'path_text', path_text FROM {annotations} UNION ALL SELECT 'level_text', level_text FROM {annotations}) AS a WHERE trim(v) <> '' GROUP BY name""")
extract_chrom = relation("extract_chrom", "SELECT variant_id, regexp_extract(variant_id, 'chr([0-9]+)', 1) AS chrom FROM (SELECT concat('chr', chrom, ':', pos) AS variant_id FROM {variants}) AS v")
resolve_alias = relation("resolve_alias", """
SELECT q.person_id, q.asked, d.canonical FROM {asked_names} q LEFT JOIN {phenotype_names} d ON d.name = replace(replace(lower(trim(q.asked)), ' ', '_'), '-', '_')""")
unpack_2bit = relation("unpack_2bit", """
SELECT b.code AS byte_value, k.k AS slot, CASE CAST(floor(b.code / k.p) AS BIGINT) % 4 WHEN 0 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 0 END AS dosage
FROM (SELECT DISTINCT p_partkey % 256 AS code FROM {part}) AS b CROSS JOIN (VALUES (0, 1e0), (1, 4e0), (2, 16e0), (3, 64e0)) AS k(k, p)""")
sigmoid = relation("sigmoid", """
SELECT sample_id, round(CASE WHEN score >= 0 THEN 1 / (1 + exp(-score)) ELSE exp(score) / (1 + exp(score)) END, 6) AS p, round(greatest(score, 0e0) + ln(1 + exp(-abs(score))), 6) AS log1pexp,
  round(least(score, 0e0) - ln(1 + exp(-abs(score))), 6) AS log_sigmoid FROM {predictions_in}""")
jj_lambda = relation("jj_lambda", "SELECT sample_id, round(CASE WHEN abs(score) < 1e-6 THEN 125e-3 ELSE ((exp(score / 2) - exp(-score / 2)) / (exp(score / 2) + exp(-score / 2))) / (4 * score) END, 6) AS jj FROM {predictions_in}")
#: A run may be taken up again if all of its settings are those wanted, nulls included.
run_metadata_match = relation("run_metadata_match", """
SELECT run_id, count(*) AS n_settings, CAST(bool_and(wanted IS NOT DISTINCT FROM found) AS INT) AS same FROM {run_settings} GROUP BY run_id""")
run_status = relation("run_status", """
SELECT run_id, CASE WHEN summary = 1 THEN 'COMPLETE' WHEN checkpoints > 0 THEN 'IN-PROGRESS' ELSE 'NOT-STARTED' END AS status FROM {runs}""")
