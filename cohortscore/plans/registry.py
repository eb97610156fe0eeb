"""The queries that drivers can run, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from cohortscore.functions import parse  # noqa: F401
from cohortscore.operators import components, intervals, joins, linalg, metrics, report, screen, stats, ties  # noqa: F401

from . import proxies  # noqa: F401
from .files import FILES, files_sql
from .relation import build, oracle
from .special import SPECIAL, special_sql

#: Keys that are a relation under another name, so that operators keep unrounded columns for each other.
_ALIASES = {"allele_freq": "allele_freq_report"}
KEYS = """
variant_stats variant_stats_float standardization_params allele_freq maf maf_filter standardize subset_variants subset_samples concat_sources validate_inputs
class_counts is_structural route_variants route_counts residualize screen_partials screen_finalize proj_diag marginal_z marginal_screen marginal_screen_protected sparse_marginal_z
matvec rmatvec block_matvec block_transpose_matvec block_gram block_partition score_samples predictor_variance posterior_logit predictions predictions_quantitative coefficient_table global_scale elbo_terms elbo_data prior_design
tie_groups tie_groups_windowed collapse_ties tie_weights expand_coefficients ld_block_join validate_blocks sv_event_edges restore_order region_filter split_regions
sample_filter sample_join sample_duplicates resolve_key align_samples sample_intersection metadata_join metadata_orphans merge_pcs concept_closure cohort_query cohort_features case_control cohort_counts
one_hot one_hot_drop_majority infer_trait survey_positive survey_split survey_diagnostic eval_pool dedupe_first hash_split
decode_gt parse_info_map validate_biallelic variant_defaults positional_ids sv_class infer_class_bim norm_chrom parse_bool parse_numeric parse_weighted parse_nested parse_pca annotation_kinds extract_chrom resolve_alias
unpack_2bit sigmoid jj_lambda run_metadata_match run_status avg_rank auc auc_two_group auc_by_group auc_components binary_metrics regression_metrics average_precision metrics_suite top_tail dose_response
effects_by_class effects_by_chrom class_by_chrom effect_percentiles effect_quartiles length_by_class af_spectrum length_vs_effect af_vs_effect effect_histogram rank_curve cumulative_variance variance_milestones effect_cdf manhattan_offsets top_variants
""".split()


def _run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(spark, sf_dir, name)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: partial(_run, _ALIASES.get(k, k)) for k in KEYS} | SPECIAL | FILES


def oracle_sql() -> dict[str, str]:
    return {k: oracle(_ALIASES.get(k, k)) for k in KEYS} | special_sql() | files_sql()
