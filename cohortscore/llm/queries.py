"""The registered queries of this subpackage and, where SQL expresses them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, divergence, fim, jaccard, langid, licenses, linededup, media, mixing, packing, suffixdedup, tokens, warc
from .common import table


def bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffix sums of the length histogram of all documents: one row for each length that occurs."""
    return tokens.suffix_sums(tokens.length_histogram(table(spark, sf_dir, "documents"), bpe_path()))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup(table(spark, sf_dir, "documents"))
    sha = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256")
    return kept.select("doc_id", "n_lines", "n_removed", "n_spans", sha)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), bpe_path())


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.repeats(table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(table(spark, sf_dir, "pages"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_media_columns, op2_token_counts, op3_language_id, op4_line_dedup, op5_license_scan,
        op6_nearest_neighbours, op7_best_fit_packing, op8_suffix_array_dedup, op9_source_mixing, op10_jaccard_join,
        op11_warc, op12_source_divergence, op13_fill_in_middle,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_line_dedup": linededup.oracle_sql(),
        "op5_license_scan": licenses.oracle_sql(),
        "op8_suffix_array_dedup": suffixdedup.oracle_sql(),
        "op9_source_mixing": mixing.oracle_sql(),
        "op10_jaccard_join": jaccard.oracle_sql(),
        "op11_warc": warc.oracle_sql(),
        "op12_source_divergence": divergence.oracle_sql(),
        "op13_fill_in_middle": fim.oracle_sql(),
    }
