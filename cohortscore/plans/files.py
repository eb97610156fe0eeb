"""Queries that go through files: what they read was written by Spark tasks to the shared folder just before."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortscore.operators import components
from cohortscore.sources import bcf, bed, bgzf, dataset, tables, vcf

from . import special
from .relation import build, oracle, relation

#: Variants in one trio of ``transcode``; a trio is written by one task.
TRIO_VARIANTS = 100_000
#: Trios written at least, so that even small tables are put together from several.
LEAST_TRIOS = 3


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that all executors share."""
    components.shared_dir(spark)
    return f"{spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def _trios(spark: SparkSession, sf_dir: str, made: dict[str, DataFrame]) -> list[tuple[str, int]]:
    """Paths of the trios of all calls with the number of variants before each, in the order of their variants."""
    where = _folder(spark, "trios").removeprefix("file:")
    sites = build(spark, sf_dir, "placed_sites", made)
    parts = max(LEAST_TRIOS, -(-sites.count() // TRIO_VARIANTS))
    told = dataset.write_trios(build(spark, sf_dir, "calls", made), sites, special.places(build(spark, sf_dir, "samples", made)), where, parts)
    found, before = [], 0
    for r in told.orderBy("part").collect():  # a row for each trio
        found.append((f"{where}/part-{r['part']}.bed", before))
        before += r["n_variants"]
    return found


def scan_bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carriers and missing calls of two-bit files of all variants, numbered through."""
    made: dict[str, DataFrame] = {}
    trios, n = _trios(spark, sf_dir, made), build(spark, sf_dir, "samples", made).count()
    spark.dataSource.register(bed.BedSource)
    empty = spark.createDataFrame([], "variant_index long, sample_index long, dosage int")
    read = [spark.read.format("bed2bit").option("samples", n).load(p).withColumn("variant_index", F.col("variant_index") + before) for p, before in trios]
    return reduce(DataFrame.unionByName, read, empty)


def transcode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls written as trios of variant ranges, and loaded from all of them again."""
    empty = spark.createDataFrame([], "sample_id string, variant_id string, dosage int")
    return reduce(DataFrame.unionByName, [dataset.named_calls(spark, p) for p, _ in _trios(spark, sf_dir, {})], empty)


def scan_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample table written as tab-separated text and read back, all columns as text; empty fields are null."""
    path = _folder(spark, "samples")
    wanted = build(spark, sf_dir, "raw_samples").select("sample_id", "research_id", "person_id", F.nullif("covariate_text", F.lit("")).alias("covariate_text"))
    wanted.write.csv(path, sep="\t", header=True)
    return tables.delimited(spark, path)


#: The header line's fields before the samples.
HEAD = "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT"])
#: Names of a header line that are put together in one group.
NAMES = 1 << 15
#: Bytes of a compressed file that one task reads, so that even small tables are read by several.
FILE_RANGE = 1 << 17


def scan_bgzf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of all variants from block-compressed call files, each read by ranges of blocks."""
    made: dict[str, DataFrame] = {}
    names, _ = dataset.name_pieces(special.places(build(spark, sf_dir, "samples", made)).select("ordinal", F.col("sample_id").alias("name")), _folder(spark, "names").removeprefix("file:"))
    head = [HEAD.encode(), *names, b"\n"]
    told = dataset.write_blocks(special.vcf_text(spark, sf_dir), head, _folder(spark, "blocks").removeprefix("file:")).collect()  # a row a file
    spark.dataSource.register(bgzf.BgzfText)
    text = [spark.read.format("bgzftext").option("bytesPerPartition", FILE_RANGE).load(r["path"]) for r in told]
    empty = spark.createDataFrame([], "value string")
    return vcf.calls(reduce(DataFrame.unionByName, text, empty)).select("variant_id", F.col("sample_index").cast("long").alias("sample_index"), "dosage")


def scan_bcf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of all variants from binary call files, each read by ranges of blocks."""
    made: dict[str, DataFrame] = {}
    sites = build(spark, sf_dir, "placed_sites", made).select(F.concat(F.lit("v"), "variant_id").alias("variant_id"), "chrom", "pos", F.lit("A").alias("ref"), F.lit("G").alias("alt"))
    calls = build(spark, sf_dir, "calls", made).withColumn("variant_id", F.concat(F.lit("v"), "variant_id"))
    told = dataset.write_binary(calls, sites, special.places(build(spark, sf_dir, "samples", made)), _folder(spark, "binary").removeprefix("file:")).collect()  # a row a file
    spark.dataSource.register(bcf.BcfSource)
    empty = spark.createDataFrame([], "variant_id string, x struct<at:int,dosage:int>")
    read = [spark.read.format("bcf2").option("bytesPerPartition", FILE_RANGE).load(r["path"]).select(F.col("id").alias("variant_id"), F.explode(F.arrays_zip("at", "dosage")).alias("x")) for r in told]
    return reduce(DataFrame.unionAll, read, empty).select("variant_id", F.col("x.at").cast("long").alias("sample_index"), F.col("x.dosage").alias("dosage"))


def load_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of a text call file for the samples of a table with finite values, as the loader joins them."""
    made: dict[str, DataFrame] = {}
    order = special.places(build(spark, sf_dir, "samples", made)).select("ordinal", F.concat(F.lit("S"), "sample_id").alias("name"))
    joined = lambda of: F.array_join(F.transform(F.sort_array(F.collect_list(of)), lambda x: x["text"]), "\t")
    parts = order.groupBy(F.floor(F.col("ordinal") / NAMES).alias("part")).agg(joined(F.struct("ordinal", F.col("name").alias("text"))).alias("text"))
    head = parts.agg(F.concat_ws("\t", F.lit(HEAD), F.nullif(joined(F.struct("part", "text")), F.lit(""))).alias("value"))  # one line of a text file
    calls, table = f"{_folder(spark, 'calls')}.vcf", _folder(spark, "samples")
    head.write.text(calls)
    special.vcf_text(spark, sf_dir).write.mode("append").text(calls)
    build(spark, sf_dir, "raw_samples", made).select("sample_id", "target_text", "covariate_text").write.csv(table, sep="\t", header=True)
    return dataset.load_dataset(spark, [calls], table, "target_text", ["covariate_text"]).calls


def artifact_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients saved with their settings' fingerprint and loaded by it."""
    path, settings = _folder(spark, "artifact"), {"minimum_maf": special.MINIMUM_MAF}
    tables.save_artifact(path, build(spark, sf_dir, "effects").select("variant_id", "beta", "beta_variance"), settings)
    found = tables.load_artifact(spark, path, settings)
    if found is None:
        raise RuntimeError("the artifact has another fingerprint than the one just saved")
    return found


relation("placed_sites", "SELECT variant_id, CAST(variant_id % 22 + 1 AS INT) AS chrom, CAST(1000 + 15 * variant_id AS BIGINT) AS pos FROM {sites}")
relation("site_order", "SELECT variant_id, row_number() OVER (ORDER BY chrom, pos, variant_id) - 1 AS place FROM {placed_sites}")
relation("scan_bed_oracle", "SELECT CAST(v.place AS BIGINT) AS variant_index, CAST(p.ordinal AS BIGINT) AS sample_index, c.dosage FROM {calls} c JOIN {site_order} v ON v.variant_id = c.variant_id JOIN {sample_places} p ON p.sample_id = c.sample_id")
relation("scan_bgzf_oracle", "SELECT * FROM {scan_vcf_oracle}")
relation("scan_bcf_oracle", "SELECT * FROM {scan_vcf_oracle}")
relation("transcode_oracle", "SELECT CAST(c.sample_id AS VARCHAR) AS sample_id, CAST(c.variant_id AS VARCHAR) AS variant_id, c.dosage FROM {calls} c JOIN {sites} v ON v.variant_id = c.variant_id JOIN {samples} s ON s.sample_id = c.sample_id")
relation("scan_delimited_oracle", "SELECT sample_id, research_id, person_id, covariate_text FROM {raw_samples}")
relation("load_dataset_oracle", """SELECT concat('S', c.sample_id) AS sample_id, concat('v', c.variant_id) AS variant_id, c.dosage FROM {calls} c
JOIN {raw_samples} s ON s.ordinal = c.sample_id WHERE s.target_text NOT IN ('', 'NaN') AND s.covariate_text <> 'x'""")
relation("artifact_roundtrip_oracle", "SELECT variant_id, beta, beta_variance FROM {effects}")

FILES = {f.__name__: f for f in (scan_bed, scan_bgzf, scan_bcf, transcode, scan_delimited, load_dataset, artifact_roundtrip)}


def files_sql() -> dict[str, str]:
    return {k: oracle(f"{k}_oracle") for k in FILES}
