"""Delimited sample tables, block tables, and saved artifacts."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def delimiter(first_line: str) -> str:
    """Tab if the header has at least as many tabs as commas."""
    return "\t" if first_line.count("\t") >= first_line.count(",") else ","


def delimited(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; short rows are padded with nulls, long ones cut."""
    first = spark.read.text(path).first()
    return spark.read.csv(path, sep=delimiter(first["value"] if first else ""), header=True, mode="PERMISSIVE")


def require_columns(df: DataFrame, names: list[str], what: str) -> None:
    if lost := [n for n in names if n not in df.columns]:
        raise ValueError(f"{what} lacks columns: {', '.join(lost)}")


def score_column(columns: list[str], purpose: str = "evaluation") -> str:
    """The first of the purpose's score columns that there is."""
    order = ["genetic_score", "linear_predictor", "probability", "prediction"] if purpose == "genetic" else ["probability", "prediction", "linear_predictor", "genetic_score"]
    found = next((c for c in order if c in columns), None)
    if found is None:
        raise ValueError(f"no score column among {columns}")
    return found


def fingerprint(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def save_artifact(path: str, coefficients: DataFrame, config: dict) -> None:
    """Coefficients as Parquet, then the manifest, which marks the artifact complete."""
    coefficients.write.mode("overwrite").parquet(f"{path}/coefficients")
    manifest = coefficients.sparkSession.createDataFrame([(fingerprint(config), json.dumps(config, sort_keys=True, default=str))], "fingerprint string, config string")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def load_artifact(spark: SparkSession, path: str, config: dict | None = None) -> DataFrame | None:
    """Coefficients; None if ``config`` is given and has another fingerprint."""
    found = spark.read.json(f"{path}/manifest").select("fingerprint").first()["fingerprint"]
    return None if config is not None and found != fingerprint(config) else spark.read.parquet(f"{path}/coefficients")


def write_table(df: DataFrame, path: str) -> None:
    """Tab-separated and gzipped, with a header, numbers to eight significant digits; the _SUCCESS file marks it complete."""
    short = {c: F.when(F.abs(c) < float("inf"), F.format_string("%.7e", F.col(c)).try_cast("double")).otherwise(F.col(c)) for c, kind in df.dtypes if kind == "double"}
    (df.withColumns(short) if short else df).write.mode("overwrite").option("compression", "gzip").csv(path, sep="\t", header=True, nullValue="")


def identifier(name: str) -> str:
    """A schema's name, quoted part by part; what could be anything but a name raises."""
    parts = name.split(".")
    if not 1 <= len(parts) <= 2 or not all(re.fullmatch(r"[A-Za-z_][A-Za-z0-9_-]*", x) for x in parts):
        raise ValueError(f"no name of a schema: {name!r}")
    return ".".join(f"`{x}`" for x in parts)


def resolve_alias(asked: str, names: dict[str, list[str]]) -> str:
    key = asked.strip().lower().replace(" ", "_").replace("-", "_")
    for name, aliases in names.items():
        if key in {x.lower().replace(" ", "_") for x in (name, *aliases)}:
            return name
    raise ValueError(f"unknown phenotype: {asked}; there are {', '.join(sorted(names))}")


#: Phenotype, SNOMED CT root code and aliases.
PHENOTYPES = {
    "hypertension": ("59621000", ["htn", "high_blood_pressure", "essential_hypertension"]),
    "type2_diabetes": ("44054006", ["t2d", "type_2_diabetes", "diabetes_type_2", "t2dm"]),
    "hyperlipidemia": ("55822004", ["dyslipidemia", "high_cholesterol", "hypercholesterolemia"]),
    "obesity": ("414916001", ["obese", "morbid_obesity"]),
    "asthma": ("195967001", ["asthma_chronic"]),
    "depression": ("370143000", ["major_depression", "major_depressive_disorder", "mdd"]),
    "anxiety": ("48694002", ["anxiety_disorder", "generalized_anxiety"]),
    "gerd": ("235595009", ["reflux", "gastroesophageal_reflux", "gastroesophageal_reflux_disease"]),
    "chronic_kidney_disease": ("709044004", ["ckd"]),
    "coronary_artery_disease": ("53741008", ["cad", "ischemic_heart_disease", "coronary_arteriosclerosis"]),
    "heart_failure": ("84114007", ["hf", "congestive_heart_failure", "chf"]),
    "atrial_fibrillation": ("49436004", ["af", "afib", "a_fib"]),
    "osteoarthritis": ("396275006", ["oa", "degenerative_joint_disease"]),
    "copd": ("13645005", ["chronic_obstructive_pulmonary_disease", "chronic_obstructive_lung_disease"]),
    "stroke": ("230690007", ["cerebrovascular_accident", "cva", "cerebrovascular_disease"]),
    "hypothyroidism": ("40930008", ["underactive_thyroid", "low_thyroid"]),
    "migraine": ("37796009", ["migraine_headache", "migraines"]),
    "rheumatoid_arthritis": ("69896004", ["ra"]),
    "atherosclerosis": ("38716007", ["ascvd", "atherosclerotic_disease"]),
    "sleep_apnea": ("73430006", ["osa", "obstructive_sleep_apnea"]),
}


def validate_blocks(blocks: DataFrame) -> None:
    """Raise on a chromosome out of 1..22, an empty block or an overlap."""
    from pyspark.sql import Window

    before = F.lag("end").over(Window.partitionBy("chrom").orderBy("start"))
    bad = blocks.withColumn("before", before).where(~F.col("chrom").between(1, 22) | (F.col("end") <= F.col("start")) | (F.col("start") < F.col("before")))
    if row := bad.first():
        raise ValueError(f"bad block: {row.asDict()}")
