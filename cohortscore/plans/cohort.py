"""A cohort from record tables to a sample table, and on to a fit: each stage leaves a manifest, written last, that says what it was made of."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortscore.operators import joins  # noqa: F401
from cohortscore.sources import tables
from cohortscore.sources.dataset import contents, load_dataset

from . import run
from .relation import RELATIONS, relation

#: Record tables of a cohort; levels of a categorical column at most (each becomes a column).
RECORDS = ("conditions", "visits", "periods", "persons", "consents", "ancestors")
MOST_LEVELS = 200

relation("closure_of_code", "SELECT DISTINCT descendant_id FROM {ancestors} WHERE ancestor_id = :code", code=0)


def manifest(spark: SparkSession, path: str) -> dict | None:
    """What a complete stage says of itself; None where there is none, or the stage was broken off."""
    try:
        found = spark.read.text(f"{path}/manifest").first()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return json.loads(found["value"]) if found else None


def write_manifest(spark: SparkSession, path: str, told: dict) -> None:
    spark.createDataFrame([(json.dumps(told, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def withdraw(spark: SparkSession, path: str) -> None:
    """Remove a stage's manifest before its data are written again, so that old words never stand by new data."""
    if manifest(spark, path) is not None:
        spark.createDataFrame([], "value string").write.mode("overwrite").text(f"{path}/manifest")


def indicators(people: DataFrame, column: str) -> tuple[DataFrame, list[str]]:
    """0/1 columns for the levels of ``column`` as the data have them, without the most frequent one (of equals, the last); null is no level."""
    counts = people.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("level")).count()
    levels = counts.orderBy(F.desc("count"), F.desc("level")).limit(MOST_LEVELS + 1).collect()
    if len(levels) > MOST_LEVELS:
        raise ValueError(f"{column} has more than {MOST_LEVELS} levels")
    names = sorted(r["level"] for r in levels[1:])
    own = {f"{column}_{x}": (F.coalesce(F.col(column).cast("string") == x, F.lit(False))).cast("int") for x in names}
    return people.withColumns(own) if own else people, list(own)


def records_of(spark: SparkSession, where: str) -> dict[str, DataFrame]:
    """The record tables of a folder (``<name>.parquet``) or, as ``catalog:<schema>``, of a schema of the session's catalog."""
    if where.startswith("catalog:"):
        schema = tables.identifier(where.removeprefix("catalog:"))
        return {t: spark.table(f"{schema}.{t}") for t in RECORDS}
    return {t: spark.read.parquet(f"{where}/{t}.parquet") for t in RECORDS}


def components(table: DataFrame, samples: DataFrame, n: int = 10) -> DataFrame:
    """``sample_id, pc1, pc2, ...``: up to n principal components of ``samples`` (sample_id) that the table has.

    The id column is that of ``sample_id, research_id, person_id`` which matches most samples; none that matches is an
    error.  Components are a list in ``pca_features``, or columns named PC and a number; rows of too few numbers raise.
    """
    ids = samples.select(F.col("sample_id").cast("string").alias("id")).distinct()
    there = [c for c in ("sample_id", "research_id", "person_id") if c in table.columns]
    found = {c: table.join(ids, F.col(c).cast("string") == F.col("id"), "left_semi").count() for c in there}
    key = max(there, key=lambda c: found[c], default=None)
    if key is None or not found[key]:
        raise ValueError(f"no sample has components: none of {there or table.columns} matches")
    named = sorted((c for c in table.columns if re.fullmatch(r"(?i)pc_?[0-9]+", c)), key=lambda c: int(re.sub(r"\D", "", c)))[:n]
    own = table.select(F.col(key).cast("string").alias("sample_id"), *([F.col("pca_features").cast("string")] if "pca_features" in table.columns else named))
    if "pca_features" in table.columns:
        values = F.from_json("pca_features", "array<double>")
        size = own.agg(F.min(F.coalesce(F.size(values), F.lit(0)))).first()[0]
        n = min(n, max(size, 0))
        parts = [F.get(values, i) for i in range(n)]
    else:
        parts = [F.col(c).try_cast("double") for c in named]
    if not parts:
        raise ValueError("no components: neither a list pca_features nor columns PC1, PC2, ...")
    rows = own.select("sample_id", *[x.alias(f"pc{i + 1}") for i, x in enumerate(parts)]).join(ids, F.col("sample_id") == F.col("id"), "left_semi")
    if bad := rows.where(" OR ".join(f"pc{i + 1} IS NULL OR isnan(pc{i + 1})" for i in range(len(parts)))).first():
        raise ValueError(f"a component of sample {bad['sample_id']} is no number")
    return rows


def prepare(spark: SparkSession, records: dict[str, DataFrame], code: int, path: str, least_conditions: int = 2, categories: tuple[str, ...] = ("gender_concept_id",), pcs: DataFrame | None = None, n_pcs: int = 10) -> dict:
    """Sample table, query text and manifest of a phenotype below ``path``; nothing is done again for equal settings and records.

    Cases have ``least_conditions`` conditions among the descendants of ``code`` or more, controls none; people between
    are counted and left out.  ``pcs`` is a table of principal components, see ``components``.
    """
    if lost := [t for t in RECORDS if t not in records]:
        raise ValueError(f"no table of {', '.join(lost)}")
    settings = {"code": code, "least_conditions": least_conditions, "categories": list(categories), "n_pcs": n_pcs}
    made_of = {t: contents(records[t]) for t in RECORDS} | {"pcs": contents(pcs) if pcs is not None else None}
    known = manifest(spark, path)
    if known and (known["settings"], known["made_of"]) == (settings, json.loads(json.dumps(made_of))):
        return known
    withdraw(spark, path)
    closure = RELATIONS["closure_of_code"](spark, {"code": code}, ancestors=records["ancestors"])
    inputs = {t: records[t] for t in RECORDS if t != "ancestors"} | {"concept_closure": closure}
    people = RELATIONS["cohort"](spark, {"least_conditions": least_conditions}, **inputs).persist()
    counts = RELATIONS["cohort_counts"](spark, cohort=people).first().asDict()
    used = people.where("target IS NOT NULL")
    for column in categories:
        used, _ = indicators(used, column)
    own = [c for c in used.columns if any(c.startswith(f"{x}_") for x in categories)]
    sample = used.select(
        F.col("person_id").cast("string").alias("sample_id"), F.col("person_id").cast("string").alias("person_id"), "target", "phenotype_occurrence_count",
        *[F.col(a).cast("string").alias(b) for a, b in (("first_condition_date", "first_condition_date"), ("start_date", "observation_start_date"), ("end_date", "observation_end_date"), ("primary_consent_date", "primary_consent_date"))],
        F.col("age").cast("long").alias("age"), (F.col("age") * F.col("age")).cast("long").alias("age_squared"), F.col("observation_days").cast("long").alias("observation_days"), F.log1p("n_visits").alias("log1p_n_visits"), *own,
    )
    covariates = ["age", "age_squared", "observation_days", "log1p_n_visits", *own]
    if pcs is not None:
        known_pcs = components(pcs, sample, n_pcs)
        sample = sample.join(known_pcs, "sample_id")
        covariates += known_pcs.columns[1:]
    tables.write_table(sample, f"{path}/table")
    texts = [f"-- {name} {json.dumps(RELATIONS[name].params | more)}\n{RELATIONS[name].text.strip()}" for name, more in (("closure_of_code", {"code": code}), ("cohort", {"least_conditions": least_conditions}))]
    spark.createDataFrame([("\n\n".join(texts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/query")
    people.unpersist()
    told = {"settings": settings, "made_of": made_of, "covariates": covariates, "n_rows": spark.read.csv(f"{path}/table", sep="\t", header=True).count(), **counts}
    write_manifest(spark, path, told)
    return json.loads(json.dumps(told))


def run_cohort(spark: SparkSession, records: dict[str, DataFrame], code: int, genotypes: list[str], output: str, pcs: DataFrame | None = None, **more) -> dict:
    """From records to scores: the sample table below ``output/cohort``, the fit below ``output/fit``, each done once for what it is made of."""
    told = prepare(spark, records, code, f"{output}/cohort", pcs=pcs)
    if not told["n_cases"] or not told["n_controls"]:
        raise ValueError(f"{told['n_cases']} cases and {told['n_controls']} controls: nothing to fit")
    data = load_dataset(spark, genotypes, f"{output}/cohort/table", "target", told["covariates"])
    # Covariates of one value among those that were genotyped say nothing.
    spread = data.samples.agg(*[F.count_distinct(c).alias(c) for c in told["covariates"]]).first()
    return run.run(spark, data, [c for c in told["covariates"] if spread[c] > 1], f"{output}/fit", trait="binary", **more)
