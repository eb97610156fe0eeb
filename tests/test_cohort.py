"""Cohorts from record tables, their manifests, and runs from records to scores."""

import datetime
import json

import numpy as np
import pytest

from cohortscore import cli
from cohortscore.plans import cohort

DAY = datetime.date(2020, 1, 1)


def _records(spark, n=160, shift=0):
    """People 0..n-1: two or more conditions in every third, one in every seventh other; three genders."""
    conditions = [(i, DAY + datetime.timedelta(days=k), 11 if k else 12) for i in range(n) for k in range(2 + i % 2 if i % 3 == shift else 1 if i % 7 == 0 else 0)]
    conditions += [(i, DAY, 99) for i in range(n)]  # another concept
    table = lambda rows, kind: spark.createDataFrame(rows, kind)
    return {
        "conditions": table(conditions, "person_id long, condition_date date, concept_id int"),
        "visits": table([(i, DAY) for i in range(n) for _ in range(i % 5)], "person_id long, visit_date date"),
        "periods": table([(i, DAY, DAY + datetime.timedelta(days=100 + i)) for i in range(n)], "person_id long, start_date date, end_date date"),
        "persons": table([(i, 1950 + i % 40, [8507, 8532, 8532, 0][i % 4]) for i in range(n)], "person_id long, year_of_birth int, gender_concept_id long"),
        "consents": table([(i, DAY) for i in range(0, n, 2)], "person_id long, observation_date date"),
        "ancestors": table([(59621000, 11, "a"), (59621000, 12, "b"), (5, 99, "c")], "ancestor_id int, descendant_id int, concept_name string"),
    }


def test_a_cohort_by_hand(spark, tmp_path):
    told = cohort.prepare(spark, _records(spark), 59621000, str(tmp_path / "c"))
    cases, one = [i for i in range(160) if i % 3 == 0], [i for i in range(160) if i % 3 and i % 7 == 0]
    assert (told["n_cases"], told["n_controls"], told["n_excluded_ambiguous"], told["n_rows"]) == (len(cases), 160 - len(cases) - len(one), len(one), 160 - len(one))
    rows = {int(r["sample_id"]): r for r in spark.read.csv(str(tmp_path / "c" / "table"), sep="\t", header=True).collect()}
    assert set(rows) == set(range(160)) - set(one)
    r = rows[9]
    assert (r["target"], r["phenotype_occurrence_count"], r["age"], r["age_squared"], r["observation_days"], r["first_condition_date"]) == ("1", "3", "61", "3721", "109", "2020-01-01")
    assert float(r["log1p_n_visits"]) == pytest.approx(np.log(5)) and rows[1]["primary_consent_date"] is None
    # The most frequent level has no column.
    assert told["covariates"][4:] == ["gender_concept_id_0", "gender_concept_id_8507"] and (rows[3]["gender_concept_id_0"], rows[4]["gender_concept_id_8507"]) == ("1", "1")
    text = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "c" / "query")).collect())
    assert "59621000" in text and "phenotype_occurrence_count" in text


def test_manifests_tell_what_a_stage_is_made_of(spark, tmp_path, monkeypatch):
    path, records = str(tmp_path / "c"), _records(spark, 40)
    first = cohort.prepare(spark, records, 59621000, path)
    monkeypatch.setattr(cohort.tables, "write_table", lambda *a: pytest.fail("written again"))
    assert cohort.prepare(spark, records, 59621000, path) == first
    monkeypatch.undo()
    assert cohort.prepare(spark, _records(spark, 40, shift=1), 59621000, path)["n_cases"] != first["n_cases"]
    # Broken off after the table: no manifest stands by it.
    monkeypatch.setattr(cohort, "write_manifest", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        cohort.prepare(spark, records, 59621000, path)
    monkeypatch.undo()
    assert cohort.manifest(spark, path) is None and cohort.prepare(spark, records, 59621000, path) == first
    with pytest.raises(ValueError, match="no table of visits"):
        cohort.prepare(spark, {k: v for k, v in records.items() if k != "visits"}, 1, path)


def test_from_records_to_scores(spark, tmp_path, capsys):
    n, records = 160, _records(spark)
    for name, df in records.items():
        df.write.parquet(str(tmp_path / "records" / f"{name}.parquet"))
    rng = np.random.default_rng(0)
    case = np.arange(n) % 3 == 0
    d = rng.binomial(2, np.where(case[:, None], 0.6, 0.2), (n, 6))
    token = np.array(["0/0", "0/1", "1/1"])
    lines = ["\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *map(str, range(n))])]
    lines += ["\t".join(["1", str(j + 1), f"v{j}", "A", "G", ".", ".", ".", "GT", *token[d[:, j]]]) for j in range(6)]
    (tmp_path / "x.vcf").write_text("\n".join(lines) + "\n")
    (tmp_path / "pcs.tsv").write_text("sample_id\tpc1\n" + "".join(f"{i}\t{x:.4f}\n" for i, x in enumerate(rng.standard_normal(n))))
    args = ["run-cohort", str(tmp_path / "records"), str(tmp_path / "out"), "--phenotype", "HTN", "--genotypes", str(tmp_path / "x.vcf"), "--pcs", str(tmp_path / "pcs.tsv")]
    assert cli.main(args) == 0
    summary = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert summary["binary"] and summary["test"]["auc"] > 0.8 and summary["n_variants"] == 6
    assert "pc1" in cohort.manifest(spark, str(tmp_path / "out" / "cohort"))["covariates"]
    sweep = ["sweep-cohorts", str(tmp_path / "records"), str(tmp_path / "many"), "--phenotypes", "asthma,htn", "--genotypes", str(tmp_path / "x.vcf")]
    assert cli.main(sweep) == 1
    said = capsys.readouterr().out
    assert "asthma: FAILED ValueError: 0 cases" in said and "htn: COMPLETE" in said


def test_components_of_any_table(spark):
    samples = spark.createDataFrame([("1",), ("2",), ("3",)], "sample_id string")
    by_list = spark.createDataFrame([("x1", 1, "[0.5,-1,2]"), ("x2", 2, "[1,2,3]"), ("x9", 9, "[7,8,9]")], "research_id string, person_id long, pca_features string")
    got = cohort.components(by_list, samples, 2)
    assert got.columns == ["sample_id", "pc1", "pc2"] and sorted(map(tuple, got.collect())) == [("1", 0.5, -1.0), ("2", 1.0, 2.0)]
    by_name = spark.createDataFrame([("3", "0.25", "9", "1")], "sample_id string, PC2 string, PC10 string, PC1 string")
    got = cohort.components(by_name, samples, 2)
    assert [tuple(r) for r in got.collect()] == [("3", 1.0, 0.25)]
    for table, why in ((by_list.where("person_id = 9"), "matches"), (by_list.select("person_id"), "neither"), (by_name.select("sample_id", samples.sparkSession.createDataFrame([("x",)], "PC1 string").schema["PC1"].name).replace("1", "x", "PC1"), "no number")):
        with pytest.raises(ValueError, match=why):
            cohort.components(table, samples, 2)


def test_names_of_schemas(spark):
    assert cohort.tables.identifier("a_b.c-d") == "`a_b`.`c-d`"
    for bad in ("", "a;b", "a.b.c", "a b", "a`b", "1a"):
        with pytest.raises(ValueError, match="no name"):
            cohort.tables.identifier(bad)


def test_numbers_at_the_sink(spark, tmp_path):
    values = [1 / 3, -123456789.123, 1e-12 / 7, 0.5, 0.0, None, float("nan")]
    cohort.tables.write_table(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double"), str(tmp_path / "t"))
    got = {int(r["i"]): r["v"] for r in spark.read.csv(str(tmp_path / "t"), sep="\t", header=True).collect()}
    assert got[5] is None and got[6] == "NaN"
    assert [float(got[i]) for i in range(5)] == [float(f"{v:.8g}") for v in values[:5]]


def test_runs_refuse_what_no_fit_can_use(spark):
    from cohortscore.plans import run
    from cohortscore.sources.dataset import Dataset

    calls = spark.createDataFrame([("a", "v", 1)], "sample_id string, variant_id string, dosage int")
    samples = spark.createDataFrame([("a", 1.0, 2.0)], "sample_id string, target double, cov double")
    run.validate(Dataset(calls, samples, calls), ["cov"])
    for data, why in (
        (Dataset(calls, samples.where("false"), calls), "no samples"), (Dataset(calls, samples.selectExpr("sample_id", "target", "double('nan') AS cov"), calls), "not finite: cov"),
        (Dataset(calls.selectExpr("sample_id", "variant_id", "3 AS dosage"), samples, calls), "1 calls are beyond"), (Dataset(calls.selectExpr("sample_id", "CAST(NULL AS STRING) AS variant_id", "dosage"), samples, calls), "1 have no sample"),
    ):
        with pytest.raises(ValueError, match=why):
            run.validate(data, ["cov"])
