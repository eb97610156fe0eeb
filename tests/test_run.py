"""Many covariates, loading of call files, trios, and a full run from files to scores."""

import json

import numpy as np
import pytest

from cohortscore import cli
from cohortscore.operators import regression
from cohortscore.plans import run, special
from cohortscore.plans.relation import build
from cohortscore.sources import dataset, vcf

from .conftest import SF


def test_residuals_of_collinear_covariates(spark):
    got = {r["sample_id"]: r["r"] for r in special._four(build(spark, SF, "samples")).frame.collect()}
    s = build(spark, SF, "samples").toPandas()
    x = np.column_stack([np.ones(len(s)), s["cov"], s["cov"] ** 2, s["target"], 2 * s["cov"] + 1])
    b = np.linalg.lstsq(x, s["y"], rcond=None)[0]
    assert np.allclose([got[i] for i in s["sample_id"]], s["y"] - x @ b, atol=1e-6)
    alone = regression.residualize(build(spark, SF, "samples"), "y", [])
    assert alone.coefficients[0] == pytest.approx(s["y"].mean()) and alone.sigma2 == pytest.approx(s["y"].var(ddof=0))


def _files(tmp_path, n=160, p=12, seed=3):
    rng = np.random.default_rng(seed)
    d = rng.binomial(2, 0.3, (n, p))
    beta = np.zeros(p)
    beta[[1, 7]] = (0.9, -0.8)
    cov = rng.standard_normal(n)
    y = ((d - d.mean(0)) / d.std(0)) @ beta + 0.5 * cov + 0.5 * rng.standard_normal(n)
    token = np.array(["0/0", "0/1", "1/1"])
    names = [f"S{i}" for i in range(n)]
    for part, at in (("a", range(0, 7)), ("b", range(5, p))):  # variants 5 and 6 are in both
        lines = ["##fileformat=VCFv4.2", "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *names])]
        lines += ["\t".join(["1", str(100 + j), f"v{j}", "A", "G", ".", "PASS", ".", "GT", *token[d[:, j]]]) for j in at]
        (tmp_path / f"{part}.vcf").write_text("\n".join(lines) + "\n")
    rows = [f"{names[i]}\tR{i}\t{y[i]}\t{cov[i]}" for i in range(n)] + ["S999\tR999\t1\t1", "S998\tR998\tNaN\t1"]
    (tmp_path / "samples.tsv").write_text("sample_id\tresearch_id\ty\tcov\n" + "\n".join(rows) + "\n")
    return d, beta


def test_full_run(spark, tmp_path, capsys):
    d, beta = _files(tmp_path)
    args = ["fit", str(tmp_path / "samples.tsv"), "y", str(tmp_path / "out"), str(tmp_path / "a.vcf"), str(tmp_path / "b.vcf"), "--covariates", "cov"]
    assert cli.main(args) == 0
    summary = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert summary["n_train"] + summary["n_test"] == len(d) and summary["n_variants"] == 12 and not summary["binary"]
    assert summary["test"]["r2"] > 0.5 and summary["alpha"][1] == pytest.approx(0.5, abs=0.2)
    found = {r["variant_id"]: r["beta"] for r in spark.read.parquet(str(tmp_path / "out" / "artifact" / "coefficients")).collect()}
    assert np.corrcoef([found[f"v{j}"] for j in range(12)], beta)[0, 1] > 0.95
    assert spark.read.csv(str(tmp_path / "out" / "predictions"), sep="\t", header=True).count() == len(d)
    assert cli.main(args) == 0 and json.loads(capsys.readouterr().out.splitlines()[-1]) == summary  # complete: not run again


def test_trios_round_trip(spark, tmp_path):
    d, _ = _files(tmp_path)
    data = dataset.load_dataset(spark, [str(tmp_path / "a.vcf"), str(tmp_path / "b.vcf")], str(tmp_path / "samples.tsv"), "y", ["cov"])
    assert data.variants.count() == 12 and data.samples.count() == len(d)
    order = spark.createDataFrame([(f"S{i}", i) for i in range(len(d))], "sample_id string, ordinal long")
    told = dataset.write_trios(data.calls, data.variants, order, str(tmp_path / "trios"), parts=2).collect()
    assert sum(r["n_variants"] for r in told) == 12
    back = np.zeros_like(d)
    for r in told:
        calls, variants, names = dataset.load_calls(spark, str(tmp_path / "trios" / f"part-{r['part']}.bed"))
        assert names == [f"S{i}" for i in range(len(d))] and variants.count() == r["n_variants"]
        for c in calls.collect():
            back[int(c["sample_id"][1:]), int(c["variant_id"][1:])] = c["dosage"]
    assert (back == d).all()


def test_loading_refuses_what_does_not_fit(spark, tmp_path):
    _files(tmp_path)
    with pytest.raises(ValueError, match="unknown genotype format"):
        vcf.genotype_format("x.pgen")
    variants = spark.createDataFrame([("v1", "snv", 1.0)], "variant_id string, variant_class string, length double")
    m = spark.createDataFrame([("v1", "9")], "variant_id string, length string")
    assert dataset.described(variants, m).first()["length"] == 9.0
    with pytest.raises(ValueError, match="unknown variant"):
        dataset.described(variants, spark.createDataFrame([("v2", "9")], "variant_id string, length string"))
    with pytest.raises(ValueError, match="comes twice"):
        dataset.described(variants, m.unionByName(m))


def test_run_with_validation_and_learned_priors(spark, tmp_path, capsys):
    d, beta = _files(tmp_path)
    out = str(tmp_path / "learned")
    args = ["fit", str(tmp_path / "samples.tsv"), "y", out, str(tmp_path / "a.vcf"), str(tmp_path / "b.vcf"), "--covariates", "cov", "--validation-share", "0.2", "--learn-priors"]
    assert cli.main(args) == 0
    summary = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert summary["n_train"] + summary["n_test"] < len(d) and summary["test"]["r2"] > 0.5
    history = spark.read.csv(f"{out}/history", sep="\t", header=True)
    assert history.count() == summary["iterations"] and history.where("validation_loss IS NOT NULL").count() > 0
    assert cli.main(["evaluate", out]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == pytest.approx(summary["test"])
    assert cli.main(["evaluate", out, "--samples", "all"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["n"] == len(d)


def test_kept_states_alternate(spark, tmp_path):
    where, settings = str(tmp_path / "state"), {"seed": 1}
    assert run.kept_state(spark, where, settings) is None
    for i in (1, 2, 3):
        run.keep_state(spark, where, settings, {"iteration": i * run.KEEP_EVERY, "x": [0.5 * i]})
    assert run.kept_state(spark, where, settings) == {"iteration": 3 * run.KEEP_EVERY, "x": [1.5]}
    assert run.kept_state(spark, where, {"seed": 2}) is None


def test_scale_design_has_no_intercept():
    got = run.scale_design(["snv", "snv", "deletion_short"], [1.0, 1.0, 100.0])
    assert got.shape == (3, 2) and got[:, 0].tolist() == [0, 0, 1] and got[:, 1].mean() == pytest.approx(0)
    assert run.scale_design(["snv", "snv"], [1.0, 1.0]).tolist() == [[0.0], [0.0]]


def test_another_target_is_another_run(spark, tmp_path, capsys):
    """Settings alone do not make a run complete: target, call files, sample table and metadata count."""
    _files(tmp_path)
    table = tmp_path / "samples.tsv"
    rows = [line.split("\t") for line in table.read_text().splitlines()]
    table.write_text("\n".join("\t".join([*r, "y2" if i == 0 else str(-2 * float(r[2]) if r[2] != "NaN" else 1)]) for i, r in enumerate(rows)) + "\n")
    out, calls = str(tmp_path / "out"), [str(tmp_path / "a.vcf"), str(tmp_path / "b.vcf")]

    def fit(target, *more):
        assert cli.main(["fit", str(table), target, out, *calls, "--covariates", "cov", *more]) == 0
        return json.loads(capsys.readouterr().out.splitlines()[-1])

    first, second = fit("y"), fit("y2")
    assert second["alpha"][1] == pytest.approx(-2 * first["alpha"][1], rel=0.2) and fit("y2") == second
    kept = table.read_text()
    table.write_text(kept.replace("S5\t", "S5x\t"))  # another sample table
    assert fit("y2")["n_train"] + fit("y2")["n_test"] == second["n_train"] + second["n_test"] - 1
    (tmp_path / "b.vcf").write_text((tmp_path / "b.vcf").read_text().replace("\tv11\t", "\tv12\t"))  # another call file
    assert fit("y2") != second
    found = {r["variant_id"] for r in spark.read.parquet(f"{out}/artifact/coefficients").collect()}
    assert "v12" in found and "v11" not in found


def test_run_by_products(spark, tmp_path, capsys):
    _files(tmp_path)
    args = ["fit", str(tmp_path / "samples.tsv"), "y", "", str(tmp_path / "a.vcf"), str(tmp_path / "b.vcf"), "--covariates", "cov", "--solver", ""]
    got = {}
    for solver in ("dense", "products"):
        args[3], args[-1] = str(tmp_path / solver), solver
        assert cli.main(args) == 0
        got[solver] = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert got["products"]["solver"] == "products" and got["products"]["alpha"] == pytest.approx(got["dense"]["alpha"], abs=1e-3)
    assert got["products"]["elbo"]["bound"] == pytest.approx(got["dense"]["elbo"]["bound"], rel=1e-3)


def test_people_without_a_score_have_no_rank(spark):
    people = [(i, i % 2, float(i), None if i % 10 == 0 else float("nan") if i % 10 == 1 else float(i // 2)) for i in range(100)]
    made = {"predictions_in": spark.createDataFrame(people, "sample_id long, target int, y double, score double")}
    ranks = {r["sample_id"]: r["avg_rank"] for r in build(spark, "", "avg_rank", dict(made)).collect()}
    scored = sorted((s, i) for i, _, _, s in people if i % 10 > 1)
    assert len(ranks) == 100 and all(ranks[i] is None for i, _, _, _ in people if i % 10 < 2)
    for s, i in scored:
        at = [k for k, (v, _) in enumerate(scored, 1) if v == s]
        assert ranks[i] == sum(at) / len(at)
    tail = build(spark, "", "top_tail", dict(made)).first()
    assert tail["n_top"] == 8
    auc = build(spark, "", "auc", dict(made)).first()[0]
    pos, neg = [s for s, i in scored if i % 2], [s for s, i in scored if not i % 2]
    assert auc == pytest.approx(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)), abs=1e-6)


def test_transcoded_files_keep_alleles_and_classes(spark, tmp_path):
    lines = ["##fileformat=VCFv4.2", "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", "A", "B", "C"])]
    lines += ["1\t5\ts\tC\tT\t.\t.\t.\tGT\t0/0\t0/1\t1/1", "1\t9\ti\tC\tCTT\t.\t.\t.\tGT\t0/1\t./.\t1/1", "2\t3\td\tN\t<DEL>\t.\t.\tSVLEN=-50\tGT\t1/1\t0/1\t0/0"]
    (tmp_path / "x.vcf").write_text("\n".join(lines) + "\n")
    calls, variants, names = dataset.load_calls(spark, str(tmp_path / "x.vcf"))
    order = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "sample_id string, ordinal long")
    dataset.write_trios(calls, variants, order, str(tmp_path / "t")).collect()
    again = dataset.load_calls(spark, str(tmp_path / "t" / "part-0.bed"))
    cols = ["variant_id", "chrom", "pos", "variant_class", "ref", "alt"]
    assert sorted(map(tuple, again[1].select(cols).collect())) == sorted(map(tuple, variants.select(cols).collect()))
    assert sorted(map(tuple, again[0].collect()), key=str) == sorted(map(tuple, calls.collect()), key=str)


def test_names_of_samples_stay_out_of_the_plan(spark, tmp_path):
    """Ids are joined, not spelled out in a plan that the driver holds; header lines of one source must agree."""
    names = [f"a-long-name-of-sample-{i}" for i in range(500)]
    head = "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT"])
    body = "1\t5\tv1\tA\tG\t.\t.\t.\tGT\t" + "\t".join("0/1" if i % 3 else "0/0" for i in range(500))
    (tmp_path / "a.vcf").write_text("\t".join([head, *names]) + "\n" + body + "\n")
    (tmp_path / "samples.tsv").write_text("sample_id\ty\n" + "".join(f"{x}\t{i if i % 2 else 'NaN'}\n" for i, x in enumerate(names)))
    data = dataset.load_dataset(spark, [str(tmp_path / "a.vcf")], str(tmp_path / "samples.tsv"), "y", [])
    assert sorted(r["sample_id"] for r in data.calls.collect()) == sorted(names[i] for i in range(500) if i % 3 and i % 2)
    assert names[7] not in data.calls._jdf.queryExecution().logical().toString() and names[7] not in data.calls._jdf.queryExecution().optimizedPlan().toString()
    (tmp_path / "b.vcf").write_text("\t".join([head, *names]) + "\n" + "\t".join([head, *names[:3]]) + "\n" + body + "\n")
    with pytest.raises(ValueError, match="header lines differ"):
        dataset.load_calls(spark, str(tmp_path / "b.vcf"))


def test_transcoding_collects_no_names(spark, monkeypatch):
    """The driver gets a row a trio and a row a range of names, not a row a sample."""
    from pyspark.sql.classic.dataframe import DataFrame as Frame

    from cohortscore.plans import files

    collected, collect = [], Frame.collect
    monkeypatch.setattr(Frame, "collect", lambda self: (collected.append(collect(self)), collected[-1])[1])
    got = {tuple(r) for r in collect(files.transcode(spark, SF))}
    assert collected and max(len(x) for x in collected) <= 8 < spark.read.parquet(f"{SF}/customer.parquet").count()
    collected.clear()
    files.scan_bed(spark, SF)
    assert collected and max(len(x) for x in collected) <= 8
    assert got
