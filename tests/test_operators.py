"""Operators on fixtures with known results."""

import numpy as np
import pytest

from cohortscore.model import em, special
from cohortscore.model.moments import design
from cohortscore.operators import components
from cohortscore.plans.relation import RELATIONS, build
from cohortscore.plans import registry  # noqa: F401
from cohortscore.sources import bed, tables, vcf
from cohortscore.streaming import incremental


def test_missing_aware_statistics(spark):
    calls = spark.createDataFrame([(1, 7, 2), (2, 7, 1), (3, 7, None), (1, 8, None), (2, 8, None), (3, 8, None), (4, 8, None)], "sample_id long, variant_id long, dosage int")
    samples = spark.createDataFrame([(i,) for i in range(1, 5)], "sample_id long")
    stats = RELATIONS["variant_stats"](spark, calls=calls, samples=samples)
    got = {r["variant_id"]: r for r in RELATIONS["standardization"](spark, variant_stats=stats).collect()}
    assert got[7]["mean"] == 1.0 and got[7]["n_observed"] == 3
    assert got[7]["scale"] == pytest.approx(np.sqrt(2 / 4))  # squares over all samples, mean over observed
    assert (got[8]["mean"], got[8]["scale"]) == (0.0, 1.0)


def test_components_of_a_long_chain(spark):
    nodes = spark.range(200).withColumnRenamed("id", "node")
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 150)] + [(160, 170)], "a long, b long")
    got = dict(components.min_label(nodes, edges).collect())
    assert all(got[i] == 0 for i in range(151)) and got[170] == 160 and got[199] == 199


def test_event_clusters(spark):
    rows = [(0, 1, 1_000_000, 1000.0, 80), (1, 1, 1_000_020, 990.0, 100), (2, 1, 1_000_010, 1005.0, 95), (3, 2, 1_000_000, 1000.0, 80), (4, 1, 5_000_000, 1000.0, 10), (5, 1, 5_000_000, 1000.0, 500)]
    v = spark.createDataFrame([(*r, "deletion_long") for r in rows], "variant_id long, chrom int, pos long, length double, support long, variant_class string")
    events = RELATIONS["events_sv"](spark, variants=v)
    edges = RELATIONS["sv_event_edges"](spark, events_sv=events)
    got = {r["variant_id"]: r["representative"] for r in components.clusters(events, edges).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_average_precision_and_auc(spark):
    p = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)] * 6)], "sample_id long, score double, target int")
    made = {"predictions_in": p}
    assert build(spark, "", "auc", made).first()["auc"] == 0.75
    assert build(spark, "", "average_precision", made).first()["average_precision"] == pytest.approx(0.833333)


VCF = "##contig=<ID=1,length=249>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\ts3\n1\t5\t.\tA\tG\t9\t.\tAF=0.1\tDP:GT\t1:0/1\t2:./.\t3:1|1\n1\t9\trs\tA\tT\t.\t.\t.\tGT\t0/0\t1\t.|0\n"


def test_vcf_scan(spark, tmp_path):
    import gzip

    path = str(tmp_path / "x.vcf.gz")
    with gzip.open(path, "wt") as f:
        f.write(VCF)
    text = vcf.lines(spark, path)
    assert vcf.header(text) == (["s1", "s2", "s3"], [("1", 249)])
    got = sorted((r["variant_id"], r["sample_index"], r["dosage"]) for r in vcf.calls(text).collect() if r["dosage"] is not None)
    assert got == [("1:5:A:G", 0, 1), ("1:5:A:G", 2, 2), ("rs", 1, 2)]
    assert vcf.calls(text).where("dosage IS NULL").count() == 2
    assert vcf.records(text, ("1", 6, 9)).count() == 1
    with pytest.raises(Exception, match="several alternative"):
        vcf.records(spark.createDataFrame([("1\t5\t.\tA\tG,T\t9\t.\t.",)], "value string")).collect()


def test_bed_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    d = rng.integers(-1, 3, (10, 7))
    path = str(tmp_path / "x.bed")
    with open(path, "wb") as f:
        f.write(bed.MAGIC + b"".join(bed.pack(v) for v in d))
    assert all((bed.unpack(bed.pack(v), 7) == v).all() for v in d)
    spark.dataSource.register(bed.BedSource)
    rows = spark.read.format("bed2bit").option("samples", 7).option("variantsPerPartition", 3).load(path).collect()
    back = np.zeros_like(d)
    for r in rows:
        back[r["variant_index"], r["sample_index"]] = -1 if r["dosage"] is None else r["dosage"]
    assert (back == d).all()
    with pytest.raises(ValueError):
        bed.pack(np.array([0, 5]))


def test_tables(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("a\tb\tc\n1\t2\n3\t4\t5\t6\n")
    df = tables.delimited(spark, str(tmp_path / "t.tsv"))
    assert [tuple(r) for r in df.collect()] == [("1", "2", None), ("3", "4", "5")]
    assert tables.score_column(["x", "prediction"]) == "prediction"
    names = {k: v[1] for k, v in tables.PHENOTYPES.items()}
    assert tables.resolve_alias(" High Blood Pressure ", names) == "hypertension"
    coefficients = spark.createDataFrame([(1, 0.5)], "variant_id long, beta double")
    tables.save_artifact(str(tmp_path / "a"), coefficients, {"seed": 1})
    assert tables.load_artifact(spark, str(tmp_path / "a"), {"seed": 1}).collect() == coefficients.collect()
    assert tables.load_artifact(spark, str(tmp_path / "a"), {"seed": 2}) is None
    with pytest.raises(ValueError, match="bad block"):
        tables.validate_blocks(spark.createDataFrame([(1, 0, 10), (1, 5, 20)], "chrom int, start long, end long"))


def test_bessel_and_inverse_moment():
    z = np.array([0.01, 1.0, 30.0])
    want = 0.5 * np.log(np.pi / (2 * z)) - z
    assert np.allclose(special.log_bessel_k(0.5, z), want, rtol=1e-9)
    # GIG(-1/2) is the inverse Gaussian: E[X] = sqrt(chi / psi)
    assert special.gig_mean(np.array([-0.5]), np.array([2.0]), np.array([8.0]))[0] == pytest.approx(0.5, rel=1e-8)


def _cohort(spark, binary):
    rng = np.random.default_rng(5)
    n, p = 600, 20
    d = rng.binomial(2, 0.3, (n, p))
    beta = np.zeros(p)
    beta[[2, 9]] = (0.8, -0.7)
    mean, scale = d.mean(0), d.std(0)
    eta = ((d - mean) / scale) @ beta
    y = (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(float) if binary else eta + rng.standard_normal(n)
    calls = spark.createDataFrame([(i, j, int(d[i, j])) for i in range(n) for j in range(p) if d[i, j]], "sample_id long, variant_id long, dosage int")
    st = spark.createDataFrame([(j, float(mean[j]), float(scale[j])) for j in range(p)], "variant_id long, mean double, scale double")
    samples = spark.createDataFrame([(i, float(y[i]), float(rng.standard_normal())) for i in range(n)], "sample_id long, y double, cov double")
    rows, _, zero = design(calls, st, samples, ["cov"], "y")
    return rows, zero, beta


@pytest.mark.parametrize("binary", [False, True])
def test_fit_recovers_the_signal(spark, binary):
    rows, zero, beta = _cohort(spark, binary)
    got = em.fit(rows.cache(), zero, 2, np.full(20, 0.02), np.full(20, 0.7), np.full(20, 0.5), binary=binary, iterations=10 if binary else 40)
    assert np.corrcoef(got.beta, beta)[0, 1] > 0.9
    assert abs(got.beta[2] - 0.8) < 0.3 and np.abs(np.delete(got.beta, [2, 9])).max() < 0.25


def test_inverse_moment_is_continuous_at_small_products():
    for p in (-0.7, 0.3, 0.8, 1.7):
        above, below = (special.gig_inverse_mean(np.array([p]), np.array([1.0]), np.array([x]))[0] for x in (1.01e-16, 0.99e-16))
        assert above == pytest.approx(below, rel=0.05)


def test_sample_files(spark):
    f = spark.createDataFrame([("f1 s1 0 0 1 -9",), ("f2\ts2 0 0 2 -9",)], "value string")
    assert [r[0] for r in bed.fam(f).collect()] == ["s1", "s2"]
    assert bed.sample_layout(["a", "b", "c"], ["c", "a"], ["c", "b", "a"]) == [2, 0]
    with pytest.raises(ValueError):
        bed.sample_layout(["a"], ["z"])


def test_streaming_sums(spark, tmp_path):
    calls = spark.createDataFrame([(1, 7, 2), (2, 7, None), (3, 8, 1)], "sample_id long, variant_id long, dosage int")
    calls.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(calls.schema).parquet(str(tmp_path / "in"))
    q = incremental.start(stream, "sums", str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    got = {r["variant_id"]: tuple(r)[1:] for r in spark.table("sums").collect()}
    assert got == {7: (2, 4, 1, 1), 8: (1, 1, 1, 0)}


def test_command_line(spark, tmp_path, capsys):
    from cohortscore import cli

    from .conftest import SF

    assert cli.main(["list-phenotypes"]) == 0 and "hypertension" in capsys.readouterr().out
    assert cli.main(["doctor", SF]) == 0
    assert cli.main(["run", "class_counts", SF, str(tmp_path / "out")]) == 0
    assert spark.read.csv(str(tmp_path / "out"), sep="\t", header=True).count() == 6
    assert cli.main(["sweep", SF, str(tmp_path / "many"), "auc", "no_such_query"]) == 1


def test_calls_of_odd_spellings_and_long_lines(spark, monkeypatch):
    """A line's samples are read in pieces, without an array of them; any spelling of a call counts as before."""
    from cohortscore.sources import vcf

    tokens = ["0/0", "0|0:3", "1", "0", ".", "", "./.", "0/.:1", "1|1:9", "2/1", "0/10:4", "10|11", "0/0/1", "1/1/1", ":5", "0/1:", "./1", "0|1"]
    want = [0, 0, 2, 0, None, None, None, None, 2, 2, 1, 2, 1, 2, None, 1, None, 1]
    monkeypatch.setattr(vcf, "STEP", 5)
    assert [len(x.split(b"\t")) for x in vcf.parts_of("\t".join(tokens).encode())] != [len(tokens)]
    assert b"\t".join(vcf.parts_of("\t".join(tokens).encode())) == "\t".join(tokens).encode()
    head = "1\t5\tv{}\tA\tG\t.\t.\t.\t"
    rows = [head.format(1) + "GT:DP\t" + "\t".join(tokens), head.format(2) + "DP:GT\t7:0/1\t7\t7:0/0:1\t7:./.", head.format(3) + "DP\t7\t8", head.format(4) + "GT", "1\t5\tv5\tA\tG\t.\t.\t."]
    got = {(r["variant_id"], r["sample_index"]): r["dosage"] for r in vcf.calls(spark.createDataFrame([(r,) for r in rows], "value string")).collect()}
    assert got == {("v1", i): w for i, w in enumerate(want) if w != 0} | {("v2", 0): 1, ("v2", 1): None, ("v2", 3): None, ("v3", 0): None, ("v3", 1): None}
    assert "transform(" not in vcf.calls(spark.createDataFrame([(rows[0],)], "value string"))._jdf.queryExecution().optimizedPlan().toString().lower()
