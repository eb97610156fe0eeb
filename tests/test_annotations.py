"""Typed INFO of any key, and designs whose kinds and levels come from the data."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortscore import cli
from cohortscore.operators import annotations
from cohortscore.plans import registry

from .conftest import SF, same
from .test_run import _files


@pytest.mark.parametrize("key", ["info_entries", "design_cells", "design_features"])
def test_queries(spark, duck, key):
    same(registry.queries()[key](spark, SF), duck, registry.oracle_sql()[key])


def test_info_of_any_key(spark):
    text = "AF=0.1,.,x;DP=10;DB;END=-5;.;;EMPTY=;E=1e3;N=nan;DP=11;A=b=c"
    got = spark.createDataFrame([(text,), (".",), (None,)], "info string").select(annotations.typed_info(F.col("info")).alias("m")).collect()
    plain = {k: [None if x is None else next(v for v in x if v is not None) for x in v] for k, v in got[0]["m"].items()}
    assert np.isnan(plain.pop("N")[0])
    assert plain == {"AF": [0.1, None, "x"], "DB": [], "END": [-5], "EMPTY": [""], "E": [1000.0], "DP": [11], "A": ["b=c"]}
    assert isinstance(plain["DP"][0], int) and isinstance(plain["E"][0], float)
    assert got[1]["m"] == {} and got[2]["m"] is None


def _table(spark):
    rows = [(f"v{i}", ["yes", "no", None][i % 3], ["lof", "missense", "neutral"][i % 3], str(i * i), f"a={i % 4},b=1", ["gene > exon", "gene > intron", "far > away"][i % 3 if i % 5 else 0], "same") for i in range(60)]
    return spark.createDataFrame(rows, "variant_id string, coding string, state string, score string, mix string, place string, constant string")


def test_levels_come_from_the_data(spark):
    table = _table(spark)
    cells = annotations.design_cells(table)
    by = {}
    for r in cells.collect():
        by.setdefault(r["feature"], {})[r["variant_id"]] = r["value"]
    # The first level of each column and depth is the reference; a column of one level adds nothing.
    assert set(by) == {"level::coding::0::true", "level::state::0::missense", "level::state::0::neutral", "level::mix::0::b", "level::place::0::gene", "level::place::1::gene>exon", "level::place::1::gene>intron", *(f"curve::score::{k}" for k in range(4))}
    assert by["level::coding::0::true"] == {f"v{i}": 1.0 for i in range(0, 60, 3)}
    values = np.arange(60.0) ** 2
    for k, q in enumerate((0.25, 0.5, 0.75), 1):
        want = np.maximum(values - np.quantile(values, q), 0)
        assert by[f"curve::score::{k}"] == pytest.approx({f"v{i}": x for i, x in enumerate(want) if x})
    scales = {r["feature"]: r for r in annotations.feature_scales(cells, 60).collect()}
    assert scales["level::coding::0::true"]["mean"] == pytest.approx(1 / 3) and scales["level::coding::0::true"]["rms"] == pytest.approx((2 / 9) ** 0.5)


def test_designs_are_centred_and_of_full_rank(spark):
    x, names = annotations.dense_design(_table(spark), [f"v{i}" for i in range(60)])
    assert x.shape == (60, len(names)) and np.allclose(x.mean(0), 0) and np.allclose((x**2).mean(0), 1)
    assert np.linalg.matrix_rank(x) == len(names)
    # mix's b is constant; coding says what states say; each is left out once
    assert "level::mix::0::b" not in names and len({"level::coding::0::true", "level::state::0::missense", "level::state::0::neutral"} & set(names)) == 2
    nothing, none = annotations.dense_design(_table(spark).select("variant_id", "constant"), ["v1", "v2"])
    assert nothing.shape == (2, 0) and none == []


def test_run_with_annotations(spark, tmp_path, capsys):
    d, beta = _files(tmp_path)
    rows = [f"v{j}\t{'strong' if beta[j] else 'weak'}\t{j}" for j in range(12)]
    (tmp_path / "notes.tsv").write_text("variant_id\tgroup\tscore\n" + "\n".join(rows) + "\n")
    args = ["fit", str(tmp_path / "samples.tsv"), "y", str(tmp_path / "out"), str(tmp_path / "a.vcf"), str(tmp_path / "b.vcf"), "--covariates", "cov", "--annotations", str(tmp_path / "notes.tsv")]
    assert cli.main(args) == 0
    summary = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert summary["test"]["r2"] > 0.5 and summary["n_variants"] == 12
