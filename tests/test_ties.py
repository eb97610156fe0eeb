"""Tie fixtures, blocks that add up, and parameters."""

import numpy as np
import pytest

from cohortscore.plans import registry  # noqa: F401
from cohortscore.plans.relation import RELATIONS, build

from .conftest import SF


def _ties(spark, columns):
    """(group, sign) of each column; columns hold 0, 1, 2 and None by sample."""
    n = len(columns[0])
    samples = spark.createDataFrame([(i,) for i in range(n)], "sample_id long")
    sites = spark.createDataFrame([(j,) for j in range(len(columns))], "variant_id long")
    cells = [(i, j, d) for j, c in enumerate(columns) for i, d in enumerate(c) if d != 0]
    calls = spark.createDataFrame(cells, "sample_id long, variant_id long, dosage int")
    states = RELATIONS["states"](spark, calls=calls, samples=samples, sites=sites)
    ties = RELATIONS["tie_map"](spark, signatures=RELATIONS["signatures"](spark, tied_states=states))
    got = {r["variant_id"]: (r["group_id"], r["sign"]) for r in RELATIONS["tie_groups"](spark, tie_map=ties).collect()}
    return [got[j] for j in range(len(columns))]


@pytest.mark.parametrize(("columns", "want"), [
    ([[0, 0, 1, 1], [1, 1, 2, 2], [2, 2, 0, 0]], [(0, 1), (0, 1), (0, -1)]),  # two states, recoded
    ([[0] * 4, [1] * 4, [2] * 4], [(0, 1)] * 3),  # one state at any level
    ([[0, None, 0, 0], [2, 2, 2, None]], [(0, 1)] * 2),  # one state, other calls missing
    ([[0, 1, 0, 1], [1, 0, 1, 0], [1, 1, 1, 1]], [(0, 1), (0, -1), (2, 1)]),
    ([[0, 1, 2, 0], [2, 1, 0, 2], [0, 2, 1, 0]], [(0, 1), (0, -1), (2, 1)]),  # three states: the complement only
    ([[0, 1, 2, None], [0, 1, 2, None], [2, 1, 0, None], [1, None, 0, 1]], [(0, 1), (0, 1), (0, -1), (3, 1)]),
    ([[0, 1, None, 0], [0, 1, 0, None]], [(0, 1), (1, 1)]),  # missing calls must agree
])
def test_ties(spark, columns, want):
    assert _ties(spark, columns) == want


def test_blocks_add_up_to_the_whole_product(spark):
    made = {}
    whole = {r["sample_id"]: r["product"] for r in build(spark, SF, "matvec", made).collect()}
    blocks = build(spark, SF, "block_matvec", made)
    total = {r["sample_id"]: r["s"] for r in blocks.groupBy("sample_id").agg({"product": "sum"}).toDF("sample_id", "s").collect()}
    assert whole.keys() == total.keys() and max(abs(whole[k] - total[k]) for k in whole) < 1e-4
    assert blocks.count() == len(whole) * blocks.select("block_id").distinct().count()
    back = build(spark, SF, "block_transpose_matvec", made)
    assert back.drop("block_id").exceptAll(build(spark, SF, "rmatvec", made)).isEmpty()


def test_products_equal_numpy(spark):
    made = {}
    calls, samples = build(spark, SF, "calls", made), build(spark, SF, "samples", made)
    c, s = calls.toPandas(), samples.toPandas().sort_values("sample_id").reset_index(drop=True)
    ids = sorted(c["variant_id"].unique())
    x = np.zeros((len(s), len(ids)))
    row = dict(zip(s["sample_id"], range(len(s)), strict=True))
    for i, j, d in zip(c["sample_id"], c["variant_id"], c["dosage"], strict=True):
        x[row[i], ids.index(j)] = d
    mean, missing = np.nanmean(x, axis=0), np.isnan(x)
    z = np.where(missing, 0, x - mean)
    z /= np.maximum(np.sqrt((z**2).sum(0) / len(s)), 1e-6)
    got = {r["variant_id"]: r["product"] for r in build(spark, SF, "rmatvec", made).collect()}
    assert np.allclose([got[j] for j in ids], z.T @ s["y"].to_numpy(), atol=1e-3)
    gram = {(r["u"], r["v"]): r["gram"] for r in build(spark, SF, "block_gram", made).collect()}
    assert np.allclose([gram[ids[0], ids[k]] for k in range(5)], (z.T @ z)[0, :5], atol=1e-3)


def test_parameters(spark):
    maf = spark.createDataFrame([(1, 0.005), (2, 0.05), (3, 0.2)], "variant_id long, maf double")
    f = RELATIONS["maf_filter"]
    assert f(spark, maf=maf).count() == 2 and f(spark, {"threshold": 0.1}, maf=maf).count() == 1
    with pytest.raises(ValueError, match="no parameters"):
        f(spark, {"treshold": 0.1}, maf=maf)
    z = spark.createDataFrame([(1, 0.5), (2, -2.0), (3, 0.1)], "variant_id long, z double")
    v = spark.createDataFrame([(1, "snv"), (2, "snv"), (3, "deletion_long")], "variant_id long, variant_class string")
    screen = RELATIONS["marginal_screen"]
    ids = lambda **p: sorted(r["variant_id"] for r in screen(spark, p, z_scores=z, variants=v).collect())
    assert ids() == [2] and ids(protect_structural=True) == [2, 3] and ids(least=9.0) == [1, 2, 3]
