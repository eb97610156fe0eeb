"""Ranges of about equally many rows, however the values are spread, and the rankings over them."""

import math

import numpy as np
import pytest

from cohortscore.plans import relation
from cohortscore.plans.relation import RELATIONS, build

from .conftest import SF


def _heavy(n=4000):
    rng = np.random.default_rng(0)
    values = rng.standard_cauchy(n) ** 3
    values[:3] = (1e300, -1e300, math.inf)
    values[3:60] = 0.25  # ties
    return values


def test_no_range_holds_more_than_its_share(spark, monkeypatch):
    monkeypatch.setattr(relation, "RANGE_ROWS", 20)
    values = _heavy()
    df = spark.createDataFrame([(i, float(v), i % 2) for i, v in enumerate(values)], "sample_id long, score double, target int")
    for name in ("scores_up", "scores_down_pos"):
        made = {"predictions_in": df}
        rows = build(spark, "", name, made).collect()
        sizes = np.bincount([r["bucket"] for r in rows])
        assert len(sizes) > 100 and sizes.max() <= 0.01 * len(rows) + 5
        sign = 1 if name == "scores_up" else -1
        by = sorted(rows, key=lambda r: sign * r["score"])
        assert [r["bucket"] for r in by] == sorted(r["bucket"] for r in rows)
        total = 0
        for b in range(len(sizes)):
            own = [r for r in rows if r["bucket"] == b]
            assert all(r["before"] == total for r in own)
            total += sum(r["pos"] + (r["neg"] if name == "scores_up" else 0) for r in own)


@pytest.mark.parametrize("rows", [20, 50_000])
def test_rankings_of_heavy_tails(spark, monkeypatch, rows):
    monkeypatch.setattr(relation, "RANGE_ROWS", rows)
    values = np.where(np.isinf(_heavy(1500)), 1e305, _heavy(1500))
    target = (np.arange(1500) * 7 % 5 < 2).astype(int)
    df = spark.createDataFrame([(i, float(v), int(t), float(i)) for i, (v, t) in enumerate(zip(values, target, strict=True))], "sample_id long, score double, target int, y double")
    ranks = {r[0]: r[1] for r in build(spark, "", "avg_rank", {"predictions_in": df}).collect()}
    order = np.sort(values)
    want = (np.searchsorted(order, values) + np.searchsorted(order, values, side="right") + 1) / 2
    assert np.allclose([ranks[i] for i in range(1500)], want)
    pos, neg = values[target == 1], np.sort(values[target == 0])
    auc = (np.searchsorted(neg, pos) + np.searchsorted(neg, pos, side="right")).sum() / 2 / len(pos) / len(neg)
    assert build(spark, "", "auc", {"predictions_in": df}).first()[0] == pytest.approx(auc, abs=1e-6)
    top = sorted(range(1500), key=lambda i: (-values[i], i))[:150]
    tail = build(spark, "", "top_tail", {"predictions_in": df}).first()
    assert tail["n_top"] == 150 and tail["enrichment"] == pytest.approx(target[top].mean() / target.mean(), abs=1e-6)
    effects = spark.createDataFrame([(i, float(v)) for i, v in enumerate(np.tanh(values / 1e3))], "variant_id long, beta double")
    curve = {r["variant_id"]: r for r in build(spark, "", "cumulative_variance", {"effects": effects}).collect()}
    size = np.abs(np.tanh(values / 1e3))
    by = sorted(np.flatnonzero(size), key=lambda i: (-size[i], i))
    share = np.cumsum(size[by] ** 2) / (size**2).sum()
    assert [curve[i]["place"] for i in by] == list(range(1, len(by) + 1)) and np.allclose([curve[i]["fraction"] for i in by], share, atol=2e-6)


def test_ties_meet_without_a_window(spark):
    plan = RELATIONS["tie_map"]
    assert "OVER" not in plan.text and "min_by" in plan.text


def test_what_is_ranged_is_made_once(spark):
    """The scores are made once; the query that ranks them reads no calls again."""
    made = build(spark, SF, "auc_all")
    assert not [f for f in made.inputFiles() if "lineitem" in f]
