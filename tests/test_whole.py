"""Queries do all of their input: no subset of ids, texts or persons."""

from cohortscore.plans import special
from cohortscore.plans.relation import build

from .conftest import SF


def _ids(df):
    return {r["variant_id"] for r in df.select("variant_id").distinct().collect()}


def test_scan_and_pack_take_all_variants(spark):
    want = _ids(build(spark, SF, "calls"))
    assert max(want) > 100
    assert _ids(special.pack_2bit(spark, SF)) == want
    assert _ids(special.scan_vcf(spark, SF)) == {f"v{v}" for v in want}


def test_places_over_ranges(spark):
    ids = [5, 0, 4095, 4096, 9000, 20000]
    got = special.places(spark.createDataFrame([(i,) for i in ids], "sample_id long")).collect()
    assert {r["sample_id"]: r["ordinal"] for r in got} == {v: i for i, v in enumerate(sorted(ids))}


def test_fit_takes_common_variants_once(spark):
    made = {}
    want = _ids(build(spark, SF, "maf", made).where("maf >= 0.01"))
    kept = _ids(special.reduced_variants(spark, SF, made))
    assert kept <= want and max(kept) > 100
    assert _ids(special.fit_quantitative(spark, SF)) == kept


def test_ties_of_all_variants(spark):
    ids = _ids(build(spark, SF, "sites"))
    got = {r["variant_id"]: r for r in build(spark, SF, "tie_groups").collect()}
    assert set(got) == {v + k for v in ids for k in (0, 1000, 2000)}
    for v in ids:
        assert got[v]["group_id"] == got[v + 1000]["group_id"] == got[v + 2000]["group_id"] <= v
        assert got[v]["sign"] == got[v + 1000]["sign"] and abs(got[v + 2000]["sign"]) == 1
