"""Assembled tables, bands, folds and scores on small tables, odd ones among them."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortwave.functions.scalar import bands
from cohortwave.operators import assembly as A
from cohortwave.operators import evaluation as E
from cohortwave.operators import selection as S
from cohortwave.operators import series as T
from cohortwave.operators import spectral as P

LONG = "subject long, key string, value double"


def test_families_meet_by_subject_only(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, "x", None)], LONG)
    b = spark.createDataFrame([(1, "x", 3.0), (3, "y", 4.0)], LONG)
    got = A.assemble({"a": a, "b": b})
    assert sorted(map(tuple, got.collect()), key=repr) == [(1, "a", "x", 1.0), (1, "b", "x", 3.0), (2, "a", "x", None), (3, "b", "y", 4.0)]
    assert {r.subject for r in A.assemble({"a": a, "b": b}, "inner").collect()} == {1}
    assert A.assemble({"a": a, "b": b.limit(0)}, "inner").count() == 0
    wide = A.widen(got, [("a", "x"), ("b", "x")]).orderBy("subject").collect()
    assert [tuple(r) for r in wide] == [(1, 1.0, 3.0), (2, None, None), (3, None, None)]


def test_missing_fits_are_null_rows(spark):
    fits = spark.createDataFrame([(1, "open", "a", 1.0, 2.0), (2, "open", "b", 3.0, None)], "subject long, state string, channel string, offset double, exponent double")
    subjects = spark.createDataFrame([(1,), (2,), (2,), (3,)], "subject long")
    got = {(r.subject, r.key): r.value for r in A.fit_table(fits, subjects, ["offset", "exponent"]).collect()}
    assert len(got) == 12 and got[1, "open_offset_a"] == 1.0 and got[2, "open_exponent_b"] is None and got[3, "open_offset_a"] is None


def test_symptoms_count_what_is_missing(spark):
    df = spark.createDataFrame([(1, 0.0, 2.0, 15.0), (2, None, 0.0, 10.0), (3, None, None, None)], "subject long, loc double, head double, memory double")
    got = {r.subject: r for r in A.simple_symptoms(df, {"LOC": "loc", "Headache": "head", "Memory": "memory"}, {"LOC": F.col("loc") * 10}, "memory").collect()}
    assert (got[1].LOC, got[1].Headache, got[1].Memory, got[1].average_score) == (0, 1, 0, 2 / 3)
    assert (got[2].LOC, got[2].Headache, got[2].Memory, got[2].average_score) == (1, 0, 1, 2.5)
    assert (got[3].LOC, got[3].average_score) == (1, None)


def test_bands():
    assert bands("standard", fs=100) == [(0.3, 1.5), (1.5, 4), (4, 8), (8, 12), (12, 30), (30, 70)][:6] and bands("standard")[-1] == (150, 250)
    assert len(bands("linear")) == 50 and len(bands("log")) == 4 and len(bands("log_40")) == 6 and len(bands("custom_low")) == 9
    cut = bands("custom", 2, True)
    assert len(cut) == 20 and math.isclose(cut[0][1], math.sqrt(0.3 * 1.5)) and bands("log-standard", min_freq=0.6)[0] == (0.5, 1 / 0.7)
    with pytest.raises(ValueError):
        bands("none")


@pytest.mark.parametrize("order", range(1, 8))
def test_integrals_are_exact_up_to_their_order(spark, order):
    f = np.linspace(-3, 3, 25)
    rows = [(1, "o", "c", k, float(x), float(sum(x**q for q in range(order + 1)))) for k, x in enumerate(f)]
    df = spark.createDataFrame(rows, "subject long, state string, channel string, k int, freq double, power double")
    want = sum((3 ** (q + 1) - (-3) ** (q + 1)) / (q + 1) for q in range(order + 1))
    exact = order if order > 1 else 1
    assert abs(P.integrate_corrected(df, exact).first().integral - want) < 1e-8 * max(1, abs(want))
    if order <= 3:
        assert abs(P.cumulative_cubic(df).orderBy(F.desc("k")).first().cum - want) < 1e-8


def test_positions_and_grids(spark):
    df = spark.createDataFrame([(1, "c", "o", i, float(i)) for i in range(100)] + [(2, "c", "o", i, 0.0) for i in range(6)] + [(3, "c", "o", i, 0.0) for i in range(3)], "subject long, channel string, state string, t_idx long, x double")
    at = lambda s, **kw: sorted(r.t_idx for r in T.downsample_index(df, 6, **kw).where(f"subject = {s}").collect())
    assert at(1) == sorted({int(math.exp(math.log(99) * k / 5) + 1e-9) for k in range(6)}) and at(1, method="linear") == [0, 19, 39, 59, 79, 99]
    assert at(1, two_sided=True) == [1, 43, 49, 51, 57, 99] and at(2) == list(range(6)) and at(3) == []
    assert T.freq_grid("linear", 1, 5, 5) == [1, 2, 3, 4, 5] and T.freq_grid("log", 1, None, 50)[-1] == 250 and T.freq_grid("log10", 1, 300, 50)[0] == 1
    curve = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, 4.0), (1, 4.0, 0.0), (2, 1.0, 1.0)], "g0 long, freq double, power double")
    got = {r.freq: r.power for r in T.interpolate(curve, [0.0, 1.5, 2.0, 3.0, 5.0], ["g0"]).collect()}
    assert got == {0.0: 0.0, 1.5: 3.0, 2.0: 4.0, 3.0: 2.0, 5.0: -2.0}


def test_folds(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(60)], "subject long, y long")
    rows = S.repeated_folds(df, "subject", "y", 4, 3, "s").collect()
    assert len(rows) == 180 and all(sum(r.repeat == q and r.fold == f and r.y == y for r in rows) == 5 for q in range(3) for f in range(4) for y in range(3))
    assert len({tuple(sorted(r.subject for r in rows if r.repeat == q and r.fold == 0)) for q in range(3)}) == 3
    groups = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b")], "subject long, site string")
    assert {r.subject: r.fold for r in S.group_folds(groups, "site").collect()} == {2: 0, 3: 1, 1: 2, 4: 2}
    split = S.shuffle_split(df, "subject", "y", 0.25, "s").collect()
    assert all(sum(r.test and r.y == y for r in split) == 5 for y in range(3))


def test_scores_over_targets(spark):
    rows = [(i, "m", t, float(i % 5 + 1), float(i % 5 + 1 + (t == "b") * i)) for i in range(20) for t in "ab"] + [(i, "flat", "a", 1.0, 1.0) for i in range(20)] + [(0, "m", "a", None, 1.0)]
    p = spark.createDataFrame(rows, "subject long, model string, target string, y double, p double")
    got = {(r.model, r.target): r for r in E.target_scores(p).collect()}
    assert got["m", "a"].pearson == 1.0 and got["m", "a"].rmse == 0.0 and got["flat", "a"].pearson is None and got["flat", "a"].r2 is None
    s = {r.model: r for r in E.regression_summary(E.target_scores(p)).collect()}
    assert s["flat"].pearson == -100.0 and s["flat"].rmse == 0.0 and s["m"].n_targets == 2
    assert abs(s["m"].rmse - math.sqrt((got["m", "a"].rmse ** 2 + got["m", "b"].rmse ** 2) / 2)) < 1e-12


def test_regressors_like_the_best_stay(spark):
    r = np.random.default_rng(9)
    y = r.normal(size=80)
    rows = [(i, t, m, float(y[i]), float(y[i] + e * r.normal())) for t in ("one", "two") for m, e in (("best", 0.1), ("like", 0.1), ("poor", 3.0)) for i in range(80)]
    got = E.select_regressors(spark.createDataFrame(rows, "subject long, target string, model string, y double, p double")).collect()
    assert {(q.target, q.model) for q in got} <= {(t, m) for t in ("one", "two") for m in ("best", "like")} and len(got) >= 2
