"""Operators against plain formulas on hand-made arrays."""

import math

import numpy as np

from cohortwave.operators import complexity, evaluation, network, selection, spectral


def series(spark, x):
    return spark.createDataFrame([(1, "c", "open", i, float(v)) for i, v in enumerate(x)], "subject long, channel string, state string, t_idx long, x double")


def test_white_noise_has_high_entropy(spark):
    x = np.random.default_rng(1).normal(size=400)
    assert complexity.perm_entropy(series(spark, x)).first().perm_entropy > 0.98
    assert abs(complexity.higuchi_fd(series(spark, x)).first().higuchi_fd - 2) < 0.1


def test_svd_entropy_is_that_of_numpy(spark):
    x = np.sin(np.arange(200) * 0.3) + 0.1 * np.random.default_rng(2).normal(size=200)
    s = np.linalg.svd(np.stack([x[:-2], x[1:-1], x[2:]], 1), compute_uv=False)
    p = s / s.sum()
    assert abs(complexity.svd_entropy(series(spark, x)).first().svd_entropy + (p * np.log2(p)).sum() / math.log2(3)) < 1e-6


def test_aperiodic_exponent_of_a_power_law(spark):
    rows = [(1, "open", "c", k, 1.0 + k, 10.0 * (1.0 + k) ** -1.5) for k in range(60)]
    got = spectral.aperiodic_fixed(spark.createDataFrame(rows, "subject long, state string, channel string, k int, freq double, power double"), 1.0, 60.0).first()
    assert abs(got.exponent - 1.5) < 1e-6 and abs(got["offset"] - 1) < 1e-6


def test_distances_take_the_shorter_way(spark):
    e = spark.createDataFrame([(1, "open", "a", "b", 1.0), (1, "open", "b", "c", 1.0), (1, "open", "a", "c", 0.1)], "subject long, state string, src string, dst string, w double")
    d = {(r.src, r.dst): r.d for r in network.distances(e, ["subject", "state"], 3).collect()}
    assert d["a", "c"] == d["c", "a"] == 2.0 and d["a", "b"] == 1.0


def test_perfect_and_empty_predictions(spark):
    p = spark.createDataFrame([(i, i % 2, "m", float(i % 2)) for i in range(10)], "subject long, y int, model string, p double")
    assert evaluation.roc_auc(p).first().auc == 1.0 and evaluation.binary_scores(p).first().mcc == 1.0
    assert evaluation.binary_scores(p.limit(0)).count() == 0


def test_equal_columns_keep_the_first(spark):
    f = spark.createDataFrame([(i, k, v) for i in range(5) for k, v in (("a", float(i)), ("b", float(i)), ("c", 1.0), ("d", float(-i)))], "subject long, key string, value double")
    assert sorted(r.key for r in selection.drop_duplicate_constant(f).collect()) == ["a", "d"]
