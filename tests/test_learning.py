"""Trained models against planted structure."""

import numpy as np
import pytest

from cohortwave.operators import learning as L

KEYS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def planted(spark):
    """Key a decides the class, b and c are noise."""
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 3))
    y = (x[:, 0] > 0).astype(int)
    rows = [(i, k, float(x[i, j])) for i in range(300) for j, k in enumerate(KEYS)]
    return spark.createDataFrame(rows, "subject long, key string, value double").cache(), spark.createDataFrame([(i, int(y[i]), i % 3) for i in range(300)], "subject long, y int, fold int").cache()


def _accuracy(said, truth):
    t = said.join(truth, "subject").toPandas()
    return len(t), ((t.p >= 0.5) == (t.y == 1)).mean()


@pytest.mark.parametrize("kind", ["logistic", "forest"])
def test_classifiers_find_what_decides(planted, kind):
    features, truth = planted
    said = L.train_classifier(L.vectors(features, KEYS), truth.where("fold < 2"), kind).join(truth.where("fold = 2").select("subject"), "subject")
    n, hit = _accuracy(said, truth)
    assert n == 100 and hit > 0.9


def test_late_fusion_scores_every_subject(planted):
    features, truth = planted
    sets = {"one": (features.where("key = 'a'"), ["a"]), "two": (features.where("key <> 'a'"), ["b", "c"])}
    n, hit = _accuracy(L.fusion(sets, truth, "late"), truth)
    assert n == 300 and hit > 0.9


def test_elimination_keeps_what_decides(planted):
    features, truth = planted
    wide = features.groupBy("subject").pivot("key", KEYS).sum("value")
    assert L.backward_elimination(wide, truth, KEYS, 1) == ["a"]


def test_clusters_are_numbered_by_value(spark):
    rows = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 101, 102, 103, 501, 502)] + [(None,)], "x double")
    got = L.ordered_clusters(rows, "x", 3).collect()
    assert {r.x: r.cluster for r in got} == {1: 0, 2: 0, 3: 0, 101: 1, 102: 1, 103: 1, 501: 2, 502: 2, None: None}


def test_neighbours_in_blocks_are_those_of_brute_force(spark):
    r = np.random.default_rng(4)
    x, y = r.normal(size=(90, 4)), r.integers(0, 2, 90)
    rows = [(i, x[i].tolist(), float(y[i])) for i in range(90)]
    v = spark.createDataFrame(rows, "id long, v array<double>, y double")
    got = {q.id: q.y for q in L.knn_predict(v.where("id < 60"), v.where("id >= 60").select("id", "v"), 5, block=16).collect()}
    assert got == {i: y[np.argsort(((x[:60] - x[i]) ** 2).sum(1), kind="stable")[:5]].mean() for i in range(60, 90)}
