"""Tuned models against the naive one, and their scores against plain formulas."""

import math

import numpy as np
import pytest

from cohortwave.operators import learning as L
from cohortwave.operators import tuning as U
from cohortwave.plans import catalogue

KEYS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def planted(spark):
    """Keys a and b decide, on very different scales; some cells are null."""
    r = np.random.default_rng(11)
    x = r.normal(size=(320, 4)) * [1000, 0.01, 1, 1]
    score = x[:, 0] / 1000 + x[:, 1] / 0.01
    rows = [(i, *[None if (i + j) % 29 == 0 else float(x[i, j]) for j in range(4)]) for i in range(320)]
    wide = spark.createDataFrame(rows, "subject long, a double, b double, c double, d double").cache()
    classes = spark.createDataFrame([(i, int(score[i] > 0), i % 4) for i in range(320)], "subject long, y int, fold int").cache()
    values = spark.createDataFrame([(i, float(score[i]), i % 4) for i in range(320)], "subject long, y double, fold int").cache()
    return wide, classes, values


def mcc(p, y):
    tp, tn, fp, fn = (float(((p >= 0.5) == a)[y == b].sum()) for a, b in ((True, 1), (False, 0), (True, 0), (False, 1)))
    below = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return (tp * tn - fp * fn) / math.sqrt(below) if below else 0.0


@pytest.mark.parametrize("kind", sorted(U.CLASSIFIERS))
def test_tuned_classifiers_beat_the_naive_one(planted, kind):
    wide, classes, _ = planted
    t = U.held_out(wide, classes, KEYS, kind, 3).join(classes, "subject").toPandas()
    n = U.naive(classes, 3).join(classes, "subject").toPandas()
    assert len(t) == len(n) == 80 and set(t.fold) == {3}
    assert mcc(t.p, t.y) > 0.6 > 0.1 > mcc(n.p, n.y)


@pytest.mark.parametrize("kind", sorted(U.REGRESSORS))
def test_tuned_regressors_beat_the_naive_one(planted, kind):
    wide, _, values = planted
    t = U.held_out(wide, values, KEYS, kind, 3, regression=True).join(values, "subject").toPandas()
    n = U.naive(values, 3).join(values, "subject").toPandas()
    assert ((t.p - t.y) ** 2).mean() < 0.5 * ((n.p - n.y) ** 2).mean()


def test_the_best_grid_point_is_taken(planted):
    wide, classes, _ = planted
    model = U.tune(wide, classes, KEYS, "logistic", grid={"regParam": [0.01, 1000.0], "elasticNetParam": [1.0]})
    scores = U.grid_scores(model)
    assert scores[0][0]["regParam"] == 0.01 and scores[0][1] > 0.8 and scores[1][1] == 0.0
    assert model.bestModel.stages[-1].getRegParam() == 0.01


def test_evaluators_are_the_formulas(spark):
    r = np.random.default_rng(2)
    y, p = r.integers(0, 2, 60), r.integers(0, 2, 60)
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "label double, prediction double")
    assert abs(U.MatthewsEvaluator().evaluate(rows) - mcc(p, y)) < 1e-12
    v, w = r.permutation(40), r.permutation(40)
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(v, w)], "label double, prediction double")
    assert abs(U.RankErrorEvaluator().evaluate(rows) - math.sqrt(((v - w) ** 2).mean())) < 1e-9
    assert U.MatthewsEvaluator().evaluate(rows.limit(0)) == 0.0


@pytest.mark.parametrize("kind", ["logistic", "forest"])
def test_elimination_keeps_what_decides(planted, kind):
    wide, classes, _ = planted
    left, means = U.eliminate(wide, classes, KEYS, kind, step=0.25)
    assert {"a", "b"} <= set(left) and len(left) < 4 + (kind == "logistic") and [n for n, _ in means] == [1, 2, 3, 4]
    assert dict(means)[2] > dict(means)[1] + 0.1


def test_meta_models_see_no_label_that_they_predict(spark):
    """Base predictions are noise, so a meta-model that learned its own subjects' labels would show."""
    r = np.random.default_rng(6)
    y = r.integers(0, 2, 200)
    preds = spark.createDataFrame([(i, m, float(r.random())) for i in range(200) for m in [f"m{k}" for k in range(30)]], "subject long, model string, p double")
    folds = spark.createDataFrame([(i, int(y[i]), i % 3) for i in range(150)], "subject long, y int, fold int")
    said = L.stack(preds, folds, [f"m{k}" for k in range(30)], "forest").toPandas().set_index("subject").p
    assert len(said) == 200 and abs(mcc(said.loc[:149].to_numpy(), y[said.loc[:149].index])) < 0.3
    alone = L.stack(preds, folds.drop("fold"), [f"m{k}" for k in range(30)], "forest").toPandas()
    assert sorted(alone.subject) == list(range(150, 200))


def _counted(spark, wide):
    """wide, and how many of its rows have been read."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return wide.mapInArrow(count, wide.schema), seen


def test_rounds_and_grid_points_read_their_input_once(spark, planted):
    """Before, each fit and score read the table and all that came before it anew."""
    wide, classes, values = planted
    for run in (
        lambda w: U.eliminate(w, classes, KEYS, "logistic"), lambda w: U.tune(w, classes, KEYS, "logistic"), lambda w: U.tune(w, values, KEYS, "linear", regression=True),
        lambda w: L.oof_predictions(L.vectors(w.unpivot(["subject"], KEYS, "key", "value"), KEYS), classes, "logistic", 4).count(),
    ):
        rows, seen = _counted(spark, wide)
        run(rows)
        assert seen.value == 320


def test_rank_errors_with_ties(spark):
    import pandas as pd

    r = np.random.default_rng(8)
    t = pd.DataFrame({"label": r.integers(0, 5, 300) * 1.0, "prediction": r.integers(0, 40, 300) / 4})
    want = math.sqrt(((t.label.rank() - t.prediction.rank()) ** 2).mean())
    assert abs(U.RankErrorEvaluator().evaluate(spark.createDataFrame(t)) - want) < 1e-9


def test_wide_tables_are_one_shuffle_by_subject(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (1, "b", None), (2, "b", 4.0), (3, "z", 9.0)], "subject long, key string, value double")
    wide = L.wide_table(rows, ["a", "b"])
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "pivotfirst" not in plan
    assert sorted(wide.collect()) == [(1, 1.0, None), (2, None, 4.0), (3, None, None)]


def test_elimination_query_begins_with_all_places_of_the_vectors(spark, tmp_path):
    """Place 40 alone decides; before, the query looked at the first 16 of 64."""
    x = np.random.default_rng(12).normal(size=(240, 64))
    rows = [(i, v.tolist(), 7 if v[40] > 0 else 2) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalogue.queries()["fs17_backward_elimination"](spark, str(tmp_path)).collect()
    scores = {int(r.name): r.score for r in got if r.what == "score"}
    assert max(scores) == 64 and min(scores) == 1 and max(scores.values()) > 0.9
    assert "f40" in {r.name for r in got if r.what == "kept"}
