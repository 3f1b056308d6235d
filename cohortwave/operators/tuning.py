"""Models chosen by cross-validation: preparation, grid and score in one pipeline of Spark's ML library.

Tables are wide (subject and a column a key), targets are (subject, y, fold). Medians, scales and models are fitted on the
training folds of each split only. What the rounds of a fold share, its rows and what was prepared of them, is stored once.
"""

from __future__ import annotations

from collections.abc import Callable
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import Imputer, RobustScaler, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import stored
from ..functions.scalar import with_ranks

#: Models by name, each with the grid that is searched where none is given.
CLASSIFIERS = {
    "bayes": (lambda seed: NaiveBayes(modelType="gaussian"), {}),
    "logistic": (lambda seed: LogisticRegression(maxIter=50), {"regParam": [0.01, 0.1], "elasticNetParam": [0.0, 0.5]}),
    "forest": (lambda seed: RandomForestClassifier(numTrees=20, seed=seed), {"maxDepth": [3, 6]}),
    "boosted": (lambda seed: GBTClassifier(maxDepth=3, seed=seed), {"maxIter": [5, 15]}),
}
REGRESSORS = {
    "linear": (lambda seed: LinearRegression(maxIter=50), {"regParam": [0.01, 0.1], "elasticNetParam": [0.0, 0.5]}),
    "forest": (lambda seed: RandomForestRegressor(numTrees=20, seed=seed), {"maxDepth": [3, 6]}),
    "boosted": (lambda seed: GBTRegressor(maxDepth=3, seed=seed), {"maxIter": [5, 15]}),
}


class MatthewsEvaluator(Evaluator):
    """Matthews correlation of label and prediction; 0 where it is undefined."""

    def _evaluate(self, dataset: DataFrame) -> float:
        c, y = F.col("prediction") == 1, F.col("label") == 1
        tp, tn, fp, fn = (float(v or 0) for v in dataset.agg(*[F.sum(t.cast("long")) for t in (c & y, ~c & ~y, c & ~y, ~c & y)]).first())
        below = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
        return (tp * tn - fp * fn) / below**0.5 if below else 0.0

    def isLargerBetter(self) -> bool:
        return True


class RankErrorEvaluator(Evaluator):
    """Root mean square of the difference of the ranks of label and prediction."""

    def _evaluate(self, dataset: DataFrame) -> float:
        x = dataset.select(F.lit(0).alias("one"), F.col("label").cast("double").alias("label"), F.col("prediction").cast("double").alias("prediction"))
        # pairs are counted first and stored: ranks read them several times, and the model's predictions are made once
        x = stored(x.groupBy("one", "label", "prediction").agg(F.count("*").alias("n")))
        ranked = with_ranks(with_ranks(x, ["one"], "label", "a", weight="n"), ["one"], "prediction", "b", weight="n")
        square = (F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))
        return ranked.agg(F.sqrt(F.try_divide(F.sum(F.col("n") * square), F.sum(F.when(square.isNotNull(), F.col("n")))))).first()[0] or 0.0

    def isLargerBetter(self) -> bool:
        return False


def preparation(keys: list[str]) -> list:
    """Nulls and NaN as the key's median, (x - median) / iqr: each key for itself."""
    filled = [f"_{k}" for k in keys]
    return [Imputer(strategy="median", inputCols=keys, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_raw"), RobustScaler(withCentering=True, inputCol="_raw", outputCol="features")]


def pipeline(keys: list[str], model) -> Pipeline:
    """The preparation and the model."""
    return Pipeline(stages=[*preparation(keys), model.setLabelCol("label").setFeaturesCol("features")])


def prepared(keys: list[str], train: DataFrame, *parts: DataFrame) -> tuple[PipelineModel, list[DataFrame]]:
    """The preparation as fitted on train, and label and features of train and of the other parts, stored."""
    ready = Pipeline(stages=preparation(keys)).fit(train)
    return ready, [stored(ready.transform(part).select("label", "features")) for part in (train, *parts)]


def at_once(spark, parallelism: int, tasks: list[Callable]) -> list:
    """What the tasks return, so many of them at a time."""
    with ThreadPool(max(1, min(parallelism, len(tasks)))) as pool:
        return pool.map(lambda f: f(), [inheritable_thread_target(spark)(f) for f in tasks])


def tune(wide: DataFrame, target: DataFrame, keys: list[str], kind: str, regression: bool = False, grid: dict[str, list] | None = None, parallelism: int = 2, seed: int = 7) -> CrossValidatorModel:
    """The pipeline of `kind` with the grid point of best mean score over the folds of target (subject, y, fold), fitted on all of them."""
    make, usual = (REGRESSORS if regression else CLASSIFIERS)[kind]
    model, points = make(seed), ParamGridBuilder()
    for name, values in (usual if grid is None else grid).items():
        points = points.addGrid(model.getParam(name), values)
    rows = stored(wide.join(target.select("subject", F.col("y").cast("double").alias("label"), F.col("fold").cast("int").alias("fold")), "subject").select("subject", *keys, "label", "fold"))
    folds = sorted(r[0] for r in rows.select("fold").distinct().collect())
    evaluator = RankErrorEvaluator() if regression else MatthewsEvaluator()
    grid, whole = points.build(), pipeline(keys, model)
    scores = []
    for fold in folds:
        _, (train, test) = prepared(keys, rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold))
        one = lambda point, train=train, test=test: evaluator.evaluate(model.fit(train, point).transform(test))
        scores.append(at_once(rows.sparkSession, parallelism, [lambda p=p, one=one: one(p) for p in grid]))
    means, spread = np.mean(scores, axis=0), np.std(scores, axis=0)
    best = whole.fit(rows, grid[int(np.argmax(means) if evaluator.isLargerBetter() else np.argmin(means))])
    search = CrossValidator(estimator=whole, estimatorParamMaps=grid, evaluator=evaluator, numFolds=max(2, len(folds)), foldCol="fold", parallelism=parallelism, seed=seed)
    return search._copyValues(CrossValidatorModel(best, means.tolist(), None, spread.tolist()))


def grid_scores(model: CrossValidatorModel) -> list[tuple[dict, float]]:
    """The grid's points with their mean scores."""
    return [({p.name: v for p, v in point.items()}, score) for point, score in zip(model.getEstimatorParamMaps(), model.avgMetrics)]


def predict(model: CrossValidatorModel, wide: DataFrame) -> DataFrame:
    """subject, p: probability of class 1, or the predicted value."""
    out = model.transform(wide)
    return out.select("subject", (vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction")).alias("p"))


def held_out(wide: DataFrame, target: DataFrame, keys: list[str], kind: str, test_fold: int, **how) -> DataFrame:
    """subject, p of the subjects of test_fold, by a model that was tuned on the others."""
    model = tune(wide, target.where(F.col("fold") != test_fold), keys, kind, **how)
    return predict(model, wide.join(target.where(F.col("fold") == test_fold).select("subject"), "subject", "left_semi"))


def naive(target: DataFrame, test_fold: int) -> DataFrame:
    """subject, p: the mean target of the other folds, for the subjects of test_fold."""
    mean = target.where(F.col("fold") != test_fold).agg(F.avg("y").alias("p"))
    return target.where(F.col("fold") == test_fold).select("subject").join(F.broadcast(mean))


def _weights(fitted, n: int) -> list[float]:
    """How much each key counts in a fitted pipeline: importance in trees, size of the weight in linear models, whose inputs are scaled."""
    model = fitted.stages[-1]
    values = model.featureImportances if hasattr(model, "featureImportances") else model.coefficients
    return [abs(float(v)) for v in values.toArray()] if len(values) == n else [0.0] * n


def eliminate(wide: DataFrame, target: DataFrame, keys: list[str], kind: str = "forest", step: float = 0.25, least: int = 1, seed: int = 7, parallelism: int = 2) -> tuple[list[str], list[tuple[int, float]]]:
    """The keys of recursive elimination with cross-validation, and the mean score by number of keys.

    In each fold the share `step` of the keys that count least, one at least, goes again and again, and what is left is
    scored on the fold. The number of keys with the best mean score (of equals the least) is what the elimination on all
    rows stops at. The driver loops over folds, `parallelism` at a time, and rounds; each fit and score is a job over all
    rows. Keys are prepared each for itself, so once a fold does for all its rounds.
    """
    make, _ = CLASSIFIERS[kind]
    rows = stored(wide.select("subject", *keys).join(target.select("subject", F.col("y").cast("double").alias("label"), "fold"), "subject"))
    folds = sorted(r[0] for r in target.select("fold").distinct().collect())

    def trained(left: list[str], train: DataFrame) -> PipelineModel:
        """The model of the keys that are left, on prepared rows of all keys."""
        some = VectorSlicer(inputCol="features", outputCol="some", indices=[keys.index(k) for k in left])
        return Pipeline(stages=[some, make(seed).setLabelCol("label").setFeaturesCol("some")]).fit(train)

    def shrunk(keys: list[str], fitted) -> list[str]:
        weights = _weights(fitted, len(keys))
        gone = max(1, min(int(step * len(keys)), len(keys) - least))
        order = sorted(range(len(keys)), key=lambda k: (weights[k], keys[k]))
        return [k for i, k in enumerate(keys) if i not in set(order[:gone])]

    def rounds(fold) -> list[tuple[int, float]]:
        """The score by number of keys, with the fold left out."""
        _, (train, test) = prepared(keys, rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold))
        left, out = list(keys), []
        while True:
            fitted = trained(left, train)
            out.append((len(left), MatthewsEvaluator().evaluate(fitted.transform(test))))
            if len(left) <= least:
                return out
            left = shrunk(left, fitted)

    scores: dict[int, list[float]] = {}
    for n, score in [x for fold in at_once(rows.sparkSession, parallelism, [lambda fold=fold: rounds(fold) for fold in folds]) for x in fold]:
        scores.setdefault(n, []).append(score)
    means = sorted((n, sum(v) / len(v)) for n, v in scores.items())
    wanted = max(means, key=lambda m: (m[1], -m[0]))[0]
    left, every = list(keys), prepared(keys, rows)[1][0] if len(keys) > wanted else None
    while len(left) > wanted:
        left = shrunk(left, trained(left, every))
    return left, means
