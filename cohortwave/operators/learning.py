"""Trained models by Spark's own ML library, on long feature tables (subject, key, value)."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import stored

CLASSIFIERS = {"logistic": lambda seed: LogisticRegression(regParam=0.01), "forest": lambda seed: RandomForestClassifier(numTrees=20, maxDepth=5, seed=seed), "boosted": lambda seed: GBTClassifier(maxIter=10, maxDepth=3, seed=seed)}
REGRESSORS = {"linear": lambda seed: LinearRegression(regParam=0.01), "forest": lambda seed: RandomForestRegressor(numTrees=20, maxDepth=5, seed=seed), "boosted": lambda seed: GBTRegressor(maxIter=10, maxDepth=3, seed=seed)}


def wide_table(features: DataFrame, keys: list[str], key: str = "key", value: str = "value") -> DataFrame:
    """A row a subject and a column a key. One aggregate by subject: a pivot would shuffle a row as wide as all keys for each cell."""
    return features.groupBy("subject").agg(*[F.first(F.when(F.col(key) == k, F.col(value)), ignorenulls=True).alias(k) for k in keys])


def vectors(features: DataFrame, keys: list[str]) -> DataFrame:
    """subject, features: a vector a subject, in the order of keys; what a subject lacks is 0."""
    wide = wide_table(features, keys).fillna(0.0, keys)
    return VectorAssembler(inputCols=keys, outputCol="features").transform(wide).select("subject", "features")


def train_classifier(rows: DataFrame, train: DataFrame, kind: str = "logistic", seed: int = 7) -> DataFrame:
    """subject, p: probability of class 1 of every row (subject, features), from the training labels (subject, y)."""
    model = CLASSIFIERS[kind](seed).setLabelCol("label").fit(rows.join(train.select("subject", F.col("y").cast("double").alias("label")), "subject"))
    return model.transform(rows).select("subject", vector_to_array("probability")[1].alias("p"))


def train_regressor(rows: DataFrame, train: DataFrame, kind: str = "linear", seed: int = 7) -> DataFrame:
    """subject, p: prediction for every row, from the training targets (subject, y)."""
    model = REGRESSORS[kind](seed).setLabelCol("label").fit(rows.join(train.select("subject", F.col("y").cast("double").alias("label")), "subject"))
    return model.transform(rows).select("subject", F.col("prediction").alias("p"))


def oof_predictions(rows: DataFrame, folds: DataFrame, kind: str, k: int, seed: int = 7) -> DataFrame:
    """subject, p: each subject's probability by the model that was trained without its fold (subject, y, fold)."""
    rows, out = stored(rows), []
    for f in range(k):
        mine = rows.join(folds.where(F.col("fold") == f).select("subject"), "subject", "left_semi")
        said = train_classifier(rows, folds.where(F.col("fold") != f), kind, seed)
        out.append(said.join(mine.select("subject"), "subject", "left_semi"))
    return reduce(DataFrame.unionByName, out)


def stack(preds: DataFrame, train: DataFrame, models: list[str], kind: str = "logistic", k: int = 3) -> DataFrame:
    """subject, p: a meta-model on the base models' out-of-fold probabilities (subject, model, p), for the subjects that all of them predict.

    No subject is predicted by a meta-model that has seen its label: those of train (subject, y, and fold where it is there)
    are predicted by the one that was fitted on the other folds, all others by the one that was fitted on train. Without
    a fold, subjects of train are only learned from and the others predicted.
    """
    wide = preds.where(F.col("model").isin(models)).groupBy("subject").pivot("model", models).agg(F.first("p")).dropna()
    rows = VectorAssembler(inputCols=models, outputCol="features").transform(wide).select("subject", "features")
    others = train_classifier(rows, train, kind).join(train.select("subject"), "subject", "left_anti")
    return others.unionByName(oof_predictions(rows, train, kind, k)) if "fold" in train.columns else others


def fusion(sets: dict[str, tuple[DataFrame, list[str]]], folds: DataFrame, mode: str = "late", kind: str = "logistic", k: int = 3) -> DataFrame:
    """subject, p out of fold: 'early' joins the feature sets (table, keys) and trains one model; 'late' trains one a set and stacks their out-of-fold probabilities, the meta-model's predictions being out of fold too."""
    if mode == "early":
        named = [t.withColumn("key", F.concat(F.lit(f"{n}_"), "key")) for n, (t, _) in sets.items()]
        return oof_predictions(vectors(reduce(DataFrame.unionByName, named), [f"{n}_{key}" for n, (_, keys) in sets.items() for key in keys]), folds, kind, k)
    base = [oof_predictions(vectors(t, keys), folds, kind, k).withColumn("model", F.lit(n)) for n, (t, keys) in sets.items()]
    return stack(stored(reduce(DataFrame.unionByName, base)), folds, list(sets), kind, k)


def backward_elimination(rows: DataFrame, train: DataFrame, keys: list[str], keep: int, drop: int = 1) -> list[str]:
    """The keys that stay when, again and again, those of the least standardised weights in a logistic model go. One distributed fit a round."""
    left = list(keys)
    while len(left) > keep:
        some = VectorAssembler(inputCols=left, outputCol="features").transform(rows.fillna(0.0, left)).join(train.select("subject", F.col("y").cast("double").alias("label")), "subject")
        spread = rows.agg(*[F.stddev_pop(c).alias(c) for c in left]).first()
        weights = np.abs(LogisticRegression(regParam=0.01).fit(some).coefficients.toArray()) * [spread[c] or 0.0 for c in left]
        gone = set(np.argsort(weights, kind="stable")[: min(drop, len(left) - keep)].tolist())
        left = [c for i, c in enumerate(left) if i not in gone]
    return left


def ordered_clusters(df: DataFrame, column: str, k: int, fit_on: DataFrame | None = None, seed: int = 7) -> DataFrame:
    """df with `cluster`: the number, by value, of the nearest of k centres, fitted on fit_on; null where the value is."""
    points = VectorAssembler(inputCols=["x"], outputCol="features").transform((df if fit_on is None else fit_on).select(F.col(column).cast("double").alias("x")).dropna())
    centres = sorted(float(c[0]) for c in KMeans(k=k, seed=seed).fit(points).clusterCenters())
    # a value's number is the middles between neighbouring centres below it
    middles = [(a + b) / 2 for a, b in zip(centres, centres[1:])]
    return df.withColumn("cluster", F.when(F.col(column).isNotNull(), sum((F.when(F.col(column) > m, 1).otherwise(0) for m in middles), F.lit(0))))


#: Test rows whose distances to a block are held at once.
ASKED = 256


def _nearest(x: np.ndarray, v: np.ndarray, k: int, p: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of v, row of x and distance to the p of the k rows of x nearest to each row of v, equal distances in the order of x.

    For p = 2 a product of matrices says, within a bound on its rounding, which rows can be among them; all that can are
    compared by the plain sum.
    """
    k, every = min(k, len(x)), []
    squares, ours = (x * x).sum(1), (v * v).sum(1)
    for a in range(0, len(v), ASKED):
        w = v[a : a + ASKED]
        if p == 2 and np.isfinite(squares).all() and np.isfinite(ours).all():
            rough = squares + ours[a : a + ASKED, None] - 2 * (w @ x.T)
            slack = 1e-14 * (x.shape[1] + 8) * (squares.max() + ours[a : a + ASKED])
            bound = np.partition(rough, k - 1, axis=1)[:, k - 1] + 2 * slack
            i, j = np.nonzero(rough <= bound[:, None])
        else:
            i, j = np.divmod(np.arange(len(w) * len(x)), len(x))
        for part in np.array_split(np.arange(len(w)), 1 if p == 2 and len(i) <= 64 * k * len(w) else len(w)):
            low, high = np.searchsorted(i, [part[0], part[-1] + 1])
            ii, jj = i[low:high], j[low:high]
            d = (np.abs(x[jj] - w[ii]) ** p).sum(1)
            order = np.lexsort((jj, d, ii))
            place = np.arange(len(order)) - np.searchsorted(ii[order], ii[order])
            best = order[place < k]
            every.append((a + ii[best], jj[best], d[best]))
    return tuple(map(np.concatenate, zip(*every)))


def knn_predict(train: DataFrame, test: DataFrame, k: int = 5, p: float = 2.0, block: int = 4096) -> DataFrame:
    """id, y: mean target of the k nearest training rows by Minkowski distance; ties go to the lower training id.

    Training rows (id, v, y) are dealt into blocks of about `block` rows and so are test rows (id, v); each pair of
    blocks is one group, which yields its k best for each test row, and the k best of all blocks are an aggregate.
    """
    n_train, n_test = (max(1, -(-t.count() // block)) for t in (train, test))
    deal = lambda df, n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    a = train.select(deal(train, n_train).alias("a"), F.explode(F.sequence(F.lit(0), F.lit(n_test - 1))).alias("b"), F.lit(True).alias("known"), "id", "v", F.col("y").cast("double").alias("y"))
    b = test.select(F.explode(F.sequence(F.lit(0), F.lit(n_train - 1))).alias("a"), deal(test, n_test).alias("b"), F.lit(False).alias("known"), "id", "v", F.lit(None).cast("double").alias("y"))

    def nearest(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        seen, asked = group.filter(group["known"]).sort_by("id"), group.filter(pc.invert(group["known"]))
        kinds = pa.schema([("id", pa.int64()), ("d", pa.float64()), ("near", pa.int64()), ("y", pa.float64())])
        if not seen.num_rows or not asked.num_rows:
            return kinds.empty_table()
        x, v = (np.asarray(pc.list_flatten(t["v"]).to_numpy(), float).reshape(t.num_rows, -1) for t in (seen, asked))
        i, j, d = _nearest(x, v, k, p)
        return pa.table([asked["id"].take(pa.array(i)), pa.array(d), seen["id"].take(pa.array(j)), seen["y"].take(pa.array(j))], schema=kinds)

    found = a.unionByName(b).groupBy("a", "b").applyInArrow(nearest, "id long, d double, near long, y double")
    # each block gave k at most, so a test row's list is k times the blocks
    best = found.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "near", "y"))), 1, k).alias("s"))
    return best.select("id", (F.aggregate("s.y", F.lit(0.0), lambda t, y: t + y) / F.size("s")).alias("y"))
