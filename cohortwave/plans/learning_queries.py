"""Queries of trained models, clusters and the remaining selection operators. Models of the ML library are beyond SQL; tests hold them to accuracy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import r6
from ..operators import learning as L
from ..operators import selection as S
from ..operators import tuning as U
from ..sources import views as V
from .evaluation_queries import sql

KEYS = [f"f{k:02d}" for k in range(64)]
HALVES = {"low": KEYS[:32], "high": KEYS[32:]}


def _rows(s, d):
    return L.vectors(V.features(s, d), KEYS)


def _train(s, d):
    return V.target(s, d).where("subject % 10 < 6").select("subject", "y")


def _folds(s, d):
    return V.target(s, d).select("subject", "y", (F.col("subject") % 3).alias("fold"))


def _sets(s, d):
    return {n: (V.features(s, d).where(F.col("key").isin(keys)), keys) for n, keys in HALVES.items()}


def _p(df):
    return df.select("subject", r6("p", "p"))


def _knn(s, d):
    v = V.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), (F.col("label") >= 5).cast("double").alias("y"))
    return L.knn_predict(v.where("id % 10 < 8"), v.where("id % 10 >= 8").select("id", "v"), 5)


def _wide(s, d):
    return L.wide_table(V.features(s, d), KEYS)


def _dealt(s, d, y="y"):
    """Targets in four folds; the last is held out."""
    return V.target(s, d).select("subject", F.col(y).alias("y"), (F.col("subject") % 4).cast("int").alias("fold"))


def _eliminated(s, d):
    left, means = U.eliminate(_wide(s, d), _folds(s, d), KEYS, "logistic")
    rows = [("kept", k, None) for k in left] + [("score", str(n), float(v)) for n, v in means]
    return s.createDataFrame(rows, "what string, name string, score double")


QUERIES = {
    **{f"ml02_tuned_{kind}": ((lambda s, d, kind=kind: _p(U.held_out(_wide(s, d), _dealt(s, d), KEYS, kind, 3))), None) for kind in U.CLASSIFIERS},
    **{f"ml03_tuned_{kind}": ((lambda s, d, kind=kind: _p(U.held_out(_wide(s, d), _dealt(s, d, "label"), KEYS, kind, 3, regression=True))), None) for kind in U.REGRESSORS},
    "fs17_backward_elimination": (_eliminated, None),
    **{f"ml02_train_{kind}": ((lambda s, d, kind=kind: _p(L.train_classifier(_rows(s, d), _train(s, d), kind))), None) for kind in L.CLASSIFIERS},
    **{f"ml03_regress_{kind}": ((lambda s, d, kind=kind: _p(L.train_regressor(_rows(s, d), V.target(s, d).where("subject % 10 < 6").select("subject", F.col("label").alias("y")), kind))), None) for kind in L.REGRESSORS},
    "ml04_knn_predict": (
        lambda s, d: _knn(s, d).select("id", r6("y", "y")),
        "SELECT id, round(avg(y), 6) AS y FROM (SELECT t.vec_id AS id, (r.label >= 5)::INT AS y, row_number() OVER (PARTITION BY t.vec_id ORDER BY list_sum(list_transform(list_zip(t.e, r.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), r.vec_id) AS k FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 10 >= 8) t, (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 10 < 8) r) WHERE k <= 5 GROUP BY id",
    ),
    "ml07_oof_logistic": (lambda s, d: _p(L.oof_predictions(_rows(s, d), _folds(s, d), "logistic", 3)), None),
    "ml09_stack": (lambda s, d: _p(L.stack(V.predictions(s, d), V.predictions(s, d).where("model = 'id' AND subject % 10 < 6").select("subject", "y"), ["length", "toxic", "id"])), None),
    "ml10_fusion_late": (lambda s, d: _p(L.fusion(_sets(s, d), _folds(s, d), "late")), None),
    "ml10_fusion_early": (lambda s, d: _p(L.fusion(_sets(s, d), _folds(s, d), "early")), None),
    "cl01_ordered_clusters": (
        lambda s, d: L.ordered_clusters(V.clinical(s, d).select("row_id", "score"), "score", 4).groupBy("cluster").agg(F.count("*").alias("n"), r6(F.min("score"), "low"), r6(F.max("score"), "high")),
        None,
    ),
    "fs14_pair_mutual_info": (
        lambda s, d: S.pair_mutual_info_matrix(V.features(s, d), 8).select("a", "b", r6("mi", "mi")),
        sql(
            "SELECT a, b, round(sum(n / t * ln(n * t / (na * nb))), 6) + 0 AS mi FROM (SELECT *, sum(n) OVER (PARTITION BY a, b, u) AS na, sum(n) OVER (PARTITION BY a, b, v) AS nb, sum(n) OVER (PARTITION BY a, b) AS t FROM (SELECT l.key AS a, r.key AS b, l.bin AS u, r.bin AS v, count(*)::DOUBLE AS n FROM bi l JOIN bi r USING (subject) GROUP BY ALL)) GROUP BY a, b",
            "bi AS (SELECT subject, key, least(floor((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0) * 8), 7) AS bin FROM features WINDOW w AS (PARTITION BY key))",
            views=("features",),
        ),
    ),
}
