"""Queries of the selection and evaluation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import r6
from ..operators import evaluation as E
from ..operators import models as M
from ..operators import selection as S
from ..sources import views as V
from ..sources.views import with_views

JOINED = "j AS (SELECT subject, key, value, y FROM features JOIN target USING (subject))"
PRED = ("predictions",)
FT = ("features", "target")
CURVE = "g AS (SELECT model, p, sum(y) AS pos, sum(1 - y) AS neg FROM predictions GROUP BY ALL), c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER m AS n1, sum(neg) OVER m AS n0 FROM g WINDOW w AS (PARTITION BY model ORDER BY p DESC), m AS (PARTITION BY model))"
P_TABLE = "pt AS (SELECT key, round(1 / (1 + 200 * abs(corr(value, y))), 9) AS p FROM j GROUP BY key)"


def sql(query: str, *ctes: str, views=FT) -> str:
    return ", ".join([with_views("", *views).rstrip(), *ctes]) + " " + query


def rounded(df, *cols):
    return df.withColumns({c: r6(c, c) for c in cols})


def _ft(s, d):
    return V.features(s, d), V.target(s, d).select("subject", "y")


def _p(s, d):
    return S.score_pearson(*_ft(s, d)).select("key", F.round(1 / (1 + 200 * F.col("score")), 9).alias("p"))


SCORES = ["accuracy", "precision", "recall", "specificity", "f1", "f2", "balanced", "mcc"]

QUERIES = {
    "fs01_drop_duplicate_constant": (lambda s, d: S.drop_duplicate_constant(V.features(s, d)), sql("SELECT key, count(DISTINCT value) AS n_unique FROM features GROUP BY key HAVING count(DISTINCT value) >= 2", views=("features",))),
    "fs02_null_report": (lambda s, d: S.null_report(V.features(s, d)), sql("SELECT key, sum((value IS NULL OR isnan(value))::INT)::BIGINT AS n_null, sum(isinf(value)::INT)::BIGINT AS n_inf FROM features GROUP BY key", views=("features",))),
    "fs03_variance_filter": (lambda s, d: rounded(S.variance_filter(V.features(s, d), 0.015), "variance"), sql("SELECT key, round(var_pop(value), 6) AS variance FROM features GROUP BY key HAVING var_pop(value) > 0.015", views=("features",))),
    "fs04_impute": (
        lambda s, d: rounded(S.impute(V.features(s, d).withColumn("value", F.when(F.col("subject") % 7 != 0, F.col("value")))), "value"),
        sql("SELECT subject, key, round(coalesce(value, median(value) OVER (PARTITION BY key)), 6) + 0 AS value FROM (SELECT subject, key, CASE WHEN subject % 7 <> 0 THEN value END AS value FROM features)", views=("features",)),
    ),
    "fs05_robust_scale": (
        lambda s, d: rounded(S.robust_scale(V.features(s, d), V.splits(s, d).where("split = 'train'")), "value"),
        sql("SELECT subject, key, round((value - m) / nullif(q3 - q1, 0), 6) + 0 AS value FROM features JOIN (SELECT key, median(value) AS m, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM features JOIN splits USING (subject) WHERE split = 'train' GROUP BY key) USING (key)", views=("features", "splits")),
    ),
    "fs06_score_pearson": (lambda s, d: rounded(S.score_pearson(*_ft(s, d)), "score"), sql("SELECT key, round(abs(corr(value, y)), 6) AS score FROM j GROUP BY key", JOINED)),
    "fs07_score_spearman": (
        lambda s, d: rounded(S.score_spearman(*_ft(s, d)), "score"),
        sql("SELECT key, round(abs(corr(rv, ry)), 6) AS score FROM (SELECT key, rank() OVER (PARTITION BY key ORDER BY value) + (count(*) OVER (PARTITION BY key, value) - 1) / 2.0 AS rv, rank() OVER (PARTITION BY key ORDER BY y) + (count(*) OVER (PARTITION BY key, y) - 1) / 2.0 AS ry FROM j) GROUP BY key", JOINED),
    ),
    "fs09_score_anova": (
        lambda s, d: rounded(S.score_anova(*_ft(s, d)), "score"),
        sql("SELECT key, round((sum(n * (m - gm) ** 2) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))), 6) AS score FROM (SELECT *, sum(n * m) OVER (PARTITION BY key) / sum(n) OVER (PARTITION BY key) AS gm FROM (SELECT key, y, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM j GROUP BY ALL)) GROUP BY key", JOINED),
    ),
    "fs11_score_multi": (
        lambda s, d: rounded(S.score_multi(V.features(s, d), V.target(s, d).select("subject", F.explode(F.array(F.struct(F.lit("a").alias("name"), F.col("label").cast("double").alias("y")), F.struct(F.lit("b").alias("name"), (F.col("label") % 3).cast("double").alias("y")))).alias("t")).select("subject", "t.*")), "avg_score", "max_score"),
        sql("SELECT key, round((a + b) / 2, 6) AS avg_score, round(greatest(a, b), 6) AS max_score FROM (SELECT key, abs(corr(value, label)) AS a, abs(corr(value, label % 3)) AS b FROM features JOIN target USING (subject) GROUP BY key)"),
    ),
    "fs12_select_threshold": (
        lambda s, d: rounded(S.select_threshold(S.score_pearson(*_ft(s, d)), 0.08, 5), "score"),
        sql("SELECT key, round(score, 6) AS score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, key) AS r FROM (SELECT key, abs(corr(value, y)) AS score FROM j GROUP BY key)) WHERE score > 0.08 OR r <= 5", JOINED),
    ),
    "fs13_pair_correlation": (lambda s, d: rounded(S.pair_correlation(V.features(s, d)), "r"), sql("SELECT a.key AS k1, b.key AS k2, round(abs(corr(a.value, b.value)), 6) AS r FROM features a JOIN features b ON a.subject = b.subject AND a.key < b.key GROUP BY ALL", views=("features",))),
    "fs18_bh_adjust": (
        lambda s, d: rounded(S.bh_adjust(_p(s, d)), "p", "q"),
        sql("SELECT key, round(p, 6) AS p, round(least(min(p * n / r) OVER (ORDER BY r DESC), 1), 6) AS q FROM (SELECT *, row_number() OVER (ORDER BY p, key) AS r, count(*) OVER () AS n FROM pt)", JOINED, P_TABLE),
    ),
    "fs19_gaussian_kl": (
        lambda s, d: rounded(S.gaussian_kl(*_ft(s, d)), "kl"),
        sql("SELECT key, round(ln(s0 / s1) + (s1 ** 2 + (m1 - m0) ** 2) / (2 * s0 ** 2) - 0.5, 6) AS kl FROM (SELECT key, avg(value) FILTER (y = 0) AS m0, avg(value) FILTER (y = 1) AS m1, stddev_pop(value) FILTER (y = 0) AS s0, stddev_pop(value) FILTER (y = 1) AS s1 FROM j GROUP BY key)", JOINED),
    ),
    "fa03_regional_features": (
        lambda s, d: rounded(S.regional_features(V.features(s, d), {"a": [f"f{i:02d}" for i in range(8)], "b": [f"f{i:02d}" for i in range(4, 20)]}), "mean", "std", "median", "sum", "max", "min"),
        sql("SELECT subject, roi, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(median(value), 6) AS median, round(sum(value), 6) AS sum, round(max(value), 6) AS max, round(min(value), 6) AS min FROM features JOIN (SELECT 'a' AS roi, 'f0' || i AS key FROM range(8) t(i) UNION ALL SELECT 'b', 'f' || lpad(i::VARCHAR, 2, '0') FROM range(4, 20) t(i)) USING (key) GROUP BY ALL", views=("features",)),
    ),
    "ml01_assign_folds": (
        lambda s, d: S.assign_folds(V.target(s, d).select("subject", "y"), "subject", "y", 5, "s1").withColumn("fold", F.col("fold").cast("long")),
        sql("SELECT subject, y, (row_number() OVER (PARTITION BY y ORDER BY md5('s1:' || subject), subject) - 1) % 5 AS fold FROM target", views=("target",)),
    ),
    "ev01_binary_scores": (
        lambda s, d: rounded(E.binary_scores(V.predictions(s, d)), *SCORES),
        sql("SELECT model, tp::BIGINT AS tp, tn::BIGINT AS tn, fp::BIGINT AS fp, fn::BIGINT AS fn, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(tn / nullif(tn + fp, 0), 6) AS specificity, round(2 * tp / nullif(2 * tp + fn + fp, 0), 6) AS f1, round(5 * tp / nullif(5 * tp + 4 * fn + fp, 0), 6) AS f2, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced, round((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 6) + 0 AS mcc FROM (SELECT model, sum((p >= 0.5 AND y = 1)::INT)::DOUBLE AS tp, sum((p < 0.5 AND y = 0)::INT)::DOUBLE AS tn, sum((p >= 0.5 AND y = 0)::INT)::DOUBLE AS fp, sum((p < 0.5 AND y = 1)::INT)::DOUBLE AS fn FROM predictions GROUP BY model)", views=PRED),
    ),
    "ev02_clip_probabilities": (lambda s, d: rounded(E.clip_probabilities(V.predictions(s, d).withColumn("p", 2 * F.col("p") - 0.5)), "p", "q"), sql("SELECT subject, y, model, round(2 * p - 0.5, 6) + 0 AS p, round(least(greatest(2 * p - 0.5, 0), 1), 6) AS q, (least(greatest(2 * p - 0.5, 0), 1) >= 0.5)::INT AS c FROM predictions", views=PRED)),
    "ev03_roc_auc": (
        lambda s, d: rounded(E.roc_auc(V.predictions(s, d)), "auc"),
        sql("SELECT model, round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) AS auc FROM (SELECT *, rank() OVER (PARTITION BY model ORDER BY p) + (count(*) OVER (PARTITION BY model, p) - 1) / 2.0 AS r FROM predictions) GROUP BY model", views=PRED),
    ),
    "ev04_roc_curve": (lambda s, d: rounded(E.roc_curve(V.predictions(s, d)), "p", "tpr", "fpr", "precision"), sql("SELECT model, round(p, 6) AS p, round(tp / n1, 6) AS tpr, round(fp / n0, 6) AS fpr, round(tp / (tp + fp), 6) AS precision FROM c", CURVE, views=PRED)),
    "ev05_auc_pr": (
        lambda s, d: rounded(E.auc_pr(V.predictions(s, d)), "auc_pr"),
        sql("SELECT model, round(sum((tpr - coalesce(t0, 0)) * (pr + coalesce(p0, 1)) / 2), 6) AS auc_pr FROM (SELECT *, lag(tpr) OVER w AS t0, lag(pr) OVER w AS p0 FROM (SELECT model, p, tp / n1 AS tpr, tp / (tp + fp) AS pr FROM c) WINDOW w AS (PARTITION BY model ORDER BY p DESC)) GROUP BY model", CURVE, views=PRED),
    ),
    "ev06_log_loss_brier": (
        lambda s, d: rounded(E.log_loss_brier(V.predictions(s, d)), "neg_log_loss", "neg_brier"),
        sql("SELECT model, round(avg(y * ln(q) + (1 - y) * ln(1 - q)), 6) AS neg_log_loss, round(-avg((p - y) ** 2), 6) AS neg_brier FROM (SELECT *, least(greatest(p, 1e-9::DOUBLE), 1 - 1e-9::DOUBLE) AS q FROM predictions) GROUP BY model", views=PRED),
    ),
    "ev07_confusion_members": (
        lambda s, d: E.confusion_members(V.predictions(s, d)),
        sql("SELECT subject, model, CASE WHEN p >= 0.5 AND y = 1 THEN 'tp' WHEN p >= 0.5 THEN 'fp' WHEN y = 1 THEN 'fn' ELSE 'tn' END AS cell, (p >= 0.5) = (y = 1) AS correct FROM predictions", views=PRED),
    ),
    "ev08_classification_report": (
        lambda s, d: rounded(E.classification_report(V.predictions(s, d)), "precision", "recall", "f1"),
        sql("SELECT model, k::INT AS class, sup::BIGINT AS support, round(hit / nullif(said, 0), 6) AS precision, round(hit / nullif(sup, 0), 6) AS recall, round(2 * hit / nullif(said + sup, 0), 6) AS f1 FROM (SELECT model, k, sum((c = k AND y = k)::INT)::DOUBLE AS hit, sum((c = k)::INT)::DOUBLE AS said, sum((y = k)::INT)::DOUBLE AS sup FROM (SELECT *, (p >= 0.5)::INT AS c FROM predictions), range(2) t(k) GROUP BY ALL)", views=PRED),
    ),
    "ev09_mcnemar_counts": (
        lambda s, d: E.mcnemar_counts(V.predictions(s, d), "toxic"),
        sql("SELECT a.model, sum((a.r AND NOT b.r)::INT)::BIGINT AS n10, sum((NOT a.r AND b.r)::INT)::BIGINT AS n01 FROM (SELECT *, (p >= 0.5)::INT = y AS r FROM predictions) a JOIN (SELECT subject, (p >= 0.5)::INT = y AS r FROM predictions WHERE model = 'toxic') b USING (subject) WHERE a.model <> 'toxic' GROUP BY a.model", views=PRED),
    ),
    "ev13_regression_scores": (
        lambda s, d: rounded(E.regression_scores(V.predictions(s, d)), "pearson", "rmse", "mae", "medae", "r2"),
        sql("SELECT model, round(abs(corr(p, y)), 6) AS pearson, round(sqrt(avg((p - y) ** 2)), 6) AS rmse, round(avg(abs(p - y)), 6) AS mae, round(median(abs(p - y)), 6) AS medae, round(1 - sum((p - y) ** 2) / (count(*) * var_pop(y)), 6) AS r2 FROM predictions GROUP BY model", views=PRED),
    ),
    "ev14_rank_rmse": (
        lambda s, d: rounded(E.rank_rmse(V.predictions(s, d)), "rank_rmse"),
        sql("SELECT model, round(sqrt(avg((rp - ry) ** 2)), 6) AS rank_rmse FROM (SELECT model, rank() OVER (PARTITION BY model ORDER BY p) + (count(*) OVER (PARTITION BY model, p) - 1) / 2.0 AS rp, rank() OVER (PARTITION BY model ORDER BY y) + (count(*) OVER (PARTITION BY model, y) - 1) / 2.0 AS ry FROM predictions) GROUP BY model", views=PRED),
    ),
    "ev18_mann_whitney": (
        lambda s, d: rounded(E.mann_whitney(V.predictions(s, d)), "u", "z"),
        sql("SELECT model, u, round((u - n1 * n0 / 2) / sqrt(n1 * n0 * (n1 + n0 + 1) / 12), 6) AS z FROM (SELECT model, sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE AS u, sum(y)::DOUBLE AS n1, sum(1 - y)::DOUBLE AS n0 FROM (SELECT *, rank() OVER (PARTITION BY model ORDER BY p) + (count(*) OVER (PARTITION BY model, p) - 1) / 2.0::DOUBLE AS r FROM predictions) GROUP BY model)", views=PRED),
    ),
    "ev19_chi2_table": (
        lambda s, d: rounded(E.chi2_table(V.table(s, d, "labels"), "quality", "toxic"), "chi2"),
        "WITH n AS (SELECT q.quality, t.toxic, (SELECT count(*) FROM labels l WHERE l.quality = q.quality AND l.toxic = t.toxic) AS n FROM (SELECT DISTINCT quality FROM labels) q, (SELECT DISTINCT toxic FROM labels) t), e AS (SELECT n, sum(n) OVER (PARTITION BY quality) * sum(n) OVER (PARTITION BY toxic) / sum(n) OVER () AS e FROM n) SELECT round(sum(greatest(abs(n - e) - 0.5, 0) ** 2 / e), 6) AS chi2, 1::BIGINT AS dof FROM e",
    ),
    "fs10_score_mutual_info": (
        lambda s, d: rounded(S.score_mutual_info(*_ft(s, d)), "score"),
        sql("SELECT key, round(sum(n / t * ln(n * t / (nb * ny))), 6) AS score FROM (SELECT *, sum(n) OVER (PARTITION BY key, bin) AS nb, sum(n) OVER (PARTITION BY key, y) AS ny, sum(n) OVER (PARTITION BY key) AS t FROM (SELECT key, bin, y, count(*)::DOUBLE AS n FROM (SELECT key, y, least(floor((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) * 10), 9) AS bin FROM j WINDOW w AS (PARTITION BY key)) GROUP BY ALL)) GROUP BY key", JOINED),
    ),
    "fs02_drop_odd_columns": (
        lambda s, d: S.drop_odd_columns(V.features(s, d).withColumn("value", F.when((F.col("subject") % 7 != 0) | (F.col("key") > "f20"), F.col("value")))).select("subject", "key", F.round("value", 6).alias("value")),
        sql("SELECT subject, key, round(value, 6) AS value FROM features WHERE key > 'f20'", views=("features",)),
    ),
    "fs02_drop_odd_rows": (
        lambda s, d: S.drop_odd_rows(V.features(s, d).withColumn("value", F.when((F.col("subject") % 7 != 0) | (F.col("key") > "f20"), F.col("value")))).select("subject", "key", F.round("value", 6).alias("value")),
        sql("SELECT subject, key, round(value, 6) AS value FROM features WHERE subject % 7 <> 0", views=("features",)),
    ),
    "fs08_score_kendall": (
        lambda s, d: rounded(S.score_kendall(*_ft(s, d)), "score"),
        sql("SELECT key, round(abs(sum(sign(a.value - b.value) * sign(a.y - b.y)) / sqrt(sum((a.value <> b.value)::INT)::DOUBLE * sum((a.y <> b.y)::INT))), 6) AS score FROM j a JOIN j b USING (key) WHERE a.subject < b.subject GROUP BY key", JOINED),
    ),
    "fa02_join_feature_sets": (
        lambda s, d: S.join_feature_sets({"a": V.features(s, d).where("subject % 3 <> 0 AND key < 'f10'"), "b": V.features(s, d).where("subject % 5 <> 0 AND key >= 'f60'")}).select("set", "subject", "key", F.round("value", 6).alias("value")),
        sql("SELECT CASE WHEN key < 'f10' THEN 'a' ELSE 'b' END AS set, subject, key, round(value, 6) AS value FROM features WHERE subject % 3 <> 0 AND subject % 5 <> 0 AND (key < 'f10' OR key >= 'f60')", views=("features",)),
    ),
    "fa04_drop_duplicate_named": (
        lambda s, d: S.drop_duplicate_named(V.features(s, d).unionByName(V.features(s, d).withColumn("value", F.when(F.col("key") < "f05", F.col("value") + 1).otherwise(F.col("value"))))).select("subject", "key", F.round("value", 6).alias("value")),
        sql("SELECT subject, key, round(value, 6) AS value FROM features UNION ALL SELECT subject, key, round(value + 1, 6) FROM features WHERE key < 'f05'", views=("features",)),
    ),
    "fa05_split_by_token": (
        lambda s, d: S.split_by_token(V.features(s, d), ["f1", "f2"]).select("subject", "key", "token"),
        sql("SELECT subject, key, CASE WHEN contains(key, 'f1') THEN 'f1' WHEN contains(key, 'f2') THEN 'f2' END AS token FROM features", views=("features",)),
    ),
    "ml05_naive_mean": (
        lambda s, d: rounded(M.naive_mean(V.target(s, d).where("subject % 10 < 6").select("subject", F.lit("label").alias("name"), F.col("label").cast("double").alias("y")), V.target(s, d).where("subject % 10 >= 6").select("subject", F.lit("label").alias("name"))), "p"),
        sql("SELECT subject, 'label' AS name, round((SELECT avg(label) FROM target WHERE subject % 10 < 6), 6) AS p FROM target WHERE subject % 10 >= 6", views=("target",)),
    ),
    "ml06_gaussian_nb": (
        lambda s, d: rounded(M.gaussian_nb(V.features(s, d), V.target(s, d).where("subject % 10 < 6").select("subject", "y")), "p"),
        sql("SELECT subject, round(1 / (1 + exp(-(sum(CASE WHEN y = 1 THEN t ELSE -t END) + (SELECT ln(sum(y) / sum(1 - y)) FROM target WHERE subject % 10 < 6)))), 6) AS p FROM (SELECT features.subject, g.y, -0.5 * (ln(2 * pi() * v) + (value - m) ** 2 / v) AS t FROM features JOIN g USING (key)) GROUP BY subject", JOINED, "w AS (SELECT max(v) AS most FROM (SELECT var_pop(value) AS v FROM j WHERE subject % 10 < 6 GROUP BY key))", "g AS (SELECT key, y, avg(value) AS m, var_pop(value) + 1e-9 * (SELECT most FROM w) AS v FROM j WHERE subject % 10 < 6 GROUP BY key, y)"),
    ),
    "ml07_oof_gaussian_nb": (
        lambda s, d: rounded(M.oof_gaussian_nb(V.features(s, d), V.target(s, d).select("subject", "y", (F.col("subject") % 5).alias("fold"))), "p"),
        sql("SELECT a.subject, round(1 / (1 + exp(-(sum(CASE WHEN g.y = 1 THEN t ELSE -t END) + max(pr)))), 6) AS p FROM (SELECT features.subject, g.y, g.fold, -0.5 * (ln(2 * pi() * v) + (value - m) ** 2 / v) AS t FROM features JOIN g ON features.key = g.key AND features.subject % 5 = g.fold) a JOIN (SELECT 1 AS y) x ON true JOIN (SELECT fold, ln(sum(y) / sum(1 - y)) AS pr FROM target JOIN range(5) r(fold) ON subject % 5 <> fold GROUP BY fold) q ON a.fold = q.fold GROUP BY a.subject".replace("CASE WHEN g.y = 1", "CASE WHEN a.y = 1"), JOINED, "g AS (SELECT fold, key, y, avg(value) AS m, greatest(avg(value * value) - avg(value) ** 2, 1e-12) AS v FROM j JOIN range(5) r(fold) ON subject % 5 <> fold GROUP BY ALL)"),
    ),
    "fa06_odd_cells": (
        lambda s, d: S.odd_cells(V.features(s, d).withColumn("value", F.when(F.col("subject") % 11 == 0, float("inf")).when(F.col("subject") % 7 != 0, F.col("value")))),
        sql("SELECT subject, key, CASE WHEN subject % 11 = 0 THEN 'inf' ELSE 'null' END AS kind FROM features WHERE subject % 11 = 0 OR subject % 7 = 0", views=("features",)),
    ),
    "fa07_sample_subjects": (
        lambda s, d: S.sample_subjects(V.features(s, d), 50, 7).select("subject", "key", F.round("value", 6).alias("value")),
        sql("SELECT subject, key, round(value, 6) AS value FROM features WHERE subject IN (SELECT subject FROM (SELECT DISTINCT subject FROM features) ORDER BY md5('7:' || subject) LIMIT 50)", views=("features",)),
    ),
    "ev15_normalize_predictions": (
        lambda s, d: rounded(E.normalize_predictions(V.predictions(s, d)), "y", "p"),
        sql("SELECT subject, model, round((y - avg(y) OVER w) / nullif(stddev_pop(y) OVER w, 0), 6) + 0 AS y, round((p - avg(p) OVER w) / nullif(stddev_pop(p) OVER w, 0), 6) + 0 AS p FROM predictions WINDOW w AS (PARTITION BY model)", views=PRED),
    ),
    "ev23_pooled_cv": (
        lambda s, d: rounded(E.pooled_cv(V.predictions(s, d).groupBy("model", (F.col("subject") % 5).alias("fold")).agg(F.avg(F.abs(F.col("y") - F.col("p"))).alias("score"), F.stddev_pop(F.abs(F.col("y") - F.col("p"))).alias("sd"))), "score", "sd"),
        sql("SELECT model, round(avg(score), 6) AS score, round(sqrt(sum(sd * sd)), 6) AS sd FROM (SELECT model, subject % 5 AS fold, avg(abs(y - p)) AS score, stddev_pop(abs(y - p)) AS sd FROM predictions GROUP BY ALL) GROUP BY model", views=PRED),
    ),
}
