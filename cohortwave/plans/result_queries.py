"""Queries that compare, select and sum up models, and the remaining cohort operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import r6
from ..operators import cohort as C
from ..operators import evaluation as E
from ..operators import selection as S
from ..operators import series as T
from ..sources import views as V
from .evaluation_queries import PRED, rounded, sql

MODELS = ["length", "toxic", "id"]
_SCORES = "cf AS (SELECT model, sum((p >= 0.5 AND y = 1)::INT)::DOUBLE AS tp, sum((p < 0.5 AND y = 0)::INT)::DOUBLE AS tn, sum((p >= 0.5 AND y = 0)::INT)::DOUBLE AS fp, sum((p < 0.5 AND y = 1)::INT)::DOUBLE AS fn FROM predictions GROUP BY model), sc AS (SELECT model, coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS mcc, (tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2 AS balanced FROM cf)"
_BEST = "best AS (SELECT model FROM sc ORDER BY mcc DESC, model DESC LIMIT 1)"


def _midp_sql(best: str) -> str:
    """Counts and mid-p value of every model against `best`, a query or a literal."""
    counts = f"mc AS (SELECT a.model, sum((a.r AND NOT b.r)::INT)::BIGINT AS n10, sum((NOT a.r AND b.r)::INT)::BIGINT AS n01 FROM (SELECT *, (p >= 0.5)::INT = y AS r FROM predictions) a JOIN (SELECT subject, (p >= 0.5)::INT = y AS r FROM predictions WHERE model = {best}) b USING (subject) GROUP BY a.model)"
    log = "lgamma(n10 + n01 + 1) - lgamma(i + 1) - lgamma(n10 + n01 - i + 1) - (n10 + n01) * ln(2::DOUBLE)"
    return f"{counts}, mp AS (SELECT model, n10, n01, least(2 * sum(exp(l)) - max(exp(l)) FILTER (i = least(n10, n01)), 1) AS p FROM (SELECT *, {log} AS l FROM (SELECT *, unnest(range(least(n10, n01) + 1)) AS i FROM mc)) GROUP BY model, n10, n01)"


_TIES = "d AS (SELECT a.model, round(abs(a.p - a.y) - abs(b.p - b.y), 12) AS diff FROM predictions a JOIN predictions b ON a.subject = b.subject AND b.model = 'toxic' WHERE a.model <> 'toxic'), rk AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY model, abs(diff)) - 1) / 2.0::DOUBLE AS r FROM d WHERE diff <> 0), ti AS (SELECT model, sum(t ** 3 - t) AS ties FROM (SELECT model, abs(diff) AS s, count(*)::DOUBLE AS t FROM rk GROUP BY ALL) GROUP BY model), wx AS (SELECT model, least(coalesce(sum(r) FILTER (diff > 0), 0), coalesce(sum(r) FILTER (diff < 0), 0)) AS w, count(*)::DOUBLE AS n FROM rk GROUP BY model), zs AS (SELECT model, w, abs(w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) / sqrt(2::DOUBLE) AS x FROM wx JOIN ti USING (model)), te AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * x) AS t FROM zs)"


def _long(s, d):
    """Scores (model, split, name, score) of each fifth of the subjects."""
    p = V.predictions(s, d).withColumn("split", F.col("subject") % 5)
    g = p.groupBy("model", "split").agg(F.avg(F.abs(F.col("p") - F.col("y"))).alias("mae"), F.avg(((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("double")).alias("accuracy"))
    return g.unpivot(["model", "split"], ["mae", "accuracy"], "name", "score")


_LONG = "lg AS (SELECT model, subject % 5 AS split, avg(abs(p - y)) AS mae, avg(((p >= 0.5)::INT = y)::INT) AS accuracy FROM predictions GROUP BY ALL), ls AS (SELECT model, split, 'mae' AS name, mae AS score FROM lg UNION ALL SELECT model, split, 'accuracy', accuracy FROM lg)"


def _results(s, d):
    p = V.predictions(s, d)
    return E.binary_scores(p).select("model", "mcc", "balanced").join(E.midp(E.mcnemar_counts(p, "toxic")), "model")


def _logs(s, d):
    return V.clinical(s, d).groupBy("subject").agg(F.collect_list("row_id").alias("onsets"), F.collect_list("sparse_note").alias("descriptions"))


def _weights(s, d):
    x = V.samples(s, d).groupBy("state", "channel", F.col("subject").alias("model")).agg(F.avg("x").alias("m"))
    return x.select("model", "channel", F.col("state").alias("band"), (F.col("m") - 50).alias("w"))


QUERIES = {
    "ev09_mcnemar_midp": (
        lambda s, d: rounded(E.midp(E.mcnemar_counts(V.predictions(s, d), "toxic")), "p"),
        sql("SELECT model, n10, n01, round(p, 6) + 0 AS p FROM mp WHERE model <> 'toxic'", _midp_sql("'toxic'"), views=PRED),
    ),
    "ev10_select_models": (
        lambda s, d: rounded(E.select_models(V.predictions(s, d)), "mcc", "p"),
        sql("SELECT model, round(mcc, 6) + 0 AS mcc, round(p, 6) + 0 AS p FROM mp JOIN sc USING (model) WHERE p > 0.05", _SCORES, _BEST, _midp_sql("(SELECT model FROM best)"), views=PRED),
    ),
    "ev11_wilcoxon_signed": (
        lambda s, d: rounded(E.wilcoxon_signed(V.predictions(s, d), "toxic"), "w", "p"),
        sql("SELECT model, round(w, 6) AS w, round(least((0.254829592::DOUBLE * t - 0.284496736::DOUBLE * t ** 2 + 1.421413741::DOUBLE * t ** 3 - 1.453152027::DOUBLE * t ** 4 + 1.061405429::DOUBLE * t ** 5) * exp(-x * x), 1), 6) + 0 AS p FROM te", _TIES, views=PRED),
    ),
    "ev17_perturbation_summary": (
        lambda s, d: rounded(E.perturbation_summary(_long(s, d)), "mean", "std"),
        sql("SELECT model, name, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, count(*) AS n FROM ls GROUP BY ALL", _LONG, views=PRED),
    ),
    "ev20_metric_combinations": (
        lambda s, d: rounded(E.metric_combinations(_results(s, d), "mcc", "balanced", -1.0, "len"), "mean", "geometric"),
        sql("SELECT model, round((mcc + balanced) / 2, 6) + 0 AS mean, round(sqrt((1 + mcc) * (1 + balanced)) - 1, 6) + 0 AS geometric FROM sc WHERE model NOT IN ('toxic', 'length')", _SCORES, views=PRED),
    ),
    "ev21_weight_rollup": (
        lambda s, d: rounded(E.weight_rollup(_weights(s, d), V.samples(s, d).groupBy(F.col("subject").alias("model")).agg((1 / F.avg("x")).alias("meta"))), "weight"),
        sql(
            "SELECT channel, band, round(sum(abs(w) / total * meta), 6) AS weight FROM (SELECT *, sum(abs(w)) OVER (PARTITION BY model) AS total FROM wt) JOIN me USING (model) GROUP BY GROUPING SETS ((channel), (band), ())",
            "wt AS (SELECT subject AS model, channel, state AS band, avg(x) - 50 AS w FROM samples GROUP BY ALL)", "me AS (SELECT subject AS model, 1 / avg(x) AS meta FROM samples GROUP BY ALL)", views=("samples",),
        ),
    ),
    "ev22_results_table": (
        lambda s, d: rounded(E.results_table(_long(s, d).where("split = 0"), ["mae", "accuracy"]), "mae", "accuracy"),
        sql("SELECT model, round(mae, 6) AS mae, round(accuracy, 6) AS accuracy FROM lg WHERE split = 0", _LONG, views=PRED),
    ),
    "ml08_collect_base_predictions": (
        lambda s, d: rounded(E.collect_base_predictions(V.predictions(s, d).where("NOT (model = 'id' AND subject % 7 = 0)"), MODELS), *MODELS),
        sql("SELECT subject, round(max(p) FILTER (model = 'length'), 6) AS length, round(max(p) FILTER (model = 'toxic'), 6) AS toxic, round(max(p) FILTER (model = 'id'), 6) AS id FROM predictions WHERE subject % 7 <> 0 GROUP BY subject", views=PRED),
    ),
    "co25_log_consistency": (
        lambda s, d: C.log_consistency(_logs(s, d), "onsets", "descriptions").select("subject", F.size("onsets").cast("long").alias("n_onsets"), F.size("descriptions").cast("long").alias("n_descriptions")),
        sql("SELECT subject, count(*) AS n_onsets, count(sparse_note) AS n_descriptions FROM clinical GROUP BY subject HAVING count(*) <> count(sparse_note)", views=("clinical",)),
    ),
    "co27_regression_targets": (
        lambda s, d: rounded(C.regression_targets(V.annotations_wide(s, d).select("subject"), first=V.clinical(s, d).where("symptom = '1-URGENT'"), second=V.clinical(s, d).where("present = 1")), "first", "second"),
        sql("SELECT subject, round(coalesce(sum(score) FILTER (symptom = '1-URGENT'), 0), 6) AS first, round(coalesce(sum(score) FILTER (present = 1), 0), 6) AS second FROM annotations_wide LEFT JOIN clinical USING (subject) GROUP BY subject", views=("annotations_wide", "clinical")),
    ),
    "ts13_log_if": (
        lambda s, d: T.log_if(V.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", *[F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount")]), ["l_quantity", "l_extendedprice", "l_discount"], lambda x: x < 1e6, lambda x: x > 10).select("l_orderkey", "l_linenumber", *[r6(c, c) for c in ("l_quantity", "l_extendedprice", "l_discount")]),
        "SELECT l_orderkey, l_linenumber, round(ln(l_quantity::DOUBLE), 6) + 0 AS l_quantity, round(ln(l_extendedprice::DOUBLE), 6) + 0 AS l_extendedprice, round(l_discount::DOUBLE, 6) AS l_discount FROM lineitem",
    ),
    "fs16_feature_trace": (
        lambda s, d: S.feature_trace(V.features(s, d).where("value > 0").select(F.lit(1).alias("step"), "key").distinct().unionByName(V.features(s, d).groupBy("key").agg(F.max("value").alias("m")).where("m > 0.4").select(F.lit(2).alias("step"), "key"))),
        sql("SELECT key, CASE WHEN max(value) > 0.4 THEN 2 ELSE 1 END AS last_step, CASE WHEN max(value) > 0.4 THEN 2 ELSE 1 END::BIGINT AS n_steps FROM features GROUP BY key HAVING max(value) > 0", views=("features",)),
    ),
    "io07_join_prefixed": (
        lambda s, d: rounded(S.join_prefixed({n: V.features(s, d).where(w).groupBy("subject").agg(F.avg("value").alias("mean"), F.max("value").alias("max")) for n, w in (("ecg", "key < 'f10'"), ("eeg", "key >= 'f10' AND subject % 3 = 0"))}), "ecg_mean", "ecg_max", "eeg_mean", "eeg_max"),
        sql("SELECT subject, round(avg(value) FILTER (key < 'f10'), 6) AS ecg_mean, round(max(value) FILTER (key < 'f10'), 6) AS ecg_max, round(avg(value) FILTER (key >= 'f10'), 6) AS eeg_mean, round(max(value) FILTER (key >= 'f10'), 6) AS eeg_max FROM features WHERE subject % 3 = 0 GROUP BY subject", views=("features",)),
    ),
}
