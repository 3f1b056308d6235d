"""Scores and tests of predictions (subject, y, model, p)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import corr, with_ranks


def binary_scores(preds: DataFrame, cut: float = 0.5) -> DataFrame:
    """Confusion counts and the scores that follow from them, null where undefined; one aggregate."""
    c, y = F.col("p") >= cut, F.col("y") == 1
    g = preds.groupBy("model").agg(*[F.sum(t.cast("long")).alias(n) for n, t in (("tp", c & y), ("tn", ~c & ~y), ("fp", c & ~y), ("fn", ~c & y))])
    tp, tn, fp, fn = (F.col(n).cast("double") for n in ("tp", "tn", "fp", "fn"))
    precision, recall, spec = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    f = lambda b: F.try_divide((1 + b * b) * tp, (1 + b * b) * tp + b * b * fn + fp)
    mcc = F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    return g.select("model", "tp", "tn", "fp", "fn", ((tp + tn) / (tp + tn + fp + fn)).alias("accuracy"), precision.alias("precision"), recall.alias("recall"), spec.alias("specificity"), f(1).alias("f1"), f(2).alias("f2"), ((recall + spec) / 2).alias("balanced"), mcc.alias("mcc"))


def clip_probabilities(preds: DataFrame) -> DataFrame:
    q = F.least(F.greatest("p", F.lit(0.0)), F.lit(1.0))
    return preds.withColumn("q", q).withColumn("c", (F.col("q") >= 0.5).cast("int"))


def thresholds(preds: DataFrame) -> DataFrame:
    """Positives and negatives at and above each distinct probability. Counts come first, so the window sees a row a value."""
    g = preds.groupBy("model", "p").agg(F.sum("y").cast("long").alias("pos"), F.sum(1 - F.col("y")).cast("long").alias("neg"))
    down = Window.partitionBy("model").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy("model")
    return g.withColumns({"tp": F.sum("pos").over(down), "fp": F.sum("neg").over(down), "n1": F.sum("pos").over(everything), "n0": F.sum("neg").over(everything)})


def roc_auc(preds: DataFrame) -> DataFrame:
    """Area under the ROC curve; ties count half."""
    t = thresholds(preds)
    return t.groupBy("model").agg(F.try_divide(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)), F.first("n1") * F.first("n0")).alias("auc"))


def roc_curve(preds: DataFrame) -> DataFrame:
    return thresholds(preds).select("model", "p", F.try_divide("tp", "n1").alias("tpr"), F.try_divide("fp", "n0").alias("fpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def auc_pr(preds: DataFrame) -> DataFrame:
    """Trapezoid area under precision against recall, from recall 0 with precision 1."""
    c = roc_curve(preds)
    w = Window.partitionBy("model").orderBy(F.desc("p"))
    area = (F.col("tpr") - F.coalesce(F.lag("tpr").over(w), F.lit(0.0))) * (F.col("precision") + F.coalesce(F.lag("precision").over(w), F.lit(1.0))) / 2
    return c.withColumn("a", area).groupBy("model").agg(F.sum("a").alias("auc_pr"))


def log_loss_brier(preds: DataFrame, eps: float = 1e-9) -> DataFrame:
    q = F.least(F.greatest("p", F.lit(eps)), F.lit(1 - eps))
    return preds.groupBy("model").agg(F.avg(F.col("y") * F.ln(q) + (1 - F.col("y")) * F.ln(1 - q)).alias("neg_log_loss"), (-F.avg((F.col("p") - F.col("y")) ** 2)).alias("neg_brier"))


def confusion_members(preds: DataFrame) -> DataFrame:
    """subject, model, cell, correct of every prediction: a row a member, since a cell has as many as there are subjects."""
    c = F.col("p") >= 0.5
    cell = F.when(c & (F.col("y") == 1), "tp").when(c, "fp").when(F.col("y") == 1, "fn").otherwise("tn")
    return preds.select("subject", "model", cell.alias("cell"), cell.isin("tp", "tn").alias("correct"))


def confusion_counts(preds: DataFrame) -> DataFrame:
    """Size, least and greatest member of each cell."""
    return confusion_members(preds).groupBy("model", "cell").agg(F.count("*").alias("n"), F.min("subject").alias("first_id"), F.max("subject").alias("last_id"))


def rank_rmse(preds: DataFrame) -> DataFrame:
    x = with_ranks(with_ranks(preds, ["model"], "p", "rp"), ["model"], "y", "ry")
    return x.groupBy("model").agg(F.sqrt(F.avg((F.col("rp") - F.col("ry")) ** 2)).alias("rank_rmse"))


def regression_scores(preds: DataFrame) -> DataFrame:
    e = F.col("p") - F.col("y")
    g = preds.groupBy("model").agg(F.abs(corr("p", "y")).alias("pearson"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.percentile(F.abs(e), F.lit(0.5)).alias("medae"), (1 - F.try_divide(F.sum(e * e), F.count("*") * F.var_pop("y"))).alias("r2"))
    return g


REGRESSION = ("pearson", "spearman", "rmse", "mae", "medae", "r2", "mape", "rank_rmse")


def target_scores(preds: DataFrame) -> DataFrame:
    """model, target and the REGRESSION scores of each target (subject, model, target, y, p): correlations without sign, mape in percent; null where undefined. Rows with a null on either side are left out."""
    by = ["model", "target"]
    known = preds.where(F.col("y").isNotNull() & F.col("p").isNotNull()).withColumns({"y": F.col("y").cast("double"), "p": F.col("p").cast("double")})
    x = with_ranks(with_ranks(known, by, "p", "rp"), by, "y", "ry")
    e, r = F.col("p") - F.col("y"), F.col("rp") - F.col("ry")
    return x.groupBy(*by).agg(
        F.abs(corr("p", "y")).alias("pearson"), F.abs(corr("rp", "ry")).alias("spearman"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.percentile(F.abs(e), F.lit(0.5)).alias("medae"),
        (1 - F.try_divide(F.sum(e * e), F.count("*") * F.var_pop("y"))).alias("r2"), (100 * F.avg(F.try_divide(F.abs(e), F.abs("y")))).alias("mape"), F.sqrt(F.avg(r * r)).alias("rank_rmse"),
    )


def regression_summary(scores: DataFrame, how: str = "avg") -> DataFrame:
    """The scores of each model over its targets: 'avg', 'max', 'min' or 'median'. Averages of rmse and rank_rmse are roots of the mean square; a score that no target has is 100 for errors and -100 for correlations and r2."""
    f = {"avg": F.avg, "max": F.max, "min": F.min, "median": lambda c: F.percentile(c, F.lit(0.5))}[how]
    one = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c))) if how == "avg" and c in ("rmse", "rank_rmse") else f(F.col(c))
    worst = {c: -100.0 if c in ("pearson", "spearman", "r2") else 100.0 for c in REGRESSION}
    return scores.groupBy("model").agg(F.count("*").alias("n_targets"), *[F.coalesce(one(c), F.lit(worst[c])).alias(c) for c in REGRESSION])


def stacked_scores(preds: DataFrame) -> DataFrame:
    """The scores of each model over all targets' rows together."""
    return target_scores(preds.withColumn("target", F.lit("all"))).drop("target")


def mann_whitney(preds: DataFrame) -> DataFrame:
    """U of the positives' probabilities and its normal z without tie correction."""
    x = with_ranks(preds, ["model"], "p", "r")
    g = x.groupBy("model").agg(F.sum(F.when(F.col("y") == 1, F.col("r"))).alias("s"), F.sum("y").cast("double").alias("n1"), F.sum(1 - F.col("y")).cast("double").alias("n0"))
    u = F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2
    return g.select("model", u.alias("u"), F.try_divide(u - F.col("n1") * F.col("n0") / 2, F.sqrt(F.col("n1") * F.col("n0") * (F.col("n1") + F.col("n0") + 1) / 12)).alias("z"))


def mcnemar_counts(preds: DataFrame, best: str) -> DataFrame:
    """Subjects that one of a model and the best gets right, from each subject's own models: no self join."""
    right = ((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("int")
    x = preds.withColumn("right", right).withColumn("b", F.max(F.when(F.col("model") == best, F.col("right"))).over(Window.partitionBy("subject")))
    return x.where(F.col("model") != best).groupBy("model").agg(F.sum(((F.col("right") == 1) & (F.col("b") == 0)).cast("long")).alias("n10"), F.sum(((F.col("right") == 0) & (F.col("b") == 1)).cast("long")).alias("n01"))


def chi2_table(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-square of a contingency table with Yates' correction for 2 x 2, and its degrees of freedom."""
    n = df.groupBy(a, b).agg(F.count("*").alias("n"))
    grid = n.select(a).distinct().crossJoin(n.select(b).distinct()).join(n, [a, b], "left").fillna({"n": 0})
    t = grid.withColumns({"ra": F.sum("n").over(Window.partitionBy(a)), "rb": F.sum("n").over(Window.partitionBy(b)), "t": F.sum("n").over(Window.partitionBy())})
    e = F.col("ra") * F.col("rb") / F.col("t")
    s = t.agg(F.countDistinct(a).alias("ka"), F.countDistinct(b).alias("kb"), F.sum((F.col("n") - e) ** 2 / e).alias("plain"), F.sum(F.greatest(F.abs(F.col("n") - e) - 0.5, F.lit(0.0)) ** 2 / e).alias("yates"))
    dof = (F.col("ka") - 1) * (F.col("kb") - 1)
    return s.select(F.when(dof == 1, F.col("yates")).otherwise(F.col("plain")).alias("chi2"), dof.alias("dof"))


def classification_report(preds: DataFrame) -> DataFrame:
    """Support, precision, recall and F1 of each class for each model."""
    x = preds.withColumn("c", (F.col("p") >= 0.5).cast("int"))
    pairs = x.select("model", F.explode(F.array(F.lit(0), F.lit(1))).alias("class"), "c", "y")
    g = pairs.groupBy("model", "class").agg(*[F.sum(t.cast("double")).alias(n) for n, t in (("hit", (F.col("c") == F.col("class")) & (F.col("y") == F.col("class"))), ("said", F.col("c") == F.col("class")), ("support", F.col("y") == F.col("class")))])
    return g.select("model", "class", F.col("support").cast("long").alias("support"), F.try_divide("hit", "said").alias("precision"), F.try_divide("hit", "support").alias("recall"), F.try_divide(2 * F.col("hit"), F.col("said") + F.col("support")).alias("f1"))


def group_reports(preds: DataFrame, by: str) -> DataFrame:
    """Support, precision, recall and F1 of each class for each model, over all rows (group null, overall true) and in each group of `by`, in one pass."""
    x = preds.withColumn("c", (F.col("p") >= 0.5).cast("int"))
    sets = F.explode(F.array(F.struct(F.lit(True).alias("overall"), F.lit(None).cast("string").alias("g")), F.struct(F.lit(False).alias("overall"), F.col(by).cast("string").alias("g")))).alias("s")
    pairs = x.select("model", sets, "c", "y").select("model", F.col("s.overall").alias("overall"), F.col("s.g").alias("group"), F.explode(F.array(F.lit(0), F.lit(1))).alias("class"), "c", "y")
    hit, said, support = (F.sum(t.cast("double")) for t in ((F.col("c") == F.col("class")) & (F.col("y") == F.col("class")), F.col("c") == F.col("class"), F.col("y") == F.col("class")))
    g = pairs.groupBy("model", "overall", "group", "class").agg(hit.alias("hit"), said.alias("said"), support.alias("support"))
    return g.select("model", "overall", "group", "class", F.col("support").cast("long").alias("support"), F.try_divide("hit", "said").alias("precision"), F.try_divide("hit", "support").alias("recall"), F.try_divide(2 * F.col("hit"), F.col("said") + F.col("support")).alias("f1"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n, expected: counts of each pair of values and what the margins would give, pairs that don't occur included. a and b are categories: their values are one array each, exploded."""
    n = df.groupBy(a, b).agg(F.count("*").alias("n"))
    values = n.agg(F.array_sort(F.collect_set(a)).alias("va"), F.array_sort(F.collect_set(b)).alias("vb"), F.sum("n").alias("t"))
    grid = values.select(F.explode("va").alias(a), "vb", "t").select(F.explode("vb").alias(b), a, "t")
    full = grid.join(n, [a, b], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    margin = lambda c: F.sum("n").over(Window.partitionBy(c))
    return full.select(a, b, "n", (margin(a) * margin(b) / F.col("t")).alias("expected"))


def split_scores(scores: DataFrame) -> DataFrame:
    """model, fold, score, sd, pooled_score, pooled_sd: every split's score beside those of pooled_cv."""
    return scores.select("model", "fold", "score", "sd").join(pooled_cv(scores).select("model", F.col("score").alias("pooled_score"), F.col("sd").alias("pooled_sd")), "model")


def normalize_predictions(preds: DataFrame) -> DataFrame:
    """Truth and prediction standardised by each model's mean and population deviation; null where that is 0."""
    by = preds.groupBy("model").agg(*[f(c).alias(f"{c}_{n}") for c in ("y", "p") for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    scaled = {c: F.try_divide(F.col(c) - F.col(f"{c}_m"), F.col(f"{c}_s")) for c in ("y", "p")}
    return preds.join(by, "model").select("subject", "model", *[e.alias(c) for c, e in scaled.items()])


def pooled_cv(scores: DataFrame) -> DataFrame:
    """Mean of the folds' scores (model, fold, score, sd) and the root of their summed squared deviations."""
    return scores.groupBy("model").agg(F.avg("score").alias("score"), F.sqrt(F.sum(F.col("sd") * F.col("sd"))).alias("sd"))


def midp(counts: DataFrame) -> DataFrame:
    """counts with p: McNemar's mid-p value, twice the binomial tail up to the lesser count less that count's own probability."""
    n, k = F.col("n10") + F.col("n01"), F.least("n10", "n01")
    zero = F.struct((-n * F.ln(F.lit(2.0))).alias("l"), F.exp(-n * F.ln(F.lit(2.0))).alias("s"))

    def term(a, i):
        l = a["l"] + F.ln(n - i + 1) - F.ln(i)  # noqa: E741
        return F.struct(l.alias("l"), (a["s"] + F.exp(l)).alias("s"))

    tail = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), zero, term)
    return counts.withColumn("_t", tail).withColumn("p", F.least(2 * F.col("_t.s") - F.exp("_t.l"), F.lit(1.0))).drop("_t")


def select_models(preds: DataFrame, alpha: float = 0.05, cut: float = 0.5) -> DataFrame:
    """model, mcc, p: the best model by MCC (of equals the last by name), and those whose mid-p value against it is above alpha."""
    scores = binary_scores(preds, cut).select("model", F.coalesce("mcc", F.lit(0.0)).alias("mcc"))
    best = scores.agg(F.max(F.struct("mcc", "model"))["model"].alias("best"))
    right = preds.withColumn("right", ((F.col("p") >= cut).cast("int") == F.col("y")).cast("int")).join(F.broadcast(best))
    right = right.withColumn("b", F.max(F.when(F.col("model") == F.col("best"), F.col("right"))).over(Window.partitionBy("subject")))
    g = right.groupBy("model").agg(F.sum(((F.col("right") == 1) & (F.col("b") == 0)).cast("long")).alias("n10"), F.sum(((F.col("right") == 0) & (F.col("b") == 1)).cast("long")).alias("n01"))
    return scores.join(midp(g), "model").where(F.col("p") > alpha).select("model", "mcc", "p")


def perturbation_splits(preds: DataFrame, n: int = 10, share: float = 0.8, seed: str = "0", cut: float = 0.5, alpha: float = 0.05) -> DataFrame:
    """split, model, best, ival_mcc, p, holdout_mcc: n seeded splits of the subjects, of which `share` (rounded down) choose models and the rest score them.

    In each split the best model by MCC on the chosen subjects (of equals the last by name) is taken, and those whose
    mid-p value against it is above alpha with it. All splits go through one pass: a subject's side follows from the
    rank of a digest of seed, split and subject, numbered within buckets of the digest; counts are grouped by
    split, side and model. A score that is undefined counts as 0 among the chosen and stays null on the other side.
    """
    subjects = preds.select("subject").distinct()
    rows = subjects.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), F.col("split").cast("string"), F.col("subject").cast("string"))))
    rows = rows.withColumn("b", F.substring("h", 1, 3))
    lower = Window.partitionBy("split").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("split", "b").agg(F.count("*").alias("m")).select("split", "b", F.coalesce(F.sum("m").over(lower), F.lit(0)).alias("start"), F.sum("m").over(Window.partitionBy("split")).alias("all"))
    place = F.row_number().over(Window.partitionBy("split", "b").orderBy("h", "subject"))
    side = rows.withColumn("place", place).join(starts, ["split", "b"]).select("subject", "split", (F.col("start") + F.col("place") <= F.floor(F.lit(share) * F.col("all") + 1e-9)).alias("ival"))
    x = preds.select("subject", "model", "y", F.coalesce(F.col("p") >= cut, F.lit(False)).alias("c")).join(side, "subject")
    y, c = F.col("y") == 1, F.col("c")
    g = x.groupBy("split", "ival", "model").agg(*[F.sum(t.cast("long")).cast("double").alias(k) for k, t in (("tp", c & y), ("tn", ~c & ~y), ("fp", c & ~y), ("fn", ~c & y))])
    tp, tn, fp, fn = map(F.col, ("tp", "tn", "fp", "fn"))
    scores = g.select("split", "ival", "model", F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"))
    chosen = scores.where("ival").select("split", "model", F.coalesce("mcc", F.lit(0.0)).alias("ival_mcc"))
    best = chosen.groupBy("split").agg(F.max(F.struct("ival_mcc", "model"))["model"].alias("best"))
    right = x.where("ival").select("split", "subject", "model", (c == y).alias("right")).join(best, "split")
    right = right.withColumn("b", F.max(F.when(F.col("model") == F.col("best"), F.col("right"))).over(Window.partitionBy("split", "subject")))
    against = right.groupBy("split", "best", "model").agg(F.sum((F.col("right") & ~F.col("b")).cast("long")).alias("n10"), F.sum((~F.col("right") & F.col("b")).cast("long")).alias("n01"))
    kept = midp(against).where(F.col("p") > alpha).join(chosen, ["split", "model"])
    return kept.join(scores.where("NOT ival").select("split", "model", F.col("mcc").alias("holdout_mcc")), ["split", "model"], "left").select("split", "model", "best", "ival_mcc", "p", "holdout_mcc")


#: Abramowitz and Stegun, formula 7.1.26.
ERF_P, ERF_A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def two_sided_p(z):
    """Two-sided tail of the standard normal, to 1.5e-7."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + ERF_P * x)
    return F.least(sum((a * F.pow(t, F.lit(float(k + 1))) for k, a in enumerate(ERF_A)), F.lit(0.0)) * F.exp(-x * x), F.lit(1.0))


def wilcoxon_signed(preds: DataFrame, best: str) -> DataFrame:
    """model, w, p: signed-rank statistic of each model's absolute errors against the best one's, with tie correction; equal errors give 1."""
    err = F.abs(F.col("p") - F.col("y"))
    x = preds.select("subject", "model", err.alias("e")).withColumn("b", F.max(F.when(F.col("model") == best, F.col("e"))).over(Window.partitionBy("subject")))
    return signed_ranks(x.where(F.col("model") != best).select("model", (F.col("e") - F.col("b")).alias("diff")), ["model"])


def signed_ranks(x: DataFrame, by: list[str]) -> DataFrame:
    """by, w, p: the signed-rank statistic of the differences (by, diff), with tie correction; p is 1 where none differs from 0."""
    x = x.withColumn("diff", F.round("diff", 12)).withColumn("size", F.abs("diff"))
    some = with_ranks(x.where("diff <> 0"), by, "size", "r")
    ties = some.groupBy(*by, "size").agg(F.count("*").cast("double").alias("t")).groupBy(*by).agg(F.sum(F.col("t") ** 3 - F.col("t")).alias("ties"))
    g = some.groupBy(*by).agg(F.sum(F.when(F.col("diff") > 0, F.col("r")).otherwise(0.0)).alias("up"), F.sum(F.when(F.col("diff") < 0, F.col("r")).otherwise(0.0)).alias("down"), F.count("*").cast("double").alias("n")).join(ties, by)
    w, n = F.least("up", "down"), F.col("n")
    z = F.try_divide(w - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48))
    return x.select(*by).distinct().join(g, by, "left").select(*by, F.coalesce(w, F.lit(0.0)).alias("w"), F.coalesce(two_sided_p(z), F.lit(1.0)).alias("p"))


def select_regressors(preds: DataFrame, alpha: float = 0.05) -> DataFrame:
    """target, model, best, rank_rmse, p: for each target (subject, target, model, y, p) the model of least rank error, of equals the first by name, and those whose absolute errors don't differ from its by the signed-rank test."""
    scores = target_scores(preds).select("target", "model", "rank_rmse")
    best = scores.groupBy("target").agg(F.min_by("model", F.struct("rank_rmse", "model")).alias("best"))
    x = preds.select("subject", "target", "model", F.abs(F.col("p") - F.col("y")).alias("e")).join(F.broadcast(best), "target")
    x = x.withColumn("b", F.max(F.when(F.col("model") == F.col("best"), F.col("e"))).over(Window.partitionBy("target", "subject")))
    tested = signed_ranks(x.where("e IS NOT NULL AND b IS NOT NULL").select("target", "model", (F.col("e") - F.col("b")).alias("diff")), ["target", "model"])
    return tested.where(F.col("p") > alpha).join(scores, ["target", "model"]).join(best, "target").select("target", "model", "best", "rank_rmse", "p")


def perturbation_summary(scores: DataFrame) -> DataFrame:
    """Mean and deviation of each model's score over the splits."""
    return scores.groupBy("model", "name").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.count("*").alias("n"))


def metric_combinations(results: DataFrame, a: str, b: str, alpha: float = 0.05, without: str | None = None) -> DataFrame:
    """Mean and shifted geometric mean of two scores, for the models whose p is above alpha and whose name lacks `without`."""
    keep = F.col("p") > alpha if without is None else (F.col("p") > alpha) & ~F.col("model").contains(without)
    return results.where(keep).select("model", ((F.col(a) + F.col(b)) / 2).alias("mean"), (F.sqrt((1 + F.col(a)) * (1 + F.col(b))) - 1).alias("geometric"))


def weight_rollup(weights: DataFrame, meta: DataFrame) -> DataFrame:
    """channel, band, weight: importances (model, channel, band, w) as shares of their model, times the model's own, summed by channel, by band and in all (nulls)."""
    total = weights.groupBy("model").agg(F.sum(F.abs("w")).alias("total"))
    shares = weights.join(total, "model").join(meta, "model").select("channel", "band", (F.try_divide(F.abs("w"), "total") * F.col("meta")).alias("share"))
    return shares.groupingSets([["channel"], ["band"], []], "channel", "band").agg(F.sum("share").alias("weight"))


def results_table(scores: DataFrame, names: list[str]) -> DataFrame:
    """A row a model, a column a score, from long scores (model, name, score)."""
    return scores.groupBy("model").pivot("name", names).agg(F.first("score"))


def collect_base_predictions(preds: DataFrame, models: list[str]) -> DataFrame:
    """subject and a column a model, for the subjects that all models predict."""
    wide = preds.where(F.col("model").isin(models)).groupBy("subject").pivot("model", models).agg(F.first("p"))
    return wide.where(F.forall(F.array(*models), lambda p: p.isNotNull()))
