"""Models that are sums: fitted by one aggregate, applied by one join, on long feature tables (subject, key, value)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def naive_mean(train: DataFrame, test: DataFrame) -> DataFrame:
    """The training mean of each target (subject, name, y) for every row of test (subject, name, ...)."""
    return test.join(train.groupBy("name").agg(F.avg("y").alias("p")), "name")


def gaussian_nb(features: DataFrame, train: DataFrame, smoothing: float = 1e-9) -> DataFrame:
    """subject, p: probability of class 1 for every subject of features, from training labels (subject, y).

    Each key is normal within a class; variances get `smoothing` times the greatest variance of a key over all training
    subjects. A key that a subject lacks tells nothing about it.
    """
    known = features.where(F.col("value").isNotNull())
    seen = known.join(train, "subject")
    most = seen.groupBy("key").agg(F.var_pop("value").alias("v")).agg(F.max("v").alias("most"))
    by = seen.groupBy("key", "y").agg(F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    by = by.join(F.broadcast(most)).withColumn("v", F.col("v") + smoothing * F.col("most"))  # a single row
    terms = -0.5 * (F.ln(2 * math.pi * F.col("v")) + F.pow(F.col("value") - F.col("m"), F.lit(2.0)) / F.col("v"))
    sums = known.join(by, "key").groupBy("subject").agg(F.sum(F.when(F.col("y") == 1, terms).otherwise(-terms)).alias("odds"))
    prior = train.agg(F.ln(F.sum("y") / F.sum(1 - F.col("y"))).alias("prior"))
    return sums.join(F.broadcast(prior)).select("subject", (1 / (1 + F.exp(-(F.col("odds") + F.col("prior"))))).alias("p"))


def oof_gaussian_nb(features: DataFrame, folds: DataFrame) -> DataFrame:
    """subject, p: out-of-fold probabilities; folds: subject, y, fold. One pass for all folds: a fold's moments are the totals less its own."""
    x = features.where(F.col("value").isNotNull()).join(folds, "subject")
    own = x.groupBy("key", "y", "fold").agg(F.count("*").cast("double").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    all_ = own.groupBy("key", "y").agg(*[F.sum(c).alias(f"all_{c}") for c in "nsq"])
    rest = own.join(all_, ["key", "y"]).select("key", "y", "fold", *[(F.col(f"all_{c}") - F.col(c)).alias(c) for c in "nsq"])
    rest = rest.withColumn("m", F.col("s") / F.col("n")).withColumn("v", F.greatest(F.col("q") / F.col("n") - F.col("m") * F.col("m"), F.lit(1e-12)))
    terms = -0.5 * (F.ln(2 * math.pi * F.col("v")) + F.pow(F.col("value") - F.col("m"), F.lit(2.0)) / F.col("v"))
    scored = x.drop("y").join(rest.select("key", "fold", F.col("y").alias("of"), "m", "v"), ["key", "fold"])
    odds = scored.groupBy("subject", "fold").agg(F.sum(F.when(F.col("of") == 1, terms).otherwise(-terms)).alias("odds"))
    n = folds.groupBy("fold").agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0"))
    total = folds.agg(F.sum("y").alias("t1"), F.sum(1 - F.col("y")).alias("t0"))
    prior = n.join(F.broadcast(total)).select("fold", F.ln((F.col("t1") - F.col("n1")) / (F.col("t0") - F.col("n0"))).alias("prior"))
    return odds.join(prior, "fold").select("subject", (1 / (1 + F.exp(-(F.col("odds") + F.col("prior"))))).alias("p"))
