"""Preparation and selection on long feature tables (subject, key, value)."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.lineage import stored
from ..functions.scalar import corr, with_ranks


def drop_duplicate_constant(features: DataFrame, min_unique: int = 2) -> DataFrame:
    """Keys whose values differ from those of all earlier keys, and among themselves. Columns meet by an order-free digest."""
    g = features.groupBy("key").agg(F.sum(F.xxhash64("subject", "value").cast("decimal(38,0)")).alias("d1"), F.bit_xor(F.xxhash64("value", "subject")).alias("d2"), F.countDistinct("value").alias("u"))
    first = F.row_number().over(Window.partitionBy("d1", "d2").orderBy("key"))
    return g.withColumn("r", first).where((F.col("r") == 1) & (F.col("u") >= min_unique)).select("key", F.col("u").alias("n_unique"))


def null_report(features: DataFrame) -> DataFrame:
    bad = F.col("value").isNull() | F.isnan("value")
    return features.groupBy("key").agg(F.sum(bad.cast("long")).alias("n_null"), F.sum((F.abs("value") == float("inf")).cast("long")).alias("n_inf"))


def variance_filter(features: DataFrame, threshold: float) -> DataFrame:
    return features.groupBy("key").agg(F.var_pop("value").alias("variance")).where(F.col("variance") > threshold)


def impute(features: DataFrame) -> DataFrame:
    """Nulls as the median of their key."""
    middle = features.groupBy("key").agg(F.percentile("value", F.lit(0.5)).alias("middle"))
    return features.join(middle, "key").select("subject", "key", F.coalesce("value", "middle").alias("value"))


def drop_odd_columns(features: DataFrame) -> DataFrame:
    """The rows of keys without any null, NaN or infinite value."""
    odd = F.coalesce(F.isnan("value") | (F.abs("value") == float("inf")), F.lit(True))
    return features.join(features.where(odd).select("key").distinct(), "key", "left_anti")


def drop_odd_rows(features: DataFrame) -> DataFrame:
    """The rows of subjects without any null, NaN or infinite value."""
    odd = F.coalesce(F.isnan("value") | (F.abs("value") == float("inf")), F.lit(True))
    return features.join(features.where(odd).select("subject").distinct(), "subject", "left_anti")


def drop_duplicate_named(features: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """One row of each subject and key, where the values under one name differ by no more than the tolerance in any subject; keys that differ more lose nothing."""
    spread = features.groupBy("subject", "key").agg((F.max("value") - F.min("value")).alias("d"), F.count("*").alias("n"))
    wide = spread.where(F.col("d") > tolerance).select("key").distinct()
    apart = features.join(wide, "key", "left_semi").select("subject", "key", "value")
    return apart.unionByName(features.join(wide, "key", "left_anti").groupBy("subject", "key").agg(F.min("value").alias("value")))


def join_feature_sets(sets: dict[str, DataFrame]) -> DataFrame:
    """The sets' rows (subject, key, value) with their set, for the subjects that all of them have."""
    every = reduce(lambda a, b: a.unionByName(b), [df.select(F.lit(name).alias("set"), "subject", "key", "value") for name, df in sets.items()])
    common = every.groupBy("subject").agg(F.count_distinct("set").alias("n")).where(F.col("n") == len(sets)).select("subject")
    return every.join(common, "subject", "left_semi")


def split_by_token(features: DataFrame, tokens: list[str]) -> DataFrame:
    """The rows with the first of the tokens that the key holds; null without any."""
    return features.withColumn("token", F.coalesce(*[F.when(F.contains("key", F.lit(t)), F.lit(t)) for t in tokens]))


def score_kendall(features: DataFrame, target: DataFrame) -> DataFrame:
    """Absolute tau-b of each key with a target of any values; rows with a null on either side are left out.

    Ranks of both sides fall into buckets. A pair of rows is counted in its bucket of x where it shares that, else in
    its bucket of y where it shares that, else by the counts of pairs of buckets. So a row travels twice, no pair is
    made, and a task holds some three times `span` rows, or a 64th of a key's rows as counts of buckets.
    """
    return tau(features.join(target.select("subject", "y"), "subject"), target.count())


def _surplus(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> float:
    """Concordant less discordant pairs of rows (a, b) that occur n times, by the first bit in which their ranks of b differ."""
    _, x = np.unique(a, return_inverse=True)
    _, y = np.unique(b, return_inverse=True)
    n, total = n.astype(float), 0.0
    for bit in range(int(y.max()).bit_length()):
        order = np.lexsort((x, y >> (bit + 1)))
        block, at, one = (y >> (bit + 1))[order], x[order], ((y >> bit) & 1)[order] == 1
        low = np.append(0.0, np.cumsum(np.where(one, 0.0, n[order])))  # rows of the lower half before each place
        new = np.append(True, block[1:] != block[:-1])
        tie = np.append(True, new[1:] | (at[1:] != at[:-1]))
        starts, ties = np.flatnonzero(new), np.flatnonzero(tie)
        which, same = np.cumsum(new) - 1, np.cumsum(tie) - 1
        first, last = low[starts], low[np.append(starts[1:], len(x))]
        before, upto = low[ties], low[np.append(ties[1:], len(x))]
        total += float((n[order] * ((before[same] - first[which]) - (last[which] - upto[same])))[one].sum())
    return total


def tau(rows: DataFrame, most: int, span: int | None = None) -> DataFrame:
    """score_kendall of rows that hold both sides (key, value, y); a key has `most` of them at most. A bucket has `span` ranks; the result is the same for any."""
    both = rows.where(F.col("value").isNotNull() & F.col("y").isNotNull() & ~F.isnan("value"))
    x = with_ranks(with_ranks(both, ["key"], "value", "rx"), ["key"], "y", "ry").select("key", (2 * F.col("rx")).cast("long").alias("x"), (2 * F.col("ry")).cast("long").alias("y"))
    x = stored(x.groupBy("key", "x", "y").agg(F.count("*").alias("n")))
    span = 2 * (span or max(4096, 8 * math.isqrt(most)))
    x = x.withColumns({"bx": F.floor(F.col("x") / span), "by": F.floor(F.col("y") / span)})
    counted = lambda place, a, b: x.groupBy("key", place.alias("place"), F.col(a).alias("a"), F.col(b).alias("b")).agg(F.sum("n").alias("n"))
    # a bucket of one value may hold a whole key, and has no pair of different ranks
    many = x.groupBy("key", "bx").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).where("lo < hi").select("key", "bx")
    inside = x.join(many, ["key", "bx"], "left_semi").select("key", F.col("bx").alias("place"), F.col("x").alias("a"), F.col("y").alias("b"), "n", F.lit(0).alias("kind"))
    parts = inside.unionByName(counted(F.col("by"), "bx", "y").withColumn("kind", F.lit(1))).unionByName(counted(F.lit(0).cast("long"), "bx", "by").withColumn("kind", F.lit(2)))

    def surplus(group: pa.Table) -> pa.Table:
        s = _surplus(*(np.asarray(group[c].to_numpy()) for c in ("a", "b", "n")))
        return pa.table([group["key"].slice(0, 1).combine_chunks(), pa.array([s])], names=["key", "s"])

    kinds = StructType([x.schema["key"], StructField("s", DoubleType())])
    # keys without any pair of different ranks come with 0
    found = parts.groupBy("key", "kind", "place").applyInArrow(surplus, kinds)
    s = found.groupBy("key").agg(F.sum("s").alias("s"))
    tied = lambda c: x.groupBy("key", c).agg(F.sum("n").cast("double").alias("t")).groupBy("key").agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).alias(f"t{c}"), F.sum("t").alias(f"n{c}"))
    t = s.join(tied("x"), "key").join(tied("y"), "key")
    pairs = F.col("nx") * (F.col("nx") - 1) / 2
    return t.select("key", F.abs(F.try_divide("s", F.sqrt((pairs - F.col("tx")) * (pairs - F.col("ty"))))).alias("score"))


def robust_scale(features: DataFrame, train: DataFrame) -> DataFrame:
    """(x - median) / iqr of each key, both from the training subjects."""
    q = features.join(train, "subject", "left_semi").groupBy("key").agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return features.join(q, "key").select("subject", "key", F.try_divide(F.col("value") - F.col("q")[1], F.col("q")[2] - F.col("q")[0]).alias("value"))


def score_pearson(features: DataFrame, target: DataFrame) -> DataFrame:
    return features.join(target, "subject").groupBy("key").agg(F.abs(corr("value", "y")).alias("score"))


def score_spearman(features: DataFrame, target: DataFrame) -> DataFrame:
    """Absolute rank correlation of each key with the target over the rows that have both.

    A target's ranks are the same for all keys without a null, so they are made once, for all subjects; keys that lack
    values have their targets ranked anew among the rows that they have.
    """
    known = features.where(F.col("value").isNotNull() & ~F.isnan("value")).join(target.where(F.col("y").isNotNull()).select("subject", F.col("y").cast("double").alias("y")), "subject")
    x = with_ranks(known, ["key"], "value", "rv")
    whole = with_ranks(target.where(F.col("y").isNotNull()).select("subject", F.lit(0).alias("_all"), F.col("y").cast("double").alias("y")), ["_all"], "y", "ry").select("subject", "ry")
    n = target.where(F.col("y").isNotNull()).count()
    lacking = known.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") != n).select("key")
    rho = F.abs(corr("rv", "ry")).alias("score")
    if lacking.isEmpty():
        return x.join(whole, "subject").groupBy("key").agg(rho)
    out = x.join(lacking, "key", "left_anti").join(whole, "subject").groupBy("key").agg(rho)
    part = x.join(lacking, "key", "left_semi")
    return out.unionByName(with_ranks(part, ["key"], "y", "ry").groupBy("key").agg(rho))


def score_anova(features: DataFrame, target: DataFrame) -> DataFrame:
    """F statistic of each key from grouped moments."""
    g = features.join(target, "subject").groupBy("key", "y").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    t = g.groupBy("key").agg(F.sum("n").alias("N"), F.count("*").alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("gm"), F.sum(F.col("n") * F.col("v")).alias("within"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("sq"))
    between = F.col("sq") - F.col("N") * F.col("gm") * F.col("gm")
    return t.select("key", F.try_divide(F.try_divide(between, F.col("k") - 1), F.try_divide("within", F.col("N") - F.col("k"))).alias("score"))


def _ln_gamma(z):
    """Logarithm of the gamma function by Stirling's series, eight places up."""
    w = z + 8
    series = (w - 0.5) * F.ln(w) - w + 0.5 * math.log(2 * math.pi) + 1 / (12 * w) - 1 / (360 * F.pow(w, F.lit(3.0))) + 1 / (1260 * F.pow(w, F.lit(5.0)))
    return series - sum((F.ln(z + k) for k in range(1, 8)), F.ln(z))


def anova_confidence(features: DataFrame, target: DataFrame, points: int = 512) -> DataFrame:
    """key, score and confidence: the F statistic of each key and 1 - p, the share of the F distribution below it; null where it is undefined. Rows with a null are left out.

    With x = sin(t)^2 the incomplete beta function is an integral of sin^(2a - 1) cos^(2b - 1), which Simpson's rule takes at
    `points` steps in the key's own row.
    """
    both = features.join(target.select("subject", "y"), "subject").where(F.col("value").isNotNull() & F.col("y").isNotNull())
    g = both.groupBy("key", "y").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    t = g.groupBy("key").agg(F.sum("n").cast("double").alias("N"), F.count("*").cast("double").alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("gm"), F.sum(F.col("n") * F.col("v")).alias("within"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("sq"))
    d1, d2 = F.col("k") - 1, F.col("N") - F.col("k")
    t = t.withColumns({"d1": d1, "d2": d2, "f": F.try_divide(F.try_divide(F.greatest(F.col("sq") - F.col("N") * F.col("gm") * F.col("gm"), F.lit(0.0)), d1), F.try_divide("within", d2))})
    t = t.withColumn("t", F.asin(F.sqrt(F.try_divide(F.col("d1") * F.col("f"), F.col("d1") * F.col("f") + F.col("d2")))))
    weight = lambda i: F.when((i == 0) | (i == points), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
    at = lambda i: F.col("t") * i / points
    one = lambda i: weight(i) * F.pow(F.sin(at(i)), F.col("d1") - 1) * F.pow(F.cos(at(i)), F.col("d2") - 1)
    area = F.aggregate(F.sequence(F.lit(0), F.lit(points)), F.lit(0.0), lambda s, i: s + one(i)) * F.col("t") / (3 * points)
    beta = _ln_gamma(F.col("d1") / 2) + _ln_gamma(F.col("d2") / 2) - _ln_gamma((F.col("d1") + F.col("d2")) / 2)
    return t.select("key", F.col("f").alias("score"), F.when((F.col("d1") > 0) & (F.col("d2") > 0) & F.col("f").isNotNull(), F.least(2 * area / F.exp(beta), F.lit(1.0))).alias("confidence"))


SCORES = {"pearson": lambda f, t: score_pearson(f, t), "spearman": lambda f, t: score_spearman(f, t), "kendall": lambda f, t: score_kendall(f, t), "mutual_info": lambda f, t: score_mutual_info(f, t)}


def score_multi(features: DataFrame, targets: DataFrame, score: str = "pearson", names: list[str] | None = None) -> DataFrame:
    """Mean and highest score over several targets (subject, name, y). Pearson's takes all targets at once; the others are scored a target at a time, for the names given."""
    if score == "pearson":
        s = features.join(targets, "subject").groupBy("key", "name").agg(F.abs(corr("value", "y")).alias("s"))
    else:
        if not names:
            raise ValueError("give the targets' names")
        s = reduce(DataFrame.unionByName, [SCORES[score](features, targets.where(F.col("name") == n).select("subject", "y")).select("key", F.col("score").alias("s")) for n in names])
    return s.groupBy("key").agg(F.avg("s").alias("avg_score"), F.max("s").alias("max_score"))


def select_threshold(scores: DataFrame, threshold: float, least: int) -> DataFrame:
    """Keys above the threshold; the best `least` where fewer are. The table has a row a key."""
    r = F.row_number().over(Window.orderBy(F.desc("score"), "key"))
    return scores.withColumn("r", r).where((F.col("score") > threshold) | (F.col("r") <= least)).select("key", "score")


def pair_correlation(features: DataFrame) -> DataFrame:
    """Absolute correlation of every pair of keys, from the subjects' own vectors: one shuffle by subject, one by pair."""
    g = features.groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("key", "value"))).alias("v"))
    one = g.select("v", F.posexplode("v").alias("i", "a"))
    two = one.select("a", F.explode(F.slice("v", F.col("i") + 2, F.greatest(F.size("v"), F.lit(1)))).alias("b"))
    return two.groupBy(F.col("a.key").alias("k1"), F.col("b.key").alias("k2")).agg(F.abs(corr("a.value", "b.value")).alias("r"))


def pair_rank_correlation(features: DataFrame) -> DataFrame:
    """Absolute rank correlation of every pair of keys, for subjects that have all of them: ranks once a key, then as pair_correlation."""
    return pair_correlation(with_ranks(features.where(F.col("value").isNotNull()), ["key"], "value", "_r").select("subject", "key", F.col("_r").alias("value")))


def pair_tau(features: DataFrame) -> DataFrame:
    """Absolute tau-b of every pair of keys: each pair is a key of its own, whose discordant pairs are counted by digits of ranks (score_kendall)."""
    g = features.where(F.col("value").isNotNull()).groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("key", "value"))).alias("v"))
    one = g.select("subject", "v", F.posexplode("v").alias("i", "a"))
    two = one.select("subject", "a", F.explode(F.slice("v", F.col("i") + 2, F.greatest(F.size("v"), F.lit(1)))).alias("b"))
    rows = two.select("subject", F.struct(F.col("a.key").alias("k1"), F.col("b.key").alias("k2")).alias("key"), F.col("a.value").alias("value"), F.col("b.value").alias("y"))
    return tau(rows, features.select("subject").distinct().count()).select("key.k1", "key.k2", F.col("score").alias("r"))


def bh_adjust(p: DataFrame) -> DataFrame:
    """Benjamini-Hochberg q values of (key, p). The table has a row a test."""
    up = Window.orderBy("p", "key")
    x = p.withColumns({"r": F.row_number().over(up), "n": F.count("*").over(Window.partitionBy())})
    x = x.withColumn("raw", F.col("p") * F.col("n") / F.col("r"))
    return x.select("key", "p", F.least(F.min("raw").over(Window.orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0)).alias("q"))


def gaussian_kl(features: DataFrame, target: DataFrame) -> DataFrame:
    """Divergence of class 1 from class 0, both as Gaussians, for each key."""
    def stat(f, y):
        return f(F.when(F.col("y") == y, F.col("value")))

    g = features.join(target, "subject").groupBy("key").agg(*[stat(f, y).alias(f"{n}{y}") for y in (0, 1) for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    return g.select("key", (F.ln(F.try_divide("s0", "s1")) + F.try_divide(F.col("s1") ** 2 + (F.col("m1") - F.col("m0")) ** 2, 2 * F.col("s0") ** 2) - 0.5).alias("kl"))


def regional_features(features: DataFrame, regions: dict[str, list[str]]) -> DataFrame:
    """Aggregates of the keys of a region for each subject; the spread is that of a sample."""
    of = F.array_compact(F.array(*[F.when(F.col("key").isin(k), F.lit(r)) for r, k in regions.items()]))
    x = features.withColumn("roi", F.explode(of))
    return x.groupBy("subject", "roi").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.percentile("value", F.lit(0.5)).alias("median"), F.sum("value").alias("sum"), F.max("value").alias("max"), F.min("value").alias("min"))


def regional_shapes(features: DataFrame, regions: dict[str, list[str]], levels: list[float]) -> DataFrame:
    """skew, kurt, iqr and a percentile pNN for each level (in percent) of the keys of a region for each subject; moments are those of the population."""
    of = F.array_compact(F.array(*[F.when(F.col("key").isin(k), F.lit(r)) for r, k in regions.items()]))
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.75), *[F.lit(v / 100) for v in levels]))
    g = features.withColumn("roi", F.explode(of)).groupBy("subject", "roi").agg(F.skewness("value").alias("skew"), F.kurtosis("value").alias("kurt"), q.alias("q"))
    return g.select("subject", "roi", "skew", "kurt", (F.col("q")[1] - F.col("q")[0]).alias("iqr"), *[F.col("q")[i + 2].alias(f"p{v:g}") for i, v in enumerate(levels)])


def subject_range(features: DataFrame, order: DataFrame, start: int, stop: int) -> DataFrame:
    """The rows of the subjects from start to below stop in an order (subject, position): positions are ranked, so they need not be gapless. The order has a row a subject; equal positions go by subject."""
    ranked = order.orderBy("position", "subject").limit(stop)
    skipped = order.orderBy("position", "subject").limit(start)
    return features.join(ranked.join(skipped, "subject", "left_anti").select("subject"), "subject", "left_semi")


def low_variance_keys(features: DataFrame, threshold: float) -> DataFrame:
    """key, variance, n_unique, static: the keys whose variance is not above the threshold, and whether all their values are equal."""
    g = features.groupBy("key").agg(F.var_pop("value").alias("variance"), F.countDistinct("value").alias("n_unique"))
    return g.where(~F.coalesce(F.col("variance") > threshold, F.lit(False))).withColumn("static", F.col("n_unique") <= 1)


def fill_cells(features: DataFrame, fill: float, pos_inf: float, neg_inf: float) -> DataFrame:
    """Nulls and NaN as fill, infinities as the given values."""
    v = F.col("value")
    return features.select("subject", "key", F.when(v.isNull() | F.isnan(v), fill).when(v == float("inf"), pos_inf).when(v == float("-inf"), neg_inf).otherwise(v).alias("value"))


def scale_scores(scores: DataFrame, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Scores brought to lo to hi by their least and greatest; lo where all are equal. One aggregate of a row is broadcast."""
    ends = scores.agg(F.min("score").alias("a"), F.max("score").alias("b"))
    return scores.join(F.broadcast(ends)).select("key", (F.lit(lo) + (hi - lo) * F.coalesce(F.try_divide(F.col("score") - F.col("a"), F.col("b") - F.col("a")), F.lit(0.0))).alias("score"))


def assign_folds(df: DataFrame, key: str, by: str, k: int, seed: str) -> DataFrame:
    """Stratified folds: the hash of the key deals each class out; the md5 is the same in any engine."""
    x = df.withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))).withColumn("_b", F.substring("_h", 1, 3))
    # rows are numbered within buckets of the digest, and a bucket starts where the lower ones end
    lower = F.sum("_m").over(Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    starts = x.groupBy(by, "_b").agg(F.count("*").alias("_m")).select(by, "_b", F.coalesce(lower, F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy(by, "_b").orderBy("_h", key))
    return x.join(starts, [by, "_b"]).withColumn("fold", (F.col("_start") + place - 1) % k).select(*df.columns, "fold")


def repeated_folds(df: DataFrame, key: str, by: str, k: int, repeats: int, seed: str) -> DataFrame:
    """Stratified folds dealt out anew for each repeat, all in one pass: df's rows times repeats, with repeat and fold."""
    x = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("_by", F.struct(F.col(by), F.col("repeat"))).withColumn("_key", F.concat_ws(":", F.col("repeat").cast("string"), F.col(key).cast("string")))
    return assign_folds(x, "_key", "_by", k, seed).drop("_by", "_key")


def group_folds(df: DataFrame, group: str) -> DataFrame:
    """Leave one group out: fold is the number of the row's group in order, null groups first. There is a row a group in the one window."""
    groups = df.select(group).distinct().withColumn("fold", (F.row_number().over(Window.orderBy(group)) - 1).cast("long"))
    return df.join(groups.select(F.col(group).alias("_g"), "fold"), F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def shuffle_split(df: DataFrame, key: str, by: str, share: float, seed: str) -> DataFrame:
    """Stratified shuffle split: test is true for the `share` (rounded down) of each class that comes first by a digest."""
    x = df.withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))).withColumn("_b", F.substring("_h", 1, 3))
    lower = Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = x.groupBy(by, "_b").agg(F.count("*").alias("_m")).select(by, "_b", F.coalesce(F.sum("_m").over(lower), F.lit(0)).alias("_start"), F.sum("_m").over(Window.partitionBy(by)).alias("_all"))
    place = F.row_number().over(Window.partitionBy(by, "_b").orderBy("_h", key))
    return x.join(starts, [by, "_b"]).withColumn("test", F.col("_start") + place <= F.floor(F.lit(share) * F.col("_all") + 1e-9)).select(*df.columns, "test")


def score_mutual_info(features: DataFrame, target: DataFrame, bins: int = 10) -> DataFrame:
    """Mutual information in nats of the target and the value's bin, bins of equal width over the key's range. Null values are left out."""
    known = features.where(F.col("value").isNotNull())
    span = known.groupBy("key").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    place = F.coalesce(F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    n = known.join(span, "key").join(target, "subject").groupBy("key", F.least(F.floor(place * bins), F.lit(bins - 1)).alias("bin"), "y").agg(F.count("*").cast("double").alias("n"))
    # the windows run over counts, a key's bins times the target's values
    n = n.withColumns({"nb": F.sum("n").over(Window.partitionBy("key", "bin")), "ny": F.sum("n").over(Window.partitionBy("key", "y")), "t": F.sum("n").over(Window.partitionBy("key"))})
    return n.groupBy("key").agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("nb") * F.col("ny")))).alias("score"))


def odd_cells(features: DataFrame) -> DataFrame:
    """subject, key, kind of the cells that are null, NaN or infinite."""
    v = F.col("value")
    kind = F.when(v.isNull(), "null").when(F.isnan(v), "nan").when(F.abs(v) == float("inf"), "inf")
    return features.select("subject", "key", kind.alias("kind")).where("kind IS NOT NULL")


def sample_subjects(features: DataFrame, n: int, seed: int) -> DataFrame:
    """The rows of n subjects, those that come first by a digest of seed and subject; the same at every run."""
    some = features.select("subject").distinct().orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("subject").cast("string")))).limit(n)
    return features.join(some, "subject", "left_semi")


def feature_trace(steps: DataFrame) -> DataFrame:
    """key, last_step, n_steps: how far each key came through the preparation steps (step, key)."""
    return steps.groupBy("key").agg(F.max("step").alias("last_step"), F.countDistinct("step").alias("n_steps"))


def join_prefixed(tables: dict[str, DataFrame]) -> DataFrame:
    """Wide feature tables side by side, their columns named by the table, for the subjects that all have."""
    named = [t.select("subject", *[F.col(c).alias(f"{name}_{c}") for c in t.columns if c != "subject"]) for name, t in tables.items()]
    out = named[0]
    for t in named[1:]:
        out = out.join(t, "subject")
    return out


def pair_mutual_info_matrix(features: DataFrame, bins: int = 20) -> DataFrame:
    """a, b, mi of all pairs of keys in nats, by bins of equal width; half is computed and mirrored. Pairs come from a subject's own array."""
    span = features.groupBy("key").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    bin_ = F.least(F.floor(F.coalesce(F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * bins), F.lit(bins - 1))
    g = features.join(span, "key").groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("key", bin_.alias("bin")))).alias("c"))
    one = g.select("c", F.explode("c").alias("p"))
    two = one.select("p", F.explode(F.filter("c", lambda q: q["key"] >= F.col("p.key"))).alias("q"))
    n = two.groupBy(F.col("p.key").alias("a"), F.col("q.key").alias("b"), F.col("p.bin").alias("u"), F.col("q.bin").alias("v")).agg(F.count("*").cast("double").alias("n"))
    n = n.withColumns({"na": F.sum("n").over(Window.partitionBy("a", "b", "u")), "nb": F.sum("n").over(Window.partitionBy("a", "b", "v")), "t": F.sum("n").over(Window.partitionBy("a", "b"))})
    mi = n.groupBy("a", "b").agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"))
    return mi.unionByName(mi.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "mi"))
