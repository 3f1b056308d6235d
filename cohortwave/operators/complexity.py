"""Complexity of series, one value a group; order is the column t_idx."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SERIES = ["subject", "channel", "state"]


def _w(by):
    return Window.partitionBy(*by).orderBy("t_idx")


def moments(df: DataFrame, by: list[str] = SERIES) -> DataFrame:
    return df.groupBy(*by).agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.var_pop("x").alias("var"), F.skewness("x").alias("skew"), F.kurtosis("x").alias("kurt"))


def curve_length(df: DataFrame, dx: float = 1.0, by: list[str] = SERIES, scale: float = 1.0, normalize: bool = False) -> DataFrame:
    """Sum of the distances between neighbours, dx apart, of the values times scale; normalize brings a series to 0 to 1 before (a constant one gives null)."""
    if normalize:
        w = Window.partitionBy(*by)
        df = df.withColumn("x", F.try_divide(F.col("x") - F.min("x").over(w), F.max("x").over(w) - F.min("x").over(w)))
    d = scale * (F.col("x") - F.lag("x").over(_w(by)))
    return df.withColumn("d", d).groupBy(*by).agg(F.sum(F.sqrt(F.lit(dx * dx) + F.col("d") * F.col("d"))).alias("curve_length"))


def hjorth(df: DataFrame, by: list[str] = SERIES) -> DataFrame:
    x = df.withColumn("d", F.col("x") - F.lag("x").over(_w(by))).withColumn("dd", F.col("d") - F.lag("d").over(_w(by)))
    v = x.groupBy(*by).agg(F.var_pop("x").alias("v0"), F.var_pop("d").alias("v1"), F.var_pop("dd").alias("v2"))
    return v.select(*by, F.sqrt(F.try_divide("v1", "v0")).alias("mobility"), F.try_divide(F.sqrt(F.try_divide("v2", "v1")), F.sqrt(F.try_divide("v1", "v0"))).alias("complexity"))


def perm_entropy(df: DataFrame, by: list[str] = SERIES) -> DataFrame:
    """Entropy of the orders of three neighbours, over log2 6. Equal values keep their places."""
    a, b, c = F.col("x"), F.lead("x").over(_w(by)), F.lead("x", 2).over(_w(by))
    code = F.when(b > a, 1).otherwise(0) + F.when(c > a, 2).otherwise(0) + F.when(c > b, 4).otherwise(0)
    x = df.withColumns({"code": code, "c": c}).where("c IS NOT NULL").groupBy(*by, "code").agg(F.count("*").alias("n"))
    return x.groupBy(*by).agg(((F.log2(F.sum("n").cast("double")) - F.sum(F.col("n") * F.log2(F.col("n").cast("double"))) / F.sum("n")) / math.log2(6)).alias("perm_entropy"))


def ordinal_entropy(df: DataFrame, order: int = 3, delay: int = 1, by: list[str] = SERIES) -> DataFrame:
    """Entropy of the orders of `order` values, `delay` apart, over log2 of their number. Equal values keep their places. perm_entropy is the form of order 3 and delay 1 without an array."""
    values = [F.lead("x", delay * k).over(_w(by)) if k else F.col("x") for k in range(order)]
    x = df.withColumn("v", F.array(*values)).withColumn("last", values[-1]).where("last IS NOT NULL")
    ranked = F.array_sort(F.transform("v", lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    n = x.groupBy(*by, F.transform(ranked, lambda s: s["i"]).alias("pattern")).agg(F.count("*").cast("double").alias("n"))
    return n.groupBy(*by).agg(((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")) / math.log2(math.factorial(order))).alias("perm_entropy"))


def katz_fd(df: DataFrame, by: list[str] = SERIES) -> DataFrame:
    x = df.withColumns({"d": F.abs(F.col("x") - F.lag("x").over(_w(by))), "first": F.first("x").over(_w(by))})
    g = x.groupBy(*by).agg(F.sum("d").alias("path"), F.avg("d").alias("step"), F.max(F.abs(F.col("x") - F.col("first"))).alias("far"))
    n = F.log10(F.try_divide("path", "step"))
    return g.select(*by, F.try_divide(n, n + F.log10(F.try_divide("far", "path"))).alias("katz_fd"))


def petrosian_fd(df: DataFrame, by: list[str] = SERIES) -> DataFrame:
    x = df.withColumn("d", F.col("x") - F.lag("x").over(_w(by))).withColumn("turn", (F.col("d") * F.lag("d").over(_w(by)) < 0).cast("int"))
    g = x.groupBy(*by).agg(F.count("*").cast("double").alias("n"), F.sum("turn").alias("t"))
    return g.select(*by, F.try_divide(F.log10("n"), F.log10("n") + F.log10(F.col("n") / (F.col("n") + 0.4 * F.col("t")))).alias("petrosian_fd"))


def higuchi_fd(df: DataFrame, kmax: int = 5, by: list[str] = SERIES) -> DataFrame:
    """Slope of log mean curve length against log 1/k, the lengths at all scales from lags in one window."""
    n = F.count("*").over(Window.partitionBy(*by))
    lags = F.array(*[F.struct(F.lit(k).alias("k"), F.abs(F.col("x") - F.lag("x", k).over(_w(by))).alias("d")) for k in range(1, kmax + 1)])
    x = df.withColumns({"n": n, "l": lags}).select(*by, "t_idx", "n", F.explode("l").alias("l")).select(*by, "t_idx", "n", "l.k", "l.d").where("d IS NOT NULL")
    m = F.col("t_idx") % F.col("k")
    per = x.groupBy(*by, "k", m.alias("m")).agg(F.sum("d").alias("s"), F.first("n").alias("n"))
    blocks = F.floor((F.col("n") - F.col("m") - 1) / F.col("k"))
    mean = per.withColumn("len", F.try_divide(F.col("s") * (F.col("n") - 1), blocks * F.col("k") * F.col("k"))).groupBy(*by, "k").agg(F.avg("len").alias("len"))
    return mean.groupBy(*by).agg(F.regr_slope(F.ln("len"), F.ln(F.lit(1.0) / F.col("k"))).alias("higuchi_fd"))


def svd_entropy(df: DataFrame, by: list[str] = SERIES) -> DataFrame:
    """Entropy over log2 3 of the normalised singular values of the embedding in three lags.

    The squared singular values are the eigenvalues of the 3 x 3 matrix of lagged products, in closed form.
    """
    a, b, c = F.col("x"), F.lead("x").over(_w(by)), F.lead("x", 2).over(_w(by))
    x = df.withColumns({"b": b, "c": c}).where("c IS NOT NULL")
    g = x.groupBy(*by).agg(*[F.sum(F.col(p) * F.col(q)).alias(p + q) for p, q in (("x", "x"), ("b", "b"), ("c", "c"), ("x", "b"), ("x", "c"), ("b", "c"))])
    q = (F.col("xx") + F.col("bb") + F.col("cc")) / 3
    off = F.col("xb") ** 2 + F.col("xc") ** 2 + F.col("bc") ** 2
    g = g.withColumn("q", q).withColumn("p", F.sqrt(((F.col("xx") - q) ** 2 + (F.col("bb") - q) ** 2 + (F.col("cc") - q) ** 2 + 2 * off) / 6))
    d = [F.try_divide(F.col(v) - F.col("q"), F.col("p")) for v in ("xx", "bb", "cc")]
    e = [F.try_divide(v, "p") for v in ("xb", "xc", "bc")]
    det = d[0] * (d[1] * d[2] - e[2] ** 2) - e[0] * (e[0] * d[2] - e[2] * e[1]) + e[1] * (e[0] * e[2] - d[1] * e[1])
    g = g.withColumn("phi", F.acos(F.greatest(F.least(det / 2, F.lit(1.0)), F.lit(-1.0))) / 3)
    eig = [F.sqrt(F.greatest(F.col("q") + 2 * F.col("p") * F.cos(F.col("phi") + k * 2 * math.pi / 3), F.lit(1e-300))) for k in range(3)]
    g = g.withColumn("s", F.array(*eig)).withColumn("t", F.aggregate("s", F.lit(0.0), lambda u, v: u + v))
    return g.select(*by, (-F.aggregate("s", F.lit(0.0), lambda u, v: u + v / F.col("t") * F.log2(v / F.col("t"))) / math.log2(3)).alias("svd_entropy"))


def svd_entropy_of(df: DataFrame, order: int = 3, delay: int = 1, by: list[str] = SERIES) -> DataFrame:
    """svd_entropy for any order and delay: the lagged products are one aggregate; the eigenvalues of each series' small matrix are found in Arrow batches of many series."""
    lags = [F.col("x")] + [F.lead("x", delay * k).over(_w(by)) for k in range(1, order)]
    x = df.withColumns({f"_v{k}": v for k, v in enumerate(lags)}).where(f"_v{order - 1} IS NOT NULL")
    g = x.groupBy(*by).agg(F.array(*[F.sum(F.col(f"_v{min(i, j)}") * F.col(f"_v{max(i, j)}")) for i in range(order) for j in range(order)]).alias("products"))

    @F.pandas_udf("double")
    def entropy(products: pd.Series) -> pd.Series:
        m = np.stack(products.to_numpy()).reshape(-1, order, order) if len(products) else np.zeros((0, order, order))
        s = np.sqrt(np.clip(np.linalg.eigvalsh(m), 0, None))
        total = s.sum(1, keepdims=True)
        p = np.divide(s, total, out=np.zeros_like(s), where=total > 0)
        parts = -np.where(p > 0, p * np.log2(np.where(p > 0, p, 1)), 0).sum(1) / np.log2(order)
        return pd.Series(np.where(total[:, 0] > 0, parts, np.nan))

    return g.select(*by, F.nanvl(entropy("products"), F.lit(None).cast("double")).alias("svd_entropy"))


def epoch_distribution(df: DataFrame, by: list[str] = SERIES) -> DataFrame:
    """Spread of an epoch feature over a channel's epochs."""
    q = F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = df.groupBy(*by).agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), q.alias("q"))
    return g.select(*by, "mean", "std", F.col("q")[1].alias("median"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"))


def feature_distribution(features: DataFrame, value: str, by: list[str] = SERIES) -> DataFrame:
    """mean, std, median, iqr, skew and kurtosis of an epoch feature over a channel's epochs; those of the population."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = features.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), q.alias("q"), F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurt"))
    return g.select(*by, "n", "mean", "std", F.col("q")[1].alias("median"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"), "skew", "kurt")


def _epoch_arrays(epoched: DataFrame, r: float) -> DataFrame:
    """An epoch a row: its samples in order and the tolerance, r times their deviation. Epochs have the window's length."""
    g = epoched.groupBy(*SERIES, "epoch").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("p"), (r * F.stddev_pop("x")).alias("tol"))
    return g.select(*SERIES, "epoch", F.col("p.x").alias("x"), "tol")


#: Comparisons of samples that a task makes at once.
AT_ONCE = 1 << 22


def _of_epochs(m: int, score):
    """A column function of epochs (samples, tolerance, places of nulls): score(two, more) of those of one length, in parts of bounded size.

    two and more say of an epoch whether its templates i and j of m and of m + 1 samples are within the tolerance at all
    places. As in SQL, a null is within no tolerance, and all else is within a tolerance of NaN.
    """

    @F.pandas_udf("double")
    def run(xs: pd.Series, tol: pd.Series, holes: pd.Series) -> pd.Series:
        out, sizes = np.full(len(xs), np.nan), xs.map(len).to_numpy(int)
        values, limits, gaps = xs.to_numpy(), tol.to_numpy(float), holes.to_numpy()
        for n in np.unique(sizes).tolist():
            step, mine = max(1, AT_ONCE // (n * n)), np.flatnonzero(sizes == n)
            for some in (mine[a : a + step] for a in range(0, len(mine), step)):
                x, t = np.stack([np.asarray(v, float) for v in values[some]]), limits[some, None, None]
                with np.errstate(invalid="ignore"):
                    near = (np.abs(x[:, :, None] - x[:, None, :]) <= t) | np.isnan(t)
                for e in range(len(some)):
                    if len(gap := np.asarray(gaps[some[e]], int)):
                        near[e, gap, :] = near[e, :, gap] = False
                both = [near]
                for k in range(1, m + 1):
                    both.append(both[-1][:, :-1, :-1] & near[:, k:, k:])
                out[some] = score(both[m - 1], both[m])
        return pd.Series(out)

    return run


def _scored(epoched: DataFrame, m: int, r: float, name: str, score) -> DataFrame:
    holes = F.filter(F.transform("x", lambda v, i: F.when(v.isNull(), i)), lambda i: i.isNotNull())
    e = _epoch_arrays(epoched, r).where(F.size("x") > m + 1)
    return e.select(*SERIES, "epoch", _of_epochs(m, score)("x", F.coalesce("tol", F.lit(0.0)), holes).alias(name))


def app_entropy(epoched: DataFrame, m: int = 2, r: float = 0.2) -> DataFrame:
    """Approximate entropy of each epoch: templates meet within the epoch's own array, matches with themselves included; null where a sample is."""

    def phi(near: np.ndarray) -> np.ndarray:
        found = near.sum(2) / near.shape[1]
        return np.where(found > 0, np.log(np.where(found > 0, found, 1)), np.nan).mean(1)

    return _scored(epoched, m, r, "app_entropy", lambda two, more: phi(two) - phi(more))


def sample_entropy(epoched: DataFrame, m: int = 2, r: float = 0.2) -> DataFrame:
    """-ln(A / B) of each epoch, without matches of a template with itself; null where there are none."""

    def score(two: np.ndarray, more: np.ndarray) -> np.ndarray:
        pairs = np.triu(np.ones(more.shape[1:], bool), 1)
        a, b = (more & pairs).sum((1, 2)), (two[:, :-1, :-1] & pairs).sum((1, 2))
        return np.where(a > 0, -np.log(np.maximum(a, 1) / np.maximum(b, 1)), np.nan)

    return _scored(epoched, m, r, "sample_entropy", score)


def flatten_names(features: DataFrame, parts: list[str], value: str, names: list[str] | None = None) -> DataFrame:
    """Long to wide: a column for each name made of the parts, a row a subject. With names given no pass over the table finds them."""
    return features.withColumn("_name", F.concat_ws("_", *parts)).groupBy("subject").pivot("_name", names).agg(F.first(value))
