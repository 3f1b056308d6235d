"""How the spread of a series grows with the length of its blocks, on packed epochs (subject, state, channel, epoch, xs)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .spectral import KEY

EPOCH = [*KEY, "epoch"]
LINE = StructType([StructField("slope", DoubleType()), StructField("intercept", DoubleType()), StructField("n", IntegerType())])


def _rows(epochs: DataFrame, sizes) -> DataFrame:
    """EPOCH, n, i, x, size, block: every point of an epoch in the block of each size that holds it whole. All that follows is keyed by the epoch, so this is the one shuffle."""
    x = epochs.repartition(*EPOCH).withColumn("n", F.size("xs")).withColumn("sizes", sizes(F.col("n")))
    x = x.select(*EPOCH, "n", "sizes", F.posexplode("xs").alias("i", "x"))
    return x


def _blocks(x: DataFrame) -> DataFrame:
    x = x.withColumn("size", F.explode("sizes")).withColumn("block", F.floor(F.col("i") / F.col("size")))
    return x.where((F.col("block") + 1) * F.col("size") <= F.col("n")).drop("sizes")


@F.pandas_udf(LINE)
def _rescaled(xs: pd.Series, sizes: pd.Series) -> pd.DataFrame:
    """The line through log10 of the mean rescaled range of each size of blocks, and the number of sizes that have one; an epoch at a time."""
    out = []
    for v, some in zip(xs, sizes):
        v, lx, ly = np.asarray(v, float), [], []
        for size in np.unique(some).tolist():
            k = len(v) // size
            step = np.diff(v[: k * size].reshape(k, size), axis=1)
            step = step[step.max(1) > step.min(1)] if size > 2 else step[:0]
            if len(step):
                z = np.cumsum(step - step.mean(1, keepdims=True), axis=1)
                lx.append(np.log10(size))
                ly.append(np.log10(((z.max(1) - z.min(1)) / step.std(1, ddof=1)).mean()))
        x, y = np.array(lx), np.array(ly)
        slope = ((x - x.mean()) * (y - y.mean())).mean() / x.var() if len(x) > 1 else np.nan
        out.append((slope, y.mean() - slope * x.mean() if len(x) else np.nan, len(x)))
    return pd.DataFrame(out, columns=["slope", "intercept", "n"])


def hurst(epochs: DataFrame, min_window: int = 10) -> DataFrame:
    """EPOCH, hurst, constant: slope and 10 ^ intercept of log10 of the mean rescaled range by log10 of the block size, for a random walk.

    Sizes go from min_window in quarter powers of ten to below the epoch's length less one, and that length. A block's
    range is that of the running sum of its steps less their mean, its scale their sample deviation; blocks of equal steps
    are left out. Epochs shorter than min_window + 2, or with a null, give none; NaN or infinite values give NaN. An epoch
    is worked out in its own row: no row a point, no shuffle.
    """
    n = F.size("xs")
    powers = F.transform(F.sequence(F.lit(0), F.lit(80)), lambda k: F.log10(F.lit(float(min_window))) + 0.25 * k)
    sizes = F.concat(F.transform(F.filter(powers, lambda e: e < F.log10((n - 1).cast("double")) - 1e-12), lambda e: F.floor(F.pow(F.lit(10.0), e) + 1e-9).cast("int")), F.array(n))
    some = epochs.where((n >= min_window + 2) & ~F.exists("xs", lambda v: v.isNull()))
    odd = F.exists("xs", lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
    line = some.select(*EPOCH, odd.alias("odd"), _rescaled(F.when(odd, F.array().cast("array<double>")).otherwise(F.col("xs").cast("array<double>")), F.when(odd, F.array().cast("array<int>")).otherwise(sizes)).alias("r"))
    nan = lambda c: F.when(F.col("odd"), float("nan")).otherwise(c)
    return line.where((F.col("r.n") > 0) | F.col("odd")).select(*EPOCH, nan(F.col("r.slope")).alias("hurst"), nan(F.pow(F.lit(10.0), F.col("r.intercept"))).alias("constant"))


def dfa(epochs: DataFrame, least: int = 4, share: float = 0.1, factor: float = 1.2) -> DataFrame:
    """EPOCH, dfa: slope of the logarithm of the fluctuation by that of the block size.

    The walk is the running sum of the epoch less its mean; in each block a line is fitted, whose squared residuals follow
    from the block's sums; the fluctuation of a size is the root of their mean. Sizes go from `least` by `factor` to a
    `share` of the epoch, as whole numbers. Epochs with a null, and those too short for two sizes, give none or null.
    """
    def sizes(n):
        steps = F.floor(F.ln(share * n / least) / F.ln(F.lit(factor)) + 1e-12).cast("int")
        more = F.transform(F.sequence(F.lit(0), F.greatest(steps, F.lit(0))), lambda k: F.floor(least * F.pow(F.lit(factor), k) + 1e-9).cast("int"))
        return F.when(share * n >= least, F.array_distinct(more)).otherwise(F.array(F.lit(least)))

    x = _rows(epochs.where(~F.exists("xs", lambda v: v.isNull())), sizes)
    run = Window.partitionBy(*EPOCH).orderBy("i")
    x = x.withColumn("d", F.col("x") - F.avg("x").over(Window.partitionBy(*EPOCH))).withColumn("walk", F.sum("d").over(run))
    at = (F.col("i") % F.col("size")).cast("double")
    each = _blocks(x).groupBy(*EPOCH, "size", "block").agg((F.regr_syy("walk", at) - F.try_divide(F.pow(F.regr_sxy("walk", at), F.lit(2.0)), F.regr_sxx("walk", at))).alias("sse"))
    f = each.groupBy(*EPOCH, "size").agg(F.sqrt(F.avg(F.greatest("sse", F.lit(0.0)) / F.col("size"))).alias("f")).where("f > 0")
    return f.groupBy(*EPOCH).agg(F.regr_slope(F.ln("f"), F.ln("size")).alias("dfa"))
