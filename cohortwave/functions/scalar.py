"""Column functions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def r6(c: Column | str, name: str) -> Column:
    """Rounded to six digits, with negative zero as zero."""
    c = F.col(c) if isinstance(c, str) else c
    return (F.round(c.cast("double"), 6) + F.lit(0.0)).alias(name)


def corr(a: Column | str, b: Column | str) -> Column:
    """Aggregate: Pearson correlation of the rows that have both values; null where one side is constant, which Spark's own raises an error for."""
    return F.try_divide(F.regr_sxy(b, a), F.sqrt(F.regr_sxx(b, a) * F.regr_syy(b, a)))


def symlog(x: Column, base: float = 10.0, eps: float = 1e-6) -> Column:
    """Logarithm that keeps the sign."""
    return F.signum(x) * F.ln(F.abs(x) + F.lit(eps)) / F.ln(F.lit(float(base)))


def with_ranks(df: DataFrame, by: list[str], value: str, out: str, buckets: int = 1024, weight: str | None = None) -> DataFrame:
    """df with the rank of value within by, ties at their mean; null where the value is. A row counts as `weight` rows, where that column is given.

    Equal values are counted first. The distinct ones fall into buckets of equal width, so that no window holds all of
    a key: the rank is the rows of the lower buckets, then those before the value in its own.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg((F.sum(weight) if weight else F.count("*")).alias("_n"))
    span = counts.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    place = F.coalesce(F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    counts = counts.join(span, by).withColumn("_bucket", F.floor(place * buckets)).drop("_lo", "_hi")
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.sum("_n").over(earlier(Window.partitionBy(*by, "_bucket").orderBy(value)))
    lower = F.sum("_m").over(earlier(Window.partitionBy(*by).orderBy("_bucket")))
    starts = counts.groupBy(*by, "_bucket").agg(F.sum("_n").alias("_m")).select(*by, "_bucket", F.coalesce(lower, F.lit(0)).alias("_start"))
    rank = F.col("_start") + F.coalesce(inside, F.lit(0)) + (F.col("_n") + 1) / F.lit(2.0)
    ranks = counts.join(starts, [*by, "_bucket"]).select(*by, value, rank.alias(out))
    return df.join(ranks, [*by, value], "left")


def band_of(freq: Column, bands: list[tuple[float, float]]) -> Column:
    """Numbers of the bands (both ends inside) that hold freq, as an array."""
    return F.array_compact(F.array(*[F.when(freq.between(lo, hi), F.lit(i)) for i, (lo, hi) in enumerate(bands)]))


#: The standard frequency bands in Hz, at 500 samples a second; the last ends at half of that.
STANDARD_BANDS = [(0.3, 1.5), (1.5, 4.0), (4.0, 8.0), (8.0, 12.0), (12.0, 30.0), (30.0, 70.0), (70.0, 150.0), (150.0, 250.0)]

#: The other published presets of bands in Hz.
BAND_PRESETS = {
    "standard": STANDARD_BANDS,
    "log-standard": [(0.2, 0.5), (0.5, 1 / 0.7), (1.5, 4), (4, 10), (10, 30), (30, 80), (80, 200), (200, 600)],
    "custom": [(0.3, 1.5), (1.5, 4), (4, 8), (8, 12.5), (12.5, 25), (25, 36), (36, 45), (45, 70), (70, 150), (150, 250)],
    "custom_low": [(0.3, 1.5), (1.5, 4), (4, 8), (8, 12.5), (12.5, 25), (25, 36), (36, 45), (45, 70), (70, 150)],
}


def bands(preset: str, divisions: int = 1, log: bool = False, fs: float = 500.0, min_freq: float = 0.3) -> list[tuple[float, float]]:
    """Bands of a preset, of `linear_N` (1 Hz each up to N, 50 without a number) or of `log_N` (six up to N, or four up to 50, even in the logarithm).

    Each is cut into so many, evenly or in the logarithm; those that end at min_freq or below, or begin at half the
    rate or above, are left out. The last standard band ends at half the rate.
    """
    def between(lo: float, hi: float, n: int, log: bool) -> list[tuple[float, float]]:
        cuts = [lo * (hi / lo) ** (k / n) if log else lo + (hi - lo) * k / n for k in range(n + 1)]
        return list(zip(cuts, cuts[1:]))

    kind, _, top = preset.partition("_")
    if preset in BAND_PRESETS:
        out = [(float(a), float(b)) for a, b in BAND_PRESETS[preset]]
        out = [*out[:-1], (out[-1][0], float(fs // 2))] if preset == "standard" else out
    elif kind == "linear":
        out = [(float(f), float(f + 1)) for f in range(int(top or 50))]
    elif kind == "log":
        out = between(1.0, float(top or 50), 6 if top else 4, True)
    else:
        raise ValueError(f"no preset {preset}")
    if divisions > 1:
        out = [part for a, b in out for part in between(a, b, divisions, log)]
    return [(a, b) for a, b in out if b > min_freq and a < fs // 2]
