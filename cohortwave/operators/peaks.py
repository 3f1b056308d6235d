"""Peaks and knees of power spectra, on long rows (subject, state, channel, k, freq, power)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spectral import KEY, aperiodic_fixed, in_bands


def line_noise_peaks(spectrum: DataFrame, harmonics: list[float], prominence: float = 0.5, near: float = 0.05) -> DataFrame:
    """KEY, k, freq, prominence, width, lo, hi of the peaks of log10 power within `near` of a harmonic.

    A peak is higher than what stands beside it; of equal neighbours it is the middle one (the left of two). Its prominence
    is its height over the higher of the two lowest points between it and the next higher bin, or the end, on either
    side. Width is that of the power, not its logarithm, in bins between the two crossings of the half of its own
    prominence, interpolated; lo and hi are the frequencies a whole number of bins away. Bins are numbered by k within
    a series, which is one row: a spectrum's length is bounded. Only bins near a harmonic are looked at.
    """
    g = spectrum.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("k", "freq", "power"))).alias("s"))
    g = g.select(*KEY, F.col("s.k").alias("ks"), F.col("s.freq").alias("f"), F.col("s.power").alias("p"), F.transform("s.power", lambda v: F.log10(v)).alias("v"), F.size("s").alias("n"))
    # numpy's closeness: the absolute part of 1e-8 too
    close = lambda f: F.array_max(F.array(*[F.abs(f - F.lit(float(h))) <= 1e-8 + near * abs(h) for h in harmonics]))
    at = F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: close(F.element_at("f", i)))
    x = g.withColumn("i", F.explode(at))
    here = lambda a: F.element_at(a, F.col("i"))
    # an ascending sequence has one end at least, so those beyond the ends are filtered out
    every = F.sequence(F.lit(1), F.col("n"))
    before, after = F.filter(every, lambda j: j < F.col("i")), F.filter(every, lambda j: j > F.col("i"))
    x = x.where("i > 1 AND i < n").withColumns({"before": before, "after": after})

    def nearest(side: str, test, column: str):
        """The nearest bin on a side that passes, null if none does."""
        found = F.filter(side, lambda j: test(F.element_at(column, j)))
        return (F.array_max if side == "before" else F.array_min)(found)

    differs = lambda v: v != here("v")
    x = x.withColumns({"l": nearest("before", differs, "v"), "r": nearest("after", differs, "v")})
    lower = (F.element_at("v", F.col("l")) < here("v")) & (F.element_at("v", F.col("r")) < here("v"))
    x = x.where(F.col("l").isNotNull() & F.col("r").isNotNull()).where(lower & (F.col("i") == F.floor((F.col("l") + F.col("r")) / 2)))

    def rise(column: str):
        """Height over the higher base, and the bins where the search for the bases ends."""
        higher = lambda v: v > here(column)
        left, right = F.coalesce(nearest("before", higher, column) + 1, F.lit(1)), F.coalesce(nearest("after", higher, column) - 1, F.col("n"))
        base = lambda a, b: F.array_min(F.slice(column, a, b - a + 1))
        return here(column) - F.greatest(base(left, F.col("i")), base(F.col("i"), right)), left, right

    in_log, _, _ = rise("v")
    in_power, left, right = rise("p")
    x = x.withColumns({"prominence": in_log, "height": here("p") - in_power * 0.5, "left": left, "right": right}).where(F.col("prominence") >= prominence)
    # the last bin at or below the height on either side, and the crossing between it and the next
    under = lambda v: v <= F.col("height")
    lo, hi = F.coalesce(F.greatest(nearest("before", under, "p"), F.col("left")), F.col("left")), F.coalesce(F.least(nearest("after", under, "p"), F.col("right")), F.col("right"))
    x = x.withColumns({"a": lo, "b": hi})

    def crossing(j, step: int):
        p, q = F.element_at("p", j), F.element_at("p", F.when((j + step >= 1) & (j + step <= F.col("n")), j + step).otherwise(j))
        return F.when(p < F.col("height"), step * F.coalesce(F.try_divide(F.col("height") - p, q - p), F.lit(0.0))).otherwise(0.0) + j

    width = crossing(F.col("b"), -1) - crossing(F.col("a"), 1)
    x = x.withColumn("width", width)
    end = lambda i: F.element_at("f", F.greatest(F.least(i, F.col("n")), F.lit(1)).cast("int"))
    # positions count from 0 when they are cut to whole numbers
    whole = lambda v: F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v)) + 1
    return x.select(*KEY, here("ks").alias("k"), here("f").alias("freq"), "prominence", "width", end(whole(F.col("i") - 1 - F.col("width"))).alias("lo"), end(whole(F.col("i") - 1 + F.col("width"))).alias("hi"))


def aperiodic_knee(spectrum: DataFrame, lo: float, hi: float, knees: list[float], exponents: list[float]) -> DataFrame:
    """KEY, offset, knee, exponent, mse of log10 P = offset - log10(knee + f ^ exponent), the least squares over the grid.

    At a grid point the best offset is the mean of log10 P + log10(knee + f ^ exponent) and the error is its variance, so
    one aggregate holds the sums of all points. Grid points where knee + f ^ exponent is not positive everywhere are left out. Of equal errors the
    least knee, then exponent, is taken.
    """
    grid = F.array(*[F.struct(F.lit(float(b)).alias("knee"), F.lit(float(e)).alias("exponent")) for b in knees for e in exponents])
    x = spectrum.where(F.col("freq").between(lo, hi) & (F.col("power") > 0)).select(*KEY, "freq", F.log10("power").alias("lp"), F.explode(grid).alias("g"))
    inner = F.col("g.knee") + F.pow("freq", F.col("g.exponent"))
    r = F.col("lp") + F.when(inner > 0, F.log10(inner))
    sums = x.groupBy(*KEY, "g").agg(F.avg(r).alias("offset"), F.var_pop(r).alias("mse"), F.count("*").alias("n"), F.count(r).alias("ok")).where("ok = n")
    best = F.min_by(F.struct("offset", "g.knee", "g.exponent", "mse"), F.struct("mse", "g.knee", "g.exponent"))
    return sums.groupBy(*KEY).agg(best.alias("b")).select(*KEY, "b.*")


def band_peaks(spectrum: DataFrame, lo: float, hi: float, bands: list[tuple[float, float]], keep: float = 0.00025) -> DataFrame:
    """KEY, band_id, center, height, width: in each band the bin that stands highest above the aperiodic line, by how much in log10 power, and the root of the second moment about it of what stands above the line.

    The moment follows from sums over the band, so the bins are read once. Of equal heights the lowest frequency is
    taken; where nothing stands above the line, width is null.
    """
    fit = aperiodic_fixed(spectrum, lo, hi, keep).select(*KEY, "offset", "exponent")
    x = spectrum.where(F.col("freq").between(lo, hi)).join(fit, KEY)
    x = in_bands(x.withColumn("r", F.log10("power") - F.col("offset") + F.col("exponent") * F.log10("freq")), bands)
    # bins that the line was fitted to are on it but for rounding
    up, f = F.when(F.col("r") > 1e-9, F.col("r")).otherwise(0.0), F.col("freq")
    g = x.groupBy(*KEY, "band_id").agg(F.max(F.struct("r", (-f).alias("f"))).alias("top"), F.sum(up).alias("s0"), F.sum(up * f).alias("s1"), F.sum(up * f * f).alias("s2"))
    c = -F.col("top.f")
    moment = F.try_divide(F.col("s2") - 2 * c * F.col("s1") + c * c * F.col("s0"), "s0")
    return g.select(*KEY, "band_id", c.alias("center"), F.col("top.r").alias("height"), F.sqrt(F.when(moment < 0, 0.0).otherwise(moment)).alias("width"))
