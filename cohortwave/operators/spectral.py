"""Features of power spectra, on long rows (subject, state, channel, k, freq, power)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import STANDARD_BANDS, band_of, corr

KEY = ["subject", "state", "channel"]


def periodogram(epochs: DataFrame, fs: float = 1.0) -> DataFrame:
    """k, freq, power of the mean Hann periodogram of each series from its packed epochs (KEY, epoch, xs): one-sided density, the mean of an epoch taken off.

    An epoch is an array of bounded length, and its sums over sines run inside the row: no row an epoch, sample and frequency is made.
    """
    n = F.size("xs")
    mean = F.aggregate("xs", F.lit(0.0), lambda a, x: a + x) / n
    taper = lambda i: 0.5 - 0.5 * F.cos(2 * math.pi * i / F.col("n"))
    x = epochs.select(*KEY, n.alias("n"), F.transform("xs", lambda v, i: v - mean).alias("xs")).select(*KEY, "n", F.transform("xs", lambda v, i: v * taper(i)).alias("xs"))
    x = x.select(*KEY, "n", "xs", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / 2).cast("int"))).alias("k"))
    part = lambda f: F.aggregate(F.transform("xs", lambda v, i: v * f(2 * math.pi * F.col("k") * i / F.col("n"))), F.lit(0.0), lambda a, b: a + b)
    sides = F.when((F.col("k") == 0) | (2 * F.col("k") == F.col("n")), 1.0).otherwise(2.0)
    # the sum of squares of a periodic Hann window of n points is 3 n / 8
    power = sides * (F.pow(part(F.cos), F.lit(2.0)) + F.pow(part(F.sin), F.lit(2.0))) / (fs * 0.375 * F.col("n"))
    return x.select(*KEY, "k", (F.col("k") * fs / F.col("n")).alias("freq"), power.alias("p")).groupBy(*KEY, "k", "freq").agg(F.avg("p").alias("power"))


def average_segments(spectra: DataFrame, which: str = "avg") -> DataFrame:
    """Mean power of the segments of a state, by their durations, or the 'first' or 'second' one's; spectra: subject, channel, state, segment, duration, k, freq, power."""
    if which != "avg":
        return spectra.where(F.col("segment") == {"first": 1, "second": 2}[which]).select(*KEY, "k", "freq", "power")
    return spectra.groupBy(*KEY, "k", "freq").agg(F.try_divide(F.sum(F.col("power") * F.col("duration")), F.sum("duration")).alias("power"))


def in_bands(spectrum: DataFrame, bands: list[tuple[float, float]]) -> DataFrame:
    """A row for each band that holds a bin. The bands are a constant of a few entries: an expression, not a join."""
    return spectrum.withColumn("band_id", F.explode(band_of(F.col("freq"), bands)))


def band_stats(spectrum: DataFrame, bands: list[tuple[float, float]] = STANDARD_BANDS) -> DataFrame:
    """Statistics of log10 power in each band, without the first and the last bin of a spectrum; one scan, one shuffle."""
    ends = Window.partitionBy(*KEY)
    inner = spectrum.withColumns({"first": F.min("k").over(ends), "last": F.max("k").over(ends)}).where("k > first AND k < last")
    lp = F.log10("power")
    x = in_bands(inner, bands).withColumn("lp", lp)
    q = F.percentile("lp", F.array(*[F.lit(v) for v in (0.25, 0.5, 0.75)]))
    out = x.groupBy(*KEY, "band_id").agg(
        F.count("lp").alias("n"), F.avg("lp").alias("avg"), F.sum("lp").alias("sum"), F.max("lp").alias("max"), F.min("lp").alias("min"), F.stddev_pop("lp").alias("std"), F.var_pop("lp").alias("var"), q.alias("q")
    )
    return out.select(*KEY, "band_id", "n", "avg", "sum", "max", "min", "std", "var", F.col("q")[0].alias("p25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p75"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"))


def band_shapes(spectrum: DataFrame, levels: list[float], bands: list[tuple[float, float]] = STANDARD_BANDS) -> DataFrame:
    """n, skew and a percentile pNN for each level (in percent) of log10 power in each band, without the first and the last bin; the skew is that of the population."""
    ends = Window.partitionBy(*KEY)
    inner = spectrum.withColumns({"first": F.min("k").over(ends), "last": F.max("k").over(ends)}).where("k > first AND k < last")
    x = in_bands(inner, bands).withColumn("lp", F.log10("power"))
    g = x.groupBy(*KEY, "band_id").agg(F.count("lp").alias("n"), F.skewness("lp").alias("skew"), F.percentile("lp", F.array(*[F.lit(v / 100) for v in levels])).alias("q"))
    return g.select(*KEY, "band_id", "n", "skew", *[F.col("q")[i].alias(f"p{v:g}") for i, v in enumerate(levels)])


def welch(samples: DataFrame, nperseg: int, noverlap: int, fs: float = 1.0, fmin: float = 0.0, fmax: float | None = None) -> DataFrame:
    """k, freq, power of each series of samples: the mean Hann periodogram of its windows of nperseg samples that share noverlap, from fmin to fmax."""
    from .fourier import dft, hann_taper, multitaper_psd, pack

    psd = multitaper_psd(dft(pack(samples, nperseg, nperseg - noverlap), hann_taper(samples.sparkSession, nperseg)), fs)
    return psd.where(F.col("freq").between(fmin, fs / 2 if fmax is None else fmax))


def band_ratios(stats: DataFrame, value: str = "avg") -> DataFrame:
    """Each higher band over each lower one, pairs made within the group's own array of bands: no self join."""
    g = stats.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("band_id", F.col(value).alias("v")))).alias("b"))
    hi = g.select(*KEY, "b", F.explode("b").alias("h"))
    pairs = hi.select(*KEY, "h", F.explode(F.filter("b", lambda l: l["band_id"] < F.col("h.band_id"))).alias("l"))
    return pairs.select(*KEY, F.col("h.band_id").alias("high"), F.col("l.band_id").alias("low"), F.try_divide("h.v", "l.v").alias("ratio"))


def power_percentiles(spectrum: DataFrame, levels: list[float], by: list[str] = KEY) -> DataFrame:
    """Percentiles of log10 power at many levels from one aggregate."""
    p = spectrum.groupBy(*by).agg(F.percentile(F.log10("power"), F.array(*map(F.lit, levels))).alias("p"))
    return p.select(*by, F.posexplode("p").alias("j", "value"))


def roi_percentiles(spectrum: DataFrame, rois: dict[str, list[str]], levels: list[float]) -> DataFrame:
    """Percentiles over all channels of a region; a channel may be in many."""
    of = F.array_compact(F.array(*[F.when(F.col("channel").isin(c), F.lit(r)) for r, c in rois.items()]))
    return power_percentiles(spectrum.withColumn("roi", F.explode(of)), levels, ["subject", "state", "roi"])


def cumulative_power(spectrum: DataFrame) -> DataFrame:
    """Running integral over frequency by the trapezoid rule."""
    w = Window.partitionBy(*KEY).orderBy("k")
    area = (F.col("freq") - F.lag("freq").over(w)) * (F.col("power") + F.lag("power").over(w)) / 2
    return spectrum.withColumn("area", F.coalesce(area, F.lit(0.0))).withColumn("cum", F.sum("area").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def integrate(spectrum: DataFrame) -> DataFrame:
    """Definite integral by Simpson's end-corrected sum of third order on an even grid: weights 3/8, 7/6, 23/24 from either end."""
    up, down = Window.partitionBy(*KEY).orderBy("k"), Window.partitionBy(*KEY).orderBy(F.desc("k"))
    x = spectrum.withColumns({"i": F.row_number().over(up), "j": F.row_number().over(down)})
    m = F.least("i", "j")
    weight = F.when(m == 1, 3.0 / 8).when(m == 2, 7.0 / 6).when(m == 3, 23.0 / 24).otherwise(1.0)
    step = (F.max("freq") - F.min("freq")) / (F.count("*") - 1)
    return x.groupBy(*KEY).agg((F.sum(weight * F.col("power")) * step).alias("integral"))


#: End corrections of integration on an even grid, by order; each end's values, the outermost first, times these, over the divisor.
END_CORRECTIONS = {
    1: ((-1,), 2), 2: ((-15, 4, -1), 24), 3: ((-16, 7, -4, 1), 24), 4: ((-965, 462, -336, 146, -27), 1440), 5: ((-981, 542, -496, 306, -107, 16), 1440),
    6: ((-84161, 55688, -66109, 57024, -31523, 9976, -1375), 120960), 7: ((-85376, 64193, -91624, 99549, -74048, 35491, -9880, 1215), 120960),
}


def integrate_corrected(spectrum: DataFrame, order: int = 3) -> DataFrame:
    """Definite integral on an even grid by an end-corrected sum, exact for polynomials of up to `order`: 1 to 7, others the nearest of them.

    Bins are numbered by k from either end; a spectrum of fewer bins than corrections takes those that it has.
    """
    values, by = END_CORRECTIONS[max(1, min(7, order))]
    up, down = Window.partitionBy(*KEY).orderBy("k"), Window.partitionBy(*KEY).orderBy(F.desc("k"))
    x = spectrum.withColumns({"i": F.row_number().over(up), "j": F.row_number().over(down)})
    end = lambda n: sum((F.when(F.col(n) == q + 1, F.lit(v / by)).otherwise(0.0) for q, v in enumerate(values)), F.lit(0.0))
    step = F.try_divide(F.max("freq") - F.min("freq"), F.count("*") - 1)
    return x.groupBy(*KEY).agg((F.sum((1 + end("i") + end("j")) * F.col("power")) * step).alias("integral"))


def cumulative_cubic(spectrum: DataFrame) -> DataFrame:
    """Running integral over an even frequency grid by cubics through four bins: (-1, 13, 13, -1) / 24 within, (9, 19, -5, 1) / 24 at either end. Spectra of fewer than four bins give nulls beyond the first."""
    w = Window.partitionBy(*KEY).orderBy("k")
    p = lambda k: F.lag("power", k).over(w) if k >= 0 else F.lead("power", -k).over(w)
    x = spectrum.withColumns({"p_2": p(2), "p_1": p(1), "p0": F.col("power"), "p1": p(-1), "p2": p(-2), "_3": p(3), "step": F.col("freq") - F.lag("freq").over(w)})
    inner = (-F.col("p_2") + 13 * F.col("p_1") + 13 * F.col("p0") - F.col("p1")) / 24
    first = (9 * F.col("p_1") + 19 * F.col("p0") - 5 * F.col("p1") + F.col("p2")) / 24
    last = (9 * F.col("p0") + 19 * F.col("p_1") - 5 * F.col("p_2") + F.col("_3")) / 24
    area = F.when(F.col("p_1").isNull(), 0.0).when(F.col("p_2").isNull(), first).when(F.col("p1").isNull(), last).otherwise(inner) * F.coalesce("step", F.lit(0.0))
    return x.withColumn("area", area).select(*spectrum.columns, F.sum("area").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"))


def spectral_edges(spectrum: DataFrame, levels: list[float]) -> DataFrame:
    """First frequency at which the running power reaches each fraction of the total."""
    c = cumulative_power(spectrum).withColumn("total", F.max("cum").over(Window.partitionBy(*KEY)))
    return c.groupBy(*KEY).agg(*[F.min(F.when(F.col("cum") >= F.lit(q) * F.col("total"), F.col("freq"))).alias(f"edge_{j}") for j, q in enumerate(levels)])


def aperiodic_fixed(spectrum: DataFrame, lo: float, hi: float, keep: float = 0.00025) -> DataFrame:
    """Offset and exponent of log10 P = a - b log10 f: a fit, its residuals floored at 0, and a fit to the lowest share of them, 0.025 percent."""
    x = spectrum.where(F.col("freq").between(lo, hi)).withColumns({"lf": F.log10("freq"), "lp": F.log10("power")})
    w = Window.partitionBy(*KEY)
    x = x.withColumns({"s": F.regr_slope("lp", "lf").over(w), "i": F.regr_intercept("lp", "lf").over(w)})
    x = x.withColumn("flat", F.greatest(F.col("lp") - F.col("i") - F.col("s") * F.col("lf"), F.lit(0.0)))
    x = x.withColumn("cut", F.percentile("flat", F.lit(keep)).over(w)).where("flat <= cut")
    return x.groupBy(*KEY).agg(F.regr_intercept("lp", "lf").alias("offset"), (-F.regr_slope("lp", "lf")).alias("exponent"), F.count("*").alias("n"))


def fit_quality(spectrum: DataFrame, model: Column) -> DataFrame:
    """Squared correlation and errors of modelled against observed log power."""
    x = spectrum.withColumn("lp", F.log10("power")).withColumn("m", model)
    e = F.col("lp") - F.col("m")
    return x.groupBy(*KEY).agg(F.pow(corr("lp", "m"), 2).alias("r2"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"))


def fit_errors(spectrum: DataFrame, fits: DataFrame) -> DataFrame:
    """r2, mae, mse, rmse and mape (in percent of the observed) of each series' fitted line (KEY, offset, exponent) against its log10 power."""
    x = spectrum.join(fits.select(*KEY, "offset", "exponent"), KEY).withColumn("lp", F.log10("power")).withColumn("m", F.col("offset") - F.col("exponent") * F.log10("freq"))
    e = F.col("lp") - F.col("m")
    return x.groupBy(*KEY).agg(F.pow(corr("lp", "m"), 2).alias("r2"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), (100 * F.avg(F.try_divide(F.abs(e), F.abs("lp")))).alias("mape"))


def band_power(spectrum: DataFrame, bands: list[tuple[float, float]] = STANDARD_BANDS) -> DataFrame:
    """Sum of power in each half-open band [lo, hi)."""
    of = F.array_compact(F.array(*[F.when((F.col("freq") >= lo) & (F.col("freq") < hi), F.lit(i)) for i, (lo, hi) in enumerate(bands)]))
    return spectrum.withColumn("band_id", F.explode(of)).groupBy(*KEY, "band_id").agg(F.sum("power").alias("p"))


def relative_power(power: DataFrame) -> DataFrame:
    return power.withColumn("rel", F.try_divide(F.col("p"), F.sum("p").over(Window.partitionBy(*KEY))))


def mean_relative_power(power: DataFrame) -> DataFrame:
    """Each band's mean share of power over the channels of a subject and state."""
    return relative_power(power).groupBy("subject", "state", "band_id").agg(F.avg("rel").alias("mean_rel"))


def all_asymmetries(power: DataFrame, places: dict[str, tuple[int, float]]) -> DataFrame:
    """asymmetry of the root of power of every pair of placed channels (number, how far to the front), both ways round.

    Odd numbers are left. Channels of different sides give (left - right) / (left + right), of one side (front - back) /
    (front + back); of equal places the later one by name counts as in front. Pairs come from the group's own list.
    """
    side = F.coalesce(*[F.when(F.col("channel") == c, F.struct(F.lit(n % 2).alias("odd"), F.lit(float(y)).alias("y"))) for c, (n, y) in places.items()])
    g = power.where(F.col("channel").isin(*places)).groupBy("subject", "state", "band_id").agg(F.array_sort(F.collect_list(F.struct("channel", F.sqrt("p").alias("v"), side.alias("at")))).alias("c"))
    one = g.select("subject", "state", "band_id", "c", F.posexplode("c").alias("i", "a"))
    two = one.select("subject", "state", "band_id", "a", F.explode(F.slice("c", F.col("i") + 2, F.size("c"))).alias("b"))
    a_first = F.when(F.col("a.at.odd") != F.col("b.at.odd"), F.col("a.at.odd") == 1).otherwise(F.col("a.at.y") > F.col("b.at.y"))
    gap = F.when(a_first, F.col("a.v") - F.col("b.v")).otherwise(F.col("b.v") - F.col("a.v"))
    both = F.explode(F.array(F.struct(F.col("a.channel").alias("x"), F.col("b.channel").alias("y")), F.struct(F.col("b.channel").alias("x"), F.col("a.channel").alias("y")))).alias("p")
    return two.withColumn("asymmetry", F.try_divide(gap, F.col("a.v") + F.col("b.v"))).select("subject", "state", "band_id", both, "asymmetry").select("subject", "state", "band_id", F.col("p.x").alias("a"), F.col("p.y").alias("b"), "asymmetry")


def power_asymmetry(power: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(left - right) / (left + right) of the root of power, for channel pairs, from one group of a subject, state and band."""
    g = power.groupBy("subject", "state", "band_id").agg(F.map_from_entries(F.collect_list(F.struct("channel", F.sqrt("p").alias("v")))).alias("c"))
    made = F.explode(F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right")) for a, b in pairs])).alias("q")
    x = g.select("subject", "state", "band_id", "c", made).withColumns({"l": F.col("c")[F.col("q.left")], "r": F.col("c")[F.col("q.right")]})
    return x.select("subject", "state", "band_id", "q.left", "q.right", F.try_divide(F.col("l") - F.col("r"), F.col("l") + F.col("r")).alias("asymmetry"))


def band_sums(spectrum: DataFrame, bands: list[tuple[float, float]] = STANDARD_BANDS) -> DataFrame:
    return band_power(spectrum, bands).groupBy("subject", "band_id").agg(F.avg("p").alias("mean_power"))


def spectral_entropy(spectrum: DataFrame) -> DataFrame:
    """Shannon entropy of the power distribution over log2 of the bins, from sums alone: one aggregate, no window."""
    p = F.col("power")
    return spectrum.groupBy(*KEY).agg(((F.log2(F.sum("power")) - F.sum(p * F.log2(p)) / F.sum("power")) / F.log2(F.count("*").cast("double"))).alias("entropy"))


def bridge_noise(spectrum: DataFrame, ranges: list[tuple[float, float]], by: list[str]) -> DataFrame:
    """Bins inside a range (both ends inside) take the straight line, in logarithms, between the bins beside it. A group's edges are one aggregate."""
    edges = [f for k, (lo, hi) in enumerate(ranges) for f in (F.max(F.when(F.col("freq") < lo, F.struct("freq", "power"))).alias(f"_l{k}"), F.min(F.when(F.col("freq") > hi, F.struct("freq", "power"))).alias(f"_r{k}"))]
    power = F.col("power")
    for k, (lo, hi) in enumerate(ranges):
        left, right = F.col(f"_l{k}"), F.col(f"_r{k}")
        share = (F.ln("freq") - F.ln(left["freq"])) / (F.ln(right["freq"]) - F.ln(left["freq"]))
        line = F.exp(F.ln(left["power"]) + share * (F.ln(right["power"]) - F.ln(left["power"])))
        power = F.when(F.col("freq").between(lo, hi) & left.isNotNull() & right.isNotNull(), line).otherwise(power)
    return spectrum.join(spectrum.groupBy(*by).agg(*edges), by).select(*[power.alias("power") if c == "power" else F.col(c) for c in spectrum.columns])


def model_spectrum(params: DataFrame, step: float, n: int, by: list[str]) -> DataFrame:
    """log10 power at n frequencies from step on: offset - log10(knee + f ^ exponent) and the Gaussian peaks (cf, pw, bw) of each row."""
    f = params.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("freq", F.col("k") * step)
    bumps = F.aggregate("peaks", F.lit(0.0), lambda s, p: s + p["pw"] * F.exp(-F.pow(F.col("freq") - p["cf"], F.lit(2.0)) / (2 * p["bw"] * p["bw"])))
    return f.select(*by, "freq", (F.col("offset") - F.log10(F.col("knee") + F.pow("freq", "exponent")) + bumps).alias("log_power"))
