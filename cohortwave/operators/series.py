"""Shaping and conditioning of long sample tables (subject, channel, state, t_idx, x)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ["subject", "channel", "state"]
INSTANT = ["subject", "state", "t_idx"]


def crop(samples: DataFrame, intervals: DataFrame, fs: float = 1.0, bucket_s: float = 64.0) -> DataFrame:
    """Samples inside intervals of their subject, both ends included.

    An equi join on subject and time bucket with a residual filter: an interval meets only the buckets that it covers,
    so neither side needs to be small.
    """
    t = F.col("t_idx") / F.lit(fs)
    left = samples.withColumns({"t": t, "bucket": F.floor(t / bucket_s)})
    first, last = F.floor(F.col("t0") / bucket_s), F.floor(F.col("t1") / bucket_s)
    right = intervals.select("subject", F.col("state").alias("in_state"), "segment", "t0", "t1", F.explode(F.sequence(first, last)).alias("bucket"))
    return left.join(right, ["subject", "bucket"]).where("t BETWEEN t0 AND t1").drop("bucket")


def crop_fixed(samples: DataFrame, intervals: DataFrame, seconds: float, fs: float = 1.0) -> DataFrame:
    """Sample counts of the intervals that are exactly `seconds` long, and whether they are complete."""
    whole = intervals.where(F.col("t1") - F.col("t0") == seconds)
    return crop(samples, whole, fs).groupBy("subject", "channel", "state", "in_state", "segment").agg(F.count("*").alias("n")).withColumn("complete", F.col("n") == int(seconds * fs) + 1)


def resample(samples: DataFrame, every: int) -> DataFrame:
    """Mean of each `every` samples."""
    return samples.groupBy(*SERIES, F.floor(F.col("t_idx") / every).alias("t_idx")).agg(F.avg("x").alias("x"))


def upsample(samples: DataFrame, times: int) -> DataFrame:
    """`times` samples for each one, on the straight line to the next; the last one of a series stays alone. A segment makes its own points, no join."""
    w = Window.partitionBy(*SERIES).orderBy("t_idx")
    seg = samples.withColumns({"x1": F.lead("x").over(w), "t1": F.lead("t_idx").over(w)})
    last = F.col("t1").isNull()
    n = F.when(last, 1).otherwise((F.col("t1") - F.col("t_idx")) * times)
    seg = seg.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    value = F.when(last, F.col("x")).otherwise(F.col("x") + (F.col("x1") - F.col("x")) * F.col("i") / F.col("n"))
    return seg.select(*SERIES, (F.col("t_idx") * times + F.col("i")).alias("t_idx"), value.alias("x"))


def downsample_index(samples: DataFrame, num: int, method: str = "log", two_sided: bool = False) -> DataFrame:
    """The samples at num positions of each series, spread over its whole length evenly or by logarithm (from the start, or from the middle to both ends); positions that fall together count once.

    Series of num samples stay whole, shorter ones are left out.
    """
    n = F.col("_n")
    spread = lambda lo, hi, k: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: lo + (hi - lo) * i / max(k - 1, 1))
    whole = lambda v: F.floor(v + 1e-9).cast("long")
    if method == "linear":
        at = F.transform(spread(F.lit(0.0), n - 1, num), whole)
    elif method == "log" and not two_sided:
        at = F.transform(spread(F.lit(0.0), F.ln(n - 1), num), lambda e: whole(F.exp(e)))
    elif method == "log":
        middle = F.floor(n / 2)
        down = F.transform(spread(F.ln(middle - 1), F.lit(0.0), num // 2), lambda e: middle - whole(F.exp(e)))
        up = F.transform(spread(F.lit(0.0), F.ln(n - middle - 1), num // 2), lambda e: middle + whole(F.exp(e)))
        at = F.concat(down, up)
    else:
        raise ValueError("method is 'log' or 'linear'")
    lengths = samples.groupBy(*SERIES).agg(F.count("*").alias("_n")).where(n >= num)
    places = F.when(n == num, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array_distinct(at))
    return samples.join(lengths.select(*SERIES, F.explode(places).alias("t_idx")), [*SERIES, "t_idx"], "left_semi")


def freq_grid(kind: str, lo: float, hi: float | None, n: int, fs: float = 500.0) -> list[float]:
    """n even frequencies from lo to hi, or those of 2 n points spaced by logarithm over 0.2 to 600 that lie between, with both ends; hi is half the rate at most."""
    hi = fs / 2 if hi is None else min(hi, fs / 2)
    if kind == "linear":
        return [lo + (hi - lo) * k / (n - 1) for k in range(n)]
    if kind not in ("log", "log10"):
        raise ValueError("kind is 'linear', 'log' or 'log10'")
    points = [0.2 * (600 / 0.2) ** (k / (2 * n - 1)) for k in range(2 * n)]
    return sorted({lo, hi, *[f for f in points if lo <= f <= hi]})


def interpolate(curve: DataFrame, grid: list[float], by: list[str]) -> DataFrame:
    """by, g, freq, power: piecewise-linear values at the grid's frequencies, beyond either end along the outermost segment.

    A segment makes the grid points from its own frequency to below the next one's, so there is no join; the grid is a
    constant. Curves of one point give none.
    """
    w = Window.partitionBy(*by).orderBy("freq")
    seg = curve.withColumns({"f1": F.lead("freq").over(w), "p1": F.lead("power").over(w), "f_": F.lag("freq").over(w), "f2": F.lead("freq", 2).over(w)}).where("f1 IS NOT NULL")
    points = F.array(*[F.struct(F.lit(i).alias("g"), F.lit(float(f)).alias("f")) for i, f in enumerate(grid)])
    mine = F.filter(points, lambda q: (F.col("f_").isNull() | (q["f"] >= F.col("freq"))) & (F.col("f2").isNull() | (q["f"] < F.col("f1"))))
    seg = seg.withColumn("q", F.explode(mine))
    return seg.select(*by, "q.g", F.col("q.f").alias("freq"), (F.col("power") + (F.col("p1") - F.col("power")) * (F.col("q.f") - F.col("freq")) / (F.col("f1") - F.col("freq"))).alias("power"))


def band_limit(spectrum: DataFrame, lo: float, hi: float) -> DataFrame:
    """The bins from lo to hi, both inside; the filter reaches the scan."""
    return spectrum.where(F.col("freq").between(lo, hi))


def interpolate_to_grid(curve: DataFrame, step: float, by: list[str]) -> DataFrame:
    """Piecewise-linear values on multiples of step: each segment makes the grid points that it covers, no join."""
    w = Window.partitionBy(*by).orderBy("k")
    seg = curve.withColumns({"f1": F.lead("freq").over(w), "p1": F.lead("power").over(w)}).where("f1 IS NOT NULL")
    first, last = F.ceil(F.col("freq") / step), F.ceil(F.col("f1") / step) - 1
    seg = seg.where(first <= last).withColumn("g", F.explode(F.sequence(first, last)))
    f = F.col("g") * F.lit(step)
    return seg.select(*by, "g", (F.col("power") + (F.col("p1") - F.col("power")) * (f - F.col("freq")) / (F.col("f1") - F.col("freq"))).alias("power"))


def epochs(samples: DataFrame, window: int, step: int) -> DataFrame:
    """Each sample in every window that holds it: an explode, no join. The number of windows is floor((T - window) / step) + 1."""
    n = F.count("*").over(Window.partitionBy(*SERIES))
    x = samples.withColumn("n_epochs", F.floor((n - window) / step) + 1).where("n_epochs > 0")
    first = F.greatest(F.ceil((F.col("t_idx") - window + 1) / step), F.lit(0))
    last = F.least(F.floor(F.col("t_idx") / step), F.col("n_epochs") - 1)
    x = x.withColumns({"a": first, "b": last}).where("a <= b").withColumn("epoch", F.explode(F.sequence("a", "b")))
    return x.select(*SERIES, "epoch", (F.col("t_idx") - F.col("epoch") * step).alias("i"), "x")


def stack_epochs(epoched: DataFrame) -> DataFrame:
    """Epochs of both states in one numbering per subject and channel."""
    w = Window.partitionBy("subject", "channel").orderBy("state", "epoch")
    return epoched.select("subject", "channel", "state", "epoch").distinct().withColumn("stacked", (F.dense_rank().over(w) - 1).cast("long"))


def scale_fit(df: DataFrame, by: list[str], value: str = "x") -> DataFrame:
    """Centre and range of each scope, for the three methods."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    s = df.groupBy(*by).agg(q.alias("q"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    return s.select(*by, F.col("q")[1].alias("median"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"), "lo", "hi", "mean", "sd")


def scale_apply(df: DataFrame, params: DataFrame, by: list[str], method: str = "robust", value: str = "x") -> DataFrame:
    centre, width = {"robust": (F.col("median"), F.col("iqr")), "min_max": (F.col("lo"), F.col("hi") - F.col("lo")), "z_score": (F.col("mean"), F.col("sd"))}[method]
    return df.join(params, by).select(*df.columns, F.try_divide(F.col(value) - centre, width).alias("scaled"))


def log_rescale(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Standardised in log10 space, then 10 to the power of it."""
    w = Window.partitionBy(*by)
    lp = F.log10(value)
    return df.withColumn("rescaled", F.pow(F.lit(10.0), F.try_divide(lp - F.avg(lp).over(w), F.stddev_pop(lp).over(w))))


def reref_average(samples: DataFrame, exclude: list[str] = ()) -> DataFrame:
    """Less the mean of all channels at the instant; the excluded ones don't count and stay as they are."""
    out = F.col("channel").isin(*exclude) if exclude else F.lit(False)
    mean = F.avg(F.when(~out, F.col("x"))).over(Window.partitionBy(*INSTANT))
    return samples.withColumn("y", F.when(out, F.col("x")).otherwise(F.col("x") - mean))


def reref_leave_one_out(samples: DataFrame) -> DataFrame:
    """Less the mean of all other channels at the instant."""
    w = Window.partitionBy(*INSTANT)
    return samples.withColumn("y", F.col("x") - F.try_divide(F.sum("x").over(w) - F.col("x"), F.count("x").over(w) - 1))


def reref_channel(samples: DataFrame, refs: list[str]) -> DataFrame:
    """Less the mean of one or two reference channels: a conditional mean in the instant's window, no join."""
    return samples.withColumn("y", F.col("x") - F.avg(F.when(F.col("channel").isin(refs), F.col("x"))).over(Window.partitionBy(*INSTANT)))


def remix(samples: DataFrame, weights: dict[str, dict[str, float]]) -> DataFrame:
    """Weighted sums of channels, a new channel for each entry of weights; one aggregate for all."""
    sums = [F.sum(F.col("x") * sum((F.when(F.col("channel") == c, F.lit(v)).otherwise(0.0) for c, v in w.items()), F.lit(0.0))).alias(out) for out, w in weights.items()]
    return samples.groupBy(*INSTANT).agg(*sums)


def drop_refs(samples: DataFrame, refs: list[str]) -> DataFrame:
    return samples.where(~F.col("channel").isin(refs))


def append_channel(samples: DataFrame, other: DataFrame, channel: str) -> DataFrame:
    """samples with the rows of one channel of other, untouched, at the instants that samples have; a channel of that name is replaced."""
    instants = samples.select(*INSTANT).distinct()
    own = other.where(F.col("channel") == channel).join(instants, INSTANT, "left_semi").select(*samples.columns)
    return samples.where(F.col("channel") != channel).unionByName(own)


def regress_out(samples: DataFrame, ref: str, threshold: float) -> DataFrame:
    """Without the linear part of a reference channel, where the correlation with it is at least threshold."""
    x = samples.withColumn("r", F.max(F.when(F.col("channel") == ref, F.col("x"))).over(Window.partitionBy(*INSTANT)))
    w = Window.partitionBy(*SERIES)
    x = x.withColumns({"c": F.try_divide(F.regr_sxy("r", "x").over(w), F.sqrt(F.regr_sxx("r", "x").over(w) * F.regr_syy("r", "x").over(w))), "s": F.regr_slope("x", "r").over(w)})
    return x.withColumn("y", F.when((F.abs("c") >= threshold) & F.col("r").isNotNull() & (F.col("channel") != ref), F.col("x") - F.col("s") * F.col("r")).otherwise(F.col("x")))


def notch(spectrum: DataFrame, centres: list[float], width: float | list[float]) -> DataFrame:
    """Without the bins around the centres; a width for all of them or one each."""
    widths = [width] * len(centres) if isinstance(width, (int, float)) else width
    return spectrum.where(~_any([F.abs(F.col("freq") - c) <= w / 2 for c, w in zip(centres, widths, strict=True)]))


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def reref_combos(samples: DataFrame, n: int) -> DataFrame:
    """A channel for each n channels of an instant: their mean less the mean of the rest. Made from the instant's own array."""
    g = samples.groupBy(*INSTANT).agg(F.array_sort(F.collect_list(F.struct("channel", "x"))).alias("all"))
    g = g.withColumns({"total": F.aggregate("all", F.lit(0.0), lambda s, c: s + c["x"]), "some": F.expr("cast(array() as array<struct<channel:string,x:double>>)")})
    for _ in range(n):
        later = F.filter("all", lambda c: (F.size("some") == 0) | (c["channel"] > F.get("some", F.size("some") - 1)["channel"]))
        g = g.withColumn("next", F.explode(later)).withColumn("some", F.array_append("some", F.col("next"))).drop("next")
    own = F.aggregate("some", F.lit(0.0), lambda s, c: s + c["x"])
    return g.select(*INSTANT, F.array_join("some.channel", "+").alias("channel"), (own / n - F.try_divide(F.col("total") - own, F.size("all") - n)).alias("y"))


def reref_lateral(samples: DataFrame, side: str = "ipsi", refs: tuple[str, str] = ("A1", "A2")) -> DataFrame:
    """Less the reference of a channel's own side (odd number: left; even: right), of the other one for side='contra', of both for the midline. References go."""
    w = Window.partitionBy(*INSTANT)
    left, right = (F.avg(F.when(F.col("channel") == r, F.col("x"))).over(w) for r in (refs if side == "ipsi" else refs[::-1]))
    digit = F.regexp_extract("channel", "([0-9])$", 1)
    ref = F.when(digit == "", (left + right) / 2).when(digit.cast("int") % 2 == 1, left).otherwise(right)
    return samples.withColumn("y", F.col("x") - ref).where(~F.col("channel").isin(*refs))


def log_if(df: DataFrame, columns: list[str], every, some) -> DataFrame:
    """Logarithm of those columns whose values are all above 0, all meet `every` and of which one meets `some`; the others stay. One aggregate, a row to broadcast."""
    fits = [(F.bool_and(every(F.col(c))) & F.bool_or(some(F.col(c))) & F.bool_and(F.col(c) > 0)).alias(f"_fits_{c}") for c in columns]
    return df.join(F.broadcast(df.agg(*fits))).select(*[F.when(F.col(f"_fits_{c}"), F.ln(c)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])
