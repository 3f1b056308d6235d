"""Complex spectra of packed epochs, and what pairs of channels make of them.

Epochs are rows (subject, state, channel, epoch, xs); xs has a bounded length. Tapers are rows (j, h, w): number, values
and weight. A coefficient is a struct (re, im); those of one epoch, taper and channel are one array.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.scalar import STANDARD_BANDS, band_of
from .spectral import KEY

#: Values of tapers that may be broadcast: 8 MB.
MOST_VALUES = 1 << 20
#: Epochs that are transformed at once.
PART = 1024
COEFFICIENTS = StructType([StructField("re", ArrayType(DoubleType())), StructField("im", ArrayType(DoubleType()))])
PAIR = ["subject", "state", "a", "b"]


def sine_tapers(spark: SparkSession, n: int, k: int) -> DataFrame:
    """The first k sine tapers of n points, orthogonal and of unit energy, each of weight 1."""
    i, j = F.sequence(F.lit(1), F.lit(n)), F.col("j")
    h = F.transform(i, lambda i: math.sqrt(2 / (n + 1)) * F.sin(math.pi * (j + 1) * i / (n + 1)))
    return spark.range(k).select(F.col("id").cast("int").alias("j"), h.alias("h"), F.lit(1.0).alias("w"))


def hann_taper(spark: SparkSession, n: int) -> DataFrame:
    """One periodic Hann taper of unit energy, whose sum of squares would be 3 n / 8."""
    h = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (0.5 - 0.5 * F.cos(2 * math.pi * i / n)) / math.sqrt(0.375 * n))
    return spark.range(1).select(F.col("id").cast("int").alias("j"), h.alias("h"), F.lit(1.0).alias("w"))


@F.arrow_udf(COEFFICIENTS)
def _transform(xs: pa.Array) -> pa.Array:
    """Coefficients 0 to n / 2 of each array, all of one length together, on the batch's own buffers: no object a row."""
    sizes, values = pc.list_value_length(xs).to_numpy(zero_copy_only=False), xs.flatten().to_numpy(zero_copy_only=False)
    starts, many = np.cumsum(sizes) - sizes, np.where(sizes > 0, sizes // 2 + 1, 0)
    cuts = np.append(0, np.cumsum(many))
    re, im = np.empty(cuts[-1]), np.empty(cuts[-1])
    for n in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == n)
        for part in (rows[a : a + PART] for a in range(0, len(rows), PART)):
            c = np.fft.rfft(values[starts[part][:, None] + np.arange(n)], axis=1)
            to = cuts[part][:, None] + np.arange(n // 2 + 1)
            re[to], im[to] = c.real, c.imag
    offsets = pa.array(cuts, pa.int32())
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (re, im)], ["re", "im"])


def dft(epochs: DataFrame, tapers: DataFrame | None = None, centre: bool = True) -> DataFrame:
    """epochs' columns but xs, with j, w, n and coef: the coefficients 0 to n / 2 of each epoch times each taper of its length; without tapers, of the epoch itself.

    centre takes the epoch's mean off before. Epochs with a null value, or of a length that no taper has, are left out.
    The tapers are broadcast, so they may have MOST_VALUES values at most.
    """
    mean = F.aggregate("xs", F.lit(0.0), lambda s, v: s + v) / F.size("xs")
    x = epochs.where(F.col("xs").isNotNull() & ~F.exists("xs", lambda v: v.isNull()))
    x = x.withColumn("xs", F.transform("xs", lambda v: v - mean) if centre else F.col("xs").cast("array<double>")).withColumn("n", F.size("xs"))
    if tapers is None:
        x = x.withColumns({"j": F.lit(0), "w": F.lit(1.0)})
    else:
        held = tapers.agg(F.sum(F.size("h"))).first()[0] or 0
        if held > MOST_VALUES:
            raise ValueError(f"tapers of {held} values, more than {MOST_VALUES}, can't be broadcast")
        x = x.join(F.broadcast(tapers.select("j", "h", "w", F.size("h").alias("n"))), "n").withColumn("xs", F.zip_with("xs", "h", lambda a, b: a * b))
    c = x.withColumn("c", _transform("xs"))
    return c.select(*[k for k in epochs.columns if k != "xs"], "j", "w", "n", F.arrays_zip("c.re", "c.im").alias("coef"))


def multitaper_psd(coefs: DataFrame, fs: float = 1.0) -> DataFrame:
    """k, freq, power of each series: one-sided density from its epochs' coefficients, the squares of all tapers by the squares of their weights; one aggregate, since all epochs have the same tapers."""
    x = coefs.select(*KEY, "n", "w", F.posexplode("coef").alias("k", "c"))
    sides = F.when((F.col("k") == 0) | (2 * F.col("k") == F.col("n")), 1.0).otherwise(2.0)
    square = F.col("c.re") * F.col("c.re") + F.col("c.im") * F.col("c.im")
    g = x.groupBy(*KEY, "n", "k").agg(F.try_divide(F.sum(sides * square * F.col("w") * F.col("w")), fs * F.sum(F.col("w") * F.col("w"))).alias("power"))
    return g.select(*KEY, "k", (F.col("k") * fs / F.col("n")).alias("freq"), "power")


def cross_spectra(coefs: DataFrame) -> DataFrame:
    """subject, state, epoch, a, b, n, k, re, im, pa, pb: of each epoch and pair of channels a < b, the sum over tapers of X_a conj(X_b), and of both powers.

    Pairs are made within an epoch's own list of channels, whose number is bounded; one shuffle by epoch.
    """
    by = ["subject", "state", "epoch", "n", "j", "w"]
    here = coefs.repartition("subject", "state", "epoch").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("channel", "coef"))).alias("v"))
    one = here.select(*by, "v", F.posexplode("v").alias("i", "a"))
    two = one.select(*by, "a", F.explode(F.slice("v", F.col("i") + 2, F.size("v"))).alias("b"))
    bins = two.select(*by, F.col("a.channel").alias("a"), F.col("b.channel").alias("b"), F.posexplode(F.arrays_zip(F.col("a.coef").alias("x"), F.col("b.coef").alias("y"))).alias("k", "c"))
    xr, xi, yr, yi, ww = F.col("c.x.re"), F.col("c.x.im"), F.col("c.y.re"), F.col("c.y.im"), F.col("w") * F.col("w")
    sums = {"re": xr * yr + xi * yi, "im": xi * yr - xr * yi, "pa": xr * xr + xi * xi, "pb": yr * yr + yi * yi}
    return bins.groupBy("subject", "state", "epoch", "a", "b", "n", "k").agg(*[F.sum(ww * v).alias(c) for c, v in sums.items()])


def _in_bands(pairs: DataFrame, fs: float, bands: list[tuple[float, float]]) -> DataFrame:
    return pairs.withColumn("band_id", F.explode(band_of(F.col("k") * fs / F.col("n"), bands)))


def _coherency(cross: DataFrame) -> DataFrame:
    """PAIR, n, k, re, im: the averaged cross spectrum over the root of both averaged powers; null where a channel has none."""
    g = cross.groupBy(*PAIR, "n", "k").agg(*[F.sum(c).alias(c) for c in ("re", "im", "pa", "pb")])
    root = F.sqrt(F.col("pa") * F.col("pb"))
    return g.select(*PAIR, "n", "k", F.try_divide("re", root).alias("re"), F.try_divide("im", root).alias("im"))


def pair_coherence(cross: DataFrame, fs: float = 1.0, bands: list[tuple[float, float]] = STANDARD_BANDS) -> DataFrame:
    """PAIR, band_id, coherence: magnitude-squared coherence over all epochs, its mean over a band's bins."""
    c = _in_bands(_coherency(cross), fs, bands)
    return c.groupBy(*PAIR, "band_id").agg(F.avg(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("coherence"))


def pair_phase_locking(cross: DataFrame, fs: float = 1.0, bands: list[tuple[float, float]] = STANDARD_BANDS) -> DataFrame:
    """PAIR, band_id, plv, pli: the length of the mean unit phasor over epochs, and the mean sign of the imaginary part without its sign; means over a band's bins. Epochs without power in a bin are left out there, and so are the first bin and that of half the rate, whose coefficients are real."""
    cross = cross.where("k > 0 AND 2 * k < n")
    size = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    mean = lambda c: F.avg(F.try_divide(F.col(c), size))
    g = cross.groupBy(*PAIR, "n", "k").agg(mean("re").alias("u"), mean("im").alias("v"), F.avg(F.when(size > 0, F.signum("im"))).alias("s"))
    x = _in_bands(g, fs, bands)
    return x.groupBy(*PAIR, "band_id").agg(F.avg(F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v"))).alias("plv"), F.avg(F.abs("s")).alias("pli"))


def pair_phase(cross: DataFrame, fs: float = 1.0, bands: list[tuple[float, float]] = STANDARD_BANDS) -> DataFrame:
    """PAIR, band_id, phase: angle of the mean coherency over a band's bins, in degrees by the band's width; (b, a) has the opposite sign of (a, b)."""
    width = F.element_at(F.array(*[F.lit(hi - lo) for lo, hi in bands]), F.col("band_id") + 1)
    g = _in_bands(_coherency(cross), fs, bands).groupBy(*PAIR, "band_id").agg(F.avg("re").alias("re"), F.avg("im").alias("im"))
    both = F.explode(F.array(F.struct(F.col("a"), F.col("b"), F.col("im")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), (-F.col("im")).alias("im")))).alias("p")
    return g.select("subject", "state", "band_id", "re", both).select("subject", "state", "p.a", "p.b", "band_id", (F.degrees(F.atan2("p.im", "re")) / width).alias("phase"))


def pack(samples: DataFrame, n: int, step: int | None = None) -> DataFrame:
    """KEY, epoch, xs of all whole windows of n samples that begin every `step` ones; a sample goes to each window that holds it, without a join."""
    step = step or n
    first, last = F.greatest(F.floor((F.col("t_idx") - n) / step) + 1, F.lit(0)), F.floor(F.col("t_idx") / step)
    rows = samples.withColumn("epoch", F.explode(F.sequence(first, last)))
    xs: Column = F.transform(F.array_sort(F.collect_list(F.struct("t_idx", "x"))), lambda v: v["x"])
    return rows.groupBy(*KEY, "epoch").agg(xs.alias("xs")).where(F.size("xs") == n)
