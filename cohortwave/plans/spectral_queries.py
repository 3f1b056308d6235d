"""Queries of the spectral operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import r6
from ..operators import spectral as S
from ..sources import views as V
from ..sources.views import with_views

KEY = "subject, state, channel"
BANDS = "bands AS (SELECT unnest(range(8))::INT AS band_id, unnest([0.3, 1.5, 4, 8, 12, 30, 70, 150]::DOUBLE[]) AS lo, unnest([1.5, 4, 8, 12, 30, 70, 150, 250]::DOUBLE[]) AS hi)"
LEVELS = [0.1, 0.25, 0.5, 0.75, 0.9]
EDGES = [0.25, 0.5, 0.95]
ROIS = {"left": ["ch1", "ch3"], "right": ["ch0", "ch2", "ch4"], "front": ["ch0", "ch1"]}
PAIRS = [("ch1", "ch2"), ("ch3", "ch4")]


def sql(query: str, *ctes: str) -> str:
    base = with_views("", "spectrum").rstrip()
    return ", ".join([base, BANDS, *ctes]) + " " + query


INNER = "inner_bins AS (SELECT *, log10(power) AS lp FROM (SELECT *, min(k) OVER w AS a, max(k) OVER w AS b FROM spectrum WINDOW w AS (PARTITION BY subject, state, channel)) WHERE k > a AND k < b)"
STATS = f"stats AS (SELECT {KEY}, band_id, avg(lp) AS v FROM inner_bins JOIN bands ON freq BETWEEN lo AND hi GROUP BY ALL)"
POWER = f"bp AS (SELECT {KEY}, band_id, sum(power) AS p FROM spectrum JOIN bands ON freq >= lo AND freq < hi GROUP BY ALL)"
CUM = f"cums AS (SELECT *, sum(coalesce((freq - f0) * (power + p0) / 2, 0)) OVER (PARTITION BY {KEY} ORDER BY k) AS cum FROM (SELECT *, lag(freq) OVER w AS f0, lag(power) OVER w AS p0 FROM spectrum WINDOW w AS (PARTITION BY {KEY} ORDER BY k)))"
FIT = f"""x AS (SELECT *, log10(freq) AS lf, log10(power) AS lp FROM spectrum WHERE freq BETWEEN 2 AND 40), f1 AS (SELECT {KEY}, regr_slope(lp, lf) AS s, regr_intercept(lp, lf) AS i FROM x GROUP BY ALL),
 x2 AS (SELECT x.*, greatest(lp - i - s * lf, 0) AS flat FROM x JOIN f1 USING (subject, state, channel)), c AS (SELECT {KEY}, quantile_cont(flat, 0.00025) AS q FROM x2 GROUP BY ALL)"""


def rounded(df, *cols):
    return df.withColumns({c: r6(c, c) for c in cols})


def _packed(samples, n: int):
    """Epochs of n samples as arrays; the last, incomplete one is left out."""
    rows = samples.withColumns({"epoch": F.floor(F.col("t_idx") / n), "i": F.col("t_idx") % n})
    xs = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda v: v["x"])
    return rows.groupBy("subject", "state", "channel", "epoch").agg(xs.alias("xs")).where(F.size("xs") == n)


STAT = ["avg", "sum", "max", "min", "std", "var", "p25", "median", "p75", "iqr"]

QUERIES = {
    "sp06_band_stats": (
        lambda s, d: rounded(S.band_stats(V.spectrum(s, d)), *STAT),
        sql(f"SELECT {KEY}, band_id, count(*) AS n, round(avg(lp), 6) AS avg, round(sum(lp), 6) AS sum, round(max(lp), 6) AS max, round(min(lp), 6) AS min, round(stddev_pop(lp), 6) AS std, round(var_pop(lp), 6) AS var, round(quantile_cont(lp, 0.25), 6) AS p25, round(quantile_cont(lp, 0.5), 6) AS median, round(quantile_cont(lp, 0.75), 6) AS p75, round(quantile_cont(lp, 0.75) - quantile_cont(lp, 0.25), 6) AS iqr FROM inner_bins JOIN bands ON freq BETWEEN lo AND hi GROUP BY {KEY}, band_id", INNER),
    ),
    "sp07_band_ratios": (
        lambda s, d: rounded(S.band_ratios(S.band_stats(V.spectrum(s, d))), "ratio"),
        sql("SELECT h.subject, h.state, h.channel, h.band_id AS high, l.band_id AS low, round(h.v / nullif(l.v, 0), 6) AS ratio FROM stats h JOIN stats l ON h.subject = l.subject AND h.state = l.state AND h.channel = l.channel AND h.band_id > l.band_id", INNER, STATS),
    ),
    "sp08_power_percentiles": (
        lambda s, d: rounded(S.power_percentiles(V.spectrum(s, d), LEVELS), "value"),
        sql(f"SELECT {KEY}, unnest(range({len(LEVELS)}))::INT AS j, round(unnest(q), 6) AS value FROM (SELECT {KEY}, quantile_cont(log10(power), {LEVELS}) AS q FROM spectrum GROUP BY ALL)"),
    ),
    "sp10_roi_percentiles": (
        lambda s, d: rounded(S.roi_percentiles(V.spectrum(s, d), ROIS, LEVELS), "value"),
        sql(f"SELECT subject, state, roi, unnest(range({len(LEVELS)}))::INT AS j, round(unnest(q), 6) AS value FROM (SELECT subject, state, roi, quantile_cont(log10(power), {LEVELS}) AS q FROM spectrum JOIN (SELECT unnest(['left', 'left', 'right', 'right', 'right', 'front', 'front']) AS roi, unnest(['ch1', 'ch3', 'ch0', 'ch2', 'ch4', 'ch0', 'ch1']) AS channel) USING (channel) GROUP BY ALL)"),
    ),
    "sp11_cumulative_power": (lambda s, d: S.cumulative_power(V.spectrum(s, d)).select("subject", "state", "channel", "k", r6("cum", "cum")), sql(f"SELECT {KEY}, k, round(cum, 6) AS cum FROM cums", CUM)),
    "sp12_integrate": (
        lambda s, d: rounded(S.integrate(V.spectrum(s, d)), "integral"),
        sql(f"SELECT {KEY}, round(sum(power * CASE least(k, 63 - k) WHEN 0 THEN 3.0 / 8 WHEN 1 THEN 7.0 / 6 WHEN 2 THEN 23.0 / 24 ELSE 1 END) * 2, 6) AS integral FROM spectrum GROUP BY ALL"),
    ),
    "sp13_spectral_edges": (
        lambda s, d: S.spectral_edges(V.spectrum(s, d), EDGES),
        sql(f"SELECT {KEY}, " + ", ".join(f"min(freq) FILTER (cum >= {q} * total) AS edge_{j}" for j, q in enumerate(EDGES)) + f" FROM (SELECT *, max(cum) OVER (PARTITION BY {KEY}) AS total FROM cums) GROUP BY {KEY}", CUM),
    ),
    "sp14_aperiodic_fixed": (
        lambda s, d: rounded(S.aperiodic_fixed(V.spectrum(s, d), 2.0, 40.0), "offset", "exponent"),
        sql(f"SELECT {KEY}, round(regr_intercept(lp, lf), 6) AS \"offset\", round(-regr_slope(lp, lf), 6) AS exponent, count(*) AS n FROM x2 JOIN c USING (subject, state, channel) WHERE flat <= q GROUP BY {KEY}", FIT),
    ),
    "sp17_fit_quality": (
        lambda s, d: rounded(S.fit_quality(V.spectrum(s, d), F.lit(-2.0) - 0.1 * F.log10("freq")), "r2", "mae", "mse", "rmse"),
        sql(f"SELECT {KEY}, round(corr(lp, m) ** 2, 6) AS r2, round(avg(abs(lp - m)), 6) AS mae, round(avg((lp - m) ** 2), 6) AS mse, round(sqrt(avg((lp - m) ** 2)), 6) AS rmse FROM (SELECT *, log10(power) AS lp, -2.0::DOUBLE - 0.1::DOUBLE * log10(freq) AS m FROM spectrum) GROUP BY ALL"),
    ),
    "sp02_periodogram": (
        lambda s, d: rounded(S.periodogram(_packed(V.samples(s, d), 32)), "freq", "power"),
        with_views("", "samples").rstrip() + f", e AS (SELECT {KEY}, t_idx // 32 AS ep, t_idx % 32 AS i, x, count(*) OVER w AS n, avg(x) OVER w AS m FROM samples WINDOW w AS (PARTITION BY {KEY}, t_idx // 32)), t AS (SELECT *, (x - m) * (0.5 - 0.5 * cos(2 * pi() * i / 32)) AS y FROM e WHERE n = 32), c AS (SELECT {KEY}, ep, k, sum(y * cos(2 * pi() * k * i / 32)) AS re, sum(y * sin(2 * pi() * k * i / 32)) AS im FROM t, range(17) r(k) GROUP BY ALL) SELECT {KEY}, k::INT AS k, round(k / 32, 6) AS freq, round(avg((CASE WHEN k IN (0, 16) THEN 1 ELSE 2 END) * (re * re + im * im) / 12), 6) AS power FROM c GROUP BY {KEY}, k",
    ),
    "sp04_average_segments": (
        lambda s, d: rounded(S.average_segments(V.spectrum(s, d).withColumn("duration", (F.col("k") % 3 + 1).cast("double")).withColumn("k", F.floor(F.col("k") / 2).cast("int")).withColumn("freq", F.lit(1.0) * F.col("k"))), "freq", "power"),
        sql(f"SELECT {KEY}, k2::INT AS k, k2::DOUBLE AS freq, round(sum(power * w) / sum(w), 6) AS power FROM (SELECT *, k // 2 AS k2, (k % 3 + 1)::DOUBLE AS w FROM spectrum) GROUP BY ALL"),
    ),
    "sp19_relative_power": (lambda s, d: rounded(S.relative_power(S.band_power(V.spectrum(s, d))), "p", "rel"), sql(f"SELECT {KEY}, band_id, round(p, 6) AS p, round(p / sum(p) OVER (PARTITION BY {KEY}), 6) AS rel FROM bp", POWER)),
    "sp20_power_asymmetry": (
        lambda s, d: rounded(S.power_asymmetry(S.band_power(V.spectrum(s, d)), PAIRS), "asymmetry"),
        sql("SELECT a.subject, a.state, a.band_id, a.channel AS \"left\", b.channel AS \"right\", round((sqrt(a.p) - sqrt(b.p)) / nullif(sqrt(a.p) + sqrt(b.p), 0), 6) AS asymmetry FROM bp a JOIN bp b ON a.subject = b.subject AND a.state = b.state AND a.band_id = b.band_id AND (a.channel, b.channel) IN (('ch1', 'ch2'), ('ch3', 'ch4'))", POWER),
    ),
    "sp21_band_sums": (lambda s, d: rounded(S.band_sums(V.spectrum(s, d)), "mean_power"), sql("SELECT subject, band_id, round(avg(p), 6) AS mean_power FROM bp GROUP BY ALL", POWER)),
    "sp22_spectral_entropy": (
        lambda s, d: rounded(S.spectral_entropy(V.spectrum(s, d)), "entropy"),
        sql(f"SELECT {KEY}, round(-sum(q * log2(q)) / log2(count(*)), 6) AS entropy FROM (SELECT {KEY}, power / sum(power) OVER (PARTITION BY {KEY}) AS q FROM spectrum) GROUP BY ALL"),
    ),
}
