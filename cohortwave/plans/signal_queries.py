"""Queries of complex spectra, peaks, scaling and uncorrelated features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import r6
from ..operators import evaluation as E
from ..operators import fourier as T
from ..operators import independence as I
from ..operators import peaks as P
from ..operators import scaling as C
from ..operators import selection as S
from ..operators import spectral
from ..sources import views as V
from ..sources.views import with_views

KEY = "subject, state, channel"
#: Bands of the samples, whose rate is one a step.
BANDS = [(0.05, 0.15), (0.15, 0.3), (0.3, 0.5)]
N, LONG, TAPERS = 32, 96, 3
HARMONICS = [30.0, 60.0, 120.0]
KNEES, EXPONENTS = [0.0, 1.0, 5.0, 25.0, 125.0], [0.25, 0.5, 1.0, 1.5, 2.0, 3.0]
SPECTRUM_BANDS = [(4.0, 8.0), (8.0, 12.0), (12.0, 30.0), (30.0, 70.0)]


def rounded(df, *cols):
    return df.withColumns({c: r6(c, c) for c in cols})


def doubles(values) -> str:
    return "[" + ", ".join(map(str, values)) + "]::DOUBLE[]"


def band_rows(bands) -> str:
    return f"bands AS (SELECT unnest(range({len(bands)}))::INT AS band_id, unnest({doubles(a for a, _ in bands)}) AS lo, unnest({doubles(b for _, b in bands)}) AS hi)"


def _sine(s, d):
    return T.dft(T.pack(V.samples(s, d), N), T.sine_tapers(s, N, TAPERS))


def _cross(s, d):
    return T.cross_spectra(T.dft(T.pack(V.samples(s, d), N, N // 2), T.hann_taper(s, N)))


def _epochs_sql(n: int, step: int) -> str:
    """Whole windows of n samples every `step` ones, each less its mean."""
    return f"""el AS (SELECT {KEY}, ep, t_idx - ep * {step} AS i, x, count(*) OVER w AS c, avg(x) OVER w AS m FROM (SELECT *, unnest(range(greatest((t_idx - {n}) // {step} + 1, 0), t_idx // {step} + 1)) AS ep FROM (SELECT *, t_idx::BIGINT AS t FROM samples)) WINDOW w AS (PARTITION BY {KEY}, ep)),
 e AS (SELECT {KEY}, ep, i, x, x - m AS y FROM el WHERE c = {n})"""


#: Integer division in SQL goes towards zero, so the first window of an early sample is taken apart.
def _windows_sql(n: int, step: int) -> str:
    return _epochs_sql(n, step).replace(f"greatest((t_idx - {n}) // {step} + 1, 0)", f"CASE WHEN t_idx < {n} THEN 0 ELSE (t_idx - {n}) // {step} + 1 END")


def _coefs_sql(taper: str, js: int) -> str:
    return f"co AS (SELECT {KEY}, ep, j, k, sum(y * h * cos(2 * pi() * k * i / {N})) AS re, -sum(y * h * sin(2 * pi() * k * i / {N})) AS im FROM (SELECT *, {taper} AS h FROM e, range({js}) tj(j)), range({N // 2 + 1}) r(k) GROUP BY ALL)"


SINE = f"sqrt(2 / {N + 1}.0::DOUBLE) * sin(pi() * (j + 1) * (i + 1) / {N + 1})"
HANN = f"(0.5 - 0.5 * cos(2 * pi() * i / {N})) / sqrt(0.375 * {N})"
CROSS = f"cr AS (SELECT a.subject, a.state, a.channel AS a, b.channel AS b, a.ep, a.k, a.re * b.re + a.im * b.im AS re, a.im * b.re - a.re * b.im AS im, a.re ** 2 + a.im ** 2 AS pa, b.re ** 2 + b.im ** 2 AS pb FROM co a JOIN co b ON a.subject = b.subject AND a.state = b.state AND a.ep = b.ep AND a.k = b.k AND a.channel < b.channel)"
COHERENCY = "cy AS (SELECT subject, state, a, b, k, sum(re) / sqrt(sum(pa) * sum(pb)) AS re, sum(im) / sqrt(sum(pa) * sum(pb)) AS im FROM cr GROUP BY ALL)"


def _pair_sql(query: str, *ctes: str) -> str:
    return ", ".join([with_views("", "samples").rstrip(), _windows_sql(N, N // 2), _coefs_sql(HANN, 1), CROSS, band_rows(BANDS), *ctes]) + " " + query


def _scores(s, d):
    return S.score_pearson(V.features(s, d), V.target(s, d).select("subject", "y"))


def _decollinearized(s, d, **kw):
    return rounded(I.decollinearize(V.features(s, d), _scores(s, d), **kw), "score").withColumn("rank", F.col("rank").cast("long"))


def _decollinearize_sql(num: int, targ: float, feat: float, least: int) -> str:
    return with_views("", "features", "target").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + f""", s AS (SELECT key, abs(corr(value, y)) AS score FROM features JOIN target USING (subject) GROUP BY key),
 top AS MATERIALIZED (SELECT * FROM (SELECT key, score, row_number() OVER (ORDER BY score DESC, key) AS rank FROM s) WHERE rank <= {num}),
 ed AS MATERIALIZED (SELECT a.key AS k, list(b.key) AS near FROM (SELECT f.* FROM features f JOIN top USING (key)) a JOIN (SELECT f.subject, f.key, f.value FROM features f JOIN top USING (key)) b ON a.subject = b.subject AND a.key <> b.key GROUP BY a.key, b.key HAVING abs(corr(a.value, b.value)) >= {feat}),
 near AS MATERIALIZED (SELECT k, flatten(list(near)) AS near FROM ed GROUP BY k),
 able AS MATERIALIZED (SELECT row_number() OVER (ORDER BY rank) AS i, key, coalesce(near, []) AS near FROM top LEFT JOIN near ON top.key = near.k WHERE score > {targ}),
 walk AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS kept UNION ALL SELECT able.i, CASE WHEN list_has_any(kept, able.near) THEN kept ELSE list_append(kept, able.key) END FROM walk JOIN able ON able.i = walk.i + 1),
 kept AS MATERIALIZED (SELECT unnest(kept) AS key FROM (SELECT kept FROM walk ORDER BY i DESC LIMIT 1)),
 pad AS (SELECT key FROM (SELECT key, row_number() OVER (ORDER BY rank) AS q FROM top WHERE key NOT IN (SELECT key FROM kept)) WHERE q <= {least} - (SELECT count(*) FROM kept))
 SELECT key, round(score, 6) AS score, rank, padded FROM top JOIN (SELECT key, false AS padded FROM kept UNION ALL SELECT key, true FROM pad) USING (key)"""


#: Sums of logarithms of a coarse grid.
KNEE_SQL = f"""WITH_VIEWS, g AS (SELECT * FROM (SELECT unnest({doubles(KNEES)}) AS knee), (SELECT unnest({doubles(EXPONENTS)}) AS exponent)),
 r AS (SELECT {KEY}, knee, exponent, avg(lp + log10(knee + freq ** exponent)) AS o, var_pop(lp + log10(knee + freq ** exponent)) AS mse FROM (SELECT *, log10(power) AS lp FROM spectrum WHERE freq BETWEEN 2 AND 100), g GROUP BY ALL)
 SELECT {KEY}, round(b.o, 6) AS "offset", b.knee AS knee, b.exponent AS exponent, round(b.mse, 6) AS mse FROM (SELECT {KEY}, min(struct_pack(mse := mse, knee := knee, exponent := exponent, o := o)) AS b FROM r GROUP BY ALL)"""

FIT = f"""x AS (SELECT *, log10(freq) AS lf, log10(power) AS lp FROM spectrum WHERE freq BETWEEN 2 AND 100), f1 AS (SELECT {KEY}, regr_slope(lp, lf) AS s, regr_intercept(lp, lf) AS i FROM x GROUP BY ALL),
 x2 AS (SELECT x.*, greatest(lp - i - s * lf, 0) AS flat FROM x JOIN f1 USING ({KEY})), cq AS (SELECT {KEY}, quantile_cont(flat, 0.00025) AS q FROM x2 GROUP BY ALL),
 fit AS (SELECT {KEY}, regr_intercept(lp, lf) AS o, -regr_slope(lp, lf) AS e FROM x2 JOIN cq USING ({KEY}) WHERE flat <= q GROUP BY ALL),
 rs AS (SELECT {KEY}, band_id, freq, lp - o + e * lf AS r FROM x JOIN fit USING ({KEY}) JOIN bands ON freq BETWEEN lo AND hi)"""

#: The definition word by word, with correlated subqueries.
PEAKS = f"""s AS MATERIALIZED (SELECT {KEY}, row_number() OVER (PARTITION BY {KEY} ORDER BY k) - 1 AS i, k, freq, power AS p, log10(power) AS v, count(*) OVER (PARTITION BY {KEY}) AS n FROM spectrum),
 near AS (SELECT * FROM s WHERE {" OR ".join(f"abs(freq - {h}) <= 1e-8 + 0.05 * {h}" for h in HARMONICS)}),
 c AS (SELECT c.*, (SELECT max(s.i) FROM s WHERE SAME AND s.i < c.i AND s.v <> c.v) AS l, (SELECT min(s.i) FROM s WHERE SAME AND s.i > c.i AND s.v <> c.v) AS r FROM near c),
 pk AS (SELECT c.* FROM c JOIN s a ON a.subject = c.subject AND a.state = c.state AND a.channel = c.channel AND a.i = c.l JOIN s b ON b.subject = c.subject AND b.state = c.state AND b.channel = c.channel AND b.i = c.r WHERE a.v < c.v AND b.v < c.v AND c.i = (c.l + c.r) // 2),
 ends AS (SELECT c.*, coalesce((SELECT max(s.i) FROM s WHERE SAME AND s.i < c.i AND s.v > c.v) + 1, 0) AS lv, coalesce((SELECT min(s.i) FROM s WHERE SAME AND s.i > c.i AND s.v > c.v) - 1, n - 1) AS rv FROM pk c),
 pr AS (SELECT c.*, c.v - greatest((SELECT min(s.v) FROM s WHERE SAME AND s.i BETWEEN c.lv AND c.i), (SELECT min(s.v) FROM s WHERE SAME AND s.i BETWEEN c.i AND c.rv)) AS prominence,
   c.p - (c.p - greatest((SELECT min(s.p) FROM s WHERE SAME AND s.i BETWEEN c.lv AND c.i), (SELECT min(s.p) FROM s WHERE SAME AND s.i BETWEEN c.i AND c.rv))) / 2 AS h FROM ends c),
 cut AS (SELECT c.*, (SELECT max(s.i) FROM s WHERE SAME AND s.i < c.i AND s.p <= c.h) AS a, (SELECT min(s.i) FROM s WHERE SAME AND s.i > c.i AND s.p <= c.h) AS b FROM pr c WHERE prominence >= 0.5),
 wd AS (SELECT c.*, (b - (c.h - (SELECT s.p FROM s WHERE SAME AND s.i = c.b)) / ((SELECT s.p FROM s WHERE SAME AND s.i = c.b - 1) - (SELECT s.p FROM s WHERE SAME AND s.i = c.b))) - (a + (c.h - (SELECT s.p FROM s WHERE SAME AND s.i = c.a)) / ((SELECT s.p FROM s WHERE SAME AND s.i = c.a + 1) - (SELECT s.p FROM s WHERE SAME AND s.i = c.a))) AS width FROM cut c)
 SELECT c.subject, c.state, c.channel, c.k, c.freq, round(prominence, 6) AS prominence, round(width, 6) AS width, (SELECT s.freq FROM s WHERE SAME AND s.i = greatest(trunc(c.i - width), 0)) AS lo, (SELECT s.freq FROM s WHERE SAME AND s.i = least(trunc(c.i + width), c.n - 1)) AS hi FROM wd c""".replace("SAME", "s.subject = c.subject AND s.state = c.state AND s.channel = c.channel")

HURST_SIZES = sorted({int(10 ** (1 + k / 4) + 1e-9) for k in range(8) if 1 + k / 4 < 1.9777236} | {LONG})
DFA_SIZES = [4, 5, 6, 8]
#: Block sizes of epochs of 96 points, by the rules of the operators.
BLOCKS = "bl AS (SELECT e.*, size, i // size AS block FROM e, (SELECT unnest({sizes}) AS size) WHERE (i // size + 1) * size <= 96)"
HURST = f"""st AS (SELECT *, x - lag(x) OVER (PARTITION BY {KEY}, ep, size, block ORDER BY i) AS step FROM bl), dv AS (SELECT *, step - avg(step) OVER (PARTITION BY {KEY}, ep, size, block) AS dd FROM st WHERE step IS NOT NULL),
 z AS (SELECT *, sum(dd) OVER (PARTITION BY {KEY}, ep, size, block ORDER BY i) AS z FROM dv), rs AS (SELECT {KEY}, ep, size, block, (max(z) - min(z)) / nullif(stddev_samp(step), 0) AS rs FROM z GROUP BY ALL),
 av AS (SELECT {KEY}, ep, log10(size) AS lx, log10(avg(rs)) AS ly FROM rs WHERE rs > 0 GROUP BY {KEY}, ep, size)
 SELECT {KEY}, ep AS epoch, round(regr_slope(ly, lx), 6) AS hurst, round(10 ** regr_intercept(ly, lx), 6) AS constant FROM av GROUP BY {KEY}, ep"""
DFA = f"""wk AS (SELECT {KEY}, ep, i, sum(y) OVER (PARTITION BY {KEY}, ep ORDER BY i) AS x FROM e), bl AS (SELECT wk.*, size, i // size AS block, i % size AS pt FROM wk, (SELECT unnest({DFA_SIZES}) AS size) WHERE (i // size + 1) * size <= {LONG}),
 rg AS (SELECT {KEY}, ep, size, block, regr_syy(x, pt) - regr_sxy(x, pt) ** 2 / regr_sxx(x, pt) AS sse FROM bl GROUP BY ALL),
 fl AS (SELECT {KEY}, ep, size, sqrt(avg(sse / size)) AS f FROM rg GROUP BY ALL) SELECT {KEY}, ep AS epoch, round(regr_slope(ln(f), ln(size)), 6) AS dfa FROM fl GROUP BY {KEY}, ep"""

TAU = "SELECT key, round(abs(sum(sign(a.value - b.value) * sign(a.label - b.label)) / sqrt(sum((a.value <> b.value)::INT)::DOUBLE * sum((a.label <> b.label)::INT))), 6) AS score FROM j a JOIN j b USING (key) WHERE a.subject < b.subject GROUP BY key"
HOLED = "CASE WHEN (subject + substr(key, 2)::INT) % 11 > 1 THEN round(value, 2) END"


def _holed(s, d):
    """Features with ties, and with nulls at other subjects for each key."""
    return V.features(s, d).withColumn("value", F.when((F.col("subject") + F.substring("key", 2, 3).cast("int")) % 11 > 1, F.round("value", 2)))


def _label(s, d):
    return V.target(s, d).select("subject", F.col("label").alias("y"))


SPLITS = """sb AS (SELECT subject, split, row_number() OVER (PARTITION BY split ORDER BY md5('0:' || split || ':' || subject), subject) <= floor(0.8::DOUBLE * count(*) OVER (PARTITION BY split) + 1e-9) AS ival FROM (SELECT DISTINCT subject FROM predictions), range(6) r(split)),
 px AS (SELECT subject, split, ival, model, y, p >= 0.5 AS c FROM predictions JOIN sb USING (subject)),
 pg AS (SELECT split, ival, model, sum((c AND y = 1)::INT)::DOUBLE AS tp, sum((NOT c AND y = 0)::INT)::DOUBLE AS tn, sum((c AND y = 0)::INT)::DOUBLE AS fp, sum((NOT c AND y = 1)::INT)::DOUBLE AS fn FROM px GROUP BY ALL),
 sc AS (SELECT split, ival, model, (tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0) AS mcc FROM pg),
 bs AS (SELECT split, arg_max(model, (coalesce(mcc, 0), model)) AS best FROM sc WHERE ival GROUP BY split),
 rt AS (SELECT a.split, a.model, b.model AS best, sum((a.c = (a.y = 1) AND b.c <> (b.y = 1))::INT)::BIGINT AS n10, sum((a.c <> (a.y = 1) AND b.c = (b.y = 1))::INT)::BIGINT AS n01 FROM px a JOIN px b ON a.subject = b.subject AND a.split = b.split JOIN bs ON bs.split = a.split AND bs.best = b.model WHERE a.ival GROUP BY ALL),
 mp AS (SELECT split, model, best, least(2 * list_sum(list_transform(range(0, least(n10, n01) + 1), lambda i: exp(lgamma(n10 + n01 + 1) - lgamma(i + 1) - lgamma(n10 + n01 - i + 1) - (n10 + n01) * ln(2)))) - exp(lgamma(n10 + n01 + 1) - lgamma(least(n10, n01) + 1) - lgamma(greatest(n10, n01) + 1) - (n10 + n01) * ln(2)), 1) AS p FROM rt)
 SELECT mp.split::INT AS split, mp.model, mp.best, round(coalesce(i.mcc, 0), 6) + 0 AS ival_mcc, round(mp.p, 6) + 0 AS p, round(h.mcc, 6) + 0 AS holdout_mcc FROM mp JOIN sc i ON i.split = mp.split AND i.model = mp.model AND i.ival LEFT JOIN sc h ON h.split = mp.split AND h.model = mp.model AND NOT h.ival WHERE mp.p > 0.05"""


def _samples_sql(query: str, *ctes: str) -> str:
    return ", ".join([with_views("", "samples").rstrip(), *ctes]) + ", " + query


QUERIES = {
    "fs15_decollinearize": (lambda s, d: _decollinearized(s, d, num_features=40, targ_threshold=0.01, feat_threshold=0.06), _decollinearize_sql(40, 0.01, 0.06, 1)),
    "fs15_decollinearize_padded": (lambda s, d: _decollinearized(s, d, num_features=30, targ_threshold=0.05, feat_threshold=0.02, min_features=12), _decollinearize_sql(30, 0.05, 0.02, 12)),
    "sp01_dft": (
        lambda s, d: rounded(_sine(s, d).select("subject", "state", "channel", "epoch", F.col("j").cast("long").alias("j"), F.posexplode("coef").alias("k", "c")).select("subject", "state", "channel", "epoch", "j", F.col("k").cast("long").alias("k"), "c.re", "c.im"), "re", "im"),
        ", ".join([with_views("", "samples").rstrip(), _windows_sql(N, N), _coefs_sql(SINE, TAPERS)]) + f" SELECT {KEY}, ep AS epoch, j, k, round(re, 6) + 0 AS re, round(im, 6) + 0 AS im FROM co",
    ),
    "sp03_multitaper_psd": (
        lambda s, d: rounded(T.multitaper_psd(_sine(s, d)), "freq", "power"),
        ", ".join([with_views("", "samples").rstrip(), _windows_sql(N, N), _coefs_sql(SINE, TAPERS)]) + f" SELECT {KEY}, k::INT AS k, round(k / {N}, 6) AS freq, round(avg((CASE WHEN k IN (0, {N // 2}) THEN 1 ELSE 2 END) * (re ** 2 + im ** 2)), 6) AS power FROM co GROUP BY {KEY}, k",
    ),
    "sp06_band_stats_of_samples": (
        lambda s, d: rounded(spectral.band_stats(T.multitaper_psd(_sine(s, d)).where("k > 0"), BANDS), "avg", "std", "median").select("subject", "state", "channel", "band_id", "n", "avg", "std", "median"),
        ", ".join([with_views("", "samples").rstrip(), _windows_sql(N, N), _coefs_sql(SINE, TAPERS), band_rows(BANDS)]) + f" SELECT {KEY}, band_id, count(*) AS n, round(avg(lp), 6) AS avg, round(stddev_pop(lp), 6) AS std, round(median(lp), 6) AS median FROM (SELECT {KEY}, k / {N}.0::DOUBLE AS freq, log10(avg(2 * (re ** 2 + im ** 2))) AS lp FROM co WHERE k BETWEEN 2 AND {N // 2 - 1} GROUP BY {KEY}, k) JOIN bands ON freq BETWEEN lo AND hi GROUP BY {KEY}, band_id",
    ),
    "nw04_pair_coherence": (
        lambda s, d: rounded(T.pair_coherence(_cross(s, d), 1.0, BANDS), "coherence"),
        _pair_sql(f"SELECT subject, state, a, b, band_id, round(avg(re ** 2 + im ** 2), 6) AS coherence FROM cy JOIN bands ON k / {N}.0::DOUBLE BETWEEN lo AND hi GROUP BY ALL", COHERENCY),
    ),
    "nw05_pair_phase_locking": (
        lambda s, d: rounded(T.pair_phase_locking(_cross(s, d), 1.0, BANDS), "plv", "pli"),
        _pair_sql(
            f"SELECT subject, state, a, b, band_id, round(avg(sqrt(u ** 2 + v ** 2)), 6) AS plv, round(avg(abs(s)), 6) + 0 AS pli FROM ph JOIN bands ON k / {N}.0::DOUBLE BETWEEN lo AND hi WHERE k < {N // 2} GROUP BY ALL",
            "ph AS (SELECT subject, state, a, b, k, avg(re / sqrt(re ** 2 + im ** 2)) AS u, avg(im / sqrt(re ** 2 + im ** 2)) AS v, avg(sign(im)) AS s FROM cr GROUP BY ALL)",
        ),
    ),
    "nw06_pair_phase": (
        lambda s, d: rounded(T.pair_phase(_cross(s, d), 1.0, BANDS), "phase"),
        _pair_sql(f"SELECT subject, state, unnest([a, b]) AS a, unnest([b, a]) AS b, band_id, round(unnest([degrees(atan2(im, re)), degrees(atan2(-im, re))]) / (hi - lo), 6) + 0 AS phase FROM (SELECT subject, state, a, b, band_id, lo, hi, avg(re) AS re, avg(im) AS im FROM cy JOIN bands ON k / {N}.0::DOUBLE BETWEEN lo AND hi GROUP BY ALL)", COHERENCY),
    ),
    "sg11_line_noise_peaks": (lambda s, d: rounded(P.line_noise_peaks(V.spectrum(s, d), HARMONICS), "prominence", "width"), with_views("", "spectrum").rstrip() + ", " + PEAKS),
    "sp15_aperiodic_knee": (lambda s, d: rounded(P.aperiodic_knee(V.spectrum(s, d), 2.0, 100.0, KNEES, EXPONENTS), "offset", "mse"), KNEE_SQL.replace("WITH_VIEWS", with_views("", "spectrum").rstrip())),
    "sp16_band_peaks": (
        lambda s, d: rounded(P.band_peaks(V.spectrum(s, d), 2.0, 100.0, SPECTRUM_BANDS), "height", "width"),
        ", ".join([with_views("", "spectrum").rstrip(), band_rows(SPECTRUM_BANDS), FIT]) + f" SELECT {KEY}, band_id, center, round(height, 6) AS height, round(sqrt(sum(r * (freq - center) ** 2) FILTER (r > 1e-9) / sum(r) FILTER (r > 1e-9)), 6) AS width FROM rs JOIN (SELECT {KEY}, band_id, max(r) AS height, arg_max(freq, (r, -freq)) AS center FROM rs GROUP BY ALL) USING ({KEY}, band_id) GROUP BY ALL",
    ),
    "cx08_hurst": (lambda s, d: rounded(C.hurst(T.pack(V.samples(s, d), LONG)), "hurst", "constant"), _samples_sql(HURST, _windows_sql(LONG, LONG), BLOCKS.format(sizes=HURST_SIZES))),
    "cx09_dfa": (lambda s, d: rounded(C.dfa(T.pack(V.samples(s, d), LONG)), "dfa"), _samples_sql(DFA, _windows_sql(LONG, LONG))),
    "fs08_score_kendall_label": (
        lambda s, d: rounded(S.score_kendall(_holed(s, d), _label(s, d)), "score"),
        with_views("", "features", "target").rstrip() + f", j AS (SELECT * FROM (SELECT subject, key, {HOLED} AS value, label FROM features JOIN target USING (subject)) WHERE value IS NOT NULL) {TAU}",
    ),
    "fs07_score_spearman_nulls": (
        lambda s, d: rounded(S.score_spearman(_holed(s, d).withColumn("value", F.when(F.col("key") < "f08", F.round("value", 2)).otherwise(F.col("value"))), _label(s, d)), "score"),
        with_views("", "features", "target").rstrip() + f", j AS (SELECT * FROM (SELECT subject, key, {HOLED} AS value, label FROM features JOIN target USING (subject)) WHERE value IS NOT NULL), rk AS (SELECT key, rank() OVER (PARTITION BY key ORDER BY value) + (count(*) OVER (PARTITION BY key, value) - 1) / 2.0 AS a, rank() OVER (PARTITION BY key ORDER BY label) + (count(*) OVER (PARTITION BY key, label) - 1) / 2.0 AS b FROM j) SELECT key, round(abs(corr(a, b)), 6) AS score FROM rk GROUP BY key",
    ),
    "ev16_perturbation_splits": (lambda s, d: rounded(E.perturbation_splits(V.predictions(s, d), 6), "ival_mcc", "p", "holdout_mcc"), with_views("", "predictions").rstrip() + ", " + SPLITS),
}
