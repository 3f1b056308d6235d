"""Queries of the operators on sample series, their complexity and their networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import r6, symlog
from ..operators import cohort as C
from ..operators import complexity as X
from ..operators import network as N
from ..operators import series as T
from ..sources import views as V
from ..sources.views import with_views

KEY = "subject, channel, state"
W = f"PARTITION BY {KEY} ORDER BY t_idx"
INTERVALS = "intervals AS (SELECT * FROM (SELECT subject, 'open' AS in_state, 1 AS segment, open_start_1 AS t0, open_end_1 AS t1 FROM annotations_wide UNION ALL SELECT subject, 'closed', 1, closed_start_1, closed_end_1 FROM annotations_wide) WHERE t0 IS NOT NULL)"
EPOCHS = f"epochs AS (SELECT {KEY}, e AS epoch, t_idx - e * 16 AS i, x FROM (SELECT *, unnest(range(greatest((t_idx - 31 + 15) // 16, 0), least(t_idx // 16, (n - 32) // 16) + 1)) AS e FROM (SELECT *, count(*) OVER (PARTITION BY {KEY}) AS n FROM samples) WHERE n >= 32))"
PAIRED = "paired AS (SELECT a.subject, a.state, a.channel AS src, b.channel AS dst, a.x AS a, b.x AS b FROM samples a JOIN samples b ON a.subject = b.subject AND a.state = b.state AND a.t_idx = b.t_idx AND a.channel < b.channel)"
EDGES = "edges AS (SELECT subject, state, src, dst, corr(a, b) AS w, count(*) AS n FROM paired GROUP BY ALL)"
BOTH = "sym AS (SELECT subject, state, src, dst, w FROM edges UNION ALL SELECT subject, state, dst, src, w FROM edges)"
_HOP = "{n} AS (SELECT subject, state, src, dst, min(d) AS d FROM (SELECT * FROM {p} UNION ALL SELECT l.subject, l.state, l.src, r.dst, l.d + r.d FROM {p} l JOIN {p} r ON l.subject = r.subject AND l.state = r.state AND l.dst = r.src AND l.src <> r.dst) GROUP BY ALL)"
DIST = "d0 AS (SELECT subject, state, src, dst, 1 / abs(w) AS d FROM sym WHERE w <> 0), " + ", ".join(_HOP.format(n=f"d{i + 1}", p=f"d{i}") for i in range(3))


def sql(query: str, *ctes: str, views=("samples",)) -> str:
    return ", ".join([with_views("", *views).rstrip(), *ctes]) + " " + query


def rounded(df, *cols):
    return df.withColumns({c: r6(c, c) for c in cols})


def _edges(s, d):
    return N.pair_pearson(V.samples(s, d))


def _intervals(s, d):
    return C.unpivot_annotations(V.annotations_wide(s, d))


GRAPH = ["subject", "state"]

QUERIES = {
    "ts01_crop": (
        lambda s, d: T.crop(V.samples(s, d), _intervals(s, d)).select("subject", "channel", "state", "t_idx", "in_state", "segment", "x"),
        sql("SELECT s.subject, channel, state, t_idx, in_state, segment, x FROM samples s JOIN intervals i ON s.subject = i.subject AND t_idx BETWEEN t0 AND t1", INTERVALS, views=("samples", "annotations_wide")),
    ),
    "ts02_crop_fixed": (
        lambda s, d: T.crop_fixed(V.samples(s, d), _intervals(s, d), 30.0),
        sql("SELECT s.subject, channel, state, in_state, segment, count(*) AS n, count(*) = 31 AS complete FROM samples s JOIN intervals i ON s.subject = i.subject AND t_idx BETWEEN t0 AND t1 WHERE t1 - t0 = 30 GROUP BY ALL", INTERVALS, views=("samples", "annotations_wide")),
    ),
    "ts03_resample": (lambda s, d: rounded(T.resample(V.samples(s, d), 5), "x"), sql(f"SELECT {KEY}, t_idx // 5 AS t_idx, round(avg(x), 6) AS x FROM samples GROUP BY {KEY}, t_idx // 5")),
    "ts04_downsample_index": (
        lambda s, d: T.downsample_index(V.samples(s, d), 12),
        sql(f"SELECT s.* FROM samples s JOIN (SELECT DISTINCT {KEY}, floor(exp(ln(n - 1) * i / 11.0::DOUBLE) + 1e-9)::BIGINT AS t_idx FROM (SELECT {KEY}, count(*) AS n FROM samples GROUP BY ALL), range(12) t(i) WHERE n > 12) USING ({KEY}, t_idx)"),
    ),
    "ts05_interpolate_to_grid": (
        lambda s, d: rounded(T.interpolate_to_grid(V.spectrum(s, d), 0.75, ["subject", "state", "channel"]), "power"),
        sql("SELECT subject, state, channel, g, round(power + (p1 - power) * (g * 0.75::DOUBLE - freq) / (f1 - freq), 6) AS power FROM (SELECT *, unnest(range(ceil(freq / 0.75::DOUBLE)::BIGINT, ceil(f1 / 0.75::DOUBLE)::BIGINT)) AS g FROM (SELECT *, lead(freq) OVER w AS f1, lead(power) OVER w AS p1 FROM spectrum WINDOW w AS (PARTITION BY subject, state, channel ORDER BY k)) WHERE f1 IS NOT NULL)", views=("spectrum",)),
    ),
    "ts07_epochs": (lambda s, d: T.epochs(V.samples(s, d), 32, 16), sql("SELECT * FROM epochs", EPOCHS)),
    "ts08_stack_epochs": (
        lambda s, d: T.stack_epochs(T.epochs(V.samples(s, d), 32, 16)),
        sql("SELECT *, dense_rank() OVER (PARTITION BY subject, channel ORDER BY state, epoch) - 1 AS stacked FROM (SELECT DISTINCT subject, channel, state, epoch FROM epochs)", EPOCHS),
    ),
    "ts09_scale_robust": (
        lambda s, d: rounded(T.scale_apply(V.samples(s, d), T.scale_fit(V.samples(s, d), T.SERIES), T.SERIES), "scaled"),
        sql(f"SELECT s.*, round((x - m) / nullif(q3 - q1, 0), 6) AS scaled FROM samples s JOIN (SELECT {KEY}, median(x) AS m, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM samples GROUP BY ALL) USING (subject, channel, state)"),
    ),
    "ts10_scale_fit_closed": (
        lambda s, d: rounded(T.scale_apply(V.samples(s, d).where("state = 'open'"), T.scale_fit(V.samples(s, d).where("state = 'closed'"), ["subject", "channel"]), ["subject", "channel"], "z_score"), "scaled"),
        sql("SELECT s.*, round((x - m) / nullif(q, 0), 6) AS scaled FROM samples s JOIN (SELECT subject, channel, avg(x) AS m, stddev_pop(x) AS q FROM samples WHERE state = 'closed' GROUP BY ALL) USING (subject, channel) WHERE state = 'open'"),
    ),
    "ts11_log_rescale": (
        lambda s, d: T.log_rescale(V.spectrum(s, d), ["subject", "state", "channel"], "power").select("subject", "state", "channel", "k", r6("rescaled", "rescaled")),
        sql("SELECT subject, state, channel, k, round(pow(10, (lp - avg(lp) OVER w) / nullif(stddev_pop(lp) OVER w, 0)), 6) AS rescaled FROM (SELECT *, log10(power) AS lp FROM spectrum) WINDOW w AS (PARTITION BY subject, state, channel)", views=("spectrum",)),
    ),
    "ts12_symlog": (lambda s, d: V.features(s, d).select("subject", "key", r6(symlog(F.col("value")), "value")), sql("SELECT subject, key, round(sign(value) * ln(abs(value) + 1e-6::DOUBLE) / ln(10), 6) + 0 AS value FROM features", views=("features",))),
    "sg01_reref_average": (lambda s, d: rounded(T.reref_average(V.samples(s, d)), "x", "y"), sql("SELECT subject, channel, state, t_idx, round(x, 6) AS x, round(x - avg(x) OVER (PARTITION BY subject, state, t_idx), 6) + 0 AS y FROM samples")),
    "sg02_reref_leave_one_out": (lambda s, d: rounded(T.reref_leave_one_out(V.samples(s, d)), "x", "y"), sql("SELECT subject, channel, state, t_idx, round(x, 6) AS x, round(x - (sum(x) OVER w - x) / nullif(count(x) OVER w - 1, 0), 6) AS y FROM samples WINDOW w AS (PARTITION BY subject, state, t_idx)")),
    "sg04_reref_channel": (lambda s, d: rounded(T.reref_channel(V.samples(s, d), ["click", "view"]), "x", "y"), sql("SELECT subject, channel, state, t_idx, round(x, 6) AS x, round(x - avg(x) FILTER (channel IN ('click', 'view')) OVER (PARTITION BY subject, state, t_idx), 6) + 0 AS y FROM samples")),
    "sg06_remix": (
        lambda s, d: rounded(T.remix(V.samples(s, d), {"a": {"click": 1.0, "view": -1.0}, "b": {"click": 0.5, "view": 0.5}}), "a", "b"),
        sql("SELECT subject, state, t_idx, round(sum(x * CASE channel WHEN 'click' THEN 1.0::DOUBLE WHEN 'view' THEN -1.0::DOUBLE ELSE 0 END), 6) + 0 AS a, round(sum(x * CASE WHEN channel IN ('click', 'view') THEN 0.5::DOUBLE ELSE 0 END), 6) AS b FROM samples GROUP BY ALL"),
    ),
    "sg07_drop_refs": (lambda s, d: T.drop_refs(V.samples(s, d), ["view"]), sql("SELECT * FROM samples WHERE channel <> 'view'")),
    "sg08_regress_out": (
        lambda s, d: rounded(T.regress_out(V.samples(s, d), "click", 0.05).select("subject", "channel", "state", "t_idx", "y"), "y"),
        sql(f"SELECT {KEY}, t_idx, round(CASE WHEN abs(corr(x, r) OVER w) >= 0.05 AND r IS NOT NULL AND channel <> 'click' THEN x - regr_slope(x, r) OVER w * r ELSE x END, 6) AS y FROM (SELECT *, max(x) FILTER (channel = 'click') OVER (PARTITION BY subject, state, t_idx) AS r FROM samples) WINDOW w AS (PARTITION BY {KEY})"),
    ),
    "sg09_band_limit": (lambda s, d: rounded(T.band_limit(V.spectrum(s, d), 1.0, 40.0), "power"), sql("SELECT * REPLACE (round(power, 6) AS power) FROM spectrum WHERE freq BETWEEN 1 AND 40", views=("spectrum",))),
    "sg10_notch": (lambda s, d: T.notch(V.spectrum(s, d), [60.0, 120.0], 4.0).select("subject", "state", "channel", "k"), sql("SELECT subject, state, channel, k FROM spectrum WHERE NOT (abs(freq - 60) <= 2 OR abs(freq - 120) <= 2)", views=("spectrum",))),
    "cx01_moments": (
        lambda s, d: rounded(X.moments(V.samples(s, d)), "mean", "std", "var", "skew", "kurt"),
        sql(f"SELECT {KEY}, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(var_pop(x), 6) AS var, round(avg(d ** 3) / avg(d ** 2) ** 1.5, 6) AS skew, round(avg(d ** 4) / avg(d ** 2) ** 2 - 3, 6) AS kurt FROM (SELECT *, x - avg(x) OVER (PARTITION BY {KEY}) AS d FROM samples) GROUP BY ALL"),
    ),
    "cx02_curve_length": (lambda s, d: rounded(X.curve_length(V.samples(s, d)), "curve_length"), sql(f"SELECT {KEY}, round(sum(sqrt(1 + d * d)), 6) AS curve_length FROM (SELECT *, x - lag(x) OVER ({W}) AS d FROM samples) GROUP BY ALL")),
    "cx03_hjorth": (
        lambda s, d: rounded(X.hjorth(V.samples(s, d)), "mobility", "complexity"),
        sql(f"SELECT {KEY}, round(sqrt(v1 / nullif(v0, 0)), 6) AS mobility, round(sqrt(v2 / nullif(v1, 0)) / nullif(sqrt(v1 / nullif(v0, 0)), 0), 6) AS complexity FROM (SELECT {KEY}, var_pop(x) AS v0, var_pop(d) AS v1, var_pop(dd) AS v2 FROM (SELECT *, d - lag(d) OVER ({W}) AS dd FROM (SELECT *, x - lag(x) OVER ({W}) AS d FROM samples)) GROUP BY ALL)"),
    ),
    "cx04_perm_entropy": (
        lambda s, d: rounded(X.perm_entropy(V.samples(s, d)), "perm_entropy"),
        sql(f"SELECT {KEY}, round(-sum(p * log2(p)) / log2(6), 6) AS perm_entropy FROM (SELECT *, n / sum(n) OVER (PARTITION BY {KEY}) AS p FROM (SELECT {KEY}, (b > x)::INT + 2 * (c > x)::INT + 4 * (c > b)::INT AS code, count(*) AS n FROM (SELECT *, lead(x) OVER ({W}) AS b, lead(x, 2) OVER ({W}) AS c FROM samples) WHERE c IS NOT NULL GROUP BY ALL)) GROUP BY ALL"),
    ),
    "cx05_svd_entropy": (lambda s, d: rounded(X.svd_entropy(V.samples(s, d)), "svd_entropy"), None),
    "cx10_katz_fd": (
        lambda s, d: rounded(X.katz_fd(V.samples(s, d)), "katz_fd"),
        sql(f"SELECT {KEY}, round(log10(path / step) / (log10(path / step) + log10(far / path)), 6) AS katz_fd FROM (SELECT {KEY}, sum(d) AS path, avg(d) AS step, max(abs(x - f)) AS far FROM (SELECT *, abs(x - lag(x) OVER ({W})) AS d, first_value(x) OVER ({W}) AS f FROM samples) GROUP BY ALL)"),
    ),
    "cx11_petrosian_fd": (
        lambda s, d: rounded(X.petrosian_fd(V.samples(s, d)), "petrosian_fd"),
        sql(f"SELECT {KEY}, round(log10(n) / (log10(n) + log10(n / (n + 0.4::DOUBLE * t))), 6) AS petrosian_fd FROM (SELECT {KEY}, count(*)::DOUBLE AS n, sum((d * d0 < 0)::INT) AS t FROM (SELECT *, lag(d) OVER ({W}) AS d0 FROM (SELECT *, x - lag(x) OVER ({W}) AS d FROM samples)) GROUP BY ALL)"),
    ),
    "cx12_higuchi_fd": (
        lambda s, d: rounded(X.higuchi_fd(V.samples(s, d)), "higuchi_fd"),
        sql(f"SELECT {KEY}, round(regr_slope(ln(len), ln(1.0::DOUBLE / k)), 6) AS higuchi_fd FROM (SELECT {KEY}, k, avg(s * (n - 1) / (((n - m - 1) // k) * k) / k) AS len FROM (SELECT a.subject, a.channel, a.state, k, a.t_idx % k AS m, any_value(n) AS n, sum(abs(a.x - b.x)) AS s FROM (SELECT *, count(*) OVER (PARTITION BY {KEY}) AS n FROM samples) a CROSS JOIN range(1, 6) r(k) JOIN samples b ON a.subject = b.subject AND a.channel = b.channel AND a.state = b.state AND b.t_idx = a.t_idx - k GROUP BY ALL) GROUP BY ALL) GROUP BY ALL"),
    ),
    "cx13_epoch_distribution": (
        lambda s, d: rounded(X.epoch_distribution(V.samples(s, d)), "mean", "std", "median", "iqr"),
        sql(f"SELECT {KEY}, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(median(x), 6) AS median, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) AS iqr FROM samples GROUP BY ALL"),
    ),
    "nw01_pair_pearson": (lambda s, d: rounded(_edges(s, d), "w"), sql("SELECT subject, state, src, dst, round(w, 6) AS w, n FROM edges", PAIRED, EDGES)),
    "nw02_pair_spearman": (
        lambda s, d: rounded(N.pair_spearman(V.samples(s, d)), "w"),
        sql("SELECT subject, state, src, dst, round(w, 6) AS w, n FROM edges", f"ranked AS (SELECT {KEY}, t_idx, rank() OVER (PARTITION BY {KEY} ORDER BY x) + (count(*) OVER (PARTITION BY {KEY}, x) - 1) / 2.0 AS x FROM samples)", PAIRED.replace("samples", "ranked"), EDGES),
    ),
    "nw03_pair_mutual_info": (
        lambda s, d: rounded(N.pair_mutual_info(V.samples(s, d)), "w"),
        sql("SELECT subject, state, src, dst, round(sum(n / t * ln(n * t / (na * nb))), 6) AS w FROM (SELECT *, sum(n) OVER (PARTITION BY subject, state, src, dst, a) AS na, sum(n) OVER (PARTITION BY subject, state, src, dst, b) AS nb, sum(n) OVER (PARTITION BY subject, state, src, dst) AS t FROM (SELECT subject, state, src, dst, a, b, count(*)::DOUBLE AS n FROM paired GROUP BY ALL)) GROUP BY subject, state, src, dst", f"binned AS (SELECT {KEY}, t_idx, least(floor((x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) * 20), 19) AS x FROM samples WINDOW w AS (PARTITION BY {KEY}))", PAIRED.replace("samples", "binned")),
    ),
    "nw07_combine_segments": (lambda s, d: rounded(N.combine_segments(_edges(s, d)), "w"), sql("SELECT subject, src, dst, round(sum(w * n) / sum(n), 6) AS w FROM edges GROUP BY ALL", PAIRED, EDGES)),
    "nw08_symmetrize": (lambda s, d: rounded(N.symmetrize(_edges(s, d), GRAPH), "w"), sql("SELECT subject, state, src, dst, round(w, 6) AS w FROM sym", PAIRED, EDGES, BOTH)),
    "nw09_strength": (lambda s, d: rounded(N.strength(_edges(s, d), GRAPH), "strength"), sql("SELECT subject, state, src AS node, round(sum(w), 6) AS strength FROM sym GROUP BY ALL", PAIRED, EDGES, BOTH)),
    "nw10_distances": (lambda s, d: rounded(N.distances(_edges(s, d), GRAPH, 5), "d"), sql("SELECT subject, state, src, dst, round(d, 6) AS d FROM d3", PAIRED, EDGES, BOTH, DIST)),
    "nw11_closeness": (lambda s, d: rounded(N.closeness(N.distances(_edges(s, d), GRAPH, 5), GRAPH), "closeness"), sql("SELECT subject, state, src AS node, round(count(*) / sum(d), 6) AS closeness FROM d3 GROUP BY ALL", PAIRED, EDGES, BOTH, DIST)),
    "nw16_graph_summary": (lambda s, d: rounded(N.graph_summary(N.distances(_edges(s, d), GRAPH, 5), GRAPH), "path_length", "efficiency"), sql("SELECT subject, state, round(avg(d), 6) AS path_length, round(avg(1 / d), 6) AS efficiency FROM d3 GROUP BY ALL", PAIRED, EDGES, BOTH, DIST)),
}
