"""Queries of graph features, rereferences, entropies of epochs and modelled spectra."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import complexity as X
from ..operators import network as N
from ..operators import series as T
from ..operators import spectral as P
from ..sources import views as V
from .series_queries import BOTH, DIST, EDGES, EPOCHS, GRAPH, KEY, PAIRED, rounded, sql

#: Channel names of a cap, given to the event types so that sides can be told.
CAP = {"view": "A1", "click": "A2", "error": "F3", "purchase": "F4", "signup": "Cz"}
CAP_SQL = "cap AS (SELECT subject, state, t_idx, x, CASE channel " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in CAP.items()) + " END AS channel FROM samples)"
STEPS = 8
_EIGEN = "e0 AS MATERIALIZED (SELECT DISTINCT subject, state, src AS node, 1.0::DOUBLE AS v FROM sym), " + ", ".join(f"e{k + 1} AS MATERIALIZED (SELECT s.subject, s.state, s.src AS node, sum(abs(w) * v) AS v FROM sym s JOIN e{k} e ON s.subject = e.subject AND s.state = e.state AND s.dst = e.node GROUP BY ALL)" for k in range(STEPS))
_OUT = "o AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY subject, state) AS k FROM (SELECT subject, state, src AS node, sum(abs(w)) AS out FROM sym GROUP BY ALL))"
_RANK = _OUT + ", r0 AS MATERIALIZED (SELECT subject, state, node, 1.0::DOUBLE / k AS v FROM o), " + ", ".join(f"r{i + 1} AS MATERIALIZED (SELECT s.subject, s.state, s.src AS node, 0.15::DOUBLE / max(k) + 0.85::DOUBLE * sum(abs(w) * v / out) AS v FROM sym s JOIN r{i} r ON s.subject = r.subject AND s.state = r.state AND s.dst = r.node JOIN o ON s.subject = o.subject AND s.state = o.state AND s.dst = o.node GROUP BY ALL)" for i in range(STEPS))
SYM = BOTH.replace("AS (", "AS MATERIALIZED (", 1)
_ARRAYS = "ar AS (SELECT subject, channel, state, epoch, list(x ORDER BY i) AS x, 0.2::DOUBLE * stddev_pop(x) AS tol FROM epochs GROUP BY ALL)"
_AT = f"at_ AS MATERIALIZED (SELECT {KEY}, epoch, tol, x, unnest(range(1, 32)) AS i FROM ar)"
_MEET = f"meet AS MATERIALIZED (SELECT a.subject, a.channel, a.state, a.epoch, a.i, b.i AS j, abs(a.x[a.i] - a.x[b.i]) <= a.tol AND abs(a.x[a.i + 1] - a.x[b.i + 1]) <= a.tol AS two, abs(a.x[a.i + 2] - a.x[b.i + 2]) <= a.tol AS more FROM at_ a JOIN at_ b ON a.subject = b.subject AND a.channel = b.channel AND a.state = b.state AND a.epoch = b.epoch)"


def _edges(s, d):
    return N.pair_pearson(V.samples(s, d))


def _dist(s, d):
    return N.distances(_edges(s, d), GRAPH, 5)


def _epochs(s, d):
    return T.epochs(V.samples(s, d), 32, 16)


def _cap(s, d):
    return V.samples(s, d).replace(CAP, subset=["channel"])


def _params(s, d):
    """Parameters that grow with the spectra: an offset from the group's greatest power and two peaks from its mean."""
    g = V.spectrum(s, d).groupBy("subject", "channel", "state").agg(F.log10(F.max("power")).alias("offset"), F.avg("power").alias("m"))
    peak = lambda cf, bw: F.struct(F.lit(cf).alias("cf"), F.col("m").alias("pw"), F.lit(bw).alias("bw"))
    return g.select("subject", "channel", "state", "offset", F.lit(0.5).alias("knee"), F.lit(1.5).alias("exponent"), F.array(peak(10.0, 2.0), peak(20.0, 4.0)).alias("peaks"))


QUERIES = {
    "nw12_betweenness": (
        lambda s, d: rounded(N.betweenness(_dist(s, d), GRAPH), "betweenness"),
        sql(
            "SELECT n.subject, n.state, n.node, round(coalesce(hits / nullif((k - 1) * (k - 2) / 2.0, 0), 0), 6) AS betweenness FROM (SELECT DISTINCT subject, state, src AS node, (SELECT count(DISTINCT src) FROM dm i WHERE i.subject = dm.subject AND i.state = dm.state) AS k FROM dm) n LEFT JOIN (SELECT l.subject, l.state, l.dst AS node, sum((abs(l.d + r.d - w.d) <= 1e-9)::INT) AS hits FROM dm l JOIN dm r ON l.subject = r.subject AND l.state = r.state AND l.dst = r.src JOIN dm w ON w.subject = l.subject AND w.state = l.state AND w.src = l.src AND w.dst = r.dst WHERE l.src < r.dst GROUP BY ALL) h ON n.subject = h.subject AND n.state = h.state AND n.node = h.node",
            PAIRED, EDGES, SYM, DIST, "dm AS MATERIALIZED (SELECT * FROM d3)",
        ),
    ),
    "nw13_eigen_centrality": (
        lambda s, d: rounded(N.eigen_centrality(_edges(s, d), GRAPH, STEPS), "centrality"),
        sql(f"SELECT subject, state, node, round(coalesce(v / nullif(sqrt(sum(v * v) OVER (PARTITION BY subject, state)), 0), 0), 6) AS centrality FROM e{STEPS}", PAIRED, EDGES, SYM, _EIGEN),
    ),
    "nw14_pagerank": (
        lambda s, d: rounded(N.pagerank(_edges(s, d), GRAPH, 0.85, STEPS), "rank"),
        sql(f"SELECT subject, state, node, round(v, 6) AS rank FROM r{STEPS}", PAIRED, EDGES, SYM, _RANK),
    ),
    "nw15_avg_clustering": (
        lambda s, d: rounded(N.avg_clustering(_edges(s, d), GRAPH), "clustering"),
        sql(
            "SELECT k.subject, k.state, round(avg(coalesce(s / nullif(n * (n - 1), 0), 0)), 6) AS clustering FROM (SELECT subject, state, src, count(*) AS n FROM u GROUP BY ALL) k LEFT JOIN (SELECT a.subject, a.state, a.src, sum((a.w * b.w * c.w) ** (1 / 3.0::DOUBLE)) AS s FROM u a JOIN u b ON a.subject = b.subject AND a.state = b.state AND a.dst = b.src AND a.src <> b.dst JOIN u c ON a.subject = c.subject AND a.state = c.state AND c.src = a.src AND c.dst = b.dst GROUP BY ALL) t ON k.subject = t.subject AND k.state = t.state AND k.src = t.src GROUP BY ALL",
            PAIRED, EDGES, SYM, "u AS MATERIALIZED (SELECT subject, state, src, dst, abs(w) / max(abs(w)) OVER (PARTITION BY subject, state) AS w FROM sym WHERE w <> 0)",
        ),
    ),
    "nw17_homotopic_mean": (
        lambda s, d: rounded(N.homotopic_mean(_edges(s, d), [("view", "click"), ("error", "signup")], GRAPH), "homotopic"),
        sql("SELECT subject, state, round(avg(w), 6) + 0 AS homotopic FROM edges WHERE (src = 'click' AND dst = 'view') OR (src = 'error' AND dst = 'signup') GROUP BY ALL", PAIRED, EDGES),
    ),
    "sg03_reref_combos": (
        lambda s, d: rounded(T.reref_combos(V.samples(s, d), 2), "y"),
        sql("SELECT a.subject, a.state, a.t_idx, a.channel || '+' || b.channel AS channel, round((a.x + b.x) / 2 - (a.t - a.x - b.x) / nullif(a.n - 2, 0), 6) + 0 AS y FROM t a JOIN t b ON a.subject = b.subject AND a.state = b.state AND a.t_idx = b.t_idx AND a.channel < b.channel", "t AS (SELECT *, sum(x) OVER w AS t, count(*) OVER w AS n FROM samples WINDOW w AS (PARTITION BY subject, state, t_idx))"),
    ),
    "sg05_reref_lateral": (
        lambda s, d: rounded(T.reref_lateral(_cap(s, d)), "x", "y"),
        sql("SELECT subject, state, t_idx, channel, round(x, 6) AS x, round(x - CASE channel WHEN 'F3' THEN a1 WHEN 'F4' THEN a2 ELSE (a1 + a2) / 2 END, 6) + 0 AS y FROM (SELECT *, max(x) FILTER (channel = 'A1') OVER w AS a1, max(x) FILTER (channel = 'A2') OVER w AS a2 FROM cap WINDOW w AS (PARTITION BY subject, state, t_idx)) WHERE channel NOT IN ('A1', 'A2')", CAP_SQL),
    ),
    "sg05_reref_lateral_contra": (
        lambda s, d: rounded(T.reref_lateral(_cap(s, d), "contra"), "x", "y"),
        sql("SELECT subject, state, t_idx, channel, round(x, 6) AS x, round(x - CASE channel WHEN 'F3' THEN a2 WHEN 'F4' THEN a1 ELSE (a1 + a2) / 2 END, 6) + 0 AS y FROM (SELECT *, max(x) FILTER (channel = 'A1') OVER w AS a1, max(x) FILTER (channel = 'A2') OVER w AS a2 FROM cap WINDOW w AS (PARTITION BY subject, state, t_idx)) WHERE channel NOT IN ('A1', 'A2')", CAP_SQL),
    ),
    "sg12_bridge_noise": (
        lambda s, d: P.bridge_noise(V.spectrum(s, d), [(57.0, 63.0), (117.0, 123.0)], ["subject", "channel", "state"]).withColumn("power", F.round("power", 9)),
        sql(
            "SELECT subject, channel, state, k, freq, round(CASE WHEN freq BETWEEN 57 AND 63 THEN exp(ln(l0.power) + (ln(freq) - ln(l0.freq)) / (ln(r0.freq) - ln(l0.freq)) * (ln(r0.power) - ln(l0.power))) WHEN freq BETWEEN 117 AND 123 THEN exp(ln(l1.power) + (ln(freq) - ln(l1.freq)) / (ln(r1.freq) - ln(l1.freq)) * (ln(r1.power) - ln(l1.power))) ELSE power END, 9) AS power FROM spectrum JOIN ed USING (subject, channel, state)",
            "ed AS (SELECT subject, channel, state, max({'freq': freq, 'power': power}) FILTER (freq < 57) AS l0, min({'freq': freq, 'power': power}) FILTER (freq > 63) AS r0, max({'freq': freq, 'power': power}) FILTER (freq < 117) AS l1, min({'freq': freq, 'power': power}) FILTER (freq > 123) AS r1 FROM spectrum GROUP BY ALL)",
            views=("spectrum",),
        ),
    ),
    "sp18_model_spectrum": (
        lambda s, d: rounded(P.model_spectrum(_params(s, d), 0.5, 60, ["subject", "channel", "state"]), "log_power"),
        sql("SELECT subject, channel, state, f * 0.5::DOUBLE AS freq, round(o - log10(0.5::DOUBLE + (f * 0.5::DOUBLE) ** 1.5::DOUBLE) + m * exp(-((f * 0.5::DOUBLE - 10) ** 2) / 8) + m * exp(-((f * 0.5::DOUBLE - 20) ** 2) / 32), 6) + 0 AS log_power FROM (SELECT subject, channel, state, log10(max(power)) AS o, avg(power) AS m, unnest(range(1, 61)) AS f FROM spectrum GROUP BY subject, channel, state)", views=("spectrum",)),
    ),
    "cx06_app_entropy": (
        lambda s, d: rounded(X.app_entropy(_epochs(s, d)), "app_entropy"),
        sql(
            f"SELECT {KEY}, epoch, round(sum(ln(c2 / 31.0::DOUBLE)) / 31 - sum(ln(c3 / 30.0::DOUBLE)) FILTER (i <= 30) / 30, 6) + 0 AS app_entropy FROM (SELECT {KEY}, epoch, i, sum(two::INT)::DOUBLE AS c2, (sum((two AND more)::INT) FILTER (i <= 30 AND j <= 30))::DOUBLE AS c3 FROM meet GROUP BY ALL) GROUP BY ALL",
            EPOCHS, _ARRAYS, _AT, _MEET,
        ),
    ),
    "cx07_sample_entropy": (
        lambda s, d: rounded(X.sample_entropy(_epochs(s, d)), "sample_entropy"),
        sql(
            f"SELECT {KEY}, epoch, CASE WHEN a > 0 THEN round(-ln(a / b), 6) + 0 END AS sample_entropy FROM (SELECT {KEY}, epoch, sum((two AND more)::INT)::DOUBLE AS a, sum(two::INT)::DOUBLE AS b FROM meet WHERE i < j AND j <= 30 GROUP BY ALL)",
            EPOCHS, _ARRAYS, _AT, _MEET,
        ),
    ),
    "cx14_flatten_names": (
        lambda s, d: rounded(X.flatten_names(V.samples(s, d).groupBy("subject", "state", "channel").agg(F.avg("x").alias("m")), ["state", "channel"], "m", ["open_click", "closed_view"]), "open_click", "closed_view"),
        sql("SELECT subject, round(avg(x) FILTER (state = 'open' AND channel = 'click'), 6) AS open_click, round(avg(x) FILTER (state = 'closed' AND channel = 'view'), 6) AS closed_view FROM samples GROUP BY subject"),
    ),
}
