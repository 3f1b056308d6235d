"""Queries of assembled feature tables, of models chosen a target, and of the wider forms of earlier operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import r6
from ..operators import assembly as A
from ..operators import evaluation as E
from ..operators import learning as L
from ..operators import network as N
from ..operators import selection as S
from ..operators import series as T
from ..operators import spectral as P
from ..sources import views as V
from ..sources.views import with_views
from . import graph_queries as G
from . import series_queries as R
from . import spectral_queries as Q

KEY = "subject, state, channel"


def rounded(df, *cols):
    return df.withColumns({c: r6(c, c) for c in cols})


def _of(part, name: str) -> str:
    """The SQL of another query, as a table."""
    return f"({part.QUERIES[name][1]})"


def _long(table: str, lead: str, columns: dict[str, str]) -> list[str]:
    return [f"SELECT subject, {lead} || ' {key}' AS key, {column}::DOUBLE AS value FROM {table}" for key, column in columns.items()]


NODE, WHOLE = "'corr ' || state || ' ' || node", "'corr ' || state"
NETWORK = " UNION ALL ".join(
    _long(_of(R, "nw09_strength"), NODE, {"degree": "strength"}) + _long(_of(G, "nw13_eigen_centrality"), NODE, {"eigen": "centrality"}) + _long(_of(R, "nw11_closeness"), NODE, {"closeness": "closeness"})
    + _long(_of(G, "nw12_betweenness"), NODE, {"betweenness": "betweenness"}) + _long(_of(G, "nw14_pagerank"), NODE, {"pagerank": "rank"})
    + _long(_of(R, "nw16_graph_summary"), WHOLE, {"path_length": "path_length", "efficiency": "efficiency"}) + _long(_of(G, "nw15_avg_clustering"), WHOLE, {"clustering": "clustering"})
)


def _network(s, d):
    return A.network_features(N.pair_pearson(V.samples(s, d)), "corr", 5, G.STEPS)


def _fits(s, d):
    """Fits of some recordings only."""
    return P.aperiodic_fixed(V.spectrum(s, d), 2.0, 40.0).where("subject % 3 > 0 OR channel > 'ch1'").select("subject", "state", "channel", "offset", "exponent")


FIT_TABLE = f"""WITH f AS {_of(Q, "sp14_aperiodic_fixed")}, k AS (SELECT * FROM f WHERE subject % 3 > 0 OR channel > 'ch1'), fr AS (SELECT * FROM (SELECT DISTINCT vec_id // 10 AS subject FROM embeddings), (SELECT DISTINCT state, channel FROM k))
 SELECT subject, state || '_' || unnest(['offset', 'exponent']) || '_' || channel AS key, unnest([k."offset", k.exponent]) AS value FROM fr LEFT JOIN k USING (subject, state, channel)"""


def _families(s, d):
    edges = P.spectral_edges(V.spectrum(s, d), Q.EDGES)
    return {
        "bands": A.named(P.band_stats(V.spectrum(s, d)), ["state", "channel", "band_id"], ["avg", "median"]), "edges": A.named(edges, ["state", "channel"], ["edge_0", "edge_1", "edge_2"]),
        "network": _network(s, d),
    }


def _assembled(s, d, how):
    return A.assemble(_families(s, d), how).select("subject", "family", "key", r6("value", "value"))


ASSEMBLED = f"""SELECT subject, 'bands' AS family, state || ' ' || channel || ' ' || band_id || ' ' || unnest(['avg', 'median']) AS key, unnest([avg, median]) AS value FROM {_of(Q, "sp06_band_stats")}
 UNION ALL SELECT subject, 'edges', state || ' ' || channel || ' ' || unnest(['edge_0', 'edge_1', 'edge_2']), round(unnest([edge_0, edge_1, edge_2]), 6) FROM {_of(Q, "sp13_spectral_edges")}
 UNION ALL SELECT subject, 'network', key, value FROM ({NETWORK})"""


def _targets(s, d):
    """Two targets a subject, each with three models."""
    p = V.predictions(s, d)
    two = F.explode(F.array(F.struct(F.lit("quality").alias("target"), F.col("y").cast("double").alias("y")), F.struct(F.lit("level").alias("target"), (1.0 + F.col("y") + (F.col("subject") % 7) / 4.0).alias("y")))).alias("t")
    return p.select("subject", "model", "p", two).select("subject", "model", "t.target", "t.y", "p")


TARGETS = "tg AS (SELECT subject, model, p, unnest(['quality', 'level']) AS target, unnest([y::DOUBLE, 1.0::DOUBLE + y + (subject % 7) / 4.0::DOUBLE]) AS y FROM predictions)"
RANKED = "rk AS (SELECT *, rank() OVER (PARTITION BY model, target ORDER BY p) + (count(*) OVER (PARTITION BY model, target, p) - 1) / 2.0::DOUBLE AS rp, rank() OVER (PARTITION BY model, target ORDER BY y) + (count(*) OVER (PARTITION BY model, target, y) - 1) / 2.0::DOUBLE AS ry FROM tg)"
SCORED = "sc AS (SELECT model, target, abs(corr(p, y)) AS pearson, abs(corr(rp, ry)) AS spearman, sqrt(avg((p - y) ** 2)) AS rmse, avg(abs(p - y)) AS mae, median(abs(p - y)) AS medae, 1 - sum((p - y) ** 2) / nullif(count(*) * var_pop(y), 0) AS r2, 100 * avg(abs(p - y) / nullif(abs(y), 0)) AS mape, sqrt(avg((rp - ry) ** 2)) AS rank_rmse FROM rk GROUP BY model, target)"


def _pred_sql(query: str, *ctes: str) -> str:
    return ", ".join([with_views("", "predictions").rstrip(), TARGETS, RANKED, *ctes]) + " " + query


def _summary_sql(how: str) -> str:
    f = {"avg": "avg", "max": "max", "min": "min", "median": "median"}[how]
    one = lambda c: f"sqrt(avg({c} ** 2))" if how == "avg" and c in ("rmse", "rank_rmse") else f"{f}({c})"
    return _pred_sql("SELECT model, count(*) AS n_targets, " + ", ".join(f"round(coalesce({one(c)}, {-100 if c in ('pearson', 'spearman', 'r2') else 100}), 6) AS {c}" for c in E.REGRESSION) + " FROM sc GROUP BY model", SCORED)


TESTED = """bs AS (SELECT target, arg_min(model, (rank_rmse, model)) AS best FROM sc GROUP BY target),
 d AS (SELECT a.target, a.model, round(abs(a.p - a.y) - abs(b.p - b.y), 12) AS diff FROM tg a JOIN bs USING (target) JOIN tg b ON a.subject = b.subject AND a.target = b.target AND b.model = bs.best),
 dr AS (SELECT *, rank() OVER (PARTITION BY target, model ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY target, model, abs(diff)) - 1) / 2.0::DOUBLE AS r FROM d WHERE diff <> 0),
 ti AS (SELECT target, model, sum(t ** 3 - t) AS ties FROM (SELECT target, model, abs(diff) AS s, count(*)::DOUBLE AS t FROM dr GROUP BY ALL) GROUP BY ALL),
 wx AS (SELECT target, model, least(coalesce(sum(r) FILTER (diff > 0), 0), coalesce(sum(r) FILTER (diff < 0), 0)) AS w, count(*)::DOUBLE AS n FROM dr GROUP BY ALL),
 zs AS (SELECT target, model, abs(w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) / sqrt(2::DOUBLE) AS x FROM wx JOIN ti USING (target, model)),
 te AS (SELECT target, model, x, 1 / (1 + 0.3275911::DOUBLE * x) AS t FROM zs),
 pv AS (SELECT DISTINCT d.target, d.model, coalesce(least((0.254829592::DOUBLE * t - 0.284496736::DOUBLE * t ** 2 + 1.421413741::DOUBLE * t ** 3 - 1.453152027::DOUBLE * t ** 4 + 1.061405429::DOUBLE * t ** 5) * exp(-x * x), 1), 1) AS p FROM d LEFT JOIN te ON d.target = te.target AND d.model = te.model)"""


def _symptoms(s, d):
    """Seven columns a subject from the clinical rows, some missing."""
    v = V.clinical(s, d).withColumn("v", F.floor(F.col("score") / 1000) % 7)
    g = v.groupBy("subject").agg(F.min("v").alias("loc"), F.max("v").alias("headache"), F.count("*").alias("n"), F.sum("present").alias("nausea"), F.max(F.when(F.col("present") == 1, F.col("v"))).alias("light"))
    return g.select("subject", "loc", "headache", "nausea", "light", (F.col("n") % 3).alias("noise"), (F.col("subject") % 5).alias("think"), F.least(F.col("n"), F.lit(15)).alias("memory"))


FLAGS = {"LOC": "loc", "Headache": "headache", "Nausea": "nausea", "LightSens": "light", "NoiseSens": "noise", "LongToThink": "think", "Memory": "memory"}
SYMPTOMS_SQL = "cl AS (SELECT subject, floor(score / 1000) % 7 AS v, present FROM clinical), sy AS (SELECT subject, min(v) AS loc, max(v) AS headache, sum(present) AS nausea, max(v) FILTER (present = 1) AS light, count(*) % 3 AS noise, subject % 5 AS think, least(count(*), 15) AS memory FROM cl GROUP BY subject)"


def _clustered(s, d):
    """Loss of consciousness and memory by the number of their cluster."""
    x = L.ordered_clusters(_symptoms(s, d).withColumn("m", F.lit(15) - F.col("memory")), "m", 7).withColumnRenamed("cluster", "c1")
    x = L.ordered_clusters(x, "loc", 7).withColumnRenamed("cluster", "c2")
    return A.simple_symptoms(x, FLAGS, {"Memory": F.col("c1"), "LOC": F.col("c2")}, "memory")


GRID = [-1.0, 0.5, 3.25, 10.0, 64.4, 126.5, 130.0]
FEW = [f"f{k:02d}" for k in range(6)]


def _few(s, d):
    return V.features(s, d).where(F.col("key").isin(FEW)).withColumn("value", F.round("value", 2))


def _two_targets(s, d):
    pair = lambda n, c: F.struct(F.lit(n).alias("name"), c.cast("double").alias("y"))
    return V.target(s, d).select("subject", F.explode(F.array(pair("label", F.col("label")), pair("third", F.col("label") % 3))).alias("t")).select("subject", "t.*")


FEW_SQL = f"fw AS (SELECT subject, key, round(value, 2) AS value FROM features WHERE key IN ({', '.join(repr(k) for k in FEW)}))"
TWO_SQL = "tw AS (SELECT subject, unnest(['label', 'third']) AS name, unnest([label, label % 3])::DOUBLE AS y FROM target)"
_TAU = "abs(sum(sign(a.value - b.value) * sign(a.y - b.y)) / sqrt(sum((a.value <> b.value)::INT)::DOUBLE * sum((a.y <> b.y)::INT)))"


def _multi_sql(scores: str) -> str:
    return with_views("", "features", "target").rstrip() + f", {FEW_SQL}, {TWO_SQL}, jn AS (SELECT fw.*, name, y FROM fw JOIN tw USING (subject)), ss AS ({scores}) SELECT key, round(avg(s), 6) AS avg_score, round(max(s), 6) AS max_score FROM ss GROUP BY key"


def _even_sql(order: int) -> str:
    values, by = P.END_CORRECTIONS[order]
    cases = " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values))
    return with_views("", "spectrum") + f"SELECT {KEY}, round(sum(power * (1 + (CASE k {cases} ELSE 0 END + CASE 63 - k {cases} ELSE 0 END) / {by}.0::DOUBLE)) * 2, 6) AS integral FROM spectrum GROUP BY ALL"


def _down_sql(places: str, most: int) -> str:
    return with_views("", "samples").rstrip() + f", ln_ AS (SELECT {KEY}, count(*) AS n FROM samples GROUP BY ALL), pl AS (SELECT DISTINCT {KEY}, unnest({places}) AS t_idx FROM ln_ WHERE n > {most}) SELECT s.* FROM samples s JOIN pl USING ({KEY}, t_idx)"


_LOG = "list_transform(range({k}), lambda i: {f})"

QUERIES = {
    "nw18_network_features": (lambda s, d: rounded(_network(s, d), "value"), NETWORK),
    "fa08_fit_table": (lambda s, d: rounded(A.fit_table(_fits(s, d), V.spectrum(s, d), ["offset", "exponent"]), "value"), FIT_TABLE),
    "fa01_assemble": (lambda s, d: _assembled(s, d, "outer"), ASSEMBLED),
    "fa01_assemble_inner": (lambda s, d: _assembled(s, d, "inner"), f"SELECT * FROM ({ASSEMBLED}) WHERE subject IN (SELECT user_id % 8 FROM events) AND subject IN (SELECT vec_id // 10 FROM embeddings)"),
    "fa01_widen": (
        lambda s, d: rounded(A.widen(A.assemble(_families(s, d)), [("edges", "open ch1 edge_1"), ("network", "corr open efficiency")]).select("subject", F.col("edges open ch1 edge_1").alias("edge"), F.col("network corr open efficiency").alias("efficiency")), "edge", "efficiency"),
        f"SELECT subject, min(value) FILTER (family = 'edges' AND key = 'open ch1 edge_1') AS edge, min(value) FILTER (family = 'network' AND key = 'corr open efficiency') AS efficiency FROM ({ASSEMBLED}) GROUP BY subject",
    ),
    "co26_simple_symptoms": (lambda s, d: rounded(_clustered(s, d), "average_score"), None),
    "co26_symptom_flags": (
        lambda s, d: rounded(A.simple_symptoms(_symptoms(s, d), FLAGS, {}, "memory"), "average_score"),
        with_views("", "clinical").rstrip() + f", {SYMPTOMS_SQL} SELECT subject, " + ", ".join(f"coalesce(({'15 - memory' if c == 'memory' else c} <> 0)::INT, 1) AS {n}" for n, c in FLAGS.items()) + ", round(list_avg([loc, headache, nausea, light, noise, think, 15 - memory]::DOUBLE[]), 6) AS average_score FROM sy",
    ),
    "ev12_select_regressors": (lambda s, d: rounded(E.select_regressors(_targets(s, d)), "rank_rmse", "p"), _pred_sql("SELECT target, model, best, round(rank_rmse, 6) AS rank_rmse, round(p, 6) + 0 AS p FROM pv JOIN sc USING (target, model) JOIN bs USING (target) WHERE p > 0.05", SCORED, TESTED)),
    "ev13_target_scores": (lambda s, d: rounded(E.target_scores(_targets(s, d)), *E.REGRESSION), _pred_sql("SELECT model, target, " + ", ".join(f"round({c}, 6) AS {c}" for c in E.REGRESSION) + " FROM sc", SCORED)),
    **{f"ev13_summary_{how}": ((lambda s, d, how=how: rounded(E.regression_summary(E.target_scores(_targets(s, d)), how), *E.REGRESSION)), _summary_sql(how)) for how in ("avg", "max", "min", "median")},
    "ev13_stacked": (
        lambda s, d: rounded(E.stacked_scores(_targets(s, d)), *E.REGRESSION),
        ", ".join([with_views("", "predictions").rstrip(), TARGETS.replace("tg AS", "t0 AS"), "tg AS (SELECT subject, model, p, y, 'all' AS target FROM t0)", RANKED, SCORED]) + " SELECT model, " + ", ".join(f"round({c}, 6) AS {c}" for c in E.REGRESSION) + " FROM sc",
    ),
    "fs11_score_multi_spearman": (
        lambda s, d: rounded(S.score_multi(_few(s, d), _two_targets(s, d), "spearman", ["label", "third"]), "avg_score", "max_score"),
        _multi_sql("SELECT key, name, abs(corr(a, b)) AS s FROM (SELECT key, name, rank() OVER (PARTITION BY key, name ORDER BY value) + (count(*) OVER (PARTITION BY key, name, value) - 1) / 2.0 AS a, rank() OVER (PARTITION BY key, name ORDER BY y) + (count(*) OVER (PARTITION BY key, name, y) - 1) / 2.0 AS b FROM jn) GROUP BY key, name"),
    ),
    "fs11_score_multi_kendall": (lambda s, d: rounded(S.score_multi(_few(s, d), _two_targets(s, d), "kendall", ["label", "third"]), "avg_score", "max_score"), _multi_sql(f"SELECT key, name, {_TAU} AS s FROM jn a JOIN jn b USING (key, name) WHERE a.subject < b.subject GROUP BY key, name")),
    "fs11_score_multi_mutual_info": (
        lambda s, d: rounded(S.score_multi(_few(s, d), _two_targets(s, d), "mutual_info", ["label", "third"]), "avg_score", "max_score"),
        _multi_sql("SELECT key, name, sum(n / t * ln(n * t / (nb * ny))) AS s FROM (SELECT *, sum(n) OVER (PARTITION BY key, name, bin) AS nb, sum(n) OVER (PARTITION BY key, name, y) AS ny, sum(n) OVER (PARTITION BY key, name) AS t FROM (SELECT key, name, bin, y, count(*)::DOUBLE AS n FROM (SELECT *, least(floor((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0) * 10), 9) AS bin FROM jn WINDOW w AS (PARTITION BY key)) GROUP BY ALL)) GROUP BY key, name"),
    ),
    "fs13_pair_spearman": (
        lambda s, d: rounded(S.pair_rank_correlation(_few(s, d)), "r"),
        with_views("", "features").rstrip() + f", {FEW_SQL}, rf AS (SELECT subject, key, rank() OVER (PARTITION BY key ORDER BY value) + (count(*) OVER (PARTITION BY key, value) - 1) / 2.0 AS v FROM fw) SELECT a.key AS k1, b.key AS k2, round(abs(corr(a.v, b.v)), 6) AS r FROM rf a JOIN rf b ON a.subject = b.subject AND a.key < b.key GROUP BY ALL",
    ),
    "fs13_pair_kendall": (
        lambda s, d: rounded(S.pair_tau(_few(s, d)), "r"),
        with_views("", "features").rstrip() + f", {FEW_SQL}, jn AS (SELECT a.subject, a.key AS k1, b.key AS k2, a.value, b.value AS y FROM fw a JOIN fw b ON a.subject = b.subject AND a.key < b.key) SELECT k1, k2, round({_TAU}, 6) AS r FROM jn a JOIN jn b USING (k1, k2) WHERE a.subject < b.subject GROUP BY k1, k2",
    ),
    "ml01_repeated_folds": (
        lambda s, d: S.repeated_folds(V.target(s, d).select("subject", "y"), "subject", "y", 5, 3, "s1").withColumn("fold", F.col("fold").cast("long")),
        with_views("", "target") + "SELECT subject, y, r::INT AS repeat, (row_number() OVER (PARTITION BY y, r ORDER BY md5('s1:' || r || ':' || subject), r || ':' || subject) - 1) % 5 AS fold FROM target, range(3) t(r)",
    ),
    "ml01_group_folds": (lambda s, d: S.group_folds(V.target(s, d).select("subject", "label"), "label"), with_views("", "target") + "SELECT subject, label, dense_rank() OVER (ORDER BY label) - 1 AS fold FROM target"),
    "ml01_shuffle_split": (
        lambda s, d: S.shuffle_split(V.target(s, d).select("subject", "y"), "subject", "y", 0.2, "s2"),
        with_views("", "target") + "SELECT subject, y, row_number() OVER (PARTITION BY y ORDER BY md5('s2:' || subject), subject) <= floor(0.2::DOUBLE * count(*) OVER (PARTITION BY y) + 1e-9) AS test FROM target",
    ),
    **{f"sp12_integrate_order_{order}": ((lambda s, d, order=order: rounded(P.integrate_corrected(V.spectrum(s, d), order), "integral")), _even_sql(order)) for order in (1, 3, 5, 7)},
    "sp11_cumulative_cubic": (
        lambda s, d: P.cumulative_cubic(V.spectrum(s, d)).select("subject", "state", "channel", "k", r6("cum", "cum")),
        with_views("", "spectrum") + f"SELECT {KEY}, k, round(sum(CASE WHEN k = 0 THEN 0 WHEN k = 1 THEN 9 * a + 19 * power - 5 * b + c WHEN k = 63 THEN 9 * power + 19 * a - 5 * a2 + a3 ELSE -a2 + 13 * a + 13 * power - b END / 24 * 2) OVER (PARTITION BY {KEY} ORDER BY k), 6) AS cum FROM (SELECT *, lag(power) OVER w AS a, lag(power, 2) OVER w AS a2, lag(power, 3) OVER w AS a3, lead(power) OVER w AS b, lead(power, 2) OVER w AS c FROM spectrum WINDOW w AS (PARTITION BY {KEY} ORDER BY k))",
    ),
    "ts04_downsample_linear": (lambda s, d: T.downsample_index(V.samples(s, d), 12, "linear"), _down_sql("list_transform(range(12), lambda i: floor((n - 1) * i / 11.0::DOUBLE + 1e-9)::BIGINT)", 12)),
    "ts04_downsample_two_sided": (
        lambda s, d: T.downsample_index(V.samples(s, d), 12, "log", True),
        _down_sql("list_transform(range(6), lambda i: n // 2 - floor(exp(ln(n // 2 - 1) * (1 - i / 5.0::DOUBLE)) + 1e-9)::BIGINT) || list_transform(range(6), lambda i: n // 2 + floor(exp(ln(n - n // 2 - 1) * i / 5.0::DOUBLE) + 1e-9)::BIGINT)", 12),
    ),
    "ts05_interpolate_beyond": (
        lambda s, d: rounded(T.interpolate(V.spectrum(s, d), GRID, ["subject", "state", "channel"]), "power"),
        with_views("", "spectrum").rstrip() + f", gr AS (SELECT unnest(range({len(GRID)}))::INT AS g, unnest({GRID}::DOUBLE[]) AS f), sg AS (SELECT *, lead(freq) OVER w AS f1, lead(power) OVER w AS p1 FROM spectrum WINDOW w AS (PARTITION BY {KEY} ORDER BY k)) SELECT {KEY}, g, f AS freq, round(power + (p1 - power) * (f - freq) / (f1 - freq), 6) AS power FROM sg, gr WHERE f1 IS NOT NULL AND (k = 0 OR f >= freq) AND (k = 62 OR f < f1)",
    ),
    "ev07_confusion_counts": (
        lambda s, d: E.confusion_counts(V.predictions(s, d)),
        with_views("", "predictions") + "SELECT model, CASE WHEN p >= 0.5 AND y = 1 THEN 'tp' WHEN p >= 0.5 THEN 'fp' WHEN y = 1 THEN 'fn' ELSE 'tn' END AS cell, count(*) AS n, min(subject) AS first_id, max(subject) AS last_id FROM predictions GROUP BY ALL",
    ),
}
