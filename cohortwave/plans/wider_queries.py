"""Queries of the remaining arguments of earlier operators, and of readers and the result store on files that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lineage import new_path
from ..functions.scalar import bands, r6
from ..operators import cohort as C
from ..operators import complexity as X
from ..operators import evaluation as E
from ..operators import selection as S
from ..operators import series as T
from ..operators import spectral as P
from ..sources import stores
from ..sources import views as V
from ..sources.views import with_views
from . import spectral_queries as Q

KEY, SERIES = "subject, state, channel", "subject, channel, state"
N = 32


def rounded(df, *cols):
    return df.withColumns({c: r6(c, c) for c in cols})


def sql(query: str, *views: str, ctes: tuple[str, ...] = ()) -> str:
    return ", ".join([with_views("", *views).rstrip(), *ctes]) + " " + query


def _two_segments(s, d):
    """The annotations with a second segment of either state, missing for other subjects than the first."""
    k = F.col("subject")
    extra = {"open_start_2": F.when(k % 4 != 0, 120.0 + k % 7), "open_end_2": F.when(k % 4 != 0, 140.0 + k % 9), "closed_start_2": F.when(k % 6 != 0, 200.0 + k % 5), "closed_end_2": F.when(k % 6 != 0, 230.0 + k % 3)}
    return V.annotations_wide(s, d).withColumns(extra)


TWO = "tw AS (SELECT *, CASE WHEN subject % 4 <> 0 THEN 120.0::DOUBLE + subject % 7 END AS open_start_2, CASE WHEN subject % 4 <> 0 THEN 140.0::DOUBLE + subject % 9 END AS open_end_2, CASE WHEN subject % 6 <> 0 THEN 200.0::DOUBLE + subject % 5 END AS closed_start_2, CASE WHEN subject % 6 <> 0 THEN 230.0::DOUBLE + subject % 3 END AS closed_end_2 FROM annotations_wide)"
DURATIONS = "du AS (SELECT subject, " + ", ".join(f"CASE WHEN coalesce({s}_end_1 - {s}_start_1, {s}_end_2 - {s}_start_2) IS NOT NULL THEN coalesce({s}_end_1 - {s}_start_1, 0) + coalesce({s}_end_2 - {s}_start_2, 0) END AS {s}_s" for s in ("open", "closed")) + " FROM tw)"


def _labels(s, d):
    return V.target(s, d).select("subject", F.when(F.col("label") < 3, "low").when(F.col("label") < 7, "mid").otherwise("high").alias("grade"))


def _segments(s, d):
    """Spectra of the two halves of the bins as two segments of one state."""
    return V.spectrum(s, d).select("subject", "state", "channel", (F.col("k") % 2 + 1).alias("segment"), F.lit(1.0).alias("duration"), F.floor(F.col("k") / 2).cast("int").alias("k"), "freq", "power")


PLACES = {"ch0": (4, 1.0), "ch1": (1, 3.0), "ch2": (2, 2.0), "ch3": (3, -1.0), "ch4": (6, 0.5)}
PLACED = "pl AS (SELECT unnest(['" + "', '".join(PLACES) + "']) AS channel, unnest([" + ", ".join(str(n % 2) for n, _ in PLACES.values()) + "]) AS odd, unnest([" + ", ".join(str(y) for _, y in PLACES.values()) + "]::DOUBLE[]) AS y), pw AS (SELECT subject, state, band_id, bp.channel, sqrt(p) AS v, odd, y FROM bp JOIN pl USING (channel))"
ASYMMETRY = "as_ AS (SELECT a.subject, a.state, a.band_id, a.channel AS a, b.channel AS b, CASE WHEN CASE WHEN a.odd <> b.odd THEN a.odd = 1 ELSE a.y > b.y END THEN a.v - b.v ELSE b.v - a.v END / nullif(a.v + b.v, 0) AS g FROM pw a JOIN pw b ON a.subject = b.subject AND a.state = b.state AND a.band_id = b.band_id AND a.channel < b.channel)"


def _epoch_lengths(s, d):
    """Curve length of each epoch."""
    e = T.epochs(V.samples(s, d), N, 16).withColumnRenamed("i", "t_idx")
    return X.curve_length(e, by=["subject", "channel", "state", "epoch"])


EPOCHS = f"ep AS (SELECT {SERIES}, e AS epoch, t_idx - e * 16 AS i, x FROM (SELECT *, unnest(range(greatest((t_idx - 31 + 15) // 16, 0), least(t_idx // 16, (n - 32) // 16) + 1)) AS e FROM (SELECT *, count(*) OVER (PARTITION BY {SERIES}) AS n FROM samples) WHERE n >= 32))"
LENGTHS = f"cl AS (SELECT {SERIES}, epoch, sum(sqrt(1 + d * d)) AS v FROM (SELECT *, x - lag(x) OVER (PARTITION BY {SERIES}, epoch ORDER BY i) AS d FROM ep) GROUP BY ALL)"
MOMENTS = "avg((v - m) ** 3) / nullif(avg((v - m) ** 2) ** 1.5, 0)", "avg((v - m) ** 4) / nullif(avg((v - m) ** 2) ** 2, 0) - 3"

REGIONS = {"a": [f"f{i:02d}" for i in range(8)], "b": [f"f{i:02d}" for i in range(4, 20)]}
IN_REGIONS = "ro AS (SELECT subject, roi, value AS v, avg(value) OVER (PARTITION BY subject, roi) AS m FROM features JOIN (SELECT 'a' AS roi, 'f0' || i AS key FROM range(8) t(i) UNION ALL SELECT 'b', 'f' || lpad(i::VARCHAR, 2, '0') FROM range(4, 20) t(i)) USING (key))"


def _odd_cells(s, d):
    """Features with nulls, NaN and infinities."""
    k = F.col("subject") % 9
    v = F.when(k == 0, F.lit(None).cast("double")).when(k == 1, float("nan")).when(k == 2, float("inf")).when(k == 3, float("-inf")).otherwise(F.col("value"))
    return V.features(s, d).where("key < 'f04'").withColumn("value", v)


def _fold_scores(s, d):
    p = V.predictions(s, d).withColumn("fold", (F.col("subject") % 5).cast("long"))
    e = F.abs(F.col("p") - F.col("y"))
    return p.groupBy("model", "fold").agg(F.avg(e).alias("score"), F.stddev_pop(e).alias("sd"))


def _written_clinical(s, d):
    """The clinical rows as CSV files, read back by name; a file of an appendix lies beside them."""
    rows, path = V.clinical(s, d).select("row_id", "subject", "symptom", "present", "score"), new_path(s, "clinical")
    rows.write.option("header", True).csv(path)
    rows.write.mode("append").option("header", True).csv(f"{path}/appendix_rows")
    return stores.read_clinical(s, path, "row_id long, subject long, symptom string, present int, score double")


def _written_samples(s, d):
    path = new_path(s, "samples")
    V.samples(s, d).write.partitionBy("state").parquet(path)
    return stores.read_samples(s, path, first=3, state="open").select("subject", "channel", "state", "t_idx", "x")


def _stored(s, d):
    """Two results in one store; the one of the other parameters comes back."""
    table = new_path(s, "results")
    for lo in (1.0, 4.0):
        stores.write_result(T.band_limit(V.spectrum(s, d), lo, 40.0).groupBy("subject").agg(F.count("*").alias("n")), table, {"lo": lo, "hi": 40.0})
    return stores.read_result(s, table, {"hi": 40.0, "lo": 4.0})


def _compatible(s, d):
    table = new_path(s, "results")
    for model, lo in (("a", 1.0), ("b", 4.0)):
        stores.write_result(T.band_limit(V.spectrum(s, d), lo, 40.0).groupBy("subject").agg(F.count("*").alias("n")), table, {"model": model, "lo": lo, "seed": 7})
    return stores.read_params_compatible(s, table, {"model": "a", "seed": 7})


def _counted(lo: float) -> str:
    return sql(f"SELECT subject, count(*) AS n FROM spectrum WHERE freq BETWEEN {lo} AND 40 GROUP BY subject", "spectrum")


def _perm_sql(order: int, delay: int) -> str:
    leads = ", ".join(f"lead(x, {delay * k}) OVER w AS v{k}" if k else "x AS v0" for k in range(order))
    pattern = " || ',' || ".join(f"({' + '.join(f'(v{j} < v{k} OR (v{j} = v{k} AND {j} < {k}))::INT' for j in range(order) if j != k)})" for k in range(order))
    return sql(f"SELECT {SERIES}, round((log2(sum(n)) - sum(n * log2(n)) / sum(n)) / log2({'*'.join(map(str, range(1, order + 1)))}), 6) AS perm_entropy FROM (SELECT {SERIES}, {pattern} AS p, count(*)::DOUBLE AS n FROM (SELECT {SERIES}, {leads} FROM samples WINDOW w AS (PARTITION BY {SERIES} ORDER BY t_idx)) WHERE v{order - 1} IS NOT NULL GROUP BY ALL) GROUP BY {SERIES}", "samples")


def _bands_sql(some) -> str:
    rows = "bands AS (SELECT unnest(range(%d))::INT AS band_id, unnest(%s::DOUBLE[]) AS lo, unnest(%s::DOUBLE[]) AS hi)" % (len(some), [a for a, _ in some], [b for _, b in some])
    return with_views("", "spectrum").rstrip() + f", {rows}, bp AS (SELECT {KEY}, band_id, sum(power) AS p FROM spectrum JOIN bands ON freq >= lo AND freq < hi GROUP BY ALL) SELECT subject, band_id, round(avg(p), 6) AS mean_power FROM bp GROUP BY ALL"


#: Presets with their divisions, as bands of the spectra.
PRESETS = {"log_standard": bands("log-standard", 2, True), "custom": bands("custom"), "linear": bands("linear_20", 2), "log": bands("log_100", 3)}

QUERIES = {
    **{f"sp21_band_sums_{name}": ((lambda s, d, some=some: rounded(P.band_sums(V.spectrum(s, d), some), "mean_power")), _bands_sql(some)) for name, some in PRESETS.items()},
    "co12_assign_category_where": (
        lambda s, d: C.assign_category(V.clinical(s, d), "subject", "symptom", ["1-URGENT", "2-HIGH", "3-MEDIUM"], "none", F.col("present") == 1),
        sql("SELECT subject, coalesce(['1-URGENT', '2-HIGH', '3-MEDIUM'][min(CASE symptom WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 END) FILTER (present = 1)], 'none') AS category FROM clinical GROUP BY subject", "clinical"),
    ),
    "co15_select_features": (
        lambda s, d: rounded(C.select_by_label(V.features(s, d), _labels(s, d), "subject", "grade", ["low", "high"], "f1"), "value"),
        sql("SELECT subject, key, round(value, 6) AS value FROM features JOIN target USING (subject) WHERE (label < 3 OR label >= 7) AND key LIKE '%f1%'", "features", "target"),
    ),
    "co18_annotation_summary_two": (
        lambda s, d: C.annotation_summary(_two_segments(s, d), 2),
        sql("SELECT subject, open_s, closed_s, coalesce(open_s, 0.0::DOUBLE) + coalesce(closed_s, 0.0::DOUBLE) AS total_s, open_s IS NULL OR closed_s IS NULL AS skip, open_s IS NULL AND closed_s IS NULL AS missing_both FROM du", "annotations_wide", ctes=(TWO, DURATIONS)),
    ),
    "co19_unpivot_annotations_two": (
        lambda s, d: C.unpivot_annotations(_two_segments(s, d), 2),
        sql("SELECT * FROM (" + " UNION ALL ".join(f"SELECT subject, '{s}' AS state, {k} AS segment, {s}_start_{k} AS t0, {s}_end_{k} AS t1 FROM tw" for s in ("open", "closed") for k in (1, 2)) + ") WHERE t0 IS NOT NULL AND t1 IS NOT NULL", "annotations_wide", ctes=(TWO,)),
    ),
    "co20_common_channels_named": (lambda s, d: C.common_channels(V.samples(s, d), ["view"], "p"), sql("SELECT channel FROM samples WHERE channel NOT LIKE 'p%' AND channel <> 'view' GROUP BY channel HAVING count(DISTINCT (subject, state)) = (SELECT count(DISTINCT (subject, state)) FROM samples WHERE channel NOT LIKE 'p%')", "samples")),
    "co23_isolate_channel_rows": (lambda s, d: rounded(C.isolate_channels(V.samples(s, d), "X|ECG|VIEW"), "x"), sql(f"SELECT {SERIES}, t_idx, round(x, 6) AS x FROM samples WHERE NOT regexp_matches(upper(channel), 'X|ECG|VIEW')", "samples")),
    "co27_baseline_scores": (
        lambda s, d: C.baseline_scores(V.table(s, d, "customer").select(F.col("c_custkey").alias("subject"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_acctbal")).alias("ACE_Baseline_Score"), F.col("c_custkey").alias("Visit_Score"), F.lit(1.5).alias("Baseline_Score_2"))),
        "SELECT c_custkey AS subject, coalesce(CASE WHEN c_custkey % 4 > 0 THEN c_acctbal::DOUBLE END, 0.0::DOUBLE) AS \"ACE_Baseline_Score\", 1.5::DOUBLE AS \"Baseline_Score_2\" FROM customer",
    ),
    "io01_read_clinical": (lambda s, d: _written_clinical(s, d), sql("SELECT row_id, subject, symptom, present, score FROM clinical", "clinical")),
    "io02_read_samples": (lambda s, d: rounded(_written_samples(s, d), "x"), sql(f"SELECT {SERIES}, t_idx, round(x, 6) AS x FROM samples WHERE state = 'open' AND subject IN (SELECT DISTINCT subject FROM samples WHERE state = 'open' ORDER BY subject LIMIT 3)", "samples")),
    "io03_missing_recordings": (
        lambda s, d: C.missing_recordings(V.samples(s, d).where("subject <> 3 OR state = 'open'"), V.target(s, d).where("subject < 12"), ["open", "closed", "rest"]),
        sql("SELECT t.subject, count(DISTINCT state) AS n_recordings, count(DISTINCT channel) AS n_channels, coalesce(string_agg(DISTINCT state, ',' ORDER BY state), '') AS present, array_to_string(list_filter(['closed', 'open', 'rest'], lambda v: NOT list_contains(coalesce(list(DISTINCT state) FILTER (state IS NOT NULL), []), v)), ',') AS missing FROM (SELECT subject FROM target WHERE subject < 12) t LEFT JOIN (SELECT * FROM samples WHERE subject <> 3 OR state = 'open') s USING (subject) GROUP BY t.subject", "samples", "target"),
    ),
    "io04_write_result": (_stored, _counted(4.0)),
    "io05_read_compatible": (_compatible, _counted(1.0)),
    "sg01_reref_average_without": (
        lambda s, d: rounded(T.reref_average(V.samples(s, d), ["view"]), "y").select("subject", "channel", "state", "t_idx", "y"),
        sql(f"SELECT {SERIES}, t_idx, round(CASE WHEN channel = 'view' THEN x ELSE x - avg(x) FILTER (channel <> 'view') OVER (PARTITION BY subject, state, t_idx) END, 6) + 0 AS y FROM samples", "samples"),
    ),
    "sg07_append_channel": (
        lambda s, d: rounded(T.append_channel(T.drop_refs(V.samples(s, d), ["view", "click"]), V.samples(s, d), "view"), "x"),
        sql(f"SELECT {SERIES}, t_idx, round(x, 6) AS x FROM samples s WHERE channel NOT IN ('view', 'click') OR (channel = 'view' AND EXISTS (SELECT 1 FROM samples o WHERE o.subject = s.subject AND o.state = s.state AND o.t_idx = s.t_idx AND o.channel NOT IN ('view', 'click')))", "samples"),
    ),
    "sg10_notch_widths": (lambda s, d: T.notch(V.spectrum(s, d), [60.0, 120.0], [4.0, 12.0]).select("subject", "state", "channel", "k"), sql(f"SELECT {KEY}, k FROM spectrum WHERE NOT (abs(freq - 60) <= 2 OR abs(freq - 120) <= 6)", "spectrum")),
    "sp02_welch": (
        lambda s, d: rounded(P.welch(V.samples(s, d), N, 16, 1.0, 0.05, 0.4), "freq", "power"),
        sql(f"SELECT {KEY}, k::INT AS k, round(k / 32, 6) AS freq, round(avg(2 * (re * re + im * im) / 12), 6) AS power FROM co WHERE k / 32 BETWEEN 0.05 AND 0.4 GROUP BY {KEY}, k", "samples", ctes=(
            EPOCHS, f"hn AS (SELECT {KEY}, epoch, i, (x - avg(x) OVER (PARTITION BY {KEY}, epoch)) * (0.5 - 0.5 * cos(2 * pi() * i / 32)) AS y FROM ep)", f"co AS (SELECT {KEY}, epoch, k, sum(y * cos(2 * pi() * k * i / 32)) AS re, sum(y * sin(2 * pi() * k * i / 32)) AS im FROM hn, range(17) r(k) GROUP BY ALL)",
        )),
    ),
    "sp04_second_segment": (lambda s, d: rounded(P.average_segments(_segments(s, d), "second"), "power"), sql(f"SELECT {KEY}, (k // 2)::INT AS k, freq, round(power, 6) AS power FROM spectrum WHERE k % 2 = 1", "spectrum")),
    "sp06_band_shapes": (
        lambda s, d: rounded(P.band_shapes(V.spectrum(s, d), [5.0, 90.0]), "skew", "p5", "p90"),
        Q.sql(f"SELECT {KEY}, band_id, count(*) AS n, round({MOMENTS[0]}, 6) + 0 AS skew, round(quantile_cont(v, 0.05), 6) AS p5, round(quantile_cont(v, 0.9), 6) AS p90 FROM (SELECT {KEY}, band_id, lp AS v, avg(lp) OVER (PARTITION BY {KEY}, band_id) AS m FROM inner_bins JOIN bands ON freq BETWEEN lo AND hi) GROUP BY {KEY}, band_id", Q.INNER),
    ),
    "sp17_fit_errors": (
        lambda s, d: rounded(P.fit_errors(V.spectrum(s, d), P.aperiodic_fixed(V.spectrum(s, d), 2.0, 40.0)), "r2", "mae", "mse", "rmse", "mape"),
        Q.sql(f"SELECT {KEY}, round(corr(lp, m) ** 2, 6) AS r2, round(avg(abs(lp - m)), 6) AS mae, round(avg((lp - m) ** 2), 6) AS mse, round(sqrt(avg((lp - m) ** 2)), 6) AS rmse, round(100 * avg(abs(lp - m) / nullif(abs(lp), 0)), 6) AS mape FROM (SELECT {KEY}, log10(power) AS lp, o - e * log10(freq) AS m FROM spectrum JOIN (SELECT {KEY}, regr_intercept(lp, lf) AS o, -regr_slope(lp, lf) AS e FROM x2 JOIN c USING ({KEY}) WHERE flat <= q GROUP BY {KEY}) f USING ({KEY})) GROUP BY {KEY}", Q.FIT),
    ),
    "sp19_mean_relative_power": (lambda s, d: rounded(P.mean_relative_power(P.band_power(V.spectrum(s, d))), "mean_rel"), Q.sql(f"SELECT subject, state, band_id, round(avg(rel), 6) AS mean_rel FROM (SELECT *, p / sum(p) OVER (PARTITION BY {KEY}) AS rel FROM bp) GROUP BY subject, state, band_id", Q.POWER)),
    "sp20_all_asymmetries": (
        lambda s, d: rounded(P.all_asymmetries(P.band_power(V.spectrum(s, d)), PLACES), "asymmetry"),
        Q.sql("SELECT subject, state, band_id, unnest([a, b]) AS a, unnest([b, a]) AS b, round(g, 6) + 0 AS asymmetry FROM as_", Q.POWER, PLACED, ASYMMETRY),
    ),
    "cx02_curve_length_scaled": (
        lambda s, d: rounded(X.curve_length(V.samples(s, d), 0.5, scale=3.0, normalize=True), "curve_length"),
        sql(f"SELECT {SERIES}, round(sum(sqrt(0.25 + d * d)), 6) AS curve_length FROM (SELECT {SERIES}, 3 * (x - lag(x) OVER (PARTITION BY {SERIES} ORDER BY t_idx)) / (max(x) OVER (PARTITION BY {SERIES}) - min(x) OVER (PARTITION BY {SERIES})) AS d FROM samples) GROUP BY {SERIES}", "samples"),
    ),
    "cx04_perm_entropy_order_4": (lambda s, d: rounded(X.ordinal_entropy(V.samples(s, d), 4, 2), "perm_entropy"), _perm_sql(4, 2)),
    "cx05_svd_entropy_order_2": (
        lambda s, d: rounded(X.svd_entropy_of(V.samples(s, d), 2, 3), "svd_entropy"),
        sql(f"SELECT {SERIES}, round(-(u * log2(u) + v * log2(v)), 6) AS svd_entropy FROM (SELECT {SERIES}, sqrt(m + r) / (sqrt(m + r) + sqrt(m - r)) AS u, sqrt(m - r) / (sqrt(m + r) + sqrt(m - r)) AS v FROM (SELECT {SERIES}, (sum(x * x) + sum(y * y)) / 2 AS m, sqrt(((sum(x * x) - sum(y * y)) / 2) ** 2 + sum(x * y) ** 2) AS r FROM (SELECT *, lead(x, 3) OVER (PARTITION BY {SERIES} ORDER BY t_idx) AS y FROM samples) WHERE y IS NOT NULL GROUP BY {SERIES}))", "samples"),
    ),
    "ts03_upsample": (
        lambda s, d: rounded(T.upsample(V.samples(s, d), 4), "x"),
        sql(f"SELECT {SERIES}, t_idx * 4 + i AS t_idx, round(x + coalesce(x1 - x, 0) * i / 4, 6) AS x FROM (SELECT *, unnest(range(CASE WHEN x1 IS NULL THEN 1 ELSE 4 END)) AS i FROM (SELECT *, lead(x) OVER (PARTITION BY {SERIES} ORDER BY t_idx) AS x1 FROM samples))", "samples"),
    ),
    "io06_manifest_by_visit": (
        lambda s, d: C.recordings_manifest(V.clinical(s, d).select("subject", "symptom", F.when(F.col("present") == 1, F.concat(F.lit("rec_"), F.col("subject"), F.lit("_"), F.col("row_id") % 2)).alias("file")), ["subject", "symptom"], "file"),
        sql("SELECT subject, symptom, CASE count(DISTINCT f) WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'many' END AS status, CASE WHEN count(DISTINCT f) = 1 THEN max(f) END AS file FROM (SELECT subject, symptom, CASE WHEN present = 1 THEN 'rec_' || subject || '_' || (row_id % 2) END AS f FROM clinical) GROUP BY ALL", "clinical"),
    ),
    "cx12_higuchi_fd_10": (
        lambda s, d: rounded(X.higuchi_fd(V.samples(s, d), 10), "higuchi_fd"),
        sql(f"SELECT {SERIES}, round(regr_slope(ln(len), ln(1.0::DOUBLE / k)), 6) AS higuchi_fd FROM (SELECT {SERIES}, k, avg(len) AS len FROM (SELECT {SERIES}, k, t_idx % k AS m, sum(d) * (any_value(n) - 1) / (((any_value(n) - t_idx % k - 1) // k) * k * k) AS len FROM (SELECT a.subject, a.channel, a.state, a.t_idx, k, abs(a.x - b.x) AS d, n FROM (SELECT *, count(*) OVER (PARTITION BY {SERIES}) AS n FROM samples) a, range(1, 11) r(k) JOIN samples b ON b.subject = a.subject AND b.channel = a.channel AND b.state = a.state AND b.t_idx = a.t_idx - k) GROUP BY {SERIES}, k, t_idx % k) GROUP BY {SERIES}, k) GROUP BY {SERIES}", "samples"),
    ),
    "cx13_feature_distribution": (
        lambda s, d: rounded(X.feature_distribution(_epoch_lengths(s, d), "curve_length"), "mean", "std", "median", "iqr", "skew", "kurt"),
        sql(f"SELECT {SERIES}, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(median(v), 6) AS median, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr, round({MOMENTS[0]}, 6) + 0 AS skew, round({MOMENTS[1]}, 6) + 0 AS kurt FROM (SELECT *, avg(v) OVER (PARTITION BY {SERIES}) AS m FROM cl) GROUP BY {SERIES}", "samples", ctes=(EPOCHS, LENGTHS)),
    ),
    "fa03_regional_shapes": (
        lambda s, d: rounded(S.regional_shapes(V.features(s, d), REGIONS, [10.0]), "skew", "kurt", "iqr", "p10"),
        sql(f"SELECT subject, roi, round({MOMENTS[0]}, 6) + 0 AS skew, round({MOMENTS[1]}, 6) + 0 AS kurt, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr, round(quantile_cont(v, 0.1), 6) AS p10 FROM ro GROUP BY subject, roi", "features", ctes=(IN_REGIONS,)),
    ),
    "fa07_subject_range": (
        lambda s, d: rounded(S.subject_range(V.features(s, d), V.target(s, d).select("subject", F.col("label").alias("position")), 50, 80), "value"),
        sql("SELECT subject, key, round(value, 6) AS value FROM features WHERE subject IN (SELECT subject FROM (SELECT subject, row_number() OVER (ORDER BY label, subject) AS r FROM target) WHERE r > 50 AND r <= 80)", "features", "target"),
    ),
    "fs03_low_variance_keys": (
        lambda s, d: rounded(S.low_variance_keys(V.features(s, d).withColumn("value", F.when(F.col("key") < "f03", 1.0).otherwise(F.col("value"))), 0.0156), "variance"),
        sql("SELECT key, round(var_pop(v), 6) AS variance, count(DISTINCT v) AS n_unique, count(DISTINCT v) <= 1 AS static FROM (SELECT key, CASE WHEN key < 'f03' THEN 1.0::DOUBLE ELSE value END AS v FROM features) GROUP BY key HAVING NOT var_pop(v) > 0.0156", "features"),
    ),
    "fs04_fill_cells": (
        lambda s, d: rounded(S.fill_cells(_odd_cells(s, d), 0.25, 9.0, -9.0), "value"),
        sql("SELECT subject, key, round(CASE subject % 9 WHEN 0 THEN 0.25 WHEN 1 THEN 0.25 WHEN 2 THEN 9.0 WHEN 3 THEN -9.0 ELSE value END, 6) AS value FROM features WHERE key < 'f04'", "features"),
    ),
    "fs09_anova_confidence": (
        lambda s, d: rounded(S.anova_confidence(V.features(s, d), V.target(s, d).select("subject", F.col("label").alias("y"))), "score", "confidence"),
        sql("SELECT key, round(f, 6) AS score, round(least(2 * list_sum(list_transform(range(2001), lambda i: CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * sin(t * i / 2000) ** (d1 - 1) * cos(t * i / 2000) ** (d2 - 1))) * t / 6000 / exp(lgamma(d1 / 2) + lgamma(d2 / 2) - lgamma((d1 + d2) / 2)), 1), 6) AS confidence FROM (SELECT *, asin(sqrt(d1 * f / (d1 * f + d2))) AS t FROM (SELECT key, (count(*) - 1)::DOUBLE AS d1, (sum(n) - count(*))::DOUBLE AS d2, (sum(n * (m - gm) ** 2) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS f FROM (SELECT *, sum(n * m) OVER (PARTITION BY key) / sum(n) OVER (PARTITION BY key) AS gm FROM (SELECT key, label, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM features JOIN target USING (subject) GROUP BY ALL)) GROUP BY key))", "features", "target"),
    ),
    "fs12_scale_scores": (
        lambda s, d: rounded(S.select_threshold(S.scale_scores(S.score_pearson(V.features(s, d), V.target(s, d).select("subject", "y"))), 0.6, 5), "score"),
        sql("SELECT key, round(score, 6) AS score FROM (SELECT key, (c - min(c) OVER ()) / (max(c) OVER () - min(c) OVER ()) AS score, row_number() OVER (ORDER BY c DESC, key) AS r FROM (SELECT key, abs(corr(value, y)) AS c FROM features JOIN target USING (subject) GROUP BY key)) WHERE score > 0.6 OR r <= 5", "features", "target"),
    ),
    "ev08_group_reports": (
        lambda s, d: rounded(E.group_reports(V.predictions(s, d).withColumn("site", F.col("subject") % 3), "site"), "precision", "recall", "f1"),
        sql("SELECT model, overall, g AS \"group\", k::INT AS class, sum((y = k)::INT)::BIGINT AS support, round(sum((c = k AND y = k)::INT) / nullif(sum((c = k)::INT), 0), 6) AS precision, round(sum((c = k AND y = k)::INT) / nullif(sum((y = k)::INT), 0), 6) AS recall, round(2 * sum((c = k AND y = k)::INT) / nullif(sum((c = k)::INT) + sum((y = k)::INT), 0), 6) AS f1 FROM (SELECT *, (p >= 0.5)::INT AS c, unnest([true, false]) AS overall, unnest([NULL, (subject % 3)::VARCHAR]) AS g FROM predictions), range(2) t(k) GROUP BY ALL", "predictions"),
    ),
    "ev19_contingency": (
        lambda s, d: rounded(E.contingency(V.table(s, d, "labels"), "quality", "toxic"), "expected"),
        "WITH n AS (SELECT q.quality, t.toxic, (SELECT count(*) FROM labels l WHERE l.quality = q.quality AND l.toxic = t.toxic) AS n FROM (SELECT DISTINCT quality FROM labels) q, (SELECT DISTINCT toxic FROM labels) t) SELECT quality, toxic, n, round(sum(n) OVER (PARTITION BY quality) * sum(n) OVER (PARTITION BY toxic) / sum(n) OVER (), 6) AS expected FROM n",
    ),
    "ev23_split_scores": (
        lambda s, d: rounded(E.split_scores(_fold_scores(s, d)), "score", "sd", "pooled_score", "pooled_sd"),
        sql("SELECT model, fold, round(score, 6) AS score, round(sd, 6) AS sd, round(avg(score) OVER (PARTITION BY model), 6) AS pooled_score, round(sqrt(sum(sd * sd) OVER (PARTITION BY model)), 6) AS pooled_sd FROM (SELECT model, subject % 5 AS fold, avg(abs(p - y)) AS score, stddev_pop(abs(p - y)) AS sd FROM predictions GROUP BY ALL)", "predictions"),
    ),
}
