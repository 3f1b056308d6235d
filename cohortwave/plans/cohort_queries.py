"""Queries of the cohort operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import r6
from ..operators import cohort as C
from ..sources import views as V
from ..sources.views import with_views as sql

SYMPTOMS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
NAMES = {s: f"s{i}" for i, s in enumerate(SYMPTOMS, 1)}


def _clinical(s, d):
    return V.clinical(s, d)


def _named(df):
    for old, new in NAMES.items():
        if old in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def _labels(s, d):
    return V.table(s, d, "customer").select(F.col("c_custkey").alias("subject"), F.col("c_mktsegment").alias("kind"))


_PIVOT = ", ".join(f"max(CASE WHEN symptom = '{s}' THEN present END) AS {n}" for s, n in NAMES.items())

QUERIES = {
    "io03_inventory": (lambda s, d: C.inventory(V.samples(s, d)), sql("SELECT subject, string_agg(DISTINCT state, ',' ORDER BY state) AS states, count(DISTINCT channel) AS n_channels, count(*) AS n_samples FROM samples GROUP BY subject", "samples")),
    "io06_recordings_manifest": (
        lambda s, d: C.recordings_manifest(V.clinical(s, d), ["subject"], "sparse_note"),
        sql("SELECT subject, CASE count(DISTINCT sparse_note) WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'many' END AS status, CASE WHEN count(DISTINCT sparse_note) = 1 THEN max(sparse_note) END AS file FROM clinical GROUP BY subject", "clinical"),
    ),
    "co01_forward_fill": (
        lambda s, d: C.forward_fill(V.clinical(s, d), ["sparse_note"], ["row_id"], ["subject"]).select("row_id", "subject", "sparse_note"),
        sql("SELECT row_id, subject, last_value(sparse_note IGNORE NULLS) OVER (PARTITION BY subject ORDER BY row_id ROWS UNBOUNDED PRECEDING) AS sparse_note FROM clinical", "clinical"),
    ),
    "co02_drop_empty_and_constant": (
        lambda s, d: C.drop_empty_and_constant(V.clinical(s, d).withColumns({"nothing": F.lit(None).cast("string"), "one": F.lit(1)})).select("row_id", "sparse_note", "present"),
        sql("SELECT row_id, sparse_note, present FROM clinical", "clinical"),
    ),
    "co03_filter_timepoint": (lambda s, d: C.filter_timepoint(V.clinical(s, d), "symptom", "2-HIGH").select("row_id", "subject"), sql("SELECT row_id, subject FROM clinical WHERE symptom = '2-HIGH'", "clinical")),
    "co04_mean_per_subject": (lambda s, d: C.mean_per_subject(V.clinical(s, d), "subject", ["score", "present"]).select("subject", r6("score", "score"), r6("present", "present")), sql("SELECT subject, round(avg(score), 6) AS score, round(avg(present), 6) AS present FROM clinical GROUP BY subject", "clinical")),
    "co05_pivot_symptoms": (lambda s, d: _named(C.pivot_symptoms(V.clinical(s, d), "subject", "symptom", "present", "score", SYMPTOMS)).withColumn("mean_score", r6("mean_score", "mean_score")), sql(f"SELECT subject, {_PIVOT}, round(avg(score), 6) AS mean_score FROM clinical GROUP BY subject", "clinical")),
    "co06_add_missing_subjects": (
        lambda s, d: C.add_missing_subjects(V.clinical(s, d).groupBy("subject").agg(F.count("*").alias("n")), _labels(s, d), "subject", 0),
        sql("SELECT c_custkey AS subject, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT subject, count(*) AS n FROM clinical GROUP BY subject) q ON q.subject = c_custkey", "clinical"),
    ),
    "co07_row_total": (
        lambda s, d: C.row_total(C.pivot_symptoms(V.clinical(s, d), "subject", "symptom", "present", "score", SYMPTOMS), "-", "total").select("subject", F.col("total").cast("long").alias("total")),
        sql("SELECT subject, sum(p)::BIGINT AS total FROM (SELECT subject, symptom, max(present) AS p FROM clinical GROUP BY ALL) GROUP BY subject", "clinical"),
    ),
    "co08_one_hot": (lambda s, d: _named(C.one_hot(V.clinical(s, d), "subject", "symptom", SYMPTOMS)), sql("SELECT subject, " + ", ".join(f"max((symptom = '{s}')::INT) AS {n}" for s, n in NAMES.items()) + " FROM clinical GROUP BY subject", "clinical")),
    "co09_impute_controls": (
        lambda s, d: C.impute_controls(C.mean_per_subject(V.clinical(s, d), "subject", ["score"]), _labels(s, d).join(V.clinical(s, d), "subject", "left_anti"), "subject", {"score": 15.0}).select("subject", r6("score", "score")),
        sql("SELECT subject, round(avg(score), 6) AS score FROM clinical GROUP BY subject UNION ALL SELECT c_custkey, 15.0 FROM customer WHERE c_custkey NOT IN (SELECT subject FROM clinical)", "clinical"),
    ),
    "co10_recode": (lambda s, d: V.clinical(s, d).select("row_id", C.recode(F.col("symptom"), {"1-URGENT": 1, "2-HIGH": 1}, 0).alias("coded")), sql("SELECT row_id, CASE WHEN symptom IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS coded FROM clinical", "clinical")),
    "co11_merge_outer": (
        lambda s, d: C.merge_outer([V.clinical(s, d).where(F.col("symptom") == k).groupBy("subject").agg(F.count("*").alias(n)) for k, n in NAMES.items()], "subject", 0),
        sql("SELECT subject, " + ", ".join(f"count(*) FILTER (symptom = '{s}') AS {n}" for s, n in NAMES.items()) + " FROM clinical GROUP BY subject", "clinical"),
    ),
    "co12_assign_category": (
        lambda s, d: C.assign_category(V.clinical(s, d), "subject", "symptom", ["5-LOW", "1-URGENT"], "other"),
        sql("SELECT subject, CASE WHEN bool_or(symptom = '5-LOW') THEN '5-LOW' WHEN bool_or(symptom = '1-URGENT') THEN '1-URGENT' ELSE 'other' END AS category FROM clinical GROUP BY subject", "clinical"),
    ),
    "co13_build_labels": (lambda s, d: C.build_labels(_labels(s, d), "subject", "kind", "BUILDING"), "SELECT DISTINCT c_custkey AS subject, (c_mktsegment = 'BUILDING')::INT AS y FROM customer"),
    "co14_check_labels": (
        lambda s, d: C.check_labels(C.build_labels(_labels(s, d), "subject", "kind", "BUILDING"), V.clinical(s, d).groupBy("subject").agg(F.max("present").alias("y")), "subject"),
        sql("SELECT subject, a.y AS ya, b.y AS yb, CASE WHEN a.y IS NULL THEN 'absent_left' WHEN b.y IS NULL THEN 'absent_right' ELSE 'differs' END AS problem FROM (SELECT c_custkey AS subject, (c_mktsegment = 'BUILDING')::INT AS y FROM customer) a FULL JOIN (SELECT subject, max(present) AS y FROM clinical GROUP BY subject) b USING (subject) WHERE a.y IS DISTINCT FROM b.y", "clinical"),
    ),
    "co15_select_by_label": (
        lambda s, d: C.select_by_label(V.clinical(s, d), _labels(s, d), "subject", "kind", ["BUILDING", "MACHINERY"]).select("row_id", "subject"),
        sql("SELECT row_id, subject FROM clinical WHERE subject IN (SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))", "clinical"),
    ),
    "co16_select_split": (
        lambda s, d: C.select_split(V.target(s, d), V.splits(s, d), ["train", "ival"], V.target(s, d).where("label = 3")),
        sql("SELECT t.* FROM target t JOIN splits USING (subject) WHERE split IN ('train', 'ival') AND label <> 3", "target", "splits"),
    ),
    "co17_check_split_disjoint": (
        lambda s, d: C.split_report(V.splits(s, d), V.target(s, d)),
        sql("SELECT split, count(*) AS n, sum(y)::BIGINT AS n_positive, sum((k > 1)::INT)::BIGINT AS n_shared FROM splits JOIN (SELECT subject, count(DISTINCT split) AS k FROM splits GROUP BY subject) USING (subject) JOIN target USING (subject) GROUP BY split", "splits", "target"),
    ),
    "co18_annotation_summary": (
        lambda s, d: C.annotation_summary(V.annotations_wide(s, d)),
        sql("SELECT subject, open_end_1 - open_start_1 AS open_s, closed_end_1 - closed_start_1 AS closed_s, coalesce(open_end_1 - open_start_1, 0.0::DOUBLE) + coalesce(closed_end_1 - closed_start_1, 0.0::DOUBLE) AS total_s, (open_end_1 - open_start_1 IS NULL OR closed_end_1 - closed_start_1 IS NULL) AS skip, (open_end_1 - open_start_1 IS NULL AND closed_end_1 - closed_start_1 IS NULL) AS missing_both FROM annotations_wide", "annotations_wide"),
    ),
    "co19_unpivot_annotations": (
        lambda s, d: C.unpivot_annotations(V.annotations_wide(s, d)),
        sql("SELECT * FROM (SELECT subject, 'open' AS state, 1 AS segment, open_start_1 AS t0, open_end_1 AS t1 FROM annotations_wide UNION ALL SELECT subject, 'closed', 1, closed_start_1, closed_end_1 FROM annotations_wide) WHERE t0 IS NOT NULL AND t1 IS NOT NULL", "annotations_wide"),
    ),
    "co20_common_channels": (
        lambda s, d: C.common_channels(V.samples(s, d), ["view"]),
        sql("SELECT channel FROM samples WHERE channel <> 'view' GROUP BY channel HAVING count(DISTINCT (subject, state)) = (SELECT count(*) FROM (SELECT DISTINCT subject, state FROM samples))", "samples"),
    ),
    "co21_channel_groups": (
        lambda s, d: C.channel_groups(V.samples(s, d)),
        sql("SELECT layout, count(*) AS n_subjects, string_agg(subject::VARCHAR, ',' ORDER BY subject) AS subjects FROM (SELECT subject, string_agg(DISTINCT channel, ',' ORDER BY channel) AS layout FROM samples GROUP BY subject) GROUP BY layout", "samples"),
    ),
    "co22_first_listed_channel": (lambda s, d: V.table(s, d, "customer").select("c_custkey", C.first_listed(F.concat_ws(",", "c_mktsegment", "c_name")).alias("first")), "SELECT c_custkey, trim(split_part(concat_ws(',', c_mktsegment, c_name), ',', 1)) AS first FROM customer"),
    "co23_isolate_channels": (lambda s, d: C.isolate_channels(V.samples(s, d), "VIEW|CLICK").groupBy("channel").agg(F.count("*").alias("n")), sql("SELECT channel, count(*) AS n FROM samples WHERE NOT regexp_matches(upper(channel), 'VIEW|CLICK') GROUP BY channel", "samples")),
}
