"""Relational operators on cohort tables: filling, pivoting, labelling, joining, checking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def forward_fill(df: DataFrame, cols: list[str], order_by: list[str], partition_by: list[str]) -> DataFrame:
    """Repeat the last value down through nulls, in the given order."""
    w = Window.partitionBy(*partition_by).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def drop_empty_and_constant(df: DataFrame) -> DataFrame:
    """Without the columns that are all null or have one value, found in one pass, and without all-null rows."""
    stats = df.agg(*[F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(df.columns)], *[F.min(c).eqNullSafe(F.max(c)).alias(f"s{i}") for i, c in enumerate(df.columns)]).first()
    return df.select(*[c for i, c in enumerate(df.columns) if not stats[f"s{i}"]]).dropna(how="all")


def filter_timepoint(df: DataFrame, col: str, value: str, contains: bool = False) -> DataFrame:
    """Rows of one visit; with contains, those whose label holds it but is longer."""
    return df.where(F.col(col).contains(value) & (F.col(col) != value) if contains else F.col(col) == value)


def mean_per_subject(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    return df.groupBy(key).agg(*[F.avg(c).alias(c) for c in cols])


def pivot_symptoms(df: DataFrame, key: str, kind: str, presence: str, score: str, kinds: list[str]) -> DataFrame:
    """A column for each symptom, its highest presence, and the mean score; one shuffle for both."""
    return df.groupBy(key).agg(*[F.max(F.when(F.col(kind) == k, F.col(presence))).alias(k) for k in kinds], F.avg(score).alias("mean_score"))


def add_missing_subjects(df: DataFrame, subjects: DataFrame, key: str, default) -> DataFrame:
    """All subjects, with the default where df has no row."""
    return subjects.select(key).distinct().join(df, key, "left").fillna(default)


def row_total(df: DataFrame, part: str, name: str) -> DataFrame:
    """The sum of the columns whose name holds part, nulls as 0."""
    return df.withColumn(name, reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in df.columns if part in c], F.lit(0)))


def one_hot(df: DataFrame, key: str, col: str, values: list[str]) -> DataFrame:
    return df.groupBy(key).agg(*[F.max((F.col(col) == v).cast("int")).alias(v) for v in values]).fillna(0)


def impute_controls(df: DataFrame, controls: DataFrame, key: str, defaults: dict) -> DataFrame:
    """Measured rows, and constants for control subjects."""
    return df.select(key, *defaults).unionByName(controls.select(key, *[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in defaults.items()]))


def recode(col: Column, mapping: dict, otherwise=None) -> Column:
    return reduce(lambda out, kv: out.when(col == kv[0], F.lit(kv[1])), mapping.items(), F.when(F.lit(False), F.lit(None))).otherwise(F.lit(otherwise))


def merge_outer(tables: list[DataFrame], on: str, fill=None) -> DataFrame:
    """Full outer join of subject tables on one key, which they share a shuffle for."""
    out = reduce(lambda a, b: a.join(b, on, "full_outer"), tables)
    return out if fill is None else out.fillna(fill)


def assign_category(df: DataFrame, key: str, col: str, options: list[str], rest: str, condition: Column | None = None) -> DataFrame:
    """The first option in order of priority that a row of the subject has, of those that meet the condition; else rest. Every subject has a category."""
    rank = recode(F.col(col), {v: i for i, v in enumerate(options)})
    rank = rank if condition is None else F.when(condition, rank)
    first = df.groupBy(key).agg(F.min(rank.cast("int")).alias("i"))
    return first.select(key, F.coalesce(F.get(F.array(*map(F.lit, options)), F.col("i")), F.lit(rest)).alias("category"))


def build_labels(df: DataFrame, key: str, col: str, positive: str) -> DataFrame:
    return df.select(key, (F.col(col) == positive).cast("int").alias("y")).dropDuplicates()


def check_labels(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Subjects whose labels differ or are absent on one side."""
    both = a.select(key, F.col("y").alias("ya")).join(b.select(key, F.col("y").alias("yb")), key, "full_outer")
    return both.where(~F.col("ya").eqNullSafe(F.col("yb"))).withColumn("problem", F.when(F.col("ya").isNull(), "absent_left").when(F.col("yb").isNull(), "absent_right").otherwise("differs"))


def select_by_label(data: DataFrame, labels: DataFrame, key: str, col: str, values: list, feature_contains: str | None = None, name: str = "key") -> DataFrame:
    """The rows of subjects whose label is one of the values; of long features only those whose name contains the given text."""
    some = data if feature_contains is None else data.where(F.contains(F.col(name), F.lit(feature_contains)))
    return some.join(labels.where(F.col(col).isin(values)), key, "left_semi")


def select_split(df: DataFrame, splits: DataFrame, split: list[str], skip: DataFrame, key: str = "subject") -> DataFrame:
    return df.join(splits.where(F.col("split").isin(split)), key, "left_semi").join(skip, key, "left_anti")


def split_report(splits: DataFrame, target: DataFrame, key: str = "subject") -> DataFrame:
    """Sizes and positives of each split, and how many of its subjects are in another."""
    n = splits.groupBy(key).agg(F.countDistinct("split").alias("k"))
    return splits.join(n, key).join(target, key).groupBy("split").agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("n_positive"), F.sum((F.col("k") > 1).cast("long")).alias("n_shared"))


def annotation_summary(ann: DataFrame, segments: int = 1) -> DataFrame:
    """Durations of either state over its segments, null-safe totals, and flags of what is missing. A state without any segment is null."""
    def lasting(state: str) -> Column:
        each = [F.col(f"{state}_end_{k}") - F.col(f"{state}_start_{k}") for k in range(1, segments + 1)]
        return F.when(F.coalesce(*each).isNotNull(), sum((F.coalesce(e, F.lit(0.0)) for e in each[1:]), F.coalesce(each[0], F.lit(0.0))))

    o, c = lasting("open"), lasting("closed")
    return ann.select("subject", o.alias("open_s"), c.alias("closed_s"), (F.coalesce(o, F.lit(0.0)) + F.coalesce(c, F.lit(0.0))).alias("total_s"), (o.isNull() | c.isNull()).alias("skip"), (o.isNull() & c.isNull()).alias("missing_both"))


def unpivot_annotations(ann: DataFrame, segments: int = 1) -> DataFrame:
    """An interval a row: subject, state, segment, t0, t1; those with a missing end are left out."""
    pairs = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(k).alias("segment"), F.col(f"{s}_start_{k}").alias("t0"), F.col(f"{s}_end_{k}").alias("t1")) for s in ("open", "closed") for k in range(1, segments + 1)])
    return ann.select("subject", F.explode(pairs).alias("i")).select("subject", "i.*").where("t0 IS NOT NULL AND t1 IS NOT NULL")


def common_channels(samples: DataFrame, bad: list[str], ignore_prefix: str | None = None) -> DataFrame:
    """Channels of every recording (subject and state) but the bad ones and those whose name begins with ignore_prefix."""
    samples = samples if ignore_prefix is None else samples.where(~F.startswith(F.col("channel"), F.lit(ignore_prefix)))
    total = samples.select("subject", "state").distinct().agg(F.count("*").alias("n"))
    per = samples.groupBy("channel").agg(F.countDistinct("subject", "state").alias("k"))
    return per.join(F.broadcast(total), F.col("k") == F.col("n")).where(~F.col("channel").isin(bad)).select("channel")


def channel_groups(samples: DataFrame) -> DataFrame:
    """Each layout of channels and the number of subjects that have it."""
    layout = samples.groupBy("subject").agg(F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("layout"))
    return layout.groupBy("layout").agg(F.count("*").alias("n_subjects"), F.array_join(F.array_sort(F.collect_list("subject")), ",").alias("subjects"))


def first_listed(col: Column) -> Column:
    """First token of a comma list, '' for null."""
    return F.trim(F.split_part(F.coalesce(col, F.lit("")), F.lit(","), F.lit(1)))


def isolate_channels(df: DataFrame, pattern: str = "X|EKG|ECG") -> DataFrame:
    return df.where(~F.upper("channel").rlike(pattern))


def inventory(samples: DataFrame) -> DataFrame:
    """Recordings of each subject: states, channels, samples."""
    return samples.groupBy("subject").agg(F.array_join(F.array_sort(F.collect_set("state")), ",").alias("states"), F.countDistinct("channel").alias("n_channels"), F.count("*").alias("n_samples"))


def missing_recordings(samples: DataFrame, subjects: DataFrame, states: list[str]) -> DataFrame:
    """subject, n_recordings, n_channels, present, missing of every subject: recordings are states, listed in order; a subject without samples lacks them all."""
    seen = samples.groupBy("subject").agg(F.array_sort(F.collect_set("state")).alias("s"), F.countDistinct("channel").alias("n_channels"))
    x = subjects.select("subject").distinct().join(seen, "subject", "left").withColumn("s", F.coalesce("s", F.array().cast("array<string>")))
    wanted = F.array(*[F.lit(v) for v in sorted(states)])
    return x.select("subject", F.size("s").cast("long").alias("n_recordings"), F.coalesce("n_channels", F.lit(0)).alias("n_channels"), F.array_join("s", ",").alias("present"), F.array_join(F.array_except(wanted, "s"), ",").alias("missing"))


def recordings_manifest(df: DataFrame, key: list[str], file: str) -> DataFrame:
    """One record a key: its file if there is one, and whether there is none, one or many."""
    n = F.countDistinct(file)
    return df.groupBy(*key).agg(F.when(n == 0, "none").when(n == 1, "one").otherwise("many").alias("status"), F.when(n == 1, F.max(file)).alias("file"))


def log_consistency(logs: DataFrame, onsets: str, descriptions: str) -> DataFrame:
    """The logs whose lists of onsets and of descriptions differ in length."""
    return logs.where(F.size(onsets) != F.size(descriptions))


def regression_targets(subjects: DataFrame, **tables: DataFrame) -> DataFrame:
    """subject and a total a table (subject, score), 0 where a subject has none; every subject stays."""
    for name, table in tables.items():
        subjects = subjects.join(table.groupBy("subject").agg(F.sum("score").alias(name)), "subject", "left")
    return subjects.fillna(0.0, list(tables))


def baseline_scores(df: DataFrame) -> DataFrame:
    """subject and the columns whose names hold both Baseline and Score, nulls as 0."""
    names = [c for c in df.columns if "Baseline" in c and "Score" in c]
    return df.select("subject", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names])
