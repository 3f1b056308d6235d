"""One long feature table (subject, key, value) from many families, and tables of fitted parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import network as N


def named(df: DataFrame, parts: list[str | Column], values: list[str], sep: str = " ") -> DataFrame:
    """subject, key, value: a row for each of the value columns, named by the parts and the column."""
    lead = [F.col(p) if isinstance(p, str) else p for p in parts]
    rows = F.explode(F.array(*[F.struct(F.concat_ws(sep, *[p.cast("string") for p in lead], F.lit(v)).alias("key"), F.col(v).cast("double").alias("value")) for v in values])).alias("f")
    return df.select("subject", rows).select("subject", "f.key", "f.value")


def assemble(families: dict[str, DataFrame], how: str = "outer") -> DataFrame:
    """subject, family, key, value of all families (subject, key, value): a union of long tables, no wide join.

    'inner' keeps the subjects that every family has. Keys are told apart by family, so equal names don't clash; rows
    whose value is null stay. A family without rows leaves 'inner' empty.
    """
    every = reduce(DataFrame.unionByName, [df.select("subject", F.lit(name).alias("family"), "key", F.col("value").cast("double").alias("value")) for name, df in families.items()])
    if how == "outer":
        return every
    common = every.groupBy("subject").agg(F.count_distinct("family").alias("n")).where(F.col("n") == len(families)).select("subject")
    return every.join(common, "subject", "left_semi")


def widen(assembled: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """subject and a column `family key` for each of the given ones; of a name that a subject has twice, the least value."""
    named_ = assembled.withColumn("_name", F.concat_ws(" ", "family", "key"))
    return named_.groupBy("subject").pivot("_name", [f"{f} {k}" for f, k in keys]).agg(F.min("value"))


def fit_table(fits: DataFrame, subjects: DataFrame, params: list[str]) -> DataFrame:
    """subject, key, value: `state_param_channel` for every subject and every (state, channel) that any fit has; null where a subject has no fit.

    The recordings' names are few, so they are one array that is broadcast to the subjects; the fits join that frame.
    """
    recordings = fits.select("state", "channel").distinct().agg(F.collect_list(F.struct("state", "channel")).alias("all"))
    frame = subjects.select("subject").distinct().join(F.broadcast(recordings)).select("subject", F.explode("all").alias("r")).select("subject", "r.state", "r.channel")
    full = frame.join(fits.select("subject", "state", "channel", *params), ["subject", "state", "channel"], "left")
    rows = F.explode(F.array(*[F.struct(F.concat_ws("_", "state", F.lit(p), "channel").alias("key"), F.col(p).cast("double").alias("value")) for p in params])).alias("f")
    return full.select("subject", rows).select("subject", "f.key", "f.value")


def network_features(edges: DataFrame, network: str, nodes: int, steps: int = 20) -> DataFrame:
    """subject, key, value: every node and graph feature of the networks (subject, state, src, dst, w), named `network state node feature` or `network state feature`."""
    by = N.GRAPH
    dist = N.distances(edges, by, nodes)
    lead = [F.lit(network), F.col("state")]
    per_node = [
        N.strength(edges, by).withColumnRenamed("strength", "degree"), N.eigen_centrality(edges, by, steps).withColumnRenamed("centrality", "eigen"), N.closeness(dist, by),
        N.betweenness(dist, by), N.pagerank(edges, by, iters=steps).withColumnRenamed("rank", "pagerank"),
    ]
    graph = [N.graph_summary(dist, by), N.avg_clustering(edges, by)]
    tables = [named(t, [*lead, "node"], [t.columns[-1]]) for t in per_node] + [named(t, lead, [c for c in t.columns if c not in by]) for t in graph]
    return reduce(DataFrame.unionByName, tables)


def simple_symptoms(df: DataFrame, flags: dict[str, str], ranks: dict[str, Column], memory: str, most: float = 15.0) -> DataFrame:
    """subject, a flag for each of flags (name: column), and average_score.

    The memory column counts from `most` down. A flag is 1 where the value is not 0, a missing one included. The score
    is the mean of the columns that are there, those of `ranks` (name: expression) by their rank.
    """
    value = {name: (F.lit(most) - F.col(c) if c == memory else F.col(c)).cast("double") for name, c in flags.items()}
    yes = [F.when(v == 0, 0).otherwise(1).alias(name) for name, v in value.items()]
    scores = F.array_compact(F.array(*[ranks.get(name, v).cast("double") for name, v in value.items()]))
    mean = F.try_divide(F.aggregate(scores, F.lit(0.0), lambda s, v: s + v), F.size(scores))
    return df.select("subject", *yes, mean.alias("average_score"))
