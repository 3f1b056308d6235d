"""Uncorrelated features: a greedy independent set over the edges of correlated keys, found in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import settled
from .selection import pair_correlation


def greedy_independent(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes (key, rank) that taking them by rank would keep when a node is left out as soon as one that is kept has an edge (k1, k2) with it.

    In each round, undecided nodes without an undecided neighbour of lower rank are kept and their neighbours go. Every
    round decides the lowest rank of each connected part at least, and usually far more; the rounds end when nothing is
    undecided. Edges to keys that are not among the nodes are ignored, as are loops. Ranks differ from each other.
    """
    low, high = nodes.select(F.col("key").alias("k1"), F.col("rank").alias("r1")), nodes.select(F.col("key").alias("k2"), F.col("rank").alias("r2"))
    ranked = edges.select("k1", "k2").where("k1 <> k2").join(low, "k1").join(high, "k2")
    first = F.col("r1") < F.col("r2")
    # from the better to the worse
    down = ranked.select(F.when(first, F.col("k1")).otherwise(F.col("k2")).alias("better"), F.when(first, F.col("k2")).otherwise(F.col("k1")).alias("worse")).distinct()
    open_, down, kept = settled(nodes.select("key", "rank")), settled(down), None
    while not open_.isEmpty():
        blocked = down.select(F.col("worse").alias("key")).distinct()
        chosen = settled(open_.join(blocked, "key", "left_anti"))
        kept = chosen if kept is None else kept.unionByName(chosen)
        gone = down.join(chosen.select(F.col("key").alias("better")), "better", "left_semi").select(F.col("worse").alias("key"))
        decided = chosen.select("key").unionByName(gone)
        open_ = settled(open_.join(decided, "key", "left_anti"))
        both = down.join(open_.select(F.col("key").alias("better")), "better", "left_semi").join(open_.select(F.col("key").alias("worse")), "worse", "left_semi")
        down = settled(both)
    return nodes.select("key", "rank").limit(0) if kept is None else kept


def decollinearize(features: DataFrame, scores: DataFrame, num_features: int | None = None, targ_threshold: float | None = None, feat_threshold: float = 0.1, min_features: int = 1, pairs=pair_correlation) -> DataFrame:
    """key, score, rank, padded: the keys that stay, by rank of their score with the target (scores: key, score).

    Of the num_features best keys, those whose score exceeds targ_threshold are taken by rank, and each is left out if
    its measure (`pairs`: k1, k2, r of pairs of keys) with one already taken reaches feat_threshold. Where fewer than
    min_features stay, the best of the num_features left out pad them. Keys without a score come last; equal scores go by
    key. The ranked table has a row a key.
    """
    order = Window.orderBy(F.desc_nulls_last(F.when(~F.isnan("score"), F.col("score"))), "key")
    ranked = scores.select("key", "score").withColumn("rank", F.row_number().over(order))
    top = settled(ranked if num_features is None else ranked.where(F.col("rank") <= num_features))
    able = top if targ_threshold is None else top.where(F.col("score") > targ_threshold)
    some = features.join(able.select("key"), "key", "left_semi")
    edges = pairs(some).where(F.col("r") >= feat_threshold).select("k1", "k2")
    kept = settled(greedy_independent(able, edges).select("key", F.lit(False).alias("padded")))
    n = kept.count()
    if n < min_features:
        more = top.join(kept, "key", "left_anti").orderBy("rank").limit(min_features - n)
        kept = kept.unionByName(more.select("key", F.lit(True).alias("padded")))
    return top.join(kept, "key").select("key", "score", "rank", "padded")
