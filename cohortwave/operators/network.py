"""Channel-pair networks as edge lists, and features of small graphs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import corr, with_ranks

GRAPH = ["subject", "state"]


def pairs(samples: DataFrame, at: list[str] = ["t_idx"], value: str = "x") -> DataFrame:
    """Values of two channels at one instant, src < dst: made from the instant's own channels, one shuffle and no self join."""
    g = samples.groupBy(*GRAPH, *at).agg(F.array_sort(F.collect_list(F.struct("channel", F.col(value).alias("v")))).alias("c"))
    one = g.select(*GRAPH, *at, "c", F.explode("c").alias("p"))
    two = one.select(*GRAPH, *at, "p", F.explode(F.filter("c", lambda q: q["channel"] > F.col("p.channel"))).alias("q"))
    return two.select(*GRAPH, *at, F.col("p.channel").alias("src"), F.col("q.channel").alias("dst"), F.col("p.v").alias("a"), F.col("q.v").alias("b"))


def pair_pearson(samples: DataFrame) -> DataFrame:
    return pairs(samples).groupBy(*GRAPH, "src", "dst").agg(corr("a", "b").alias("w"), F.count("*").alias("n"))


def pair_spearman(samples: DataFrame) -> DataFrame:
    ranked = with_ranks(samples, ["subject", "state", "channel"], "x", "rank")
    return pair_pearson(ranked.withColumn("x", F.col("rank")))


def pair_mutual_info(samples: DataFrame, bins: int = 20) -> DataFrame:
    """Histogram mutual information in nats, bins of equal width over each channel's range."""
    w = Window.partitionBy("subject", "state", "channel")
    lo, hi = F.min("x").over(w), F.max("x").over(w)
    binned = samples.withColumn("x", F.least(F.floor(F.coalesce(F.try_divide(F.col("x") - lo, hi - lo), F.lit(0.0)) * bins), F.lit(bins - 1)))
    n = pairs(binned).groupBy(*GRAPH, "src", "dst", "a", "b").agg(F.count("*").cast("double").alias("n"))
    key = [*GRAPH, "src", "dst"]
    n = n.withColumns({"na": F.sum("n").over(Window.partitionBy(*key, "a")), "nb": F.sum("n").over(Window.partitionBy(*key, "b")), "t": F.sum("n").over(Window.partitionBy(*key))})
    return n.groupBy(*key).agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("w"))


def combine_segments(edges: DataFrame) -> DataFrame:
    """Mean of the states' networks, weighted by their samples."""
    return edges.groupBy("subject", "src", "dst").agg((F.sum(F.col("w") * F.col("n")) / F.sum("n")).alias("w"))


def symmetrize(edges: DataFrame, by: list[str]) -> DataFrame:
    both = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")
    return edges.where("src <> dst").select(*by, both, "w").select(*by, "e.src", "e.dst", "w")


def strength(edges: DataFrame, by: list[str]) -> DataFrame:
    return symmetrize(edges, by).groupBy(*by, F.col("src").alias("node")).agg(F.sum("w").alias("strength"))


def distances(edges: DataFrame, by: list[str], nodes: int) -> DataFrame:
    """All-pairs shortest paths of lengths 1 / abs(w), by min-plus doubling: log2 of the nodes rounds."""
    d = symmetrize(edges, by).where("w <> 0").select(*by, "src", "dst", (1 / F.abs("w")).alias("d"))
    rounds = max(1, (nodes - 1).bit_length())
    for _ in range(rounds):
        l, r = d.select(*by, "src", F.col("dst").alias("mid"), F.col("d").alias("d1")), d.select(*by, F.col("src").alias("mid"), "dst", F.col("d").alias("d2"))
        via = l.join(r, [*by, "mid"]).where("src <> dst").select(*by, "src", "dst", (F.col("d1") + F.col("d2")).alias("d"))
        d = d.unionByName(via).groupBy(*by, "src", "dst").agg(F.min("d").alias("d"))
    return d


def closeness(dist: DataFrame, by: list[str]) -> DataFrame:
    return dist.groupBy(*by, F.col("src").alias("node")).agg((F.count("*") / F.sum("d")).alias("closeness"))


def graph_summary(dist: DataFrame, by: list[str]) -> DataFrame:
    return dist.groupBy(*by).agg(F.avg("d").alias("path_length"), F.avg(1 / F.col("d")).alias("efficiency"))


def _square(rows: DataFrame, by: list[str], value: str, none: float) -> DataFrame:
    """by, nodes, a: a graph's nodes in order and the matrix of its edges' values, `none` where there is no edge. A graph has as many nodes as there are channels."""
    to = rows.groupBy(*by, "src").agg(F.map_from_entries(F.collect_list(F.struct("dst", value))).alias("to"))
    order = lambda p, q: F.when(p["src"] < q["src"], -1).when(p["src"] > q["src"], 1).otherwise(0)
    g = to.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("src", "to")), order).alias("r"))
    a = F.transform("r", lambda p: F.transform("r", lambda q: F.coalesce(F.try_element_at(p["to"], q["src"]), F.lit(none))))
    return g.select(*by, F.col("r.src").alias("nodes"), a.alias("a"))


def matrices(edges: DataFrame, by: list[str]) -> DataFrame:
    """by, nodes, a: each graph's symmetric matrix of abs(w)."""
    return _square(symmetrize(edges, by).withColumn("w", F.abs("w")), by, "w", 0.0)


def _total(x):
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def _per_node(g: DataFrame, by: list[str], scores, name: str) -> DataFrame:
    return g.select(*by, F.explode(F.arrays_zip(F.col("nodes").alias("node"), scores.alias("s"))).alias("z")).select(*by, F.col("z.node").alias("node"), F.col("z.s").alias(name))


def eigen_centrality(edges: DataFrame, by: list[str], iters: int = 20) -> DataFrame:
    """Power iteration within a graph's own row, L2-normalised at the end; 0 where it fails."""
    g = matrices(edges, by)
    steps = F.aggregate(F.sequence(F.lit(1), F.lit(iters)), F.transform("nodes", lambda _: F.lit(1.0)), lambda v, _: F.transform("a", lambda row: _total(F.zip_with(row, v, lambda x, y: x * y))))
    g = g.withColumn("v", steps).withColumn("norm", F.sqrt(_total(F.transform("v", lambda x: x * x))))
    return _per_node(g, by, F.transform("v", lambda x: F.coalesce(F.try_divide(x, F.col("norm")), F.lit(0.0))), "centrality")


def pagerank(edges: DataFrame, by: list[str], alpha: float = 0.85, iters: int = 20) -> DataFrame:
    """Weighted PageRank by a fixed number of steps within a graph's own row."""
    g = matrices(edges, by).withColumn("k", F.size("nodes")).withColumn("out", F.transform("a", _total))
    start = F.transform("nodes", lambda _: 1 / F.col("k"))
    step = lambda v, _: F.transform("a", lambda row: F.lit(1 - alpha) / F.col("k") + alpha * _total(F.zip_with(row, F.zip_with(v, "out", lambda x, o: F.coalesce(F.try_divide(x, o), F.lit(0.0))), lambda w, x: w * x)))
    return _per_node(g.withColumn("v", F.aggregate(F.sequence(F.lit(1), F.lit(iters)), start, step)), by, F.col("v"), "rank")


def betweenness(dist: DataFrame, by: list[str], eps: float = 1e-9) -> DataFrame:
    """Share of the pairs of other nodes whose shortest path leads through a node, within a graph's own row. A path has one form but for ties."""
    g = _square(dist, by, "d", math.inf).withColumn("k", F.size("nodes"))
    d = lambda i, j: F.get(F.get("a", i), j)
    ends = F.sequence(F.lit(0), F.col("k") - 1)

    def through(v):
        one = lambda s, t: F.when((s < t) & (s != v) & (t != v) & (F.abs(d(s, v) + d(v, t) - d(s, t)) <= eps), 1.0).otherwise(0.0)
        return _total(F.transform(ends, lambda s: _total(F.transform(ends, lambda t: one(s, t)))))

    return _per_node(g, by, F.transform(ends, lambda v: F.coalesce(F.try_divide(through(v), (F.col("k") - 1) * (F.col("k") - 2) / 2), F.lit(0.0))), "betweenness")


def avg_clustering(edges: DataFrame, by: list[str]) -> DataFrame:
    """Mean over a graph's nodes of the weighted clustering: geometric means of each triangle's weights, over the greatest weight."""
    most = edges.where("src <> dst").groupBy(*by).agg(F.max(F.abs("w")).alias("most"))
    w = symmetrize(edges, by).where("w <> 0").join(most, by).select(*by, "src", "dst", (F.abs("w") / F.col("most")).alias("w"))
    second = w.select(*by, F.col("src").alias("dst"), F.col("dst").alias("far"), F.col("w").alias("w2"))
    third = w.select(*by, "src", F.col("dst").alias("far"), F.col("w").alias("w3"))
    triangles = w.join(second, [*by, "dst"]).where("src <> far").join(third, [*by, "src", "far"])
    closed = triangles.groupBy(*by, "src").agg(F.sum(F.pow(F.col("w") * F.col("w2") * F.col("w3"), F.lit(1 / 3))).alias("s"))
    degree = w.groupBy(*by, "src").agg(F.count("*").alias("k"))
    c = F.coalesce(F.try_divide(F.col("s"), F.col("k") * (F.col("k") - 1)), F.lit(0.0))
    return degree.join(closed, [*by, "src"], "left").groupBy(*by).agg(F.avg(c).alias("clustering"))


def homotopic_mean(edges: DataFrame, mirrored: list[tuple[str, str]], by: list[str]) -> DataFrame:
    """Mean edge over the mirrored channel pairs of a graph."""
    wanted = F.array(*[F.struct(F.lit(min(p)).alias("src"), F.lit(max(p)).alias("dst")) for p in mirrored])
    return edges.where(F.array_contains(wanted, F.struct(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")))).groupBy(*by).agg(F.avg("w").alias("homotopic"))
