"""Mixing sources to target weights by the cube method.

A source whose target is m times its size gives every document floor(m) times; the fraction left over is a
probability that the cube method rounds. Its flight moves three documents at a time along the null space of the
constraints (number of documents, number of words), so both totals hold exactly until one probability reaches 0 or 1.
Documents fly in blocks of bounded size; what a block leaves open (two documents at most) flies on in blocks of the
next level, until a source is one block and its last documents land on the choice nearest to the word target.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, fresh, read

BLOCK = 4096
EPS = 1e-9


def size_column():
    return F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, cap: float = 3.0) -> DataFrame:
    """source, source_size, target of each source from rows (source, size).

    Sources by code point, null last, weigh 1, 2, 3, repeating. With targets that stop at `cap` times the size and an
    excess that is reshared by weight, a target is least(cap * size, level * weight); the level follows from the
    sources in the order of cap * size / weight. The table has a row a source, so its windows are small.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by = by.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double")).withColumn("most", F.col("source_size") * F.lit(cap))
    ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    by = by.withColumn(
        "level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    )
    # removing a source that its cap binds raises the level of the rest, removing another lowers it: the highest is the right one
    level = F.max("level").over(everything)
    return by.select("source", "source_size", F.least("most", level * F.col("weight")).alias("target"))


def flight(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move probabilities to 0 or 1 with sum(pi) and sum(pi * size) kept; at most two stay open, or three of one direction."""
    pi = pi.copy()
    waiting = iter(np.flatnonzero((pi > EPS) & (pi < 1 - EPS)).tolist())
    p, s = pi.tolist(), size.astype(float).tolist()
    draws = iter(rng.random(len(p) + 8).tolist())
    active = list(itertools.islice(waiting, 3))
    while len(active) >= 2:
        if len(active) == 3:
            a, b, c = (s[i] for i in active)
            u = (c - b, a - c, b - a)
            if not any(u):
                u = (1.0, -1.0, 0.0)
        elif s[active[0]] == s[active[1]]:
            u = (1.0, -1.0)
        else:
            break
        up = min(((1 - p[i]) / v if v > 0 else p[i] / -v) for i, v in zip(active, u) if v)
        down = min((p[i] / v if v > 0 else (1 - p[i]) / -v) for i, v in zip(active, u) if v)
        step = up if next(draws, 0.5) * (up + down) < down else -down
        for i, v in zip(active, u):
            p[i] += step * v
            if p[i] < EPS:
                p[i] = 0.0
            elif p[i] > 1 - EPS:
                p[i] = 1.0
        active = [i for i in active if 0.0 < p[i] < 1.0]
        active += itertools.islice(waiting, 3 - len(active))
    return np.array(p)


def land(start: np.ndarray, pi: np.ndarray, size: np.ndarray, flips: int = 3) -> np.ndarray:
    """Round the open few to the choice nearest in words, then in documents; then turn up to `flips` documents that
    were open at the start, each the one that brings the words nearest, where a large document was left to round."""
    out = pi.copy()
    open_ = np.flatnonzero((pi > EPS) & (pi < 1 - EPS))
    if len(open_):
        words, docs = float(pi[open_] @ size[open_]), float(pi[open_].sum())
        out[open_] = min(itertools.product((0.0, 1.0), repeat=len(open_)), key=lambda x: (abs(float(np.dot(x, size[open_])) - words), abs(sum(x) - docs), x))
    out = np.round(out)
    free = np.flatnonzero((start > EPS) & (start < 1 - EPS))
    for _ in range(flips if len(free) else 0):
        over = float(out @ size - start @ size)
        left = np.abs(over + np.where(out[free] > 0, -size[free], size[free]))
        k = int(left.argmin())
        if left[k] >= abs(over):
            break
        out[free[k]] = 1 - out[free[k]]
    return out


def _fly(seed: int, last: bool):
    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "size", "row"], na_position="last", ignore_index=True)
        rng = np.random.Generator(np.random.PCG64([seed, zlib.crc32("\0".join("" if x is None else str(x) for x in key).encode())]))
        part = part.iloc[rng.permutation(len(part))]
        part = part.sort_values("size", ascending=False, kind="stable", ignore_index=True)  # what stays open is small
        size = part["size"].to_numpy()
        start = part["pi"].to_numpy()
        pi = flight(start, size, rng)
        part["pi"] = land(start, pi, size) if last else pi
        return part

    return run


def mix(docs: DataFrame, seed: int = 7, cap: float = 3.0, block: int = BLOCK) -> DataFrame:
    """doc_id, row, size, source, source_size, target, copies of every document.

    Null texts have size 0; null sources are one source, the last. Repeated rows are documents of their own, told
    apart by `row`, a hash of all columns (which must not be maps). A source of size 0 has target 0. An empty table gives no rows.
    """
    sized = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), size_column().alias("size"), F.xxhash64(*docs.columns).alias("row")))
    by = targets(sized, cap)
    counts = sized.groupBy("source").agg(F.count("*").alias("n"))
    goal = cut(by.join(counts, by["source"].eqNullSafe(counts["source"])).select(by["source"].alias("of"), "source_size", "target", "n"))
    times = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    units = sized.join(goal, sized["source"].eqNullSafe(goal["of"])).drop("of")
    units = units.withColumn("times", times).withColumn("whole", F.floor(F.col("times") + EPS).cast("long"))
    units = units.withColumn("pi", F.greatest(F.col("times") - F.col("whole"), F.lit(0.0))).drop("times")
    most = goal.agg(F.max("n")).first()[0] or 0
    done, level, left = None, 0, most
    while True:
        last = left <= block
        blocks = F.greatest(F.ceil(F.col("n") / F.lit(float(block) * (block / 2.0) ** level)), F.lit(1))
        keyed = units.withColumn("block", F.pmod(F.xxhash64("doc_id", "row", F.lit(seed + level)), blocks.cast("long")))
        flown = cut(keyed.groupBy("source", "block").applyInPandas(_fly(seed + level, last), keyed.schema).drop("block"))
        if last:
            break
        settled = (F.col("pi") <= 0) | (F.col("pi") >= 1)
        done = flown.where(settled) if done is None else done.unionByName(flown.where(settled))
        units, level, left = flown.where(~settled), level + 1, 2 * -(-left // block)
    flown = flown if done is None else done.unionByName(flown)
    return flown.select("doc_id", "row", "size", "source", "source_size", "target", (F.col("whole") + F.round("pi").cast("long")).alias("copies"))


def op5_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.col("target").cast("double"), (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source", "copies")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. Rows of equal columns share their copies; all columns come back, whatever their names."""
    taken = mix(docs).where("copies > 0").groupBy("row").agg(F.sum("copies").alias("times"))
    row, times, time = fresh(docs, "row", "times", "time")
    taken = taken.select(F.col("row").alias(row), F.col("times").alias(times))
    # equal rows share a key: their copies add up and all go to one of them, inside the join's own partitioning
    out = docs.withColumn(row, F.xxhash64(*docs.columns)).join(taken, row).dropDuplicates([row])
    return out.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))).alias(time)).drop(time)
