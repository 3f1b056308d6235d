"""Hierarchical weighted hash tree: rows descend region, rack and shard by weighted hash draws.

At each level a node's child is the one with the least -ln(u) / weight, u being a hash of the row's key and the
child's path. A child's draw depends on nothing but its own path and weight, so a change of weights moves rows only
into or out of subtrees whose weights change. A shard that is added as a region of its own therefore takes rows only
into itself. All is column arithmetic; one shuffle groups equal rows and one numbers the slots.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read

#: Leading hex digits of the key's hash that name a slot bucket: at most 16 ** 4 buckets a shard, whatever the input.
BUCKET_DIGITS = 4

Tree = list[tuple[int, tuple[str, ...], float]]


def tree(shards: int, per_rack: int = 2, racks: int = 2, base: int = 8) -> Tree:
    """(shard, path, weight) of each shard: the first `base` fill racks and regions, each later one is a region of its own."""
    return [(k, (f"g{k // (per_rack * racks)}", f"k{k // per_rack}", f"s{k}") if k < base else (f"x{k}",), 1.0) for k in range(shards)]


def _draw(key: Column, path: tuple[str, ...], weight: float, seed: str) -> Column:
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/{'/'.join(path)}:"), key)), 1, 13), 16, 10).cast("long")
    return -F.ln((bits.cast("double") + 0.5) / F.lit(float(2**52))) / F.lit(weight)


def place(key: Column, leaves: Tree, seed: str = "tree", at: tuple[str, ...] = ()) -> Column:
    """The shard that key descends to. Weights must be above 0."""
    below: dict[str, Tree] = {}
    for leaf in leaves:
        below.setdefault(leaf[1][len(at)], []).append(leaf)
    steps = {name: (part[0][0] if len(part) == 1 and len(part[0][1]) == len(at) + 1 else None, part) for name, part in sorted(below.items())}

    def inner(name: str) -> Column:
        shard, part = steps[name]
        return F.lit(shard) if shard is not None else place(key, part, seed, (*at, name))

    names = list(steps)
    if len(names) == 1:
        return inner(names[0])
    draws = [F.struct(_draw(key, (*at, n), sum(w for _, _, w in steps[n][1]), seed).alias("d"), F.lit(i).alias("i")) for i, n in enumerate(names)]
    won = F.array_min(F.array(*draws))["i"]
    return reduce(lambda out, i: out.when(F.lit(i) == won, inner(names[i])), range(1, len(names)), F.when(F.lit(0) == won, inner(names[0])))


def shard_documents(docs: DataFrame, shards: int = 8, seed: str = "tree") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    Null texts count as empty; a null doc_id is a key of its own. Repeated rows get the same shard and slots of their
    own. Slots are gapless from 0 in each shard, in the order of md5(doc_id), doc_id, size, text_crc32. Other columns
    are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("times"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = rows.withColumns({"shard": place(key, tree(shards), seed), "grown_shard": place(key, tree(shards + 1), seed), "order": F.md5(key)})
    rows = rows.withColumn("bucket", F.substring("order", 1, BUCKET_DIGITS))
    inside = Window.partitionBy("shard", "bucket").orderBy("order", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("times").over(inside), F.lit(0)))
    lower = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "bucket").agg(F.sum("times").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("start"))
    out = rows.join(starts, ["shard", "bucket"])
    one = F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("k")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("before")).alias("slot"), "grown_shard", one).withColumn(
        "slot", (F.col("slot") + F.col("k")).cast("long")
    ).drop("k")


def op9_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents"))
