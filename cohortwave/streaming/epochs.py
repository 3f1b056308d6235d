"""Epochs of a live feed: event-time windows with a watermark, the stream's twin of the batch epochs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import new_path
from ..operators.spectral import KEY


def windows(feed: DataFrame, width: str, step: str, late: str) -> DataFrame:
    """KEY, start, end, n, mean, xs of every window of `width` that begins each `step` in which a series has a sample; feed: KEY, ts, seq, x.

    xs are the samples by ts, then seq; null values count in neither n nor mean and stay in xs. Works on a table and on a stream alike. On a
    stream, a window's state is kept until the greatest ts seen is `late` past its end; then it is returned once, and
    samples that come for it afterwards are dropped. Rows without a ts are left out.
    """
    rows = feed.where("ts IS NOT NULL").withWatermark("ts", late)
    g = rows.groupBy(*KEY, F.window("ts", width, step).alias("w"))
    g = g.agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.array_sort(F.collect_list(F.struct("ts", "seq", "x"))).alias("s"))
    return g.select(*KEY, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean", F.col("s.x").alias("xs"))


def closed(windows: DataFrame, feed: DataFrame, late: str) -> DataFrame:
    """The windows of a table that a stream of the same rows would have returned: those that the watermark has passed."""
    last = feed.agg((F.max("ts") - F.expr(f"INTERVAL {late}")).alias("mark"))
    return windows.join(F.broadcast(last), F.col("end") <= F.col("mark")).drop("mark")


def files(spark: SparkSession, path: str, schema, per_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files at path (a folder or a pattern), per_batch of them at a time."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).parquet(path)


def drained(stream: DataFrame, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """What the stream returns for all that is there now, written as Parquet to path and read back.

    With the same path and checkpoint it goes on where it stopped; without, both are new ones in the shared folder.
    """
    spark = stream.sparkSession
    path = path or new_path(spark, "stream")
    checkpoint = checkpoint or new_path(spark, "progress")
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
