"""Long tables that the operators take, as views of the test tables, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(
        (F.col("user_id") % 8).alias("subject"), F.col("event_type").alias("channel"), F.when(F.dayofmonth("ts") <= 15, "open").otherwise("closed").alias("state"), "ts", "event_id", F.col("value").alias("x")
    )
    order = Window.partitionBy("subject", "channel", "state").orderBy("ts", "event_id")
    return e.select("subject", "channel", "state", (F.row_number().over(order) - 1).cast("long").alias("t_idx"), "x")


def spectrum(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "v")).withColumn("v", F.col("v").cast("double"))
    return v.select(
        F.floor(F.col("vec_id") / 10).alias("subject"), F.concat(F.lit("ch"), F.col("vec_id") % 5).alias("channel"), F.when(F.col("vec_id") % 10 < 5, "open").otherwise("closed").alias("state"),
        F.col("k").cast("int").alias("k"), (F.lit(0.5) + 2 * F.col("k")).cast("double").alias("freq"), (F.col("v") * F.col("v") + F.lit(1e-9)).alias("power"),
    )


def features(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("subject"), F.posexplode("embedding").alias("k", "v"))
    return v.select("subject", F.concat(F.lit("f"), F.lpad(F.col("k").cast("string"), 2, "0")).alias("key"), F.col("v").cast("double").alias("value"))


def target(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("subject"), (F.col("label") >= 5).cast("int").alias("y"), "label")


def splits(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("vec_id") % 10
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("subject"), F.when(m <= 5, "train").when(m <= 7, "ival").otherwise("holdout").alias("split"))


def annotations_wide(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    one, two = k % 5 == 0, k % 3 == 0
    return table(spark, d, "customer").select(
        k.alias("subject"), F.when(~one, (k % 7).cast("double")).alias("open_start_1"), F.when(~one, (k % 7 + 30).cast("double")).alias("open_end_1"),
        F.when(~two, (60 + k % 11).cast("double")).alias("closed_start_1"), F.when(~two, (95 + k % 11).cast("double")).alias("closed_end_1"),
    )


def clinical(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("subject"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("sparse_note"),
        F.col("o_orderpriority").alias("symptom"), (F.col("o_orderstatus") == "F").cast("int").alias("present"), F.col("o_totalprice").cast("double").alias("score"),
    )


def predictions(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    by = {"length": F.least(F.lit(0.99), F.col("n_chars") / 20000.0), "toxic": 0.9 - 0.8 * F.col("toxic"), "id": (F.col("doc_id") % 100) / 100.0}
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), p.cast("double").alias("p")) for m, p in by.items()])).alias("m")
    return x.select(F.col("doc_id").alias("subject"), F.col("quality").alias("y"), pairs).select("subject", "y", "m.model", "m.p")


SQL = {
    "samples": "SELECT user_id % 8 AS subject, event_type AS channel, CASE WHEN day(ts) <= 15 THEN 'open' ELSE 'closed' END AS state, row_number() OVER (PARTITION BY user_id % 8, event_type, day(ts) <= 15 ORDER BY ts, event_id) - 1 AS t_idx, value AS x FROM events",
    "spectrum": "SELECT vec_id // 10 AS subject, 'ch' || (vec_id % 5) AS channel, CASE WHEN vec_id % 10 < 5 THEN 'open' ELSE 'closed' END AS state, k::INT AS k, (0.5 + 2 * k)::DOUBLE AS freq, v * v + 1e-9::DOUBLE AS power FROM (SELECT vec_id, unnest(range(len(embedding))) AS k, unnest(embedding)::DOUBLE AS v FROM embeddings)",
    "features": "SELECT vec_id AS subject, 'f' || lpad(k::VARCHAR, 2, '0') AS key, v AS value FROM (SELECT vec_id, unnest(range(len(embedding))) AS k, unnest(embedding)::DOUBLE AS v FROM embeddings)",
    "target": "SELECT vec_id AS subject, (label >= 5)::INT AS y, label FROM embeddings",
    "splits": "SELECT vec_id AS subject, CASE WHEN vec_id % 10 <= 5 THEN 'train' WHEN vec_id % 10 <= 7 THEN 'ival' ELSE 'holdout' END AS split FROM embeddings",
    "annotations_wide": "SELECT c_custkey AS subject, CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey % 7)::DOUBLE END AS open_start_1, CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey % 7 + 30)::DOUBLE END AS open_end_1, CASE WHEN c_custkey % 3 <> 0 THEN (60 + c_custkey % 11)::DOUBLE END AS closed_start_1, CASE WHEN c_custkey % 3 <> 0 THEN (95 + c_custkey % 11)::DOUBLE END AS closed_end_1 FROM customer",
    "clinical": "SELECT o_orderkey AS row_id, o_custkey AS subject, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS sparse_note, o_orderpriority AS symptom, (o_orderstatus = 'F')::INT AS present, o_totalprice::DOUBLE AS score FROM orders",
    "predictions": "SELECT doc_id AS subject, quality AS y, model, p FROM (SELECT doc_id, quality, unnest(['length', 'toxic', 'id']) AS model, unnest([least(0.99::DOUBLE, n_chars / 20000.0::DOUBLE), 0.9::DOUBLE - 0.8::DOUBLE * toxic, (doc_id % 100) / 100.0::DOUBLE]) AS p FROM labels JOIN documents USING (doc_id))",
}


def with_views(query: str, *names: str) -> str:
    """A query in SQL with the views that it reads before it."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + " " + query
