"""Readers of clinical tables and samples, and a store of results by their parameters."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_clinical(spark: SparkSession, path: str, schema: str, name: str = "*.csv", without: str = "appendix") -> DataFrame:
    """CSV files of a folder whose names match, those with `without` in the name left out; NaN is null. The files are read by Spark alone."""
    rows = spark.read.schema(schema).option("header", True).option("pathGlobFilter", name).option("nanValue", "NaN").csv(path)
    rows = rows.where(~F.contains(F.lower(F.col("_metadata.file_name")), F.lit(without.lower())))
    return rows.select(*[F.nanvl(c, F.lit(None).cast(t)).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes])


def read_samples(spark: SparkSession, path: str, subjects: DataFrame | None = None, first: int | None = None, **equal) -> DataFrame:
    """Long samples from Parquet: those of the subjects given, of the first so many by number, and with the columns named equal to the values."""
    rows = spark.read.parquet(path)
    for column, value in equal.items():
        rows = rows.where(F.col(column) == value)
    if subjects is not None:
        rows = rows.join(subjects.select("subject").distinct(), "subject", "left_semi")
    if first is not None:
        rows = rows.join(rows.select("subject").distinct().orderBy("subject").limit(first), "subject", "left_semi")
    return rows


def params_hash(params: dict) -> str:
    """A name for parameters: equal ones have one, whatever their order."""
    return hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()


def write_result(df: DataFrame, table: str, params: dict) -> None:
    """Add df to the store under its parameters, unless a result of these parameters is there.

    The result's own partition is overwritten as a whole, so of two writers that both find nothing the later one's rows
    stay, and none twice.
    """
    if read_result(df.sparkSession, table, params) is None:
        said = F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(json.dumps(v, default=str)).alias("v")) for k, v in sorted(params.items())]))
        df.withColumns({"params": said, "written": F.current_timestamp(), "params_hash": F.lit(params_hash(params))}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("params_hash").parquet(table)


def _stored(spark: SparkSession, table: str) -> DataFrame | None:
    """The store as it is, null where nothing was written yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    return spark.read.parquet(table) if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else None


def read_result(spark: SparkSession, table: str, params: dict) -> DataFrame | None:
    """The result of exactly these parameters, by a pruned partition; None where there is none."""
    rows = _stored(spark, table)
    rows = None if rows is None else rows.where(F.col("params_hash") == params_hash(params))
    return None if rows is None or rows.isEmpty() else rows.drop("params", "written", "params_hash")


def read_params_compatible(spark: SparkSession, table: str, must_match: dict, strict: bool = True) -> DataFrame | None:
    """The latest result whose parameters hold the given ones; where strict is false, parameters that a result lacks do not count against it."""
    rows = _stored(spark, table)
    if rows is None:
        return None
    for k, v in must_match.items():
        said = F.try_element_at("params", F.lit(k))
        rows = rows.where(said.eqNullSafe(json.dumps(v, default=str)) | (F.lit(not strict) & said.isNull()))
    last = rows.agg(F.max(F.struct("written", "params_hash"))["params_hash"].alias("params_hash"))
    rows = rows.join(F.broadcast(last), "params_hash")
    return None if rows.isEmpty() else rows.drop("params", "written", "params_hash")
