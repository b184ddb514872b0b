"""Sinks: partitioned Parquet with dynamic overwrite, a CSV twin, and the manifest of what is there."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write(df: DataFrame, path: str, by: Sequence[str], order: Sequence[str] = (), csv_path: str | None = None) -> None:
    """Replaces the partitions that df has rows of. Rows are dealt by the partition columns, so each is few files, and sorted within."""
    dealt = df.repartition(*by).sortWithinPartitions(*by, *order)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    if csv_path:
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True).partitionBy(*by).csv(csv_path)


def manifest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The partitions that are there; without a table, none."""
    try:
        return spark.read.parquet(path).select(*keys).distinct()
    except Exception as e:  # the path is not there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], ", ".join(f"{k} string" for k in keys))


def demand(df: DataFrame, path: str, retrieval_date: str, source: str, csv_path: str | None = None) -> None:
    """code, ts, value to retrieval_date=, data_source=, entity_code= partitions of `Time (UTC)` and `Load (MW)`."""
    named = df.select(F.lit(retrieval_date).alias("retrieval_date"), F.lit(source).alias("data_source"), F.col("code").alias("entity_code"), F.col("ts").alias("Time (UTC)"), F.col("value").alias("Load (MW)"))
    write(named, path, ["retrieval_date", "data_source", "entity_code"], ["Time (UTC)"], csv_path)


def projections(df: DataFrame, path: str, code: str = "code", order: Sequence[str] = ("year", "position")) -> None:
    """Projected loads, a partition for each code and year, in order of the year's positions."""
    write(df, path, [code, "year"], [c for c in order if c in df.columns and c != "year"])
