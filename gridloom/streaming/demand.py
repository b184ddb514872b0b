"""An extension: the batch rules on streams. Late data within the publishing delay counts, duplicates within it go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_mean(stream: DataFrame, key: str, ts: str = "ts", value: str = "value", delay: str = "5 days", width: str = "1 hour") -> DataFrame:
    """key, ts, value: means of the hours that the watermark has passed."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return timed.groupBy(key, F.window(ts, width).alias("w")).agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias(ts), value, "n")


def first_only(stream: DataFrame, key: str, ts: str = "ts", value: str = "value", delay: str = "5 days") -> DataFrame:
    """Present, non-zero values, one for each key and time."""
    timed = stream.filter(F.col(value).isNotNull() & (F.col(value) != 0)).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return timed.dropDuplicatesWithinWatermark([key, ts])
