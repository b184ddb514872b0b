"""Temperature and calendar features of entities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions import time as T
from gridloom.functions.scalar import average_rank, bounded
from gridloom.operators import series


def local_fields(df: DataFrame, zone: Column | str, ts: str = "ts") -> DataFrame:
    """df with local hour, is_weekend, month and year."""
    local = T.to_local(F.col(ts), zone)
    return df.withColumn("_l", local).withColumns({"hour": F.hour("_l"), "is_weekend": T.weekend(F.col("_l")), "month": F.month("_l"), "year": F.year("_l")}).drop("_l")


def nearest(df: DataFrame, candidates: DataFrame, keys: Sequence[str], year: str = "year", other: str = "available") -> DataFrame:
    """df's keys and year with the nearest available year; of two the earlier."""
    met = df.select(*keys, year).distinct().join(candidates.select(*keys, other).distinct(), list(keys))
    return met.groupBy(*keys, year).agg(F.min(F.struct(F.abs(F.col(other) - F.col(year)).alias("d"), F.col(other).alias("y")))["y"].alias(other))


def mean_over_cells(weather: DataFrame, cells: DataFrame, ks: Sequence[int] = (1, 3), mode: str = "pointwise", value: str = "t2m") -> DataFrame:
    """code, ts, top1, top3..: means over each code's cells of the largest population, for all k in one pass.

    weather: code, ts, y, x, value; cells: code, y, x, rank. pointwise: the k cells; orthogonal: every pairing of their rows and columns,
    as often as it comes, which is what selecting along both axes gives. The cells are counted, and broadcast only if they are few.
    """
    most = max(ks)
    if mode == "pointwise":
        met = weather.join(bounded(cells.filter(F.col("rank") <= most).select("code", "y", "x", "rank")), ["code", "y", "x"])
        return met.groupBy("code", "ts").agg(*[F.avg(F.when(F.col("rank") <= k, F.col(value))).alias(f"top{k}") for k in ks])
    if mode != "orthogonal":
        raise ValueError("mode is pointwise or orthogonal")
    top = cells.filter(F.col("rank") <= most)
    crossed = top.select("code", "y", F.col("rank").alias("ry")).join(top.select("code", "x", F.col("rank").alias("rx")), "code")
    met = weather.join(bounded(crossed), ["code", "y", "x"])
    return met.groupBy("code", "ts").agg(*[F.avg(F.when((F.col("ry") <= k) & (F.col("rx") <= k), F.col(value))).alias(f"top{k}") for k in ks])


def temperature_features(df: DataFrame, keys: Sequence[str], zone: Column | str = "UTC", ts: str = "ts", top1: str = "top1", top3: str = "top3", hottest_first: bool = True) -> DataFrame:
    """df with local fields and month_avg, month_rank, year_avg, p05, p95 of top1, by local month and year.

    Months are averaged and ranked in a table of a row per month, percentiles in one of a row per year; both are small and joined back. A
    percentile's buffer holds one entity's values of one year.
    """
    named = local_fields(df, zone, ts)
    months = named.groupBy(*keys, "year", "month").agg(F.avg(top1).alias("month_avg"))
    months = months.withColumn("month_rank", average_rank([*keys, "year"], "month_avg", hottest_first))
    years = named.groupBy(*keys, "year").agg(F.avg(top1).alias("year_avg"), F.percentile(top1, F.lit(0.05)).alias("p05"), F.percentile(top1, F.lit(0.95)).alias("p95"))
    return named.join(months, [*keys, "year", "month"]).join(years, [*keys, "year"])


def in_years(df: DataFrame, first: int | None = None, last: int | None = None, year: str = "year") -> DataFrame:
    """Rows from the first to the last year, both counted; None is no limit. Rows without a year fall with either limit."""
    for limit, holds in ((first, lambda c: c >= first), (last, lambda c: c <= last)):
        if limit is not None:
            df = df.filter(holds(F.col(year)))
    return df


def in_local_year(df: DataFrame, zone: Column | str, year: int, ts: str = "ts") -> DataFrame:
    """Rows from local January 1st to the last instant of local December 31st, as a filter on UTC that reaches the scan."""
    edge = lambda y: T.to_utc(F.make_timestamp_ntz(F.lit(y), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)), zone)
    return df.filter((F.col(ts) >= edge(year)) & (F.col(ts) < edge(year + 1)))


def group_mean_normalized(df: DataFrame, by: Sequence[str], value: str, out: str = "normalized") -> DataFrame:
    """value over its group's mean. The means are aggregated and joined back, so a large group is no single task."""
    means = df.groupBy(*by).agg(F.avg(value).alias("_mean"))
    return df.join(means, list(by)).withColumn(out, F.col(value) / F.col("_mean")).drop("_mean")


def position_in_group(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str = "position", block: Column | None = None) -> DataFrame:
    """df with each row's place in its group, from 0. block as in series.position; without one the first of order is a number, of which a
    part takes 100,000."""
    return series.position(df, by, order, F.floor(F.col(order[0]) / 100_000) if block is None else block, out)
