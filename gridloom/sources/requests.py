"""Request lists: what a source is asked for, one row per request, so that a scan has one input partition each."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import time as T


def ranges(spark: SparkSession, rows: Sequence[tuple[str, date, date]]) -> DataFrame:
    return spark.createDataFrame(list(rows), "code string, start date, end date")


def years(df: DataFrame, lag_days: int = 0) -> DataFrame:
    """code, year."""
    return df.select("code", F.explode(F.sequence(F.year("start"), F.year(F.date_sub("end", lag_days)))).alias("year"))


def days(df: DataFrame) -> DataFrame:
    return df.select("code", F.explode(T.date_range(F.col("start"), F.col("end"), "D")).alias("day"))


def starts(df: DataFrame, freq: str) -> DataFrame:
    """code, day: the points of a frequency, such as 15D."""
    return df.select("code", F.explode(T.date_range(F.col("start"), F.col("end"), freq)).alias("day"))


def month_ends(df: DataFrame, include_partial: bool = False) -> DataFrame:
    """code, year, month of every month that ends in the range; include_partial: and of the running one."""
    found = T.date_range(F.col("start"), F.last_day("end") if include_partial else F.col("end"), "ME")
    return df.select("code", F.explode(found).alias("day")).select("code", F.year("day").alias("year"), F.month("day").alias("month"))


def intervals(df: DataFrame, freq: str, lag_days: int = 0) -> DataFrame:
    """code, from, to: consecutive points of the frequency, with both ends of the range."""
    end = F.date_sub("end", lag_days)
    return df.select("code", F.inline(T.pairs(T.with_ends(T.date_range(F.col("start"), end, freq), F.col("start"), end))))


def tagged(parts: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Lists of different formats in one, each row with its tag; columns that a list lacks are null."""
    out = None
    for tag, part in parts:
        part = part.withColumn("tag", F.lit(tag))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def too_long(df: DataFrame, most_days: int) -> Column:
    """Whether a request's span is over a source's limit."""
    return F.datediff("to", "from") > most_days


def pending(wanted: DataFrame, done: DataFrame, keys: Sequence[str], refresh_year: int | None = None, year: str = "year") -> DataFrame:
    """The requests that have no result yet, and those of the year that is still open."""
    left = wanted.join(done.select(*keys).distinct(), list(keys), "left_anti")
    if refresh_year is None:
        return left
    return left.unionByName(wanted.filter(F.col(year) == refresh_year).join(done.select(*keys).distinct(), list(keys), "left_semi"))


def weather(df: DataFrame) -> DataFrame:
    """code, year, area (N, W, S, E), months, days, hours of reanalysis requests; df: code, year, west, south, east, north."""
    two = lambda lo, hi, form: F.transform(F.sequence(F.lit(lo), F.lit(hi)), lambda k: F.format_string(form, k))
    return df.select("code", "year", F.array("north", "west", "south", "east").alias("area"), two(1, 12, "%02d").alias("months"), two(1, 31, "%02d").alias("days"), two(0, 23, "%02d:00").alias("hours"))
