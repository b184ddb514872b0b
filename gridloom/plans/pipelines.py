"""The engine's own chains: retrieval, temperature database, annual demand, projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scalar import bounded
from gridloom.operators import coverage, features, forecast, grid, series
from gridloom.sources import connectors


def retrieve(landed: DataFrame, source: str, ordinal: str | None = "ordinal") -> DataFrame:
    """A source's landed rows to clean code, ts, value; of rows of one time the first by the ordinal, or without one the least value."""
    return series.clean(connectors.extract(landed, source, ordinal), ["code"], "ts", "value", ordinal or "value").select("code", "ts", "value")


def retrieve_formats(parts: dict[str, DataFrame], ordinal: str = "ordinal") -> DataFrame:
    """Landed rows of a source in several formats, each a connector of its own, to clean code, ts, value; of rows of one time the first
    format's, and of those the first by the ordinal."""
    rows = None
    for k, (source, landed) in enumerate(parts.items()):
        own = connectors.extract(landed, source, ordinal).select("code", "ts", "value", F.struct(F.lit(k).alias("part"), F.col(ordinal).cast("long").alias("at")).alias("_order"))
        rows = own if rows is None else rows.unionByName(own)
    if rows is None:
        raise ValueError("no formats")
    return series.clean(rows, ["code"], "ts", "value", "_order").select("code", "ts", "value")


def temperature_database(weather: DataFrame, population: DataFrame, fractions: DataFrame, zones: DataFrame, mode: str = "pointwise") -> DataFrame:
    """Features of each code's weather (ts, y, x, t2m) in its cells of the largest population: one plan for all codes, both sizes in one pass.

    population: y, x, year, value. The nearest population year of each code and weather year is taken; of two the earlier."""
    zoned = weather.join(bounded(zones), "code")
    years = zoned.select("code", F.year("ts").alias("year")).distinct()
    known = population.select(F.col("year").alias("available")).distinct()
    nearest = features.nearest(years, years.select("code").distinct().join(bounded(known)), ["code"])
    cells = grid.largest(population.withColumnRenamed("year", "available"), fractions, 3, keys=["available"]).select("code", "available", "y", "x", "rank")
    picked = cells.join(nearest, ["code", "available"]).select("code", "year", "y", "x", "rank")
    own = weather.withColumn("year", F.year("ts")).withColumn("code", F.concat_ws("|", "code", "year"))
    tops = picked.select(F.concat_ws("|", "code", "year").alias("code"), "y", "x", "rank")
    means = features.mean_over_cells(own, tops, (1, 3), mode).withColumn("code", F.split_part("code", F.lit("|"), F.lit(1)))
    return features.temperature_features(means.join(bounded(zones), "code"), ["code"], F.col("zone"))


def annual_demand(table: DataFrame, names: dict[str, str], zone: Column | str = "UTC") -> DataFrame:
    """Annual demand to every hour of the local years. names: variables to columns; the first is expanded."""
    own = coverage.indicator(table, names)
    first = next(iter(names.values()))
    return series.expand_years(own.select("code", "year", first), ["code"], first, zone)


def projection(weather_features: DataFrame, annual: DataFrame, model, energy: DataFrame, first: int = 2020, last: int = 2100, step: int = 5) -> DataFrame:
    """Projected load of every position of the weather year, for each projection year."""
    rows = forecast.project(weather_features, annual, first, last, step)
    return forecast.denormalize(model.transform(rows), energy)


def residuals(predicted: DataFrame, truth: DataFrame, keys: Sequence[str], label: str = "target") -> DataFrame:
    """keys and the absolute error of each prediction."""
    return predicted.select(*keys, "prediction").join(truth.select(*keys, label), list(keys)).withColumn("error", F.abs(F.col("prediction") - F.col(label)))
