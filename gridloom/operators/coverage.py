"""Coverage of entities by socio-economic class: annual indicators, combined sources, the occurrence cube."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions.scalar import either, level


def indicator(table: DataFrame, variables: dict[str, str], code: str = "ISO 3 code", year: str = "Year", variable: str = "Variable", value: str = "Value", scale: float = 1.0) -> DataFrame:
    """A long annual table to code, year and one column for each variable named."""
    rows = table.filter(F.col(variable).isin(*variables))
    own = [(F.max(F.when(F.col(variable) == v, F.col(value))) * scale).alias(n) for v, n in variables.items()]
    return rows.groupBy(F.col(code).alias("code"), F.col(year).cast("int").alias("year")).agg(*own)


def unpivot_years(wide: DataFrame, code: str, value: str = "value") -> DataFrame:
    """A table of a column per year to code, year, value. Headers like 2015 or 2015.0 are years; other columns are not read."""
    years = [c for c in wide.columns if c.split(".")[0].isdigit()]
    quoted = [F.col(f"`{c}`").cast("double").alias(c.split(".")[0]) for c in years]
    long = wide.select(F.col(f"`{code}`").alias("code"), *quoted).unpivot("code", [c.split(".")[0] for c in years], "year", value)
    return long.filter(F.col(value).isNotNull()).withColumn("year", F.col("year").cast("int"))


def combine(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """keys, value: the mean of both sources, or the one that there is."""
    left, right = a.select(*keys, F.col(value).alias("_a")), b.select(*keys, F.col(value).alias("_b"))
    return left.join(right, list(keys), "full_outer").select(*keys, either(F.col("_a"), F.col("_b")).alias(value))


def occurrence_cube(facts: DataFrame, groups: DataFrame, edges: Sequence[float], group: str = "grp", x: str = "x", weight: Column | None = None) -> DataFrame:
    """group, level, weight: sums of weights by class of x, with zeros for what does not occur."""
    weight = F.lit(1.0) if weight is None else weight
    sums = facts.withColumn("level", level(F.col(x), edges)).groupBy(group, "level").agg(F.sum(weight).alias("w"))
    cells = groups.select(group).distinct().withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(len(edges) - 1))))
    return cells.join(sums, [group, "level"], "left").select(group, "level", F.coalesce("w", F.lit(0.0)).alias("weight"))


def stacked(cube: DataFrame, group: str = "grp") -> DataFrame:
    """The cube with `base`, the sum of the groups before within a level."""
    before = Window.partitionBy("level").orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    return cube.withColumn("base", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))


def trajectory(series: DataFrame, keys: Sequence[str], year: str = "year", values: Sequence[str] = ("value",)) -> DataFrame:
    """keys, first and last year, and each value there."""
    own = [f(v, year).alias(f"{v}_{n}") for v in values for f, n in ((F.min_by, "first"), (F.max_by, "last"))]
    return series.groupBy(*keys).agg(F.min(year).alias("year_first"), F.max(year).alias("year_last"), *own)


def coverage_class(days: Column) -> Column:
    """0, 1, 2, 3: up to 5, 10, 20 and more years of data."""
    return level(days / F.lit(365.0), (0.0, 5.0, 10.0, 20.0))
