"""Other column functions: average ranks, half-even steps, longitudes, levels, null-safe sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def average_rank(partition: Sequence[str], by: Column | str, descending: bool = True) -> Column:
    """Rank from 1 with ties averaged."""
    by = F.col(by) if isinstance(by, str) else by
    order: WindowSpec = Window.partitionBy(*partition).orderBy(by.desc() if descending else by.asc())
    return F.rank().over(order) + (F.count(F.lit(1)).over(Window.partitionBy(*partition, by)) - 1) / F.lit(2.0).cast("double")


def row_sum(*columns: str) -> Column:
    """The sum of a row's columns; nulls count as nothing."""
    total = F.coalesce(F.col(columns[0]), F.lit(0.0))
    for c in columns[1:]:
        total = total + F.coalesce(F.col(c), F.lit(0.0))
    return total


def quarter(x: Column) -> Column:
    """Rounded to a quarter, halves to even."""
    return F.bround(x * F.lit(4.0)) / F.lit(4.0)


def wrap_longitude(x: Column) -> Column:
    """To (-180, 180], to the accuracy of the grids' labels."""
    return F.pmod(x + F.lit(179.99999), F.lit(360.0)) - F.lit(179.99999)


def level(x: Column, edges: Sequence[float]) -> Column:
    """The half-open class [edges[k], edges[k + 1]) of x; the last has no upper edge. Null below the first."""
    out = F.lit(None).cast("int")
    for k, edge in enumerate(edges):
        out = F.when(x >= F.lit(float(edge)), F.lit(k)).otherwise(out)
    return out


def whole_label(x: Column, step: float = 1.0) -> Column:
    """The number of whole steps in x as text; of numbers below 0 too, it is rounded towards 0."""
    steps = x / F.lit(float(step))
    return F.when(steps < 0, F.ceil(steps)).otherwise(F.floor(steps)).cast("string")


def finite(x: Column) -> Column:
    """0 for null, NaN and infinities."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(0.0)).otherwise(x)


def either(a: Column, b: Column) -> Column:
    """The mean of two values, or the one that there is."""
    return F.coalesce((a + b) / F.lit(2.0), a, b)


def code(country: Column, subdivision: Column) -> Column:
    return F.concat_ws("_", country, subdivision)


def bounded(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df marked for broadcast if it has at most so many rows, which a job counts no further than that; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
