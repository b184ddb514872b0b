"""Time series of many entities as one DataFrame: cleaning, calendar completion, resampling, interpolation, quality.

Every operator takes the names of the entity columns (keys), the TIMESTAMP_NTZ column in UTC, and the value column, and treats NULL as
missing. No window holds a whole entity: rows are partitioned by the keys and a block of time, and each block gets the nearest row of its
neighbours (`haloed`). Only the table of a row per block is ordered by entity.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions import time as T


#: Microseconds of a block.
BLOCK = 86_400_000_000


def _over(keys: Sequence[str], *order: str):
    return Window.partitionBy(*keys).orderBy(*order)


def haloed(df: DataFrame, keys: Sequence[str], ts: str = "ts", values: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """df with `_block`, and beside its rows (`_halo` false) for each entity and block the last row before it and the first after it.

    Halo rows have keys, ts and values only. Null keys are an entity as any other; rows without a time are in a block of their own, which
    has no neighbours. A window over (keys, _block) then sees what one over keys would see one row away.
    """
    rows = df.withColumn("_block", F.floor(T.micros(F.col(ts)) / F.lit(block)))
    own = F.struct(ts, *values)
    edges = rows.filter(F.col(ts).isNotNull()).groupBy(*keys, "_block").agg(F.min(own).alias("_a"), F.max(own).alias("_b"))
    order = _over(keys, "_block")
    near = edges.select(*keys, "_block", F.array_compact(F.array(F.lag("_b").over(order), F.lead("_a").over(order))).alias("_n"))
    halo = near.withColumn("_n", F.explode("_n")).select(*keys, "_block", "_n.*", F.lit(True).alias("_halo"))
    return rows.withColumn("_halo", F.lit(False)).unionByName(halo, allowMissingColumns=True)


def clean(df: DataFrame, keys: Sequence[str], ts: str = "ts", value: str = "value", ordinal: str = "ordinal", drop_zero: bool = True) -> DataFrame:
    """Without missing times and values (and exact zeros); of rows of one time, the first by the ordinal."""
    present = F.col(ts).isNotNull() & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    if drop_zero:
        present &= F.col(value) != 0
    first = F.row_number().over(_over([*keys, ts], ordinal))
    return df.filter(present).withColumn("_first", first).filter("_first = 1").drop("_first")


def steps(df: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """df with `step`, the microseconds since the entity's time before; null for the first and for rows without a time."""
    now = T.micros(F.col(ts))
    return haloed(df, keys, ts).withColumn("step", now - F.lag(now).over(_over([*keys, "_block"], ts))).filter("not _halo").drop("_block", "_halo")


def resolution(df: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Per entity: resolution (least step over 0, microseconds), first and last time, n."""
    return steps(df, keys, ts).groupBy(*keys).agg(F.min(F.when(F.col("step") > 0, F.col("step"))).alias("resolution"), F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("n"))


def _calendar(known: DataFrame, zone: Column | str) -> DataFrame:
    """resolution's rows with the instants _a and _b at which the local year of the first time begins and ends, and whether rows are missing."""
    start = F.year(T.to_local(F.col("first"), zone))
    day = lambda y: T.to_utc(F.make_timestamp_ntz(y, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)), zone)
    spans = known.withColumn("_a", day(start)).withColumn("_b", day(start + 1))
    return spans.withColumn("_short", F.coalesce(F.col("n") < (T.micros(F.col("_b")) - T.micros(F.col("_a"))) / F.col("resolution"), F.lit(False)))


def fill_calendar(df: DataFrame, keys: Sequence[str], zone: Column | str = "UTC", ts: str = "ts", value: str = "value", known: DataFrame | None = None) -> DataFrame:
    """keys, ts, value on every step of the local calendar year that the series begins in, for the entities that have fewer rows than
    that; the others stay. Years have their true length. known: resolution(df), if it is at hand."""
    short = _calendar(resolution(df, keys, ts) if known is None else known, zone).filter("_short")
    grid = short.select(*keys, F.explode(F.sequence(T.micros(F.col("_a")), T.micros(F.col("_b")) - 1, F.col("resolution"))).alias("_m")).select(*keys, T.from_micros(F.col("_m")).alias(ts))
    filled = grid.join(df.select(*keys, ts, value), [*keys, ts], "left")
    return filled.unionByName(df.select(*keys, ts, value).join(short.select(*keys), list(keys), "left_anti"))


def fill_between(df: DataFrame, keys: Sequence[str], minutes: int, ts: str = "ts", value: str = "value") -> DataFrame:
    """keys, ts, value on every step between each entity's first and last time."""
    ends = df.groupBy(*keys).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    grid = ends.select(*keys, F.explode(F.sequence(F.col("_a"), F.col("_b"), F.make_dt_interval(mins=F.lit(minutes)))).alias(ts))
    return grid.join(df.select(*keys, ts, value), [*keys, ts], "left")


def resample(df: DataFrame, keys: Sequence[str], minutes: int = 60, zone: Column | str | None = None, ts: str = "ts", value: str = "value", known: DataFrame | None = None) -> DataFrame:
    """Means over buckets of so many minutes, labelled by their start and counted from local midnight; missing values do not count. With a
    zone, only series finer than that are resampled. known: resolution(df), if it is at hand."""
    if zone is None:
        return df.groupBy(*keys, T.bucket(F.col(ts), minutes).alias(ts)).agg(F.avg(value).alias(value))
    known = resolution(df, keys, ts) if known is None else known
    known = known.select(*keys, "resolution", T.to_utc(T.floor_unit(T.to_local(F.col("first"), zone), "day"), zone).alias("_origin"))
    marked = df.join(known, list(keys))
    at = F.when(F.col("resolution") < minutes * 60_000_000, T.bucket(F.col(ts), minutes, F.col("_origin"))).otherwise(F.col(ts))
    return marked.groupBy(*keys, at.alias(ts)).agg(F.avg(value).alias(value))


def interpolate(df: DataFrame, keys: Sequence[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """A missing value between two present ones is their mean; longer gaps, ends and rows without a time stay."""
    w = _over([*keys, "_block"], ts)
    between = F.when(F.col(ts).isNotNull(), (F.lag(value).over(w) + F.lead(value).over(w)) / F.lit(2.0))
    return haloed(df, keys, ts, [value]).withColumn(value, F.coalesce(F.col(value), between)).filter("not _halo").drop("_block", "_halo")


def harmonize(df: DataFrame, keys: Sequence[str], zone: Column | str = "UTC", minutes: int | None = 60, fill_gaps: bool = True, ts: str = "ts", value: str = "value") -> DataFrame:
    """Calendar completion, then resampling, then interpolation. The resolution is found once: a completed series has the same one and
    begins with its year."""
    known = resolution(df, keys, ts)
    out = fill_calendar(df, keys, zone, ts, value, known)
    if minutes:
        completed = _calendar(known, zone).withColumn("first", F.when(F.col("_short"), F.col("_a")).otherwise(F.col("first")))
        out = resample(out, keys, minutes, zone, ts, value, completed)
    return interpolate(out, keys, ts, value) if fill_gaps else out


def quality(df: DataFrame, keys: Sequence[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """keys, metric, n: rows, missing values, duplicate times."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(value).isNull()).alias("missing"), (F.count(F.lit(1)) - F.count_distinct(ts)).alias("duplicates"))
    return counts.unpivot(list(keys), ["rows", "missing", "duplicates"], "metric", "n")


def step_histogram(df: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """keys, step (microseconds), n."""
    return steps(df, keys, ts).filter("step is not null").groupBy(*keys, "step").agg(F.count(F.lit(1)).alias("n"))


def occurrences(df: DataFrame, keys: Sequence[str], local: str, ordinal: str) -> Column:
    """Which of the rows of one local time a row is, for localize(ambiguous='infer')."""
    return F.row_number().over(_over([*keys, local], ordinal))


def position(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, out: str = "position") -> DataFrame:
    """df with each row's place in its entity by order, from 0.

    block: what cuts an entity into parts, an expression that never falls along the order. Rows are counted by part; a row per part
    carries the count of the parts before it into the part's window.
    """
    rows = df.withColumn("_block", block)
    counts = rows.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    sums = F.coalesce(F.sum("_n").over(_over(keys, "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = counts.select(*keys, "_block", sums.alias("_before"))
    marked = rows.withColumn("_before", F.lit(None).cast("long")).unionByName(heads, allowMissingColumns=True)
    part = Window.partitionBy(*keys, "_block")
    placed = marked.withColumn(out, F.max("_before").over(part) + F.row_number().over(part.orderBy(F.col("_before").isNull(), *order)) - 2)
    return placed.filter("_before is null").drop("_block", "_before")


def positional(df: DataFrame, keys: Sequence[str], ordinal: str, start: Column, minutes: int, out: str = "ts", block: Column | None = None) -> DataFrame:
    """Times by position: start, in UTC, and one step more for each row. block as in `position`; without one the ordinal is a number, of
    which a part takes 100,000."""
    placed = position(df, keys, [ordinal], F.floor(F.col(ordinal) / 100_000) if block is None else block, "_position")
    return placed.withColumn(out, F.timestamp_add("MINUTE", F.col("_position") * F.lit(minutes), start)).drop("_position")


def percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float], parts: int = 1024, most: int = 200_000) -> DataFrame:
    """keys and a column for each named share: exact percentiles, between two values by distance. Missing values and NaN do not count; an
    entity of nothing else has nulls. At least one key.

    Where no entity has many distinct values, of which a count within some 5 % tells, they are one aggregation's buffer. Beyond that an
    entity's range is cut into equal parts. Their counts say in which parts the wanted values lie, and only the distinct values of
    those are ranked, a part at a time. Both ways are exact.
    """
    if not keys:
        raise ValueError("percentiles are of entities")
    number = F.col(value).cast("double")
    if most and (df.groupBy(*keys).agg(F.approx_count_distinct(number).alias("_n")).agg(F.max("_n")).first()[0] or 0) <= most:
        return df.groupBy(*keys).agg(*[F.percentile(F.when(~F.isnan(number), number), F.lit(q)).alias(n) for n, q in shares.items()])
    own = df.select(*keys, F.when(~F.isnan(number), number).alias("_v")).groupBy(*keys, "_v").agg(F.count("_v").alias("_n"))
    ends = own.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("_all"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = own.filter("_v is not null").join(ends, same)
    cut = inside.withColumn("_part", F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * parts), F.lit(parts - 1))).otherwise(F.lit(0)))
    through = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part"))
    counts = cut.groupBy(*keys, "_part").agg(F.sum("_n").alias("_n"), F.first("_all").alias("_all")).withColumn("_through", through)
    at = lambda q: F.lit(q) * (F.col("_all") - 1)
    ranks = F.array_distinct(F.array(*[f(at(q)) for q in shares.values() for f in (F.floor, F.ceil)]))
    wanted = counts.withColumn("_ranks", F.filter(ranks, lambda r: (r >= F.col("_through") - F.col("_n")) & (r < F.col("_through")))).filter(F.size("_ranks") > 0)
    heads = wanted.select(*[F.col(k).alias(f"_w{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), (F.col("_through") - F.col("_n")).alias("_before"), "_ranks")
    met = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        met &= F.col(k).eqNullSafe(F.col(f"_w{i}"))
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, "_part").orderBy("_v"))
    ranked = cut.join(heads, met).withColumn("_upto", upto).withColumn("_rank", F.explode("_ranks"))
    hit = ranked.filter((F.col("_rank") >= F.col("_upto") - F.col("_n")) & (F.col("_rank") < F.col("_upto")))
    value_at = lambda r: F.max(F.when(F.col("_rank") == r, F.col("_v")))
    found = hit.groupBy(*keys).agg(F.first("_all").alias("_all"), *[value_at(f(at(q))).alias(f"{n}_{name}") for n, q in shares.items() for name, f in (("l", F.floor), ("h", F.ceil))])
    exact = [(F.col(f"{n}_l") + (F.col(f"{n}_h") - F.col(f"{n}_l")) * (at(q) - F.floor(at(q)))).alias(n) for n, q in shares.items()]
    empty = ends.filter("_lo is null").select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], *[F.lit(None).cast("double").alias(n) for n in shares])
    return found.select(*keys, *exact).unionByName(empty)


def expand_years(annual: DataFrame, keys: Sequence[str], value: str, zone: Column | str = "UTC", minutes: int = 60, year: str = "year") -> DataFrame:
    """A value per year to every step of the local years from first to last; ts in UTC, null where a year has none."""
    ends = annual.groupBy(*keys).agg(F.min(year).alias("_a"), F.max(year).alias("_b"))
    day = lambda y: T.to_utc(F.make_timestamp_ntz(y, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)), zone)
    years = ends.select(*keys, F.explode(F.sequence("_a", "_b")).alias(year)).join(annual.select(*keys, year, value), [*keys, year], "left")
    return years.select(*keys, year, value, F.explode(F.sequence(T.micros(day(F.col(year))), T.micros(day(F.col(year) + 1)) - 1, F.lit(minutes * 60_000_000))).alias("_m")).select(*keys, T.from_micros(F.col("_m")).alias("ts"), year, value)


def year_fractions(ranges: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """The share of each year's days, both ends counted, that a date range covers."""
    years = ranges.withColumn("year", F.explode(F.sequence(F.year(start), F.year(end))))
    low, high = F.greatest(F.col(start), F.make_date("year", F.lit(1), F.lit(1))), F.least(F.col(end), F.make_date("year", F.lit(12), F.lit(31)))
    return years.groupBy(*keys, "year").agg(F.sum((F.datediff(high, low) + 1) / T.days_in_year(F.col("year"))).alias("fraction"))


def longest(ranges: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", order: str = "source") -> DataFrame:
    """Of each key's ranges the longest; of equal ones the first by order."""
    w = Window.partitionBy(*keys).orderBy(F.datediff(end, start).desc(), order)
    return ranges.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
