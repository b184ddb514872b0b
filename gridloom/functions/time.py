"""Column functions on TIMESTAMP_NTZ: zones with an explicit policy for folds and gaps, calendars, date ranges, label shifts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UTC = "UTC"
EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def _zone(zone: Column | str) -> Column:
    return F.lit(zone) if isinstance(zone, str) else zone


def to_utc(ts: Column, zone: Column | str) -> Column:
    """Local to UTC; a fold is the earlier instant, a gap is shifted forward."""
    return F.convert_timezone(_zone(zone), F.lit(UTC), ts)


def to_local(ts: Column, zone: Column | str) -> Column:
    return F.convert_timezone(F.lit(UTC), _zone(zone), ts)


def hours(ts: Column, n: float) -> Column:
    """ts shifted by n hours; fractions to the minute."""
    return F.timestamp_add("MINUTE", F.lit(round(n * 60)), ts)


def is_gap(ts: Column, zone: Column | str) -> Column:
    """No instant has this local time."""
    return to_local(to_utc(ts, zone), zone) != ts


def fold_minutes(ts: Column, zone: Column | str) -> Column:
    """Minutes between the two instants of this local time; null if there is one."""
    u = to_utc(ts, zone)
    return F.when(to_local(hours(u, 1), zone) == ts, F.lit(60)).when(to_local(hours(u, 0.5), zone) == ts, F.lit(30))


def localize(ts: Column, zone: Column | str, ambiguous: str = "raise", nonexistent: str = "raise", occurrence: Column | None = None) -> Column:
    """The UTC instant of a local time.

    ambiguous: raise, null, earlier, later or infer (by occurrence, 1 for the first and 2 for the second row of the local time in order).
    nonexistent: raise, null or forward.
    """
    policies = ({"raise", "null", "earlier", "later", "infer"}, {"raise", "null", "forward"})
    if ambiguous not in policies[0] or nonexistent not in policies[1] or (ambiguous == "infer") != (occurrence is not None):
        raise ValueError("unknown policy, or infer without occurrence")
    u, fold = to_utc(ts, zone), fold_minutes(ts, zone)
    later = F.timestamp_add("MINUTE", fold, u)
    none = F.lit(None).cast("timestamp_ntz")
    fail = lambda what: F.raise_error(F.concat(F.lit(f"{what} local time "), ts.cast("string"))).cast("timestamp_ntz")
    of_fold = {"raise": fail("ambiguous"), "null": none, "earlier": u, "later": later, "infer": F.when(occurrence >= 2, later).otherwise(u) if occurrence is not None else none}[ambiguous]
    of_gap = {"raise": fail("nonexistent"), "null": none, "forward": u}[nonexistent]
    return F.when(is_gap(ts, zone), of_gap).when(fold.isNotNull(), of_fold).otherwise(u)


def dst_minutes(ts: Column, zone: Column | str) -> Column:
    """Minutes that local time at a UTC instant is ahead of the zone's standard time of that year."""
    offset = lambda t: F.timestamp_diff("MINUTE", t, to_local(t, zone))
    at = lambda month: F.make_timestamp_ntz(F.year(ts), F.lit(month), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return offset(ts) - F.least(offset(at(1)), offset(at(7)))


def micros(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), ts)


def from_micros(n: Column) -> Column:
    return F.timestamp_add("MICROSECOND", n, F.expr(EPOCH))


def bucket(ts: Column, minutes: int, origin: Column | None = None) -> Column:
    """The start of the bucket of so many minutes that holds ts, counted from origin (the epoch)."""
    zero = micros(origin) if origin is not None else F.lit(0)
    return from_micros(F.floor((micros(ts) - zero) / F.lit(minutes * 60_000_000)) * F.lit(minutes * 60_000_000) + zero)


def floor_unit(ts: Column, unit: str) -> Column:
    """date_trunc that stays TIMESTAMP_NTZ."""
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def weekend(ts: Column) -> Column:
    return (F.weekday(ts) >= 5).cast("int")


def days_in_year(year: Column) -> Column:
    return F.dayofyear(F.make_date(year, F.lit(12), F.lit(31)))


def round_second(ts: Column) -> Column:
    return floor_unit(F.timestamp_add("MICROSECOND", F.lit(500_000), ts), "second")


def date_range(start: Column, end: Column, freq: str) -> Column:
    """Dates from start to end, both inclusive, as an array. freq: nD; nMS and nYS, starts of months and years; ME, ends of months that are not after
    end; nh and nmin, times without a zone."""
    n, unit = int("".join(c for c in freq if c.isdigit()) or 1), "".join(c for c in freq if not c.isdigit())
    if unit in ("h", "min"):
        found = F.sequence(start.cast("timestamp_ntz"), end.cast("timestamp_ntz"), F.make_dt_interval(**{"hours" if unit == "h" else "mins": F.lit(n)}))
    elif unit == "D":
        found = F.sequence(start, end, F.make_dt_interval(days=F.lit(n)))
    elif unit in ("MS", "YS", "ME"):
        first = F.trunc(start, "year" if unit == "YS" else "month")
        found = F.sequence(first, F.greatest(first, end), F.make_ym_interval(years=F.lit(n)) if unit == "YS" else F.make_ym_interval(months=F.lit(n if unit == "MS" else 1)))
        if unit == "ME":
            found = F.transform(found, F.last_day)
        elif n > 1:  # the first start that is not before the range, then every n-th
            found = F.sequence(F.when(first < start, F.add_months(first, 1)).otherwise(first), F.greatest(first, end), F.make_ym_interval(months=F.lit(n)))
        found = F.filter(found, lambda d: (d >= start) & (d <= end))
    else:
        raise ValueError(f"unknown frequency {freq}")
    return found


def with_ends(dates: Column, start: Column, end: Column) -> Column:
    """The sorted distinct union of dates with start and end."""
    return F.array_sort(F.array_union(dates, F.array(start, end)))


def pairs(dates: Column) -> Column:
    """Consecutive boundaries as structs (from, to)."""
    return F.transform(F.slice(dates, 1, F.greatest(F.size(dates) - 1, F.lit(0))), lambda d, i: F.struct(d.alias("from"), F.get(dates, i + 1).alias("to")))
