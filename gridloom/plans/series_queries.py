"""Queries of the time-series operators over events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import time as T
from gridloom.functions.scalar import average_rank
from gridloom.operators import features, series
from gridloom.plans.base import Book, Tables

book = Book()

#: Events with missing and zero values, and repeated times, made by rule.
GAPPED_SQL = """gapped AS (SELECT event_id, user_id, event_type, date_trunc('second', ts) AS ts,
  CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 0.0 ELSE value END AS value FROM events)"""


def gapped(t: Tables) -> DataFrame:
    value = F.when(F.col("event_id") % 11 == 0, F.lit(None)).when(F.col("event_id") % 13 == 0, F.lit(0.0)).otherwise(F.col("value"))
    return t.events.select("event_id", "user_id", "event_type", T.floor_unit(F.col("ts"), "second").alias("ts"), value.alias("value"))


HOURLY_SQL = "hourly AS (SELECT event_type, user_id % 20 AS u, date_trunc('hour', ts)::TIMESTAMP AS ts, avg(value) AS value FROM events GROUP BY ALL)"


def hourly(t: Tables) -> DataFrame:
    return series.resample(t.events.withColumn("u", F.col("user_id") % 20), ["event_type", "u"])


GRID_SQL = """ends AS (SELECT event_type, u, min(ts) AS a, max(ts) AS b FROM hourly GROUP BY ALL),
 grid AS (SELECT event_type, u, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM ends),
 filled AS (SELECT g.event_type, g.u, g.ts, h.value FROM grid g LEFT JOIN hourly h ON g.event_type = h.event_type AND g.u = h.u AND g.ts = h.ts)"""
LERP_SQL = """lerp AS (SELECT event_type, u, ts, coalesce(value, (lag(value) OVER w + lead(value) OVER w) / 2) AS value FROM filled WINDOW w AS (PARTITION BY event_type, u ORDER BY ts))"""


@book.add(f"WITH {HOURLY_SQL}, {GRID_SQL}, {LERP_SQL} SELECT event_type, u, ts, round(value, 6) AS value, hour(ts)::BIGINT AS hour, (isodow(ts) >= 6)::INT AS is_weekend, month(ts)::BIGINT AS month FROM lerp")
def ts_flagship(t: Tables) -> DataFrame:
    filled = series.interpolate(series.fill_between(hourly(t), ["event_type", "u"], 60), ["event_type", "u"])
    return filled.select("event_type", "u", "ts", F.round("value", 6).alias("value"), F.hour("ts").cast("long").alias("hour"), T.weekend(F.col("ts")).alias("is_weekend"), F.month("ts").cast("long").alias("month"))


@book.add(f"WITH {GAPPED_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY event_type, ts ORDER BY event_id) AS r FROM gapped WHERE value IS NOT NULL AND value <> 0) SELECT event_id, event_type, ts, value FROM n WHERE r = 1")
def ts_clean(t: Tables) -> DataFrame:
    return series.clean(gapped(t), ["event_type"], ordinal="event_id").select("event_id", "event_type", "ts", "value")


@book.add("SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS ts, round(avg(value), 6) AS value FROM events GROUP BY ALL")
def ts_resample_hourly(t: Tables) -> DataFrame:
    return series.resample(t.events, ["event_type"]).withColumn("value", F.round("value", 6))


@book.add(f"WITH {HOURLY_SQL}, {GRID_SQL} SELECT event_type, u, ts, round(value, 6) AS value FROM filled")
def ts_fill_calendar(t: Tables) -> DataFrame:
    return series.fill_between(hourly(t), ["event_type", "u"], 60).withColumn("value", F.round("value", 6))


@book.add(
    """WITH s AS (SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS ts, avg(value) AS value FROM events WHERE hour(ts) % 5 <> 3 GROUP BY ALL),
 g AS (SELECT e.event_type, unnest(generate_series(TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-12-31 23:00:00', INTERVAL 1 HOUR)) AS ts FROM (SELECT DISTINCT event_type FROM s) e)
 SELECT g.event_type, g.ts, round(s.value, 6) AS value FROM g LEFT JOIN s ON g.event_type = s.event_type AND g.ts = s.ts"""
)
def ts_fill_year(t: Tables) -> DataFrame:
    own = series.resample(t.events.filter(F.hour("ts") % 5 != 3), ["event_type"])
    return series.fill_calendar(own, ["event_type"]).withColumn("value", F.round("value", 6))


#: A zone five hours west of UTC in winter; the events are moved to begin with its year, which then ends five hours late in UTC.
ZONE = "America/New_York"


@book.add(
    """WITH s AS (SELECT event_type, date_trunc('hour', ts + INTERVAL 5 HOUR)::TIMESTAMP AS ts, avg(value) AS value FROM events WHERE hour(ts) % 5 <> 3 GROUP BY ALL),
 g AS (SELECT e.event_type, unnest(generate_series(TIMESTAMP '2024-01-01 05:00:00', TIMESTAMP '2025-01-01 04:00:00', INTERVAL 1 HOUR)) AS ts FROM (SELECT DISTINCT event_type FROM s) e)
 SELECT g.event_type, g.ts, round(s.value, 6) AS value FROM g LEFT JOIN s ON g.event_type = s.event_type AND g.ts = s.ts"""
)
def ts_fill_year_zoned(t: Tables) -> DataFrame:
    moved = t.events.filter(F.hour("ts") % 5 != 3).withColumn("ts", F.timestamp_add("HOUR", F.lit(5), F.col("ts")))
    return series.fill_calendar(series.resample(moved, ["event_type"]), ["event_type"], ZONE).withColumn("value", F.round("value", 6))


@book.add(
    """WITH s AS (SELECT event_type, to_timestamp(floor(epoch(ts) / 1800) * 1800)::TIMESTAMP + INTERVAL 5 HOUR AS ts, avg(value) AS value FROM events GROUP BY ALL),
 g AS (SELECT e.event_type, unnest(generate_series(TIMESTAMP '2024-01-01 05:00:00', TIMESTAMP '2025-01-01 04:30:00', INTERVAL 30 MINUTE)) AS ts FROM (SELECT DISTINCT event_type FROM s) e),
 f AS (SELECT g.event_type, g.ts, s.value FROM g LEFT JOIN s ON g.event_type = s.event_type AND g.ts = s.ts),
 h AS (SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS ts, avg(value) AS value FROM f GROUP BY ALL)
 SELECT event_type, ts, round(coalesce(value, (lag(value) OVER w + lead(value) OVER w) / 2), 6) AS value FROM h WINDOW w AS (PARTITION BY event_type ORDER BY ts)"""
)
def ts_harmonize_zoned(t: Tables) -> DataFrame:
    moved = t.events.withColumn("ts", F.timestamp_add("HOUR", F.lit(5), F.col("ts")))
    return series.harmonize(series.resample(moved, ["event_type"], 30), ["event_type"], ZONE).withColumn("value", F.round("value", 6))


@book.add(f"WITH {HOURLY_SQL}, {GRID_SQL}, {LERP_SQL} SELECT event_type, u, ts, round(value, 6) AS value FROM lerp")
def ts_interpolate_isolated(t: Tables) -> DataFrame:
    filled = series.fill_between(hourly(t), ["event_type", "u"], 60)
    return series.interpolate(filled, ["event_type", "u"]).withColumn("value", F.round("value", 6))


@book.add(
    """WITH s AS (SELECT event_type, to_timestamp(floor(epoch(ts) / 1800) * 1800)::TIMESTAMP AS ts, avg(value) AS value FROM events GROUP BY ALL),
 g AS (SELECT e.event_type, unnest(generate_series(TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-12-31 23:30:00', INTERVAL 30 MINUTE)) AS ts FROM (SELECT DISTINCT event_type FROM s) e),
 f AS (SELECT g.event_type, g.ts, s.value FROM g LEFT JOIN s ON g.event_type = s.event_type AND g.ts = s.ts),
 h AS (SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS ts, avg(value) AS value FROM f GROUP BY ALL)
 SELECT event_type, ts, round(coalesce(value, (lag(value) OVER w + lead(value) OVER w) / 2), 6) AS value FROM h WINDOW w AS (PARTITION BY event_type ORDER BY ts)"""
)
def ts_harmonize(t: Tables) -> DataFrame:
    own = series.resample(t.events, ["event_type"], 30)
    return series.harmonize(own, ["event_type"]).withColumn("value", F.round("value", 6))


@book.add(
    f"""WITH {GAPPED_SQL}, c AS (SELECT event_type, count(*)::BIGINT AS rows, count(*) FILTER (value IS NULL)::BIGINT AS missing, (count(*) - count(DISTINCT ts))::BIGINT AS duplicates FROM gapped GROUP BY 1)
 SELECT event_type, metric, n FROM c UNPIVOT (n FOR metric IN (rows, missing, duplicates))"""
)
def ts_quality_report(t: Tables) -> DataFrame:
    return series.quality(gapped(t), ["event_type"])


@book.add(
    """WITH s AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS step FROM (SELECT user_id, date_trunc('hour', ts) AS ts FROM events))
 SELECT user_id, step, count(*)::BIGINT AS n FROM s WHERE step IS NOT NULL GROUP BY ALL"""
)
def ts_step_histogram(t: Tables) -> DataFrame:
    return series.step_histogram(t.events.select("user_id", T.floor_unit(F.col("ts"), "hour").alias("ts")), ["user_id"])


@book.add(
    """WITH d AS (SELECT event_id, ts + INTERVAL 300 DAY AS a, ts + INTERVAL 66 DAY AS b FROM events),
 l AS (SELECT event_id, unnest([a, b]) AS local FROM d),
 u AS (SELECT event_id, local, timezone('UTC', timezone('America/New_York', local)) AS utc FROM l),
 k AS (SELECT *, timezone('America/New_York', timezone('UTC', utc)) <> local AS gap, timezone('America/New_York', timezone('UTC', utc - INTERVAL 1 HOUR)) = local AS fold FROM u)
 SELECT event_id, local, CASE WHEN gap OR fold THEN NULL ELSE utc END AS utc FROM k"""
)
def ts_localize_nat(t: Tables) -> DataFrame:
    shifted = F.array(F.timestamp_add("DAY", F.lit(300), F.col("ts")), F.timestamp_add("DAY", F.lit(66), F.col("ts")))
    rows = t.events.select("event_id", F.explode(shifted).alias("local"))
    return rows.withColumn("utc", T.localize(F.col("local"), "America/New_York", "null", "null"))


@book.add(
    """WITH l AS (SELECT event_id, timezone('Australia/Adelaide', timezone('UTC', ts)) AS local FROM events)
 SELECT event_id, hour(local)::BIGINT AS hour, (isodow(local) - 1)::BIGINT AS weekday, (isodow(local) >= 6)::INT AS is_weekend, month(local)::BIGINT AS month, year(local)::BIGINT AS year FROM l"""
)
def ts_local_calendar_features(t: Tables) -> DataFrame:
    named = features.local_fields(t.events, "Australia/Adelaide").withColumn("weekday", F.weekday(T.to_local(F.col("ts"), "Australia/Adelaide")))
    return named.select("event_id", *[F.col(c).cast("long").alias(c) for c in ("hour", "weekday")], "is_weekend", *[F.col(c).cast("long").alias(c) for c in ("month", "year")])


ANNUAL_SQL = "annual AS (SELECT o_orderpriority AS p, year(o_orderdate)::BIGINT AS year, sum(o_totalprice) AS total FROM orders GROUP BY ALL)"


def annual(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_orderpriority").alias("p"), F.year("o_orderdate").cast("int").alias("year")).agg(F.sum("o_totalprice").alias("total"))


@book.add(
    f"""WITH {ANNUAL_SQL}, ends AS (SELECT p, min(year) AS a, max(year) AS b FROM annual GROUP BY 1),
 g AS (SELECT p, unnest(generate_series(make_timestamp(a, 1, 1, 0, 0, 0.0), make_timestamp(b, 12, 31, 23, 0, 0.0), INTERVAL 1 HOUR)) AS ts FROM ends)
 SELECT g.p, g.ts, year(g.ts)::BIGINT AS year, round(x.total, 2) AS total FROM g LEFT JOIN annual x ON g.p = x.p AND year(g.ts) = x.year"""
)
def year_expand_hourly(t: Tables) -> DataFrame:
    return series.expand_years(annual(t), ["p"], "total").select("p", "ts", F.col("year").cast("long").alias("year"), F.round("total", 2).alias("total"))


RANGES_SQL = "ranges AS (SELECT o_custkey, min(o_orderdate)::DATE AS s, max(o_orderdate)::DATE AS e FROM orders GROUP BY 1)"


def ranges(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").cast("date").alias("start"), F.max("o_orderdate").cast("date").alias("end"))


@book.add(f"WITH {RANGES_SQL} SELECT o_custkey, unnest(generate_series(year(s), year(e)))::BIGINT AS year FROM ranges")
def available_years(t: Tables) -> DataFrame:
    return ranges(t).select("o_custkey", F.explode(F.sequence(F.year("start").cast("long"), F.year("end").cast("long"))).alias("year"))


@book.add(
    f"""WITH {RANGES_SQL}, d AS (SELECT o_custkey, unnest(generate_series(s, e, INTERVAL 1 DAY)) AS day FROM ranges)
 SELECT o_custkey, year(day)::BIGINT AS year, round(count(*) / dayofyear(make_date(year(day), 12, 31)), 9) AS fraction FROM d GROUP BY o_custkey, year(day)"""
)
def year_fractions(t: Tables) -> DataFrame:
    return series.year_fractions(ranges(t), ["o_custkey"]).select("o_custkey", F.col("year").cast("long").alias("year"), F.round("fraction", 9).alias("fraction"))


@book.add(
    """WITH r AS (SELECT o_custkey AS k, o_orderpriority AS source, min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS b FROM orders GROUP BY ALL),
 n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY b - a DESC, source) AS r FROM r) SELECT k, source, a, b FROM n WHERE r = 1"""
)
def longest_range_wins(t: Tables) -> DataFrame:
    own = t.orders.groupBy(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("source")).agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b"))
    return series.longest(own, ["k"], "a", "b")


@book.add(
    """WITH e AS (SELECT event_type AS g, date_trunc('day', ts)::TIMESTAMP AS d, avg(value) AS v FROM events GROUP BY ALL), m AS (SELECT g, (dayofyear(d) // 3)::BIGINT AS month, avg(round(v, 0)) AS mean FROM e GROUP BY ALL)
 SELECT g, month, round(mean, 6) AS mean, rank() OVER (PARTITION BY g ORDER BY mean DESC) + (count(*) OVER (PARTITION BY g, mean) - 1) / 2 AS rank FROM m"""
)
def monthly_stats_rank_avg(t: Tables) -> DataFrame:
    daily = t.events.groupBy(F.col("event_type").alias("g"), T.floor_unit(F.col("ts"), "day").alias("d")).agg(F.avg("value").alias("v"))
    own = daily.groupBy("g", F.floor(F.dayofyear("d") / 3).cast("long").alias("month")).agg(F.avg(F.round("v", 0)).alias("mean"))
    return own.withColumn("rank", average_rank(["g"], "mean")).withColumn("mean", F.round("mean", 6))


@book.add("SELECT event_type, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def percentiles_5_95(t: Tables) -> DataFrame:
    own = series.percentiles(t.events, ["event_type"], "value", {"p05": 0.05, "p95": 0.95})
    return own.select("event_type", F.round("p05", 6).alias("p05"), F.round("p95", 6).alias("p95"))


@book.add(
    """WITH w AS (SELECT event_type AS code, date_trunc('hour', ts)::TIMESTAMP AS ts, avg(value) AS top1, max(value) AS top3 FROM events GROUP BY ALL),
 l AS (SELECT *, timezone('Asia/Kolkata', timezone('UTC', ts)) AS local FROM w),
 f AS (SELECT code, ts, top1, top3, hour(local)::BIGINT AS hour, (isodow(local) >= 6)::INT AS is_weekend, month(local)::BIGINT AS month, year(local)::BIGINT AS year FROM l),
 m AS (SELECT code, year, month, avg(top1) AS month_avg FROM f GROUP BY ALL),
 r AS (SELECT *, rank() OVER (PARTITION BY code, year ORDER BY month_avg DESC) + (count(*) OVER (PARTITION BY code, year, month_avg) - 1) / 2 AS month_rank FROM m),
 y AS (SELECT code, year, avg(top1) AS year_avg, quantile_cont(top1, 0.05) AS p05, quantile_cont(top1, 0.95) AS p95 FROM f GROUP BY ALL)
 SELECT code, ts, hour, is_weekend, month, year, round(top1, 6) AS top1, top3, round(month_avg, 6) AS month_avg, month_rank, round(year_avg, 6) AS year_avg, round(p05, 6) AS p05, round(p95, 6) AS p95
 FROM f JOIN r USING (code, year, month) JOIN y USING (code, year)"""
)
def feature_table(t: Tables) -> DataFrame:
    own = t.events.groupBy(F.col("event_type").alias("code"), T.floor_unit(F.col("ts"), "hour").alias("ts")).agg(F.avg("value").alias("top1"), F.max("value").alias("top3"))
    out = features.temperature_features(own, ["code"], "Asia/Kolkata")
    rounded = [F.round(c, 6).alias(c) for c in ("top1", "month_avg", "year_avg", "p05", "p95")]
    return out.select("code", "ts", *[F.col(c).cast("long").alias(c) for c in ("hour", "month", "year")], "is_weekend", "top3", "month_rank", *rounded)


@book.add("SELECT o_orderkey, round(o_totalprice / avg(o_totalprice) OVER (PARTITION BY o_orderpriority), 9) AS normalized FROM orders")
def normalize_by_group_mean(t: Tables) -> DataFrame:
    return features.group_mean_normalized(t.orders, ["o_orderpriority"], "o_totalprice").select("o_orderkey", F.round("normalized", 9).alias("normalized"))


@book.add("SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::BIGINT AS position FROM events")
def hour_of_year_cumcount(t: Tables) -> DataFrame:
    return features.position_in_group(t.events, ["user_id"], ["ts", "event_id"], block=T.floor_unit(F.col("ts"), "day")).select("event_id", "position")


@book.add(
    """WITH o AS (SELECT o_orderkey, (o_orderkey % 20) AS source, o_orderdate FROM orders)
 SELECT source, o_orderkey, row_number() OVER (PARTITION BY source ORDER BY o_orderkey)::BIGINT - 1 AS n, TIMESTAMP '2024-03-31 00:30:00' + (row_number() OVER (PARTITION BY source ORDER BY o_orderkey) - 1) * INTERVAL 30 MINUTE AS ts FROM o"""
)
def positional_index(t: Tables) -> DataFrame:
    own = features.position_in_group(t.orders.select("o_orderkey", (F.col("o_orderkey") % 20).alias("source")), ["source"], ["o_orderkey"], "n")
    return series.positional(own, ["source"], "o_orderkey", F.lit("2024-03-31 00:30:00").cast("timestamp_ntz"), 30)
