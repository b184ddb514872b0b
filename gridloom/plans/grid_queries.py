"""Queries of grids and shapes over pseudo-grids made from part and customer, and of the model over events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scalar import quarter
from gridloom.operators import features, forecast, grid, series
from gridloom.plans.base import Book, Tables

book = Book()

#: A cell for each part, in tenths of a degree.
CELLS_SQL = "cells AS (SELECT p_partkey, (p_partkey * 37 % 100)::INT AS iy, (p_partkey * 61 % 120)::INT AS ix, p_retailprice AS value FROM part)"


def cells(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    return t.part.select("p_partkey", (key * 37 % 100).cast("int").alias("iy"), (key * 61 % 120).cast("int").alias("ix"), F.col("p_retailprice").alias("value"))


def labelled(t: Tables) -> DataFrame:
    own = cells(t)
    return own.select("p_partkey", (F.col("iy") / 10).cast(grid.LABEL).alias("y"), (F.col("ix") / 10).cast(grid.LABEL).alias("x"), "value")


def doubles(df: DataFrame) -> DataFrame:
    """Labels as doubles, for comparison with other engines."""
    return df.withColumns({c: F.col(c).cast("double") for c in ("y", "x")})


@book.add(f"WITH {CELLS_SQL}, n AS (SELECT p_partkey % 5 AS code, p_partkey, value, row_number() OVER (PARTITION BY p_partkey % 5 ORDER BY value DESC, iy DESC, ix DESC, p_partkey) AS rank FROM cells WHERE iy >= 50) SELECT code, rank::BIGINT AS rank, value FROM n WHERE rank <= 3")
def topk_cells(t: Tables) -> DataFrame:
    own = labelled(t).withColumn("code", F.col("p_partkey") % 5)
    inside = own.select("code", "y", "x", F.when(F.col("y") >= 5, F.lit(1.0)).otherwise(F.lit(0.0)).alias("fraction")).distinct()
    joined = grid.largest(own.withColumnRenamed("code", "part_code"), inside, 3, keys=["part_code"])
    return joined.filter("code = part_code").select("code", F.col("rank").cast("long").alias("rank"), "value")


@book.add(
    f"""WITH {CELLS_SQL}, b AS (SELECT ceil((iy / 10.0::DOUBLE + 0.125) / 0.25) - 1 AS ky, ceil((ix / 10.0::DOUBLE + 0.125) / 0.25) - 1 AS kx, value FROM cells)
 SELECT (ky * 0.25)::DOUBLE AS y, (kx * 0.25)::DOUBLE AS x, round(sum(value), 2) AS value FROM b GROUP BY ALL"""
)
def coarsen_grid(t: Tables) -> DataFrame:
    return doubles(grid.coarsen(labelled(t), 0.1).withColumn("value", F.round("value", 2)))


@book.add("SELECT c_custkey, round(CASE WHEN lon + 179.99999 >= 360 THEN lon + 179.99999 - 360 ELSE lon + 179.99999 END - 179.99999, 4) AS x FROM (SELECT c_custkey, (c_custkey % 1440) / 4.0::DOUBLE AS lon FROM customer)")
def wrap_longitudes(t: Tables) -> DataFrame:
    own = t.customer.select("c_custkey", (F.col("c_custkey") % 1440 / F.lit(4.0)).alias("lon"), F.lit(0.0).alias("lat"))
    return grid.harmonize_coordinates(own, keys=["c_custkey"]).select("c_custkey", F.col("x").cast("double").alias("x"))


@book.add("SELECT c_custkey, round_even((c_custkey % 1000) / 8.0::DOUBLE * 4, 0) / 4 AS q FROM customer")
def quarter_degree_bounds(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", quarter(F.col("c_custkey") % 1000 / F.lit(8.0)).alias("q"))


@book.add(
    f"""WITH {CELLS_SQL}, boxes AS (SELECT * FROM (VALUES ('A', 10, 20, 45, 61), ('B', 40, 0, 119, 33), ('C', 0, 90, 5, 99)) v(code, w, s, e, n))
 SELECT code, p_partkey, (iy / 10.0)::DOUBLE AS y, (ix / 10.0)::DOUBLE AS x, value FROM cells JOIN boxes ON ix BETWEEN w AND e AND iy BETWEEN s AND n"""
)
def bbox_slice(t: Tables) -> DataFrame:
    boxes = t._spark.createDataFrame([("A", 1.0, 2.0, 4.5, 6.1), ("B", 4.0, 0.0, 11.9, 3.3), ("C", 0.0, 9.0, 0.5, 9.9)], "code string, west double, south double, east double, north double")
    edges = boxes.select("code", *[F.col(c).cast(grid.LABEL).alias(c) for c in ("west", "south", "east", "north")])
    return doubles(grid.extract(labelled(t), edges, 2.0).select("code", "p_partkey", "y", "x", "value"))


@book.add("WITH w AS (SELECT p_partkey % 5 AS code, p_size AS ts, (p_partkey * 37 % 100)::INT AS iy, p_retailprice AS t2m FROM part), k AS (SELECT * FROM (VALUES (1, 1), (12, 2), (23, 3)) v(iy, rank)) SELECT code, ts, round(avg(t2m) FILTER (rank <= 1), 6) AS top1, round(avg(t2m) FILTER (rank <= 3), 6) AS top3 FROM w JOIN k USING (iy) GROUP BY ALL")
def mean_over_top_cells(t: Tables) -> DataFrame:
    weather = t.part.select((F.col("p_partkey") % 5).alias("code"), F.col("p_size").alias("ts"), (F.col("p_partkey") * 37 % 100).cast("int").alias("y"), F.lit(0).alias("x"), F.col("p_retailprice").alias("t2m"))
    tops = t._spark.createDataFrame([(c, y, 0, r) for c in range(5) for y, r in ((1, 1), (12, 2), (23, 3))], "code long, y int, x int, rank int")
    return features.mean_over_cells(weather, tops).select("code", "ts", F.round("top1", 6).alias("top1"), F.round("top3", 6).alias("top3"))


@book.add()
def gbt_logo(t: Tables) -> DataFrame:
    """Leave-one-group-out errors of boosted trees on events; the models of all groups grow together."""
    hourly = series.resample(t.events, ["event_type"])
    rows = features.local_fields(hourly, "UTC")
    target = features.group_mean_normalized(rows, ["event_type"], "value", "target").select("event_type", "hour", "is_weekend", F.dayofmonth("ts").alias("day"), "target")
    return forecast.leave_one_group_out(target, "event_type", ["hour", "is_weekend", "day"], trees=5, depth=3)


@book.add(
    """WITH r AS (SELECT event_type AS g, value AS y, hour(ts) AS f0, user_id % 10 AS f1, dayofmonth(ts) AS f2 FROM events WHERE value IS NOT NULL), m AS (SELECT DISTINCT g AS out FROM r),
 b AS (SELECT out, avg(y) AS base FROM r JOIN m ON g <> out GROUP BY 1),
 u AS (SELECT out, f, x, sum(base - y) AS gs, count(*) AS h FROM (SELECT out, base, y, unnest([0, 1, 2]) AS f, unnest([f0, f1, f2]) AS x FROM r JOIN b ON g <> out) GROUP BY ALL),
 c AS (SELECT out, f, x, sum(gs) OVER w AS gl, sum(h) OVER w AS hl, sum(gs) OVER v AS g, sum(h) OVER v AS ht FROM u WINDOW w AS (PARTITION BY out, f ORDER BY x), v AS (PARTITION BY out, f)),
 k AS (SELECT *, row_number() OVER (PARTITION BY out ORDER BY gl * gl / (hl + 1) + (g - gl) * (g - gl) / (ht - hl + 1) - g * g / (ht + 1) DESC) AS n FROM c WHERE ht - hl >= 1),
 p AS (SELECT out, r.g, y, base + CASE WHEN [f0, f1, f2][f + 1] <= x THEN -0.3::DOUBLE * gl / (hl + 1) ELSE -0.3::DOUBLE * (k.g - gl) / (ht - hl + 1) END AS p FROM r CROSS JOIN b JOIN k USING (out) WHERE n = 1)
 SELECT out AS event_type, round(avg(abs(p - y)) FILTER (g <> out), 6) AS train_mae, round(avg(abs(p - y)) FILTER (g = out), 6) AS test_mae FROM p GROUP BY 1"""
)
def gbt_stumps(t: Tables) -> DataFrame:
    """Leave-one-group-out errors of one tree of one cut, by the first step of second-order boosting."""
    rows = t.events.select("event_type", F.hour("ts").alias("hour"), (F.col("user_id") % 10).alias("user"), F.dayofmonth("ts").alias("day"), F.col("value").alias("target"))
    found = forecast.leave_one_group_out(rows, "event_type", ["hour", "user", "day"], trees=1, depth=1, rate=0.3, bins=512)
    return found.select("event_type", F.round("train_mae", 6).alias("train_mae"), F.round("test_mae", 6).alias("test_mae"))
