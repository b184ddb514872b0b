import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions.scalar import average_rank, quarter
from gridloom.operators import features, grid


def polygons(spark):
    """A triangle, a ring with a hole, and a concave shape."""
    ring = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    rows = [
        ("T", [ring((0, 0), (3, 0), (0, 3))]),
        ("H", [ring((5, 5), (8, 5), (8, 8), (5, 8)), ring((6, 6), (6, 7), (7, 7), (7, 6))]),
        ("U", [ring((-4, 0), (-1, 0), (-1, 3), (-2, 3), (-2, 1), (-3, 1), (-3, 3), (-4, 3))]),
    ]
    return spark.createDataFrame(rows, "code string, rings array<array<struct<x:double,y:double>>>")


def test_clip_is_exact_where_a_concave_ring_splits():
    u = np.array([(0, 0), (3, 0), (3, 3), (2, 3), (2, 1), (1, 1), (1, 3), (0, 3)], float)
    assert grid.area(grid.clip(u, -1, 2, 4, 4)) == pytest.approx(2)  # both arms above y = 2
    assert grid.area(grid.clip(u, 0.5, 0.5, 2.5, 2.5)) == pytest.approx(1 + 2 * 0.5 * 1.5)
    assert len(grid.clip(u, 5, 5, 6, 6)) == 0


def test_fractions_sum_to_the_area(spark):
    shapes = polygons(spark)
    got = grid.cell_fractions(shapes, 0.5)
    totals = {r["code"]: r["s"] for r in got.groupBy("code").agg(F.sum("fraction").alias("s")).collect()}
    for code, area in (("T", 4.5), ("H", 8.0), ("U", 7.0)):  # the fullest cell is a whole one
        assert totals[code] * 0.25 == pytest.approx(area)
    assert got.agg(F.max("fraction")).first()[0] == 1.0
    inside = {(float(r["y"]), float(r["x"])): r["fraction"] for r in got.filter("code = 'H'").collect()}
    assert (6.5, 6.5) not in inside and inside[5.0, 5.0] == pytest.approx(0.25)


def test_bounds_and_clipped_shapes(spark):
    shapes = polygons(spark)
    rows = {r["code"]: tuple(r)[1:] for r in grid.bounds(shapes).collect()}
    assert rows["T"] == (-1.0, -1.0, 4.0, 4.0) and rows["U"] == (-5.0, -1.0, 0.0, 4.0)
    boxes = spark.createDataFrame([("T", 0.0, 0.0, 1.0, 1.0)], "code string, west double, south double, east double, north double")
    cut = {r["code"]: sum(grid.area(np.array([(p["x"], p["y"]) for p in ring])) for ring in r["rings"]) for r in grid.clip_shapes(shapes, boxes).collect()}
    assert cut["T"] == pytest.approx(1) and cut["H"] == pytest.approx(8) and cut["U"] == pytest.approx(7)
    both = grid.dissolve(shapes.withColumn("to", F.lit("X")), "to").first()
    assert both["code"] == "X" and len(both["rings"]) == 4


def test_harmonized_coordinates(spark):
    df = spark.createDataFrame([(0.0, 1.0, 1.0), (180.0, 1.0, 2.0), (359.75, 1.0, 3.0), (190.0, 2.0, 4.0)], "lon double, lat double, value double")
    got = {r["value"]: float(r["x"]) for r in grid.harmonize_coordinates(df).collect()}
    assert got == {1.0: 0.0, 2.0: 180.0, 3.0: -0.25, 4.0: -170.0}
    west = df.withColumn("lon", F.col("lon") - 180)
    assert grid.harmonize_coordinates(west).count() == 4
    with pytest.raises(Exception, match="longitude"):
        grid.harmonize_coordinates(df.withColumn("lon", F.col("lon") - 300)).collect()


def test_coarsen(spark):
    df = spark.range(40).select((F.col("id") / 20 - 1).cast("decimal(7,3)").alias("x"), F.lit(0).cast("decimal(7,3)").alias("y"), F.lit(1.0).alias("value"))
    got = {float(r["x"]): r["value"] for r in grid.coarsen(df, 0.05).collect()}
    assert sum(got.values()) == 40 and got[-0.5] == 5 and got[-1.0] == 3  # right-closed: -0.875 is the last of -1
    with pytest.raises(ValueError):
        grid.coarsen(df, 0.5, 0.25)


def test_extract_finds_each_cell_once(spark):
    cells = spark.range(400).select((F.col("id") % 20).cast("decimal(7,3)").alias("x"), F.floor(F.col("id") / 20).cast("decimal(7,3)").alias("y"), F.col("id").alias("value"))
    boxes = spark.createDataFrame([("A", 2.0, 3.0, 11.0, 12.0), ("B", 19.0, 19.0, 30.0, 30.0)], "code string, west double, south double, east double, north double")
    got = grid.extract(cells, boxes, 5.0).groupBy("code").count().collect()
    assert {r["code"]: r["count"] for r in got} == {"A": 100, "B": 1}


def test_largest_and_means(spark):
    cells = spark.createDataFrame([(0, 0, 5.0), (0, 1, 9.0), (1, 0, 9.0), (1, 1, 1.0)], "y int, x int, value double")
    parts = cells.select("y", "x", F.lit("A").alias("code"), F.lit(0.5).alias("fraction"))
    top = grid.largest(cells, parts, 3)
    assert [(r["y"], r["x"]) for r in top.orderBy("rank").collect()] == [(1, 0), (0, 1), (0, 0)]
    weather = cells.select(F.lit("A").alias("code"), F.lit(1).alias("ts"), "y", "x", (F.col("y") * 10 + F.col("x")).cast("double").alias("t2m"))
    picked = top.select("code", "y", "x", "rank")
    one = features.mean_over_cells(weather, picked).first()
    assert (one["top1"], one["top3"]) == (10.0, 11 / 3)
    crossed = features.mean_over_cells(weather, picked, mode="orthogonal").first()
    assert (crossed["top1"], crossed["top3"]) == (10.0, pytest.approx((10 + 0 + 0) / 3 + (0 + 1 + 0) / 3))


def test_shape_lookup_prefers_codes(spark):
    records = spark.createDataFrame([("FR", "-99", "France", "La France", 1), ("-99", "FR", "Elsewhere", "x", 2), ("NO", "NO", "Norway", "Norge", 3), ("-99", "-99", "Kosovo", "Kos", 4)], "a string, b string, n string, m string, id int")
    wanted = spark.createDataFrame([("FR", "France"), ("NO", "Norway"), ("XK", "Kosovo"), ("ZZ", "None")], "code string, name string")
    got = {r["code"]: r["id"] for r in grid.shape_lookup(records, wanted, ["a", "b"], ["n", "m"]).collect()}
    assert got == {"FR": 1, "NO": 3, "XK": 4}


def test_average_rank_and_quarters(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", 3.0), ("a", 2.0)], "g string, v double")
    assert sorted((r["v"], r["r"]) for r in df.withColumn("r", average_rank(["g"], "v")).collect()) == [(1.0, 4.0), (2.0, 3.0), (3.0, 1.5), (3.0, 1.5)]
    assert [r[0] for r in spark.createDataFrame([(0.125,), (0.375,), (-0.1,)], "x double").select(quarter(F.col("x"))).collect()] == [0.0, 0.5, 0.0]
