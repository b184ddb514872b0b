"""Queries of shapes made from rows of part, customer and supplier: overlays, dissolved borders, subdivisions, cell fractions, bounds.

Most shapes have whole-numbered corners, so that the SQL can count unit cells; triangles are told by the area below their long side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators import grid, overlay
from gridloom.plans.base import Book, Tables
from gridloom.plans.grid_queries import doubles

book = Book()


def ring(*points: tuple[Column, Column]) -> Column:
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in points])


def rectangle(west: Column, south: Column, east: Column, north: Column, hole: bool = False) -> Column:
    """Counter-clockwise, or clockwise as a hole."""
    corners = [(west, south), (east, south), (east, north), (west, north)]
    return ring(*(corners[::-1] if hole else corners))


#: For each part two rectangles in a square of its own, 8 wide; every third part has a second one on the right side, every fourth a hole on the left.
SQUARES_SQL = """p AS (SELECT p_partkey AS k, p_size % 4 AS code, p_partkey % 64 * 8 AS x0, p_partkey // 64 * 8 AS y0 FROM part),
 u AS (SELECT code, k, i, j, i < 2 + k % 5 AND j < 3 + k % 3 AND NOT (k % 4 = 0 AND i = 1 AND j = 1) AS l,
  i >= 1 + k % 4 AND i < 4 + k % 4 AND j >= 1 + k % 2 AND j < 2 + k % 2 + k % 4 OR k % 3 = 0 AND i < 7 AND j >= 5 AND j < 7 AS r FROM p, range(8) a(i), range(8) b(j))"""


def squares(t: Tables) -> tuple[DataFrame, DataFrame]:
    k = F.col("p_partkey")
    x, y = k % 64 * 8, F.floor(k / 64) * 8
    left = F.array(rectangle(x, y, x + 2 + k % 5, y + 3 + k % 3))
    hole = F.when(k % 4 == 0, F.array(rectangle(x + 1, y + 1, x + 2, y + 2, hole=True))).otherwise(F.array().cast(overlay.RINGS))
    right = F.array(rectangle(x + 1 + k % 4, y + 1 + k % 2, x + 4 + k % 4, y + 2 + k % 2 + k % 4))
    second = F.when(k % 3 == 0, F.array(rectangle(x, y + 5, x + 7, y + 7))).otherwise(F.array().cast(overlay.RINGS))
    own = t.part.withColumn("code", F.col("p_size") % 4)
    return own.select("code", F.concat(left, hole).alias("rings")), own.select("code", F.concat(right, second).alias("rings"))


@book.add(
    f"WITH {SQUARES_SQL} SELECT code::INT AS code, count(*) FILTER (l AND NOT r)::DOUBLE AS difference, count(*) FILTER (l AND r)::DOUBLE AS intersection, count(*) FILTER (l OR r)::DOUBLE AS both, count(*) FILTER (l <> r)::DOUBLE AS symmetric FROM u GROUP BY 1"
)
def polygon_overlay(t: Tables) -> DataFrame:
    left, right = squares(t)
    side = lambda df, name: df.select(F.col("code").alias("key"), F.lit(name).alias("layer"), "rings")
    how = {"difference": "cut", "intersection": "keep", "both": "add", "symmetric": "differ"}
    steps = [s for name, op in how.items() for s in (("add", name, "left"), (op, name, "right"))]
    made = overlay.ringed(side(left, "left").unionByName(side(right, "right")), steps, list(how), 64.0)
    areas = overlay.measured_rings(made, "key", "layer")
    columns = [F.coalesce(F.round(F.sum(F.when(F.col("layer") == n, F.col("area"))), 6), F.lit(0.0)).alias(n) for n in how]
    return areas.groupBy(F.col("key").alias("code")).agg(*columns)


@book.add(
    """WITH c AS (SELECT c_nationkey AS code, c_custkey % 40 AS x, c_custkey // 40 AS y FROM customer),
 n AS (SELECT a.code, count(*) AS pairs FROM c a JOIN c b ON a.code = b.code AND (b.x = a.x + 1 AND b.y = a.y OR b.x = a.x AND b.y = a.y + 1) GROUP BY 1)
 SELECT code, count(*)::DOUBLE AS area, (4 * count(*) - 2 * coalesce(any_value(pairs), 0))::DOUBLE AS border FROM c LEFT JOIN n USING (code) GROUP BY 1"""
)
def dissolved_cells(t: Tables) -> DataFrame:
    """Unit cells of customers dissolved by nation; shared borders vanish."""
    x, y = F.col("c_custkey") % 40, F.floor(F.col("c_custkey") / 40)
    cells = t.customer.select("c_nationkey", F.array(rectangle(x, y, x + 1, y + 1)).alias("rings"))
    shapes = overlay.dissolve(cells, "c_nationkey", 64.0)
    return overlay.measured(shapes).select("code", F.round("area", 6).alias("area"), F.round("border", 6).alias("border"))


#: Who yields to whom, in order: what C has left cuts D, so the order matters.
YIELDS = [("cut", "B", "A"), ("cut", "C", "B"), ("keep", "C", "bounds"), ("cut", "D", "C"), ("cut", "D", "A"), ("add", "A", "gap"), ("cut", "B", "gap"), ("cut", "D", "gap"), ("cut", "C", "gap"), ("cut", "D", "B")]


@book.add(
    """WITH p AS (SELECT p_partkey AS k, p_partkey % 80 * 3 AS x0, p_partkey // 80 * 3 AS y0, ['A', 'B', 'C', 'D'][1 + p_size % 4] AS layer FROM part),
 u AS (SELECT DISTINCT layer, x0 + i AS x, y0 + j AS y FROM p, range(7) a(i), range(7) b(j) WHERE i < 4 + k % 4 AND j < 4 + k % 3),
 e AS (SELECT max(y0) + 9 AS top FROM p),
 w AS (SELECT x, y, bool_or(layer = 'A') AS a, bool_or(layer = 'B') AS b, bool_or(layer = 'C') AS c, bool_or(layer = 'D') AS d, any_value(x >= 30 AND x < 200 AND y < top) AS bounds, any_value(x >= 100 AND x < 140 AND y >= 3 AND y < 40) AS gap
  FROM (SELECT * FROM u UNION ALL SELECT 'gap', i, j FROM range(100, 140) a(i), range(3, 40) b(j)) CROSS JOIN e GROUP BY x, y),
 s1 AS (SELECT *, b AND NOT a AS b1 FROM w), s2 AS (SELECT *, c AND NOT b1 AND bounds AS c1 FROM s1),
 s3 AS (SELECT a OR gap AS A, b1 AND NOT gap AS B, c1 AND NOT gap AS C, d AND NOT c1 AND NOT a AND NOT gap AND NOT (b1 AND NOT gap) AS D FROM s2)
 SELECT code, n::DOUBLE AS area FROM (SELECT unnest(['A', 'B', 'C', 'D']) AS code, unnest([count(*) FILTER (A), count(*) FILTER (B), count(*) FILTER (C), count(*) FILTER (D)]) AS n FROM s3) WHERE n > 0"""
)
def subdivided(t: Tables) -> DataFrame:
    """Four overlapping regions cut from each other in order, one bounded and one filled up."""
    k = F.col("p_partkey")
    x, y = k % 80 * 3, F.floor(k / 80) * 3
    own = t.part.select(F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("p_size") % 4 + 1).cast("int")).alias("code"), F.array(rectangle(x, y, x + 4 + k % 4, y + 4 + k % 3)).alias("rings"))
    top = t.part.agg((F.max(F.floor(k / 80)) * 3 + 9).alias("top"))
    bounds = top.select(F.lit("bounds").alias("code"), F.array(rectangle(F.lit(30), F.lit(-1), F.lit(200), F.col("top"))).alias("rings"))
    gap = top.select(F.lit("gap").alias("code"), F.array(rectangle(F.lit(100), F.lit(3), F.lit(140), F.lit(40))).alias("rings"))
    shapes = own.unionByName(bounds).unionByName(gap).select(F.lit(0).alias("key"), F.col("code").alias("layer"), "rings")
    made = overlay.ringed(shapes, YIELDS, list("ABCD"), 64.0)
    return overlay.measured_rings(made, "layer").select(F.col("layer").alias("code"), F.round("area", 6).alias("area"))


#: For each supplier a rectangle, one with a hole, or a triangle.
SHAPES_SQL = """s AS (SELECT s_suppkey AS code, s_suppkey % 3 AS kind, s_suppkey % 36 * 0.75::DOUBLE - 10 AS x0, s_suppkey % 17 * 0.75::DOUBLE AS y0, 1.3::DOUBLE + s_nationkey % 5 * 0.5::DOUBLE AS w, 1::DOUBLE + s_suppkey % 4 * 0.7::DOUBLE AS h FROM supplier)"""


def supplier_shapes(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    x, y = k % 36 * F.lit(0.75) - 10, k % 17 * F.lit(0.75)
    e, n = x + (F.lit(1.3) + F.col("s_nationkey") % 5 * F.lit(0.5)), y + (F.lit(1.0) + k % 4 * F.lit(0.7))
    whole = rectangle(x, y, e, n)
    holed = F.array(whole, rectangle(x + 0.25, y + 0.25, x + 0.75, y + 0.75, hole=True))
    rings = F.when(k % 3 == 0, F.array(whole)).when(k % 3 == 1, holed).otherwise(F.array(ring((x, y), (e, y), (x, n))))
    return t.supplier.select(k.alias("code"), rings.alias("rings"))


@book.add(
    f"""WITH {SHAPES_SQL},
 c AS (SELECT s.*, i * 0.5::DOUBLE - 0.25 AS cw, j * 0.5::DOUBLE - 0.25 AS cs FROM s, LATERAL (SELECT unnest(range(floor(x0 * 2)::INT - 1, ceil((x0 + w) * 2)::INT + 2)) AS i), LATERAL (SELECT unnest(range(floor(y0 * 2)::INT - 1, ceil((y0 + h) * 2)::INT + 2)) AS j)),
 b AS (SELECT *, greatest(cw, x0) AS bw, least(cw + 0.5, x0 + w) AS be, greatest(cs, y0) AS bs, least(cs + 0.5, y0 + h) AS bn FROM c),
 q AS (SELECT *, greatest(0, be - bw) * greatest(0, bn - bs) AS box, greatest(0, least(be, x0 + 0.75) - greatest(bw, x0 + 0.25)) * greatest(0, least(bn, y0 + 0.75) - greatest(bs, y0 + 0.25)) AS hole,
  (bw - x0) / w AS u1, (be - x0) / w AS u2, (bs - y0) / h AS v1, (bn - y0) / h AS v2 FROM b),
 a AS (SELECT code, cs + 0.25 AS y, cw + 0.25 AS x, CASE WHEN box <= 0 THEN 0 WHEN kind = 0 THEN box WHEN kind = 1 THEN box - hole
  ELSE w * h / 2 * (pow(greatest(0, 1 - u1 - v1), 2) - pow(greatest(0, 1 - u2 - v1), 2) - pow(greatest(0, 1 - u1 - v2), 2) + pow(greatest(0, 1 - u2 - v2), 2)) END AS a FROM q)
 SELECT code, y, x, round(a / max(a) OVER (PARTITION BY code), 7) AS fraction FROM a WHERE a > 2.5e-10"""
)
def cell_fraction(t: Tables) -> DataFrame:
    return doubles(grid.cell_fractions(supplier_shapes(t), 0.5)).withColumn("fraction", F.round("fraction", 7))


@book.add(
    f"""WITH {SHAPES_SQL} SELECT code, round_even((x0 - 1) * 4, 0) / 4 AS west, round_even((y0 - 1) * 4, 0) / 4 AS south, round_even((x0 + w + 1) * 4, 0) / 4 AS east, round_even((y0 + h + 1) * 4, 0) / 4 AS north FROM s"""
)
def shape_bounds(t: Tables) -> DataFrame:
    return grid.bounds(supplier_shapes(t))
