"""Gridded values as long tables (y, x, value): coordinates, coarsening, boxes, cell fractions, the largest cells, and rasters per entity."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions.scalar import bounded, finite, quarter, wrap_longitude
from gridloom.operators.overlay import cell_of, cut_at_lines, edges

LABEL = "decimal(7,3)"
LIMIT = 180.01


def harmonize_coordinates(grid: DataFrame, lon: str = "lon", lat: str = "lat", keys: Sequence[str] = ()) -> DataFrame:
    """lon, lat to x, y of DECIMAL(7,3). If no longitude is below 0 they are wrapped to (-180, 180]; of cells that then meet one stays.

    A coordinate outside +-180.01 is an error."""
    low = grid.agg(F.min(lon).alias("_low"))
    wrapped = F.when(F.col("_low") >= 0, wrap_longitude(F.col(lon).cast("double"))).otherwise(F.col(lon).cast("double"))
    checked = F.when(F.abs(wrapped) > LIMIT, F.raise_error(F.lit("longitude outside +-180")).cast("double")).otherwise(wrapped)
    named = grid.crossJoin(F.broadcast(low)).withColumn("x", F.round(checked, 3).cast(LABEL)).withColumn("y", F.round(lat, 3).cast(LABEL))
    first = F.row_number().over(Window.partitionBy(*keys, "y", "x").orderBy(lon))
    return named.withColumn("_n", first).filter("_n = 1").drop("_n", "_low", lon, lat)


def bounds(shapes: DataFrame, margin: float = 1.0) -> DataFrame:
    """code, west, south, east, north: of all vertices, a margin wider, to a quarter degree."""
    points = shapes.select("code", F.explode(F.flatten("rings")).alias("p"))
    own = points.groupBy("code").agg(F.min("p.x").alias("w"), F.min("p.y").alias("s"), F.max("p.x").alias("e"), F.max("p.y").alias("n"))
    return own.select("code", quarter(F.col("w") - margin).alias("west"), quarter(F.col("s") - margin).alias("south"), quarter(F.col("e") + margin).alias("east"), quarter(F.col("n") + margin).alias("north"))


def box(grid: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Cells whose labels are in the box, edges included; the filter reaches the scan."""
    return grid.filter(F.col("x").between(west, east) & F.col("y").between(south, north))


def extract(grid: DataFrame, boxes: DataFrame, tile: float = 10.0) -> DataFrame:
    """Each box's cells. Boxes are entered under every tile that they touch, so the range join is an equi-join on tiles."""
    tiles = lambda a, b: F.sequence(F.floor(F.col(a) / tile).cast("int"), F.floor(F.col(b) / tile).cast("int"))
    entered = boxes.withColumn("_tx", F.explode(tiles("west", "east"))).withColumn("_ty", F.explode(tiles("south", "north")))
    placed = grid.withColumn("_tx", F.floor(F.col("x") / tile).cast("int")).withColumn("_ty", F.floor(F.col("y") / tile).cast("int"))
    inside = F.col("x").between(F.col("west"), F.col("east")) & F.col("y").between(F.col("south"), F.col("north"))
    return placed.join(entered, ["_tx", "_ty"]).filter(inside).drop("_tx", "_ty", "west", "south", "east", "north")


def bin_index(coordinate: Column, size: float) -> Column:
    """The cell of a grid of this size, centred on its multiples, right-closed, that holds the coordinate."""
    return (F.ceil((coordinate.cast("double") + F.lit(size / 2)) / F.lit(size)) - 1).cast("long")


def coarsen(grid: DataFrame, source: float, target: float = 0.25, keys: Sequence[str] = (), value: str = "value", how: str = "sum") -> DataFrame:
    """keys, y, x, value on the coarser grid; how: sum or mean."""
    if target <= source or abs(360 / target - round(360 / target)) > 1e-9 or how not in ("sum", "mean"):
        raise ValueError("the target must be coarser than the source and divide 360; how is sum or mean")
    total = F.sum(value) if how == "sum" else F.avg(value)
    binned = grid.groupBy(*keys, bin_index(F.col("y"), target).alias("_y"), bin_index(F.col("x"), target).alias("_x")).agg(total.alias(value))
    return binned.select(*keys, (F.col("_y") * target).cast(LABEL).alias("y"), (F.col("_x") * target).cast(LABEL).alias("x"), value)


def clip(ring: np.ndarray, west: float, south: float, east: float, north: float) -> np.ndarray:
    """A ring clipped to a rectangle, one half-plane after the other; its signed area is exact even where the clipped ring touches itself."""
    for axis, edge, sign in ((0, west, 1), (0, east, -1), (1, south, 1), (1, north, -1)):
        if not len(ring):
            return ring
        side = (ring[:, axis] - edge) * sign
        after, other = np.roll(ring, -1, 0), np.roll(side, -1)
        out = []
        for p, q, a, b in zip(ring, after, side, other):
            if a >= 0:
                out.append(p)
            if (a >= 0) != (b >= 0):
                out.append(p + (q - p) * (a / (a - b)))
        ring = np.array(out).reshape(-1, 2)
    return ring


def area(ring: np.ndarray) -> float:
    if len(ring) < 3:
        return 0.0
    x, y = ring[:, 0], ring[:, 1]
    return float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2


def cell_fractions(shapes: DataFrame, size: float = 0.25) -> DataFrame:
    """code, y, x, fraction: each cell's area within the shape, over that of the fullest cell. Rings: counter-clockwise shells, clockwise holes.

    Areas are added up by signed edges: cut at the cells' lines, each piece gives its cell the area between it and the cell's western line, and
    every cell to the west of it in its row the whole width. A running sum along the row gives both, and the cells between two that
    hold edges; the window's group is one row of one shape's cells. All of it is DataFrame expressions."""
    pieces = cut_at_lines(edges(shapes, ["code"]), size, 0.5).withColumns({"_ix": cell_of("x", size, 0.5) + 1, "_iy": cell_of("y", size, 0.5) + 1})
    rise = F.col("m") * (F.col("y2") - F.col("y1"))
    own = rise * ((F.col("x1") + F.col("x2")) / 2 - (F.col("_ix") - 0.5) * size)
    sums = pieces.groupBy("code", "_iy", "_ix").agg(F.sum(own).alias("_own"), (F.sum(rise) * size).alias("_all"))
    row = Window.partitionBy("code", "_iy").orderBy(F.desc("_ix"))
    east = F.sum("_all").over(row.rowsBetween(Window.unboundedPreceding, 0))
    lined = sums.select("code", "_iy", "_ix", (F.col("_own") + east - F.col("_all")).alias("_a"), east.alias("_east"), F.lead("_ix").over(row).alias("_next"))
    least = 1e-9 * size * size
    gap = F.when((F.col("_east") > least) & (F.col("_ix") - F.col("_next") > 1), F.sequence(F.col("_next") + 1, F.col("_ix") - 1)).otherwise(F.array().cast("array<bigint>"))
    cells = F.concat(F.array(F.struct(F.col("_ix").alias("ix"), F.col("_a").alias("a"))), F.transform(gap, lambda i: F.struct(i.alias("ix"), F.col("_east").alias("a"))))
    found = lined.select("code", "_iy", F.explode(cells).alias("c")).select("code", "_iy", "c.ix", "c.a").filter(F.col("a") > least)
    most = found.groupBy("code").agg(F.max("a").alias("_most"))
    share = finite(F.col("a") / F.col("_most"))
    return found.join(most, "code").select("code", (F.col("_iy") * size).cast(LABEL).alias("y"), (F.col("ix") * size).cast(LABEL).alias("x"), share.alias("fraction"))


def clip_shapes(shapes: DataFrame, boxes: DataFrame) -> DataFrame:
    """Shapes cut to their box, for those that have one: without far islands. boxes: code, west, south, east, north."""
    joined = shapes.join(bounded(boxes), "code", "left")
    schema = "code string, rings array<array<struct<x:double,y:double>>>"

    def cut(batches):
        for pdf in batches:
            out = []
            for code, rings, *edges in zip(pdf["code"], pdf["rings"], pdf["west"], pdf["south"], pdf["east"], pdf["north"]):
                own = [np.array([(p["x"], p["y"]) for p in r], float) for r in rings]
                if not pd.isna(edges[0]):
                    own = [c for r in own if len(c := clip(r, *edges)) >= 3]
                out.append((code, [[{"x": float(x), "y": float(y)} for x, y in r] for r in own]))
            yield pd.DataFrame(out, columns=["code", "rings"])

    return joined.select("code", "rings", "west", "south", "east", "north").mapInPandas(cut, schema)


#: Code, west, south, east, north of the main land of countries with far islands.
MAINLANDS = [
    ("CL", -80.0, -60.0, -60.0, 0.0),
    ("ES", -10.0, 35.0, 5.0, 45.0),
    ("FR", -5.0, 40.0, 10.0, 55.0),
    ("NL", 0.0, 50.0, 10.0, 55.0),
    ("NO", 0.0, 55.0, 35.0, 73.0),
    ("NZ", 165.0, -50.0, 180.0, -30.0),
    ("PT", -10.0, 35.0, 0.0, 45.0),
]


def without_islands(shapes: DataFrame) -> DataFrame:
    """Shapes of countries with far islands cut to their main land; the others stay."""
    return clip_shapes(shapes, shapes.sparkSession.createDataFrame(MAINLANDS, "code string, west double, south double, east double, north double"))


def dissolve(shapes: DataFrame, by: str) -> DataFrame:
    """One shape for each value of `by`: the rings of all, which do not overlap."""
    return shapes.groupBy(F.col(by).alias("code")).agg(F.flatten(F.collect_list("rings")).alias("rings"))


def largest(grid: DataFrame, fractions: DataFrame, k: int, value: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    """Each shape's k cells of the largest value, with rank; of equal values the northern, then the eastern cell first."""
    inside = grid.join(fractions.filter("fraction > 0"), ["y", "x"])
    order = Window.partitionBy("code", *keys).orderBy(F.col(value).desc(), F.col("y").desc(), F.col("x").desc())
    return inside.filter(F.col(value).isNotNull()).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def shape_lookup(records: DataFrame, wanted: DataFrame, code_columns: Sequence[str], name_columns: Sequence[str]) -> DataFrame:
    """wanted(code, name) with the record of the best match: by code columns in order, else by name columns. One row per wanted code."""
    ways = [(k, c, "code") for k, c in enumerate(code_columns)] + [(len(code_columns) + k, c, "name") for k, c in enumerate(name_columns)]
    entered = records.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("way"), F.lit(w).alias("by"), F.col(c).alias("key")) for k, c, w in ways])).alias("_m"))
    asked = wanted.select("code", "name", F.explode(F.array(F.struct(F.lit("code").alias("by"), F.col("code").alias("key")), F.struct(F.lit("name").alias("by"), F.col("name").alias("key")))).alias("_w"))
    met = asked.withColumnsRenamed({"code": "_code", "name": "_name"}).join(entered, (F.col("_w.key") == F.col("_m.key")) & (F.col("_w.by") == F.col("_m.by")))
    best = met.withColumn("_n", F.row_number().over(Window.partitionBy("_code").orderBy("_m.way", *code_columns))).filter("_n = 1")
    return best.select(F.col("_code").alias("code"), *[c for c in records.columns if c != "code"])


def preferred(special: DataFrame, standard: DataFrame) -> DataFrame:
    """The special shapes, and the standard ones of all other codes."""
    return special.unionByName(standard.join(special.select("code"), "code", "left_anti"))


def entity_shapes(wanted: DataFrame, standard: DataFrame, special: DataFrame, code_columns: Sequence[str], name_columns: Sequence[str], islands: bool = False) -> DataFrame:
    """code, rings of the wanted(code, name): the special shape of a subdivision that has one, else the standard record's that matches best.

    standard: rings, and columns with codes and names; special: code, rings. islands: whether countries keep their far ones; special shapes
    are as they are. Codes without a shape are no rows."""
    asked = wanted.select("code", "name")
    own = special.select("code", "rings").join(asked.filter(F.col("code").contains("_")).select("code"), "code", "left_semi")
    found = shape_lookup(standard, asked.join(own.select("code"), "code", "left_anti"), code_columns, name_columns).select("code", "rings")
    return preferred(own, found if islands else without_islands(found))
