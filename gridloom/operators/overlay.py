"""Overlays of shapes: differences, intersections, unions, dissolved borders, and subdivisions cut from each other in a stated order.

A shape is (code, rings): counter-clockwise shells, clockwise holes; a point is inside where the rings wind around it at all. The edges of all
shapes are rows. Equal edges are added up first, so that borders run both ways cancel. The rest is cut at the lines of square tiles, natively, and a
running sum along each row of tiles gives how often each shape winds around a tile's lower left corner. A tile's pieces are then one small task:
they are split where they meet, each part's sides are told by counting, and parts with the result on one side only are its border, linked to
chains within the tile. Chains that reach a tile's edge are paired there by angle and put together to rings by pointer doubling. No
task holds a shape: only a ring of the result is one row.

Coordinates are taken to ten decimals, so slanted edges may move by half a unit of the tenth. Rings of less than three points add nothing. Null or empty
rings are none; results without area are no rows.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.session import lineage_cut

DIGITS = 10
EPS = 1e-9
#: Edges that a tile may hold before smaller tiles are taken, and the smallest tile.
MOST, LEAST_TILE = 2000, 2.0**-9
#: Numbers in one block of comparisons within a tile.
BLOCK = 4_000_000
RINGS = "array<array<struct<x:double,y:double>>>"
Step = tuple[str, str, str]


def edges(shapes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, x1, y1, x2, y2, m: the shapes' edges from the lesser end (by x, then y) to the greater; m: how many run so, less those that run back.

    Of a border that runs both ways nothing is left."""
    rings = shapes.select(*keys, F.explode("rings").alias("_ring")).filter(F.size("_ring") > 2)
    after = F.concat(F.slice("_ring", 2, F.size("_ring") - 1), F.slice("_ring", 1, 1))
    pairs = rings.select(*keys, F.explode(F.arrays_zip(F.col("_ring").alias("a"), after.alias("b"))).alias("_e"))
    at = lambda end, c: F.round(F.col(f"_e.{end}.{c}").cast("double"), DIGITS)
    points = pairs.select(*keys, F.struct(at("a", "x").alias("x"), at("a", "y").alias("y")).alias("a"), F.struct(at("b", "x").alias("x"), at("b", "y").alias("y")).alias("b"))
    there = F.col("a") < F.col("b")
    one = points.filter(F.col("a") != F.col("b")).select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(there, 1).otherwise(-1).alias("m"))
    net = one.groupBy(*keys, F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), F.col("b.x").alias("x2"), F.col("b.y").alias("y2")).agg(F.sum("m").alias("m"))
    return net.filter("m != 0")


def cut_at_lines(lines: DataFrame, size: float, offset: float = 0.0) -> DataFrame:
    """lines(x1, y1, x2, y2, ...) cut where they cross the lines of a grid at (k + offset) * size; c1, c2: whether an end is such a cut."""

    def cuts(u: str, v: str, along_x: bool) -> Column:
        a, b = F.col(f"{u}1"), F.col(f"{u}2")
        lo, hi = F.ceil(F.least(a, b) / size - offset), F.floor(F.greatest(a, b) / size - offset)
        numbers = F.when((a != b) & (lo <= hi), F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))

        def point(k: Column) -> Column:
            line = (k + offset) * size
            t = (line - a) / (b - a)
            other = F.round(F.col(f"{v}1") + t * (F.col(f"{v}2") - F.col(f"{v}1")), DIGITS)
            x, y = (line, other) if along_x else (other, line)
            return F.struct(t.alias("t"), x.alias("x"), y.alias("y"))

        return F.filter(F.transform(numbers, point), lambda p: (p["t"] > 0) & (p["t"] < 1))

    end = lambda t, i: F.array(F.struct(F.lit(t).alias("t"), F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")))
    points = F.array_sort(F.concat(end(0.0, 1), cuts("x", "y", True), cuts("y", "x", False), end(1.0, 2)))
    kept = [c for c in lines.columns if c not in ("x1", "y1", "x2", "y2")]
    listed = lines.select(*kept, points.alias("_p"))
    pieces = listed.select(*kept, F.explode(F.arrays_zip(F.slice("_p", 1, F.size("_p") - 1).alias("a"), F.slice("_p", 2, F.size("_p") - 1).alias("b"))).alias("_s"))
    out = pieces.select(*kept, *[F.col(f"_s.{e}.{c}").alias(f"{c}{i}") for e, i in (("a", 1), ("b", 2)) for c in "xy"], *[((F.col(f"_s.{e}.t") > 0) & (F.col(f"_s.{e}.t") < 1)).alias(f"c{i}") for e, i in (("a", 1), ("b", 2))])
    return out.filter((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))


def cell_of(c: str, size: float, offset: float = 0.0) -> Column:
    """The number of the cell that holds a piece's middle."""
    return F.floor((F.col(f"{c}1") + F.col(f"{c}2")) / (2 * size) - offset)


def fitting_tile(lines: DataFrame, tile: float, keys: Sequence[str]) -> float:
    """tile, halved until no tile holds the middle of more than MOST edges, or the tile is the smallest."""
    while tile > LEAST_TILE:
        most = lines.groupBy(*keys, cell_of("x", tile).alias("_tx"), cell_of("y", tile).alias("_ty")).count().agg(F.max("count")).first()[0] or 0
        if most <= MOST:
            break
        tile = max(LEAST_TILE, tile / 2 ** math.ceil(math.log2(most / MOST) / 2))
    return tile


# ---------------------------------------------------------------- within a tile


def _split(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parts, index of the piece of each, points that are no cut) of pieces (x1, y1, x2, y2) split wherever they meet or touch."""
    n = len(p)
    lo, hi = np.minimum(p[:, :2], p[:, 2:]) - EPS, np.maximum(p[:, :2], p[:, 2:]) + EPS
    more_of, more_at = [], []
    rows = max(1, BLOCK // n)
    for i in range(0, n, rows):
        meet = (lo[i : i + rows, None, 0] <= hi[None, :, 0]) & (hi[i : i + rows, None, 0] >= lo[None, :, 0]) & (lo[i : i + rows, None, 1] <= hi[None, :, 1]) & (hi[i : i + rows, None, 1] >= lo[None, :, 1])
        a, b = np.nonzero(meet)
        a += i
        a, b = a[a != b], b[a != b]
        start, along = p[a, :2], p[a, 2:] - p[a, :2]
        long = np.hypot(along[:, 0], along[:, 1])
        for end in (p[b, :2], p[b, 2:]):  # an end of b on a
            way = end - start
            off = np.abs(way[:, 0] * along[:, 1] - way[:, 1] * along[:, 0]) / long
            far = (way * along).sum(1) / long
            on = (off <= EPS) & (far > EPS) & (far < long - EPS)
            more_of.append(a[on])
            more_at.append(end[on])
        other = p[b, 2:] - p[b, :2]
        way = p[b, :2] - start
        cross = along[:, 0] * other[:, 1] - along[:, 1] * other[:, 0]
        short = np.hypot(other[:, 0], other[:, 1])
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (way[:, 0] * other[:, 1] - way[:, 1] * other[:, 0]) / cross
            u = (way[:, 0] * along[:, 1] - way[:, 1] * along[:, 0]) / cross
        inner = (a < b) & (np.abs(cross) > 1e-12 * long * short) & (t * long > EPS) & ((1 - t) * long > EPS) & (u * short > EPS) & ((1 - u) * short > EPS)
        met = np.round(start[inner] + t[inner, None] * along[inner], DIGITS)
        more_of += [a[inner], b[inner]]
        more_at += [met, met]
    of, at = np.concatenate(more_of), np.concatenate(more_at)
    every = np.concatenate([np.arange(n), np.arange(n), of])
    points = np.concatenate([p[:, :2], p[:, 2:], at])
    along = p[:, 2:] - p[:, :2]
    place = ((points - p[every, :2]) * along[every]).sum(1)
    order = np.lexsort((place, every))
    every, points = every[order], points[order]
    same = every[1:] == every[:-1]
    parts = np.concatenate([points[:-1], points[1:]], axis=1)[same]
    piece = every[:-1][same]
    real = (parts[:, :2] != parts[:, 2:]).any(1)
    return parts[real], piece[real], at


def _sides(part: np.ndarray, net: np.ndarray, base: np.ndarray, west: float, south: float) -> tuple[np.ndarray, np.ndarray]:
    """(left, right): how often each layer winds around the two sides of each part, by a ray to the tile's west line and down along it."""
    x1, y1, x2, y2 = part.T
    rise = np.sign(y2 - y1)
    xm, ym = (x1 + x2) / 2, (y1 + y2) / 2
    low, high = np.minimum(y1, y2), np.maximum(y1, y2)
    slope = np.where(rise != 0, (x2 - x1) / np.where(rise != 0, y2 - y1, 1), 0)
    beside = np.empty(net.shape)
    passed = -net * rise[:, None]
    for i in range(0, len(part), rows := max(1, BLOCK // len(part))):
        y = ym[i : i + rows, None]
        crossed = (low <= y) & (y < high) & (x1 + (y - y1) * slope < xm[i : i + rows, None])
        own = np.arange(i, min(i + rows, len(part)))
        crossed[own - i, own] = False
        in_ = (x1 == west) & (south < y1) & (y1 <= y)
        out = (x2 == west) & (south < y2) & (y2 <= y)
        beside[i : i + rows] = crossed @ passed + (in_.astype(float) - out) @ net
    beside += base
    # west of a rising or falling part, above a level one
    west_is_left = (rise >= 0)[:, None]
    return np.where(west_is_left, beside, beside + net), np.where(west_is_left, beside - net, beside)


def _pair(ends: list[tuple[float, bool, int]]) -> dict[int, int]:
    """At a point: for each border that comes in, the one that goes out next to it clockwise. ends: (angle as seen from the point, goes out, border)."""
    ends = sorted(ends)
    last = next((e for _, out, e in reversed(ends) if out), None)
    paired = {}
    for _, out, e in ends:
        if out:
            last = e
        else:
            paired[e] = last
    return paired


def _chains(border: np.ndarray, inner: dict[tuple[float, float], bool]) -> list[tuple[bool, list[tuple[float, float]]]]:
    """(closed, points) of directed borders linked at points for which inner is true."""
    start, end = [tuple(b[:2]) for b in border.tolist()], [tuple(b[2:]) for b in border.tolist()]
    here: dict[tuple[float, float], list[tuple[float, bool, int]]] = defaultdict(list)
    for k, (a, b) in enumerate(zip(start, end)):
        if inner[a]:
            here[a].append((math.atan2(b[1] - a[1], b[0] - a[0]), True, k))
        if inner[b]:
            here[b].append((math.atan2(a[1] - b[1], a[0] - b[0]), False, k))
    after: dict[int, int] = {}
    for own in here.values():
        after.update(_pair(own))
    seen = [False] * len(start)
    out = []
    for k in [k for k, a in enumerate(start) if not inner[a]] + list(range(len(start))):
        if seen[k]:
            continue
        points, first = [], k
        while k is not None and not seen[k]:
            seen[k] = True
            points.append(start[k])
            last, k = k, after.get(k)
        closed = k == first
        out.append((closed, points if closed else [*points, end[last]]))
    return out


CHAINS = "closed boolean, points array<struct<x:double,y:double>>, real boolean, real_end boolean, leaves double, comes double"


def _tile_chains(pdf: pd.DataFrame, size: float, steps: Sequence[Step], wanted: Sequence[str]) -> list[tuple]:
    """layer and CHAINS of the wanted results' borders in one tile."""
    layers = sorted(set(pdf["layer"]))
    number = {c: k for k, c in enumerate(layers)}
    tx, ty = float(pdf["tx"].iat[0]), float(pdf["ty"].iat[0])
    west, south = tx * size, ty * size
    corner, own = pdf[pdf["m"].isna()], pdf[pdf["m"].notna()]
    base = np.zeros(len(layers))
    for c, w in zip(corner["layer"], corner["w"]):
        base[number[c]] += w
    ends = own[["x1", "y1", "x2", "y2"]].to_numpy(float)
    part, piece, met = _split(ends)
    turned = (part[:, 0] > part[:, 2]) | ((part[:, 0] == part[:, 2]) & (part[:, 1] > part[:, 3]))
    part[turned] = part[turned][:, [2, 3, 0, 1]]
    part, which = np.unique(part, axis=0, return_inverse=True)
    net = np.zeros((len(part), len(layers)))
    weight = own["m"].to_numpy(float)[piece] * np.where(turned, -1, 1)
    np.add.at(net, (which.reshape(-1), own["layer"].map(number).to_numpy()[piece]), weight)
    left_right = {}
    some = (net != 0).any(1)
    part, net = part[some], net[some]
    if not len(part):
        return []
    for side, wound in zip(("left", "right"), _sides(part, net, base, west, south)):
        inside = defaultdict(lambda: np.zeros(len(part), bool), {c: wound[:, k] != 0 for c, k in number.items()})
        for op, target, other in steps:
            if op == "cut":
                inside[target] = inside[target] & ~inside[other]
            elif op == "keep":
                inside[target] = inside[target] & inside[other]
            elif op == "add":
                inside[target] = inside[target] | inside[other]
            else:
                inside[target] = inside[target] ^ inside[other]
        left_right[side] = inside
    corners = {tuple(q) for q in met.tolist()}
    for c, x, y in (("c1", "x1", "y1"), ("c2", "x2", "y2")):
        corners |= set(zip(own.loc[~own[c].astype(bool), x], own.loc[~own[c].astype(bool), y]))
    out = []
    for layer in wanted:
        a, b = left_right["left"][layer], left_right["right"][layer]
        border = np.concatenate([part[a & ~b], part[b & ~a][:, [2, 3, 0, 1]]])
        if not len(border):
            continue
        inner = {q: q[0] not in (west, west + size) and q[1] not in (south, south + size) for q in {tuple(r) for r in border[:, :2].tolist()} | {tuple(r) for r in border[:, 2:].tolist()}}
        for closed, points in _chains(border, inner):
            (ax, ay), (bx, by), (yx, yy), (zx, zy) = points[0], points[1], points[-2], points[-1]
            out.append((layer, closed, points, points[0] in corners, points[-1] in corners, math.atan2(by - ay, bx - ax), math.atan2(yy - zy, yx - zx)))
    return out


# ---------------------------------------------------------------- all tiles


def arranged(shapes: DataFrame, steps: Sequence[Step], wanted: Sequence[str], tile: float = 8.0) -> DataFrame:
    """`ringed`, with all rings of a key's layer in one row: key, layer, rings."""
    return ringed(shapes, steps, wanted, tile).groupBy("key", "layer").agg(F.sort_array(F.collect_list("ring")).alias("rings"))


def ringed(shapes: DataFrame, steps: Sequence[Step], wanted: Sequence[str], tile: float = 8.0) -> DataFrame:
    """shapes(key, layer, rings) to key, layer, ring of the wanted layers after the steps, which are done in order within each key; a row a ring.

    A step is (op, layer, other): "cut" takes the other from the layer, "keep" leaves what both have, "add" what either has, "differ" what one of
    them has. tile: the size of a tile, a power of two; smaller ones are taken where it would hold too many edges.
    """
    if math.log2(tile) % 1 or tile < LEAST_TILE:
        raise ValueError("a tile's size is a power of two, and no less than the smallest tile")
    unknown = {op for op, *_ in steps} - {"cut", "keep", "add", "differ"}
    if unknown:
        raise ValueError(f"unknown steps: {sorted(unknown)}")
    lines = lineage_cut(edges(shapes.select("key", "layer", "rings"), ["key", "layer"]))
    size = fitting_tile(lines, tile, ["key"])
    # a table of its own, as it is read for the tiles and, thrice, for their corners
    pieces = lineage_cut(cut_at_lines(lines, size).withColumns({"tx": cell_of("x", size), "ty": cell_of("y", size)}))

    # how often a layer winds around a tile's lower left corner: what the row's tiles to the west have on its lower line
    low = F.least("y1", "y2")
    touching = (low == F.col("ty") * size) & (F.col("y1") != F.col("y2"))
    passed = F.sum(F.when(touching, -F.col("m") * F.signum(F.col("y2") - F.col("y1"))).otherwise(0.0)).alias("w")
    events = pieces.groupBy("key", "layer", "ty", "tx").agg(passed)
    asked = events.select("key", "ty", "tx").distinct().join(events.select("key", "ty", "layer").distinct(), ["key", "ty"]).withColumn("w", F.lit(0.0))
    by_tile = events.unionByName(asked).groupBy("key", "layer", "ty", "tx").agg(F.sum("w").alias("w"))
    before = Window.partitionBy("key", "layer", "ty").orderBy("tx").rowsBetween(Window.unboundedPreceding, -1)
    corners = by_tile.withColumn("w", F.coalesce(F.sum("w").over(before), F.lit(0.0))).filter("w != 0")

    rows = pieces.unionByName(corners, allowMissingColumns=True)

    def solve(own: pa.Table) -> pa.Table:
        # rows of Arrow, as pandas would turn each point into a dictionary and back
        found = _tile_chains(own.to_pandas(), size, steps, wanted)
        layer, closed, points, *rest = zip(*found) if found else [()] * 7
        x, y = np.array([q for row in points for q in row], float).reshape(-1, 2).T
        offsets = np.cumsum([0, *map(len, points)])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(x), pa.array(y)], ["x", "y"]))
        key = own["key"].take(pa.array([0] * len(found), pa.int64()))
        flags = [pa.array(v, pa.bool_()) for v in (closed, *rest[:2])]
        return pa.table({"key": key, "layer": pa.array(layer, pa.string()), "closed": flags[0], "points": lists, "real": flags[1], "real_end": flags[2], "leaves": pa.array(rest[2], pa.float64()), "comes": pa.array(rest[3], pa.float64())})

    key_type = dict(shapes.dtypes)["key"]
    chains = rows.groupBy("key", "ty", "tx").applyInArrow(solve, f"key {key_type}, layer string, {CHAINS}")
    return _rings(lineage_cut(chains.withColumn("id", F.monotonically_increasing_id())))


def _rings(chains: DataFrame) -> DataFrame:
    """key, layer, ring: closed chains as they are, the others followed from tile to tile."""
    whole = chains.filter("closed").select("key", "layer", F.col("points").alias("ring"))
    open_ = chains.filter("not closed")
    first, last = F.col("points")[0], F.element_at("points", -1)
    ends = open_.select("key", "layer", first.alias("at"), F.col("leaves").alias("angle"), F.lit(True).alias("out"), "id", "real").unionByName(
        open_.select("key", "layer", last.alias("at"), F.col("comes").alias("angle"), F.lit(False).alias("out"), "id", F.col("real_end").alias("real"))
    )
    here = Window.partitionBy("key", "layer", "at")
    clockwise = here.orderBy("angle").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole_turn = here.orderBy("angle").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    going = F.when(F.col("out"), F.struct("id", "angle", "real"))
    next_ = F.coalesce(F.last(going, ignorenulls=True).over(clockwise), F.last(going, ignorenulls=True).over(whole_turn))
    links = ends.withColumn("next", next_).filter("not out")
    # a point that only the tiles' lines made, and at which the border runs straight on, is none of the result's
    straight = ~F.col("real") & ~F.col("next.real") & (F.abs(F.pmod(F.col("next.angle") - F.col("angle"), F.lit(2 * math.pi)) - math.pi) < 1e-6)
    links = lineage_cut(links.select("id", F.col("next.id").alias("next"), straight.alias("straight")))
    order = followed(links.select("id", "next"))
    skipped = links.select(F.col("next").alias("id"), F.col("straight"))
    parts = open_.join(order, "id").join(skipped, "id")
    own = F.slice("points", F.when(F.col("straight"), 2).otherwise(1), F.size("points") - F.when(F.col("straight"), 2).otherwise(1))
    placed = parts.select("key", "layer", "ring", F.struct("place", own.alias("points")).alias("part"))
    linked = placed.groupBy("key", "layer", "ring").agg(F.flatten(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["points"])).alias("points"))
    return whole.unionByName(linked.select("key", "layer", F.col("points").alias("ring"))).filter(F.size("ring") > 2)


def followed(links: DataFrame) -> DataFrame:
    """links(id, next), closed cycles, to id, ring (the least id of its cycle) and place (steps from that id), by pointer doubling.

    A round joins each id with the one so far on; there are as many rounds as the longest cycle's length has binary digits, and one more.
    """
    state = links.select("id", "next", F.col("id").alias("ring"), F.lit(0).cast("long").alias("ahead"))
    reach = 1
    while True:
        other = state.select(F.col("id").alias("next"), F.col("next").alias("_next"), F.col("ring").alias("_ring"), F.col("ahead").alias("_ahead"))
        nearer = F.col("_ring") < F.col("ring")
        state = lineage_cut(state.join(other, "next").select("id", F.col("_next").alias("next"), F.least("ring", "_ring").alias("ring"), F.when(nearer, F.col("_ahead") + reach).otherwise(F.col("ahead")).alias("ahead"), nearer.alias("moved")))
        reach *= 2
        if state.filter("moved").isEmpty():
            return state.select("id", "ring", F.when(F.col("ahead") == 0, F.lit(-(1 << 62))).otherwise(-F.col("ahead")).alias("place"))


def overlay(left: DataFrame, right: DataFrame, how: str, tile: float = 8.0) -> DataFrame:
    """code, rings of the difference, intersection, union or symmetric difference of each code's left and right shapes; a side may be missing.

    Several rows of a code on one side are one shape. Results without area are no rows."""
    op = {"difference": "cut", "intersection": "keep", "union": "add", "symmetric": "differ"}[how]
    side = lambda df, name: df.select(F.col("code").alias("key"), F.lit(name).alias("layer"), "rings")
    both = side(left, "left").unionByName(side(right, "right"))
    return arranged(both, [(op, "left", "right")], ["left"], tile).select(F.col("key").alias("code"), "rings")


def dissolve(shapes: DataFrame, by: str, tile: float = 8.0) -> DataFrame:
    """code, rings: one shape for each value of `by`, without the borders and overlaps within it."""
    one = shapes.select(F.col(by).alias("key"), F.lit("all").alias("layer"), "rings")
    return arranged(one, [], ["all"], tile).select(F.col("key").alias("code"), "rings")


def subdivide(shapes: DataFrame, steps: Sequence[Step], wanted: Sequence[str], tile: float = 8.0) -> DataFrame:
    """code, rings of the wanted codes after the steps (see `arranged`) on the shapes, which may hold bounds that are only cut with.

    All steps are one plan: a later step sees what the earlier ones have left. Rows of one code are one shape."""
    one = shapes.select(F.lit(0).alias("key"), F.col("code").cast("string").alias("layer"), "rings")
    return arranged(one, steps, wanted, tile).select(F.col("layer").alias("code"), "rings")


def ring_area(ring: Column) -> Column:
    """The signed area of a ring."""
    nexts = F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))
    terms = F.zip_with(ring, nexts, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t) / 2


def ring_length(ring: Column) -> Column:
    nexts = F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))
    return F.aggregate(F.zip_with(ring, nexts, lambda a, b: F.hypot(a["x"] - b["x"], a["y"] - b["y"])), F.lit(0.0), lambda s, t: s + t)


def measured(shapes: DataFrame) -> DataFrame:
    """code, area, border, n_rings of each shape."""
    total = lambda f: F.aggregate(F.transform("rings", f), F.lit(0.0), lambda s, t: s + t)
    return shapes.select("code", total(ring_area).alias("area"), total(ring_length).alias("border"), F.size("rings").cast("long").alias("n_rings"))


def measured_rings(rings: DataFrame, *by: str) -> DataFrame:
    """by, area, border, n_rings of rings(by, ring), of which none but the sums are gathered."""
    return rings.groupBy(*by).agg(F.sum(ring_area(F.col("ring"))).alias("area"), F.sum(ring_length(F.col("ring"))).alias("border"), F.count(F.lit(1)).alias("n_rings"))
