import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import grid, overlay
from gridloom.session import lineage_cut

SCHEMA = "code string, rings " + overlay.RINGS


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def box(w, s, e, n, hole=False):
    corners = [(w, s), (e, s), (e, n), (w, n)]
    return ring(*(corners[::-1] if hole else corners))


def measures(shapes):
    return {r.code: (round(r.area, 6), round(r.border, 6), r.n_rings) for r in overlay.measured(shapes).collect()}


@pytest.fixture(scope="module")
def pairs(spark):
    """code: (left, right) and the area and border of left - right, left & right, left | right."""
    cases = {
        "hole": ([box(0, 0, 10, 10)], [box(2, 2, 5, 5)]),  # the cut is a hole
        "shared edge": ([box(0, 0, 4, 4)], [box(4, 0, 8, 4)]),
        "part of an edge": ([box(0, 0, 4, 4)], [box(4, 1, 8, 3)]),
        "touching corner": ([box(0, 0, 4, 4)], [box(4, 4, 8, 8)]),
        "equal": ([box(1, 1, 3, 3)], [box(1, 1, 3, 3)]),
        "inside, sharing a corner": ([box(0, 0, 6, 6)], [box(0, 0, 3, 3)]),
        "holed": ([box(0, 0, 9, 9), box(3, 3, 6, 6, hole=True)], [box(2, 4, 7, 5)]),
        "apart": ([box(0, 0, 1, 1)], [box(5, 5, 6, 6)]),
        "slanted": ([ring((0, 0), (6, 0), (0, 6))], [box(1, 1, 9, 9)]),
        "negative": ([box(-7, -7, -1, -1)], [box(-3, -3, 2, 2)]),
    }
    left = spark.createDataFrame([(c, v[0]) for c, v in cases.items()], SCHEMA)
    right = spark.createDataFrame([(c, v[1]) for c, v in cases.items()], SCHEMA)
    return left, right


@pytest.mark.parametrize("tile", [16.0, 1.0])
def test_overlays(pairs, tile):
    left, right = pairs
    d, i, u = (measures(overlay.overlay(left, right, how, tile)) for how in ("difference", "intersection", "union"))
    assert d["hole"] == (91, 52, 2) and i["hole"] == (9, 12, 1) and u["hole"] == (100, 40, 1)
    assert d["shared edge"] == (16, 16, 1) and "shared edge" not in i and u["shared edge"] == (32, 24, 1)
    assert u["part of an edge"] == (24, 16 + 8, 1) and d["part of an edge"] == (16, 16, 1)
    assert u["touching corner"] == (32, 32, 2) and d["touching corner"] == (16, 16, 1)  # two rings, not one that crosses itself
    assert "equal" not in d and i["equal"] == u["equal"] == (4, 8, 1)
    assert d["inside, sharing a corner"] == (27, 24, 1)
    assert d["holed"][0] == 70
    assert i["holed"][0] == 2 and u["holed"][0] == 81 - 9 + 3
    assert "apart" not in i and u["apart"] == (2, 8, 2)
    assert i["slanted"] == (8, round(8 + 4 * math.sqrt(2), 6), 1) and d["slanted"][0] == 10
    assert i["negative"] == (4, 8, 1) and d["negative"] == (32, 24, 1)


def test_straight_points_of_tiles_are_dropped(pairs):
    """Rings made over many tiles have no points but corners."""
    left, right = pairs
    rows = {r.code: r.rings for r in overlay.overlay(left, right, "difference", 0.5).collect()}
    assert sorted(map(len, rows["hole"])) == [4, 4] and [len(r) for r in rows["shared edge"]] == [4]


def test_random_polygons_against_clipping(spark):
    """A star-shaped polygon and a rectangle: the intersection by clipping half-planes, the rest by inclusion and exclusion."""
    r = random.Random(4)
    left, right, want = [], [], {}
    for k in range(60):
        angles = sorted(r.uniform(0, 2 * math.pi) for _ in range(r.randint(3, 12)))
        if max(b - a for a, b in zip(angles, [*angles[1:], angles[0] + 2 * math.pi])) > 3:
            continue
        star = [(round(5 + d * math.cos(a), 6), round(5 + d * math.sin(a), 6)) for a in angles for d in [r.uniform(0.5, 6)]]
        w, s = r.uniform(-1, 6), r.uniform(-1, 6)
        e, n = w + r.uniform(0.5, 6), s + r.uniform(0.5, 6)
        w, s, e, n = (round(v, 6) for v in (w, s, e, n))
        whole, part, cut = grid.area(np.array(star)), grid.area(grid.clip(np.array(star), w, s, e, n)), (e - w) * (n - s)
        left.append((str(k), [ring(*star)]))
        right.append((str(k), [box(w, s, e, n)]))
        want[str(k)] = (whole - part, part, whole + cut - part, whole + cut - 2 * part)
    a, b = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    for j, how in enumerate(("difference", "intersection", "union", "symmetric")):
        got = measures(overlay.overlay(a, b, how, 4.0))
        assert len(want) > 20
        for code, areas in want.items():
            assert got.get(code, (0.0,))[0] == pytest.approx(areas[j], abs=1e-5), (code, how)


def test_a_full_tile_is_split(spark, monkeypatch):
    monkeypatch.setattr(overlay, "MOST", 20)
    cells = [("n" if (x + y) % 3 else "m", [box(x / 8, y / 8, (x + 1) / 8, (y + 1) / 8)]) for x in range(12) for y in range(12)]
    shapes = spark.createDataFrame(cells, SCHEMA)
    lines = overlay.edges(shapes, ["code"])
    assert overlay.fitting_tile(lines, 8.0, ["code"]) < 1
    got = measures(overlay.dissolve(shapes, "code", 8.0))
    assert got["m"][0] == pytest.approx(48 / 64) and got["n"][0] == pytest.approx(96 / 64) and got["m"][1] == pytest.approx(48 * 4 / 8)


def test_dissolve(spark):
    cells = [("a", [box(x, y, x + 1, y + 1)]) for x in range(5) for y in range(5) if (x, y) != (2, 2)] + [("b", [box(2, 2, 3, 3)]), ("b", [box(2, 2, 2.5, 3)]), ("c", [box(0, 9, 2, 10)]), ("c", [box(1, 9, 3, 10)]), ("d", None), ("e", []), (None, [box(0, 0, 1, 1)]), ("f", [ring((0, 0), (1, 1))])]
    got = measures(overlay.dissolve(spark.createDataFrame(cells, SCHEMA), "code", 4.0))
    assert got == {"a": (24, 24, 2), "b": (1, 4, 1), "c": (3, 8, 1), None: (1, 4, 1)}
    # a border of three points against one of two
    odd = [("g", [ring((0, 0), (4, 0), (4, 4), (0, 4))]), ("g", [ring((4, 0), (8, 0), (8, 4), (4, 4), (4, 3), (4, 1))])]
    assert measures(overlay.dissolve(spark.createDataFrame(odd, SCHEMA), "code"))["g"] == (32, 24, 1)


def test_subdivide_keeps_order(spark):
    shapes = spark.createDataFrame([("A", [box(0, 0, 4, 4)]), ("B", [box(2, 0, 6, 4)]), ("C", [box(5, 0, 9, 4)]), ("edge", [box(0, 0, 9, 2)])], SCHEMA)
    # B has lost what lies in A before it cuts C; then C has what B once had and A has not
    got = measures(overlay.subdivide(shapes, [("cut", "B", "A"), ("cut", "C", "B"), ("keep", "A", "edge")], ["A", "B", "C"]))
    assert got == {"A": (8, 12, 1), "B": (8, 12, 1), "C": (12, 14, 1)}
    both = overlay.subdivide(shapes, [("cut", "B", "A"), ("cut", "C", "B"), ("add", "all", "A"), ("add", "all", "B"), ("add", "all", "C")], ["A", "B", "C", "all"])
    areas = {c: v[0] for c, v in measures(both).items()}
    assert areas["A"] + areas["B"] + areas["C"] == areas["all"] == 36  # none overlap, and none is lost
    with pytest.raises(ValueError):
        overlay.subdivide(shapes, [("slice", "B", "A")], ["A"])
    with pytest.raises(ValueError):
        overlay.dissolve(shapes, "code", 3.0)


def test_cycles_are_followed(spark):
    r = random.Random(2)
    ids = list(range(300))
    r.shuffle(ids)
    cycles = [ids[:1], ids[1:3], ids[3:40], ids[40:]]
    links = [(a, b) for c in cycles for a, b in zip(c, c[1:] + c[:1])]
    rows = overlay.followed(spark.createDataFrame(links, "id long, next long")).collect()
    after = dict(links)
    for c in cycles:
        own = sorted((r for r in rows if r.id in set(c)), key=lambda r: r.place)
        assert {r.ring for r in own} == {min(c)} and own[0].id == min(c)
        assert all(after[a.id] == b.id for a, b in zip(own, own[1:]))


def test_fractions_by_accumulation_equal_clipping(spark):
    """Signed areas along rows of cells against each ring clipped to each cell."""
    r = random.Random(6)
    shapes, size = [], 0.5
    for k in range(12):
        angles = sorted(r.uniform(0, 2 * math.pi) for _ in range(9))
        shapes.append((str(k), [ring(*[(round(d * math.cos(a), 5), round(d * math.sin(a), 5)) for a in angles for d in [r.uniform(1, 5)]])]))
    shapes.append(("hole", [box(-3.1, -3.2, 3.3, 3.4), box(-1.6, -1.7, 1.8, 1.9, hole=True)]))
    shapes.append(("aligned", [box(-0.75, -0.25, 1.25, 0.75)]))
    got = {(c, float(y), float(x)): f for c, y, x, f in grid.cell_fractions(spark.createDataFrame(shapes, SCHEMA), size).collect()}
    want = {}
    for code, rings in shapes:
        own = [np.array([(p["x"], p["y"]) for p in q]) for q in rings]
        for iy in range(-12, 13):
            for ix in range(-12, 13):
                a = sum(grid.area(grid.clip(q, (ix - 0.5) * size, (iy - 0.5) * size, (ix + 0.5) * size, (iy + 0.5) * size)) for q in own)
                if a > 1e-9:
                    want[code, iy * size, ix * size] = a
        most = max(v for k, v in want.items() if k[0] == code)
        want.update({k: v / most for k, v in want.items() if k[0] == code})
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=1e-7) for k, v in want.items())


def test_fractions_need_no_python(spark):
    plan = grid.cell_fractions(spark.createDataFrame([("A", [box(0, 0, 1, 1)])], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "Python" not in plan


def test_lineage_cut(spark):
    df = lineage_cut(spark.range(5).withColumn("x", F.rand()))
    assert sorted(df.collect()) == sorted(df.collect()) and "Scan ExistingRDD" in df._jdf.queryExecution().executedPlan().toString()


def test_queries_gather_no_whole_shape(spark, small):
    """Rings are measured one by one; a shape of millions of them would be one row."""
    from gridloom.plans import catalogue

    for query in ("polygon_overlay", "subdivided"):
        assert "collect_list(ring" not in catalogue.queries()[query](spark, small)._jdf.queryExecution().optimizedPlan().toString()
