import struct
import zlib
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import time as T
from gridloom.operators import grid
from gridloom.sources import raster


def tiff(path, a, rows, deflate=False, order="<", tile=None, nodata=b"-1\0"):
    """A one-band TIFF of a, with its north-west corner at (10, 50) and cells of half a degree."""
    kind = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
    height, width = a.shape
    if tile:
        full = np.zeros((-(-height // tile) * tile, -(-width // tile) * tile), a.dtype)
        full[:height, :width] = a
        parts = [full[r : r + tile, c : c + tile] for r in range(0, full.shape[0], tile) for c in range(0, full.shape[1], tile)]
    else:
        parts = [a[r : r + rows] for r in range(0, height, rows)]
    blocks = [p.astype(a.dtype.newbyteorder(order)).tobytes() for p in parts]
    blocks = [zlib.compress(b) for b in blocks] if deflate else blocks
    starts = [8 + sum(map(len, blocks[:k])) for k in range(len(blocks))]
    tags = [(256, "I", [width]), (257, "I", [height]), (258, "H", [a.dtype.itemsize * 8]), (259, "H", [8 if deflate else 1]), (277, "H", [1]), (339, "H", [kind]), (33550, "d", [0.5, 0.5, 0]), (33922, "d", [0, 0, 0, 10, 50, 0])]
    tags += [(322, "I", [tile]), (323, "I", [tile]), (324, "I", starts), (325, "I", [len(b) for b in blocks])] if tile else [(273, "I", starts), (278, "I", [rows]), (279, "I", [len(b) for b in blocks])]
    at = 8 + sum(map(len, blocks))
    body, entries = b"", b""
    for tag, form, values in [*sorted(tags), (42113, "s", [nodata])]:
        raw = nodata if form == "s" else struct.pack(order + form * len(values), *values)
        place = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", at + len(body))
        body += raw if len(raw) > 4 else b""
        entries += struct.pack(order + "HHI", tag, {"I": 4, "H": 3, "d": 12, "s": 2}[form], len(raw) if form == "s" else len(values)) + place
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at + len(body))
    path.write_bytes(head + b"".join(blocks) + body + struct.pack(order + "H", len(tags) + 1) + entries + b"\0" * 4)


def netcdf(path, values, version=1, unlimited=True):
    """values (time, latitude, longitude) as packed shorts beside their coordinates."""
    steps, ny, nx = values.shape
    name = lambda s: struct.pack(">i", len(s)) + s.encode().ljust(-(-len(s) // 4) * 4, b"\0")
    text = lambda n, s: name(n) + struct.pack(">2i", 2, len(s)) + s.encode().ljust(-(-len(s) // 4) * 4, b"\0")
    number = lambda n, v: name(n) + struct.pack(">2id", 6, 1, v)
    fill = name("_FillValue") + struct.pack(">2ihh", 3, 1, -999, 0)
    packed = np.where(np.isnan(values), -999, np.round((np.nan_to_num(values) - 100) / 0.5)).astype(">i2")
    row = lambda b: b.ljust(-(-len(b) // 4) * 4, b"\0")
    lat, lon = np.arange(ny, dtype=">f4")[::-1].tobytes(), np.arange(nx, dtype=">f4").tobytes()
    hours = [struct.pack(">i", 24 * 365 + k) for k in range(steps)]
    dims = [("time", 0 if unlimited else steps), ("latitude", ny), ("longitude", nx)]
    variables = [("latitude", [1], b"", 0, 5, len(lat)), ("longitude", [2], b"", 0, 5, len(lon)), ("time", [0], text("units", "hours since 2023-01-01 00:00:00.0"), 1, 4, 4 if unlimited else 4 * steps)]
    variables.append(("t2m", [0, 1, 2], number("scale_factor", 0.5) + number("add_offset", 100.0) + fill, 3, 3, len(row(packed[0].tobytes())) if unlimited else len(row(packed.tobytes()))))

    def header(begins):
        out = b"CDF" + bytes([version]) + struct.pack(">i", steps if unlimited else 0) + struct.pack(">2i", 10, 3) + b"".join(name(n) + struct.pack(">i", k) for n, k in dims) + struct.pack(">2i", 0, 0) + struct.pack(">2i", 11, 4)
        for (n, ids, attributes, count, kind, size), begin in zip(variables, begins):
            out += name(n) + struct.pack(f">i{len(ids)}i", len(ids), *ids) + struct.pack(">2i", 12 if count else 0, count) + attributes + struct.pack(">2i", kind, size) + struct.pack(">I" if version == 1 else ">Q", begin)
        return out

    first = len(header([0] * 4))
    begins = [first, first + len(lat), first + len(lat) + len(lon), first + len(lat) + len(lon) + (4 if unlimited else 4 * steps)]
    data = b"".join(h + row(p.tobytes()) for h, p in zip(hours, packed)) if unlimited else b"".join(hours) + packed.tobytes()
    path.write_bytes(header(begins) + lat + lon + data)


@pytest.mark.parametrize("how", [{"rows": 3}, {"rows": 3, "deflate": True}, {"rows": 9, "order": ">"}, {"rows": 0, "tile": 4, "deflate": True}])
@pytest.mark.parametrize("dtype", ["f4", "i2", "u1"])
def test_geotiff(spark, tmp_path, monkeypatch, how, dtype):
    a = (np.arange(70).reshape(7, 10) % 50).astype(dtype)
    if dtype != "u1":
        a[2, 3] = -1
    tiff(tmp_path / "a.tif", a, **how, nodata=b"255\0" if dtype == "u1" else b"-1\0")
    spark.dataSource.register(raster.GeoTiffSource)
    df = spark.read.format("geotiff").option("path", str(tmp_path / "a.tif")).option("name", "population").load()
    got = {(r["y"], r["x"]): r["population"] for r in df.collect()}
    assert df.columns == ["y", "x", "population"] and len(got) == 70
    assert all(got[49.75 - i / 2, 10.25 + j / 2] == (None if a[i, j] == -1 and dtype != "u1" else float(a[i, j])) for i in range(7) for j in range(10))


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("unlimited", [True, False])
def test_netcdf(spark, tmp_path, version, unlimited):
    values = 100 + np.arange(5 * 3 * 3).reshape(5, 3, 3) / 2.0
    values[1, 2, 0] = np.nan
    netcdf(tmp_path / "a.nc", values, version, unlimited)
    spark.dataSource.register(raster.NetCdfSource)
    df = spark.read.format("netcdf").option("path", str(tmp_path / "a.nc")).option("variable", "t2m").option("name", "t2m").load()
    got = {(r["ts"], r["y"], r["x"]): r["t2m"] for r in df.collect()}
    assert len(got) == 45
    for k in range(5):
        for i in range(3):
            for j in range(3):
                want = values[k, i, j]
                assert got[datetime(2024, 1, 1, k), 2.0 - i, float(j)] == (None if np.isnan(want) else want)


def test_other_files_are_errors(tmp_path):
    (tmp_path / "a").write_bytes(b"\x89PNG\r\n\x1a\n" + bytes(30))
    for kind in (raster.opened, raster.NetCdf, raster.GeoTiff):
        with pytest.raises(ValueError, match="classic"):
            kind(str(tmp_path / "a"))


def test_hours_of_a_range(spark):
    day = F.lit("2024-03-01").cast("date")
    df = spark.range(1).select(*[T.date_range(day, F.date_add(day, 1), f).alias(f) for f in ("h", "30min", "6h")])
    r = df.first()
    assert [len(r[f]) for f in ("h", "30min", "6h")] == [25, 49, 5] and r["30min"][1] == datetime(2024, 3, 1, 0, 30)


def test_far_islands(spark):
    ring = lambda w, s, e, n: [{"x": float(x), "y": float(y)} for x, y in ((w, s), (e, s), (e, n), (w, n))]
    shapes = spark.createDataFrame([("ES", [ring(-8, 37, 3, 43), ring(-18, 28, -14, 29)]), ("IT", [ring(7, 37, 18, 46)])], "code string, rings array<array<struct<x:double,y:double>>>")
    got = {r["code"]: r["rings"] for r in grid.without_islands(shapes).collect()}
    assert len(got["ES"]) == 1 and len(got["IT"]) == 1 and min(p["x"] for p in got["ES"][0]) == -8.0
