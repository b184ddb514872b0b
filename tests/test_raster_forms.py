"""Rasters as they are published: NetCDF version 4, and TIFF with LZW, predictors, 64-bit offsets; bounds pushed down to blocks and chunks."""

import itertools
import struct
import zlib
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThanOrEqual
from test_raster import netcdf

from gridloom.sources import hdf5, raster

NONE = b"\xff" * 8


class Hdf5Writer:
    """A NetCDF-4 file of variables by time, latitude and longitude. old: headers, groups and attributes of the format's first version, else of its
    second, with the attributes of one variable in a fractal heap."""

    def __init__(self, old: bool, chunk=(2, 2, 3), filters=("shuffle", "deflate")) -> None:
        self.old, self.chunk, self.filters, self.out = old, chunk, filters, bytearray(256)

    def put(self, data: bytes) -> int:
        self.out += bytes(-len(self.out) % 8)
        self.out += data
        return len(self.out) - len(data)

    def type_of(self, dtype):
        if isinstance(dtype, int):  # text of so many bytes
            return struct.pack("<B3sI", 0x13, b"\0\0\0", dtype)
        if dtype == "refs":
            return struct.pack("<B3sI", 0x19, b"\0\0\0", 16) + struct.pack("<B3sI", 0x17, b"\0\0\0", 8)
        d = np.dtype(dtype)
        if d.kind == "f":
            return struct.pack("<B3sIHHBBBBI", 0x11, b"\x20\x1f\0", d.itemsize, 0, d.itemsize * 8, 23, 8, 0, 23, 127)
        return struct.pack("<B3sIHH", 0x10, bytes([8, 0, 0]), d.itemsize, 0, d.itemsize * 8)

    def space(self, shape):
        if self.old:
            return struct.pack("<BBBB4x", 1, len(shape), 0, 0) + b"".join(struct.pack("<Q", n) for n in shape)
        return struct.pack("<BBBB", 2, len(shape), 0, bool(shape)) + b"".join(struct.pack("<Q", n) for n in shape)

    def attribute(self, name, value):
        if isinstance(value, str):
            raw, kind, shape = value.encode(), len(value), ()
        elif isinstance(value, list):  # header addresses of scales
            heap = b"".join(struct.pack("<HHIQQ", k + 1, 1, 0, 8, v) for k, v in enumerate(value)) + struct.pack("<HHIQ", 0, 0, 0, 0)
            at = self.put(b"GCOL" + struct.pack("<B3xQ", 1, 16 + len(heap)) + heap)
            raw, kind, shape = b"".join(struct.pack("<IQI", 1, at, k + 1) for k in range(len(value))), "refs", (len(value),)
        else:
            raw, kind, shape = np.atleast_1d(value).tobytes(), value.dtype, (1,)
        parts = [name.encode() + b"\0", self.type_of(kind), self.space(shape)]
        head = struct.pack("<BBHHH", 1 if self.old else 3, 0, *map(len, parts)) + (b"" if self.old else b"\0")
        return head + b"".join(p + bytes(-len(p) % 8 if self.old else 0) for p in parts) + raw

    def header(self, messages, split=False):
        if self.old:
            body = [struct.pack("<HHB3x", k, len(d) + -len(d) % 8, 0) + d + bytes(-len(d) % 8) for k, d in messages]
            if split:  # the second half in a continuation
                rest = b"".join(body[1:])
                at = self.put(rest)
                body = [body[0], struct.pack("<HHB3xQQ", 16, 16, 0, at, len(rest))]
            whole = b"".join(body)
            return self.put(struct.pack("<BBHII4x", 1, 0, len(messages), 1, len(whole)) + whole)
        body = [struct.pack("<BHB", k, len(d), 0) + d for k, d in messages]
        if split:
            rest = b"OCHK" + b"".join(body[1:]) + bytes(4)
            at = self.put(rest)
            body = [body[0], struct.pack("<BHBQQ", 16, 16, 0, at, len(rest))]
        whole = b"".join(body)
        return self.put(b"OHDR" + struct.pack("<BBI", 2, 2, len(whole)) + whole + bytes(4))

    def dense(self, attributes):
        """The messages of attributes that lie in a fractal heap of several blocks, with a B-tree of two levels."""
        start, wide, bits = 512, 4, 16
        blocks, ids, sizes = [bytearray(b"FHDB" + bytes(1 + 8 + 2))], [], [start, start, start, start, start]
        for a in attributes:
            if len(blocks[-1]) + len(a) > start:
                blocks[-1] += bytes(start - len(blocks[-1]))
                blocks.append(bytearray(b"FHDB" + bytes(1 + 8 + 2)))
            ids.append(struct.pack("<BHH", 0, (len(blocks) - 1) * start + len(blocks[-1]), len(a)) + bytes(3))
            blocks[-1] += a
        assert 1 < len(blocks) <= len(sizes)
        places = [self.put(bytes(b)) for b in blocks]
        root = self.put(b"FHIB" + bytes(1 + 8 + 2) + b"".join(struct.pack("<Q", p) for p in places) + NONE * (2 * wide - len(places)))
        heap = self.put(b"FRHP" + struct.pack("<BHHBI", 0, 8, 0, 0, 4096) + bytes(8) + NONE + bytes(8) + NONE + bytes(64) + struct.pack("<HQQHHQH", wide, start, 4096, bits, 1, root, 2) + bytes(4))
        records = [i + struct.pack("<BII", 0, k, 0) for k, i in enumerate(ids)]
        half, node = len(records) // 2, 512
        leaf = lambda part: self.put((b"BTLF" + bytes([0, 8]) + b"".join(part)).ljust(node, b"\0"))
        a, b = leaf(records[:half]), leaf(records[half + 1 :])
        top = self.put((b"BTIN" + bytes([0, 8]) + records[half] + struct.pack("<QBQB", a, half, b, len(records) - half - 1)).ljust(node, b"\0"))
        tree = self.put(b"BTHD" + struct.pack("<BBIHHBBQHQ", 0, 8, node, 17, 1, 98, 40, top, 1, len(records)) + bytes(4))
        return [(21, struct.pack("<BBQQ", 0, 0, heap, tree))]

    def dataset(self, values, attributes, chunked=False, dense=False, fill=None):
        messages = [(1, self.space(values.shape)), (3, self.type_of(values.dtype))]
        if fill is not None:
            raw = np.array(fill, values.dtype).tobytes()
            messages.append((5, struct.pack("<BBBBI", 2, 2, 2, 1, len(raw)) + raw if self.old else struct.pack("<BBI", 3, 0x29, len(raw)) + raw))
        if chunked:
            keys, rank = [], values.ndim
            for start in itertools.product(*(range(0, n, c) for n, c in zip(values.shape, self.chunk))):
                part = values[tuple(slice(s, s + c) for s, c in zip(start, self.chunk))]
                if fill is not None and (part == fill).all():
                    continue  # never written
                whole = np.zeros(self.chunk, values.dtype)
                whole[tuple(slice(0, n) for n in part.shape)] = part
                data, mask = whole.tobytes(), 0
                for k, f in enumerate(self.filters):
                    if f == "shuffle":
                        data = np.frombuffer(data, np.uint8).reshape(-1, values.itemsize).T.tobytes()
                    elif f == "deflate" and start[0]:
                        data = zlib.compress(data)
                    elif f == "deflate":
                        mask |= 1 << k  # left out for some chunks
                    else:
                        data += b"sum!"
                keys.append((struct.pack("<II", len(data), mask) + b"".join(struct.pack("<Q", s) for s in (*start, 0)), self.put(data)))
            key = 8 + 8 * (rank + 1)

            def node(level, entries):
                return self.put(b"TREE" + struct.pack("<BBH", 1, level, len(entries)) + NONE * 2 + b"".join(k + struct.pack("<Q", c) for k, c in entries) + bytes(key))

            leaves = [(keys[i][0], node(0, keys[i : i + 4])) for i in range(0, len(keys), 4)]
            messages.append((8, struct.pack("<BBBQ", 3, 2, rank + 1, node(1, leaves)) + b"".join(struct.pack("<I", c) for c in (*self.chunk, values.itemsize))))
            number = {"deflate": 1, "shuffle": 2, "fletcher32": 3}
            client = {"deflate": [4], "shuffle": [values.itemsize], "fletcher32": []}
            if self.old:
                body = b"".join(struct.pack("<HHHH", number[f], 8, 1, len(client[f])) + f[:7].encode().ljust(8, b"\0") + b"".join(struct.pack("<I", c) for c in client[f]) + bytes(4 * (len(client[f]) % 2)) for f in self.filters)
                messages.append((11, struct.pack("<BB6x", 1, len(self.filters)) + body))
            else:
                body = b"".join(struct.pack("<HHH", number[f], 1, len(client[f])) + b"".join(struct.pack("<I", c) for c in client[f]) for f in self.filters)
                messages.append((11, struct.pack("<BB", 2, len(self.filters)) + body))
        else:
            messages.append((8, struct.pack("<BBQQ", 3, 1, self.put(values.tobytes()), values.nbytes)))
        own = [self.attribute(n, v) for n, v in attributes.items()]
        messages += self.dense(own) if dense else [(12, a) for a in own]
        return self.header(messages, split=True)

    def write(self, path, values):
        steps, ny, nx = values.shape
        fill = -999
        packed = np.where(np.isnan(values), fill, np.round((np.nan_to_num(values) - 100) / 0.5)).astype("<i2")
        scale = {"CLASS": "DIMENSION_SCALE"}
        made = {
            "time": self.dataset((24 * 365 + np.arange(steps)).astype("<i8"), scale | {"units": "hours since 2023-01-01 00:00:00.0"}),
            "latitude": self.dataset(np.arange(ny, dtype="<f4")[::-1].copy(), scale),
            "longitude": self.dataset(np.arange(nx, dtype="<f4"), scale),
        }
        own = {"DIMENSION_LIST": [made[n] for n in ("time", "latitude", "longitude")], "scale_factor": np.array(0.5, "<f4"), "add_offset": np.array(100, "<f4"), "_FillValue": np.array(fill, "<i2")}
        own |= {f"note_{k}": "of no use " * 8 for k in range(12)}
        made["t2m"] = self.dataset(packed, own, chunked=True, dense=not self.old, fill=fill)
        if self.old:
            heap, entries = bytearray(8), b""
            for name, at in sorted(made.items()):
                entries += struct.pack("<QQ", len(heap), at) + bytes(24)
                heap += name.encode() + bytes(8 - len(name) % 8)
            names = self.put(bytes(heap))
            held = self.put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(heap), 0, names))
            node = self.put(b"SNOD" + struct.pack("<BBH", 1, 0, len(made)) + entries)
            tree = self.put(b"TREE" + struct.pack("<BBH", 0, 0, 1) + NONE * 2 + struct.pack("<QQQ", 0, node, 0))
            root = self.header([(17, struct.pack("<QQ", tree, held))])
            head = hdf5.MAGIC + struct.pack("<BBBBBBBBHHIQQQQ", 0, 0, 0, 0, 0, 8, 8, 0, 4, 16, 0, 0, (1 << 64) - 1, len(self.out), (1 << 64) - 1) + struct.pack("<QQ", 0, root)
        else:
            root = self.header([(2, struct.pack("<BBQQ", 0, 0, (1 << 64) - 1, (1 << 64) - 1)), *[(6, struct.pack("<BBB", 1, 0, len(n)) + n.encode() + struct.pack("<Q", at)) for n, at in made.items()]])
            head = hdf5.MAGIC + struct.pack("<BBBBQQQQ", 2, 8, 8, 0, 0, (1 << 64) - 1, len(self.out), root)
        self.out[: len(head)] = head
        path.write_bytes(bytes(self.out))


def grid_of(steps=5, ny=5, nx=7):
    values = 100 + np.arange(steps * ny * nx).reshape(steps, ny, nx) / 2.0
    values[1, 2, 0] = np.nan
    values[2:4, 0:2, 0:3] = np.nan  # a chunk that was never written
    return values


def load(spark, path, fmt="netcdf", **options):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (raster.NetCdfSource, raster.GeoTiffSource):
        spark.dataSource.register(source)
    return spark.read.format(fmt).option("path", str(path)).options(**options).load()


@pytest.mark.parametrize("old", [True, False])
@pytest.mark.parametrize("filters", [("shuffle", "deflate"), ("deflate", "fletcher32"), ()])
def test_version_4_equals_its_classic_twin(spark, tmp_path, old, filters):
    values = grid_of()
    Hdf5Writer(old, filters=filters).write(tmp_path / "four.nc", values)
    netcdf(tmp_path / "three.nc", values)
    four, three = (sorted(map(str, load(spark, tmp_path / f, variable="t2m", name="t2m").collect())) for f in ("four.nc", "three.nc"))
    assert len(four) == values.size and four == three
    own = hdf5.Hdf5(str(tmp_path / "four.nc")).variables["t2m"]
    assert own["dims"] == ["time", "latitude", "longitude"] and own["attributes"]["note_11"].startswith("of no use") and own["chunk"] == (2, 2, 3)


@pytest.mark.parametrize("form", ["three", "four"])
def test_bounds_reach_the_chunks(spark, tmp_path, monkeypatch, form):
    values, path = grid_of(), tmp_path / "a.nc"
    Hdf5Writer(False).write(path, values) if form == "four" else netcdf(path, values)
    monkeypatch.setattr(raster, "CELLS", 1)
    whole = load(spark, path, variable="t2m")
    some = whole.filter("ts >= timestamp_ntz'2024-01-01 03:00:00' and x between 3 and 4.5 and y = 1")
    assert sorted(map(str, some.collect())) == sorted(str(r) for r in whole.collect() if r.ts >= datetime(2024, 1, 1, 3) and 3 <= r.x <= 4.5 and r.y == 1) and some.count() == 4
    assert whole.filter("y > 90").count() == 0

    def parts(*filters):
        reader = raster._NetCdfReader({"path": str(path), "variable": "t2m"})
        assert list(reader.pushFilters(list(filters))) == list(filters)
        return [p.value[1] for p in reader.partitions()]

    late = GreaterThanOrEqual(("ts",), datetime(2024, 1, 1, 3))
    assert parts() == ([[0, 1], [2, 3], [4]] if form == "four" else [[0], [1], [2], [3], [4]])
    assert parts(late) == [[3], [4]] and parts(late, LessThanOrEqual(("ts",), datetime(2024, 1, 1, 3))) == [[3]] and parts(EqualTo(("y",), 90.0)) == []
    if form == "four":
        f, read = hdf5.Hdf5(str(path)), []
        unpack = hdf5.Hdf5._unpack
        monkeypatch.setattr(hdf5.Hdf5, "_unpack", lambda self, v, data, mask: read.append(1) or unpack(self, v, data, mask))
        got = list(f.steps("t2m", [2, 3], np.array([3]), np.array([3, 4])))
        assert len(read) == 1 and np.allclose([g[1] for g in got], values[2:4, 3:4, 3:5])


def lzw(data: bytes) -> bytes:
    """TIFF's LZW, by its definition."""
    table, codes, before, width = {}, [(256, 9)], b"", 9

    def clear():
        table.clear()
        table.update({bytes([i]): i for i in range(256)})

    clear()
    for byte in data:
        now = before + bytes([byte])
        if now in table:
            before = now
            continue
        codes.append((table[before], width))
        table[now] = len(table) + 2
        if len(table) + 2 in (512, 1024, 2048):  # the reader knows one entry less, and widens at 511
            width += 1
        if len(table) + 2 == 4094:
            codes.append((256, 12))
            clear()
            width = 9
        before = bytes([byte])
    codes += [(table[before], width)] if before else []
    codes.append((257, width))
    bits = "".join(f"{c:0{w}b}" for c, w in codes)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


def tiff(path, a, tile=4, packed=1, predictor=1, big=False, order="<"):
    kind = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
    full = np.zeros((-(-a.shape[0] // tile) * tile, -(-a.shape[1] // tile) * tile), a.dtype)
    full[: a.shape[0], : a.shape[1]] = a
    blocks = []
    for r in range(0, full.shape[0], tile):
        for c in range(0, full.shape[1], tile):
            p = full[r : r + tile, c : c + tile]
            if predictor == 2:
                p = np.concatenate([p[:, :1], np.diff(p, axis=1)], axis=1).astype(a.dtype)
            raw = p.astype(a.dtype.newbyteorder(order)).tobytes()
            if predictor == 3:
                planes = p.astype(a.dtype.newbyteorder(">")).view(np.uint8).reshape(tile, tile, a.itemsize).transpose(0, 2, 1).reshape(tile, -1)
                raw = np.concatenate([planes[:, :1], np.diff(planes, axis=1)], axis=1).astype(np.uint8).tobytes()
            blocks.append({1: bytes, 5: lzw, 8: zlib.compress}[packed](raw))
    base = 16 if big else 8
    starts = [base + sum(map(len, blocks[:k])) for k in range(len(blocks))]
    many = "Q" if big else "I"
    tags = [(256, "I", [a.shape[1]]), (257, "I", [a.shape[0]]), (258, "H", [a.itemsize * 8]), (259, "H", [packed]), (277, "H", [1]), (317, "H", [predictor]), (322, "I", [tile]), (323, "I", [tile]), (324, many, starts), (325, many, [len(b) for b in blocks]), (339, "H", [kind]), (33550, "d", [0.5, 0.5, 0]), (33922, "d", [0, 0, 0, 10, 50, 0])]
    at, body, entries, room = base + sum(map(len, blocks)), b"", b"", 8 if big else 4
    for tag, form, values in tags:
        raw = struct.pack(order + form * len(values), *values)
        place = raw.ljust(room, b"\0") if len(raw) <= room else struct.pack(order + many, at + len(body))
        body += raw if len(raw) > room else b""
        entries += struct.pack(order + "HH" + many, tag, {"I": 4, "H": 3, "d": 12, "Q": 16}[form], len(values)) + place
    head = (b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, at + len(body)) if big else struct.pack(order + "HI", 42, at + len(body)))
    path.write_bytes(head + b"".join(blocks) + body + struct.pack(order + ("Q" if big else "H"), len(tags)) + entries + bytes(8))


FORMS = [{"packed": 5}, {"packed": 5, "predictor": 2}, {"packed": 8, "predictor": 2, "order": ">"}, {"big": True}, {"big": True, "packed": 5, "predictor": 2, "order": ">"}, {"predictor": 3, "packed": 8}]


@pytest.mark.parametrize("how", FORMS, ids=str)
def test_tiff_forms_equal_their_plain_twins(spark, tmp_path, how):
    for dtype in ("f4", "f8") if how.get("predictor") == 3 else ("u1", "i2", "i4") if how.get("predictor") == 2 else ("f4", "u1"):
        a = (np.arange(7 * 10).reshape(7, 10) * 37 % 251 - (60 if dtype[0] != "u" else 0)).astype(dtype) / (4 if dtype[0] == "f" else 1)
        a = a.astype(dtype)
        tiff(tmp_path / "plain.tif", a)
        tiff(tmp_path / "other.tif", a, **how)
        plain, other = ([(y.tolist(), x.tolist(), v.tolist()) for y, x, v, _ in raster.GeoTiff(str(tmp_path / n)).read(list(range(6)))] for n in ("plain.tif", "other.tif"))
        assert plain == other
    assert load(spark, tmp_path / "other.tif", "geotiff").count() == 70


def test_lzw_of_long_blocks():
    r = np.random.default_rng(1)
    for data in (b"", b"a", b"ab" * 9000, bytes(70_000), r.integers(0, 256, 60_000).astype(np.uint8).tobytes(), r.integers(0, 3, 90_000).astype(np.uint8).tobytes()):
        assert raster.lzw(lzw(data)) == data


def test_bounds_reach_the_blocks(spark, tmp_path, monkeypatch):
    a = np.arange(64 * 64).reshape(64, 64).astype("i4")
    tiff(tmp_path / "a.tif", a, tile=8, packed=5)
    monkeypatch.setattr(raster, "CELLS", 64)
    whole = load(spark, tmp_path / "a.tif", "geotiff", name="v")
    some = whole.filter("x > 12 and x <= 16 and y between 30.25 and 34.75")
    reader = raster._TiffReader({"path": str(tmp_path / "a.tif")})
    assert len(reader.partitions()) == 64
    reader.pushFilters([GreaterThan(("x",), 12.0), LessThanOrEqual(("x",), 16.0), GreaterThanOrEqual(("y",), 30.25), LessThanOrEqual(("y",), 34.75), In(("y",), (31.25, 33.25))])
    assert 0 < len(reader.partitions()) <= 6
    assert sorted(map(tuple, some.collect())) == sorted(tuple(r) for r in whole.collect() if 12 < r.x <= 16 and 30.25 <= r.y <= 34.75)
