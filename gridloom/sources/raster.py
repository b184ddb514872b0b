"""format("geotiff") and format("netcdf"): rasters as long tables, a partition for each run of blocks or of steps, as Arrow batches.

Only the header is read on the driver; a partition seeks to its own bytes, so a file is never whole in a task. Bounds on y, x and ts that a
query filters by are pushed down: blocks, steps and chunks beyond them are no partitions and are not read. That needs the session's setting
spark.sql.python.filterPushdown.enabled. The path must be mounted on every executor. The value column has the name that the option `name` gives, and no band or reference columns beside it; a cell without
data is null. Options: path (comma-joined files), name, and for netcdf variable, time, y and x (names in the file).
"""

from __future__ import annotations

import re
import struct
import zlib
from datetime import datetime
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from gridloom.sources import hdf5

#: Cells of a partition, about.
CELLS = 4_000_000
#: The bytes of TIFF's field types and their struct codes; kinds of samples; NetCDF's types.
FIELDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
SAMPLES = {1: "u", 2: "i", 3: "f"}
NC_TYPES = {1: "i1", 2: "S1", 3: "i2", 4: "i4", 5: "f4", 6: "f8"}


def tiff_tags(f) -> tuple[str, dict[int, tuple]]:
    """The byte order and the tags of a TIFF's first image, classic or big."""
    head = f.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    kind = struct.unpack(order + "H", head[2:4])[0] if order else 0
    if kind not in (42, 43):
        raise ValueError("not a TIFF, classic or big")
    # count of entries, an entry's count, an offset or a value's room
    many, number, place_of = ("H", "I", "I") if kind == 42 else ("Q", "Q", "Q")
    f.seek(struct.unpack(order + place_of, head[4:8] if kind == 42 else head[8:16])[0])
    entry = struct.Struct(f"{order}HH{number}{struct.calcsize(place_of)}s")
    entries = f.read(entry.size * struct.unpack(order + many, f.read(struct.calcsize(many)))[0])
    tags = {}
    for tag, kind, count, place in entry.iter_unpack(entries):
        if kind not in FIELDS:
            continue
        form = order + (f"{count}s" if kind == 2 else FIELDS[kind] * count)
        if (size := struct.calcsize(form)) > len(place):
            f.seek(struct.unpack(order + place_of, place)[0])
            place = f.read(size)
        tags[tag] = struct.unpack(form, place[:size])
    return order, tags


def lzw(data: bytes) -> bytes:
    """TIFF's variant of LZW: codes of 9 to 12 bits from the high bit on, widened one code early; 256 clears the table, 257 ends."""
    single = [bytes((i,)) for i in range(256)]
    table: list[bytes] = []
    out: list[bytes] = []
    held, bits, width, before = 0, 0, 9, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, before = [], 9, b""
            continue
        if code < 256:
            now = single[code]
        elif code - 258 < len(table):
            now = table[code - 258]
        elif code - 258 == len(table) and before:
            now = before + before[:1]
        else:
            raise ValueError("broken LZW data")
        out.append(now)
        if before:
            table.append(before + now[:1])
            if len(table) + 259 >= 1 << width and width < 12:
                width += 1
        before = now
    return b"".join(out)


class Bounds:
    """What filters say of y, x and ts: least and greatest values; ts in microseconds since the epoch."""

    def __init__(self) -> None:
        self.low: dict[str, float] = {}
        self.high: dict[str, float] = {}

    def take(self, filters: list[Filter]) -> None:
        for f in filters:
            name = getattr(f, "attribute", ("",))[-1].lower()
            if name not in ("y", "x", "ts"):
                continue
            values = list(f.value) if isinstance(f, In) else [f.value] if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) else []
            numbers = [self._number(v) for v in values if v is not None]
            if numbers and isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual)):
                self.low[name] = max(self.low.get(name, -np.inf), min(numbers))
            if numbers and isinstance(f, (EqualTo, In, LessThan, LessThanOrEqual)):
                self.high[name] = min(self.high.get(name, np.inf), max(numbers))

    @staticmethod
    def _number(value) -> float:
        if isinstance(value, datetime):
            return float(np.datetime64(value.replace(tzinfo=None), "us").astype("i8"))
        return float(value)

    def within(self, name: str, values: np.ndarray) -> np.ndarray:
        return (values >= self.low.get(name, -np.inf)) & (values <= self.high.get(name, np.inf))

    def meets(self, name: str, least: float, most: float) -> bool:
        return most >= self.low.get(name, -np.inf) and least <= self.high.get(name, np.inf)


class GeoTiff:
    """The layout of a georeferenced, one-band TIFF of strips or tiles: plain, deflated or LZW, with or without a predictor."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            order, t = tiff_tags(f)
        one = lambda tag, default: t.get(tag, (default,))[0]
        self.path, self.width, self.height, self.packed, self.predictor = path, one(256, 0), one(257, 0), one(259, 1), one(317, 1)
        if self.packed not in (1, 5, 8, 32946) or self.predictor not in (1, 2, 3) or one(277, 1) != 1:
            raise ValueError(f"{path}: compression, predictor or bands are not supported")
        self.dtype = np.dtype(f"{order}{SAMPLES[one(339, 1)]}{one(258, 8) // 8}")
        self.tile = (one(323, 0), one(322, 0)) if 324 in t else (min(one(278, self.height), self.height), self.width)
        self.blocks = list(zip(t.get(324, t.get(273)), t.get(325, t.get(279))))
        (self.dx, self.dy), (i, j, _, x, y, _) = t[33550][:2], t[33922][:6]
        self.x0, self.y0 = x - i * self.dx, y + j * self.dy
        none = one(42113, b"").split(b"\0")[0].strip()
        self.nodata = float(none) if none else None
        self.across = -(-self.width // self.tile[1])

    def place(self, k: int) -> tuple[int, int, int, int]:
        """First row, first column, rows and columns of a block within the image."""
        top, left = k // self.across * self.tile[0], k % self.across * self.tile[1]
        return top, left, min(self.tile[0], self.height - top), min(self.tile[1], self.width - left)

    def centres(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        top, left, rows, columns = self.place(k)
        return self.y0 - (top + np.arange(rows) + 0.5) * self.dy, self.x0 + (left + np.arange(columns) + 0.5) * self.dx

    def wanted(self, bounds: Bounds) -> list[int]:
        """The blocks that have cells within the bounds."""
        spans = ((k, *self.centres(k)) for k in range(len(self.blocks)))
        return [k for k, y, x in spans if bounds.meets("y", y.min(), y.max()) and bounds.meets("x", x.min(), x.max())]

    def _cells(self, data: bytes) -> np.ndarray:
        raw = data if self.packed == 1 else lzw(data) if self.packed == 5 else zlib.decompress(data)
        wide = self.tile[1]
        if self.predictor == 3:  # a row's bytes are differences, sorted by their place in the number, the highest first
            size = self.dtype.itemsize
            planes = np.frombuffer(raw, np.uint8)
            planes = np.cumsum(planes[: len(planes) // (wide * size) * wide * size].reshape(-1, wide * size), axis=1, dtype=np.uint8)
            return np.ascontiguousarray(planes.reshape(-1, size, wide).transpose(0, 2, 1)).view(self.dtype.newbyteorder(">")).reshape(-1, wide)
        cells = np.frombuffer(raw, self.dtype)
        cells = cells[: len(cells) // wide * wide].reshape(-1, wide)
        if self.predictor == 2:
            return np.cumsum(cells, axis=1, dtype=self.dtype.newbyteorder("="))
        return cells

    def read(self, blocks: list[int], bounds: Bounds | None = None):
        """y, x and value of the blocks' cells at their centres, within the bounds, and which are missing."""
        with open(self.path, "rb") as f:
            for k in blocks:
                f.seek(self.blocks[k][0])
                _, _, rows, columns = self.place(k)
                cells = self._cells(f.read(self.blocks[k][1]))[:rows, :columns].astype("f8")
                y, x = self.centres(k)
                if bounds:
                    here, there = bounds.within("y", y), bounds.within("x", x)
                    y, x, cells = y[here], x[there], cells[here][:, there]
                missing = np.isnan(cells) if self.nodata is None else np.isnan(cells) | (cells == float(np.dtype(self.dtype).type(self.nodata)))
                yield np.repeat(y, len(x)), np.tile(x, len(y)), cells.ravel(), missing.ravel()


class NetCdf:
    """Header of a classic NetCDF file (versions 1 and 2): dimensions and variables with their place."""

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, "rb") as f:
            self._f = f
            magic = f.read(4)
            if magic[:3] != b"CDF" or magic[3] not in (1, 2):
                raise ValueError(f"{path}: neither a classic NetCDF file nor one of version 4")
            self._offset = ">I" if magic[3] == 1 else ">Q"
            self.records = self._int()
            self.dims = [(self._name(), self._int()) for _ in range(self._list())]
            self._attributes()
            self.variables = dict(self._variable() for _ in range(self._list()))
            del self._f
        sizes = [v["size"] for v in self.variables.values() if v["record"]]
        self.stride = sum(sizes) if len(sizes) != 1 else next(prod(v["shape"][1:]) * v["dtype"].itemsize for v in self.variables.values() if v["record"])

    def _int(self) -> int:
        return struct.unpack(">i", self._f.read(4))[0]

    def _list(self) -> int:
        self._int()
        return self._int()

    def _padded(self, n: int) -> bytes:
        return self._f.read(-(-n // 4) * 4)[:n]

    def _name(self) -> str:
        return self._padded(self._int()).decode()

    def _attributes(self) -> dict[str, object]:
        out = {}
        for _ in range(self._list()):
            name, kind, n = self._name(), self._int(), self._int()
            raw = self._padded(n * np.dtype(NC_TYPES[kind]).itemsize)
            out[name] = raw.decode("utf-8", "replace") if kind == 2 else np.frombuffer(raw, ">" + NC_TYPES[kind])
        return out

    def _variable(self) -> tuple[str, dict]:
        name, ids = self._name(), [self._int() for _ in range(self._int())]
        attributes, kind, size = self._attributes(), self._int(), self._int()
        begin = struct.unpack(self._offset, self._f.read(struct.calcsize(self._offset)))[0]
        record = bool(ids) and self.dims[ids[0]][1] == 0
        shape = [self.dims[i][1] or self.records for i in ids]
        return name, {"dims": [self.dims[i][0] for i in ids], "shape": shape, "attributes": attributes, "dtype": np.dtype(">" + NC_TYPES[kind]), "size": size, "begin": begin, "record": record}

    def values(self, name: str, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Steps first to last of the variable's leading dimension, unpacked, and which of them are missing."""
        v = self.variables[name]
        last, inner = v["shape"][0] if last is None else last, prod(v["shape"][1:])
        step = self.stride if v["record"] else inner * v["dtype"].itemsize
        raw = np.empty((last - first, inner), v["dtype"])
        with open(self.path, "rb") as f:
            for k in range(first, last):
                f.seek(v["begin"] + k * step)
                raw[k - first] = np.frombuffer(f.read(inner * v["dtype"].itemsize), v["dtype"])
        return unpacked(raw, v["attributes"])

    def steps(self, name: str, steps: list[int], rows: np.ndarray, columns: np.ndarray):
        """(step, values, missing) of the wanted rows and columns of each step."""
        shape = self.variables[name]["shape"][1:]
        for k in steps:
            value, missing = (a.reshape(shape)[np.ix_(rows, columns)] for a in self.values(name, k, k + 1))
            yield k, value, missing


def unpacked(raw: np.ndarray, attributes: dict) -> tuple[np.ndarray, np.ndarray]:
    """Values by the attributes scale_factor and add_offset, and which are missing."""
    missing = np.isnan(raw) if raw.dtype.kind == "f" else np.zeros(raw.shape, bool)
    for key in ("_FillValue", "missing_value"):
        if key in attributes:
            missing |= raw == attributes[key][0]
    return raw.astype("f8") * float(attributes.get("scale_factor", [1])[0]) + float(attributes.get("add_offset", [0])[0]), missing


def opened(path: str):
    """A NetCDF file, classic or version 4."""
    with open(path, "rb") as f:
        magic = f.read(8)
    if magic == hdf5.MAGIC:
        return hdf5.Hdf5(path)
    return NetCdf(path)


def times(values: np.ndarray, units: str) -> np.ndarray:
    """Microseconds since the epoch of numbers in `hours since 1900-01-01 00:00:0.0` and the like."""
    found = re.match(r"(second|minute|hour|day)s? since (\d+)-(\d+)-(\d+)(?:[ T](\d+):(\d+))?", units)
    if not found:
        raise ValueError(f"unknown units of time: {units}")
    zero = datetime(*[int(g or 0) for g in found.groups()[1:]])
    micros = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[found[1]] * 1_000_000
    return np.round(values * micros).astype("i8") + np.datetime64(zero, "us").astype("i8")


def batch(columns: dict[str, np.ndarray], missing: np.ndarray, value: str) -> pa.RecordBatch:
    """Arrow columns; value is null where missing, ts a time without zone."""
    arrays = [pa.array(v, mask=missing) if n == value else pa.array(v, pa.timestamp("us")) if n == "ts" else pa.array(v) for n, v in columns.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


class _Source(DataSource):
    def schema(self) -> str:
        return f"{self.lead}y double, x double, `{self.options.get('name', 'value')}` double"

    def reader(self, schema: StructType) -> DataSourceReader:
        return self.read_with(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options, self.bounds = options, Bounds()

    def pushFilters(self, filters: list[Filter]):
        """Bounds are taken from the filters; Spark filters the rows again, as blocks and chunks are wanted whole."""
        self.bounds.take(filters)
        return filters


class _TiffReader(_Reader):
    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.options["path"].split(","):
            g = GeoTiff(path)
            blocks, step = g.wanted(self.bounds), max(1, CELLS // prod(g.tile))
            out += [InputPartition((path, blocks[k : k + step])) for k in range(0, len(blocks), step)]
        return out

    def read(self, partition: InputPartition):
        if partition is None:  # Spark's stand-in for no partitions
            return
        path, blocks = partition.value
        name = self.options.get("name", "value")
        for y, x, value, missing in GeoTiff(path).read(blocks, self.bounds):
            yield batch({"y": y, "x": x, name: value}, missing, name)


class _NetCdfReader(_Reader):
    def _axes(self, f) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ts, y and x of the variable's dimensions."""
        o = self.options
        names = [o.get("time", "time"), o.get("y", "latitude"), o.get("x", "longitude")]
        if f.variables[o["variable"]]["dims"] != names:
            raise ValueError(f"{f.path}: {o['variable']} is not laid out by {names}")
        ts, y, x = (f.values(n)[0].ravel() for n in names)
        return times(ts, f.variables[names[0]]["attributes"]["units"]), y, x

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.options["path"].split(","):
            f = opened(path)
            ts, y, x = self._axes(f)
            steps = np.flatnonzero(self.bounds.within("ts", ts)).tolist()
            # a chunk's steps are one task's, as they are unpacked together
            group = f.variables[self.options["variable"]].get("chunk", (1,))[0]
            runs: dict[int, list[int]] = {}
            for k in steps:
                runs.setdefault(k // group, []).append(k)
            most = max(1, CELLS // max(1, group * len(y) * len(x)))
            held = list(runs.values()) if self.bounds.within("y", y).any() and self.bounds.within("x", x).any() else []
            out += [InputPartition((path, sum(held[i : i + most], []))) for i in range(0, len(held), most)]
        return out

    def read(self, partition: InputPartition):
        if partition is None:
            return
        path, steps = partition.value
        f, name = opened(path), self.options.get("name", "value")
        ts, y, x = self._axes(f)
        here, there = np.flatnonzero(self.bounds.within("y", y)), np.flatnonzero(self.bounds.within("x", x))
        for k, value, missing in f.steps(self.options["variable"], steps, here, there):
            yield batch({"ts": np.full(value.size, ts[k]), "y": np.repeat(y[here], len(there)), "x": np.tile(x[there], len(here)), name: value.ravel()}, missing.ravel(), name)


class GeoTiffSource(_Source):
    lead, read_with = "", _TiffReader

    @classmethod
    def name(cls) -> str:
        return "geotiff"


class NetCdfSource(_Source):
    lead, read_with = "ts timestamp_ntz, ", _NetCdfReader

    @classmethod
    def name(cls) -> str:
        return "netcdf"
