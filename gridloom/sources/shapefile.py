"""format("shp"): polygon records of ESRI shapefiles, with the attributes of the .dbf beside, as code, name and rings; and their writing.

`write` encodes records in tasks, adds their bytes up by task, and then lets each task write its records at its own offset of the three
files, which must lie in a folder that all executors mount. A task that runs again writes the same bytes at the same place.
"""

from __future__ import annotations

import struct
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from gridloom.session import lineage_cut

POLYGON = 5
#: Bytes of the attributes code and name; the geographic system of longitudes and latitudes.
WIDTHS = (32, 120)
WGS84 = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]'


def polygons(data: bytes) -> list[list[list[tuple[float, float]]] | None]:
    """The rings of each record; null records give None. Shells come clockwise and are turned counter-clockwise, holes the other way."""
    out, at = [], 100
    while at + 8 <= len(data):
        size = struct.unpack_from(">i", data, at + 4)[0] * 2
        kind = struct.unpack_from("<i", data, at + 8)[0]
        if kind % 10 == POLYGON:
            parts, points = struct.unpack_from("<2i", data, at + 44)
            first = [*struct.unpack_from(f"<{parts}i", data, at + 52), points]
            flat = struct.unpack_from(f"<{2 * points}d", data, at + 52 + 4 * parts)
            out.append([list(zip(flat[2 * a : 2 * b : 2], flat[2 * a + 1 : 2 * b : 2]))[::-1] for a, b in zip(first, first[1:])])
        else:
            out.append(None)
        at += 8 + size
    return out


def attributes(data: bytes, encoding: str = "utf-8") -> list[dict[str, str]]:
    """The rows of a dBASE table as text."""
    rows, head, size = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("ascii"), data[at + 16]))
        at += 32
    out = []
    for k in range(rows):
        place, row = head + k * size + 1, {}
        for name, width in fields:
            row[name] = data[place : place + width].decode(encoding, "replace").strip()
            place += width
        out.append(row)
    return out


class ShapefileSource(DataSource):
    """Options: path (comma-joined .shp files), code and name (fields of the attributes)."""

    @classmethod
    def name(cls) -> str:
        return "shp"

    def schema(self) -> str:
        return "code string, name string, rings array<array<struct<x:double,y:double>>>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.options["path"].split(",")]

    def read(self, partition: InputPartition):
        path = Path(partition.value)
        rows = attributes(path.with_suffix(".dbf").read_bytes())
        for row, rings in zip(rows, polygons(path.read_bytes())):
            if rings is not None:
                yield row.get(self.options.get("code", "code")), row.get(self.options.get("name", "name")), [[{"x": x, "y": y} for x, y in r] for r in rings]


def record(rings: list) -> bytes | None:
    """A polygon record without its header: shells clockwise, holes the other way, each closed. None without a ring of three points."""
    closed = []
    for ring in rings if rings is not None else []:
        points = np.array([(p["x"], p["y"]) for p in ring], float).reshape(-1, 2)[::-1]
        if len(points) >= 3:
            closed.append(points if (points[0] == points[-1]).all() else np.concatenate([points, points[:1]]))
    if not closed:
        return None
    flat = np.concatenate(closed)
    firsts = np.cumsum([0, *map(len, closed[:-1])])
    box = struct.pack("<4d", *flat.min(0), *flat.max(0))
    return struct.pack("<i", POLYGON) + box + struct.pack("<2i", len(closed), len(flat)) + firsts.astype("<i4").tobytes() + flat.astype("<f8").tobytes()


def row(code: str | None, name: str | None) -> bytes:
    """A row of the attributes; texts are cut to whole characters within their width."""
    cells = [(v or "").encode("utf-8")[:w].decode("utf-8", "ignore").encode("utf-8").ljust(w) for v, w in zip((code, name), WIDTHS)]
    return b" " + b"".join(cells)


def _head(words: int, box: tuple[float, ...]) -> bytes:
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i", 1000, POLYGON) + struct.pack("<8d", *box, 0, 0, 0, 0)


def write(shapes: DataFrame, path: str) -> int:
    """Writes shapes(code, name, rings), sorted by code, to path (.shp) and the .shx, .dbf and .prj beside; returns the number of records.

    Shapes without an area's ring are left out. The driver holds one row a task: its records, bytes and box."""

    def encode(batches):
        for pdf in batches:
            found = [(row(c, n), record(r)) for c, n, r in zip(pdf["code"], pdf["name"], pdf["rings"])]
            yield pd.DataFrame([f for f in found if f[1] is not None], columns=["row", "record"])

    sorted_ = shapes.select("code", "name", "rings").sort("code", "name")
    held = lineage_cut(sorted_.mapInPandas(encode, "row binary, record binary").select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("n")))
    sums = {r["part"]: (r["records"], r["bytes"]) for r in held.groupBy("part").agg(F.count(F.lit(1)).alias("records"), F.sum(8 + F.octet_length("record")).alias("bytes")).collect()}

    def boxes(batches):
        for pdf in batches:
            if len(pdf):
                own = np.array([struct.unpack_from("<4d", r, 4) for r in pdf["record"]])
                yield pd.DataFrame([(*own[:, :2].min(0), *own[:, 2:].max(0))], columns=["w", "s", "e", "n"])

    box = held.mapInPandas(boxes, "w double, s double, e double, n double").agg(F.min("w"), F.min("s"), F.max("e"), F.max("n")).first()
    box = tuple(v or 0.0 for v in box)
    start, records, size = {}, 0, 100
    for part in sorted(sums):
        start[part] = (records, size)
        records, size = records + sums[part][0], size + sums[part][1]
    out = {s: Path(path).with_suffix(s) for s in (".shp", ".shx", ".dbf", ".prj")}
    width = 1 + sum(WIDTHS)
    fields = b"".join(struct.pack("<11sc4xBB14x", f, b"C", w, 0) for f, w in zip((b"code", b"name"), WIDTHS)) + b"\r"
    heads = {".shp": _head(size // 2, box), ".shx": _head(50 + 4 * records, box), ".dbf": struct.pack("<4BIHH20x", 3, 100, 1, 1, records, 32 + len(fields), width) + fields}
    new = {s: str(p) + ".new" for s, p in out.items()}
    for s, head in heads.items():
        Path(new[s]).write_bytes(head)

    def put(pdf: pd.DataFrame) -> pd.DataFrame:
        number, at = start[int(pdf["part"].iat[0])]
        own = pdf.sort_values("n")
        sizes = np.array([len(r) for r in own["record"]])
        places = at + np.concatenate(([0], np.cumsum(sizes + 8)[:-1]))
        shp = b"".join(struct.pack(">2i", number + k + 1, len(r) // 2) + r for k, r in enumerate(own["record"]))
        shx = b"".join(struct.pack(">2i", p // 2, n // 2) for p, n in zip(places.tolist(), sizes.tolist()))
        for s, offset, data in ((".shp", at, shp), (".shx", 100 + 8 * number, shx), (".dbf", len(heads[".dbf"]) + number * width, b"".join(own["row"]))):
            with open(new[s], "r+b") as f:
                f.seek(offset)
                f.write(data)
        return pd.DataFrame([(len(own),)], columns=["done"])

    done = held.groupBy("part").applyInPandas(put, "done long").agg(F.sum("done")).first()[0] or 0
    if done != records:
        raise RuntimeError(f"{done} of {records} records written")
    with open(new[".dbf"], "r+b") as f:
        f.seek(0, 2)
        f.write(b"\x1a")
    Path(new[".prj"]).write_text(WGS84)
    for s, p in out.items():
        Path(new[s]).replace(p)
    return records
