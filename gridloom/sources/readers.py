"""Scans: CSV with lines to skip, JSON by key path, HTML literals, ZIP members, workbooks, registries, wide hours, whole directories.

Every text or binary is landed first and parsed on the executors; schemas are given, never inferred.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType
from pyspark.sql.window import Window


def csv(spark: SparkSession, path: str | Sequence[str], schema: str, sep: str = ",", skip: int = 0, header: bool = True, **options: str) -> DataFrame:
    """A CSV scan with a fixed schema. skip: lines before the header, which are dropped with it by their place in the file; then rows are lines,
    and a quoted line break ends one. Files are split among tasks as others are."""
    if not skip:
        return spark.read.schema(schema).option("sep", sep).option("header", header).options(**options).csv(path)
    paths = [path] if isinstance(path, str) else list(path)
    # lines are numbered within the scan; a file's first split holds the lines to drop, and its least number is that of the file's first line
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_n"))
    first = lines.filter("_at = 0").groupBy("_file").agg(F.min("_n").alias("_first"))
    kept = lines.join(first, "_file").filter((F.col("_at") > 0) | (F.col("_n") - F.col("_first") >= skip + int(header))).filter(F.trim("value") != "")
    return kept.select(F.from_csv("value", schema, {"sep": sep} | options).alias("r")).select("r.*")


def csv_text(df: DataFrame, text: str, schema: str, skip: int = 0, header: bool = True, sep: str = ",", keep: Sequence[str] = ()) -> DataFrame:
    """The columns to keep, ordinal (of the line) and fields of landed CSV texts, below the lines to skip and the header. Empty lines and null
    texts give none; a quoted line break ends a row."""
    lines = F.split(F.col(text), r"\r?\n")
    body = df.select(*keep, F.posexplode(F.slice(lines, skip + int(header) + 1, F.size(lines))).alias("ordinal", "_line")).filter(F.trim("_line") != "")
    return body.select(*keep, "ordinal", F.from_csv("_line", schema, {"sep": sep}).alias("r")).select(*keep, "ordinal", "r.*")


def json_path(df: DataFrame, text: str, schema: str, keys: Sequence[str], keep: Sequence[str] = (), position: str | None = None) -> DataFrame:
    """The records of the array at a key path of a JSON document, after the columns to keep and, if it is named, the position. schema: of a record."""
    nested = f"array<struct<{schema}>>"
    for key in reversed(keys):
        nested = f"struct<`{key}`:{nested}>"
    whole = F.from_json(F.col(text), nested)
    rows = df.select(*keep, F.posexplode(_descend(whole, keys)).alias(position or "_n", "r"))
    return rows.select(*keep, *[position] * bool(position), "r.*")


def _descend(column: Column, keys: Sequence[str]) -> Column:
    for key in keys:
        column = column.getField(key)
    return column


def nested_series(df: DataFrame, text: str, schema: str, keys: Sequence[str], wanted: Column, values: str, keep: Sequence[str] = ()) -> DataFrame:
    """The columns to keep, position and fields of the elements of the list `values` of those records at a key path that are wanted; empty lists give none."""
    found = json_path(df, text, schema, keys, keep).filter(wanted)
    return found.select(*keep, F.posexplode(values).alias("position", "_e")).select(*keep, "position", "_e.*")


def parallel_lists(df: DataFrame, text: str, patterns: dict[str, str], keep: Sequence[str] = (), position: str | None = None) -> DataFrame:
    """All matches of each pattern's first group, zipped by position: a row for each, after the columns to keep and, if it is named, the position."""
    found = [F.regexp_extract_all(F.col(text), F.lit(p), F.lit(1)).alias(n) for n, p in patterns.items()]
    rows = df.select(*keep, *found).select(*keep, F.posexplode(F.arrays_zip(*patterns)).alias(position or "_n", "_e"))
    return rows.select(*keep, *[position] * bool(position), "_e.*")


def hidden_fields(df: DataFrame, page: str, names: Sequence[str] = ("__VIEWSTATE", "__VIEWSTATEGENERATOR", "__EVENTVALIDATION")) -> DataFrame:
    """The values of a page's hidden form fields, for the second request of a two-step form."""
    return df.select("*", *[F.regexp_extract(F.col(page), rf'id="{n}"[^>]*value="([^"]*)"', 1).alias(n) for n in names])


def unzip(files: DataFrame, pattern: str = r".*\.csv$", encoding: str = "utf-8") -> DataFrame:
    """binaryFile rows to file, member, text: the archive's members whose names match."""

    def members(batches):
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    out += [(path, n, z.read(n).decode(encoding, "replace")) for n in z.namelist() if re.match(pattern, n)]
            yield pd.DataFrame(out, columns=["file", "member", "text"])

    return files.select("path", "content").mapInPandas(members, "file string, member string, text string")


def after_marker(df: DataFrame, text: str, marker: str, schema: str, keep: Sequence[str] = ()) -> DataFrame:
    """The CSV rows of texts below the line that holds the marker and its header line; texts without it have none."""
    lines = F.split(F.col(text), r"\r?\n")
    at = F.array_position(F.transform(lines, lambda x: x.contains(marker)), True)
    rows = df.withColumn("_lines", F.when(at > 0, F.slice(lines, at.cast("int") + 1, F.size(lines))).otherwise(F.array().cast("array<string>")))
    return rows.select(*keep, F.explode("_lines").alias("_line")).filter(F.trim("_line") != "").select(*keep, F.from_csv("_line", schema).alias("r")).select(*keep, "r.*")


def newest_with_rows(versions: DataFrame, day: str, version: str, rows: str) -> DataFrame:
    """For each day the newest version that has rows."""
    order = Window.partitionBy(day).orderBy(F.col(version).desc())
    return versions.filter(F.col(rows) > 0).withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def by_prefix(spark: SparkSession, folder: str, prefix: str, schema: str, sep: str = ",") -> DataFrame:
    """All CSV files of a folder whose names begin with the prefix."""
    return csv(spark, f"{folder.rstrip('/')}/{prefix}*", schema, sep)


def with_file_code(df: DataFrame, pattern: str = r"([^/]+?)(?:_[^/_]*)?\.[^.]+$", out: str = "country_code") -> DataFrame:
    """df read from files, with a column taken from each file's name."""
    return df.withColumn(out, F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def by_extension(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".csv"):
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    raise ValueError(f"neither .parquet nor .csv: {path}")


def listing(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """path, length of a folder's files with a suffix; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder).select("path", "length")


def melt_hours(wide: DataFrame, day: str | Sequence[str], hour_columns: Sequence[str], value: str = "value") -> DataFrame:
    """day (and other columns to keep), hour (from 0), value of a table with a column for each hour, named or ending in its number from 1."""
    return wide.unpivot([day] if isinstance(day, str) else list(day), list(hour_columns), "_h", value).withColumn("hour", F.regexp_extract("_h", r"(\d+)", 1).cast("int") - 1).drop("_h")


def struct_hours(df: DataFrame, day: str, struct: str, prefix: str = "Hour", count: int = 24, value: str = "value") -> DataFrame:
    """day, hour, value of a struct with a field for each hour."""
    fields = F.array(*[F.col(f"{struct}.{prefix}{h:02d}") for h in range(1, count + 1)])
    return df.select(day, F.posexplode(fields).alias("hour", value))


class WorkbookSource(DataSource):
    """format("xlsx"): option path, sheet (name or first), skip (rows), columns (a comma-joined choice). All cells are strings."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        rows = sheet_rows(self.options["path"], self.options.get("sheet"), int(self.options.get("skip", 0)))
        chosen = [c for c in self.options.get("columns", "").split(",") if c]
        return ", ".join(f"`{c}` string" for c in next(iter(rows), []) if c and (not chosen or c in chosen))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _WorkbookReader(schema, dict(self.options))


class _WorkbookReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.fields, self.options = [f.name for f in schema.fields], options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.options["path"].split(",")]

    def read(self, partition: InputPartition):
        rows = iter(sheet_rows(partition.value, self.options.get("sheet"), int(self.options.get("skip", 0))))
        place = {n: k for k, n in enumerate(next(rows, []))}
        for row in rows:
            yield tuple(row[place[f]] if f in place and place[f] < len(row) else None for f in self.fields)


def sheet_rows(path: str, sheet: str | None = None, skip: int = 0) -> list[list[str | None]]:
    """The rows of a sheet of an .xlsx workbook as strings, by its XML."""
    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{main}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{main}si")]
        names = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{main}sheet")]
        number = names.index(sheet) + 1 if sheet else 1
        rows = []
        for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{number}.xml")).iter(f"{main}row"):
            cells: dict[int, str | None] = {}
            for k, c in enumerate(row.iter(f"{main}c")):
                letters = re.match(r"[A-Z]+", c.get("r") or "")
                at = k
                if letters:
                    at = 0
                    for x in letters[0]:
                        at = at * 26 + ord(x) - 64
                    at -= 1
                v = c.find(f"{main}v")
                text = "".join(t.text or "" for t in c.iter(f"{main}t")) if c.get("t") == "inlineStr" else v.text if v is not None else None
                cells[at] = shared[int(text)] if c.get("t") == "s" and text is not None else text
            rows.append([cells.get(k) for k in range(max(cells, default=-1) + 1)])
    return rows[skip:]
