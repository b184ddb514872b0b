"""From what a source sends to the rows that its connector takes: JSON, pages, CSV texts and sheets with their layouts and synthetic times.

Each takes rows with `code` and the answer's text, or a sheet's rows with their number, and gives code, a time and value columns as
`connectors.CONNECTORS` names them, and an ordinal. Texts of nothing, or without the wanted list, give no rows. A series whose times are
told by its first row and a step is dated by position: no task holds it whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions import time as T
from gridloom.operators.series import positional
from gridloom.sources import readers

#: The areas of the workbooks' columns; the line above the values, their columns, and the hour that is there twice.
ALBERTA_AREAS = ("SOUTH", "NORTHWEST", "NORTHEAST", "EDMONTON", "CALGARY", "CENTRAL")
MEXICO_MARKER = "Estimacion de Demanda por Balance (MWh)"
MEXICO_TWICE = ("NTE", "2022-10-30", 2)
#: Rows of a part in which positions are counted.
PART = 100_000


def _local(day: Column, hours: Column | int = 0) -> Column:
    return F.timestamp_add("HOUR", F.lit(hours) if isinstance(hours, int) else hours, day.cast("timestamp_ntz"))


def _from_first(rows: DataFrame, keys: Sequence[str], ordinal: str, start: Column, minutes: int) -> DataFrame:
    """rows with ts: the start of their entity's first row, in UTC, and a step more for each row."""
    first = rows.groupBy(*keys).agg(F.min_by(start, ordinal).alias("_start"))
    return positional(rows.join(first, list(keys)), keys, ordinal, F.col("_start"), minutes, "ts", F.floor(F.col(ordinal) / PART)).drop("_start")


def alberta(sheet: DataFrame, standard_time: bool) -> DataFrame:
    """Sheets of hourly loads by area: code, file, n (row number), the areas, and DATE with HOUR ENDING, or DT_MST, the hour's beginning in
    standard time. To code, ts, area_1 to area_6, n. Areas may be written in capitals or not."""
    named = {c.upper(): c for c in sheet.columns}
    if standard_time:
        begin = T.to_utc(F.col("DT_MST").cast("timestamp_ntz"), "America/Edmonton")
        start = T.hours(F.timestamp_add("MINUTE", T.dst_minutes(begin, "America/Edmonton"), begin), 1)
    else:
        start = T.to_utc(_local(F.col("DATE"), F.col("`HOUR ENDING`").cast("int")), "America/Edmonton")
    dated = _from_first(sheet, ["code", "file"], "n", start, 60)
    return dated.select("code", "ts", *[F.col(named[a]).cast("double").alias(f"area_{k + 1}") for k, a in enumerate(ALBERTA_AREAS)], "n")


def british_columbia(sheet: DataFrame, date: str, hour: str, load: str) -> DataFrame:
    """Sheets of a year: code, file, n, a date, the hour from 1 and the load. Rows without a load stand where clocks change; the others follow
    each other hour by hour from the first row's time. To code, ts, load, n."""
    start = T.to_utc(_local(F.to_date(date), F.col(hour).cast("int")), "America/Vancouver")
    first = sheet.groupBy("code", "file").agg(F.min_by(start, "n").alias("_start"))
    kept = sheet.filter(F.col(load).cast("double") != 0).join(first, ["code", "file"])
    dated = positional(kept, ["code", "file"], "n", F.col("_start"), 60, "ts", F.floor(F.col("n") / PART))
    return dated.select("code", "ts", F.col(load).cast("double").alias("load"), "n")


def mexico(members: DataFrame) -> DataFrame:
    """Members of an archive: code (such as MX_NTE), file, member (with its day and version in the name) and text. Of each day the newest version
    that has rows counts. To code, ts (local), load, ordinal: the hours of a day in order, for the code's own area."""
    area = F.split_part("code", F.lit("_"), F.lit(2))
    lines = F.split("text", r"\r?\n")
    at = F.array_position(F.transform(lines, lambda x: x.contains(MEXICO_MARKER)), True).cast("int")
    body = F.when(at > 0, F.filter(F.slice(lines, at + 1, F.size(lines)), lambda x: F.trim(x) != "")).otherwise(F.array().cast("array<string>"))
    # the first line below the marker's may be empty: then this version has nothing
    empty = F.coalesce(F.trim(F.get(lines, at)) == "", F.lit(True))
    days = members.select("code", "member", F.regexp_extract("member", r"(\d{4}-\d{2}-\d{2})", 1).alias("day"), area.alias("area"), F.get(lines, at - 1).alias("head"), F.when(~empty, body).otherwise(F.array().cast("array<string>")).alias("rows"))
    newest = Window.partitionBy("code", "day").orderBy(F.desc("member"))
    chosen = days.filter(F.size("rows") > 0).withColumn("_n", F.row_number().over(newest)).filter("_n = 1")
    names = F.transform(F.split("head", ","), lambda h: F.trim(F.regexp_replace(h, '"', "")))
    place = lambda name: F.array_position(names, name).cast("int") - 1
    where = F.when(F.col("area").isin("BCA", "BCS"), place("Sistema")).otherwise(place("Area"))
    cells = chosen.select("code", "day", "area", where.alias("_w"), place(MEXICO_MARKER).alias("_v"), F.posexplode("rows").alias("line", "row"))
    split = cells.withColumn("_c", F.transform(F.split("row", ","), lambda c: F.trim(F.regexp_replace(c, '"', "")))).filter(F.get("_c", F.col("_w")) == F.col("area"))
    nth = F.row_number().over(Window.partitionBy("code", "day").orderBy("line")) - 1
    own = split.select("code", "day", "area", F.get("_c", F.col("_v")).cast("double").alias("load"), nth.alias("k"))
    twice = (F.col("area") == MEXICO_TWICE[0]) & (F.col("day") == MEXICO_TWICE[1])
    kept = own.filter(~(twice & (F.col("k") == MEXICO_TWICE[2]))).withColumn("k", F.when(twice & (F.col("k") > MEXICO_TWICE[2]), F.col("k") - 1).otherwise(F.col("k")))
    return kept.select("code", _local(F.to_date("day"), F.col("k")).alias("ts"), "load", F.col("k").alias("ordinal"))


def great_britain(answers: DataFrame, year: str = "year") -> DataFrame:
    """Answers with records of ND, one each half hour from half past midnight of the year: code, year, text to code, ts, ND, ordinal."""
    keep = ["code", year]
    lists = answers.select(*keep, F.from_json("text", "result struct<records: array<struct<ND: double>>>")["result"]["records"].alias("_r"))
    rows = lists.select(*keep, F.posexplode("_r").alias("ordinal", "_e")).select(*keep, "ordinal", "_e.ND")
    start = T.to_utc(F.timestamp_add("MINUTE", F.lit(30), F.make_timestamp_ntz(F.col(year), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))), "Europe/London")
    return rows.select("code", F.timestamp_add("MINUTE", F.col("ordinal") * 30, start).alias("ts"), "ND", "ordinal")


def cyprus(pages: DataFrame) -> DataFrame:
    """Pages of scripts: code, text to code, ts (local), wind, solar, total, conventional as text, ordinal."""
    number = r"(?:\d+|null)"
    tail = {"wind": 0, "solar": 1, "total": 2, "conventional": 3}
    patterns = {"_day": r'var dateStr = "(\d{4}-\d{2}-\d{2})";', "_hour": r'var hourStr = "(\d{2})";', "_minute": r'var minutesStr = "(\d{2})";'}
    patterns |= {n: r"\[dateStrFormat, " + (number + ", ") * k + r"(\d+|null)" + (", " + number) * (3 - k) + r"\]" for n, k in tail.items()}
    rows = readers.parallel_lists(pages, "text", patterns, ["code"], "ordinal")
    return rows.select("code", F.to_timestamp_ntz(F.concat_ws(" ", "_day", F.concat_ws(":", "_hour", "_minute")), F.lit("yyyy-MM-dd HH:mm")).alias("ts"), *tail, "ordinal")


def colombia(answers: DataFrame) -> DataFrame:
    """Answers with items of a date and a struct of Hour01 to Hour24: code, text to code, Date, hour (from 0), value, ordinal."""
    hours = ", ".join(f"Hour{h:02d}: double" for h in range(1, 25))
    rows = readers.json_path(answers, "text", f"Date string, Values struct<{hours}>", ["Items"], ["code"])
    keyed = rows.select(F.struct("code", "Date").alias("day"), "Values")
    return readers.struct_hours(keyed, "day", "Values").select("day.code", "day.Date", "hour", "value", F.col("hour").alias("ordinal"))


def algeria(wide: DataFrame, day: str) -> DataFrame:
    """Rows of a day with columns 1h to 24h: to code, day, hour (from 0), value, ordinal."""
    names = [f"{h}h" for h in range(1, 25) if f"{h}h" in wide.columns]
    long = readers.melt_hours(wide.select("code", F.col(day).alias("day"), *names), ["code", "day"], names)
    return long.select("code", "day", "hour", "value", F.col("hour").alias("ordinal"))


def brazil(rows: DataFrame, subsystem: str = "id_subsistema") -> DataFrame:
    """Rows of all subsystems: those of the code's own, the part of the code after its first underscore."""
    return rows.filter(F.col(subsystem) == F.split_part("code", F.lit("_"), F.lit(2)))


def western_australia(texts: DataFrame) -> DataFrame:
    """CSV texts of a year of half hours: code, text to code, ts (local), load, ordinal."""
    rows = readers.csv_text(texts, "text", "`Trading Interval` string, `Operational Demand (MW)` double", keep=["code"])
    return rows.select("code", F.to_timestamp_ntz("Trading Interval", F.lit("yyyy-MM-dd HH:mm:ss")).alias("ts"), F.col("Operational Demand (MW)").alias("load"), "ordinal")


def western_australia_days(answers: DataFrame) -> DataFrame:
    """Answers of a day, with times that have an offset: code, text to code, asAtTimeStamp, operationalDemand, ordinal."""
    return readers.json_path(answers, "text", "asAtTimeStamp string, operationalDemand double", ["data", "data"], ["code"], "ordinal")


def ontario(texts: DataFrame) -> DataFrame:
    """CSV texts of all years before May 2002: code, text to code, DateTime, OntarioDemand, ordinal."""
    return readers.csv_text(texts, "text", "DateTime string, OntarioDemand double", keep=["code"])


def ontario_years(texts: DataFrame) -> DataFrame:
    """CSV texts of a year, below three lines: code, text to code, Date, Hour (from 1), load, ordinal."""
    rows = readers.csv_text(texts, "text", "Date string, Hour int, market double, load double", 3, keep=["code"])
    return rows.drop("market")
