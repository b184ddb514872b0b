"""The feeds, each from texts or sheets as its source sends them, which are made of the hours of events, to clean instants and MW."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import time as T
from gridloom.plans import pipelines
from gridloom.plans.base import Book, Tables
from gridloom.sources import landings, readers

book = Book()

HOURS_SQL = "h AS (SELECT event_type AS code, date_trunc('hour', ts)::TIMESTAMP AS t, round(sum(value), 2) AS v FROM events GROUP BY 1, 2)"


def hours(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("event_type").alias("code"), T.floor_unit(F.col("ts"), "hour").alias("t")).agg(F.round(F.sum("value"), 2).alias("v")).withColumn("year", F.year("t"))


def lines(rows: DataFrame, line: Column, head: str, keys: tuple[str, ...] = ("code", "year"), order: str = "t") -> DataFrame:
    """keys, text: the lines of each key in order, below the head. A text is what a source sends at once, a day or a year of an entity."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line"))))
    return rows.groupBy(*keys).agg(F.concat(F.lit(head + "\n"), F.array_join(F.transform(ordered, lambda r: r["line"]), "\n"), F.lit("\n")).alias("text"))


def records(rows: DataFrame, record: Column, keys: tuple[str, ...] = ("code", "year"), *path: str) -> DataFrame:
    """keys, text: the records of each key as a JSON list at the path."""
    body: Column = F.collect_list(record)
    for name in reversed(path):
        body = F.struct(body.alias(name))
    return rows.groupBy(*keys).agg(F.to_json(body).alias("text"))


def day(rows: DataFrame) -> DataFrame:
    return rows.withColumn("day", F.to_date("t"))


def stamp(pattern: str) -> Column:
    return F.date_format("t", pattern)


def clean(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.round("value", 4))


def fixed(minutes: str, value: str = "v", code: str = "code") -> str:
    """SQL of the hours moved by minutes."""
    return f"WITH {HOURS_SQL} SELECT {code} AS code, (t + ({minutes}) * INTERVAL 1 MINUTE)::TIMESTAMP AS ts, round({value}, 4) AS value FROM h WHERE v <> 0"


@book.add(fixed("CASE WHEN t < TIMESTAMP '2024-01-16' THEN 30 - 480 ELSE -480 END"))
def feed_in_two_formats(t: Tables) -> DataFrame:
    """Years of CSV up to a day, days of JSON with offsets from then on."""
    old, new = hours(t).filter("t < timestamp_ntz'2024-01-16'"), day(hours(t)).filter("t >= timestamp_ntz'2024-01-16'")
    texts = lines(old, F.concat_ws(",", stamp("yyyy-MM-dd HH:mm:ss"), "v"), "Trading Interval,Operational Demand (MW)")
    answers = records(new, F.struct(F.concat(stamp("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+08:00")).alias("asAtTimeStamp"), F.col("v").alias("operationalDemand")), ("code", "day"), "data", "data")
    return clean(pipelines.retrieve_formats({"aemo_wem": landings.western_australia(texts), "aemo_wem_new": landings.western_australia_days(answers)}))


@book.add(
    f"""WITH {HOURS_SQL}, p AS (SELECT code, t + INTERVAL 6 HOUR AS ts, v, 0 AS part FROM h WHERE t < TIMESTAMP '2024-01-12' UNION ALL SELECT code, t + INTERVAL 5 HOUR, v, 1 FROM h WHERE t >= TIMESTAMP '2024-01-12')
 SELECT code, ts::TIMESTAMP AS ts, round(v, 4) AS value FROM p WHERE v <> 0 QUALIFY row_number() OVER (PARTITION BY code, ts ORDER BY part) = 1"""
)
def feed_in_overlapping_formats(t: Tables) -> DataFrame:
    """Two layouts of CSV whose labels differ by an hour, so that an instant can be in both: the first one's counts."""
    old, new = hours(t).filter("t < timestamp_ntz'2024-01-12'"), hours(t).filter("t >= timestamp_ntz'2024-01-12'")
    texts = lines(old, F.concat_ws(",", stamp("yyyy-MM-dd HH:mm"), "v"), "DateTime,OntarioDemand")
    years = lines(new, F.concat_ws(",", stamp("yyyy-MM-dd"), F.hour("t") + 1, F.lit(0), "v"), "a\nb\nc\nDate,Hour,Market Demand,Ontario Demand")
    return clean(pipelines.retrieve_formats({"ieso": landings.ontario(texts), "ieso_new": landings.ontario_years(years)}))


@book.add(f"WITH {HOURS_SQL}, n AS (SELECT code, v, min(t) OVER (PARTITION BY code) AS first, row_number() OVER (PARTITION BY code ORDER BY t) - 1 AS n FROM h) SELECT code, (first + (n + 8) * INTERVAL 1 HOUR)::TIMESTAMP AS ts, round(v, 2) AS value FROM n WHERE v <> 0")
def feed_of_areas(t: Tables) -> DataFrame:
    """Sheets with a column for each of six areas, dated by position from the first row."""
    names = landings.ALBERTA_AREAS
    own = t.events.select(F.col("event_type").alias("code"), T.floor_unit(F.col("ts"), "hour").alias("t"), F.get(F.array(*map(F.lit, names)), F.col("user_id").cast("int") % 6).alias("area"), "value")
    wide = own.groupBy("code", "t").pivot("area", list(names)).agg(F.sum("value"))
    number = F.floor(T.micros(F.col("t")) / 3_600_000_000)
    sheet = wide.select("code", F.col("code").alias("file"), number.alias("n"), F.to_date("t").alias("DATE"), (F.hour("t") + 1).alias("HOUR ENDING"), *names)
    return pipelines.retrieve(landings.alberta(sheet, False), "aeso", "n").withColumn("value", F.round("value", 2))


@book.add(
    f"""WITH {HOURS_SQL}, g AS (SELECT code, t, CASE WHEN hour(t) % 7 = 0 THEN 0 WHEN hour(t) % 7 = 1 THEN NULL ELSE v END AS v, min(t) OVER (PARTITION BY code) AS first FROM h),
 n AS (SELECT code, v, first, row_number() OVER (PARTITION BY code ORDER BY t) - 1 AS n FROM g WHERE v <> 0)
 SELECT code, (first + (n + 9) * INTERVAL 1 HOUR)::TIMESTAMP AS ts, round(v, 4) AS value FROM n"""
)
def feed_of_sheets(t: Tables) -> DataFrame:
    """Sheets in which rows without a load are left out before the others are dated by position."""
    load = F.when(F.hour("t") % 7 == 0, F.lit(0.0)).when(F.hour("t") % 7 != 1, F.col("v"))
    number = F.floor(T.micros(F.col("t")) / 3_600_000_000)
    sheet = hours(t).select("code", F.lit("2024").alias("file"), number.alias("n"), stamp("yyyy-MM-dd").alias("Date"), (F.hour("t") + 1).alias("Hour"), load.alias("Load"))
    return clean(pipelines.retrieve(landings.british_columbia(sheet, "Date", "Hour", "Load"), "bchydro", "n"))


@book.add(
    f"""WITH {HOURS_SQL}, n AS (SELECT code, t::DATE AS day, v, row_number() OVER (PARTITION BY code, t::DATE ORDER BY t) - 1 AS n FROM h)
 SELECT 'MX_' || code AS code, (day + (n + 7) * INTERVAL 1 HOUR)::TIMESTAMP AS ts, round(CASE WHEN day(day) % 3 = 0 THEN 2 * v ELSE v END, 4) AS value FROM n WHERE v <> 0"""
)
def feed_of_versions(t: Tables) -> DataFrame:
    """Members of archives, each a day of all areas: on every third day a newer version has twice the loads, on the days after it has no rows."""
    mark = landings.MEXICO_MARKER
    head = f'note\n\n"Sistema"," Area"," Hora"," {mark} "'
    row = lambda v: F.concat(F.lit('"SIN","'), "code", F.lit('",'), F.hour("t") + 1, F.lit(","), v)
    own = day(hours(t))
    ordered = own.withColumn("o", F.struct("t", "code"))
    first = lines(ordered, row(F.col("v")), head, ("day",), "o").withColumn("version", F.lit("v1"))
    twice = lines(ordered.filter("day(day) % 3 = 0"), row(F.col("v") * 2), head, ("day",), "o").withColumn("version", F.lit("v2"))
    empty = first.filter("day(day) % 3 = 1").select("day", F.lit(head + "\n\n").alias("text"), F.lit("v2").alias("version"))
    asked = own.select("day", F.concat(F.lit("MX_"), "code").alias("code")).distinct()
    members = first.unionByName(twice).unionByName(empty).join(asked, "day")
    named = members.select("code", F.lit("zip").alias("file"), F.concat(F.lit("Demanda Dia del "), F.col("day").cast("string"), F.lit(" "), "version", F.lit(".csv")).alias("member"), "text")
    return clean(pipelines.retrieve(landings.mexico(named), "cenace"))


@book.add(
    """WITH c AS (SELECT event_type AS code, date_trunc('hour', ts)::TIMESTAMP AS t, count(*) FILTER (user_id % 3 = 0) AS wind, count(*) FILTER (user_id % 3 = 1) AS solar, count(*) FILTER (user_id % 3 = 2) AS other, count(*) AS n FROM events GROUP BY 1, 2),
 l AS (SELECT code, t - INTERVAL 2 HOUR AS ts, CASE WHEN hour(t) % 2 = 1 THEN 10 * n WHEN hour(t) % 5 = 0 THEN solar + other ELSE n END AS v FROM c)
 SELECT code, ts::TIMESTAMP AS ts, v::DOUBLE AS value FROM l WHERE v <> 0"""
)
def feed_of_scripts(t: Tables) -> DataFrame:
    """Pages whose scripts hold times and four numbers each: the total is 0 in even hours, and wind is null in every fifth."""
    part = lambda k: F.count_if(F.col("user_id") % 3 == k)
    counts = t.events.groupBy(F.col("event_type").alias("code"), T.floor_unit(F.col("ts"), "hour").alias("t")).agg(part(0).alias("wind"), part(1).alias("solar"), part(2).alias("other"), F.count(F.lit(1)).alias("n"))
    wind = F.when(F.hour("t") % 5 == 0, F.lit("null")).otherwise(F.col("wind").cast("string"))
    total = F.when(F.hour("t") % 2 == 1, F.col("n") * 10).otherwise(F.lit(0))
    at = F.concat(F.lit('var dateStr = "'), stamp("yyyy-MM-dd"), F.lit('"; var hourStr = "'), stamp("HH"), F.lit('"; var minutesStr = "00"; '))
    script = F.concat(at, F.lit("rows.push([dateStrFormat, "), F.concat_ws(", ", wind, "solar", total, "other"), F.lit("]);"))
    pages = lines(day(counts), script, "<html><script>", ("code", "day"))
    return pipelines.retrieve(landings.cyprus(pages.select("code", "text")), "tsoc").withColumn("value", F.round("value", 4))


@book.add(fixed("0"))
def feed_of_wide_days(t: Tables) -> DataFrame:
    """Sheets with a row a day and a column an hour."""
    wide = day(hours(t)).withColumn("hour", F.concat(F.hour("t") + 1, F.lit("h"))).groupBy("code", "day").pivot("hour", [f"{h}h" for h in range(1, 25)]).agg(F.first("v"))
    return clean(pipelines.retrieve(landings.algeria(wide, "day"), "sonelgaz"))


@book.add(fixed("240", code="'BR_' || code"))
def feed_of_subsystems(t: Tables) -> DataFrame:
    """CSV texts of a month of all subsystems, parted by semicolons, of which each entity takes its own."""
    own = hours(t).withColumn("o", F.struct("t", "code"))
    texts = lines(own.withColumn("file", stamp("yyyy")), F.concat_ws(";", "code", stamp("yyyy-MM-dd HH:mm:ss"), "v"), "id_subsistema;din_instante;val_cargaenergiahomwmed", ("file",), "o")
    asked = own.select(stamp("yyyy").alias("file"), F.concat(F.lit("BR_"), "code").alias("code")).distinct()
    rows = readers.csv_text(texts.join(asked, "file"), "text", "id_subsistema string, din_instante string, val_cargaenergiahomwmed double", sep=";", keep=["code"])
    return clean(pipelines.retrieve(landings.brazil(rows), "ons"))


@book.add("WITH q AS (SELECT event_type AS code, time_bucket(INTERVAL 15 MINUTE, ts)::TIMESTAMP AS t, sum(value) AS v FROM events GROUP BY 1, 2) SELECT code, (t - INTERVAL 315 MINUTE)::TIMESTAMP AS ts, round(v, 4) AS value FROM q WHERE v <> 0")
def feed_of_plants(t: Tables) -> DataFrame:
    """Answers with a record for each plant and report time, which are summed."""
    own = day(t.events.select(F.col("event_type").alias("code"), T.bucket(F.col("ts"), 15).alias("t"), "value"))
    record = F.struct(F.concat(stamp("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30")).alias("reportTimestamp"), F.col("value").alias("dispatchValueInMW"))
    rows = readers.json_path(records(own, record, ("code", "day"), "data"), "text", "reportTimestamp string, dispatchValueInMW double", ["data"], ["code"])
    return clean(pipelines.retrieve(rows, "pucsl", None))


@book.add(fixed("0"))
def feed_of_periods(t: Tables) -> DataFrame:
    """Answers with a list of hours two keys deep."""
    record = F.struct(stamp("yyyy-MM-dd'T'HH").alias("period"), F.col("v").alias("value"))
    rows = readers.json_path(records(hours(t), record, ("code", "year"), "response", "data"), "text", "period string, value double", ["response", "data"], ["code"], "ordinal")
    return clean(pipelines.retrieve(rows, "eia"))


@book.add(fixed("-780", "v * 2000"))
def feed_of_energies(t: Tables) -> DataFrame:
    """CSV texts below eleven lines, with energies of half hours in GWh."""
    texts = lines(hours(t), F.concat_ws(",", stamp("dd/MM/yyyy HH:mm:ss"), F.lit("R"), "v"), "x\n" * 11 + "Period end,Region,Demand (GWh)")
    return clean(pipelines.retrieve(readers.csv_text(texts, "text", "period_end string, region string, demand_gwh double", 11, keep=["code"]), "emi"))


@book.add(fixed("300"))
def feed_of_charts(t: Tables) -> DataFrame:
    """Answers with several series, of which the one of a name counts, each with a list of points."""
    point = F.struct(stamp("yyyy/MM/dd HH:mm").alias("Nombre"), F.col("v").alias("Valor"))
    named = hours(t).groupBy("code", "year").agg(F.collect_list(point).alias("d"))
    charts = F.array(F.struct(F.lit("Programado").alias("Name"), F.slice("d", 1, 1).alias("Data")), F.struct(F.lit("Ejecutado").alias("Name"), F.col("d").alias("Data")))
    answers = named.select("code", F.to_json(F.struct(F.struct(charts.alias("Series")).alias("Chart"))).alias("text"))
    rows = readers.nested_series(answers, "text", "Name string, Data array<struct<Nombre: string, Valor: double>>", ["Chart", "Series"], F.col("Name") == "Ejecutado", "Data", ["code"])
    return clean(pipelines.retrieve(rows, "coes", "position"))


@book.add(
    f"""WITH {HOURS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY code, (t - INTERVAL 1 SECOND)::DATE ORDER BY t DESC) AS n FROM h)
 SELECT code, (t + INTERVAL 3 HOUR)::TIMESTAMP AS ts, round(v, 4) AS value FROM n WHERE n > 1 AND v <> 0"""
)
def feed_without_last_rows(t: Tables) -> DataFrame:
    """Answers of days, whose last row belongs to the next day."""
    record = F.struct(F.concat(stamp("yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("-03:00")).alias("fecha"), F.col("v").alias("dem"))
    rows = readers.json_path(records(day(hours(t)), record, ("code", "day"), "rows"), "text", "fecha string, dem double", ["rows"], ["code"], "ordinal")
    return clean(pipelines.retrieve(rows, "cammesa"))


#: Feeds that are columns of a table: the columns that each sends, and the minutes from its label, in local time, to the instant.
COLUMNS: dict[str, tuple[dict[str, Column | str], int]] = {
    "aemo_nem": ({"TOTALDEMAND": "v", "SETTLEMENTDATE": "yyyy/MM/dd HH:mm:ss"}, -660),
    "ccei": ({"OBS_VALUE": "v", "TIME_PERIOD": "yyyy-MM-dd'T'HH:mm:ss'.000Z'"}, 0),
    "cen": ({"demanda": "v", "fecha": "yyyy-MM-dd", "hora": "H+1"}, 240),
    "entsoe": ({"load": "v", "ts": "t"}, 60),
    "epias": ({"load": "v", "date": "dd.MM.yyyy", "hour": "HH:mm"}, -120),
    "eskom": ({"load": "v", "time": "yyyy-MM-dd hh:mm:ss a"}, -60),
    "hydroquebec": ({"load": "v", "date": "yyyy-MM-dd'T'HH:mm:ss'-05:00'"}, 300),
    "nbpower": ({"NB_LOAD": "v", "HOUR": "yyyy-MM-dd HH:mm"}, 240),
    "nigeria": ({"load": "v", "ts": "t"}, 0),
    "niti": ({"load": "v", "year": "yyyy", "date": "dd-MMM ha"}, -270),
    "tepco": ({"load": "v", "DATE": "yyyy/M/d", "TIME": "H:mm"}, -480),
}


@book.add(
    f"WITH {HOURS_SQL}, s(source, minutes) AS (VALUES {', '.join(f"('{k}', {m})" for k, (_, m) in COLUMNS.items())})"
    " SELECT source, code, (t + minutes * INTERVAL 1 MINUTE)::TIMESTAMP AS ts, round(CASE WHEN source = 'tepco' THEN 10 * v ELSE v END, 4) AS value FROM h CROSS JOIN s WHERE v <> 0"
)
def feeds_of_columns(t: Tables) -> DataFrame:
    """Eleven feeds that send a row an hour in columns of their own."""
    base = hours(t).withColumn("o", F.floor(T.micros(F.col("t")) / 1_000_000))
    named = {"v": F.col("v"), "t": F.col("t"), "H+1": F.hour("t") + 1}
    out = []
    for source, (columns, _) in COLUMNS.items():
        landed = base.select("code", "o", *[named[x].alias(c) if x in named else stamp(x).alias(c) for c, x in columns.items()])
        out.append(clean(pipelines.retrieve(landed, source, "o")).select(F.lit(source).alias("source"), "code", "ts", "value"))
    return reduce(DataFrame.unionByName, out)
