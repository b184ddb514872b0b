"""The feeds: for each source how it is asked, what its landed rows hold, and how they become instants and MW.

A connector turns landed rows, parsed by gridloom.sources.readers, into (code, ts, value): ts a UTC instant as TIMESTAMP_NTZ that labels
the period as the source's convention says, value in MW. Zones, fold policy, label shift and unit are data, not code; what differs
more has a function of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions import time as T
from gridloom.functions.scalar import row_sum
from gridloom.operators.series import occurrences, resolution
from gridloom.sources import requests as Q


@dataclass(frozen=True)
class Connector:
    """value and time: columns, or SQL expressions, of the landed rows. zone: of local times; None if the text has an offset; '' for UTC."""

    value: str
    time: str
    zone: str | None
    ambiguous: str = "raise"
    nonexistent: str = "raise"
    shift_minutes: int = 0
    scale: float = 1.0
    requests: Callable[[DataFrame], DataFrame] | None = None
    prepare: Callable[[DataFrame], DataFrame] | None = None
    limit_days: int | None = None


def _at(day: str, hour: str, less: int = 0) -> str:
    """SQL of a day's text and an hour's number."""
    return f"cast(cast({day} as date) as timestamp_ntz) + make_dt_interval(0, int({hour}) - {less})"


def _drop_last_of_day(order: str) -> Callable[[DataFrame], DataFrame]:
    """Without the last row of each code and day asked for, as it belongs to the next day's request. A day goes up to and with the midnight after it."""
    day = F.to_date(F.to_timestamp_ntz(F.substring(order, 1, 19)) - F.expr("INTERVAL 1 SECOND"))
    last = F.row_number().over(Window.partitionBy("code", "_day").orderBy(F.col(order).desc()))
    return lambda df: df.withColumn("_day", day).withColumn("_n", last).filter("_n > 1").drop("_n", "_day")


def _market_west(df: DataFrame) -> DataFrame:
    return Q.tagged([("year", Q.years(df.withColumn("end", F.least("end", F.lit("2023-12-31").cast("date"))).filter("start <= end"))), ("day", Q.days(df.withColumn("start", F.greatest("start", F.lit("2023-10-01").cast("date"))).filter("start <= end")))])


def dispatch_sum(df: DataFrame) -> DataFrame:
    """One row per report time: the sum of all plants."""
    return df.groupBy("code", "reportTimestamp").agg(F.sum("dispatchValueInMW").alias("dispatchValueInMW"))


def areas(df: DataFrame) -> DataFrame:
    """The sum of the columns that begin with `area`; nulls count as nothing."""
    return df.withColumn("load", row_sum(*[c for c in df.columns if c.startswith("area")]))


def generation_total(df: DataFrame) -> DataFrame:
    """total, or the sum of wind, solar and conventional where total is missing or 0; the text null is missing. Nothing at all is null."""
    number = lambda c: F.nullif(F.col(c), F.lit("null")).cast("double")
    parts = [F.coalesce(number(c), F.lit(0.0)) for c in ("wind", "solar", "conventional")]
    summed = F.when(number("wind").isNull() & number("solar").isNull() & number("conventional").isNull(), F.lit(None)).otherwise(parts[0] + parts[1] + parts[2])
    return df.withColumn("load", F.coalesce(F.nullif(number("total"), F.lit(0.0)), summed))


#: Each source's columns, zone, policy, shift and unit.
CONNECTORS: dict[str, Connector] = {
    "aemo_nem": Connector("TOTALDEMAND", "to_timestamp_ntz(SETTLEMENTDATE, 'yyyy/MM/dd HH:mm:ss')", "Australia/Sydney", "null", "null", requests=Q.month_ends),
    "aemo_wem": Connector("load", "ts", "Australia/Perth", "null", "null", 30, requests=_market_west),
    "aemo_wem_new": Connector("operationalDemand", "asAtTimeStamp", None),
    "aeso": Connector("load", "ts", "", requests=None, prepare=areas),
    "bchydro": Connector("load", "ts", "", requests=Q.years, prepare=lambda df: df.filter("load is not null and load <> 0")),
    "cammesa": Connector("dem", "fecha", None, requests=Q.days, prepare=lambda df: _drop_last_of_day("fecha")(df.filter("dem is not null"))),
    "ccei": Connector("OBS_VALUE", "to_timestamp_ntz(replace(TIME_PERIOD, '.000Z', ''), \"yyyy-MM-dd'T'HH:mm:ss\")", "", prepare=lambda df: df.filter("not (code = 'CA_ON' and contains(TIME_PERIOD, '06:59:59'))")),
    "cen": Connector("demanda", _at("fecha", "least(hora, 24)", 1), "America/Santiago", "null", "null", 60, requests=lambda df: Q.intervals(df, "YS")),
    "cenace": Connector("load", "ts", "America/Mexico_City", shift_minutes=60, requests=lambda df: Q.intervals(df, "YS", 10)),
    "coes": Connector("Valor", "to_timestamp_ntz(Nombre, 'yyyy/MM/dd HH:mm')", "America/Lima", requests=Q.years),
    "eia": Connector("value", "to_timestamp_ntz(period, \"yyyy-MM-dd'T'HH\")", "", requests=lambda df: Q.intervals(df, "6MS"), limit_days=208),
    "emi": Connector("demand_gwh", "to_timestamp_ntz(period_end, 'dd/MM/yyyy HH:mm:ss')", "Pacific/Auckland", "null", "null", scale=1000 / 0.5, requests=lambda df: Q.intervals(df, "YS"), limit_days=366),
    "entsoe": Connector("load", "ts", None, requests=lambda df: Q.intervals(df, "YS"), prepare=lambda df: label_ends(df)),
    "epias": Connector("load", "to_timestamp_ntz(concat(date, ' ', hour), 'dd.MM.yyyy HH:mm')", "Europe/Istanbul", "null", "null", 60),
    "eskom": Connector("load", "to_timestamp_ntz(time, 'yyyy-MM-dd hh:mm:ss a')", "Africa/Johannesburg", shift_minutes=60),
    "hydroquebec": Connector("load", "date", None),
    "ieso": Connector("OntarioDemand", "to_timestamp_ntz(DateTime, 'yyyy-MM-dd HH:mm')", "America/Toronto", "null", "null", 60, requests=Q.years),
    "ieso_new": Connector("load", _at("Date", "Hour", 1), "America/Toronto", "null", "null"),
    "nbpower": Connector("NB_LOAD", "to_timestamp_ntz(HOUR, 'yyyy-MM-dd HH:mm')", "America/Moncton", "infer", requests=Q.month_ends),
    "neso": Connector("ND", "ts", "", requests=Q.years),
    "nigeria": Connector("load", "ts", "Africa/Lagos", shift_minutes=60, prepare=lambda df: df.withColumn("ts", T.round_second(F.col("ts")))),
    "niti": Connector("load", "to_timestamp_ntz(concat(year, ' ', date), 'yyyy dd-MMM ha')", "Asia/Kolkata", shift_minutes=60),
    "ons": Connector("val_cargaenergiahomwmed", "to_timestamp_ntz(din_instante, 'yyyy-MM-dd HH:mm:ss')", "America/Sao_Paulo", "null", "null", 60, requests=Q.years),
    "pucsl": Connector("dispatchValueInMW", "reportTimestamp", None, shift_minutes=15, requests=lambda df: Q.intervals(df, "7D"), prepare=dispatch_sum, limit_days=7),
    "sonelgaz": Connector("value", _at("day", "hour"), "Africa/Algiers", shift_minutes=60),
    "tepco": Connector("load", "to_timestamp_ntz(concat(DATE, ' ', TIME), 'yyyy/M/d H:mm')", "Asia/Tokyo", shift_minutes=60, scale=10.0, requests=Q.years),
    "tsoc": Connector("load", "ts", "Asia/Nicosia", "null", "null", requests=lambda df: Q.starts(df, "15D"), prepare=generation_total),
    "xm": Connector("value", _at("Date", "hour"), "America/Bogota", shift_minutes=60, scale=1 / 1000, requests=lambda df: Q.intervals(df, "MS"), limit_days=31),
}


def label_ends(df: DataFrame) -> DataFrame:
    """Times moved by each code's least step, an hour if it has one row, so that they label the period's end."""
    least = resolution(df, ["code"]).select("code", F.coalesce("resolution", F.lit(3_600_000_000)).alias("_s"))
    return df.join(least, "code").withColumn("ts", F.timestamp_add("MICROSECOND", F.col("_s"), F.col("ts"))).drop("_s")


def instant(text: Column) -> Column:
    """UTC of a time with an offset in its text, or of a timestamp."""
    return F.to_timestamp(text).cast("timestamp_ntz") if text is not None else text


def extract(landed: DataFrame, source: str, ordinal: str | None = None) -> DataFrame:
    """code, ts, value and, if there is one, the ordinal, of a source's landed rows. ordinal: order of rows, needed where folds are inferred."""
    c = CONNECTORS[source]
    rows = c.prepare(landed) if c.prepare else landed
    local = F.expr(c.time)
    keep = ["code", *([ordinal] if ordinal else [])]
    if c.zone is None:
        own = rows.select(*keep, instant(local).alias("ts"), (F.expr(c.value).cast("double") * c.scale).alias("value"))
    elif c.zone == "":
        own = rows.select(*keep, local.cast("timestamp_ntz").alias("ts"), (F.expr(c.value).cast("double") * c.scale).alias("value"))
    else:
        zone = F.col("zone") if "zone" in rows.columns else F.lit(c.zone)
        named = rows.withColumn("_local", local.cast("timestamp_ntz"))
        nth = occurrences(named, ["code"], "_local", ordinal) if c.ambiguous == "infer" else None
        if nth is not None:
            named = named.withColumn("_nth", nth)
        ts = T.localize(F.col("_local"), zone, c.ambiguous, c.nonexistent, F.col("_nth") if nth is not None else None)
        own = named.select(*keep, ts.alias("ts"), (F.expr(c.value).cast("double") * c.scale).alias("value"))
    return own.withColumn("ts", F.timestamp_add("MINUTE", F.lit(c.shift_minutes), F.col("ts"))) if c.shift_minutes else own


def request_list(source: str, df: DataFrame) -> DataFrame | None:
    """The source's requests for (code, start, end); None if it is asked once for all. A span over its limit is an error."""
    c = CONNECTORS[source]
    if c.requests is None:
        return None
    found = c.requests(df)
    if c.limit_days is not None:
        found = found.withColumn("to", F.when(Q.too_long(found, c.limit_days), F.raise_error(F.lit(f"{source}: span over {c.limit_days} days")).cast("date")).otherwise(F.col("to")))
    return found
