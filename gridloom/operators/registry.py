"""The entity registry: a small dimension read from YAML, with codes, date ranges, zones, ISO codes and continents."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.scalar import bounded, code as code_of
from gridloom.functions import time as T
from gridloom.operators.series import longest

SCHEMA = "data_source string, country_name string, country_code string, subdivision_name string, subdivision_code string, time_zone string, start_date date, end_date date"
#: Days that sources publish late: the end `today` is so many days before.
PUBLISH_DAYS = 5

#: Alpha-2, alpha-3, continent and the zone that stands for the country (its capital's where it has several).
COUNTRIES = """
AL ALB EU Europe/Tirane|AR ARG SA America/Argentina/Buenos_Aires|AT AUT EU Europe/Vienna|AU AUS OC Australia/Sydney|BA BIH EU Europe/Sarajevo|BE BEL EU Europe/Brussels|BG BGR EU Europe/Sofia|BR BRA SA America/Sao_Paulo
CA CAN NA America/Toronto|CH CHE EU Europe/Zurich|CL CHL SA America/Santiago|CO COL SA America/Bogota|CY CYP AS Asia/Nicosia|CZ CZE EU Europe/Prague|DE DEU EU Europe/Berlin|DK DNK EU Europe/Copenhagen
DZ DZA AF Africa/Algiers|EE EST EU Europe/Tallinn|ES ESP EU Europe/Madrid|FI FIN EU Europe/Helsinki|FR FRA EU Europe/Paris|GB GBR EU Europe/London|GE GEO AS Asia/Tbilisi|GR GRC EU Europe/Athens
HR HRV EU Europe/Zagreb|HU HUN EU Europe/Budapest|IE IRL EU Europe/Dublin|IN IND AS Asia/Kolkata|IT ITA EU Europe/Rome|JP JPN AS Asia/Tokyo|LK LKA AS Asia/Colombo|LT LTU EU Europe/Vilnius
LU LUX EU Europe/Luxembourg|LV LVA EU Europe/Riga|MD MDA EU Europe/Chisinau|ME MNE EU Europe/Podgorica|MK MKD EU Europe/Skopje|MX MEX NA America/Mexico_City|NG NGA AF Africa/Lagos|NL NLD EU Europe/Amsterdam
NO NOR EU Europe/Oslo|NZ NZL OC Pacific/Auckland|PE PER SA America/Lima|PL POL EU Europe/Warsaw|PT PRT EU Europe/Lisbon|RO ROU EU Europe/Bucharest|RS SRB EU Europe/Belgrade|SE SWE EU Europe/Stockholm
SG SGP AS Asia/Singapore|SI SVN EU Europe/Ljubljana|SK SVK EU Europe/Bratislava|TR TUR AS Europe/Istanbul|UA UKR EU Europe/Kyiv|US USA NA America/New_York|XK XKX EU Europe/Belgrade|ZA ZAF AF Africa/Johannesburg
"""


def countries(spark: SparkSession) -> DataFrame:
    rows = [tuple(r.split()) for line in COUNTRIES.split("\n") for r in line.split("|") if r]
    return spark.createDataFrame(rows, "country_code string, alpha3 string, continent string, country_zone string")


def read(spark: SparkSession, path: str | None = None, folder: str | None = None, today: date | None = None) -> DataFrame:
    """The entities of one YAML file, or of all of a folder. Exactly one of both. A start after the end, or a missing field, is an error."""
    import yaml

    if (path is None) == (folder is None):
        raise ValueError("either path or folder")
    files = [Path(path)] if path else sorted(Path(folder).glob("*.yaml"))
    end = (today or date.today()) - timedelta(days=PUBLISH_DAYS)
    rows = []
    for file in files:
        for e in yaml.safe_load(file.read_text(encoding="utf-8"))["entities"]:
            last = end if str(e["end_date"]) == "today" else _day(e["end_date"])
            first = _day(e["start_date"])
            if first > last:
                raise ValueError(f"{file.name}: starts after its end: {e}")
            rows.append((file.stem, e["country_name"], e["country_code"], e.get("subdivision_name"), e.get("subdivision_code"), e.get("time_zone"), first, last))
    return spark.createDataFrame(rows, SCHEMA).withColumn("code", code_of(F.col("country_code"), F.col("subdivision_code")))


def _day(x: object) -> date:
    return x if isinstance(x, date) else date.fromisoformat(str(x))


def sources(entities: DataFrame, code: str | None = None) -> DataFrame:
    own = entities if code is None else entities.filter(F.col("code") == code)
    return own.select("data_source").distinct()


def codes(entities: DataFrame) -> DataFrame:
    return entities.select("code").distinct()


def chosen(entities: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The entities of the wanted codes; unknown codes are left out, and none known is an error."""
    asked = entities.sparkSession.createDataFrame([(c,) for c in wanted], "code string")
    found = entities.join(bounded(asked), "code", "left_semi")
    if found.isEmpty():
        raise ValueError(f"no known code among {list(wanted)}")
    return found


def unknown(entities: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(codes(entities), "code", "left_anti")


def zones(entities: DataFrame) -> DataFrame:
    """code, zone: the subdivision's own, else the country's. Sources that disagree are an error."""
    named = entities.join(F.broadcast(countries(entities.sparkSession)), "country_code", "left").select("code", F.coalesce("time_zone", "country_zone").alias("zone"))
    own = named.groupBy("code").agg(F.min("zone").alias("zone"), F.count_distinct("zone").alias("_n"))
    return own.withColumn("zone", F.when(F.col("_n") == 1, F.col("zone")).otherwise(F.raise_error(F.concat(F.lit("no single zone for "), F.col("code"))))).drop("_n")


def with_geography(df: DataFrame) -> DataFrame:
    """df(code) with alpha3 and continent of the country."""
    return df.withColumn("country_code", F.split_part("code", F.lit("_"), F.lit(1))).join(F.broadcast(countries(df.sparkSession)).select("country_code", "alpha3", "continent"), "country_code", "left")


def date_ranges(entities: DataFrame) -> DataFrame:
    """code, data_source, start_date, end_date: of each code the longest; of equal ones the first source."""
    return longest(entities.select("code", "data_source", "start_date", "end_date"), ["code"], "start_date", "end_date", "data_source")


def available_years(entities: DataFrame) -> DataFrame:
    """code, year: of the UTC instants of the range's local midnights, both ends counted."""
    ranges = date_ranges(entities).join(zones(entities), "code")
    utc = lambda d: F.year(T.to_utc(F.col(d).cast("timestamp_ntz"), F.col("zone")))
    return ranges.select("code", F.explode(F.sequence(utc("start_date"), utc("end_date"))).alias("year"))


def folders(text: str, root: str) -> dict[str, str]:
    """Names of folders to their paths: values of a YAML mapping, or lists that are joined, below the root; and root_folder itself."""
    import yaml

    held = yaml.safe_load(text) or {}
    return {name: "/".join([root.rstrip("/"), *([v] if isinstance(v, str) else v)]) for name, v in held.items()} | {"root_folder": root}
