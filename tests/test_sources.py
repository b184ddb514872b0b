import zipfile
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from gridloom.functions.scalar import bounded
from gridloom.operators import features, registry
from gridloom.plans import pipelines
from gridloom.sources import connectors, readers, requests, sinks


def test_csv_with_lines_to_skip(spark, tmp_path):
    (tmp_path / "EPI_1.csv").write_text("note\nmore\na;b\n1;x\n2;y\n")
    (tmp_path / "EPI_2.csv").write_text("note\nmore\na;b\n3;z\n")
    (tmp_path / "other.csv").write_text("n\nm\na;b\n9;q\n")
    got = readers.csv(spark, [str(tmp_path / "EPI_1.csv"), str(tmp_path / "EPI_2.csv")], "a int, b string", ";", skip=2)
    assert sorted(map(tuple, got.collect())) == [(1, "x"), (2, "y"), (3, "z")]
    plain = tmp_path / "p"
    plain.mkdir()
    (plain / "NIT_a.csv").write_text("a,b\n1,x\n")
    (plain / "ZZZ.csv").write_text("a,b\n2,x\n")
    assert readers.by_prefix(spark, str(plain), "NIT", "a int, b string").count() == 1
    assert readers.listing(spark, str(plain), ".csv").count() == 2 and readers.listing(spark, str(plain), ".yaml").count() == 0
    assert readers.by_extension(spark, str(plain / "NIT_a.csv"), "a int, b string").count() == 1
    with pytest.raises(ValueError):
        readers.by_extension(spark, "x.xml")


def test_json_by_key_path(spark):
    df = spark.createDataFrame([('{"data":{"data":[{"v":1.5,"t":"a"},{"v":2,"t":"b"}]}}',), ('{"data":{"data":[]}}',)], "body string")
    assert [tuple(r) for r in readers.json_path(df, "body", "v: double, t: string", ["data", "data"]).collect()] == [(1.5, "a"), (2.0, "b")]
    flat = spark.createDataFrame([('{"data":[{"v":7}]}',)], "body string")
    assert readers.json_path(flat, "body", "v: int", ["data"]).first()[0] == 7


def test_page_literals(spark):
    page = "x([fmt(2024,1,2), 10, 20, null, 5]); y([fmt(2024,1,3), 1, null, 7, 0]);"
    df = spark.createDataFrame([(page, '<input id="__VIEWSTATE" type=hidden value="abc=" />')], "page string, form string")
    found = readers.parallel_lists(df, "page", {"day": r"fmt\(([\d,]+)\)", "wind": r"\), (\w+),", "solar": r"\), \w+, (\w+),"})
    assert [tuple(r) for r in found.collect()] == [("2024,1,2", "10", "20"), ("2024,1,3", "1", "null")]
    assert readers.hidden_fields(df, "form").first()["__VIEWSTATE"] == "abc="


def test_zip_marker_and_versions(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("day_v1.csv", 'head\nmarker line\n"BCA"," NTE",12.5\n"BCA"," SIN",3\n')
        z.writestr("day_v2.csv", "head only\n")
        z.writestr("Metadata.txt", "no")
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.zip"))
    members = readers.unzip(files)
    rows = readers.after_marker(members, "text", "marker", "system string, area string, mw double", ["member"])
    assert members.count() == 2 and sorted((r["area"].strip(), r["mw"]) for r in rows.collect()) == [("NTE", 12.5), ("SIN", 3.0)]
    versions = spark.createDataFrame([("d1", 1, 5), ("d1", 3, 0), ("d1", 2, 4), ("d2", 1, 0)], "day string, version int, rows int")
    assert [(r["day"], r["version"]) for r in readers.newest_with_rows(versions, "day", "version", "rows").collect()] == [("d1", 2)]


def workbook(path):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}"><sheets><sheet name="S1"/><sheet name="S2"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>date</t></si><si><t>load</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData/></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet xmlns="{main}"><sheetData><row><c r="A1" t="inlineStr"><is><t>title</t></is></c></row><row><c r="A2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c></row><row><c r="A3"><v>45000</v></c><c r="C3"><v>7.5</v></c></row><row><c r="A4"><v>45001</v></c></row></sheetData></worksheet>')


def test_workbook(spark, tmp_path):
    workbook(tmp_path / "b.xlsx")
    spark.dataSource.register(readers.WorkbookSource)
    got = spark.read.format("xlsx").option("path", str(tmp_path / "b.xlsx")).option("sheet", "S2").option("skip", 1).load()
    assert [tuple(r) for r in got.select("date", "load").collect()] == [("45000", "7.5"), ("45001", None)]


def test_wide_hours(spark):
    wide = spark.createDataFrame([("2024-01-01", 1.0, 2.0)], "day string, `1h` double, `24h` double")
    assert sorted(map(tuple, readers.melt_hours(wide, "day", ["1h", "24h"]).select("hour", "value").collect())) == [(0, 1.0), (23, 2.0)]
    nested = spark.createDataFrame([("2024-01-01", {"Hour01": 1.0, "Hour02": 5.0})], "Date string, Values struct<Hour01: double, Hour02: double>")
    assert sorted(map(tuple, readers.struct_hours(nested, "Date", "Values", count=2).select("hour", "value").collect())) == [(0, 1.0), (1, 5.0)]


def test_requests(spark):
    df = requests.ranges(spark, [("A", date(2023, 2, 10), date(2024, 3, 20))])
    assert [(r["year"], r["month"]) for r in requests.month_ends(df).collect()][::12] == [(2023, 2), (2024, 2)]
    assert requests.month_ends(df, True).count() == 14 and requests.years(df).count() == 2 and requests.days(df).count() == 405
    assert [(r["from"], r["to"]) for r in requests.intervals(df, "YS").collect()] == [(date(2023, 2, 10), date(2024, 1, 1)), (date(2024, 1, 1), date(2024, 3, 20))]
    assert [r["from"] for r in requests.intervals(df, "6MS").collect()] == [date(2023, 2, 10), date(2023, 3, 1), date(2023, 9, 1), date(2024, 3, 1)]
    assert requests.starts(df, "15D").count() == 27 and requests.intervals(df, "7D").count() == 58
    done = spark.createDataFrame([("A", 2023), ("A", 2024)], "code string, year int")
    assert requests.pending(requests.years(df), done, ["code", "year"]).count() == 0
    assert [r["year"] for r in requests.pending(requests.years(df), done, ["code", "year"], 2024).collect()] == [2024]
    w = requests.weather(spark.createDataFrame([("A", 2020, 1.0, 2.0, 3.0, 4.0)], "code string, year int, west double, south double, east double, north double")).first()
    assert w["area"] == [4.0, 1.0, 2.0, 3.0] and (len(w["months"]), len(w["days"]), w["hours"][-1]) == (12, 31, "23:00")
    parts = connectors.request_list("aemo_wem", df)
    assert {r["tag"]: r["n"] for r in parts.groupBy("tag").agg(F.count("*").alias("n")).collect()} == {"year": 1, "day": 172}
    assert connectors.request_list("epias", df) is None
    assert connectors.request_list("pucsl", df).count() == 58
    assert set(connectors.CONNECTORS) >= {"aemo_nem", "eia", "entsoe", "xm"} and len(connectors.CONNECTORS) == 28


CASES = [
    ("aemo_nem", [("NSW", "2024/01/01 00:30:00", "7000.5")], "code string, SETTLEMENTDATE string, TOTALDEMAND string", [(datetime(2023, 12, 31, 13, 30), 7000.5)]),
    ("aemo_nem", [("NSW", "2024/04/07 02:30:00", "1")], "code string, SETTLEMENTDATE string, TOTALDEMAND string", [(None, 1.0)]),
    ("emi", [("NZ", "01/07/2023 00:30:00", 2.0)], "code string, period_end string, demand_gwh double", [(datetime(2023, 6, 30, 12, 30), 4000.0)]),
    ("cen", [("CL", "2024-01-10", 25, 5.0)], "code string, fecha string, hora int, demanda double", [(datetime(2024, 1, 11, 3), 5.0)]),
    ("ccei", [("CA_ON", "2024-01-01T06:59:59.000Z", 1.0), ("CA_ON", "2024-01-01T07:00:00.000Z", 2.0)], "code string, TIME_PERIOD string, OBS_VALUE double", [(datetime(2024, 1, 1, 7), 2.0)]),
    ("cammesa", [("AR", "2024-01-01T00:05:00.000-03:00", 1.0), ("AR", "2024-01-01T00:10:00.000-03:00", 2.0)], "code string, fecha string, dem double", [(datetime(2024, 1, 1, 3, 5), 1.0)]),
    ("cammesa", [("AR", f"2024-01-0{d}T{h}:00.000-03:00", float(d)) for d, h in ((1, "12:00"), (2, "00:00"), (2, "12:00"), (3, "00:00"))], "code string, fecha string, dem double", [(datetime(2024, 1, 1, 15), 1.0), (datetime(2024, 1, 2, 15), 2.0)]),
    ("eia", [("US_TEX", "2024-01-01T05", "40000")], "code string, period string, value string", [(datetime(2024, 1, 1, 5), 40000.0)]),
    ("aeso", [("CA_AB", datetime(2024, 1, 1), 1.0, None, 2.0)], "code string, ts timestamp_ntz, area_a double, area_b double, area_c double", [(datetime(2024, 1, 1), 3.0)]),
    ("tepco", [("JP", "2023/4/1", "0:00", 300.0)], "code string, DATE string, TIME string, load double", [(datetime(2023, 3, 31, 16), 3000.0)]),
    ("xm", [("CO", "2024-01-01", 3, 9_000_000.0)], "code string, Date string, hour int, value double", [(datetime(2024, 1, 1, 9), 9000.0)]),
    ("niti", [("IN", "2024", "05-Jan 3PM", 1.0)], "code string, year string, date string, load double", [(datetime(2024, 1, 5, 10, 30), 1.0)]),
    ("pucsl", [("LK", "2024-01-01T00:00:00+05:30", 1.0), ("LK", "2024-01-01T00:00:00+05:30", 2.5)], "code string, reportTimestamp string, dispatchValueInMW double", [(datetime(2023, 12, 31, 18, 45), 3.5)]),
    ("tsoc", [("CY", datetime(2024, 1, 1), "1", "2", "0", "3"), ("CY", datetime(2024, 1, 2), "null", "null", "null", "null"), ("CY", datetime(2024, 1, 3), "1", "1", "9", "1")], "code string, ts timestamp_ntz, wind string, solar string, total string, conventional string", [(datetime(2023, 12, 31, 22), 6.0), (datetime(2024, 1, 1, 22), None), (datetime(2024, 1, 2, 22), 9.0)]),
    ("entsoe", [("FR", datetime(2024, 1, 1), 1.0), ("FR", datetime(2024, 1, 1, 0, 15), 2.0), ("DE", datetime(2024, 1, 1), 3.0)], "code string, ts timestamp_ntz, load double", [(datetime(2024, 1, 1, 0, 15), 1.0), (datetime(2024, 1, 1, 0, 30), 2.0), (datetime(2024, 1, 1, 1), 3.0)]),
    ("ieso_new", [("CA_ON", "2024-01-01", 1, 5.0)], "code string, Date string, Hour int, load double", [(datetime(2024, 1, 1, 5), 5.0)]),
    ("sonelgaz", [("DZ", "2024-01-01", 0, 5.0)], "code string, day string, hour int, value double", [(datetime(2024, 1, 1, 0), 5.0)]),
    ("hydroquebec", [("CA_QC", "2024-01-01T01:00:00-05:00", 5.0)], "code string, date string, load double", [(datetime(2024, 1, 1, 6), 5.0)]),
]


@pytest.mark.parametrize("source, rows, schema, want", CASES, ids=lambda x: x if isinstance(x, str) and len(x) < 13 else "")
def test_connectors(spark, source, rows, schema, want):
    got = [(r["ts"], r["value"]) for r in connectors.extract(spark.createDataFrame(rows, schema), source).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_inferred_folds(spark):
    rows = [("CA_NB", f"2024-11-03 0{h}:30", float(k), k) for k, h in enumerate((0, 1, 1, 2))]
    got = connectors.extract(spark.createDataFrame(rows, "code string, HOUR string, NB_LOAD double, n int"), "nbpower", "n").orderBy("n").collect()
    assert [r["ts"].hour for r in got] == [3, 4, 5, 6]


def test_registry(spark, tmp_path):
    (tmp_path / "one.yaml").write_text("entities:\n- {country_name: France, country_code: FR, start_date: 2020-01-01, end_date: today}\n- {country_name: United States, country_code: US, subdivision_name: Texas, subdivision_code: TEX, time_zone: America/Chicago, start_date: 2019-07-01, end_date: 2024-01-01}\n")
    (tmp_path / "two.yaml").write_text("entities:\n- {country_name: France, country_code: FR, start_date: 2010-01-01, end_date: today}\n")
    e = registry.read(spark, folder=str(tmp_path), today=date(2024, 6, 10))
    assert {r["code"] for r in registry.codes(e).collect()} == {"FR", "US_TEX"} and registry.sources(e, "FR").count() == 2
    best = {r["code"]: (r["data_source"], r["end_date"]) for r in registry.date_ranges(e).collect()}
    assert best["FR"] == ("two", date(2024, 6, 5))
    assert {r["code"]: r["zone"] for r in registry.zones(e).collect()} == {"FR": "Europe/Paris", "US_TEX": "America/Chicago"}
    assert registry.available_years(e).filter("code = 'FR'").agg(F.min("year"), F.max("year")).first()[:] == (2009, 2024)
    geo = {r["code"]: (r["alpha3"], r["continent"]) for r in registry.with_geography(registry.codes(e)).collect()}
    assert geo == {"FR": ("FRA", "EU"), "US_TEX": ("USA", "NA")}
    assert registry.chosen(e, ["FR", "nope"]).count() == 2 and registry.unknown(e, spark.createDataFrame([("nope",), ("FR",)], "code string")).count() == 1
    with pytest.raises(ValueError):
        registry.chosen(e, ["nope"])
    with pytest.raises(ValueError):
        registry.read(spark)
    (tmp_path / "bad.yaml").write_text("entities:\n- {country_name: X, country_code: XX, start_date: 2025-01-01, end_date: 2024-01-01}\n")
    with pytest.raises(ValueError):
        registry.read(spark, path=str(tmp_path / "bad.yaml"))


def test_sink_replaces_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = lambda code, v: spark.createDataFrame([(code, datetime(2024, 1, 1), v)], "code string, ts timestamp_ntz, value double")
    assert sinks.manifest(spark, path, ["entity_code"]).count() == 0
    sinks.demand(rows("A", 1.0), path, "2024-06-01", "x")
    sinks.demand(rows("B", 2.0), path, "2024-06-01", "x", str(tmp_path / "csv"))
    sinks.demand(rows("A", 3.0), path, "2024-06-01", "x")
    got = {r["entity_code"]: r["Load (MW)"] for r in spark.read.parquet(path).collect()}
    assert got == {"A": 3.0, "B": 2.0} and sinks.manifest(spark, path, ["entity_code"]).count() == 2
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.count() == 1


def test_nested_series_to_clean_rows(spark):
    """Text of a chart of several series, of which one is the demand, to UTC instants."""
    chart = '{"Chart": {"Series": [{"Name": "Programado", "Data": [{"Nombre": "2024/01/01 00:30", "Valor": 1.0}]}, {"Name": "Ejecutado", "Data": [{"Nombre": "2024/01/01 00:30", "Valor": 7.5}, {"Nombre": "2024/01/01 01:00", "Valor": null}, {"Nombre": "2024/01/01 01:30", "Valor": 8.0}]}]}}'
    pages = spark.createDataFrame([("PE", chart), ("PE", None), ("PE", '{"Chart": {"Series": []}}'), ("PE", '{"Chart": {"Series": [{"Name": "Ejecutado", "Data": []}]}}')], "code string, text string")
    landed = readers.nested_series(pages, "text", "Name string, Data array<struct<Nombre string, Valor double>>", ["Chart", "Series"], F.col("Name") == "Ejecutado", "Data", ["code"])
    got = sorted(tuple(r) for r in pipelines.retrieve(landed, "coes", "position").collect())
    assert got == [("PE", datetime(2024, 1, 1, 5, 30), 7.5), ("PE", datetime(2024, 1, 1, 6, 30), 8.0)]


def test_bounded_and_years(spark):
    df = spark.createDataFrame([(2019,), (2020,), (2021,), (None,)], "year int")
    count = lambda *limits: features.in_years(df, *limits).count()
    assert (count(), count(2020), count(None, 2019), count(2020, 2020), features.in_years(df.limit(0), 2020).count()) == (4, 2, 1, 1, 0)
    other = spark.range(2000, 2100).withColumnRenamed("id", "year")
    plan = lambda rows: other.join(bounded(df, rows), "year")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(4) and "strategy=broadcast" not in plan(3)
