"""Each source's answer, as it is sent, to clean rows of UTC and MW."""

import json
from datetime import datetime, timedelta

import pytest

from gridloom.plans import pipelines
from gridloom.sources import landings, readers


def clean(landed, source, ordinal="ordinal"):
    return [tuple(r)[1:] for r in pipelines.retrieve(landed, source, ordinal).orderBy("ts").collect()]


def test_alberta(spark):
    areas = list(landings.ALBERTA_AREAS)
    ending = spark.createDataFrame([("CA_AB", "f1", n, f"2023-03-{12 + n // 24}", n % 24 + 1, *[float(n + 1)] * 6) for n in range(30)], "code string, file string, n long, DATE string, `HOUR ENDING` int, " + ", ".join(f"{a} double" for a in areas))
    got = clean(landings.alberta(ending, False), "aeso", "n")
    # an hour each, although clocks change within; six areas in sum
    assert got == [(datetime(2023, 3, 12, 8) + timedelta(hours=n), 6.0 * (n + 1)) for n in range(30)]
    for month, first in ((1, datetime(2024, 1, 1, 8)), (7, datetime(2024, 7, 1, 8))):
        begins = spark.createDataFrame([("CA_AB", "f3", n, datetime(2024, month, 1, n), *[None, 1.0, 2.0, 3.0, 4.0, 5.0]) for n in range(3)], "code string, file string, n long, DT_MST timestamp_ntz, " + ", ".join(f"{a.title()} double" for a in areas))
        assert clean(landings.alberta(begins, True), "aeso", "n") == [(first + timedelta(hours=n), 15.0) for n in range(3)]


def test_british_columbia(spark):
    rows = [("CA_BC", "2023", n, "2023-11-05", n + 1, v) for n, v in enumerate([5.0, 6.0, 0.0, None, 7.0])]
    sheet = spark.createDataFrame(rows, "code string, file string, n long, Date string, Hour int, Load double")
    assert clean(landings.british_columbia(sheet, "Date", "Hour", "Load"), "bchydro", "n") == [(datetime(2023, 11, 5, 8 + k), v) for k, v in enumerate((5.0, 6.0, 7.0))]


def test_mexico(spark):
    head = '"Sistema"," Area"," Hora"," Estimacion de Demanda por Balance (MWh) "'
    body = lambda k: "\n".join(f'"SIN","{a}",{h},{k + h}' for a in ("NTE", "NOR") for h in range(1, 25))
    twice = "\n".join(f'"SIN","NTE",{h},{h}' for h in range(1, 26))
    members = [
        ("MX_NTE", "z", "Demanda Dia del 2023-01-01 v1.csv", f"note\n\n{head}\n{body(100)}\n"),
        ("MX_NTE", "z", "Demanda Dia del 2023-01-01 v2.csv", f"note\n\n{head}\n\n"),  # the newest is empty
        ("MX_NTE", "z", "Demanda Dia del 2023-01-02 v1.csv", f"note\n{head}\n{body(200)}\n"),
        ("MX_NTE", "z", "Demanda Dia del 2023-01-02 v2.csv", f"note\n{head}\n{body(300)}\n"),
        ("MX_NTE", "z", "Demanda Dia del 2023-01-03 v1.csv", "no table here"),
        ("MX_BCA", "z", "Demanda Dia del 2023-01-01 v1.csv", f'{head}\n"BCA","x",1,9\n"BCA","y",2,8\n"SIN","BCA",1,7'),
    ]
    df = spark.createDataFrame(members, "code string, file string, member string, text string")
    got = pipelines.retrieve(landings.mexico(df), "cenace", "ordinal").orderBy("code", "ts").collect()
    assert [(r.ts, r.value) for r in got if r.code == "MX_BCA"] == [(datetime(2023, 1, 1, 7), 9.0), (datetime(2023, 1, 1, 8), 8.0)]
    own = [(r.ts, r.value) for r in got if r.code == "MX_NTE"]
    assert own == [(datetime(2023, 1, 1, 7) + timedelta(hours=h), (101.0 if h < 24 else 301.0) + h % 24) for h in range(48)]
    doubled = spark.createDataFrame([("MX_NTE", "z", "Demanda Dia del 2022-10-30 v1.csv", f"{head}\n{twice}")], df.schema)
    assert [(r.ordinal, r.load) for r in landings.mexico(doubled).orderBy("ordinal").collect()] == [(h, h + 1.0 if h < 2 else h + 2.0) for h in range(24)]


def test_great_britain(spark):
    text = json.dumps({"result": {"records": [{"ND": 100.0 + k} for k in range(4)]}})
    answers = spark.createDataFrame([("GB", 2023, text), ("GB", 2024, '{"result": {"records": []}}'), ("GB", 2025, None)], "code string, year int, text string")
    assert clean(landings.great_britain(answers), "neso") == [(datetime(2023, 1, 1) + timedelta(minutes=30 * (k + 1)), 100.0 + k) for k in range(4)]


def test_cyprus(spark):
    one = lambda d, h, m, g: f'var dateStr = "{d}"; var hourStr = "{h}"; var minutesStr = "{m}"; data.push([dateStrFormat, {g}]);'
    page = one("2024-01-01", "00", "15", "1, 2, 0, 3") + one("2024-01-01", "00", "30", "null, null, null, null") + one("2024-07-01", "12", "00", "1, 1, 90, 5")
    got = clean(landings.cyprus(spark.createDataFrame([("CY", page), ("CY", ""), ("CY", None)], "code string, text string")), "tsoc")
    assert got == [(datetime(2023, 12, 31, 22, 15), 6.0), (datetime(2024, 7, 1, 9), 90.0)]


def test_colombia(spark):
    text = json.dumps({"Items": [{"Date": d, "Values": {f"Hour{h:02d}": 1000.0 * h for h in range(1, 25)}} for d in ("2024-01-01", "2024-01-02")]})
    got = clean(landings.colombia(spark.createDataFrame([("CO", text), ("CO", '{"Items": []}')], "code string, text string")), "xm")
    assert got == [(datetime(2024, 1, 1, 6) + timedelta(hours=h), h % 24 + 1.0) for h in range(48)]


def test_algeria_and_brazil(spark):
    wide = spark.createDataFrame([("DZ", "2024-01-01", *[float(h) for h in range(1, 25)])], "code string, day string, " + ", ".join(f"`{h}h` double" for h in range(1, 25)))
    assert clean(landings.algeria(wide, "day"), "sonelgaz") == [(datetime(2024, 1, 1) + timedelta(hours=h), h + 1.0) for h in range(24)]
    rows = spark.createDataFrame([("BR_SE", "SE", "2024-01-01 00:00:00", 5.0, 0), ("BR_SE", "NE", "2024-01-01 00:00:00", 6.0, 1)], "code string, id_subsistema string, din_instante string, val_cargaenergiahomwmed double, ordinal int")
    assert clean(landings.brazil(rows), "ons") == [(datetime(2024, 1, 1, 4), 5.0)]


def test_csv_texts(spark):
    texts = spark.createDataFrame([("A", 'note\r\nx,y\r\n1,"a,b"\r\n\r\n2,c'), ("B", "note\nx,y"), ("C", "note"), ("D", ""), ("E", None)], "code string, text string")
    got = readers.csv_text(texts, "text", "x int, y string", 1, keep=["code"]).orderBy("ordinal").collect()
    assert [tuple(r) for r in got] == [("A", 0, 1, "a,b"), ("A", 2, 2, "c")]
    assert [tuple(r) for r in readers.csv_text(texts, "text", "x string", header=False, sep=";").filter("ordinal = 0 and x = 'note'").select("x").collect()] == [("note",)] * 3


def test_formats_of_a_source(spark):
    """Of an instant that both formats have, the first one's value counts; folds and gaps are missing in either; empty answers give none."""
    old = spark.createDataFrame([("CA_ON", "DateTime,OntarioDemand\n2002-04-30 22:00,1\n2002-04-30 23:00,2\n2002-04-07 02:00,9\n2001-10-28 01:00,9\n")], "code string, text string")
    new = spark.createDataFrame([("CA_ON", "a\nb\nc\nDate,Hour,Market Demand,Ontario Demand\n2002-05-01,1,0,3\n2002-05-01,2,0,4\n2002-05-01,2,0,5\n"), ("CA_ON", "")], "code string, text string")
    got = pipelines.retrieve_formats({"ieso": landings.ontario(old), "ieso_new": landings.ontario_years(new)}).orderBy("ts").collect()
    assert [(r.ts, r.value) for r in got] == [(datetime(2002, 5, 1, 3), 1.0), (datetime(2002, 5, 1, 4), 2.0), (datetime(2002, 5, 1, 5), 4.0)]
    with pytest.raises(ValueError, match="no formats"):
        pipelines.retrieve_formats({})
    texts = spark.createDataFrame([("AU_WA", "Trading Interval,Operational Demand (MW)\n2023-01-01 08:00:00,7\n")], "code string, text string")
    answers = spark.createDataFrame([("AU_WA", '{"data":{"data":[{"asAtTimeStamp":"2023-01-01T08:30:00+08:00","operationalDemand":8},{"asAtTimeStamp":"2023-01-01T09:00:00+08:00","operationalDemand":9}]}}'), ("AU_WA", "{}")], "code string, text string")
    got = pipelines.retrieve_formats({"aemo_wem": landings.western_australia(texts), "aemo_wem_new": landings.western_australia_days(answers)}).orderBy("ts").collect()
    assert [(r.ts, r.value) for r in got] == [(datetime(2023, 1, 1, 0, 30), 7.0), (datetime(2023, 1, 1, 1), 9.0)]
