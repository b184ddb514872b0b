from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from gridloom.functions import time as T
from gridloom.operators import series

ZONE = "America/New_York"


@pytest.fixture(scope="module")
def half_hours(spark):
    """A year of half hours in local New York time; values by position, with a pair and a single value missing."""
    start = datetime(2023, 1, 1, 5)
    rows = [("a", start + timedelta(minutes=30 * k), None if k in (2, 3, 10) else float(k)) for k in range(17520)]
    return spark.createDataFrame(rows, "code string, ts timestamp_ntz, value double").cache()


def nulls(df):
    return df.filter("value is null").count()


def test_missing_step_comes_back(half_hours):
    out = series.fill_calendar(half_hours.filter("value is null or value <> 20"), ["code"], ZONE)
    assert out.count() == 17520 and nulls(out) == 4


def test_complete_series_stays(half_hours):
    out = series.fill_calendar(half_hours, ["code"], ZONE)
    assert out.count() == 17520 and nulls(out) == 3


def test_hourly(half_hours):
    out = series.resample(half_hours, ["code"], 60, ZONE)
    assert out.count() == 8760 and out.filter("ts = timestamp_ntz'2023-01-01 07:00:00'").first()["value"] == 4.5
    assert series.resample(out, ["code"], 30, ZONE).count() == 8760  # coarser than asked for: stays


def test_isolated_gap(half_hours):
    out = series.interpolate(half_hours, ["code"])
    assert nulls(out) == 2 and out.filter("ts = timestamp_ntz'2023-01-01 10:00:00'").first()["value"] == 10.0


def test_harmonize(half_hours):
    out = series.harmonize(half_hours, ["code"], ZONE)
    assert out.count() == 8760 and nulls(out) == 0


def test_clean_keeps_the_first(spark):
    t = datetime(2024, 1, 1)
    rows = [("a", t, 1.0, 2), ("a", t, 5.0, 1), ("a", None, 1.0, 3), ("a", t + timedelta(hours=1), 0.0, 4), ("a", t + timedelta(hours=2), None, 5), ("a", t + timedelta(hours=3), float("nan"), 6), ("b", t, 7.0, 7)]
    df = spark.createDataFrame(rows, "code string, ts timestamp_ntz, value double, ordinal int")
    assert sorted((r["code"], r["value"]) for r in series.clean(df, ["code"]).collect()) == [("a", 5.0), ("b", 7.0)]
    assert series.clean(df, ["code"], drop_zero=False).count() == 3


def test_expected_quality(half_hours):
    got = {r["metric"]: r["n"] for r in series.quality(half_hours.union(half_hours.limit(5)), ["code"]).collect()}
    assert got == {"rows": 17525, "missing": got["missing"], "duplicates": 5} and got["missing"] >= 3
    assert {r["step"]: r["n"] for r in series.step_histogram(half_hours, ["code"]).collect()} == {1_800_000_000: 17519}


@pytest.mark.parametrize("zone", ["America/New_York", "Europe/Paris", "Asia/Kathmandu", "Australia/Adelaide", "Pacific/Auckland", "America/Santiago", "UTC", "Australia/Lord_Howe"])
def test_localize_against_zoneinfo(spark, zone):
    """Every quarter hour of a year: folds and gaps are null, the rest is the one instant."""
    z = ZoneInfo(zone)
    rows = []
    for k in range(4 * 24 * 366):
        local = datetime(2024, 1, 1) + timedelta(minutes=15 * k)
        a, b = (local.replace(tzinfo=z, fold=f).astimezone(ZoneInfo("UTC")).replace(tzinfo=None) for f in (0, 1))
        exists = (a.replace(tzinfo=ZoneInfo("UTC")).astimezone(z).replace(tzinfo=None)) == local
        rows.append((local, a if a == b and exists else None))
    df = spark.createDataFrame(rows, "local timestamp_ntz, want timestamp_ntz").withColumn("got", T.localize(F.col("local"), zone, "null", "null"))
    assert df.filter("not (want <=> got)").count() == 0


def test_localize_policies(spark):
    fold, gap = datetime(2024, 11, 3, 1, 30), datetime(2024, 3, 10, 2, 30)
    df = spark.createDataFrame([(fold, 1), (fold, 2), (gap, 1)], "t timestamp_ntz, n int")
    own = lambda **k: [r[0] for r in df.select(T.localize(F.col("t"), ZONE, **k)).collect()]
    five, six = datetime(2024, 11, 3, 5, 30), datetime(2024, 11, 3, 6, 30)
    assert own(ambiguous="earlier", nonexistent="null") == [five, five, None]
    assert own(ambiguous="later", nonexistent="forward") == [six, six, datetime(2024, 3, 10, 7, 30)]
    assert own(ambiguous="infer", nonexistent="null", occurrence=F.col("n")) == [five, six, None]
    for policies in ({"ambiguous": "raise", "nonexistent": "null"}, {"ambiguous": "null", "nonexistent": "raise"}):
        with pytest.raises(Exception, match="local time"):
            own(**policies)
    with pytest.raises(ValueError):
        own(ambiguous="infer")


def test_dst_minutes(spark):
    df = spark.createDataFrame([(datetime(2024, 7, 1),), (datetime(2024, 1, 1),)], "t timestamp_ntz")
    assert [r[0] for r in df.select(T.dst_minutes(F.col("t"), ZONE)).collect()] == [60, 0]
    assert [r[0] for r in df.select(T.dst_minutes(F.col("t"), "Australia/Sydney")).collect()] == [0, 60]


def test_expand_years_covers_local_years(spark):
    df = spark.createDataFrame([("a", 2023, 1.0), ("a", 2025, 3.0)], "code string, year int, v double")
    out = series.expand_years(df, ["code"], "v", "Europe/Paris")
    assert out.count() == 8760 * 2 + 8784 and out.filter("year = 2024 and v is not null").count() == 0
    assert out.agg(F.min("ts")).first()[0] == datetime(2022, 12, 31, 23)


@pytest.fixture(scope="module")
def odd(spark):
    """Irregular times over days without rows, a null entity, rows without a time, missing values, a repeated time."""
    start = datetime(2024, 3, 1, 22)
    rows = [(c, start + timedelta(minutes=k * k * m), None if k % 3 == 1 else float(k), k) for c, m in (("a", 7), ("b", 90), (None, 13)) for k in range(40)]
    return spark.createDataFrame([*rows, ("a", None, None, 40), ("b", start, 5.0, 41), ("c", start, 1.0, 42)], "code string, ts timestamp_ntz, value double, n int").cache()


def test_blocks_see_what_an_entity_sees(odd):
    by = {}
    for r in odd.filter("ts is not null").collect():
        by.setdefault(r["code"], []).append(r)
    steps, filled = {}, {}
    for rows in by.values():
        rows.sort(key=lambda r: (r["ts"], r["n"]))
        for k, r in enumerate(rows):
            steps[r["n"], r["code"]] = (r["ts"] - rows[k - 1]["ts"]) // timedelta(microseconds=1) if k else None
            around = [rows[j]["value"] for j in (k - 1, k + 1) if 0 <= j < len(rows)]
            filled[r["n"], r["code"]] = r["value"] if r["value"] is not None else sum(around) / 2 if len(around) == 2 and None not in around else None
    single = odd.filter("n <> 41")  # which of two rows of one time comes first is open
    got = {(r["n"], r["code"]): r for r in series.interpolate(series.steps(odd, ["code"]), ["code"]).collect()}
    assert len(got) == 123 and got[40, "a"]["step"] is None and got[40, "a"]["value"] is None
    assert {k: r["step"] for k, r in got.items() if k[0] not in (0, 40, 41)} == {k: v for k, v in steps.items() if k[0] not in (0, 41)}
    assert {(r["n"], r["code"]): r["value"] for r in series.interpolate(single, ["code"]).collect() if r["n"] not in (0, 1, 40)} == {k: v for k, v in filled.items() if k[0] not in (0, 1, 41)}
    assert series.interpolate(odd.limit(0), ["code"]).count() == 0 and set(series.interpolate(odd, ["code"]).columns) == set(odd.columns)


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_positions(odd, width):
    got = {(r["code"], r["n"]): r["position"] for r in series.position(odd, ["code"], ["n"], F.floor(F.col("n") / width)).collect()}
    want = {}
    for code in ("a", "b", "c", None):
        for k, n in enumerate(sorted(r["n"] for r in odd.collect() if r["code"] == code)):
            want[code, n] = k
    assert got == want


@pytest.mark.parametrize("most", [0, 200_000])
def test_percentiles(spark, most):
    import numpy as np

    values = {"skewed": [3.0] * 500 + [1e9, -1e9, 4.0, 3.5], "one": [2.0], "flat": [1.0] * 7, None: [float(k * k % 101) for k in range(997)]}
    rows = [(c, v) for c, vs in values.items() for v in vs] + [("one", None), ("one", float("nan")), ("none", None)]
    shares = {"p00": 0.0, "p05": 0.05, "p50": 0.5, "p999": 0.999, "p100": 1.0}
    got = {r["code"]: r for r in series.percentiles(spark.createDataFrame(rows, "code string, v double"), ["code"], "v", shares, most=most).collect()}
    assert set(got) == {*values, "none"} and got["none"]["p50"] is None
    for code, vs in values.items():
        for n, q in shares.items():
            assert got[code][n] == pytest.approx(np.quantile(vs, q)), (code, n)
