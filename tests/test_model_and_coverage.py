import pytest
from pyspark.sql import functions as F

from gridloom.operators import coverage, forecast
from gridloom.streaming import demand


def test_indicators(spark):
    long = spark.createDataFrame([("FRA", 2020, "Demand", 500.0), ("FRA", 2020, "Demand per capita", 7.0), ("FRA", 2021, "Demand", 510.0), ("FRA", 2020, "Other", 1.0)], "`ISO 3 code` string, Year int, Variable string, Value double")
    got = {r["year"]: (r["twh"], r["capita"]) for r in coverage.indicator(long, {"Demand": "twh", "Demand per capita": "capita"}).collect()}
    assert got == {2020: (500.0, 7.0), 2021: (510.0, None)}
    wide = spark.createDataFrame([("FRA", "x", 1.0, None)], "`Country Code` string, note string, `2015.0` double, `2016` double")
    assert [tuple(r) for r in coverage.unpivot_years(wide, "Country Code").collect()] == [("FRA", 2015, 1.0)]


def test_record_ranges(spark):
    good = dict(is_weekend=0, hour=3, month=12, month_temp_avg=280.0, month_temp_rank=1, year_electricity_demand_per_capita=5.0, year_gdp_ppp=1.0, year_temp_percentile_5=1.0, year_temp_percentile_95=2.0, year_temp_top3=1.0)
    schema = ", ".join(f"{k} {v[0]}" for k, v in forecast.RECORD.items())
    rows = [good, good | {"hour": 25, "month": 0}, good | {"year_gdp_ppp": 0.0}, good | {"is_weekend": None}]
    df = spark.createDataFrame([tuple(r[k] for k in forecast.RECORD) for r in rows], schema)
    ok, bad = forecast.validated(df)
    assert ok.count() == 1 and sorted(sorted(r["violations"]) for r in bad.collect()) == [["hour", "month"], ["is_weekend"], ["year_gdp_ppp"]]


def test_model_learns_and_leaves_groups_out(spark):
    df = spark.range(600).select((F.col("id") % 3).alias("g"), (F.col("id") % 24).alias("hour"), F.rand(1).alias("noise")).withColumn("target", (F.col("hour") > 12).cast("double") + 0.01 * F.col("noise"))
    got = forecast.leave_one_group_out(df, "g", ["hour", "noise"], trees=3, depth=3).collect()
    assert len(got) == 3 and all(r["test_mae"] < 0.3 for r in got)
    model = forecast.regressor(["hour", "noise"], trees=3, depth=3).fit(df)
    assert forecast.importances(model, ["hour", "noise"])[0][0] == "hour"


def test_projection(spark):
    weather = spark.createDataFrame([("A", 2019, 1, 2.0)], "code string, year int, position int, prediction double")
    annual = spark.createDataFrame([("A", y, 8.76) for y in range(2019, 2031)], "code string, year int, twh double")
    out = forecast.denormalize(forecast.project(weather, annual.drop("twh"), 2020, 2030), annual)
    assert sorted((r["year"], r["load_mw"]) for r in out.collect()) == [(y, pytest.approx(2000.0)) for y in (2020, 2025, 2030)]


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("SELECT 'a' AS k, timestamp_ntz'2024-01-01 00:10:00' + make_dt_interval(id div 4, 0, 0) AS ts, double(id % 4) AS value FROM range(80)").write.parquet(src)
    stream = spark.readStream.schema("k string, ts timestamp_ntz, value double").parquet(src)
    q = demand.first_only(stream, "k").writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("firsts").count() == 20
    q = demand.hourly_mean(stream, "k").writeStream.format("memory").queryName("means").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert 0 < spark.table("means").count() <= 20 and spark.table("means").filter("value <> 1.5").count() == 0
