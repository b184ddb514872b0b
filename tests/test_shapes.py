import struct

from pyspark.sql import functions as F

from gridloom.operators import grid, overlay, registry
from gridloom.sources import readers, shapefile, sinks

SCHEMA = "code string, name string, rings " + overlay.RINGS


def box(w, s, e, n, hole=False):
    corners = [(w, s), (e, s), (e, n), (w, n)]
    return [{"x": float(x), "y": float(y)} for x, y in (corners[::-1] if hole else corners)]


def test_shapefiles_go_round(spark, tmp_path):
    rows = [(f"C{k:03d}", f"Näme {k} 日本", [box(k, 0, k + 1, 2), box(k + 0.25, 0.5, k + 0.5, 1, hole=True)][: 1 + k % 2]) for k in range(50)]
    shapes = spark.createDataFrame([*rows, ("none", "x", []), ("null", "y", None), (None, None, [box(99, 1, 100, 2)])], SCHEMA).repartition(7)
    path = str(tmp_path / "made.shp")
    assert shapefile.write(shapes, path) == 51
    spark.dataSource.register(shapefile.ShapefileSource)
    back = spark.read.format("shp").option("path", path).load()
    area = lambda df: {r.code: round(r.area, 9) for r in overlay.measured(df).collect()}
    want = area(shapes.filter("size(rings) > 0").withColumn("code", F.coalesce("code", F.lit(""))))
    assert area(back) == want and back.count() == 51
    assert {r.code: r.name for r in back.collect()} == {c: n for c, n, _ in rows} | {"": ""}
    data, index = (tmp_path / "made.shp").read_bytes(), (tmp_path / "made.shx").read_bytes()
    assert struct.unpack_from(">i", data, 24)[0] * 2 == len(data) and len(index) == 100 + 8 * 51
    assert struct.unpack_from("<4d", data, 36) == (0.0, 0.0, 100.0, 2.0)
    for k in range(51):  # the index leads to each record, whose number is its place
        at, words = struct.unpack_from(">2i", index, 100 + 8 * k)
        assert struct.unpack_from(">2i", data, 2 * at) == (k + 1, words)
    assert shapefile.write(shapes.limit(0), str(tmp_path / "none.shp")) == 0
    assert spark.read.format("shp").option("path", str(tmp_path / "none.shp")).load().count() == 0


def test_entity_shapes(spark):
    standard = spark.createDataFrame([("ES", "ESP", "Spain", [box(-8, 37, 3, 43), box(-18, 28, -14, 29)]), ("US-TX", "", "Texas", [box(-106, 26, -94, 36)]), ("IT", "ITA", "Italy", [box(7, 37, 18, 46)])], "iso string, adm string, name string, rings " + overlay.RINGS)
    special = spark.createDataFrame([("US_TEX", [box(-104, 27, -95, 36)]), ("IT", [box(0, 0, 1, 1)])], "code string, rings " + overlay.RINGS)
    wanted = spark.createDataFrame([("ES", "Spain"), ("US_TEX", "Texas"), ("IT", "Italy"), ("XX", "Nowhere")], "code string, name string")
    got = {r.code: r.rings for r in grid.entity_shapes(wanted, standard, special, ["iso", "adm"], ["name"]).collect()}
    assert set(got) == {"ES", "US_TEX", "IT"} and len(got["ES"]) == 1  # without far islands
    assert min(p["x"] for p in got["US_TEX"][0]) == -104 and min(p["x"] for p in got["IT"][0]) == 7  # a country's shape is the standard one
    kept = grid.entity_shapes(wanted, standard, special, ["iso", "adm"], ["name"], islands=True)
    assert {r.code: len(r.rings) for r in kept.collect()}["ES"] == 2


def test_folders():
    text = "logs_folder: logs\ndata_folder: &d data\nweather_folder:\n- *d\n- weather\n"
    assert registry.folders(text, "/srv/x/") == {"logs_folder": "/srv/x/logs", "data_folder": "/srv/x/data", "weather_folder": "/srv/x/data/weather", "root_folder": "/srv/x/"}


def test_skipped_lines_of_split_files(spark, tmp_path):
    """Files of many splits, with empty lines above and among the rows."""
    for f in range(3):
        (tmp_path / f"f{f}.csv").write_text("note\n\nmore notes;x\na;b\n" + "".join(f"{k};row {f}\n" + "\n" * (k % 50 == 0) for k in range(2000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = readers.csv(spark, str(tmp_path), "a int, b string", ";", skip=3)
        assert df.rdd.getNumPartitions() >= 3
        got = df.groupBy("b").agg(F.count("*").alias("n"), F.sum("a").alias("s"), F.min("a").alias("lo")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(map(tuple, got)) == [(f"row {f}", 2000, 1999000, 0) for f in range(3)]


def test_projections_by_country(spark, tmp_path):
    df = spark.createDataFrame([(c, y, p, 1.0 * p) for c in "AB" for y in (2025, 2030) for p in range(3)], "code string, year int, position int, load_mw double")
    sinks.projections(df, str(tmp_path / "p"))
    assert sorted(p.name for p in (tmp_path / "p").iterdir() if p.is_dir()) == ["code=A", "code=B"]
    back = spark.read.parquet(str(tmp_path / "p"))
    assert back.count() == 12 and back.filter("code = 'A' and year = 2030").agg(F.sum("load_mw")).first()[0] == 3.0
