import json

import pytest
from pyspark.sql import functions as F

from gridloom.sources import retrieval as R


def flaky(fails, then="[1]"):
    calls = []

    def fetch(request):
        calls.append(request)
        if len(calls) <= fails:
            raise ConnectionError("reset")
        return then

    return fetch, calls


def test_asking_again():
    pauses = []
    fetch, calls = flaky(3)
    assert R.ask(fetch, {"a": 1}, 5, 2.0, 7.0, pauses.append) == ("data", 4, None, "[1]") and pauses == [2.0, 4.0, 7.0] and len(calls) == 4
    pauses.clear()
    assert R.ask(flaky(9)[0], {}, 3, 1.0, sleep=pauses.append) == ("failed", 3, "ConnectionError: reset", None) and pauses == [1.0, 2.0]

    def none(_):
        raise R.NoData

    def wrong(_):
        raise KeyError("x")

    assert R.ask(none, {}) == ("none", 1, None, None) and R.ask(wrong, {}, sleep=pauses.append) == ("failed", 1, "KeyError: 'x'", None)


def requests_of(spark, years=(2022, 2023), months=6):
    return spark.createDataFrame([(c, y, m) for c in ("A", "B") for y in years for m in range(months)], "code string, year int, month int")


def parse(df):
    return df.select("code", "year", "month", F.explode(F.from_json("body", "array<double>")).alias("value"))


def test_outcomes_are_rows(spark):
    def fetch(r):
        if r["month"] == 1:
            raise R.NoData
        if r["month"] == 2:
            raise TimeoutError("late")
        return json.dumps([r["year"] + r["month"] / 10])

    rows = R.fetched(requests_of(spark), fetch, 2, 0.0, 3).collect()
    assert len(rows) == 24 and {(r.month, r.outcome, r.attempts) for r in rows if r.month < 3} == {(0, "data", 1), (1, "none", 1), (2, "failed", 2)}
    assert all((r.body is None) == (r.outcome != "data") and (r.error is None) == (r.outcome != "failed") for r in rows)
    assert R.fetched(requests_of(spark).limit(0), fetch).count() == 0


def test_a_run_that_dies_is_taken_up(spark, tmp_path):
    """Half of the batches' writes fail; the next run asks for what is left only, and one year is still open."""
    path, log = str(tmp_path / "out"), tmp_path / "log"
    log.mkdir()

    def fetch(r):
        (log / f"{r['code']}-{r['year']}-{r['month']}-{len(list(log.iterdir()))}").touch()
        return json.dumps([r["year"] * 100.0 + r["month"]])

    def asked():
        names = sorted(tuple(p.name.split("-")[:3]) for p in log.iterdir())
        for p in log.iterdir():
            p.unlink()
        return names

    seen = []

    def dies(df):
        seen.append(1)
        if len(seen) == 2:
            raise RuntimeError("the driver is gone")
        return parse(df)

    keys, part, requests = ["code", "year", "month"], ["code", "year"], requests_of(spark)
    with pytest.raises(RuntimeError):
        R.run(requests, fetch, dies, path, keys, part, batches=4, delay=0.0)
    asked()
    done = {(r.code, r.year) for r in R.manifest(spark, path).collect()}
    assert len(done) < 4
    R.run(requests, fetch, parse, path, keys, part, batches=4, delay=0.0)
    assert {(a, int(b)) for a, b, _ in asked()} == {(c, y) for c in "AB" for y in (2022, 2023)} - done
    table = lambda: sorted((r.code, r.year, r.month, r.value) for r in spark.read.parquet(f"{path}/data").collect())
    want = sorted((c, y, m, y * 100.0 + m) for c in "AB" for y in (2022, 2023) for m in range(6))
    assert table() == want
    # nothing is left but the open year, whose partitions are replaced and no others
    R.run(requests, lambda r: json.dumps([-1.0]), parse, path, keys, part, still_open=F.col("year") == 2023, delay=0.0)
    assert table() == [(c, y, m, v if y == 2022 else -1.0) for c, y, m, v in want]


def test_failed_requests_keep_their_partition(spark, tmp_path):
    path, keys, part, requests = str(tmp_path / "out"), ["code", "year", "month"], ["code", "year"], requests_of(spark, (2022,), 3)

    def some(r):
        if r["code"] == "B" and r["month"] == 1:
            raise ConnectionError("reset")
        if r["month"] == 2:
            raise R.NoData
        return "[1.0]"

    first = {(r.code, r.month): r.outcome for r in R.run(requests, some, parse, path, keys, part, retries=2, delay=0.0).collect()}
    assert first["B", 1] == "failed" and first["A", 2] == "none" and {r.code for r in spark.read.parquet(f"{path}/data").collect()} == {"A"}
    assert {r.code for r in R.pending(spark, requests, path, keys).collect()} == {"B"}
    again = R.run(requests, lambda r: "[2.0]", parse, path, keys, part, delay=0.0).collect()
    assert {r.code for r in again} == {"B"} and sorted((r.code, r.value) for r in spark.read.parquet(f"{path}/data").collect()) == [("A", 1.0), ("A", 1.0), ("B", 2.0), ("B", 2.0), ("B", 2.0)]
    assert R.pending(spark, requests, path, keys).count() == 0
