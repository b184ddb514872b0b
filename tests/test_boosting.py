import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import boosting, forecast, fuzzy


def rows_of(n=240, seed=1):
    r = random.Random(seed)
    rows = [("abcd"[k % 4], float(r.randint(0, 9)), r.choice([None, 1.0, 2.5, 7.0]), float(r.randint(0, 3))) for k in range(n)]
    return [(g, a, b, c, 3.0 * (a > 4) - 2.0 * ((b or 0) > 2) + 0.3 * c + r.gauss(0, 0.2) + "abcd".index(g)) for g, a, b, c in rows]


def plain(rows, left_out, trees, depth, rate, features=(1, 2, 3)):
    """Predictions of all rows by boosting written plainly, on values instead of bins; missing values are greater than all others."""
    number = lambda x: float("inf") if x is None else x
    train = [k for k, r in enumerate(rows) if r[0] != left_out]
    base = sum(rows[k][4] for k in train) / len(train)
    pred = [base] * len(rows)

    def grow(own, every, depth):
        g, h = sum(pred[k] - rows[k][4] for k in own), len(own)
        best = (1e-9, None)
        for f in features if depth else ():
            for cut in sorted({number(rows[k][f]) for k in own}):
                left = [k for k in own if number(rows[k][f]) <= cut]
                if not left or len(left) == len(own):
                    continue
                gl = sum(pred[k] - rows[k][4] for k in left)
                gain = gl**2 / (len(left) + 1) + (g - gl) ** 2 / (h - len(left) + 1) - g * g / (h + 1)
                if gain > best[0] * (1 + 1e-9):
                    best = (gain, (f, cut))
        if best[1] is None:
            return {k: -rate * g / (h + 1) for k in every}
        f, cut = best[1]
        step = {}
        for side in (True, False):
            at = lambda ks: [k for k in ks if (number(rows[k][f]) <= cut) == side]
            step |= grow(at(own), at(every), depth - 1)
        return step

    for _ in range(trees):
        step = grow(train, range(len(rows)), depth)
        for k, v in step.items():
            pred[k] += v
    return pred


@pytest.mark.parametrize("trees, depth", [(1, 1), (3, 2)])
def test_models_of_all_groups_equal_plain_boosting(spark, trees, depth):
    rows = rows_of()
    df = spark.createDataFrame(rows, "g string, a double, b double, c double, target double")
    got = {r.g: (r.train_mae, r.test_mae) for r in forecast.leave_one_group_out(df, "g", ["a", "b", "c"], trees=trees, depth=depth, rate=0.5, bins=256).collect()}
    assert set(got) == set("abcd")
    for g in got:
        pred = plain(rows, g, trees, depth, 0.5)
        for held, mae in zip((False, True), got[g]):
            miss = [abs(p - r[4]) for p, r in zip(pred, rows) if (r[0] == g) == held]
            assert mae == pytest.approx(sum(miss) / len(miss), abs=1e-6)


def test_one_model_predicts_new_rows(spark):
    rows = rows_of(600)
    df = spark.createDataFrame(rows, "g string, a double, b double, c double, target double")
    model, seen = boosting.fit(df, ["a", "b", "c"], trees=12, depth=3, rate=0.3)
    fresh = spark.createDataFrame(rows_of(200, 5), "g string, a double, b double, c double, target double").withColumn("target", F.col("target"))
    error, spread = fresh_error(model, fresh), fresh.agg(F.stddev("target")).first()[0]
    assert error < 0.85 * spread and seen.agg(F.sum("rows")).first()[0] == 600
    best = model.importances()
    assert best[0][0] == "a" and sum(s for _, s in best) == pytest.approx(1)


def fresh_error(model, df):
    return model.predict(df).agg(F.sqrt(F.avg((F.col("prediction") - F.col("target")) ** 2))).first()[0]


def test_odd_tables(spark):
    schema = "g string, a double, target double"
    empty = spark.createDataFrame([], schema)
    assert forecast.leave_one_group_out(empty, "g", ["a"], trees=2, depth=2).count() == 0
    one = spark.createDataFrame([("x", 1.0, 2.0), ("x", None, 2.0), ("x", 3.0, None), (None, float("nan"), 4.0)], schema)
    got = forecast.leave_one_group_out(one, "g", ["a"], trees=2, depth=2).collect()
    assert [(r.g, r.test_mae) for r in got] == [("x", 2.0)]  # the model of what is left knows the row without a group only
    same = spark.createDataFrame([("x", 1.0, 2.0), ("y", 1.0, 2.0)], schema)
    assert [tuple(r)[1:] for r in forecast.leave_one_group_out(same, "g", ["a"], trees=2).collect()] == [(0.0, 0.0)] * 2


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("distance", [1, 2])
def test_nearest_names(spark, distance):
    r = random.Random(3)
    word = lambda: "".join(r.choices("abc", k=r.randint(0, 6)))
    known, asked = [word() for _ in range(60)] + [None, "côte", "日本語"], [(k, word()) for k in range(80)] + [(80, None), (81, "cote"), (82, "日語"), (83, ""), (0, "abc")]
    rows = fuzzy.nearest_names(spark.createDataFrame(asked, "k long, asked string"), spark.createDataFrame([(n,) for n in known], "name string"), distance).collect()
    best = lambda a: min(((edits(a, n), n) for n in known if n is not None and edits(a, n) <= distance), default=(None, None)) if a is not None else (None, None)
    assert sorted((r.k, r.asked or "", r.distance, r.name) for r in rows) == sorted((k, a or "", *best(a)) for k, a in asked)


def test_neighbourhoods_are_not_broadcast(spark):
    """Their size is far beyond the planner's estimate, which is that of the names."""
    names = spark.range(100).select(F.concat(F.lit("Customer#"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("name"))
    found = fuzzy.nearest_names(names.select(F.lit(1).alias("k"), F.concat("name", F.lit("x")).alias("asked")), names)
    plan = found._jdf.queryExecution().optimizedPlan().toString() + found._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "_part" in line and "Exec" not in line]
    assert any("SortMergeJoin" in j for j in joins) and not any("Broadcast" in j for j in joins)
    assert [(r.asked, r.name, r.distance) for r in found.orderBy("asked").take(2)] == [("Customer#000000000x", "Customer#000000000", 1), ("Customer#000000001x", "Customer#000000001", 1)]
