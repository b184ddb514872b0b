"""Gradient-boosted regression trees of second order, of which one for each left-out group grows at once.

Rows are binned once, and rows of equal bins, group and label are counted as one. Each level of all models' trees is one aggregation: sums
of gradients and Hessians by model, node, feature and bin; a model does not see its own group's rows. The driver takes the best cuts from
these sums, of which there are at most models x 2^depth x features x bins. Trees go back as one row a model, broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import lineage_cut

#: Models whose trees and sums may be held by the driver.
MOST_GROUPS = 1000
#: A tree: for nodes 1, 2, 3, ... (2k and 2k + 1 are below k) the feature, the last bin that goes left, and the value of those that are leaves.
Tree = tuple[list[int], list[int], list[float]]


@dataclass
class Boosted:
    """group values by model (None for the model of all rows), start values, and the trees of each round by model; edges: of each feature's bins."""

    features: Sequence[str]
    edges: list[list[float]]
    groups: list
    start: list[float]
    depth: int
    rounds: list[list[Tree]] = field(default_factory=list)
    gain: list[dict[int, float]] = field(default_factory=list)

    def importances(self, model: int = 0) -> list[tuple[str, float]]:
        """Features by their share of the gain in a model's trees."""
        own = self.gain[model]
        total = sum(own.values()) or 1.0
        return sorted(((f, own.get(k, 0.0) / total) for k, f in enumerate(self.features)), key=lambda p: -p[1])

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """df with the prediction of the first model."""
        binned = df.withColumn("_bins", _bins(self.features, self.edges))
        total = F.lit(self.start[0])
        for trees in self.rounds:
            f, b, v = (F.array(*map(F.lit, part)) for part in trees[0])
            total = total + _value(_descend(f, b, self.depth), v)
        return binned.withColumn(out, total).drop("_bins")


def _bins(features: Sequence[str], edges: list[list[float]]) -> Column:
    """The bin of each feature's value: how many edges lie below it. Null and NaN are in a bin of their own, the last."""

    def one(name: str, own: list[float]) -> Column:
        x = F.col(name).cast("double")
        below = F.size(F.filter(F.array(*map(F.lit, own)), lambda e: e < x)) if own else F.lit(0)
        return F.when(x.isNull() | F.isnan(x), F.lit(len(own) + 1)).otherwise(below)

    return F.array(*[one(f, own) for f, own in zip(features, edges)])


def _descend(feature: Column, cut: Column, depth: int) -> Column:
    """The node that a row with `_bins` comes to in a tree; a node without a feature (-1) is a leaf, where it stays."""
    node = F.lit(1)
    for _ in range(depth):
        f = F.element_at(feature, node)
        node = F.when(f < 0, node).otherwise(2 * node + (F.element_at("_bins", f + 1) > F.element_at(cut, node)).cast("int"))
    return node


def _value(node: Column, values: Column) -> Column:
    return F.element_at(values, node)


def _best(sums: dict[tuple[int, int], tuple[float, float]], penalty: float, least: float) -> tuple[float, int, int]:
    """(gain, feature, last bin to the left) of the best cut; feature -1 if none gains. Gains that differ by rounding only count as equal: the first cut wins."""
    g = sum(s[0] for (f, _), s in sums.items() if f == 0)
    h = sum(s[1] for (f, _), s in sums.items() if f == 0)
    best, at, gl, hl = (1e-9, -1, -1), -1, 0.0, 0.0
    for f, b in sorted(sums):
        if f != at:
            at, gl, hl = f, 0.0, 0.0
        gl, hl = gl + sums[f, b][0], hl + sums[f, b][1]
        if hl < least or h - hl < least:
            continue
        gain = gl * gl / (hl + penalty) + (g - gl) ** 2 / (h - hl + penalty) - g * g / (h + penalty)
        if gain > best[0] * (1 + 1e-9):
            best = gain, f, b
    return best


def fit(df: DataFrame, features: Sequence[str], label: str = "target", group: str | None = None, trees: int = 100, depth: int = 6, rate: float = 0.3, bins: int = 64, penalty: float = 1.0, least: float = 1.0) -> tuple[Boosted, DataFrame]:
    """The models, and the rows (group, label, rows, model, prediction, own) as the fit saw them: own is whether the model has left the row's group out.

    Without a group there is one model of all rows. Rows without a label are not read. Squared loss; the Hessian of a row is 1."""
    spark = df.sparkSession
    rows = df.filter(F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double")))
    shares = [(k + 1) / bins for k in range(bins - 1)]
    found = rows.agg(*[F.percentile_approx(F.col(f).cast("double"), shares, 10_000).alias(f"e{k}") for k, f in enumerate(features)]).first()
    edges = [sorted({float(e) for e in found[f"e{k}"] or []}) for k in range(len(features))]
    key = F.col(group) if group else F.lit(0)
    groups = sorted(r[0] for r in rows.select(key).distinct().filter(key.isNotNull()).limit(MOST_GROUPS + 1).collect()) if group else [None]
    if len(groups) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups to leave out")
    own = rows.select(key.alias("_g"), F.col(label).cast("double").alias("_y"), _bins(features, edges).alias("_bins"))
    counted = lineage_cut(own.groupBy("_g", "_y", "_bins").agg(F.count(F.lit(1)).alias("_w")))
    total = {r["_g"]: (r["y"], r["w"]) for r in counted.groupBy("_g").agg(F.sum(F.col("_y") * F.col("_w")).alias("y"), F.sum("_w").alias("w")).collect()}
    y, w = (sum(t[i] for t in total.values()) for i in (0, 1))
    less = [total.get(g, (0.0, 0)) if group else (0.0, 0) for g in groups]
    start = [(y - a) / (w - b) if w > b else 0.0 for a, b in less]
    model = Boosted(features, edges, groups, start, depth, gain=[{} for _ in groups])
    held = F.array_position(F.array(*map(F.lit, groups)), F.col("_g")) - 1 if group else F.lit(-1)
    state = counted.withColumn("_own", F.coalesce(held, F.lit(-1))).withColumn("_m", F.explode(F.sequence(F.lit(0), F.lit(len(groups) - 1))))
    state = state.withColumn("_p", F.element_at(F.array(*map(F.lit, start)), (F.col("_m") + 1).cast("int")))
    state = lineage_cut(state)
    for _ in range(trees):
        grown = _grow(spark, state, len(groups), len(features), model, depth, rate, penalty, least)
        if grown is None:
            break
        state = lineage_cut(_with_tree(state, spark, grown, depth).withColumn("_p", F.col("_p") + F.element_at("_v", F.col("_node"))).drop("_f", "_b", "_v", "_node"))
    seen = state.select(F.col("_g").alias(group or "_g"), F.col("_y").alias(label), F.col("_w").alias("rows"), F.col("_m").alias("model"), F.col("_p").alias("prediction"), (F.col("_own") == F.col("_m")).alias("own"))
    return model, seen


def _with_tree(state: DataFrame, spark: SparkSession, grown: list[Tree], depth: int) -> DataFrame:
    table = spark.createDataFrame([(m, *t) for m, t in enumerate(grown)], "_m int, _f array<int>, _b array<int>, _v array<double>")
    return state.join(F.broadcast(table), "_m").withColumn("_node", _descend(F.col("_f"), F.col("_b"), depth))  # a row a model, at most MOST_GROUPS


def _grow(spark: SparkSession, state: DataFrame, models: int, features: int, model: Boosted, depth: int, rate: float, penalty: float, least: float) -> list[Tree] | None:
    """The next tree of each model, level by level; None if none of them gains."""
    size = (2 << depth) - 1
    grown: list[Tree] = [([-1] * size, [-1] * size, [0.0] * size) for _ in range(models)]
    gained = False
    train = state.filter("_own <> _m")
    for level in range(depth):
        placed = _with_tree(train, spark, grown, level) if level else train.withColumn("_node", F.lit(1))
        each = placed.filter(F.col("_node") >= 1 << level).select("_m", "_node", (F.col("_w") * (F.col("_p") - F.col("_y"))).alias("g"), "_w", F.posexplode("_bins").alias("f", "b"))
        sums: dict[tuple[int, int], dict[tuple[int, int], tuple[float, float]]] = {}
        for r in each.groupBy("_m", "_node", "f", "b").agg(F.sum("g").alias("g"), F.sum("_w").alias("h")).collect():
            sums.setdefault((r["_m"], r["_node"]), {})[r["f"], r["b"]] = r["g"], float(r["h"])
        for (m, node), own in sums.items():
            gain, f, b = _best(own, penalty, least)
            if f >= 0:
                gained = True
                model.gain[m][f] = model.gain[m].get(f, 0.0) + gain
                grown[m][0][node - 1], grown[m][1][node - 1] = f, b
                for child, side in ((2 * node, [s for (x, y), s in own.items() if x == f and y <= b]), (2 * node + 1, [s for (x, y), s in own.items() if x == f and y > b])):
                    grown[m][2][child - 1] = -rate * sum(s[0] for s in side) / (sum(s[1] for s in side) + penalty)
    if not gained:
        return None
    model.rounds.append(grown)
    return grown


def leave_one_group_out(df: DataFrame, group: str, features: Sequence[str], label: str = "target", **settings: float) -> DataFrame:
    """group, train_mae, test_mae of a model for each group, fitted on the others; all models grow together."""
    model, seen = fit(df, features, label, group, **settings)
    miss = F.col("rows") * F.abs(F.col("prediction") - F.col(label))
    mae = lambda own: F.sum(F.when(F.col("own") == own, miss)) / F.sum(F.when(F.col("own") == own, F.col("rows")))
    errors = seen.groupBy("model").agg(mae(False).alias("train_mae"), mae(True).alias("test_mae"))
    kind = dict(df.dtypes)[group]
    names = df.sparkSession.createDataFrame(list(enumerate(model.groups)), f"model int, `{group}` {kind}")
    return errors.join(F.broadcast(names), "model").select(group, "train_mae", "test_mae").orderBy(F.desc("test_mae"))
