"""The demand model: features, boosted trees, leave-one-group-out validation, projection, rescaling, validation of records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators import boosting

#: The record's fields, their types, and the range that each must be in.
RECORD = {
    "is_weekend": ("int", 0, 1),
    "hour": ("int", 0, 24),
    "month": ("int", 1, 12),
    "month_temp_avg": ("double", None, None),
    "month_temp_rank": ("int", 1, 12),
    "year_electricity_demand_per_capita": ("double", 0, None),
    "year_gdp_ppp": ("double", 0, None),
    "year_temp_percentile_5": ("double", None, None),
    "year_temp_percentile_95": ("double", None, None),
    "year_temp_top3": ("double", None, None),
}
POSITIVE = ("year_electricity_demand_per_capita", "year_gdp_ppp")


def violations(fields: dict[str, tuple] = RECORD) -> Column:
    """The names of the fields that are null or out of range."""
    out = []
    for name, (_, low, high) in fields.items():
        bad = F.col(name).isNull()
        if low is not None:
            bad |= F.col(name) <= low if name in POSITIVE else F.col(name) < low
        if high is not None:
            bad |= F.col(name) > high
        out.append(F.when(bad, F.lit(name)))
    return F.array_compact(F.array(*out))


def validated(df: DataFrame, fields: dict[str, tuple] = RECORD) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the others with their `violations`."""
    marked = df.withColumn("violations", violations(fields))
    return marked.filter(F.size("violations") == 0).drop("violations"), marked.filter(F.size("violations") > 0)


def assemble(demand: DataFrame, temperature: DataFrame, annual: Sequence[DataFrame], code: str = "code", position: str = "position") -> DataFrame:
    """Demand and temperature by code and position in the year, with annual tables by code."""
    out = demand.join(temperature, [code, position])
    for table in annual:
        out = out.join(table, code)
    return out


def regressor(features: Sequence[str], label: str = "target", trees: int = 100, depth: int = 6, rate: float = 0.3, seed: int = 42) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip"), GBTRegressor(featuresCol="features", labelCol=label, maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed)])


def importances(model: PipelineModel, features: Sequence[str]) -> list[tuple[str, float]]:
    return sorted(zip(features, map(float, model.stages[-1].featureImportances.toArray())), key=lambda p: -p[1])


def mae_by_group(predicted: DataFrame, group: str, label: str = "target", prediction: str = "prediction") -> DataFrame:
    return predicted.groupBy(group).agg(F.avg(F.abs(F.col(prediction) - F.col(label))).alias("mae"), F.count(F.lit(1)).alias("n"))


def leave_one_group_out(df: DataFrame, group: str, features: Sequence[str], label: str = "target", **settings: float) -> DataFrame:
    """group, train_mae, test_mae: a model for each group, fitted on the others; see `boosting.fit` for the settings."""
    return boosting.leave_one_group_out(df, group, features, label, **settings)


def project(weather: DataFrame, annual: DataFrame, first: int = 2020, last: int = 2100, step: int = 5, code: str = "code") -> DataFrame:
    """The weather year's rows for every projection year, with that year's annual values: the years are joined by key, not crossed."""
    return weather.drop("year").join(annual.filter(F.col("year").between(first, last) & ((F.col("year") - first) % step == 0)), code)


def mean_power(annual_twh: Column, hours: int | Column = 8760) -> Column:
    """Mean MW of an annual energy in TWh."""
    return annual_twh * F.lit(1e6) / hours


def denormalize(predicted: DataFrame, annual: DataFrame, code: str = "code", prediction: str = "prediction", energy: str = "twh") -> DataFrame:
    """Load in MW: the prediction, a multiple of the mean, times the year's mean power."""
    return predicted.join(annual.select(code, "year", energy), [code, "year"]).withColumn("load_mw", F.col(prediction) * mean_power(F.col(energy))).drop(energy)


def score(records: DataFrame, model: PipelineModel) -> DataFrame:
    """Batch inference on valid records."""
    return model.transform(validated(records)[0]).drop("features")


def load(path: str) -> PipelineModel:
    """The saved model; a path without one is a RuntimeError, all other failures are what they are."""
    try:
        return PipelineModel.load(path)
    except Exception as e:
        if "does not exist" not in str(e) and "PATH_NOT_FOUND" not in str(e):
            raise
        raise RuntimeError(f"no model at {path}") from e


def without_null_columns(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """df without the columns that hold any null, by one aggregation; columns to keep stay."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if c in keep or not row[c]])
