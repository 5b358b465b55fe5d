"""Training sets, one regressor per target, errors, scoring and backtests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thermofleet.functions.timekeys import add_seconds
from thermofleet.operators.aggregates import filled_fraction
from thermofleet.operators.asof import lookup_actual
from thermofleet.operators.grid import horizon_value
from thermofleet.operators.track import Track, numbered


def training_set(grid: DataFrame, targets: Sequence[str], steps: Sequence[int], step_seconds: int = 300) -> DataFrame:
    """Wide grid with the value of every target `h` steps ahead as `{target}_t+{h}`."""
    return horizon_value(grid, ["site_id"], targets, steps, step_seconds)


def kept_targets(df: DataFrame, columns: Sequence[str], minimum: float = 0.5) -> DataFrame:
    """Targets with enough known rows per site."""
    return filled_fraction(df, columns, minimum=minimum).filter("kept")


def chronological_split(df: DataFrame, fraction: float = 0.8, ts: str = "ts", tie: Sequence[str] = ()) -> DataFrame:
    """Mark the first `fraction` of each site's rows as training rows (row counts, not time).

    The rank is a position on the chunked track, not one window per site.
    """
    placed = numbered(df, Track(("site_id",), ts, tuple(tie)), "__n")
    sizes = df.groupBy("site_id").agg(F.count(F.lit(1)).alias("__all"))
    return placed.join(sizes, ["site_id"]).withColumn(
        "is_train", F.col("__n") <= F.floor(F.col("__all") * fraction)
    ).drop("__n", "__all")


def regressor(features: Sequence[str], label: str, rounds: int = 20, depth: int = 5, seed: int = 42) -> Pipeline:
    """Boosted trees on imputed features with missing-value marks."""
    filled = [f"{c}__filled" for c in features]
    marks = [f"{c}__missing" for c in features]
    return Pipeline(stages=[
        Imputer(inputCols=list(features), outputCols=filled),
        VectorAssembler(inputCols=filled + marks, outputCol="__features"),
        GBTRegressor(featuresCol="__features", labelCol=label, maxIter=rounds, maxDepth=depth, seed=seed),
    ])


def with_marks(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Missing feature columns appear as NULL; every feature gets a 0/1 mark of being missing."""
    absent = {c: F.lit(None).cast("double") for c in features if c not in df.columns}
    full = df.withColumns(absent) if absent else df
    return full.withColumns({f"{c}__missing": F.col(c).isNull().cast("double") for c in features})


def train(df: DataFrame, features: Sequence[str], targets: Sequence[str], rounds: int = 20, depth: int = 5) -> dict[str, PipelineModel]:
    """One model per target, on the rows whose target is known and which the split marked for training."""
    marked = with_marks(df, features)
    return {
        t: regressor(features, t, rounds, depth).fit(marked.filter(F.col("is_train") & F.col(t).isNotNull())) for t in targets
    }


def score(models: Mapping[str, PipelineModel], df: DataFrame, features: Sequence[str]) -> DataFrame:
    out = with_marks(df, features)
    for target, model in models.items():
        scored = model.transform(out).withColumnRenamed("prediction", f"pred_{target}")
        out = scored.drop("__features", *[f"{c}__filled" for c in features])
    return out.drop(*[f"{c}__missing" for c in features])


def errors(scored: DataFrame, targets: Sequence[str], by: Sequence[str] = ("site_id",)) -> DataFrame:
    """RMSE, MAE and count per target on the rows not used for training."""
    items = F.array(*[
        F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("actual"), F.col(f"pred_{t}").alias("predicted")) for t in targets
    ])
    rows = scored.filter(~F.col("is_train")).select(*by, F.explode(items).alias("e")).select(*by, "e.*").filter(
        F.col("actual").isNotNull()
    )
    miss = F.col("predicted") - F.col("actual")
    return rows.groupBy(*by, "target").agg(
        F.sqrt(F.avg(miss * miss)).alias("rmse"), F.avg(F.abs(miss)).alias("mae"), F.count(F.lit(1)).alias("n_val")
    )


def override_scenarios(df: DataFrame, scenarios: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """Every row once per named scenario with the scenario's columns replaced. Scenarios are a literal array, so
    rows are expanded in place without a join."""
    columns = sorted({c for s in scenarios.values() for c in s})
    items = F.array(*[
        F.struct(F.lit(n).alias("scenario"), *[F.lit(s.get(c)).cast("double").alias(f"__{c}") for c in columns])
        for n, s in scenarios.items()
    ])
    spread = df.withColumn("__s", F.explode(items)).select(*df.columns, "__s.*")
    return spread.withColumns({c: F.coalesce(F.col(f"__{c}"), F.col(c).cast("double")) for c in columns}).drop(*[f"__{c}" for c in columns])


def scenario_deltas(scored: DataFrame, prediction: str, keys: Sequence[str], base: str = "all_off") -> DataFrame:
    """Prediction of each scenario minus the all-off one of the same row."""
    of_base = F.max(F.when(F.col("scenario") == base, F.col(prediction))).over(Window.partitionBy(*keys))
    return scored.withColumn("delta", F.col(prediction) - of_base)


def every_nth(df: DataFrame, n: int = 3, ts: str = "ts", tie: Sequence[str] = ()) -> DataFrame:
    """Rows 1, n+1, 2n+1 … of each site's time order."""
    placed = numbered(df, Track(("site_id",), ts, tuple(tie)), "__n")
    return placed.filter((F.col("__n") - 1) % n == 0).drop("__n")


def backtest(predictions: DataFrame, observed: DataFrame, value: str = "value", step_seconds: int = 300) -> DataFrame:
    """Predictions `(site_id, ts, room, horizon_steps, pred)` with the actual value at their target time (exact,
    else within three minutes) and the error."""
    asked = predictions.withColumn("target_ts", add_seconds(F.col("ts"), F.col("horizon_steps") * step_seconds))
    found = lookup_actual(asked, observed, ["site_id", "room"], value)
    return found.withColumn("error", F.col("pred") - F.col("actual"))


def importances(models: Mapping[str, PipelineModel], features: Sequence[str], spark) -> DataFrame:
    """`(target, feature, gain)`: one row per model and feature, from the models' own summaries."""
    rows = []
    names = [*features, *[f"{c}__missing" for c in features]]
    for target, model in models.items():
        weights = model.stages[-1].featureImportances
        rows += [(target, names[i], float(weights[i])) for i in range(len(names))]
    return spark.createDataFrame(rows, "target string, feature string, gain double")

