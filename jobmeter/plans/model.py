"""Cross-validated energy regression with folds by user."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.base import Estimator
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobmeter.constants import FEATURE_COLUMNS, FOLDS, MAX_SAMPLES, SEED, TARGET_COLUMN
from jobmeter.operators.sampling import fold_samples, group_folds
from jobmeter.plans.features import model_inputs
from jobmeter.session import materialize


def fold_metrics(predictions: DataFrame) -> DataFrame:
    """MAE and RMSE per fold and overall (fold -1), in one pass."""
    error = F.col("y_true") - F.col("y_pred")
    return (
        predictions.rollup("fold")
        .agg(
            F.grouping_id().alias("_all"),
            F.avg(F.abs(error)).alias("mae"),
            F.sqrt(F.avg(error * error)).alias("rmse"),
            F.count("*").alias("rows"),
        )
        .select(F.when(F.col("_all") == 1, -1).otherwise(F.col("fold")).alias("fold"), "mae", "rmse", "rows")
    )


def default_regressor(seed: int = SEED) -> Estimator:
    return RandomForestRegressor(
        featuresCol="features", labelCol=TARGET_COLUMN, predictionCol="y_pred",
        numTrees=20, maxDepth=8, seed=seed,
    )


def _known_columns(data: DataFrame, columns: list[str]) -> list[str]:
    """The columns with at least one known value."""
    known = data.agg(*[F.count(F.nanvl(F.col(c), F.lit(None))).alias(c) for c in columns]).first()
    return [c for c in columns if known[c]]


def cross_validate(
    features: DataFrame,
    k: int = FOLDS,
    max_samples: int = MAX_SAMPLES,
    seed: int = SEED,
    ignore_limits: bool = False,
    regressor: Estimator | None = None,
    mode: str = "greedy",
) -> DataFrame:
    """Out-of-fold predictions (job_key, user, fold, y_true, y_pred); a user is in one fold only.

    Every row with a known target is predicted. ``max_samples`` bounds only the rows that a fold's
    model is fitted on. A feature with no known value in a fold's fitted rows is left out of that fold's model.

    The model table is written once to the shared folder, and so is one hash per row, which gives the
    samples of all folds; each fold's fit is a distributed job and the predictions stay distributed.
    """
    extra = [c for c in ("JobID",) if c in features.columns]
    data = materialize(group_folds(model_inputs(features, extra), k, mode=mode), "model")
    columns = [c for c in FEATURE_COLUMNS if c in data.columns]
    held_out = None
    if ignore_limits:
        samples = [data.where(F.col("fold") != fold) for fold in range(k)]
    else:
        samples = fold_samples(data, k, max_samples, seed, ["job_key", *extra])
    for fold, fitted in enumerate(samples):
        fitted = fitted if ignore_limits else materialize(fitted, "fitted")
        known = _known_columns(fitted, columns)
        filled = [f"{c}_filled" for c in known]
        steps = [
            Imputer(inputCols=known, outputCols=filled),
            VectorAssembler(inputCols=filled, outputCol="features", handleInvalid="keep"),
            regressor or default_regressor(seed),
        ]
        model = Pipeline(stages=steps).fit(fitted)
        part = model.transform(data.where(F.col("fold") == fold)).select(
            "job_key", F.col("User").cast("int").alias("user"), "fold",
            F.col(TARGET_COLUMN).alias("y_true"), "y_pred",
        )
        held_out = part if held_out is None else held_out.unionByName(part)
    return held_out
