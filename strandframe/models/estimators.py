"""Regressors as Spark ML pipelines: assembled features in, ``prediction`` out."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.splits import HASH_BITS, key_hash

MAX_DEPTH = 30  # deepest tree Spark ML grows; stands for "no limit"
VALIDATION_FLAG = "__validation"


def _assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")


def _subset(max_features) -> str:
    return str(max_features) if not isinstance(max_features, int) else str(int(max_features))


def checked_depth(max_depth: int | None) -> int:
    if max_depth is not None and max_depth > MAX_DEPTH:
        raise ValueError(f"max_depth {max_depth} is above {MAX_DEPTH}, the deepest tree Spark ML grows")
    return MAX_DEPTH if max_depth is None else max_depth


def forest_regressor(
    n_estimators: int = 100,
    max_depth: int | None = None,
    min_samples_leaf: int = 1,
    max_features: str | float | int = 0.7,
    bootstrap: bool = True,
    seed: int = 42,
    min_samples_split: int = 2,
) -> RandomForestRegressor:
    """Random forest.

    ``max_depth`` None means the most that Spark ML grows, 30; more than that is an error. A node of two
    rows may always be split: Spark ML knows no larger ``min_samples_split``, only the size of a leaf.
    """
    depth = checked_depth(max_depth)
    if min_samples_split > max(2, 2 * min_samples_leaf):
        raise ValueError(f"min_samples_split {min_samples_split} is not supported; min_samples_leaf bounds the size of a leaf")
    return RandomForestRegressor(
        featuresCol="features",
        labelCol="label",
        numTrees=n_estimators,
        maxDepth=depth,
        minInstancesPerNode=min_samples_leaf,
        featureSubsetStrategy=_subset(max_features),
        bootstrap=bootstrap,
        seed=seed,
    )


def forest(features: Sequence[str], **params) -> Pipeline:
    return Pipeline(stages=[_assembler(features), forest_regressor(**params)])


def boosted(
    features: Sequence[str],
    epochs: int = 15,
    learning_rate: float = 0.1,
    max_depth: int = 5,
    subsample: float = 1.0,
    early_stopping: bool = True,
    tolerance: float = 0.01,
    seed: int = 42,
) -> Pipeline:
    """Boosted trees on standardised inputs, stopped early on the flagged validation rows."""
    scaler = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)
    booster = GBTRegressor(
        featuresCol="features",
        labelCol="label",
        maxIter=epochs,
        stepSize=learning_rate,
        maxDepth=max_depth,
        subsamplingRate=subsample,
        validationTol=tolerance,
        seed=seed,
    )
    if early_stopping:
        booster = booster.setValidationIndicatorCol(VALIDATION_FLAG)
    return Pipeline(stages=[_assembler(features).setOutputCol("raw_features"), scaler, booster])


def linear(features: Sequence[str]) -> Pipeline:
    return Pipeline(
        stages=[_assembler(features), LinearRegression(featuresCol="features", labelCol="label")]
    )


def validation_flag(keys: Sequence[str], share: float = 0.2, seed: int = 42) -> Column:
    """True for the rows held out while boosting; decided by the row's key."""
    return key_hash(keys, seed) < F.lit(int(share * 2**HASH_BITS))


ESTIMATORS: dict[str, Callable[..., Pipeline]] = {
    "random_forest": forest,
    "boosted": boosted,  # the slot of the second, standardised-input regressor
    "linear": linear,
}


def estimator(name: str, features: Sequence[str], **params) -> Pipeline:
    if name not in ESTIMATORS:
        raise ValueError(f"unknown model '{name}'; available: {sorted(ESTIMATORS)}")
    return ESTIMATORS[name](features, **params)


def fit(pipeline: Pipeline, df: DataFrame, keys: Sequence[str] = (), seed: int = 42) -> PipelineModel:
    """Fit on rows with a ``label``; ``keys`` name a row when a validation part is held out."""
    regressor = pipeline.getStages()[-1]
    if regressor.hasParam("validationIndicatorCol") and regressor.isSet("validationIndicatorCol"):
        if not keys:
            raise ValueError("early stopping needs the row key columns")
        df = df.withColumn(VALIDATION_FLAG, validation_flag(keys, seed=seed))
    return pipeline.fit(df)


def feature_list(model: PipelineModel) -> list[str]:
    return model.stages[0].getInputCols()


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
