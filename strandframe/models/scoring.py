"""Predictions, their uncertainty, evaluation of several models, training history."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import z_score
from ..operators.metrics import (
    DEFAULT_METRICS,
    abs_error_column,
    error_column,
    predicted_column,
    regression_metrics,
    uncertainty_column,
)
from ..operators.splits import HASH_BITS, key_hash
from .estimators import VALIDATION_FLAG, estimator, fit
from .trees import leaf_table, leaf_values, node_table, tree_chunks

# Leaf values shipped in one literal (8 MB).
LEAVES_PER_LITERAL = 1_000_000


def predict(model: PipelineModel, df: DataFrame, name: str = "prediction") -> DataFrame:
    """Add one prediction column and nothing else."""
    scored = model.transform(df)
    return scored.select(*df.columns, F.col("prediction").alias(name))


def predict_with_std(
    model: PipelineModel,
    df: DataFrame,
    name: str = "prediction",
    std_name: str = "uncertainty",
    leaves_per_literal: int = LEAVES_PER_LITERAL,
) -> DataFrame:
    """Forest prediction and the population std over its trees.

    The forest reports the leaf a row falls into; leaf values, which are part of the model every
    executor holds anyway, are taken from its node table and looked up in arrays of a bounded size.
    """
    *before, forest = model.stages
    ready = PipelineModel(before).transform(df)
    leaf_column = forest.copy().setLeafCol("__leaf")
    known = leaf_table(node_table(df.sparkSession, forest))
    trees = forest.getNumTrees
    placed = leaf_column.transform(ready).withColumn("__leaf", vector_to_array("__leaf"))
    pieces = []
    for j, (start, end) in enumerate(tree_chunks(known, leaves_per_literal)):
        table = f"__values_{j}"
        placed = placed.withColumn(table, leaf_values(known, start, end))
        leaves = F.slice("__leaf", start + 1, end - start)
        pieces.append(
            F.zip_with(leaves, F.col(table), lambda leaf, of_tree: F.get(of_tree, leaf.cast("int")))
        )
    scored = placed.withColumn("__trees", F.concat(*pieces) if len(pieces) > 1 else pieces[0])
    n = F.lit(float(trees))
    zero = F.lit(0.0)
    mean = F.aggregate("__trees", zero, lambda s, x: s + x) / n
    scored = scored.withColumn("__mean", mean)
    spread = F.aggregate(
        "__trees", zero, lambda s, x: s + (x - F.col("__mean")) * (x - F.col("__mean"))
    )
    return scored.select(
        *df.columns, F.col("__mean").alias(name), F.sqrt(spread / n).alias(std_name)
    )


def subsample_rows(df: DataFrame, keys: Sequence[str], share: float, seed: int) -> DataFrame:
    """About ``share`` of the rows, decided by the row's key: the same rows however often they are computed."""
    return df.filter(key_hash(keys, seed) < F.lit(int(share * 2**HASH_BITS)))


def fit_ensemble(
    name: str, df: DataFrame, features: Sequence[str], keys: Sequence[str], size: int = 5,
    subsample: float = 0.7, seed: int = 42, **params,
) -> list[PipelineModel]:
    """The same regressor fitted ``size`` times, each on its own subsample of the rows and with its own seed.

    Members differ by the rows that they saw; the seed of a subsample is another one than that of the
    rows held out while boosting.
    """
    return [
        fit(estimator(name, features, seed=seed + i, **params), subsample_rows(df, keys, subsample, seed + 1 + i), keys, seed)
        for i in range(size)
    ]


def ensemble_predict(
    models: Sequence[PipelineModel], df: DataFrame, name: str = "prediction", std_name: str = "uncertainty"
) -> DataFrame:
    """Mean and population std over an ensemble's predictions."""
    scored = reduce(lambda d, m: predict(m[1], d, f"__p{m[0]}"), enumerate(models), df)
    columns = [F.col(f"__p{i}") for i in range(len(models))]
    mean = reduce(lambda a, b: a + b, columns) / len(models)
    scored = scored.withColumn(name, mean)
    spread = reduce(lambda a, b: a + b, [(c - F.col(name)) * (c - F.col(name)) for c in columns])
    return scored.select(*df.columns, name, F.sqrt(spread / len(models)).alias(std_name))


def has_tree_spread(model) -> bool:
    return not isinstance(model, list) and type(model.stages[-1]).__name__.startswith("RandomForest")


def score(model, df: DataFrame, name: str, std_name: str) -> DataFrame:
    """Prediction with uncertainty where the model has one."""
    if isinstance(model, list):
        return ensemble_predict(model, df, name, std_name)
    if has_tree_spread(model):
        return predict_with_std(model, df, name, std_name)
    return predict(model, df, name)


def score_new_data(
    model, df: DataFrame, target: str, with_uncertainty: bool = False, with_quality: bool = False
) -> DataFrame:
    """Predictions for new rows; errors, or z-scores, where the target is known."""
    predicted, sigma = f"{target}_predicted", f"{target}_uncertainty"
    if not with_uncertainty:
        plain = model[0] if isinstance(model, list) else model
        scored = predict(plain, df, predicted)
        if target not in df.columns:
            return scored
        error = F.col(predicted) - F.col(target)
        return scored.withColumns({f"{target}_error": error, f"{target}_abs_error": F.abs(error)})
    scored = score(model, df, predicted, sigma)
    if with_quality and target in df.columns and sigma in scored.columns:
        z = z_score(F.col(predicted), F.col(target), F.col(sigma))
        scored = scored.withColumn(f"{target}_z_score", z)
    return scored


def score_models(models: dict, df: DataFrame, actual: str = "label") -> DataFrame:
    """All models' predictions, errors and uncertainties as columns of one table."""
    scored = df
    for name, model in models.items():
        scored = score(model, scored, predicted_column(name), uncertainty_column(name))
        error = F.col(predicted_column(name)) - F.col(actual)
        scored = scored.withColumns(
            {error_column(name): error, abs_error_column(name): F.abs(error)}
        )
    return scored


def evaluate_models(
    models: dict, df: DataFrame, actual: str = "label", metrics: Sequence[str] = DEFAULT_METRICS,
    n_features: int | None = None, features: Sequence[str] = (), keys: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """(metrics per model, scored rows).

    ``q2`` among the metrics is the cross-validated R2 of a linear regression on ``features`` with folds by
    ``keys``: a measure of the rows, the same for every model.
    """
    scored = score_models(models, df, actual)
    names = {m: predicted_column(m) for m in models}
    others = [m for m in metrics if m != "q2"]
    table = regression_metrics(scored, actual, names, metrics=others, n_features=n_features)
    if "q2" in metrics:
        from .validation import q_squared

        if not features or not keys:
            raise ValueError("q2 needs the feature and key columns")
        q2 = q_squared(df.withColumn("label", F.col(actual)), features, keys)
        table = table.withColumn("q2", F.lit(q2)).select("model", "n", *metrics)
    return table, scored


def training_history(model: PipelineModel, df: DataFrame) -> DataFrame:
    """(epoch, part, metric, value): loss and R2 per boosting round, training and validation rows."""
    *before, booster = model.stages
    ready = PipelineModel(before).transform(df)
    rows = []
    for part, flag in (("train", False), ("val", True)):
        chosen = ready.filter(F.col(VALIDATION_FLAG) == flag)
        variance = chosen.agg(F.var_pop("label")).first()[0]
        for epoch, loss in enumerate(booster.evaluateEachIteration(chosen, "squared")):
            rows.append((epoch, part, "loss", float(loss)))
            rows.append((epoch, part, "r2", 1 - loss / variance if variance else None))
    return df.sparkSession.createDataFrame(rows, "epoch int, part string, metric string, value double")


def fit_conditions(fit_one, conditions: Sequence[int | str]) -> tuple[dict, dict]:
    """Fit every condition in turn; a failing one is recorded and the rest go on."""
    fitted, failed = {}, {}
    for condition in conditions:
        try:
            fitted[condition] = fit_one(condition)
        except Exception as problem:  # noqa: BLE001 - reported to the caller per condition
            failed[condition] = str(problem)
    return fitted, failed
