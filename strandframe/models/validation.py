"""Cross-validation and hyper-parameter search."""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import GROUP
from ..operators.metrics import CORE_METRICS, regression_metrics
from ..operators.splits import even_folds, hash_folds
from .estimators import checked_depth, fit, linear
from .scoring import score

# search name -> Spark ML parameter
SEARCH_PARAMETERS = {
    "n_estimators": "numTrees",
    "max_depth": "maxDepth",
    "min_samples_leaf": "minInstancesPerNode",
    "max_features": "featureSubsetStrategy",
    "bootstrap": "bootstrap",
    "epochs": "maxIter",
    "learning_rate": "stepSize",
    "subsample": "subsamplingRate",
}


def out_of_fold(
    build: Callable[[], Pipeline],
    df: DataFrame,
    folds: int,
    fold: str = "fold",
    keys: Sequence[str] = (),
    seed: int = 42,
) -> DataFrame:
    """Every row scored by the model that did not see its fold."""
    parts = []
    for i in range(folds):
        model = fit(build(), df.filter(F.col(fold) != i), keys, seed)
        parts.append(score(model, df.filter(F.col(fold) == i), "prediction", "uncertainty"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def summarize_folds(scored: DataFrame, metrics: Sequence[str] = CORE_METRICS, fold: str = "fold") -> DataFrame:
    """(metric, mean, std): mean and population std over folds, and mean uncertainty."""
    per_fold = regression_metrics(scored, "label", {"model": "prediction"}, by=[fold], metrics=metrics)
    columns = list(metrics)
    if "uncertainty" in scored.columns:
        spread = scored.groupBy(fold).agg(F.avg("uncertainty").alias("uncertainty_std"))
        per_fold = per_fold.join(spread, fold)
        columns.append("uncertainty_std")
    entries = [
        F.struct(
            F.lit(c).alias("metric"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")
        ).alias(c)
        for c in columns
    ]
    return per_fold.agg(*entries).select(F.inline(F.array(*columns)))


def cross_validate(
    build: Callable[[], Pipeline],
    df: DataFrame,
    folds: int = 5,
    group: str | None = GROUP,
    keys: Sequence[str] = (),
    seed: int = 42,
    metrics: Sequence[str] = CORE_METRICS,
) -> tuple[DataFrame, DataFrame]:
    """(summary, out-of-fold predictions). Folds keep groups whole, or are by row key."""
    placed = even_folds(df, folds, [group], seed) if group else hash_folds(df, folds, keys, seed)
    placed = placed.persist()  # read once per fold
    scored = out_of_fold(build, placed, folds, keys=keys or [group], seed=seed)
    return summarize_folds(scored, metrics), scored


def q_squared(df: DataFrame, features: Sequence[str], keys: Sequence[str], folds: int = 5, seed: int = 42) -> float:
    """Mean R2 over folds of a linear regression on the features."""
    # the folds and what is fitted on, alone: read twice per fold
    placed = hash_folds(df, folds, keys, seed).select("fold", "label", *features).persist()
    search = CrossValidator(
        estimator=linear(features),
        estimatorParamMaps=ParamGridBuilder().build(),
        evaluator=RegressionEvaluator(labelCol="label", metricName="r2"),
        numFolds=folds,
        foldCol="fold",
    )
    try:
        return float(search.fit(placed).avgMetrics[0])
    finally:
        placed.unpersist()


def _value(name: str, value):
    if name == "max_depth":
        return checked_depth(value)
    return str(value) if name == "max_features" else value


def parameter_sets(
    choices: Mapping[str, Sequence], n: int | None = None, seed: int = 42
) -> list[dict]:
    """All combinations, or ``n`` of them drawn without repetition."""
    names = list(choices)
    combos = [dict(zip(names, values, strict=True)) for values in itertools.product(*choices.values())]
    if n is None or n >= len(combos):
        return combos
    return random.Random(seed).sample(combos, n)


def search(
    pipeline: Pipeline,
    df: DataFrame,
    choices: Mapping[str, Sequence],
    n: int | None = None,
    folds: int = 3,
    fold_keys: Sequence[str] = (GROUP,),
    seed: int = 42,
    parallelism: int = 4,
) -> tuple[CrossValidatorModel, DataFrame]:
    """Grid (``n=None``) or random search by cross-validated mean squared error.

    Returns the fitted search, its best model inside, and (parameters, mse) per set.
    """
    regressor = pipeline.getStages()[-1]
    sets = parameter_sets(choices, n, seed)
    maps = [
        {regressor.getParam(SEARCH_PARAMETERS[k]): _value(k, v) for k, v in chosen.items()}
        for chosen in sets
    ]
    fitted = CrossValidator(
        estimator=pipeline,
        estimatorParamMaps=maps,
        evaluator=RegressionEvaluator(labelCol="label", metricName="mse"),
        numFolds=folds,
        foldCol="fold",
        parallelism=parallelism,
        seed=seed,
    ).fit(hash_folds(df, folds, fold_keys, seed))
    rows = [(str(chosen), float(mse)) for chosen, mse in zip(sets, fitted.avgMetrics, strict=True)]
    return fitted, df.sparkSession.createDataFrame(rows, "parameters string, mse double")
