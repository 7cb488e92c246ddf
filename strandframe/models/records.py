"""What a fit leaves behind as tables: importances of the inputs, and the history of boosting."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from .importance import built_in_importance
from .scoring import training_history

IMPORTANCES, HISTORY = "importances", "history"


def write_records(model: PipelineModel, df: DataFrame, path: str) -> list[str]:
    """Writes the tables that ``model`` has below ``path`` and names them; ``df`` are the rows of the fit.

    Trees have importances; boosted ones also a history, over flagged and other rows.
    """
    written = []
    regressor = model.stages[-1]
    if hasattr(regressor, "featureImportances"):
        built_in_importance(model, df).write.mode("overwrite").parquet(f"{path}/{IMPORTANCES}")
        written.append(IMPORTANCES)
    if hasattr(regressor, "evaluateEachIteration"):
        training_history(model, df).write.mode("overwrite").parquet(f"{path}/{HISTORY}")
        written.append(HISTORY)
    return written


def read_record(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")
