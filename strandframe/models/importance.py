"""Feature importance: the forest's own, and by permutation."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import r2
from ..operators.splits import hash_order
from .estimators import feature_list


def built_in_importance(model: PipelineModel, df: DataFrame) -> DataFrame:
    """(feature, importance), summing to 1."""
    values = model.stages[-1].featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(feature_list(model), values, strict=True)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def rotations(n: int, n_repeats: int, seed: int) -> list[int]:
    """A shift per repeat in 1..n-1 (0 if there is one row), from md5 of its number and the seed."""
    if n < 2:
        return [0] * n_repeats
    hashed = [int(hashlib.md5(f"repeat-{i}-{seed}".encode()).hexdigest()[:13], 16) for i in range(n_repeats)]
    return [1 + h % (n - 1) for h in hashed]


def permutation_importance(
    model: PipelineModel, df: DataFrame, keys: Sequence[str], n_repeats: int = 10, seed: int = 42
) -> DataFrame:
    """Mean drop in R2 when one feature is shuffled across rows.

    Rows are numbered once, in the order of a hash of their key. In each repeat a row's donor is the row
    a fixed number of places further on, around the end, so a repeat is a permutation and one join on the
    place serves all of them. All features of all repeats are scored in one pass.
    """
    names = feature_list(model)
    *before, regressor = model.stages
    ready = PipelineModel(before).transform(df)
    base, n = regressor.transform(ready).agg(r2(F.col("label"), F.col("prediction")), F.count(F.lit(1))).first()

    rows = ready.select(*keys, "label", vector_to_array("features").alias("__x"))
    numbered = hash_order(rows, keys, seed, "__place").select("__place", "label", "__x")
    shifts = F.array(*[F.lit(s).cast("long") for s in rotations(n, n_repeats, seed)])
    own = numbered.select("label", "__x", "__place", F.posexplode(shifts).alias("repeat", "__shift")).withColumn(
        "__place", F.pmod(F.col("__place") + F.col("__shift"), F.lit(max(1, n)))
    )
    donors = numbered.select("__place", F.col("__x").alias("__donor"))
    swapped = own.join(donors, "__place").withColumn("__j", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1)))).select(
        "repeat",
        "__j",
        "label",
        array_to_vector(
            F.transform("__x", lambda x, i: F.when(i == F.col("__j"), F.get("__donor", i)).otherwise(x))
        ).alias("features"),
    )
    scores = (
        regressor.transform(swapped)
        .groupBy("__j", "repeat")
        .agg(r2(F.col("label"), F.col("prediction")).alias("__r2"))
    )
    feature = F.array(*[F.lit(n) for n in names])[F.col("__j")]
    return (
        scores.groupBy("__j")
        .agg(F.avg(F.lit(base) - F.col("__r2")).alias("importance"))
        .select(feature.alias("feature"), "importance")
    )
