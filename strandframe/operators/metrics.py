"""Regression metrics, rank correlation and uncertainty calibration.

All models of a table are scored in one aggregate; rows are never repeated per model.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..columns import GROUP, POSITION, is_numeric_condition
from ..functions.numeric import complete, paired, pearson, ratio, to_number
from ..functions.significance import correlation_p_value
from .radix import even_cuts
from .ranking import aggregate_with_medians, default_buckets, with_bucket
from .skew import count_hot_groups, match_keys

CORE_METRICS = ("rmse", "mae", "r2", "pearson_correlation")
# Reported by default, as the usual evaluation settings do.
DEFAULT_METRICS = (*CORE_METRICS, "pearson_p_value", "spearman_correlation", "spearman_p_value",
                   "root_mean_square_absolute_error")
ALL_METRICS = (*DEFAULT_METRICS, "explained_variance", "max_error", "median_absolute_error",
               "adjusted_r2", "temperature_coefficient")


# Rows of one group that a task may rank; the products of its ranks sum up within a long.
RANKED_GROUP_ROWS = 1_000_000


def predicted_column(model: str) -> str:
    return f"{model}_predicted"


def error_column(model: str) -> str:
    return f"{model}_error"


def abs_error_column(model: str) -> str:
    return f"{model}_abs_error"


def uncertainty_column(model: str) -> str:
    return f"{model}_uncertainty"


def add_errors(df: DataFrame, models: Sequence[str], actual: str) -> DataFrame:
    """Signed and absolute error of every model."""
    signed = {error_column(m): F.col(predicted_column(m)) - F.col(actual) for m in models}
    absolute = {abs_error_column(m): F.abs(F.col(predicted_column(m)) - F.col(actual)) for m in models}
    return df.withColumns(signed | absolute)


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg((y - p) * (y - p)))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def r2(y: Column, p: Column) -> Column:
    """1 - SSE / SST. A constant target scores 1 if met exactly, else 0; one row: null."""
    yy, pp = paired(y, p)
    sse = F.sum((yy - pp) * (yy - pp))
    sst = F.var_pop(yy) * F.count(yy)
    flat = F.when(sse == 0, 1.0).otherwise(0.0)
    return F.when(F.count(yy) > 1, F.when(sst == 0, flat).otherwise(1 - ratio(sse, sst)))


def explained_variance(y: Column, p: Column) -> Column:
    yy, pp = paired(y, p)
    left, whole = F.var_pop(yy - pp), F.var_pop(yy)
    return F.when(whole == 0, F.when(left == 0, 1.0).otherwise(0.0)).otherwise(1 - ratio(left, whole))


def adjusted_r2(y: Column, p: Column, n_features: int) -> Column:
    n = F.count(paired(y, p)[0])
    return 1 - ratio((1 - r2(y, p)) * (n - 1), n - n_features - 1)


def temperature_coefficient(y: Column, p: Column, temperature: int) -> Column:
    """Correlation of predictions with the target scaled by temperature / 400."""
    return pearson(p, y * temperature / 400)


def _scores(y: Column, p: Column, n_features: int | None, condition) -> dict[str, Column]:
    scores = {
        "rmse": rmse(y, p),
        "mae": mae(y, p),
        "r2": r2(y, p),
        "pearson_correlation": pearson(y, p),
        "explained_variance": explained_variance(y, p),
        "max_error": F.max(F.abs(y - p)),
        "root_mean_square_absolute_error": rmse(y, p),
    }
    if n_features is not None:
        scores["adjusted_r2"] = adjusted_r2(y, p, n_features)
    if condition is not None and is_numeric_condition(condition):
        scores["temperature_coefficient"] = temperature_coefficient(y, p, int(condition))
    return scores


def rank_correlation(
    df: DataFrame, a: str, b: str, by: Sequence[str] = (), name: str = "spearman_correlation"
) -> DataFrame:
    """Spearman correlation with tied values sharing their mean rank."""
    return rank_correlations(df, a, {"": b}, by, name).drop("model")


def rank_correlations(
    df: DataFrame, actual: str, predictions: dict[str, str], by: Sequence[str] = (), name: str = "spearman_correlation"
) -> DataFrame:
    """(by, model, n, correlation) of the actual value with every prediction, over their complete pairs.

    All models are ranked side by side: one pass for the cut points of all columns, then equal pairs are
    counted, so a frequent pair is moved once, and the counted pairs are ranked bucket by bucket on either side.
    """
    if by and count_hot_groups(df, by, RANKED_GROUP_ROWS) == 0:
        return _rank_correlations_in_groups(df, actual, predictions, by, name)
    # a sum with 0.0 makes -0.0 the 0.0 that it equals
    columns = {"__a": actual, **{f"__b{i}": column for i, column in enumerate(predictions.values())}}
    numbers = df.select(*by, *[(to_number(c) + F.lit(0.0)).alias(n) for n, c in columns.items()])
    placed = numbers
    for column, cuts in zip(columns, even_cuts(numbers, list(columns), default_buckets(df)), strict=True):
        placed = with_bucket(placed, column, cuts, f"{column}_bucket")
        # cut points are finite: an infinity would share its bucket
        ends = F.when(F.col(column) == math.inf, len(cuts) + 1).when(F.col(column) == -math.inf, -1)
        placed = placed.withColumn(f"{column}_bucket", ends.otherwise(F.col(f"{column}_bucket")))
    sides = [
        F.struct(F.lit(model).alias("model"), "__a", "__a_bucket", F.col(f"__b{i}").alias("__b"), F.col(f"__b{i}_bucket").alias("__b_bucket"))
        for i, model in enumerate(predictions)
    ]
    rows = placed.select(*by, F.inline(F.array(*sides))).filter(complete(F.col("__a"), F.col("__b")))
    keys = [*by, "model"]
    ranked = rows.groupBy(*keys, "__a_bucket", "__a", "__b_bucket", "__b").agg(F.count(F.lit(1)).alias("__w"))
    for value, other in (("__a", "__b"), ("__b", "__a")):
        ranked = _with_mid_rank(ranked, _bucket_counts(rows, keys, value, bounded=not by), keys, value, other)
    return _weighted_pearson(ranked, "__a_rank", "__b_rank", "__w", keys, name)


def _bucket_counts(rows: DataFrame, keys: Sequence[str], value: str, bounded: bool) -> DataFrame:
    """Per key and bucket of ``value``: rows, rows of earlier buckets, and whether the bucket holds one value.

    ``bounded``: these are models times buckets, which may be sent to every task.
    """
    counted = rows.groupBy(*keys, f"{value}_bucket").agg(F.count(F.lit(1)).alias("__n"), (F.min(value) == F.max(value)).alias("__one"))
    earlier = Window.partitionBy(*keys).orderBy(f"{value}_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("__start", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    return F.broadcast(counted) if bounded else counted


def _with_mid_rank(pairs: DataFrame, counts: DataFrame, keys: Sequence[str], value: str, other: str) -> DataFrame:
    """Weighted pairs with the mean rank of ``value`` among their keys.

    A bucket of several values has at most its share of the rows and is ordered in one task. Where it has one, of any
    number of rows, the rank is known from the counts; its pairs are dealt by their other value.
    """
    bucket = f"{value}_bucket"
    held = match_keys(pairs, counts, [*keys, bucket], "inner", known=["model", bucket])
    held = held.withColumn("__dealt", F.when(F.col("__one"), F.xxhash64(other)))
    inside = Window.partitionBy(*keys, bucket, "__dealt")
    upto = F.sum("__w").over(inside.orderBy(value))
    ties = F.sum("__w").over(Window.partitionBy(*keys, bucket, "__dealt", value))
    within = F.when(F.col("__one"), (F.col("__n") + 1) / 2).otherwise(upto + (1 - ties) / 2)
    return held.withColumn(f"{value}_rank", F.col("__start") + within).drop("__n", "__one", "__start", "__dealt", bucket)


def _rank_correlations_in_groups(df: DataFrame, actual: str, predictions: dict[str, str], by: Sequence[str], name: str) -> DataFrame:
    """The same for groups that one task may order: rows are moved once, to their group, and ranked there.

    Twice a mid-rank, less n + 1, is a whole number below RANKED_GROUP_ROWS, so the moments fit a long.
    """
    columns = {"__a": actual, **{f"__b{i}": column for i, column in enumerate(predictions.values())}}
    ranked = df.select(*by, *[(to_number(c) + F.lit(0.0)).alias(n) for n, c in columns.items()])
    sides = []
    for i in range(len(predictions)):
        ranks = {}
        for side, value in zip("xy", paired(F.col("__a"), F.col(f"__b{i}")), strict=True):
            ranked = ranked.withColumn(f"__{side}{i}", value)
            order = Window.partitionBy(*by).orderBy(F.col(f"__{side}{i}").desc_nulls_last())
            upto = F.count(f"__{side}{i}").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
            ranks[f"__{side}{i}"] = F.when(F.col(f"__{side}{i}").isNotNull(), F.rank().over(order) + upto)
        ranked = ranked.withColumns(ranks)
        x, y = F.col(f"__x{i}"), F.col(f"__y{i}")
        n = F.count(x)
        moments = [F.sum(a * b) - (n + 1) * (n + 1) * n for a, b in ((x, y), (x, x), (y, y))]
        xy, xx, yy = (m.cast("double") for m in moments)
        r = ratio(xy, F.sqrt(xx) * F.sqrt(yy))
        r = F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
        sides.append(F.struct(n.alias("n"), r.alias(name)).alias(f"__{i}"))
    found = ranked.groupBy(*by).agg(*sides)
    entries = [F.struct(F.lit(model).alias("model"), F.col(f"__{i}")["n"].alias("n"), F.col(f"__{i}")[name].alias(name)) for i, model in enumerate(predictions)]
    return found.select(*by, F.inline(F.array(*entries))).filter(F.col("n") > 0)


def _weighted_pearson(
    df: DataFrame, x: str, y: str, weight: str, by: Sequence[str], name: str
) -> DataFrame:
    """Correlation of rank columns whose rows stand for ``weight`` equal rows each.

    Twice a mid-rank is a whole number with the known mean n + 1, so the moments are summed as
    whole numbers and lose nothing, at any size. Null if a side is constant.
    """
    whole = "decimal(38,0)"
    dx, dy = ((2 * F.col(c)).cast("decimal(16,0)") for c in (x, y))
    n = F.sum(F.col(weight)).cast("decimal(14,0)")

    def moment(a: Column, b: Column) -> Column:
        total = F.sum(((a * b).cast(whole) * F.col(weight)).cast(whole))
        return (total - ((n + 1) * (n + 1)).cast(whole) * n).cast("double")

    r = ratio(moment(dx, dy), F.sqrt(moment(dx, dx)) * F.sqrt(moment(dy, dy)))
    r = F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
    return df.groupBy(*by).agg(F.sum(weight).alias("n"), r.alias(name))


def regression_metrics(
    df: DataFrame,
    actual: str,
    predictions: dict[str, str],
    by: Sequence[str] = (),
    metrics: Sequence[str] = DEFAULT_METRICS,
    n_features: int | None = None,
    condition: int | str | None = None,
) -> DataFrame:
    """One row per (``by``, model) with the wanted metrics; null where not defined."""
    y = to_number(actual)
    cheap, medians = [], {}
    for model, column in predictions.items():
        p = to_number(column)
        scores = _scores(y, p, n_features, condition)
        n = F.count(paired(y, p)[0])
        fields = [n.alias("n"), *[c.alias(k) for k, c in scores.items() if k in metrics or k == "pearson_correlation"]]
        cheap.append(F.struct(*fields).alias(f"__{model}"))
        if "median_absolute_error" in metrics:
            medians[f"__median_{model}"] = F.abs(y - p)
    scored = aggregate_with_medians(df, list(by), cheap, medians)
    wanted = [m for m in metrics if "spearman" not in m]

    def entry(model: str) -> Column:
        source = F.col(f"__{model}")
        held = scored.schema[f"__{model}"].dataType.names
        fields = [F.lit(model).alias("model"), source["n"].alias("n")]
        for m in wanted:
            if m == "pearson_p_value":
                continue
            if m == "median_absolute_error":
                value = F.col(f"__median_{model}")
            else:
                value = source[m] if m in held else F.lit(None).cast("double")
            fields.append(value.alias(m))
        if "pearson_p_value" in wanted and "pearson_correlation" not in wanted:
            fields.append(source["pearson_correlation"].alias("__r"))
        return F.struct(*fields)

    result = scored.select(*by, F.inline(F.array(*[entry(m) for m in predictions])))
    if "pearson_p_value" in wanted:
        r = "pearson_correlation" if "pearson_correlation" in wanted else "__r"
        result = result.withColumn("pearson_p_value", correlation_p_value(r, F.col("n").cast("double")))
    if any("spearman" in m for m in metrics):
        ranked = rank_correlations(df, actual, predictions, by).select(
            *by, "model", "spearman_correlation",
            correlation_p_value("spearman_correlation", F.col("n").cast("double")).alias("spearman_p_value"),
        )
        result = match_keys(result, ranked, [*by, "model"], "left")
    return result.select(*by, "model", "n", *metrics)


def long_metrics(metrics: DataFrame, ids: Sequence[str] = ("model",)) -> DataFrame:
    """(ids, metric, value) form of a metrics table."""
    values = [c for c in metrics.columns if c not in ids]
    doubles = metrics.select(*ids, *[F.col(c).cast("double").alias(c) for c in values])
    return doubles.unpivot(list(ids), values, "metric", "value")


def metrics_table(long: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row per model from (model, metric, value)."""
    return long.groupBy("model").pivot("metric", list(metrics)).agg(F.first("value"))


def r2_by_model(df: DataFrame, actual: str, predictions: dict[str, str]) -> DataFrame:
    return regression_metrics(df, actual, predictions, metrics=("r2",)).select("model", "r2")


def calibration(
    df: DataFrame, actual: str, models: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Coverage within 1 / 2 / 3 sigma, its distance from the ideal, NLPD, sigma-error correlation.

    NLPD is null when some sigma is not positive.
    """
    ideal = {1: 0.68, 2: 0.95, 3: 0.997}
    y = to_number(actual)
    structs = []
    for model in models:
        p, s = to_number(predicted_column(model)), to_number(uncertainty_column(model))
        error = F.abs(y - p)
        within = {k: F.avg((error <= k * s).cast("double")) for k in ideal}
        gap = {k: F.abs(within[k] - ideal[k]) for k in ideal}
        density = F.avg(
            0.5 * F.ln(F.when(s > 0, 2 * math.pi * s * s)) + 0.5 * ratio(error * error, s * s)
        )
        structs.append(
            F.struct(
                F.lit(model).alias("model"),
                *[within[k].alias(f"within_{k}std") for k in ideal],
                *[gap[k].alias(f"calibration_error_{k}std") for k in ideal],
                ((gap[1] + gap[2] + gap[3]) / 3).alias("avg_calibration_error"),
                F.when(F.count_if(s <= 0) == 0, density).alias("nlpd"),
                pearson(s, error).alias("uncertainty_error_correlation"),
            ).alias(f"__{model}")
        )
    scored = df.groupBy(*by).agg(*structs)
    return scored.select(*by, F.inline(F.array(*[F.col(f"__{m}") for m in models])))


def position_report(
    df: DataFrame,
    actual: str,
    models: Sequence[str],
    order: Sequence[str],
    carried: Sequence[str] = ("resname", "secondary_structure_encoded", "core_exterior_encoded"),
    keys: Sequence[str] = (GROUP, POSITION),
) -> DataFrame:
    """One row per (group, position): the first row in ``order``, with errors per model."""
    carried = [c for c in carried if c in df.columns]
    sigma = [m for m in models if uncertainty_column(m) in df.columns]
    held = [*carried, actual, *[predicted_column(m) for m in models], *[uncertainty_column(m) for m in sigma]]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*held), F.struct(*order)).alias("__first"))
    y = F.col("__first")[actual]
    columns = [*keys, *[F.col("__first")[c].alias(c) for c in carried], y.alias("actual")]
    for m in models:
        p = F.col("__first")[predicted_column(m)]
        columns += [
            p.alias(predicted_column(m)),
            (p - y).alias(error_column(m)),
            F.abs(p - y).alias(abs_error_column(m)),
        ]
        if m in sigma:
            s = F.col("__first")[uncertainty_column(m)]
            columns += [
                s.alias(uncertainty_column(m)),
                F.when(s > 0, ratio(F.abs(p - y), s)).alias(f"{m}_normalized_error"),
            ]
    return first.select(*columns)
