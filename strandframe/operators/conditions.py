"""Cross-condition operators over the aligned (wide) table.

One row per (group, position, category); ``actual_T``, ``{model}_pred_T`` and so on
hold each condition's values. The table is built by one shuffle; every operator here
is then a single aggregate over it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import BASE_FEATURES, CONDITION, GROUP, KEYS, numeric_conditions
from ..functions.bins import cut_bin, cut_edges, edge_at, even_edges, histogram_bin, histogram_edges, value_range
from ..functions.codes import label
from ..functions.numeric import paired, pearson, to_number
from .metrics import (
    abs_error_column,
    error_column,
    predicted_column,
    r2,
    regression_metrics,
    rmse,
    uncertainty_column,
)
from .ranking import pooled_quantiles
from .skew import match_keys
from .statistics import group_statistics

ID_AND_CODE_COLUMNS = ("resid", "secondary_structure_encoded", "core_exterior_encoded", "resname_encoded")


def _per_condition_columns(long: DataFrame, models: Sequence[str], actual: str) -> dict[str, Column]:
    """Column name prefix in the aligned table -> expression on the long table."""
    y = F.col(actual)
    columns = {"actual": y}
    for m in models:
        p = F.col(predicted_column(m))
        stored = long.columns
        columns[f"{m}_pred"] = p
        columns[f"{m}_error"] = F.col(error_column(m)) if error_column(m) in stored else p - y
        columns[f"{m}_abs_error"] = (
            F.col(abs_error_column(m)) if abs_error_column(m) in stored else F.abs(p - y)
        )
        if uncertainty_column(m) in stored:
            columns[f"{m}_unc"] = F.col(uncertainty_column(m))
    return columns


def align_conditions(
    long: DataFrame,
    conditions: Sequence[int | str],
    models: Sequence[str],
    keys: Sequence[str] = KEYS,
    base: Sequence[str] = BASE_FEATURES,
    actual: str = "actual",
    unique_keys: bool = True,
) -> DataFrame:
    """Full outer alignment of all conditions on ``keys`` (null keys match each other).

    With one row per key and condition the N-way outer join is one grouped pivot:
    one shuffle in all; a key repeated within a condition stops the job, for folding its rows
    would make up a row that never was. ``unique_keys=False`` joins condition by condition instead and
    pairs repeated keys the way a join does. Base features come from the first condition.
    """
    columns = _per_condition_columns(long, models, actual)
    base = [c for c in base if c in long.columns]
    is_at = {c: F.col(CONDITION) == str(c) for c in conditions}
    if unique_keys:
        first = is_at[conditions[0]]
        # rows are moved before they become wide: a partly filled wide row is far larger
        wide = (
            long.filter(F.col(CONDITION).isin(*[str(c) for c in conditions]))
            .repartition(*keys)
            .groupBy(*keys)
            .agg(
                *[F.max(F.when(first, F.col(b))).alias(b) for b in base],
                *[
                    F.max(F.when(is_at[c], value)).alias(f"{name}_{c}")
                    for c in conditions
                    for name, value in columns.items()
                ],
                F.greatest(F.lit(0), *[F.count_if(is_at[c]) for c in conditions]).alias("__rows"),
            )
        )
        repeated = F.raise_error(F.lit("a key repeats within a condition; align with unique_keys=False"))
        # as a filter, which no later selection prunes away
        wide = wide.filter(F.when(F.col("__rows") > 1, repeated.cast("boolean")).otherwise(True)).drop("__rows")
        return add_model_differences(wide, models, conditions)

    def of(c) -> DataFrame:
        carried = [F.col(b) for b in base] if c == conditions[0] else []
        return long.filter(is_at[c]).select(
            *keys, *carried, *[value.alias(f"{name}_{c}") for name, value in columns.items()]
        )

    wide = of(conditions[0])
    for c in conditions[1:]:
        right = of(c).withColumnsRenamed({k: f"__{k}" for k in keys})
        on = reduce(lambda a, b: a & b, [wide[k].eqNullSafe(right[f"__{k}"]) for k in keys])
        wide = wide.join(right, on, "full").select(
            *[F.coalesce(wide[k], right[f"__{k}"]).alias(k) for k in keys],
            *[wide[x] for x in wide.columns if x not in keys],
            *[right[x] for x in right.columns if not x.startswith("__")],
        )
    return add_model_differences(wide, models, conditions)


def add_model_differences(
    wide: DataFrame, models: Sequence[str], conditions: Sequence[int | str]
) -> DataFrame:
    """First model minus second, for predictions and absolute errors."""
    if len(models) < 2:
        return wide
    a, b = models[:2]
    differences = {}
    for c in conditions:
        differences[f"pred_diff_{c}"] = F.col(f"{a}_pred_{c}") - F.col(f"{b}_pred_{c}")
        differences[f"abs_error_diff_{c}"] = F.col(f"{a}_abs_error_{c}") - F.col(f"{b}_abs_error_{c}")
    return wide.withColumns(differences)


def condition_correlations(
    wide: DataFrame, conditions: Sequence[int | str], prefix: str = "actual"
) -> DataFrame:
    """Correlation of every two conditions over complete pairs: (condition_a, condition_b, r).

    ``prefix`` is ``actual`` or ``{model}_pred``. The diagonal is 1; a condition without a
    column has null everywhere. All pairs come from one aggregate.
    """
    present = [c for c in conditions if f"{prefix}_{c}" in wide.columns]
    pairs = list(combinations(present, 2))
    sums = wide.agg(
        F.lit(1).alias("__one"),
        *[
            pearson(F.col(f"{prefix}_{a}"), F.col(f"{prefix}_{b}")).alias(f"r{i}")
            for i, (a, b) in enumerate(pairs)
        ],
    )
    at = {frozenset((str(a), str(b))): F.col(f"r{i}") for i, (a, b) in enumerate(pairs)}
    nothing = F.lit(None).cast("double")
    known = {str(c) for c in present} if len(present) > 1 else set()

    def value(a: str, b: str) -> Column:
        if a == b:
            return F.lit(1.0) if a in known else nothing
        return at.get(frozenset((a, b)), nothing) if known else nothing

    names = [str(c) for c in conditions]
    entries = [
        F.struct(F.lit(a).alias("condition_a"), F.lit(b).alias("condition_b"), value(a, b).alias("r"))
        for a in names
        for b in names
    ]
    return sums.select(F.inline(F.array(*entries)))


def correlation_matrix(correlations: DataFrame, conditions: Sequence[int | str]) -> DataFrame:
    names = [str(c) for c in conditions]
    return correlations.groupBy(F.col("condition_a").alias(CONDITION)).pivot("condition_b", names).agg(F.first("r"))


def correlations_of(correlations: DataFrame, condition: int | str) -> DataFrame:
    """One condition against all, ascending."""
    return (
        correlations.filter(F.col("condition_a") == str(condition))
        .select(F.col("condition_b").alias(CONDITION), "r")
        .orderBy("r", CONDITION)
    )


def scaling_factors(wide: DataFrame, conditions: Sequence[int | str], prefix: str = "rmsf") -> DataFrame:
    """Mean ratio higher / lower condition over rows where both values are positive."""
    present = [c for c in numeric_conditions(conditions) if f"{prefix}_{c}" in wide.columns]
    pairs = list(combinations(present, 2))

    def mean_ratio(a, b) -> Column:
        low, high = F.col(f"{prefix}_{a}"), F.col(f"{prefix}_{b}")
        return F.avg(F.when((low > 0) & (high > 0), high / low))

    means = wide.agg(*[mean_ratio(a, b).alias(f"f{i}") for i, (a, b) in enumerate(pairs)])
    entries = [
        F.struct(F.lit(f"{a}_to_{b}").alias("pair"), F.col(f"f{i}").alias("factor"))
        for i, (a, b) in enumerate(pairs)
    ]
    return means.select(F.inline(F.array(*entries)))


def condition_metrics(
    long: DataFrame,
    models: Sequence[str],
    metrics: Sequence[str] = ("rmse", "r2", "pearson_correlation"),
    actual: str = "actual",
) -> DataFrame:
    """(condition, model) with the chosen metrics."""
    scored = regression_metrics(
        long, actual, {m: predicted_column(m) for m in models}, by=[CONDITION], metrics=metrics
    )
    return scored.drop("n")


def grouped_errors(
    wide: DataFrame,
    key: str,
    conditions: Sequence[int | str],
    models: Sequence[str],
    labels: Mapping | None = None,
    missing: str = "nan",
) -> DataFrame:
    """Per key value: rows, and mean / median / sample std of absolute error per model and condition.

    Rows without a key form a group of their own, shown as ``missing``.
    """
    columns = {f"{m}|{c}": f"{m}_abs_error_{c}" for m in models for c in conditions}
    found = group_statistics(wide, [key], columns)
    summary = found.select(
        key, "count", *[F.col(f"`{m}|{c}_{s}`").alias(f"{m}_{s}_abs_error_{c}") for m in models for c in conditions for s in ("mean", "std", "median")]
    )
    shown = label(F.col(key), labels) if labels else F.col(key).cast("string")
    return summary.withColumn(key, F.coalesce(shown, F.lit(missing)))


def structure_errors(
    wide: DataFrame, key: str, conditions: Sequence[int | str], models: Sequence[str], labels: Mapping
) -> DataFrame:
    """Grouped errors by structure code, unknown structure shown as 'Unknown'."""
    return grouped_errors(wide, key, conditions, models, labels, missing="Unknown")


def binned_errors(
    wide: DataFrame,
    feature: str,
    conditions: Sequence[int | str],
    models: Sequence[str],
    bins: int = 10,
) -> DataFrame:
    """Per occupied equal-width bin of a feature: edges, rows, mean absolute error.

    A feature with at most one distinct value gives no bins.
    """
    span = value_range(wide, feature)
    flat = span is None or span[0] == span[1]
    edges = cut_edges(*((0.0, 1.0) if flat else span), bins)
    rows = wide.filter(F.lit(False)) if flat else wide
    means = [
        F.avg(f"{m}_abs_error_{c}").alias(f"{m}_mean_abs_error_{c}") for m in models for c in conditions
    ]
    summary = (
        rows.withColumn("__bin", cut_bin(to_number(feature), edges))
        .filter(F.col("__bin").isNotNull())
        .groupBy("__bin")
        .agg(F.count(F.lit(1)).alias("count"), *means)
    )
    start, end = edge_at(F.col("__bin"), edges), edge_at(F.col("__bin"), edges, 1)
    return summary.select(
        F.lit(feature).alias("feature"),
        start.alias("bin_start"),
        end.alias("bin_end"),
        ((start + end) / 2).alias("bin_center"),
        "count",
        *[c for c in summary.columns if c not in ("__bin", "count")],
    )


def features_to_bin(wide: DataFrame, conditions: Sequence[int | str]) -> list[str]:
    """Numeric columns that belong to no condition and are neither ids nor codes."""
    numeric = (T.DoubleType, T.LongType, T.IntegerType)
    return [
        f.name
        for f in wide.schema.fields
        if isinstance(f.dataType, numeric)
        and f.name not in ID_AND_CODE_COLUMNS
        and not any(str(c) in f.name for c in conditions)
    ]


def group_performance_by_condition(
    wide: DataFrame,
    conditions: Sequence[int | str],
    models: Sequence[str],
    group: str = GROUP,
) -> DataFrame:
    """Per group and condition: size, mean, std; RMSE / R2 / Pearson per model."""
    aggregates = []
    for c in conditions:
        y = F.col(f"actual_{c}")
        aggregates += [
            F.count(y).alias(f"num_residues_{c}"),
            F.avg(y).alias(f"mean_actual_{c}"),
            F.when(F.count(y) > 1, F.stddev_samp(y)).otherwise(0.0).alias(f"std_actual_{c}"),
        ]
        for m in models:
            aggregates += _guarded_scores(y, F.col(f"{m}_pred_{c}"), f"{m}_{{}}_{c}")
    named = wide.filter(F.col(group).isNotNull())
    return named.groupBy(group).agg(*aggregates)


def _guarded_scores(actual: Column, predicted: Column, name: str) -> list[Column]:
    """Scores that stay defined on a flat group: 0 and 1 if it is met, else null."""
    y, p = paired(actual, predicted)
    varied = (F.var_pop(y) > 1e-9) & (F.var_pop(p) > 1e-9)
    met = F.every(F.abs(y - p) <= 1e-8 + 1e-5 * F.abs(p))
    several = F.count(y) > 1
    return [
        rmse(y, p).alias(name.format("rmse")),
        F.when(several & varied, r2(y, p)).when(several & met, 0.0).alias(name.format("r2")),
        F.when(several & varied, F.coalesce(pearson(y, p), F.lit(0.0)))
        .when(several & met, 1.0)
        .alias(name.format("pearson")),
    ]


def _histogram(values: DataFrame, by: Sequence[str], edges: list[float], combos: list[tuple]) -> DataFrame:
    """Counts per (``by``, bin), empty bins included.

    Both join sides have at most ``len(combos) * bins`` rows.
    """
    bins = len(edges) - 1
    counted = (
        values.withColumn("__bin", histogram_bin(F.col("value"), edges))
        .filter(F.col("__bin").isNotNull())
        .groupBy(*by, "__bin")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    schema = ", ".join([f"`{b}` string" for b in by] + ["__bin int, bin_start double, bin_end double"])
    rows = [(*c, i, float(edges[i]), float(edges[i + 1])) for c in combos for i in range(bins)]
    grid = values.sparkSession.createDataFrame(rows, schema)
    filled = match_keys(grid, F.broadcast(counted), [*by, "__bin"], "left")
    return filled.select(*by, "bin_start", "bin_end", F.coalesce("count", F.lit(0)).alias("count"))


def pooled_histogram(
    wide: DataFrame, conditions: Sequence[int | str], model: str, bins: int = 20
) -> DataFrame:
    """Counts per condition and source over bins shared by all of them.

    The bins span the 1st to 99th percentile of actual and predicted values together, not below 0.
    The values alone are kept while ranks and counts are taken from them; the result is as small as
    conditions x sources x bins and is made at once.
    """
    sources = [
        (str(c), source, column)
        for c in conditions
        for source, column in (("actual", f"actual_{c}"), (f"predicted_{model}", f"{model}_pred_{c}"))
    ]
    names = [f"v{i}" for i in range(len(sources))]
    values = wide.select(*[to_number(column).alias(v) for v, (_, _, column) in zip(names, sources, strict=True)]).persist()
    try:
        low, high = pooled_quantiles(values, names, [0.01, 0.99])
        if low is None:
            low, high = 0.0, 1.0
        low = max(0.0, low)
        high = low + 1e-6 if high <= low else high
        edges = even_edges(low, high, bins)
        entries = [
            F.when(F.col(v).isNotNull(), F.struct(F.lit(i).alias("source"), F.coalesce(histogram_bin(F.col(v), edges), F.lit(-1)).alias("bin")))
            for i, v in enumerate(names)
        ]
        counted = values.select(F.inline(F.array_compact(F.array(*entries)))).groupBy("source", "bin").count().collect()
    finally:
        values.unpersist()
    counts = {(source, bin): n for source, bin, n in counted}
    rows = [
        (sources[i][0], sources[i][1], float(edges[b]), float(edges[b + 1]), counts.get((i, b), 0))
        for i in sorted({i for i, _ in counts})  # sources without a value have no rows
        for b in range(bins)
    ]
    schema = f"`{CONDITION}` string, type string, bin_start double, bin_end double, count bigint"
    return wide.sparkSession.createDataFrame(rows, schema)


def run_histogram(df: DataFrame, actual: str, models: Sequence[str], bins: int = 20) -> DataFrame:
    """Counts of actual values over their own range, and of predictions in the same bins."""
    sources = {"actual": actual, **{m: predicted_column(m) for m in models}}
    entries = [
        F.struct(F.lit(s).alias("source"), to_number(c).alias("value")) for s, c in sources.items()
    ]
    values = df.select(F.inline(F.array(*entries))).filter(F.col("value").isNotNull())
    span = value_range(df, actual) or (0.0, 1.0)
    return _histogram(values, ["source"], histogram_edges(*span, bins), [(s,) for s in sources])
