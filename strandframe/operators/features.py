"""Derived columns, per-group columns and neighbour features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import GROUP, GROUP_SIZE, POSITION, SCALED_POSITION, offset_name, offsets
from ..functions import codes
from ..functions.numeric import to_number
from .radix import even_cuts
from .ranking import default_buckets, exact_quantiles, row_index, sort_number, with_bucket
from .skew import HOT_GROUP_ROWS, count_hot_groups, hot_keys, match_keys

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)

# Positions handled together when one group is too large for a single task.
BLOCK_ROWS = 200_000


def with_group_statistics(
    df: DataFrame, statistics: dict[str, Column], group: str = GROUP
) -> DataFrame:
    """Attach per-group aggregates to every row; rows without a group get null.

    Aggregate and join back instead of an aggregate window: groups are combined
    before the shuffle and a hot group is split by the skew-join rule.
    """
    stats = df.filter(F.col(group).isNotNull()).groupBy(group).agg(
        *[c.alias(n) for n, c in statistics.items()]
    )
    return df.join(stats, group, "left").select(*df.columns, *statistics)


def add_group_columns(df: DataFrame, group: str = GROUP, position: str = POSITION) -> DataFrame:
    """Min-max position and group size, from one aggregate. Present columns are kept."""
    statistics, results = {}, {}
    low, high = F.min(position), F.max(position)
    if SCALED_POSITION not in df.columns:
        statistics |= {"__low": low, "__range": high - low}
        span = F.when(F.col("__range") == 0, 1).otherwise(F.col("__range"))
        results[SCALED_POSITION] = ((F.col(position) - F.col("__low")) / span).cast("double")
    if GROUP_SIZE not in df.columns:
        statistics["__size"] = F.count(position)
        results[GROUP_SIZE] = F.col("__size")
    if not statistics:
        return df
    return with_group_statistics(df, statistics, group).withColumns(results).drop(*statistics)


def add_codes(df: DataFrame, core_names: tuple[str, ...] = ("core",)) -> DataFrame:
    """Category codes and angle sines, for source columns that exist."""
    rules = {
        "resname_encoded": ("resname", codes.residue_code),
        "core_exterior_encoded": ("core_exterior", lambda c: codes.surface_code(c, core_names)),
        "secondary_structure_encoded": ("dssp", codes.structure_code),
        "phi_norm": ("phi", codes.angle_sine),
        "psi_norm": ("psi", codes.angle_sine),
    }
    return df.withColumns(
        {
            name: rule(F.col(source))
            for name, (source, rule) in rules.items()
            if source in df.columns and name not in df.columns
        }
    )


def _shifted(df: DataFrame, features: Sequence[str], k: int, window, known_group: Column) -> DataFrame:
    """All neighbour columns over one window, so the plan holds one sort and one pass.

    Rows without a group have no neighbours at all, not even an edge value.
    """
    edges = {f: 0 if isinstance(df.schema[f].dataType, _INTEGRAL) else None for f in features}

    def at(feature: str, i: int) -> Column:
        shift = F.lead if i > 0 else F.lag
        return F.when(known_group, shift(feature, abs(i), edges[feature]).over(window))

    return df.withColumns({offset_name(f, i): at(f, i) for f in features for i in offsets(k)})


def neighbor_columns(
    df: DataFrame,
    features: Sequence[str],
    k: int,
    group: str = GROUP,
    order: Sequence[str] = (POSITION,),
    max_group_rows: int = HOT_GROUP_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Values up to ``k`` rows before and after each row of its group.

    Past the ends of a group: 0 for whole-number features, null for others.
    ``order`` starts with the numeric position; more columns break ties. A
    (group, position) pair names a row, so ties are few.

    One shuffle by group, unless some group is too large for a task. Such groups
    are numbered, cut into blocks of consecutive rows with ``k`` copied rows on
    both sides, and handled block by block. Null positions come first in either form,
    and any type that sorts may give the position.
    """
    if group not in df.columns or order[0] not in df.columns:
        raise ValueError(f"neighbour features need the columns '{group}' and '{order[0]}'")
    features = [f for f in features if f in df.columns]
    if k <= 0 or not features:
        return df
    window = Window.partitionBy(group).orderBy(*order)
    known = F.col(group).isNotNull()
    n_hot = count_hot_groups(df, [group], max_group_rows)
    if n_hot == 0:
        return _shifted(df, features, k, window, known)

    hot = hot_keys(df, [group], max_group_rows, n_hot)
    usual = match_keys(df, hot, [group], "left_anti")
    large = match_keys(df, hot, [group], "left_semi")
    parts = [_shifted(usual, features, k, window, known)]
    named = large.filter(known)
    parts.append(_shifted_in_blocks(named, features, k, group, order, block_rows))
    unnamed = large.filter(~known)
    parts.append(
        unnamed.withColumns(
            {
                offset_name(f, i): F.lit(None).cast(df.schema[f].dataType)
                for f in features
                for i in offsets(k)
            }
        )
    )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _shifted_in_blocks(
    df: DataFrame, features: Sequence[str], k: int, group: str, order: Sequence[str], block_rows: int
) -> DataFrame:
    block_rows = max(block_rows, k)
    placed = df.withColumn("__at", sort_number(df, order[0]))
    (bounds,) = even_cuts(placed, ["__at"], default_buckets(df))
    numbered = row_index(
        with_bucket(placed, "__at", bounds), "__bucket", order, "__row", keys=[group]
    )
    block = F.floor(F.col("__row") / block_rows)
    inside = F.col("__row") % block_rows
    targets = F.array_compact(
        F.array(
            block,
            F.when((inside < k) & (block > 0), block - 1),
            F.when(inside >= block_rows - k, block + 1),
        )
    )
    copies = numbered.withColumn("__home", block).withColumn("__block", F.explode(targets))
    window = Window.partitionBy(group, "__block").orderBy("__row")
    shifted = _shifted(copies, features, k, window, F.lit(True))
    return shifted.filter(F.col("__block") == F.col("__home")).drop(
        "__at", "__bucket", "__row", "__home", "__block"
    )


def fill_statistics(df: DataFrame, features: Sequence[str]) -> dict:
    """Per feature: exact median of fractional columns, else the most frequent value.

    Equally frequent values: the smallest wins. Nothing known: 0.0, 0 or ''.
    """
    kinds = {f: df.schema[f].dataType for f in features}
    fractional = [f for f in features if isinstance(kinds[f], _FRACTIONAL)]
    others = [f for f in features if f not in fractional]
    fills = {}
    if fractional:
        medians = exact_quantiles(df, fractional, [0.5])
        fills |= {f: 0.0 if medians[f][0] is None else medians[f][0] for f in fractional}
    if others:
        # whole numbers and texts side by side: one count for all columns
        entries = []
        for f in others:
            text = isinstance(kinds[f], T.StringType)
            number, word = F.lit(None).cast("long") if text else F.col(f).cast("long"), F.col(f) if text else F.lit(None).cast("string")
            entries.append(F.when(F.col(f).isNotNull(), F.struct(F.lit(f).alias("f"), number.alias("number"), word.alias("word"))))
        counted = df.select(F.inline(F.array_compact(F.array(*entries)))).groupBy("f", "number", "word").agg(F.count(F.lit(1)).alias("n"))
        value = F.struct("number", "word")
        best = counted.groupBy("f").agg(F.min_by(value, F.struct(-F.col("n"), value)).alias("v")).select("f", "v.*")
        found = {r["f"]: r["number"] if r["word"] is None else r["word"] for r in best.collect()}
        fills |= {f: found.get(f, "" if isinstance(kinds[f], T.StringType) else 0) for f in others}
    return fills


def fill_neighbors(df: DataFrame, features: Sequence[str], k: int, fills: dict | None = None) -> DataFrame:
    """Replace missing neighbour values by a statistic of the base column."""
    features = [f for f in features if f in df.columns and offset_name(f, 1) in df.columns]
    if not features or k <= 0:
        return df
    fills = fill_statistics(df, features) if fills is None else fills
    return df.withColumns(
        {
            offset_name(f, i): F.coalesce(
                offset_name(f, i), F.lit(fills[f]).cast(df.schema[f].dataType)
            )
            for f in features
            for i in offsets(k)
        }
    )


def add_neighbors(
    df: DataFrame,
    features: Sequence[str],
    k: int,
    group: str = GROUP,
    order: Sequence[str] = (POSITION,),
    **limits,
) -> DataFrame:
    """Neighbour columns with missing values filled."""
    present = [f for f in features if f in df.columns]
    if k <= 0 or not present:
        return df
    fills = fill_statistics(df, present)
    return fill_neighbors(neighbor_columns(df, present, k, group, order, **limits), present, k, fills)


def feature_names(df: DataFrame, enabled: Sequence[str], k: int = 0) -> list[str]:
    """Model inputs: base features, then their neighbours, each in text order."""
    base = sorted(f for f in enabled if f in df.columns)
    around = sorted(
        offset_name(f, i) for f in base for i in offsets(k) if offset_name(f, i) in df.columns
    )
    if not base:
        raise ValueError(f"the table has none of the inputs {sorted(enabled)}")
    return base + around


def numeric_features(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Text as number (unreadable: 0), booleans as 0 / 1, other columns unchanged."""
    changes = {}
    for name in names:
        kind = df.schema[name].dataType
        if isinstance(kind, T.StringType):
            changes[name] = F.coalesce(to_number(name), F.lit(0.0))
        elif isinstance(kind, T.BooleanType):
            changes[name] = F.col(name).cast("int")
    return df.withColumns(changes) if changes else df


def model_rows(df: DataFrame, names: Sequence[str], target: str | None = None) -> DataFrame:
    """Numeric inputs and, with a target, the ``label``."""
    ready = numeric_features(df, names)
    if target is None:
        return ready
    if target not in df.columns:
        raise ValueError(f"target column '{target}' is missing")
    return ready.withColumn("label", F.coalesce(to_number(target), F.lit(0.0)))


def assemble(df: DataFrame, names: Sequence[str], target: str | None = None) -> DataFrame:
    """Model rows with their inputs as one ``features`` vector."""
    vectors = VectorAssembler(inputCols=list(names), outputCol="features", handleInvalid="keep")
    return vectors.transform(model_rows(df, names, target))
