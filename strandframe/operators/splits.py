"""Group-disjoint splits, folds and samples, all decided by a portable hash.

The hash depends on the key and the seed alone, so a lost task recomputes the same
split and any engine with md5 can reproduce it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..columns import GROUP
from .radix import Digits, select_ranks
from .ranking import row_index
from .skew import match_keys

HASH_BITS = 52
BUCKET_BITS = 14
# Rows of one hash range that are read as counted hashes.
CUT_ROWS = 10_000


def key_hash(keys: Sequence[str], seed: int) -> Column:
    """52-bit number from md5 of the key values and the seed."""
    text = F.concat_ws("-", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def _unit(keys: Sequence[str], seed: int) -> Column:
    return key_hash(keys, seed) / F.lit(float(2**HASH_BITS))


def hash_order(df: DataFrame, keys: Sequence[str], seed: int, name: str) -> DataFrame:
    """0-based place of each row in hash order, numbered bucket by bucket."""
    hashed = df.withColumn("__hash", key_hash(keys, seed))
    bucketed = hashed.withColumn("__part", F.shiftright("__hash", HASH_BITS - BUCKET_BITS))
    return row_index(bucketed, "__part", ["__hash", *keys], name).drop("__hash", "__part")


@dataclass
class Cut:
    """The place of a rank in the order of (hash, keys): rows of a smaller hash lie before it, and of rows with
    the same hash those with the keys ``before``. ``within`` are equal keys of which only ``take`` rows do."""

    hash: int
    before: list[tuple]
    within: tuple | None
    take: int

    def holds(self, keys: Sequence[str], seed: int) -> Column:
        """Whether a row lies before the cut; a comparison, no shuffle."""
        hashed = key_hash(keys, seed)
        tied = reduce(lambda a, b: a | b, [_same(keys, k) for k in self.before], F.lit(False))
        return (hashed < self.hash) | ((hashed == self.hash) & tied)


def _same(keys: Sequence[str], values: tuple) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in zip(keys, values, strict=True)])


def hash_cuts(df: DataFrame, keys: Sequence[str], seed: int, wanted: Callable[[int], Sequence[int]]) -> tuple[int, list[Cut | None]]:
    """(rows, cuts at the ranks ``wanted(rows)`` in hash order); no cut where a rank is not below the rows.

    Hashes are counted by their leading bits and rows of the hashes found are looked up; nothing is ordered
    but equal hashes.
    """
    hashed = df.select(*keys, key_hash(keys, seed).alias("__hash"))
    # the hash fills the upper bits of its column, which are counted first
    digits = Digits(hashed.select(F.shiftleft("__hash", 63 - HASH_BITS).alias("h")), ["h"])
    (n,), (found,) = select_ranks(digits, lambda _, rows: [r for r in wanted(rows) if r < rows], CUT_ROWS)
    at = {rank: (value >> (63 - HASH_BITS), below) for rank, (value, below) in found.items()}
    equal: dict[int, list] = {}
    if at:
        rows = hashed.filter(F.col("__hash").isin([h for h, _ in at.values()])).groupBy("__hash", *keys).count().orderBy("__hash", *keys).collect()
        for h, *values, count in rows:
            equal.setdefault(h, []).append((tuple(values), count))
    cuts: list[Cut | None] = []
    for rank in wanted(n):
        if rank >= n:
            cuts.append(None)
            continue
        h, start = at[rank]
        cut = Cut(h, [], None, 0)
        for values, count in equal[h]:
            if start + count <= rank:
                cut.before.append(values)
                start += count
            else:
                if start < rank:
                    cut.within, cut.take = values, rank - start
                break
        cuts.append(cut)
    return n, cuts


def _before(df: DataFrame, keys: Sequence[str], seed: int, cuts: Sequence[Cut | None]) -> tuple[DataFrame, list[Column]]:
    """``df`` and, per cut, whether a row lies before it.

    Rows that repeat the very keys of a cut are numbered apart, and only those.
    """
    split = [c for c in cuts if c is not None and c.within is not None]
    if split:
        straddling = reduce(lambda a, b: a | b, [_same(keys, c.within) for c in split])
        numbered = df.filter(straddling).withColumn("__equal", F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0))) - 1)
        df = df.filter(~straddling).withColumn("__equal", F.lit(None).cast("int")).unionByName(numbered)
    tests = []
    for c in cuts:
        test = F.lit(True) if c is None else c.holds(keys, seed)
        if c is not None and c.within is not None:
            test = test | (_same(keys, c.within) & (F.col("__equal") < c.take))
        tests.append(test)
    return df, tests


def split_sizes(n: int, test_size: float, validation_size: float) -> tuple[int, int, int]:
    """(train, validation, test) counts; both shares are of the whole and rounded up."""
    if test_size >= 1:
        raise ValueError("test_size must be less than 1")
    share = validation_size / (1 - test_size)
    if not 0 < share < 1:
        raise ValueError("validation_size must be positive and smaller than the remaining share")
    test = math.ceil(n * test_size)
    validation = math.ceil((n - test) * share)
    return n - test - validation, validation, test


def _named(place: Column, validation: Column | float, test: Column | float) -> Column:
    return (
        F.when(place < test, "test").when(place < test + validation, "validation").otherwise("train")
    )


def split_rows(
    df: DataFrame,
    keys: Sequence[str],
    test_size: float = 0.2,
    validation_size: float = 0.15,
    seed: int = 42,
    exact: bool = False,
    name: str = "split",
) -> DataFrame:
    """Row-level split. By threshold (no shuffle), or with exact counts."""
    split_sizes(1, test_size, validation_size)
    if not exact:
        return df.withColumn(name, _named(_unit(keys, seed), validation_size, test_size))
    _, cuts = hash_cuts(df, keys, seed, lambda n: _part_ranks(n, test_size, validation_size))
    return _named_by_cuts(df, keys, seed, cuts, name)


def _part_ranks(n: int, test_size: float, validation_size: float) -> list[int]:
    _, validation, test = split_sizes(n, test_size, validation_size)
    return [test, test + validation]


def _named_by_cuts(df: DataFrame, keys: Sequence[str], seed: int, cuts: Sequence[Cut | None], name: str) -> DataFrame:
    ready, (test, validation) = _before(df, keys, seed, cuts)
    part_name = F.when(test, "test").when(validation, "validation").otherwise("train")
    return ready.select(*[F.col(f"`{c}`") for c in df.columns if c != name], part_name.alias(name))


def split_groups(
    df: DataFrame,
    test_size: float = 0.2,
    validation_size: float = 0.15,
    seed: int = 42,
    group: str = GROUP,
    row_keys: Sequence[str] | None = None,
    exact: bool = True,
    name: str = "split",
) -> DataFrame:
    """Split that keeps every group whole.

    ``exact`` gives exact group counts: two cuts are looked up among the hashes of the distinct groups,
    then every row compares its own, without a shuffle. Otherwise a threshold on the group hash decides
    without a count. Exact counts need three groups; with fewer, and ``row_keys`` given, rows are split,
    else it is an error.
    """
    split_sizes(1, test_size, validation_size)
    if not exact:
        return df.withColumn(name, _named(_unit([group], seed), validation_size, test_size))
    groups = df.select(group).distinct().persist()  # a row per group, until the cuts are known
    try:
        n, cuts = hash_cuts(groups, [group], seed, lambda n: _part_ranks(n, test_size, validation_size) if n >= 3 else [])
    finally:
        groups.unpersist()
    if n < 3:
        if row_keys is None:
            raise ValueError(f"{n} groups cannot fill three parts; give row_keys to split their rows instead")
        return split_rows(df, row_keys, test_size, validation_size, seed, exact, name)
    return _named_by_cuts(df, [group], seed, cuts, name)


def part(df: DataFrame, which: str, name: str = "split") -> DataFrame:
    return df.filter(F.col(name) == which).drop(name)


def members(df: DataFrame, keys_of: DataFrame, keys: Sequence[str] = (GROUP,)) -> DataFrame:
    """Rows whose key occurs in another table."""
    return match_keys(df, keys_of.select(*keys).distinct(), keys, "left_semi")


def hash_folds(
    df: DataFrame, k: int, keys: Sequence[str] = (GROUP,), seed: int = 42, name: str = "fold"
) -> DataFrame:
    """Fold 0..k-1 by key hash: no shuffle, sizes about equal."""
    return df.withColumn(name, F.pmod(key_hash(keys, seed), F.lit(k)).cast("int"))


def even_folds(
    df: DataFrame, k: int, keys: Sequence[str] = (GROUP,), seed: int = 42, name: str = "fold"
) -> DataFrame:
    """Fold 0..k-1 with key counts differing by at most one."""
    distinct = df.select(*keys).distinct()
    placed = hash_order(distinct, keys, seed, "__place")
    assigned = placed.select(*keys, (F.col("__place") % k).cast("int").alias(name))
    return match_keys(df, assigned, keys, "inner")


def range_folds(
    df: DataFrame, k: int, keys: Sequence[str] = (GROUP,), seed: int = 42, name: str = "fold"
) -> DataFrame:
    """Fold 0..k-1 by ranges of the key hash that hold equally many keys, but for one.

    Only the k - 1 cuts between them are looked up; every row compares its hash with these, without a shuffle.
    """
    distinct = df.select(*keys).distinct().persist()  # a row per key, until the cuts are known
    try:
        _, cuts = hash_cuts(distinct, keys, seed, lambda n: [i * n // k for i in range(1, k)])
    finally:
        distinct.unpersist()
    beyond = [F.when(c.holds(keys, seed), 0).otherwise(1) if c else F.lit(0) for c in cuts]
    return df.withColumn(name, reduce(lambda a, b: a + b, beyond, F.lit(0)).cast("int"))


def sample_rows(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """At most ``n`` rows chosen uniformly: the smallest hashes, a top-n without a full sort."""
    return df.orderBy(key_hash(keys, seed), *keys).limit(n)
