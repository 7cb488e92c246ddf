"""Rank selection by digits: values at wanted ranks without a sketch and without ordering a column.

A number is read as a 64-bit integer that sorts like it. Rows are counted by its leading bits, which are
combined before the shuffle into at most 2^DIGIT counts per column whatever its size; the counts tell which
digit holds a wanted rank, and the next round counts the following bits of the rows under it. After
64 / DIGIT rounds the integer is the value itself; intervals of few rows end earlier.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGIT = 16
# A bucket's border needs fewer: its counts number at most 2^CUT_DIGIT per bucket.
CUT_DIGIT = 8
# Intervals that are told by their edges, not by a look-up of the prefix.
FEW = 8
_BITS = 64
_SMALLEST_NORMAL = 2.0**-1022


def sort_key(value: Column, kind: T.DataType) -> Column:
    """A whole number that sorts like ``value`` and tells different values apart; null stays null.

    For doubles: their sign, exponent and fraction in one, so that 0.0 is 0. NaN counts as null.
    """
    if isinstance(kind, T.IntegralType):
        return value.cast("long")
    size = F.abs(value)
    return _signed(value, _bits_of(size, _exponent(size, _guess(size))))


def _guess(size: Column) -> Column:
    return F.floor(F.log2(F.when(size < math.inf, size))).cast("long")


def _exponent(size: Column, guess: Column) -> Column:
    # the logarithm may miss the exponent by one next to a power of two
    return guess - (size < F.pow(F.lit(2.0), guess)).cast("long") + (size >= F.pow(F.lit(2.0), guess + 1)).cast("long")


def _bits_of(size: Column, exponent: Column) -> Column:
    fraction = ((size / F.pow(F.lit(2.0), exponent) - 1) * 2.0**52).cast("long")
    return (
        F.when(size < _SMALLEST_NORMAL, (size * 2.0**537 * 2.0**537).cast("long"))
        .when(size == math.inf, F.lit(0x7FF << 52))
        .otherwise((exponent + 1023) * F.lit(1 << 52) + fraction)
    )


def _signed(value: Column, bits: Column) -> Column:
    return F.when(~F.isnan(value), F.when(value < 0, -bits).otherwise(bits))


def sort_keys(df: DataFrame) -> DataFrame:
    """Every numeric column of ``df`` replaced by its ``sort_key``.

    Step by step, so that logarithm and powers are computed once a value: as one expression they are
    repeated wherever the key is used, in code too long for the JVM to compile.
    """
    doubles = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.IntegralType)]
    size, guess, exponent = ({c: F.col(f"{part}_{c}") for c in doubles} for part in ("__size", "__guess", "__exponent"))
    steps = df.withColumns({f"__size_{c}": F.abs(F.col(c)) for c in doubles})
    steps = steps.withColumns({f"__guess_{c}": _guess(size[c]) for c in doubles})
    steps = steps.withColumns({f"__exponent_{c}": _exponent(size[c], guess[c]) for c in doubles})
    steps = steps.withColumns({f"__bits_{c}": _bits_of(size[c], exponent[c]) for c in doubles})
    return steps.select(*[(_signed(F.col(c), F.col(f"__bits_{c}")) if c in doubles else F.col(c).cast("long")).alias(c) for c in df.columns])


def value_of(key: int, kind: T.DataType) -> float | int:
    """The value whose sort key this is."""
    if isinstance(kind, T.IntegralType):
        return key
    if abs(key) > 0x7FF << 52:  # beyond the infinities: an edge of an interval only
        return math.copysign(math.inf, key)
    size = struct.unpack("<d", struct.pack("<q", abs(key)))[0]
    return -size if key < 0 else size


def key_value(key: Column) -> Column:
    """The double whose sort key this is, as a column."""
    size = F.abs(key)
    fraction = size.bitwiseAND((1 << 52) - 1) / float(2**52)
    normal = F.pow(F.lit(2.0), F.shiftright(size, 52) - 1023) * (1 + fraction)
    small = size / 2.0**537 / 2.0**537
    value = F.when(size < (1 << 52), small).when(size >= (0x7FF << 52), F.lit(math.inf)).otherwise(normal)
    return F.when(key < 0, -value).otherwise(value)


@dataclass
class Interval:
    """Rows of a column whose key starts with ``prefix`` in its leading ``bits``; ``below`` rows have smaller ones."""

    column: int
    prefix: int
    bits: int
    below: int
    rows: int

    def edges(self, kind: T.DataType) -> tuple:
        """The smallest and the largest value inside."""
        low, high = self.keys
        return value_of(low, kind), value_of(high, kind)

    @property
    def keys(self) -> tuple[int, int]:
        low = self.prefix << (_BITS - self.bits)
        return low, low + (1 << (_BITS - self.bits)) - 1

    @property
    def settled(self) -> bool:
        return self.bits == _BITS


def _interval(column: int, prefix: int, bits: int, below: int, rows: int, low: int, high: int) -> Interval:
    """Rows that all have one key are settled, however few digits are known."""
    return Interval(column, low, _BITS, below, rows) if low == high else Interval(column, prefix, bits, below, rows)


class Digits:
    """Counts of numeric columns (double or whole numbers) by leading digits.

    A list of columns of one type in place of a column pools their values.
    """

    def __init__(self, df: DataFrame, columns: Sequence[str | Sequence[str]]):
        pools = [[c] if isinstance(c, str) else list(c) for c in columns]
        self.pools = [[f"c{i}_{j}" for j in range(len(pool))] for i, pool in enumerate(pools)]
        values = df.select(*[F.col(f"`{c}`").alias(f"c{i}_{j}") for i, pool in enumerate(pools) for j, c in enumerate(pool)])
        self.kinds = [values.schema[pool[0]].dataType for pool in self.pools]
        self.df = sort_keys(values)

    def _keys(self, column: int) -> list[Column]:
        return [F.col(c) for c in self.pools[column]]

    def whole(self) -> list[list[Interval]]:
        """Each column split by its first digit, in order."""
        found: list[list[Interval]] = [[] for _ in self.kinds]
        if not self.kinds:
            return found
        entries = [
            F.struct(F.lit(i).alias("q"), F.shiftright(key, _BITS - DIGIT).alias("digit"), key.alias("key"))
            for i in range(len(self.kinds))
            for key in self._keys(i)
        ]
        for q, counts in self._counted(F.array(*entries)).items():
            below = 0
            for digit, (n, low, high) in sorted(counts.items()):
                found[q].append(_interval(q, digit, DIGIT, below, n, low, high))
                below += n
        return found

    def split(self, wide: Sequence[Interval], step: int = DIGIT) -> list[list[Interval]]:
        """Each interval split by its next ``step`` bits, in order; one pass for all of them."""
        if not wide:
            return []
        entries, places = [], {}
        for column, bits in sorted({(q.column, q.bits) for q in wide}):
            alike = [q for q in wide if (q.column, q.bits) == (column, bits)]
            places |= {(column, bits, q.prefix): q for q in alike}
            for key in self._keys(column):
                if len(alike) > FEW:
                    inside = F.shiftright(key, _BITS - bits).isin([q.prefix for q in alike])
                else:
                    inside = reduce(lambda a, b: a | b, [key.between(*map(F.lit, q.keys)) for q in alike])
                digit = F.shiftright(key, max(0, _BITS - bits - step))
                entries.append(F.when(inside, F.struct(F.lit(column * _BITS + bits - 1).alias("q"), digit.alias("digit"), key.alias("key"))))
        parts: dict[int, list[Interval]] = {id(q): [] for q in wide}
        for place, counts in self._counted(F.array_compact(F.array(*entries))).items():
            column, bits = place // _BITS, place % _BITS + 1
            finer = min(_BITS, bits + step)
            below = None
            for digit, (n, low, high) in sorted(counts.items()):
                q = places[column, bits, digit >> (finer - bits)]
                below = below + parts[id(q)][-1].rows if parts[id(q)] else q.below
                parts[id(q)].append(_interval(column, digit, finer, below, n, low, high))
        return [parts[id(q)] for q in wide]

    def values(self, narrow: Sequence[Interval]) -> list[list[tuple]]:
        """(value, rows) of each interval in order; meant for intervals of few rows."""
        if not narrow:
            return []
        entries = [
            F.when(key.between(*map(F.lit, q.keys)), F.struct(F.lit(j).alias("q"), key.alias("digit"), key.alias("key")))
            for j, q in enumerate(narrow)
            for key in self._keys(q.column)
        ]
        counted = self._counted(F.array_compact(F.array(*entries)))
        return [[(value_of(k, self.kinds[q.column]), n) for k, (n, *_) in sorted(counted.get(j, {}).items())] for j, q in enumerate(narrow)]

    def _counted(self, entries: Column) -> dict[int, dict[int, tuple[int, int, int]]]:
        """Per place and digit: rows, smallest and largest key."""
        rows = self.df.select(F.inline(entries)).filter(F.col("digit").isNotNull()).groupBy("q", "digit").agg(F.count(F.lit(1)), F.min("key"), F.max("key")).collect()
        found: dict[int, dict] = {}
        for q, digit, *counts in rows:
            found.setdefault(q, {})[digit] = tuple(counts)
        return found


def select_ranks(digits: Digits, wanted, limit: int) -> tuple[list[int], list[dict[int, tuple]]]:
    """Rows per column, and per column (value, number of smaller rows) at the 0-based ranks ``wanted(column, rows)``.

    Intervals of at most ``limit`` rows are read as values; others are split further.
    """
    split = digits.whole()
    rows = [sum(q.rows for q in parts) for parts in split]
    missing = {(i, rank) for i, n in enumerate(rows) if n for rank in wanted(i, n)}
    found: list[dict] = [{} for _ in rows]
    parts = [q for column in split for q in column]
    while missing:
        holding = []
        for q in parts:
            inside = {m for m in missing if m[0] == q.column and q.below <= m[1] < q.below + q.rows}
            if q.settled:
                for i, rank in inside:
                    found[i][rank] = (q.edges(digits.kinds[i])[0], q.below)
                missing -= inside
            elif inside:
                holding.append(q)
        wide = [q for q in holding if q.rows > limit]
        narrow = [q for q in holding if q.rows <= limit]
        if narrow and not wide:
            for q, values in zip(narrow, digits.values(narrow), strict=True):
                start = q.below
                for value, n in values:
                    for m in {m for m in missing if m[0] == q.column and start <= m[1] < start + n}:
                        found[m[0]][m[1]] = (value, start)
                        missing.discard(m)
                    start += n
            break
        # narrow ones wait, so that the values are read in one pass at the end
        parts = [*narrow, *(p for inner in digits.split(wide) for p in inner)]
    return rows, found


def even_cuts(df: DataFrame, columns: Sequence[str], buckets: int) -> list[list[float]]:
    """Per column increasing cut points between which about equally many rows lie.

    Digits with more than a bucket's share of the rows are split, until single values are left.
    """
    digits = Digits(df, columns)
    columns_parts = digits.whole()
    shares = [max(1, sum(q.rows for q in parts) // buckets) for parts in columns_parts]
    while True:
        wide = [q for parts in columns_parts for q in parts if q.rows > shares[q.column] and not q.settled]
        if not wide:
            break
        finer = dict(zip(map(id, wide), digits.split(wide, CUT_DIGIT), strict=True))
        columns_parts = [[p for q in parts for p in finer.get(id(q), [q])] for parts in columns_parts]
    cuts: list[list[float]] = []
    for i, parts in enumerate(columns_parts):
        mine, held = [], 0
        for q in parts:
            if held and held + q.rows > shares[i]:
                mine.append(float(q.edges(digits.kinds[i])[0]))
                held = 0
            held += q.rows
        cuts.append(sorted({c for c in mine if math.isfinite(c)}))
    return cuts
