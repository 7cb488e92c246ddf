"""Periodic runs of words: stretches that repeat a period several times and go no further either way.

Every document by itself, in batches of a map; nothing is shuffled.

1. Prefix doubling in numpy orders the suffixes of a batch, each within its document. A suffix that no
   other one shares its first words with is done and leaves the rounds early; most texts end there.
2. Longest common prefixes of neighbours in that order: only pairs whose left words differ are compared,
   a pair to the right of another of the same shift has one word less.
3. Neighbours are united by decreasing common prefix (Kruskal). A class keeps its places in order, the
   smaller goes into the larger. Two places next to each other for the first time, at a distance d of at
   most ``lcp / (min_exponent - 1)``, agree for d + lcp words with period d: a run, if the words before
   them differ. It is the smallest period: a smaller one would divide d, and its place would stand between.

Runs are (start, length, period) in words, by start, then period. A word is dropped from ``collapsed`` if a
run holds it after that run's first period. Words are split at ASCII white space. A null text has no words,
no run and an empty ``collapsed``; so has an empty one. Repeated rows and equal or null ids are documents of
their own. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm.common import table, text_or_empty
from strandframe.llm.shards import in_batches

MIN_LENGTH, MIN_EXPONENT = 24, 3
WORD = r"([^\x20\x09-\x0D]+)"
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def find_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, runs, collapsed) of every document."""
    if min_exponent < 2 or min_length < min_exponent:
        raise ValueError("a run repeats its period at least twice")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_batches(batches, 1):
            words = [t.split() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            bounds = np.cumsum([0, *map(len, words)])
            found = runs_of(symbols_of(words), bounds, min_length, min_exponent)
            kept = [b" ".join(w) for w in words]
            for document, runs in enumerate(found):
                if runs:
                    stays = np.ones(len(words[document]), bool)
                    for start, length, period in runs:
                        stays[start + period : start + length] = False
                    kept[document] = b" ".join([words[document][i] for i in np.flatnonzero(stays).tolist()])
            fields = [pa.array([r[i] for runs in found for r in runs], "int64") for i in range(3)]
            rows = pa.StructArray.from_arrays(fields, ["start", "length", "period"])
            ends = pa.array(np.cumsum([0, *map(len, found)]), "int32")
            text = pc.cast(pa.array(kept, pa.binary()), options=pc.CastOptions(target_type=pa.string(), allow_invalid_utf8=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, rows), text], ["id", "runs", "collapsed"])

    read = docs.select(F.col(f"`{id_column}`").alias("id"), text_or_empty(text_column).alias("text"))
    kind = read.schema["id"].dataType.simpleString()
    found = read.mapInArrow(search, f"id {kind}, runs {RUNS}, collapsed string")
    return found.withColumnRenamed("id", id_column)


def symbols_of(documents: list[list[bytes]]) -> np.ndarray:
    """A number per word, equal words alike."""
    known: dict[bytes, int] = {}
    return np.asarray([known.setdefault(w, len(known)) for words in documents for w in words], "i8")


def runs_of(symbols: np.ndarray, bounds: np.ndarray, min_length: int, min_exponent: int) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each document symbols[bounds[k]:bounds[k + 1]], ordered."""
    # Of length l and period q <= l / e, the common prefix of a run and the run q later: l - q.
    least = -(-min_length * (min_exponent - 1) // min_exponent)
    found: list[list[tuple[int, int, int]]] = [[] for _ in bounds[1:]]
    document = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    lower, upper, shared = neighbours(symbols, document, bounds, least)
    order = np.lexsort((-shared, document[lower]))
    owners, cuts = document[lower][order], []
    if len(order):
        cuts = [0, *(np.flatnonzero(np.diff(owners)) + 1).tolist(), len(order)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        part, at, stop = order[a:b], int(bounds[owners[a]]), int(bounds[owners[a] + 1])
        pairs = zip((lower[part] - at).tolist(), (upper[part] - at).tolist(), shared[part].tolist(), strict=True)
        found[owners[a]] = sorted(unite(symbols[at:stop].tolist(), pairs, min_length, min_exponent), key=lambda r: (r[0], r[2]))
    return found


def neighbours(symbols: np.ndarray, document: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, place, common prefix) of suffixes next to each other in order, those that share ``least`` symbols."""
    n = len(symbols)
    none = np.zeros(0, "i8")
    if not n:
        return none, none, none
    begin, end = bounds[document], bounds[document + 1]
    rank = np.zeros(n, "i8")
    places, shared = np.arange(n), 0
    key = document * (int(symbols.max()) + 1) + symbols
    candidates = heads = none
    while True:
        order = np.argsort(key, kind="stable")
        places, key = places[order], key[order]
        first = np.append(True, key[1:] != key[:-1])
        old = rank[places]
        opens = np.append(True, old[1:] != old[:-1])
        at = np.arange(len(places))
        rank[places] = old + np.maximum.accumulate(np.where(first, at, 0)) - np.maximum.accumulate(np.where(opens, at, 0))
        places = places[~(first & np.append(first[1:], True))]  # alone: done
        shared = 2 * shared or 1
        if shared <= least:
            candidates, heads = places, rank[places]
        if not len(places):
            break
        later = places + shared
        second = np.where(later < end[places], rank[np.minimum(later, n - 1)] + 1, 0)
        key = rank[places] * (n + 1) + second
    if not len(candidates):
        return none, none, none
    order = np.argsort(rank[candidates])
    candidates, heads = candidates[order], heads[order]
    pair = heads[1:] == heads[:-1]
    lower, upper = candidates[:-1][pair], candidates[1:][pair]

    order = np.argsort(upper)  # by place, so that pairs of the same shift follow each other
    lower, upper = lower[order], upper[order]
    inside = (upper > begin[upper]) & (lower > begin[lower])
    follows = inside & (symbols[upper - 1] == symbols[lower - 1])
    common = np.zeros(len(upper), "i8")
    for i in np.flatnonzero(~follows).tolist():
        a, b = int(lower[i]), int(upper[i])
        common[i] = shared_length(symbols, a, b, int(min(end[a] - a, end[b] - b)))
    leader = np.maximum.accumulate(np.where(follows, 0, np.arange(len(upper))))
    common = common[leader] - (upper - upper[leader])
    enough = common >= least
    return lower[enough], upper[enough], common[enough]


def shared_length(symbols: np.ndarray, a: int, b: int, most: int) -> int:
    length, step = 0, 64
    while length < most:
        size = min(step, most - length)
        differs = symbols[a + length : a + length + size] != symbols[b + length : b + length + size]
        at = int(differs.argmax())
        if differs[at]:
            return length + at
        length, step = length + size, 4 * step
    return most


def unite(symbols: list[int], pairs, min_length: int, min_exponent: int) -> list[tuple[int, int, int]]:
    """Runs seeded while classes of places are united by ``pairs`` (place, place, common prefix), longest first."""
    runs: list[tuple[int, int, int]] = []
    owner: dict[int, list[int]] = {}

    def seed(start: int, period: int, common: int) -> None:
        if common >= (min_exponent - 1) * period and common + period >= min_length and (start == 0 or symbols[start - 1] != symbols[start - 1 + period]):
            runs.append((start, common + period, period))

    for a, b, common in pairs:
        large, small = owner.setdefault(a, [a]), owner.setdefault(b, [b])
        if len(large) < len(small):
            large, small = small, large
        for i, place in enumerate(small):
            k = bisect_left(large, place)
            if k and (i == 0 or small[i - 1] < large[k - 1]):
                seed(large[k - 1], place - large[k - 1], common)
            if k < len(large) and (i + 1 == len(small) or large[k] < small[i + 1]):
                seed(place, large[k] - place, common)
        if len(small) * 16 < len(large):
            for place in small:
                insort(large, place)
        else:
            large += small
            large.sort()  # two ordered stretches: one merge
        for place in small:
            owner[place] = large
    return runs


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of ids whose checksum ends in 0, the words from some place on repeat the first of them."""
    # No lambda: each part of the words is taken once.
    read = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    read = read.withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD))))
    read = read.withColumn("n", F.nullif(F.size("words"), F.lit(0))).withColumn("g", F.expr("h div 10"))
    read = read.withColumn("a", F.expr("int(g % n)")).withColumn("p", F.expr("int(1 + (n - a) div (3 + g % 8))"))
    tail = "slice(flatten(array_repeat(slice(words, a + 1, p), int((n - a + p - 1) div p))), 1, n - a)"
    changed = F.expr(f"IF(n > 0, array_join(concat(slice(words, 1, a), {tail}), ' '), NULL)")
    return read.select("doc_id", F.coalesce(changed, F.col("text")).alias("text"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    found = find_runs(planted(table(spark, folder, "documents")))
    greatest = "aggregate(runs, CAST(NULL AS struct<start:bigint,length:bigint,period:bigint>), (best, r) -> " \
               "IF(best IS NULL OR r.length * best.period > best.length * r.period, r, best))"
    lines = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')"
    found = found.withColumn("best", F.expr(greatest))
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.expr(lines), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
