"""Packing token sequences by cutting-stock column generation.

1. Every document becomes ids and an end id, cut into full sequences and one remainder.
2. Remainder lengths fall into classes of ``grain`` tokens, rounded up. Their histogram, of at most
   ``capacity / grain`` rows whatever the corpus, is all the driver sees. A linear program over
   patterns (how many pieces of each class fill one sequence) is solved by column generation: a
   revised simplex holds the basis, a knapsack dynamic program prices new patterns.
3. Patterns are rounded down; what is left over, at most a sequence per class, is filled greedily.
4. The pieces of a class are ranked by (table part, place in the part); a piece's rank gives its
   pattern, sequence and slot, without a shuffle of the ids.

Nulls count as empty texts and give one piece with the end id alone. Repeated rows are packed once
each. An empty table gives no rows. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandframe.llm.common import table, text_or_empty, written
from strandframe.llm.tokens import Encoder, encoded, encoder, vocabulary

CAPACITY, GRAIN, END_ID = 4096, 16, 2
PIECE = "piece bigint, doc_id {id}, start bigint, length bigint, doc_tokens bigint, size_class int, part int, place bigint, ids binary"


def token_pieces(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, grain: int = GRAIN, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece with its ids; full pieces are of class capacity / grain."""
    schema = PIECE.format(id=docs.schema[id_column].dataType.simpleString())
    end = np.asarray([end_id], "<u4").tobytes()
    names = ["piece", "doc_id", "start", "length", "doc_tokens", "size_class", "part", "place", "ids"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(vocabulary_path) as codes:
            yield from cut_with(codes, batches)

    def cut_with(codes: Encoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        placed, number = np.zeros(capacity // grain + 1, "i8"), part << 33
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for key, ids in zip(batch.column(0).to_pylist(), encoded(batch.column(1).to_pylist(), codes), strict=True):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    length = min(capacity, total - start)
                    kind = -(-length // grain)
                    rows.append((number, key, start, length, total, kind, part, int(placed[kind]), ids[4 * start : 4 * (start + length)]))
                    placed[kind] += 1
                    number += 1
                size += len(ids)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)

    return docs.select(F.col(f"`{id_column}`").alias("doc_id"), text_or_empty(text_column).alias("text")).mapInArrow(_typed(cut, schema), schema)


def _typed(function, schema: str):
    """Casts batches to the Arrow form of ``schema``, also where a column holds nulls only."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def typed(batches):
        for batch in function(batches):
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, target, strict=True)], schema=target)

    return typed


def best_pattern(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: items of size 1..capacity with ``values[size]``; the value and counts."""
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, int)
    for room in range(1, capacity + 1):
        options = best[room - 1 :: -1][:room] + values[1 : room + 1]
        size = int(np.argmax(options)) + 1
        if options[size - 1] > best[room - 1]:
            best[room], took[room] = options[size - 1], size
        else:
            best[room] = best[room - 1]
    counts, room = np.zeros(capacity + 1, "i8"), capacity
    while room > 0:
        if took[room]:
            counts[took[room]] += 1
            room -= took[room]
        else:
            room -= 1
    return float(best[capacity]), counts


def cutting_plan(demand: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """(times, counts by class) patterns that together hold exactly ``demand`` (index = class)."""
    demand = demand.astype("i8")
    classes = np.flatnonzero(demand)
    if not len(classes):
        return []
    most = capacity // classes
    columns = [np.where(np.arange(capacity + 1) == c, m, 0) for c, m in zip(classes, most, strict=True)]
    inverse, amounts = np.diag(1.0 / most), demand[classes] / most
    for _ in range(40 * len(classes) + 200):
        prices = inverse.sum(axis=0)  # every pattern costs one sequence
        values = np.zeros(capacity + 1)
        values[classes] = prices
        worth, pattern = best_pattern(values, capacity)
        if worth <= 1 + 1e-7:
            break
        direction = inverse @ pattern[classes]
        ratios = np.where(direction > 1e-10, amounts / np.where(direction > 1e-10, direction, 1), np.inf)
        leaving = int(np.argmin(ratios))
        amounts = np.maximum(amounts - ratios[leaving] * direction, 0)
        amounts[leaving] = ratios[leaving]
        inverse[leaving] /= direction[leaving]
        others = np.arange(len(classes)) != leaving
        inverse[others] -= np.outer(direction[others], inverse[leaving])
        columns[leaving] = pattern
    plan, left = [], demand.copy()
    for amount, column in sorted(zip(amounts, columns, strict=True), key=lambda x: -x[0]):
        use = column > 0
        times = int(min(np.floor(amount + 1e-6), (left[use] // column[use]).min()))
        if times > 0:
            plan.append((times, column.copy()))
            left -= times * column
    while left.any():  # largest first, as often as what is left allows
        pattern, room = np.zeros(capacity + 1, "i8"), capacity
        for c in np.flatnonzero(left)[::-1]:
            pattern[c] = min(left[c], room // c)
            room -= c * pattern[c]
        use = pattern > 0
        times = int((left[use] // pattern[use]).min())
        plan.append((times, pattern))
        left -= times * pattern
    return plan


def sequence_plan(pieces: DataFrame, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """(piece, sequence_id, offset, used) of every piece; ``pieces`` must be a written table."""
    units = capacity // grain
    narrow = pieces.select("piece", "length", "size_class", "part", "place")
    counted = narrow.groupBy("size_class", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("size_class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counted = written(counted.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "pack-classes")
    demand = np.zeros(units + 1, "i8")
    for kind, n in counted.groupBy("size_class").agg(F.sum("n")).collect():  # a row per class
        demand[kind] = n
    plan = cutting_plan(demand, units)
    first = np.cumsum([0, *(times for times, _ in plan)])
    slots: dict[int, list[tuple[int, int, int]]] = {}  # class: (first rank, first sequence, pieces each)
    for (times, pattern), sequence in zip(plan, first, strict=False):
        for kind in np.flatnonzero(pattern):
            ranges = slots.setdefault(int(kind), [])
            ranges.append((0 if not ranges else ranges[-1][3], int(sequence), int(pattern[kind]), (0 if not ranges else ranges[-1][3]) + times * int(pattern[kind])))
    arrays = {kind: tuple(np.array(c, "i8") for c in zip(*ranges, strict=True)) for kind, ranges in slots.items()}

    def assign(batches):
        for batch in batches:
            piece, length, kind, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            sequence, slot = np.zeros(len(rank), "i8"), np.zeros(len(rank), "i8")
            for k in np.unique(kind):
                here = np.flatnonzero(kind == k)
                starts, sequences, each, _ = arrays[int(k)]
                at = np.searchsorted(starts, rank[here], "right") - 1
                inside = rank[here] - starts[at]
                sequence[here] = sequences[at] + inside // each[at]
                slot[here] = (units - k) * (units + 1) + inside % each[at]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (piece, length, sequence, slot)], ["piece", "length", "sequence_id", "slot"])

    ranked = narrow.join(counted.select("size_class", "part", "before"), ["size_class", "part"]).select(
        "piece", "length", "size_class", (F.col("before") + F.col("place")).alias("rank"))
    placed = ranked.mapInArrow(assign, "piece bigint, length bigint, sequence_id bigint, slot bigint")
    inside = Window.partitionBy("sequence_id")  # at most capacity / grain rows
    earlier = inside.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(
        "piece", "sequence_id",
        F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("offset"),
        F.sum("length").over(inside).alias("used"),
    )


def pack_documents(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, grain: int = GRAIN, end_id: int = END_ID) -> tuple[DataFrame, DataFrame]:
    """(pieces with ids, places): two tables with key ``piece``; the first is written already."""
    pieces = written(token_pieces(docs, vocabulary_path, capacity, grain, end_id), "pack-pieces")
    return pieces, sequence_plan(pieces, capacity, grain)


def packed(pieces: DataFrame, places: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Digest of every piece with its place; ``sequence_length`` is the padded length."""
    power = F.bit_count(F.col("used")) == 1
    return pieces.select("piece", "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens").join(
        places.withColumn("sequence_length", F.when(power, F.col("used")).otherwise(F.lit(capacity))), "piece"
    ).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length")


def query(spark: SparkSession, folder: str) -> DataFrame:
    return packed(*pack_documents(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json")))
