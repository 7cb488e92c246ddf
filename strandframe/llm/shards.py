"""Documents in shard files that tasks can open again, and hashes of any substring in numpy.

A row is known by (shard, row), its file and its place there, whatever its id and columns hold.
Tasks that need a few texts of a shard, or its spans beside them, open the file instead of having
the texts shuffled to them. What they need to know of a shard comes as ordered rows, shard by shard.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandframe.llm.common import qualified, scratch

# Odd multiplier of the prefix hash and the seed of its symbol values: fixed, so that all tasks agree.
BASE, SEED = np.uint64(0x9E3779B97F4A7C15), 20240229
BATCH_BYTES = 1 << 20


class Shards:
    """Documents written once to the shared folder as ``name``; ``columns`` are kept beside the text."""

    def __init__(self, docs: DataFrame, name: str):
        self.spark: SparkSession = docs.sparkSession
        self.path = scratch(self.spark, name)
        docs.write.option("compression", "zstd").parquet(self.path)
        self.schema = docs.schema
        self.count = max(1, self.files().count())

    def rows(self, *columns: str) -> DataFrame:
        """(shard, row, columns) of the documents, through Spark's own scan."""
        frame = self.spark.read.schema(self.schema).parquet(self.path)
        return frame.select(_shard_number().alias("shard"), F.col("_metadata.row_index").cast("int").alias("row"), *[F.col(f"`{c}`") for c in columns])

    def files(self) -> DataFrame:
        """(shard, file), a row per file that holds rows."""
        frame = self.spark.read.schema(self.schema).parquet(self.path)
        return frame.select(_shard_number().alias("shard"), F.col("_metadata.file_path").alias("file")).distinct()

    def beside(self, marks: DataFrame, fields: list[str]) -> DataFrame:
        """(shard, file, row, fields): rows of ``marks`` (shard, row, fields) in a task per shard, in order.

        A shard begins with a row of its own, which names its file at row -1. The list of files, a
        few bytes each, is sent to every task.
        """
        places = self.files().withColumn("place", F.row_number().over(Window.orderBy("shard")) - 1)  # a row per file
        kinds = {f: marks.schema[f].dataType for f in fields}
        heads = places.select("place", "shard", "file", F.lit(-1).alias("row"), *[F.lit(None).cast(k).alias(f) for f, k in kinds.items()])
        rows = marks.join(F.broadcast(places.select("shard", "place")), "shard").select(
            "place", "shard", F.lit(None).cast("string").alias("file"), F.col("row").cast("int").alias("row"), *fields)
        dealt = heads.union(rows).repartitionById(self.count, "place").drop("place")
        return dealt.sortWithinPartitions("shard", "row", *fields[:1])


def _shard_number():
    def part(group: int):
        return F.regexp_extract("_metadata.file_name", r"^part-(\d+)-.*-c(\d+)\.", group).cast("bigint")

    return (part(1) * 1000 + part(2)).cast("int")


class Marks:
    """The marks of one shard after the other, from batches in the order of ``Shards.beside``."""

    def __init__(self, batches: Iterator[pa.RecordBatch], fields: list[str]):
        self.batches, self.fields = batches, ["row", *fields]
        self.batch, self.at = None, 0
        self._advance()

    def _advance(self) -> None:
        while self.batch is None or self.at >= self.batch.num_rows:
            self.batch = next(self.batches, None)
            if self.batch is None:
                return
            self.at, self.rows = 0, self.batch.column("row").to_numpy()

    def shards(self) -> Iterator[tuple[int, str]]:
        """(shard, file) in order; what is left of a shard's marks is skipped."""
        while self.batch is not None:
            head = self.batch.slice(self.at, 1)
            self.at += 1
            self._advance()
            yield head.column("shard")[0].as_py(), head.column("file")[0].as_py()
            self.upto(1 << 31)

    def any(self) -> bool:
        """Whether the shard has marks left."""
        return self.batch is not None and self.rows[self.at] >= 0

    def upto(self, limit: int) -> list[np.ndarray]:
        """Rows and fields of the shard's next marks, those of rows before ``limit``."""
        parts: list[list[np.ndarray]] = []
        while self.any() and self.rows[self.at] < limit:
            rest = self.rows[self.at :]
            stop = self.at + int(np.argmax(np.append((rest < 0) | (rest >= limit), True)))
            part = self.batch.slice(self.at, stop - self.at)
            parts.append([part.column(f).to_numpy(zero_copy_only=False) for f in self.fields])
            self.at = stop
            self._advance()
        return [np.concatenate(columns) for columns in zip(*parts, strict=True)] if parts else [np.zeros(0, "i8") for _ in self.fields]


def read_shard(uri: str, columns: list[str] | None = None, rows_at_once: int = 512) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(first row, batch) of a shard file in order."""
    store, path = fs.FileSystem.from_uri(qualified(uri))
    with store.open_input_file(path) as stream:
        file, at = pq.ParquetFile(stream), 0
        for batch in file.iter_batches(batch_size=rows_at_once, columns=columns):
            yield at, batch
            at += batch.num_rows


def without_rows(shards: Shards, dropped: DataFrame) -> DataFrame:
    """The documents without the rows (shard, row) of ``dropped``, read beside them: no text is shuffled."""
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(shards.schema)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks(batches, [])
        for _, uri in marks.shards():
            for first, rows in read_shard(uri):
                (gone,) = marks.upto(first + rows.num_rows)
                stays = np.ones(rows.num_rows, bool)
                stays[gone - first] = False
                kept = rows.filter(pa.array(stays))
                yield pa.RecordBatch.from_arrays([kept.column(kept.schema.get_field_index(f.name)).cast(f.type) for f in target], schema=target)

    return shards.beside(dropped, []).mapInArrow(keep, shards.schema)


def in_batches(batches: Iterator[pa.RecordBatch], text: int, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of about ``limit`` bytes of text; a longer text comes alone.

    The worker may have run another operator before: what that kept for its own next task goes first.
    """
    if (tokens := sys.modules.get("strandframe.llm.tokens")) is not None and tokens._encoders:
        tokens.forget_pieces()
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in one array and the bounds of each text."""
    bounds = np.cumsum([0, *map(len, texts)])
    return np.frombuffer(b"".join(texts), "u1"), bounds


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def byte_values() -> np.ndarray:
    return np.random.default_rng(SEED).integers(1, 1 << 63, 256, dtype="u8") * np.uint64(2) + np.uint64(1)


class PrefixHash:
    """Hash of any stretch of a sequence in constant time: equal stretches, equal hashes."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        powers = np.full(n + 1, BASE, "u8")
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        self.sums = np.zeros(n + 1, "u8")
        np.cumsum(values * powers[:n], out=self.sums[1:])
        self.powers = powers
        self.n = n

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Shifted to a common power, so that only content and length count."""
        h = (self.sums[stop] - self.sums[start]) * self.powers[self.n - start]
        # Equal lengths at different places now carry BASE ** n; the batch's own n is divided out.
        return mix(h * self._inverse() + (stop - start).astype("u8"))

    def _inverse(self) -> np.uint64:
        return np.uint64(pow(int(BASE), -self.n, 1 << 64))


def slide_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, by doubling."""
    size, current = 1, values
    while size * 2 <= width:
        current = np.minimum(current[:-size], current[size:])
        size *= 2
    rest, n = width - size, len(values) - width + 1
    return np.minimum(current[:n], current[rest : rest + n]) if rest else current[:n]
