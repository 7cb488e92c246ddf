"""Token ids in files of fixed-width packed bits, and back.

A file holds the documents of one key range in order. Layout, little-endian:

* blocks of ``BLOCK`` ids, each packed in the fewest bits that hold the vocabulary; the last is short;
* the block offsets, the document ids and the token starts of the documents (unsigned / signed 64-bit);
* a footer of six 64-bit numbers: bits, block size, blocks, documents, ids, format number.

With the footer and the block offsets, any id is found by one ranged read and unpacked by numpy.

Files are written by the tasks under a name of their attempt, then moved to the final name, so a
repeated task replaces its file by an equal one. Rows are ordered by (id, hash of the text,
text); null ids come first, null texts are empty, repeated rows are written once each, an empty table gives no file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandframe.llm.common import qualified, scratch, table, text_or_empty, written
from strandframe.llm.tokens import encoded, encoder, vocabulary

BLOCK, FORMAT, NO_ID, END_ID = 8192, 1, -(1 << 63), 0
FOOTER = 48
FILE = "file string, number int, documents bigint, ids bigint"


def bits_for(size: int) -> int:
    return max(1, int(size - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype("<u4")[:, None] >> np.arange(bits, dtype="u4")) & 1
    return np.packbits(spread.astype("u1").ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, count: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype("<u4")
    spread = np.unpackbits(np.frombuffer(data, "u1"), count=count * bits, bitorder="little").reshape(count, bits)
    return (spread.astype("<u4") << np.arange(bits, dtype="u4")).sum(axis=1, dtype="<u4")


class BlockWriter:
    def __init__(self, stream, bits: int, block: int = BLOCK):
        self.stream, self.bits, self.block = stream, bits, block
        self.waiting, self.held, self.at, self.total = [], 0, 0, 0
        self.offsets, self.keys, self.starts = [], [], []

    def add(self, key: int, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.starts.append(self.total)
        self.total += len(ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            self.flush(False)

    def flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, "<u4")
        end = len(ids) if last else len(ids) // self.block * self.block
        for start in range(0, end, self.block):
            data = pack_bits(ids[start : min(start + self.block, end)], self.bits)
            self.offsets.append(self.at)
            self.stream.write(data)
            self.at += len(data)
        self.waiting, self.held = [ids[end:]], len(ids) - end

    def finish(self) -> None:
        self.flush(True)
        for values, kind in ((self.offsets, "<u8"), (self.keys, "<i8"), (self.starts, "<u8")):
            self.stream.write(np.asarray(values, kind).tobytes())
        self.stream.write(np.asarray([self.bits, self.block, len(self.offsets), len(self.keys), self.total, FORMAT], "<i8").tobytes())


class BlockReader:
    """Random access to the documents of one file; reads only the blocks asked for."""

    def __init__(self, stream):
        self.stream = stream
        size = stream.size()
        self.bits, self.block, blocks, docs, self.total, kind = np.frombuffer(self._read(size - FOOTER, FOOTER), "<i8").tolist()
        if kind != FORMAT:
            raise ValueError(f"unknown format {kind}")
        index = self._read(size - FOOTER - 8 * (blocks + 2 * docs), 8 * (blocks + 2 * docs))
        self.end = size - FOOTER - len(index)
        self.offsets = np.frombuffer(index, "<u8", blocks).astype("i8")
        self.keys = np.frombuffer(index, "<i8", docs, 8 * blocks)
        self.starts = np.frombuffer(index, "<u8", docs, 8 * (blocks + docs)).astype("i8")

    def _read(self, start: int, length: int) -> bytes:
        self.stream.seek(start)
        return self.stream.read(length)

    def ids(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        bounds = np.append(self.offsets, self.end)
        data = self._read(int(bounds[first]), int(bounds[last + 1] - bounds[first]))
        parts = [
            unpack_bits(data[bounds[b] - bounds[first] : bounds[b + 1] - bounds[first]], min(self.block, self.total - b * self.block), self.bits)
            for b in range(first, last + 1)
        ]
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]

    def document(self, number: int) -> np.ndarray:
        stop = self.starts[number + 1] if number + 1 < len(self.starts) else self.total
        return self.ids(int(self.starts[number]), int(stop))


def write_ids(docs: DataFrame, path: str, vocabulary_path: str, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Writes the files below ``path`` and returns their list, a written table."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        end = np.asarray([end_id], "<u4").tobytes()
        store, folder = fs.FileSystem.from_uri(qualified(path))
        store.create_dir(folder, recursive=True)
        attempt, name = f"{folder}/.{uuid.uuid4().hex}", f"part-{number:06d}.ids"
        writer = None
        with store.open_output_stream(attempt) as stream, encoder(vocabulary_path) as codes:
            for batch in batches:
                for key, ids in zip(batch.column(0).to_pylist(), encoded(batch.column(1).to_pylist(), codes), strict=True):
                    writer = writer or BlockWriter(stream, bits_for(codes.size))
                    writer.add(NO_ID if key is None else key, np.frombuffer(ids + end, "<u4"))
            if writer:
                writer.finish()
        if writer:
            store.move(attempt, f"{folder}/{name}")
            yield pa.RecordBatch.from_pydict({"file": [f"{path}/{name}"], "number": pa.array([number], "int32"), "documents": [len(writer.keys)], "ids": [writer.total]})
        else:
            store.delete_file(attempt)

    ordered = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("id"), text_or_empty(text_column).alias("text"))
    ordered = ordered.repartitionByRange(F.col("id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"), "text")
    return written(ordered.mapInArrow(write, FILE), "id-files")


def read_ids(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document; start counts the ids of all files before."""
    before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    listed = files.withColumn("before", F.coalesce(F.sum("ids").over(before), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, name = fs.FileSystem.from_uri(qualified(uri))
                with store.open_input_file(name) as stream:
                    file = BlockReader(stream)
                    limits = np.append(file.starts, file.total)
                    first = 0
                    while first < len(file.keys):  # documents of about a million ids at once
                        last = max(first + 1, int(np.searchsorted(limits, limits[first] + (1 << 20), "right")) - 1)
                        ids = file.ids(int(limits[first]), int(limits[last]))
                        cuts = limits[first : last + 1] - limits[first]
                        keys = file.keys[first:last]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(keys, mask=keys == NO_ID),
                                pa.array(limits[first:last] + base),
                                pa.array(np.diff(cuts)),
                                pa.array([ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                            ],
                            ["doc_id", "start", "n_tokens", "ids"],
                        )
                        first = last

    tasks = listed.select("file", "before").repartition(max(1, files.count()), "file")
    return tasks.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def query(spark: SparkSession, folder: str) -> DataFrame:
    files = write_ids(table(spark, folder, "documents"), scratch(spark, "ids"), vocabulary("byte_bpe_50k.json"))
    return read_ids(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
