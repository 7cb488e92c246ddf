"""Byte-level BPE of whole texts through a table of distinct words, and back through a table of pieces.

A byte-level vocabulary splits at white space before any merge, so a text is the sequence of its words
"white space, then what follows it", each encoded by itself, and a word's ids are the same everywhere.

1. A map cuts the texts into words and writes blocks of documents: the block's distinct words in bundles
   by their checksum, and every word of its texts as a number among them. Words that recur in a block leave
   it once, whatever their share of the corpus; the numbers never leave their file.
2. Bundles of one checksum range meet in one task: there the distinct words of all blocks form one table,
   and each is encoded once, by the tokenizers library. The number of ranges grows with the texts.
3. Ids join the blocks, and each block, its numbers read from the file, gathers its documents' ids by position.
4. The vocabulary's table of pieces, one piece per id, joins the blocks as well; ids become bytes by their
   place in it, bytes become text. ``decode_ids`` does the same for any table of ids with a row per id.

A null text is empty: no ids, an empty text. Strings of special tokens inside texts become their ids, as the
library has it by default; truncation and padding that a vocabulary file may ask for are not used. Ids
unknown to the vocabulary decode to nothing, bytes that are no UTF-8 to replacement characters. Repeated rows
and equal or null document ids are documents of their own. An empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from strandframe.llm.common import table, text_or_empty, written
from strandframe.llm.shards import in_batches, read_shard
from strandframe.llm.tokens import PIECES, vocabulary

# Text of a block, and text whose words one task encodes.
BLOCK_BYTES, RANGE_BYTES = 8 << 20, 32 << 20


def packed(values: np.ndarray) -> bytes:
    """Numbers below 2^32 byte by byte, so that their many high zeros compress away."""
    return pa.compress(np.ascontiguousarray(values.astype("<u4").view("u1").reshape(-1, 4).T), "zstd", asbytes=True) if len(values) else b""


def unpacked(data: bytes, count: int) -> np.ndarray:
    if not count:
        return np.zeros(0, "i8")
    return np.ascontiguousarray(np.frombuffer(pa.decompress(data, 4 * count, "zstd"), "u1").reshape(4, count).T).view("<u4").ravel().astype("i8")


@functools.lru_cache(maxsize=1)
def library(path: str):
    """The vocabulary, once per worker process."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def check_vocabulary(path: str) -> None:
    """Words can be encoded apart only where the vocabulary splits at white space and changes nothing before."""
    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    splitter = found.get("pre_tokenizer") or {}
    special = [t for t in found["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"] or PIECES.findall(t["content"]) != [t["content"]]]
    if found["normalizer"] or splitter.get("type") != "ByteLevel" or splitter["add_prefix_space"] or not splitter.get("use_regex", True) or special:
        raise ValueError(f"{path}: not a byte-level vocabulary that splits at white space alone")


def word_blocks(docs: DataFrame, id_column: str, text_column: str, ranges: int) -> DataFrame:
    """(block, ids, sizes, places, total, dealt, bundles), written: documents as numbers of the block's own words.

    Words are numbered as they come first. A place is 0 at a word's first, else the word's number and one;
    ``dealt`` is each word's range, in order of the numbers.
    """
    read = docs.select(F.col(f"`{id_column}`").alias("id"), text_or_empty(text_column).alias("text"))
    kind = read.schema["id"].dataType.simpleString()
    schema = StructType.fromDDL(f"ids array<{kind}>, sizes binary, places binary, total bigint, dealt binary, bundles array<struct<range:int,count:int,sizes:binary,words:binary,bytes:bigint>>")
    target = to_arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_batches(batches, 1, BLOCK_BYTES):
            if not batch.num_rows:
                continue
            known: dict[str, int] = {}
            sizes, places = [], []
            for text in batch.column(1).to_pylist():
                words = PIECES.findall(text)
                sizes.append(len(words))
                places.append(np.fromiter((known.setdefault(w, len(known)) for w in words), "<u4", len(words)))
            places = np.concatenate(places)
            if len(places):
                places = np.where(np.append(True, places[1:] > np.maximum.accumulate(places)[:-1]), 0, places + 1)
            spelled = [w.encode("utf8", "surrogatepass") for w in known]
            dealt = np.fromiter((zlib.crc32(w) % ranges for w in spelled), "i8", len(spelled))
            order = np.argsort(dealt, kind="stable")
            lengths = np.fromiter(map(len, spelled), "i8", len(spelled))[order]
            spelled = [spelled[i] for i in order.tolist()]
            present, first = np.unique(dealt[order], return_index=True)
            bundles = []
            for r, a, b in zip(present.tolist(), first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
                data = b"".join(spelled[a:b])
                bundles.append({"range": r, "count": b - a, "sizes": packed(lengths[a:b]), "words": pa.compress(data, "zstd", asbytes=True), "bytes": len(data)})
            ids = batch.column(0)
            columns = [
                pa.ListArray.from_arrays(pa.array([0, len(ids)], "int32"), ids),
                pa.array([packed(np.asarray(sizes))], pa.binary()),
                pa.array([packed(places)], pa.binary()),
                pa.array([len(places)]),
                pa.array([packed(dealt)], pa.binary()),
                pa.array([bundles], target.field("bundles").type),
            ]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    return written(read.mapInArrow(cut, schema).select(F.monotonically_increasing_id().alias("block"), "*"), "word-blocks")


def encode_bundles(blocks: DataFrame, path: str, ranges: int) -> DataFrame:
    """(block, range, count, sizes, ids): the ids of each bundle's words; a word is encoded once."""
    bundles = blocks.select("block", F.explode("bundles").alias("b")).select("block", "b.*")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bytes] = {}
        for batch in batches:
            sizes, ids = [], []
            for count, lengths, data, total in zip(*(batch.column(c).to_pylist() for c in ("count", "sizes", "words", "bytes")), strict=True):
                data = pa.decompress(data, total, "zstd", asbytes=True) if total else b""
                ends = np.cumsum(unpacked(lengths, count)).tolist()
                words = [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
                new = [w for w in words if w not in known]
                for start in range(0, len(new), 10_000):
                    part = new[start : start + 10_000]
                    codes = library(path).encode_batch([w.decode("utf8", "surrogatepass") for w in part], add_special_tokens=False)
                    known.update((w, np.asarray(code.ids, "<u4").tobytes()) for w, code in zip(part, codes, strict=True))
                found = [known[w] for w in words]
                sizes.append(packed(np.fromiter(map(len, found), "i8", count) // 4))
                ids.append(packed(np.frombuffer(b"".join(found), "<u4")))
            columns = [batch.column("block"), batch.column("range"), batch.column("count"), pa.array(sizes, pa.binary()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "range", "count", "sizes", "ids"])

    dealt = bundles.repartitionById(ranges, F.col("range"))
    return dealt.mapInArrow(encode, "block bigint, range int, count int, sizes binary, ids binary")


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece) of a byte-level vocabulary, pieces as bytes; as many rows as the vocabulary has entries."""
    # The alphabet of byte-level vocabularies: a visible Latin-1 byte stands for itself, the others
    # follow from code point 256 on.
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    alphabet = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    rows = []
    for token, number in library(path).get_vocab(with_added_tokens=True).items():
        rows.append((number, bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()))
    return spark.createDataFrame(rows, "id int, piece binary")


def decode_ids(frame: DataFrame, key: str, path: str, ids_column: str = "ids") -> DataFrame:
    """(key, bytes) of every row of ``frame`` that has ids; ``key`` tells its rows apart."""
    each = frame.select(key, F.posexplode(ids_column).alias("position", "id"))
    met = each.join(F.broadcast(pieces(frame.sparkSession, path)), "id")  # a vocabulary's size at most
    ordered = F.array_sort(F.collect_list(F.struct("position", F.hex("piece").alias("piece"))))
    return met.groupBy(key).agg(F.unhex(F.array_join(F.transform(ordered, lambda p: p["piece"]), "")).alias("bytes"))


def encode_documents(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(id, ids, text) of every document: its ids, and the text that they decode to."""
    check_vocabulary(path)
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text_or_empty(text_column)))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // range_bytes))
    blocks = word_blocks(docs, id_column, text_column, ranges)
    known = encode_bundles(blocks, path, ranges).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("range", "count", "sizes", "ids"))).alias("known"))
    # The id-to-piece table as one row of the vocabulary, in order of the ids: of a fixed size.
    listed = pieces(spark, path).groupBy(F.lit(path).alias("vocabulary")).agg(F.array_sort(F.collect_list(F.struct("id", "piece"))).alias("pieces"))
    kept = blocks.select("block", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), F.lit(path).alias("vocabulary"))
    whole = kept.join(known, "block", "left").join(F.broadcast(listed), "vocabulary").select("file", "row", "known", "pieces")
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    schema = StructType.fromDDL(f"id {kind}, ids array<int>, text string")
    target = to_arrow_schema(schema)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, row, known, listed in zip(*(batch.column(i) for i in range(4)), strict=True):
                for columns in gathered(read_block(file.as_py(), row.as_py()), known, listed):
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    return whole.mapInArrow(gather, schema).withColumnRenamed("id", id_column)


def read_block(uri: str, row: int) -> pa.RecordBatch:
    """One row of a file of blocks."""
    for at, found in read_shard(uri, ["ids", "sizes", "places", "total", "dealt"], 1):
        if at == row:
            return found
    raise ValueError(f"{uri} has no row {row}")


def gathered(block: pa.RecordBatch, known: pa.ListScalar, listed: pa.ListScalar) -> Iterator[list[pa.Array]]:
    """Keys, ids and texts of a block's documents, about a million words at a time."""
    keys, sizes, places, total, dealt = (block.column(n)[0] for n in ("ids", "sizes", "places", "total", "dealt"))
    keys = keys.values
    sizes, places = unpacked(sizes.as_py(), len(keys)), unpacked(places.as_py(), total.as_py())
    new = places == 0
    places[new] = np.arange(1, np.count_nonzero(new) + 1)
    places -= 1
    # The bundles' words come by range; the block's own numbers tell them apart.
    bundles = known.as_py() or []
    order = np.argsort(unpacked(dealt.as_py(), sum(b["count"] for b in bundles)), kind="stable")
    lengths = np.zeros(len(order), "i8")
    parts = [unpacked(b["sizes"], b["count"]) for b in bundles]
    ids = [unpacked(b["ids"], int(n.sum())) for b, n in zip(bundles, parts, strict=True)]
    del bundles
    begins = lengths.copy()
    if parts:
        lengths[order] = np.concatenate(parts)
        begins[order] = np.cumsum(lengths[order]) - lengths[order]
    ids = np.concatenate(ids).astype("i4") if ids else np.zeros(0, "i4")
    numbers, spelled = listed.values.field(0).to_numpy(), listed.values.field(1).to_pylist()
    decoded = [b""] * (int(numbers.max()) + 1)
    for number, piece in zip(numbers.tolist(), spelled, strict=True):
        decoded[number] = piece
    ends = np.append(0, np.cumsum(sizes))
    first = 0
    while first < len(keys):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + (1 << 19), "right")) - 1)
        here = places[ends[first] : ends[last]]
        counts = lengths[here]
        upto = np.append(0, np.cumsum(counts))
        flat = ids[np.repeat(begins[here] - upto[:-1], counts) + np.arange(upto[-1])]
        cuts = upto[ends[first : last + 1] - ends[first]]
        bytes_of = [decoded[i] for i in flat.tolist()]
        texts = [b"".join(bytes_of[a:b]).decode("utf-8", "replace") for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        yield [keys.slice(first, last - first), pa.ListArray.from_arrays(pa.array(cuts, "int32"), pa.array(flat, "int32")), pa.array(texts, pa.string())]
        first = last


def query(spark: SparkSession, folder: str) -> DataFrame:
    found = encode_documents(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"))
    return found.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
