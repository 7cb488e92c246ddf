"""Suffix-array deduplication: bytes covered by a long string that also starts elsewhere.

A full suffix array over the corpus would move every suffix. Instead every window of ``length`` bytes
names one anchor inside it, the ``GRAM``-byte string of least hash (the first of equals). Equal windows
name equal anchors at equal places, so a window recurs only among the windows of its anchor's hash.
The windows that name one occurrence of an anchor are consecutive; their union is its context.

1. A map over shards finds anchors and contexts and hashes both.
2. Contexts that occur twice as a whole are repeated throughout: counting settles them, whatever the
   number of copies.
3. Contexts that differ but share an anchor are brought together, one of each kind, in shards of a
   fixed number of contexts. In each, the suffix array is refined in numpy by Larsson and Sadakane's
   doubling, Kasai's algorithm gives common prefixes, and windows with a common prefix of ``length``
   bytes are repeated. An anchor with more contexts than a shard holds is split over several; one window
   of each kind of theirs is hashed, and hashes of one range from all shards are ordered and compared.
4. Repeated windows go back to their shard as runs, where the text is cut.

So the suffix order decides between contexts that share an anchor and differ. Contexts that are equal as a
whole, and windows of an anchor that is split, are matched by two 64-bit hashes: of anchor and context, or of
the window twice.

Windows are judged on the input and never cross documents. A null text is empty. Repeated rows count
as documents of their own; empty tables give no rows. Cuts may fall inside a UTF-8 character, so the
kept bytes are binary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm.common import table, text_or_empty, written
from strandframe.llm.shards import Marks, PrefixHash, Shards, byte_values, in_batches, joined, mix, read_shard, slide_least

LENGTH, GRAM, SHARD_CONTEXTS = 200, 64, 4096
ANCHORS = "anchor bigint, context bigint, shard int, row int, start int, windows int"


def find_anchors(data: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, context hash, text number, first window, windows) over joined texts."""
    texts = np.flatnonzero(np.diff(bounds) >= length)
    if not len(texts):
        return tuple(np.zeros(0, "i8") for _ in range(5))
    hashed = PrefixHash(byte_values()[data])
    places = np.arange(len(data) - gram + 1)
    grams = hashed.of(places, places + gram)
    width = length - gram + 1  # grams in a window
    least = slide_least(grams, width)
    # Windows inside one text.
    counts = np.diff(bounds)[texts] - length + 1
    first = np.repeat(bounds[texts] - np.cumsum(counts) + counts, counts)
    windows = np.arange(counts.sum()) + first
    owner = np.repeat(texts, counts)
    value = least[windows]
    # The first gram at or after the window's start that has the least value.
    pointed = np.full(len(grams), False)
    reach = ~slide_least(~np.concatenate([np.zeros(width - 1, "u8"), least, np.zeros(width - 1, "u8")]), width)
    pointed = np.flatnonzero(grams == reach)
    at = np.searchsorted(pointed, windows)
    wrong = np.flatnonzero(grams[pointed[at]] != value)
    while len(wrong):
        at[wrong] += 1
        wrong = wrong[grams[pointed[at[wrong]]] != value[wrong]]
    place = pointed[at]
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])]))
    size = np.diff(np.concatenate([new, [len(place)]]))
    start = windows[new]
    context = hashed.of(start, start + size + length - 1) + (place[new] - start).astype("u8")
    return grams[place[new]].view("i8"), context.view("i8"), owner[new], start - bounds[owner[new]], size


def group_order(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the order by ``second`` inside the groups of ``first``, ties by place; where a new pair begins).

    ``first`` does not fall. Group, value and place are packed into one number, since numbers are sorted much
    quicker than places by several keys.
    """
    n = len(first)
    group = np.cumsum(np.append(False, first[1:] != first[:-1])).astype("u8")
    places, values = (n - 1).bit_length(), int(second.max()).bit_length()
    if places + values + int(group[-1]).bit_length() > 64:
        by = np.lexsort((second, group))
        pairs = (group[by], second[by])
    else:
        packed = np.sort(((group << np.uint64(values) | second.astype("u8")) << np.uint64(places)) | np.arange(n, dtype="u8"))
        by = (packed & np.uint64((1 << places) - 1)).astype("i8")
        pairs = (packed >> np.uint64(places),)
    fresh = np.append(True, np.any([p[1:] != p[:-1] for p in pairs], axis=0))
    return by, fresh


def suffix_order(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Suffix array of several texts, each ending in the same smallest symbol; ties by place.

    Larsson and Sadakane: ranks of the first h symbols give those of 2h, and only suffixes in
    groups that are still tied are sorted again.
    """
    n = len(data)
    end = np.repeat(bounds[1:], np.diff(bounds))
    left = end - np.arange(n)  # symbols to the end of the own text
    key = np.zeros(n, "u8")
    padded = np.concatenate([data.astype("u8") + np.uint64(1), np.zeros(7, "u8")])
    for i in range(7):  # seven symbols of nine bits
        key = (key << np.uint64(9)) | np.where(left > i, padded[i : i + n], 0)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    fresh = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    rank = np.empty(n, "i8")
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    h = 7
    longest = int(left.max(initial=0))
    while h < longest:
        in_order = rank[order]
        again = in_order[1:] == in_order[:-1]
        tied = np.flatnonzero(np.append(again, False) | np.append(False, again))
        if not len(tied):
            break
        part = order[tied]
        second = np.where(left[part] > h, rank[np.minimum(part + h, n - 1)] + 1, 0)
        first = in_order[tied]
        by, fresh = group_order(first, second)
        part = part[by]
        order[tied] = part
        rank[part] = np.maximum.accumulate(np.where(fresh, tied, 0))
        h *= 2
    return order


def common_prefixes(data: np.ndarray, bounds: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Kasai: the common prefix of every suffix with the one before it, all texts side by side."""
    n = len(data)
    place = np.empty(n, "i8")
    place[order] = np.arange(n)
    end = np.repeat(bounds[1:], np.diff(bounds))
    out = np.zeros(n, "i4")
    lane = np.flatnonzero(np.diff(bounds) > 0)
    i, stop = bounds[:-1][lane].copy(), bounds[1:][lane]
    h = np.zeros(len(lane), "i8")
    while len(i):
        at = place[i]
        j = order[np.maximum(at - 1, 0)]
        inside = (at > 0) & (i + h < end[i]) & (j + h < end[j])
        grows = inside & (data[np.minimum(i + h, n - 1)] == data[np.minimum(j + h, n - 1)])
        done = ~grows
        out[at[done]] = h[done]
        h = np.where(grows, h + 1, np.maximum(h - 1, 0))
        i = np.where(grows, i, i + 1)
        live = i < stop
        if not live.all():
            i, h, stop = i[live], h[live], stop[live]
    return out


def repeated_starts(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of ``length``-symbol windows, in suffix order, and the number of their kind."""
    order = suffix_order(data, bounds)
    shared = common_prefixes(data, bounds, order)
    end = np.repeat(bounds[1:], np.diff(bounds))
    long = np.flatnonzero(end[order] - order >= length)
    # Between two windows of a kind only suffixes with the same prefix stand, and those are windows.
    kind = np.cumsum(shared[long] < length)
    return order[long], kind


MARKS = ["start", "windows", "anchor", "salt", "single"]


def contexts_of(shards: Shards, marks: DataFrame, length: int) -> DataFrame:
    """The bytes of marked contexts, each read from its shard's file."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = Marks(batches, MARKS)
        for shard, uri in stream.shards():
            if not stream.any():
                continue
            for first, texts in read_shard(uri, ["text"]):
                row, start, windows, anchor, salt, single = stream.upto(first + texts.num_rows)
                if not len(row):
                    continue
                needed, at = np.unique(row - first, return_inverse=True)
                found = [x.encode("utf8", "surrogatepass") for x in texts.column(0).take(pa.array(needed)).to_pylist()]
                cut = [found[t][s : s + w + length - 1] for t, s, w in zip(at.tolist(), start.tolist(), windows.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(salt), pa.array(np.full(len(row), shard, "i4")), pa.array(row), pa.array(start), pa.array(single.astype(bool)), pa.array(cut, pa.binary())],
                    ["anchor", "salt", "shard", "row", "start", "single", "bytes"])

    return shards.beside(marks, MARKS).mapInArrow(read, "anchor bigint, salt int, shard int, row int, start int, single boolean, bytes binary")


def run_rows(places: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, owner, length) of the runs of consecutive places of one owner."""
    order = np.argsort(places)
    places, owner = places[order], owner[order]
    new = np.flatnonzero(np.append(True, (places[1:] != places[:-1] + 1) | (owner[1:] != owner[:-1]))) if len(places) else np.zeros(0, "i8")
    return places[new], owner[new], np.diff(np.append(new, len(places)))


def compare_contexts(contexts: DataFrame, length: int, shard_contexts: int, partitions: int) -> DataFrame:
    """(shard, row, start, windows) runs of repeated windows in contexts that occur once."""
    FOUND = "open boolean, a bigint, b bigint, shard int, row int, start int, windows int"
    names = [f.split()[0] for f in FOUND.split(", ")]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        rows = pa.Table.from_batches(batches).combine_chunks()
        anchors = rows.column("anchor").to_numpy()
        by = np.argsort(anchors, kind="stable")
        cuts = [0]
        cuts += [i for i in range(1, len(by)) if anchors[by[i]] != anchors[by[i - 1]]]
        # Groups of whole anchors of about a shard each.
        bounds, start = [0], 0
        for c in [*cuts[1:], len(by)]:
            if c - start >= shard_contexts:
                bounds.append(c)
                start = c
        if bounds[-1] != len(by):
            bounds.append(len(by))
        for a, b in zip(bounds, bounds[1:], strict=False):
            part = rows.take(pa.array(by[a:b]))
            data, ends = joined(part.column("bytes").to_pylist())
            starts, kind = repeated_starts(data, ends, length)
            owner = np.searchsorted(ends, starts, "right") - 1
            salted, single = part.column("salt").to_numpy()[owner] >= 0, part.column("single").to_numpy()[owner]
            shard, row, begin = (part.column(c).to_numpy() for c in ("shard", "row", "start"))
            # Windows with an equal here are settled, as runs; contexts that occur more often are so anyway.
            again = (np.bincount(kind)[kind] > 1) if len(kind) else np.zeros(0, bool)
            place, own, size = run_rows(starts[again & single], owner[again & single])
            yield _found(names, np.zeros((2, len(place)), "i8"), False, shard[own], row[own], begin[own] + place - ends[own], size)
            # One window of every kind of a split anchor goes on to the other shards.
            more = np.append(True, kind[1:] != kind[:-1]) & salted if len(kind) else np.zeros(0, bool)
            if more.any():
                own, place = owner[more], starts[more]
                hashes = [PrefixHash(values[data]).of(place, place + length).view("i8") for values in (byte_values(), mix(byte_values()))]
                hashes[0] ^= part.column("anchor").to_numpy()[own]
                yield _found(names, np.stack(hashes), True, shard[own], row[own], begin[own] + place - ends[own], np.ones(len(own), "i8"))

    dealt = contexts.repartition(partitions, "anchor", "salt")
    local = written(dealt.mapInArrow(merge, FOUND), "suffix-windows")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows of one range of hashes from all shards: those whose hashes stand there again."""
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        rows = pa.Table.from_batches(batches)
        a, b = (rows.column(n).to_numpy() for n in ("a", "b"))
        order = np.lexsort((b, a))
        same = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
        yield from rows.select(["shard", "row", "start", "windows"]).take(pa.array(np.sort(order[np.append(same, False) | np.append(False, same)]))).to_batches()

    spans = ["shard", "row", "start", "windows"]
    split = local.filter("open").select("a", "b", *spans).repartition("a").mapInArrow(search, "shard int, row int, start int, windows int")
    return local.filter("NOT open").select(*spans).union(split)


def _found(names: list[str], hashes: np.ndarray, is_open: bool, shard: np.ndarray, row: np.ndarray, start: np.ndarray, windows: np.ndarray) -> pa.RecordBatch:
    columns = [np.full(len(row), is_open), *hashes, *(c.astype("i4") for c in (shard, row, start, windows))]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def repeated_spans(shards: Shards, length: int = LENGTH, gram: int = GRAM, shard_contexts: int = SHARD_CONTEXTS) -> DataFrame:
    """(shard, row, start, windows): runs of windows whose bytes also start elsewhere."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_batches(batches, 2):
            texts = [t.encode("utf8", "surrogatepass") for t in batch.column(2).to_pylist()]
            anchor, context, text, start, size = find_anchors(*joined(texts), length, gram)
            shard, row = (batch.column(i).to_numpy()[text] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(context), pa.array(shard), pa.array(row), pa.array(start.astype("i4")), pa.array(size.astype("i4"))],
                                             ["anchor", "context", "shard", "row", "start", "windows"])

    found = written(shards.rows("text").mapInArrow(anchors, ANCHORS), "suffix-anchors")
    classes = found.groupBy("anchor", "context").agg(F.count("*").alias("times"), F.min(F.struct("shard", "row", "start", "windows")).alias("first"))
    classes = written(classes, "suffix-classes")
    groups = classes.groupBy("anchor").agg(F.count("*").alias("contexts")).filter("contexts > 1")
    whole = found.join(classes.filter("times > 1").select("anchor", "context"), ["anchor", "context"], "left_semi").select("shard", "row", "start", "windows")
    mixed = classes.join(groups, "anchor")
    parts = F.ceil(F.col("contexts") / F.lit(shard_contexts))
    salt = F.when(F.col("contexts") > shard_contexts, F.pmod(F.xxhash64("context"), parts)).otherwise(-1).cast("int")
    marks = mixed.select("first.*", "anchor", salt.alias("salt"), (F.col("times") == 1).alias("single"))
    marks = written(marks, "suffix-marks")
    tasks = max(-(-marks.count() // (2 * shard_contexts)), int(shards.spark.conf.get("spark.sql.shuffle.partitions")))
    partial = compare_contexts(contexts_of(shards, marks, length), length, shard_contexts, tasks)
    return whole.union(partial)


def cut_spans(shards: Shards, spans: DataFrame, length: int = LENGTH) -> DataFrame:
    """Every document with n_bytes, spans (merged, [from, to)) and the kept bytes."""
    id_type = shards.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks(batches, ["start", "windows"])
        for _, uri in marks.shards():
            for first, rows in read_shard(uri, ["doc_id", "text"]):
                row, start, windows = marks.upto(first + rows.num_rows)
                stop = start + windows + length - 1
                sizes, merged, kept = [], [], []
                for k, text in enumerate(rows.column(1).to_pylist()):
                    data = text.encode("utf8", "surrogatepass")
                    a, b = np.searchsorted(row, [first + k, first + k + 1])
                    runs = union_of(start[a:b], stop[a:b])
                    sizes.append(len(data))
                    merged.append(runs.tolist())
                    inner = np.concatenate([[0], runs.ravel(), [len(data)]])
                    kept.append(b"".join(data[x:y] for x, y in inner.reshape(-1, 2)))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(sizes, "int64"), pa.array(merged, pa.list_(pa.list_(pa.int32()))), pa.array(kept, pa.binary())],
                    ["doc_id", "n_bytes", "spans", "kept"])

    return shards.beside(spans, ["start", "windows"]).mapInArrow(cut, f"doc_id {id_type}, n_bytes bigint, spans array<array<int>>, kept binary")


def union_of(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Sorted intervals merged where they touch."""
    if not len(start):
        return np.zeros((0, 2), "i8")
    reach = np.maximum.accumulate(stop)
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(start) - 1]])
    return np.stack([start[new], reach[last]], axis=1)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_contexts: int = SHARD_CONTEXTS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept) per row of ``docs``."""
    shards = Shards(docs.select(F.col(f"`{id_column}`").alias("doc_id"), text_or_empty(text_column).alias("text")), "suffix-docs")
    return cut_spans(shards, repeated_spans(shards, length, gram, shard_contexts), length)


def query(spark: SparkSession, folder: str) -> DataFrame:
    found = remove_repeats(table(spark, folder, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + (s[1] - s[0]))
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
