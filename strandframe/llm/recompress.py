"""Substring deduplication by recompression: words covered by a long window that starts earlier too.

Words become symbols. The first round replaces every run of one symbol by a new symbol, each later
round every pair of a left and a right symbol by one; a bit of a symbol's hash says on which side it
stands, so pairs never overlap and every place decides by itself. New symbols are named by hashes of
what they stand for, so all tasks name equal runs and pairs alike, without a dictionary, and equal
substrings get the same symbols inside, but for a few at their ends. After ``ROUNDS`` rounds a window
of 20 words still holds ``TOGETHER`` symbols of its own, unless long runs fill it; then fewer rounds
count, and in the end the window itself.

1. A map over shards finds for each window the least hash of ``TOGETHER`` neighbouring inner symbols,
   its anchor. Windows that name one occurrence of an anchor are consecutive: they form a context.
2. Rows of (anchor, context, place) are dealt by anchor. Of equal contexts the first stays, the
   others are covered. An anchor with more rows than a task should hold is dealt by context as well.
3. First occurrences of different contexts around a shared anchor are verified window by window, each
   window hashed in full, in an aggregate; again the first stays.
4. Covered windows go back to their shard as spans, where the words are cut.

Windows are judged on the input and never cross documents. Earlier is a smaller id (null first), then
the row's place, then the start. A null text has no words. Repeated rows are documents of their own.
An empty table gives no rows. Matches are by two 64-bit hashes of full contents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm.common import table, text_or_empty, unused, written
from strandframe.llm.shards import Marks, PrefixHash, Shards, byte_values, in_batches, joined, mix, read_shard
from strandframe.llm.suffix_array import union_of

WINDOW, ROUNDS, TOGETHER = 20, 3, 4
# Rows of one anchor that are dealt together, and rows of a task; neither changes a result.
HOT_ROWS, TASK_ROWS = 50_000, 1_000_000
WINDOWS_AT_ONCE = 200_000  # hashed together
BROADCAST_ANCHORS = 100_000  # of 16 bytes each; more are joined without a hint
# Words are separated by spaces and the controls from tab to carriage return.
_IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def word_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, text number) of every word in joined texts."""
    inside = ~_IS_SPACE[data]
    before = np.concatenate([[False], inside[:-1]]) if len(inside) else inside
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]]) if len(inside) else inside
    stops = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, stops, np.searchsorted(bounds, starts, "right") - 1


def word_symbols(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    return PrefixHash(byte_values()[data]).of(starts, stops)


def name_runs(symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, first old symbol of each): a run of one symbol becomes one symbol."""
    run = np.flatnonzero(np.concatenate([[True], (symbols[1:] != symbols[:-1]) | (owner[1:] != owner[:-1])]))
    size = np.diff(np.append(run, len(symbols))).astype("u8")
    return np.where(size > 1, mix(symbols[run] + size * np.uint64(0xD6E8FEB86659FD93)), symbols[run]), run


def name_pairs(symbols: np.ndarray, owner: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, first old symbol of each, side of each old symbol): a left and a right one become one."""
    left = (mix(symbols + np.uint64(number)) & np.uint64(1)).astype(bool)
    first = np.append(left[:-1] & ~left[1:] & (owner[1:] == owner[:-1]), False)
    pair = np.flatnonzero(~np.append(False, first[:-1]))
    following = symbols[np.minimum(pair + 1, len(symbols) - 1)]
    return np.where(first[pair], mix(symbols[pair] * np.uint64(0xA0761D6478BD642F) + mix(following)), symbols[pair]), pair, left


def inner_symbols(symbols: np.ndarray, owner: np.ndarray, window: int, rounds: int = ROUNDS, together: int = TOGETHER) -> tuple[np.ndarray, ...]:
    """For every window: (first word, anchor's first word, anchor's end, rounds behind the anchor).

    The symbols [low, high) of a window are those that its own content fixes. The round of runs
    gives up the run at either end, which may reach beyond the window; a round of pairs gives up a
    right symbol at the start and a left one at the end, which may belong to a pair that does.
    """
    n = len(symbols)
    last = np.flatnonzero(np.append(owner[1:] != owner[:-1], True)) + 1
    ends = np.repeat(last, np.diff(np.append(0, last)))
    start = np.flatnonzero(np.arange(n) + window <= ends)
    begin, end, settled = start.copy(), start + window, np.zeros(len(start), "i1")
    if not len(start):
        return start, begin, end, settled
    low, high = start, start + window
    place = np.arange(n + 1)  # first word of each symbol
    for number in range(1, rounds + 1):
        live = high > low  # a window inside a long run has nothing left
        low, high = np.where(live, low, 0), np.where(live, high, 1)
        if number == 1:
            symbols, first = name_runs(symbols, owner)
            new_of = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
            low, high = new_of[low] + 1, new_of[high - 1]
        else:
            symbols, first, left = name_pairs(symbols, owner, number)
            size = len(left)
            new_of = np.append(np.repeat(np.arange(len(first)), np.diff(np.append(first, size))), len(first))
            low = new_of[low] + ~np.append(left, True)[low]
            high = new_of[high - 1] + ~left[high - 1]
        owner, place = owner[first], np.append(place[first], n)
        high = np.where(live, high, low)
        fits = np.flatnonzero((high - low >= together) & (settled == number - 1))
        if not len(fits):
            break
        grams = symbols[: len(symbols) - together + 1]
        for i in range(1, together):
            grams = mix(grams * np.uint64(0xA0761D6478BD642F) + symbols[i : len(grams) + i])
        best = first_least(grams, low[fits], high[fits] - together + 1)
        begin[fits], end[fits], settled[fits] = place[best], place[best + together], number
    return start, begin, end, settled


def first_least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The first place of the least value in each [low, high), by doubled ranges."""
    spans = [np.arange(len(values))]
    width = 1
    while width * 2 <= int((high - low).max()):
        a, b = spans[-1][:-width], spans[-1][width:]
        spans.append(np.where(values[b] < values[a], b, a))
        width *= 2
    power = np.floor(np.log2(high - low)).astype("i8")
    out = low.copy()
    for k, least in enumerate(spans):
        here = np.flatnonzero(power == k)
        a, b = least[low[here]], least[high[here] - (1 << k)]
        out[here] = np.where(values[b] < values[a], b, a)
    return out


def find_contexts(data: np.ndarray, bounds: np.ndarray, window: int, rounds: int) -> tuple[np.ndarray, ...]:
    """(anchor, context, text number, first window's word, windows), one row per context."""
    begin, end, owner = word_bounds(data, bounds)
    if not len(begin):
        return tuple(np.zeros(0, "i8") for _ in range(5))
    words = word_symbols(data, begin, end)
    start, first, last, settled = inner_symbols(words, owner, window, rounds)
    if not len(start):
        return tuple(np.zeros(0, "i8") for _ in range(5))
    new = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (last[1:] != last[:-1]) | (settled[1:] != settled[:-1]) | (start[1:] != start[:-1] + 1)]))
    size = np.diff(np.append(new, len(start)))
    hashed = PrefixHash(words)
    a, f, t, level = start[new], first[new], last[new], settled[new].astype("i8")
    # The round of runs has given up a word or more on both sides, so the window holds these as well.
    more = np.minimum(level, 1)
    anchor = hashed.of(f - more, t + more) + level.astype("u8")
    context = hashed.of(a, a + size - 1 + window) + (f - a).astype("u8")
    lengths = np.bincount(owner, minlength=len(bounds) - 1)
    first_word = np.cumsum(lengths) - lengths
    return anchor.view("i8"), context.view("i8"), owner[a], a - first_word[owner[a]], size


FOUND = "anchor bigint, context bigint, doc_id {id}, shard int, row int, start int, windows int, spread bigint"
# Salts from here on mark contexts that have an earlier equal in their own batch.
SPREAD = 1 << 40


def covered_spans(shards: Shards, window: int = WINDOW, rounds: int = ROUNDS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(shard, row, start, windows): runs of windows whose words also start earlier."""
    schema = FOUND.format(id=shards.schema["doc_id"].dataType.simpleString())
    names = ["anchor", "context", "doc_id", "shard", "row", "start", "windows", "spread"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_batches(batches, 3):
            texts = [(t or "").encode("utf8", "surrogatepass") for t in batch.column(3).to_pylist()]
            anchor, context, text, start, size = find_contexts(*joined(texts), window, rounds)
            ids, (shard, row) = batch.column(2).take(pa.array(text)), (batch.column(i).to_numpy()[text] for i in (0, 1))
            # An earlier equal in the batch settles a context; it is dealt out by its place, so that a
            # context repeated in many documents, or many times in one, comes once per batch.
            by, _, kind_new = in_order(anchor, context, ids, shard, row, start)
            spread = np.full(len(by), -1, "i8")
            later = by[~kind_new]
            spread[later] = SPREAD + ((row[later].astype("i8") * 31 + start[later]) & 0xFFFF)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor), pa.array(context), ids, pa.array(shard), pa.array(row), pa.array(start.astype("i4")), pa.array(size.astype("i4")), pa.array(spread)], names)

    rows = shards.rows("doc_id", "text")
    found = rows.mapInArrow(find, schema)
    # Which anchors are hot only steers how rows are dealt, so every 16th document tells enough.
    sixteenth = F.pmod(F.xxhash64("shard", "row"), F.lit(16)) == 0
    sampled = written(rows.filter(sixteenth).mapInArrow(find, schema).filter("spread < 0").select("anchor"), "recompress-sampled")
    hot = sampled.groupBy("anchor").agg((F.count("*") * 16).alias("rows")).filter(F.col("rows") > hot_rows)
    hot = written(hot, "recompress-hot")
    known = hot.count()
    marked, salt = found, F.lit(-1).cast("bigint")
    if known:
        marked = found.join(F.broadcast(hot) if known <= BROADCAST_ANCHORS else hot, "anchor", "left")
        salt = F.when(F.col("rows").isNotNull(), F.pmod("context", F.ceil(F.col("rows") / F.lit(hot_rows)))).otherwise(salt)
    tasks = max(int(shards.spark.conf.get("spark.sql.shuffle.partitions")), -(-16 * sampled.count() // TASK_ROWS))
    salt = F.when(F.col("spread") >= 0, F.col("spread")).otherwise(salt)
    dealt = marked.select(*names[:-1], salt.alias("salt")).repartition(tasks, "anchor", "salt")
    settled = written(dealt.mapInArrow(settle_contexts, "covered boolean, shard int, row int, start int, windows int, anchor bigint"), "recompress-settled")
    whole = settled.filter("covered").select("shard", "row", "start", "windows")
    marks = settled.filter("NOT covered").select("shard", "row", "start", "windows", "anchor")
    windows = written(window_hashes(shards, marks, window), "recompress-windows")
    here = F.struct("doc_id", "shard", "row", "start")
    first = windows.groupBy("anchor", "hash").agg(F.count("*").alias("times"), F.min(here).alias("first")).filter("times > 1")
    partial = windows.join(first, ["anchor", "hash"]).filter(~F.col("first").eqNullSafe(here)).select("shard", "row", "start", F.lit(1).alias("windows"))
    return whole.union(partial)


def in_order(anchor: np.ndarray, context: np.ndarray, ids: pa.Array, shard: np.ndarray, row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts by (anchor, context), the earliest first; where anchors and where contexts begin."""
    if not len(anchor):
        return np.zeros(0, "i8"), np.zeros(0, bool), np.zeros(0, bool)
    order = pa.compute.rank(ids, "ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
    by = np.lexsort((start, row, shard, order, context, anchor))
    anchor_new = np.append(True, anchor[by][1:] != anchor[by][:-1])
    return by, anchor_new, anchor_new | np.append(True, context[by][1:] != context[by][:-1])


def settle_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of some anchors: later equals are covered, firsts of mixed anchors are passed on."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    rows, out_names = pa.Table.from_batches(batches), ["shard", "row", "start", "windows", "anchor"]
    early = pa.compute.greater_equal(rows.column("salt"), SPREAD)
    settled = rows.filter(early).select(out_names)
    yield from settled.add_column(0, "covered", pa.array(np.ones(len(settled), bool))).combine_chunks().to_batches(max_chunksize=100_000)
    rows = rows.filter(pa.compute.invert(early)).combine_chunks()
    if not len(rows):
        return
    anchor, context, shard, row, start, salt = (rows.column(n).to_numpy() for n in ("anchor", "context", "shard", "row", "start", "salt"))
    by, anchor_new, kind_new = in_order(anchor, context, rows.column("doc_id").combine_chunks(), shard, row, start)
    kinds = np.add.reduceat(kind_new.astype("i8"), np.flatnonzero(anchor_new))
    mixed = np.repeat(kinds > 1, np.diff(np.append(np.flatnonzero(anchor_new), len(by)))) | (salt[by] >= 0)
    keep = ~kind_new | mixed
    out = rows.select(out_names).take(pa.array(by[keep]))
    yield from out.add_column(0, "covered", pa.array(~kind_new[keep])).combine_chunks().to_batches(max_chunksize=100_000)


def window_hashes(shards: Shards, marks: DataFrame, window: int) -> DataFrame:
    """Every window of the marked contexts, hashed from its words."""
    id_type = shards.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = Marks(batches, ["start", "windows", "anchor"])
        for shard, uri in stream.shards():
            if not stream.any():
                continue
            for first, rows in read_shard(uri, ["doc_id", "text"]):
                row, start, windows, anchor = stream.upto(first + rows.num_rows)
                if not len(row):
                    continue
                # Only the texts with marks are read, a few at a time.
                needed, text = np.unique(row - first, return_inverse=True)
                found = [(t or "").encode("utf8", "surrogatepass") for t in rows.column(1).take(pa.array(needed)).to_pylist()]
                data, bounds = joined(found)
                begin, end, owner = word_bounds(data, bounds)
                hashed = PrefixHash(word_symbols(data, begin, end))
                lengths = np.bincount(owner, minlength=len(needed))
                offset = (np.cumsum(lengths) - lengths)[text]
                ends = np.cumsum(windows)
                a = 0
                while a < len(row):
                    b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + WINDOWS_AT_ONCE, "right")))
                    number = np.repeat(np.arange(a, b), windows[a:b])
                    inside = np.arange(len(number)) - np.repeat(ends[a:b] - windows[a:b] - (ends[a - 1] if a else 0), windows[a:b])
                    word = start[number] + inside
                    place = word + offset[number]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor[number]), pa.array(hashed.of(place, place + window).view("i8")), rows.column(0).take(pa.array(row[number] - first)),
                         pa.array(np.full(len(number), shard, "i4")), pa.array(row[number].astype("i4")), pa.array(word.astype("i4"))],
                        ["anchor", "hash", "doc_id", "shard", "row", "start"])
                    a = b

    return shards.beside(marks, ["start", "windows", "anchor"]).mapInArrow(read, f"anchor bigint, hash bigint, doc_id {id_type}, shard int, row int, start int")


def added_names(columns: list[str]) -> tuple[str, str, str]:
    """Names for the number of words, the spans and the kept text that ``columns`` do not hold yet."""
    return tuple(unused(columns, n) for n in ("n_words", "spans", "kept"))


def cut_words(shards: Shards, spans: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every row's columns with the number of its words, the spans (merged, [from, to) in words) and the kept text,
    its other words joined by spaces; ``added_names`` tells what these are called."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    names = shards.schema.names
    added = zip(added_names(names), (T.LongType(), T.ArrayType(T.ArrayType(T.IntegerType())), T.StringType()), strict=True)
    schema = T.StructType([*shards.schema.fields, *(T.StructField(n, t) for n, t in added)])
    target = to_arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks(batches, ["start", "windows"])
        for _, uri in marks.shards():
            for first, rows in read_shard(uri):
                row, start, windows = marks.upto(first + rows.num_rows)
                stop = start + windows + window - 1
                count, merged, kept = [], [], []
                for k, text in enumerate(rows.column(rows.schema.get_field_index("text")).to_pylist()):
                    words = (text or "").translate(_TO_SPACE).split(" ")
                    words = [w for w in words if w]
                    a, b = np.searchsorted(row, [first + k, first + k + 1])
                    runs = union_of(start[a:b], stop[a:b]).tolist()
                    count.append(len(words))
                    merged.append(runs)
                    edges = [0, *(x for r in runs for x in r), len(words)]
                    kept.append(" ".join(w for x, y in zip(edges[::2], edges[1::2], strict=True) for w in words[x:y]))
                new = [pa.array(count), pa.array(merged, target.field(len(names) + 1).type), pa.array(kept, pa.string())]
                columns = [*(rows.column(rows.schema.get_field_index(n)) for n in names), *new]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    return shards.beside(spans, ["start", "windows"]).mapInArrow(cut, schema)


_TO_SPACE = {c: " " for c in range(0x09, 0x0E)}


def remove_repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, hot_rows: int = HOT_ROWS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_words, spans, kept) per row of ``docs``."""
    shards = Shards(docs.select(F.col(f"`{id_column}`").alias("doc_id"), text_or_empty(text_column).alias("text")), "recompress-docs")
    return cut_words(shards, covered_spans(shards, window, rounds, hot_rows), window).drop("text")


def cut_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` (doc_id, text and other columns) with covered words cut; other texts stay as they are.

    ``n_chars`` of a cut text is counted again, where there is such a column.
    """
    shards = Shards(docs, "recompress-docs")
    found = cut_words(shards, covered_spans(shards, window), window)
    _, spans, kept = added_names(docs.columns)
    cut = F.size(spans) > 0
    changed = {"text": F.when(cut, F.col(kept)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(cut, F.length(kept)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.withColumns(changed).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, folder: str) -> DataFrame:
    found = remove_repeats(table(spark, folder, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + (s[1] - s[0]))
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
