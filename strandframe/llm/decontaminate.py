"""Benchmark decontamination with a generalised suffix automaton of the test items.

Words are the runs of ASCII letters and digits and of everything outside ASCII, A-Z lower-cased. The
automaton accepts every word sequence inside an item. Streaming a document's words through it gives
at each word the longest match that ends there. Where it reaches ``window`` words, or a whole item
of fewer, the words are hit. Spans of hit words are cut out where a span is longer than
``max_span`` words, or everywhere once hits reach ``coverage`` of the document.

Items are dealt into blocks of about ``BLOCK_WORDS`` words, so an automaton has a fixed size in every worker;
a longer item is cut into pieces that overlap by a window less one word, which loses no window. Blocks are
written to the shared folder, where tasks read them; the driver sees their numbers. With more than one
block the documents pass through them in turn, each pass written.

Null texts have no words, hits or items and stay null; empty documents and items count likewise.
Repeated rows are judged each. Without items or documents nothing is hit, or no row comes out.
Added columns replace those of the same name; give a prefix to keep both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandframe.llm.common import qualified, scratch, table, unused_prefix, written

WINDOW, COVERAGE_PERCENT, BLOCK_WORDS = 13, 5, 100_000
# Bytes inside words stay (A-Z in lower case), all others become spaces.
_WORD_BYTES = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf8", "surrogatepass").translate(_WORD_BYTES).split()


class Automaton:
    """Generalised suffix automaton over words, with the items of every window."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.window, self.next, self.link, self.length = window, [{}], [-1], [0]
        self.code: dict[bytes, int] = {}
        listed = []
        for name, text in items:
            codes = [self.code.setdefault(w, len(self.code)) for w in words_of(text or "")]
            if codes:
                listed.append((name, codes))
        for _, codes in listed:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        n = len(self.link)
        # ends[s]: the state on the suffix path of s that holds its last ``window`` words.
        order = sorted(range(1, n), key=self.length.__getitem__)
        self.window_state, self.items = [-1] * n, {}
        self.whole: list[tuple[tuple[int, int], ...]] = [()] * n  # whole short items that end here: (words, state)
        for s in order:
            up = self.link[s]
            if self.length[s] >= window:
                self.window_state[s] = s if self.length[up] < window else self.window_state[up]
        short: dict[int, dict[int, set[str]]] = {}
        for name, codes in listed:
            state = 0
            for i, c in enumerate(codes):
                state = self.next[state][c]
                if i + 1 >= window:
                    # the words read so far may be longer than a window; its state is on the path
                    self.items.setdefault(self.window_state[state], set()).add(name)
            if len(codes) < window:
                short.setdefault(state, {}).setdefault(len(codes), set()).add(name)
        self.short_items = {}
        for s in order:
            mine = tuple((k, s) for k in sorted(short.get(s, {})))
            for k in short.get(s, {}):
                self.short_items[k, s] = short[s][k]
            self.whole[s] = self.whole[self.link[s]] + mine
        self.any_short = bool(self.short_items)

    def _extend(self, last: int, c: int) -> int:
        step, link, length = self.next, self.link, self.length
        if c in step[last]:
            q = step[last][c]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, c, q)
        new = len(link)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p != -1:
            q = step[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        step, link, length = self.next, self.link, self.length
        copy = len(link)
        step.append(dict(step[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = copy
        while p != -1 and step[p].get(c) == q:
            step[p][c] = copy
            p = link[p]
        return copy

    def match(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Hit spans [first word, word after], merged and in order, and the items whose windows occur."""
        spans: list[list[int]] = []
        found_windows, found_short = set(), set()
        step, link, length, window = self.next, self.link, self.length, self.window
        state = size = 0
        for i, c in enumerate(map(self.code.get, words)):
            if c is None:
                state = size = 0
                continue
            here = step[state]
            if c not in here:
                while state and c not in step[state]:
                    state = link[state]
                    size = length[state]
                here = step[state]
                if c not in here:
                    continue
            state = here[c]
            size += 1
            hit = 0
            if size >= window:
                hit = window
                found_windows.add(self.window_state[state])
            if self.any_short and self.whole[state]:
                for k, s in self.whole[state]:
                    if k <= size:
                        hit = max(hit, k)
                        found_short.add((k, s))
            if hit:
                start = i + 1 - hit
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, i + 1])
        items = set().union(*(self.items[s] for s in found_windows), *(self.short_items[s] for s in found_short))
        return spans, items


def cut_words(text: str, spans: list[list[int]]) -> str:
    """``text`` without the given word spans; what stands between kept words stays as it is."""
    data = text.encode("utf8", "surrogatepass")
    inside = np.frombuffer(data.translate(_WORD_BYTES), "u1") != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.view("i1"), [0]])))
    starts, ends = edges[::2], edges[1::2]
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at : starts[a]])
        at = int(ends[b - 1])
    return b"".join([*kept, data[at:]]).decode("utf8", "surrogatepass")


def item_blocks(items: DataFrame, id_column: str = "item_id", text_column: str = "text", block_words: int = BLOCK_WORDS, window: int = WINDOW) -> tuple[str, list[int]]:
    """(path, block numbers): items by block, in folders ``block=number`` below the path."""
    listed = items.select(F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{text_column}`").cast("string").alias("text"))
    most = max(window, block_words // 4)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                starts = range(0, max(1, len(words) - window + 1), most - window + 1) if len(words) > most else [0]
                for start in starts:
                    piece = words[min(start, max(0, len(words) - most)) :][:most]
                    rows.append((name, b" ".join(piece).decode("utf8", "surrogatepass"), len(piece)))
            names, texts, sizes = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], ["item", "text", "words"])

    pieces = written(listed.filter("text IS NOT NULL").mapInArrow(cut, "item string, text string, words bigint").filter("words > 0").distinct(), "items")
    total = pieces.agg(F.sum("words")).first()[0] or 0
    # Blocks are half full on average: with pieces of a quarter at most none is much larger than asked for.
    count = 1 if total <= block_words else -(-2 * total // block_words)
    path = scratch(items.sparkSession, "item-blocks")
    dealt = pieces.select("item", "text", F.pmod(F.xxhash64("item", "text"), F.lit(count)).alias("block"))
    dealt.repartition("block").write.partitionBy("block").parquet(path)
    return path, sorted(r.block for r in dealt.select("block").distinct().collect())


def read_items(path: str, block: int) -> list[tuple[str, str]]:
    """The items of a block."""
    store, folder = fs.FileSystem.from_uri(qualified(path))
    files = store.get_file_info(fs.FileSelector(f"{folder}/block={block}"))
    found = [pq.read_table(f.path, columns=["item", "text"], filesystem=store, partitioning=None) for f in files if f.path.endswith(".parquet")]
    return [pair for t in found for pair in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True)]


def find_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, text_column: str = "text", prefix: str = "", keep_text: bool = True, block_words: int = BLOCK_WORDS, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_hit, spans (word places) and items (sorted as strings) per row."""
    path, blocks = item_blocks(items, item_id, item_text, block_words, window)
    names = [prefix + n for n in ("n_words", "n_hit", "spans", "items")]
    added = [T.LongType(), T.LongType(), T.ArrayType(T.ArrayType(T.IntegerType())), T.ArrayType(T.StringType())]
    current = docs.drop(*names)
    for number, block in enumerate(blocks or [None]):
        last = number >= len(blocks) - 1
        drop = {text_column} if last and not keep_text else set()
        inner = current.columns
        out_fields = [f for f in current.schema.fields if f.name not in drop and f.name not in names]
        schema = T.StructType([*out_fields, *(T.StructField(n, t) for n, t in zip(names, added, strict=True))])
        current = current.mapInArrow(_matcher(path, block, window, inner, text_column, names, schema, number > 0), schema)
        if not last:
            current = written(current, "decontaminate")
    return current


def _matcher(path, block, window, columns, text_column, names, schema, again):
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton([] if block is None else read_items(path, block), window)
        at = columns.index(text_column)
        for batch in batches:
            out = {n: [] for n in names}
            earlier = [batch.column(columns.index(n)).to_pylist() for n in names[2:]] if again else None
            for row, text in enumerate(batch.column(at)):
                words = words_of(text.as_py() or "")
                spans, items = automaton.match(words)
                if again:
                    spans, items = merge_spans([*earlier[0][row], *spans]), items | set(earlier[1][row])
                for n, v in zip(names, (len(words), sum(b - a for a, b in spans), spans, sorted(items)), strict=True):
                    out[n].append(v)
            kept = [batch.column(columns.index(n)) for n in target.names[: len(target) - 4]]
            new = [pa.array(out[n], target.field(len(target) - 4 + i).type) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(kept, target, strict=False)), *new], schema=target)

    return run


def merge_spans(spans: list) -> list[list[int]]:
    merged: list[list[int]] = []
    for a, b in sorted(map(tuple, spans)):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return merged


def contaminated(percent: int = COVERAGE_PERCENT, prefix: str = ""):
    hit, words = F.col(f"{prefix}n_hit"), F.col(f"{prefix}n_words")
    return (hit > 0) & (100 * hit >= percent * words)


def remove_hits(docs: DataFrame, items: DataFrame, percent: int = COVERAGE_PERCENT, max_span: int | None = None, window: int = WINDOW, text_column: str = "text") -> DataFrame:
    """``docs`` with the hit spans cut out of the texts that exceed a limit; other texts are untouched."""
    columns, prefix = docs.columns, unused_prefix(docs.columns, "hit_")
    found = find_hits(docs, items, window, text_column, prefix)

    @F.pandas_udf("string")
    def cut(text, spans):
        return text.combine(spans, lambda t, s: cut_words(t, [list(map(int, x)) for x in s]))

    long = F.filter(f"{prefix}spans", lambda s: s[1] - s[0] > (max_span if max_span is not None else 1 << 30))
    spans = F.when(contaminated(percent, prefix), F.col(f"{prefix}spans")).otherwise(long)
    text = F.when(F.size(spans) > 0, cut(F.coalesce(f"`{text_column}`", F.lit("")), spans)).otherwise(F.col(f"`{text_column}`"))
    return found.withColumn(text_column, text).select(*[F.col(f"`{c}`") for c in columns])


def drop_contaminated(docs: DataFrame, items: DataFrame, percent: int = COVERAGE_PERCENT, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows that are contaminated; the others unchanged."""
    prefix = unused_prefix(docs.columns, "hit_")
    found = find_hits(docs, items, window, prefix=prefix)
    return found.filter(~contaminated(percent, prefix)).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = find_hits(docs, table(spark, folder, "benchmark"), keep_text=False)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[p : p + least(len(w), 13) - 1], ' ') AS v
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS p FROM b WHERE len(w) > 0)
), ks AS (SELECT DISTINCT k FROM windows
), places AS (
  SELECT doc_id, k, p, array_to_string(w[p : p + k - 1], ' ') AS v
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks WHERE len(w) >= k)
), found AS (SELECT doc_id, p, k, item_id FROM places JOIN windows USING (k, v)
), hit AS (SELECT doc_id, count(DISTINCT h) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS h FROM found) GROUP BY 1
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM found) GROUP BY 1
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
