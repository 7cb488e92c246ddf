"""Near-duplicate vectors by an inverted multi-index.

Each half of the unit vectors has a codebook of its own; pairs of codewords form the grid of cells, and
a vector lies in the cell of its nearest codewords. A near vector may lie in another cell, but not
in any: to leave one codeword's region for another's it must cross the plane between them. The
distance to the furthest such plane bounds from below how far a vector must move to reach a region,
for each half; the squares of both halves add up. A vector visits the cells whose sum is within reach.

Vectors within ``cosine`` c lie within a squared distance of 2 - 2c, so with ``recall`` 1 all cells that can
hold a link are visited and no link is lost. With less, the reach is the quantile of the bounds that
linked pairs of the fitting sample need. Every pair of a visited cell is verified by its cosine: a few
directions of most spread and the lengths left beside them bound it from above, and what passes is computed.

Equal vectors are one entry with a count. Entries are ordered by cell and written once, in blocks of like size,
so neither a crowded cell nor a large group of near copies grows a task. A task holds one block and reads, from
the shared folder and one by one, the blocks it can reach: no vector is sent a second time, and the disk in use
grows with the input alone. A link has both its ends, so two blocks meet in one task only, and each block meets half of the
others. Links are counted and joined to a forest by numpy; at most one edge per vector and pair of blocks leaves.

Null and zero vectors and those with null or non-finite components link with nothing; vectors of
different lengths do not link. Repeated rows count as other vectors. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandframe.llm.common import components, qualified, table, written

COSINE, RECALL, SAMPLE, CHUNK, SEED, SLACK = 0.95, 1.0, 10_000, 4096, 7, 1e-9
SAMPLE_BYTES = 32 << 20  # of the vectors that the codebooks are fitted to, on the driver
#: Chunks of a block at most, once there are so many blocks; bytes of its vectors; entries compared at once; pairs of a product.
CHUNKS, BLOCKS, BLOCK_BYTES, RUN, TILE = 8, 48, 16 << 20, 32, 1 << 18
PLANES, ROUNDING = 4, 1e-12  # planes that bound a region; rounding of squared distances of unit vectors


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Unit vectors of rows of finite numbers, not all zero; a row's result does not depend on the others."""
    x = x / np.abs(x).max(axis=1)[:, None]  # no overflow of the squares
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None] + 0.0


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, rows) of the lists of each length that have a direction."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype("i8")
    values = pc.fill_null(column.flatten().cast(pa.float64(), safe=False), np.nan).to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    for size in np.unique(lengths[lengths > 0]):
        here = np.flatnonzero(lengths == size)
        x = values[starts[here][:, None] + np.arange(size)]
        good = np.isfinite(x).all(axis=1) & x.any(axis=1)
        yield here[good], x[good]


def stacked(column: pa.Array, kind: str) -> np.ndarray:
    """Rows of equal length from their bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def fit_codebook(sample: np.ndarray, size: int, rounds: int = 8) -> np.ndarray:
    """k-means; fewer codewords if the sample has fewer distinct vectors."""
    points = np.unique(sample, axis=0)
    words = points[np.random.default_rng(SEED).permutation(len(points))[:size]]
    for _ in range(rounds):
        nearest = (sample @ words.T - (words**2).sum(axis=1) / 2).argmax(axis=1)
        count = np.bincount(nearest, minlength=len(words))
        total = np.zeros_like(words)
        np.add.at(total, nearest, sample)
        words = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], words)
    return np.unique(words, axis=0)


def nearest_word(half: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Equal vectors get the same word in any batch: near ties are decided row by row."""
    score = half @ words.T - (words**2).sum(axis=1) / 2
    best = score.argmax(axis=1)
    tied = np.flatnonzero((score >= score.max(axis=1, keepdims=True) - SLACK).sum(axis=1) > 1)
    for part in np.array_split(tied, -(-len(tied) // 1024)) if len(tied) else []:
        best[part] = np.stack([((half[part] - word) ** 2).sum(axis=1) for word in words], axis=1).argmin(axis=1)
    return best


def region_bounds(half: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Squared distance that each vector must at least move to reach each codeword's region, by the planes of its nearest words."""
    squares = np.maximum((half**2).sum(axis=1)[:, None] - 2 * half @ words.T + (words**2).sum(axis=1), 0)
    apart = np.sqrt(((words[:, None, :] - words[None]) ** 2).sum(axis=2))
    planes = min(PLANES, len(words))
    bound = np.zeros_like(squares)
    for other in np.argpartition(squares, planes - 1, axis=1)[:, :planes].T:
        gap = 2 * apart[other]
        ahead = squares - np.take_along_axis(squares, other[:, None], axis=1) - ROUNDING
        bound = np.maximum(bound, np.divide(ahead, gap, out=np.zeros_like(gap), where=gap > 0))
    return bound**2


class Grid:
    """The codebooks of both halves, the reach of the traversal and the directions of most spread."""

    def __init__(self, sample: np.ndarray, entries: int, cosine: float, recall: float):
        size = int(min(256, max(1, 2 * entries**0.25, (entries / 64) ** 0.5)))
        self.cut, self.cosine = sample.shape[1] // 2, cosine
        self.words = [fit_codebook(sample[:, : self.cut], size), fit_codebook(sample[:, self.cut :], size)]
        self.reach = 2 - 2 * cosine + SLACK
        if recall < 1:
            needed = self._needed(sample, cosine)
            if len(needed):
                self.reach = min(self.reach, float(np.quantile(needed, recall)) + SLACK)
        #: Products of unit vectors in single precision are off by less.
        self.margin = 1.2e-7 * (sample.shape[1] + 16)
        self.basis = self._directions(sample)

    def _needed(self, sample: np.ndarray, cosine: float) -> np.ndarray:
        """Bounds of the cells that the links inside the sample lie in."""
        needed, cells = [], self.cells(sample)
        for start in range(0, len(sample), 512):
            part = sample[start : start + 512]
            x, y = np.nonzero(part @ sample.T >= cosine)
            first, second = self.bounds(part)
            needed.append((first[x, cells[0][y]] + second[x, cells[1][y]])[start + x != y])
        return np.concatenate(needed) if needed else np.zeros(0)

    def _directions(self, sample: np.ndarray) -> np.ndarray | None:
        """As many as make products and what passes them cheapest, over pairs of the sample; None for all."""
        size, part = sample.shape[1], sample[:1000]
        axes = np.linalg.eigh(sample.T @ sample)[1][:, ::-1]
        cost = {size: 0.016 * size}
        for n in sorted({max(1, size * k // 8) for k in range(1, 7)} - {size}):
            turned = part @ axes[:, :n]
            left = np.sqrt(np.maximum(1 - (turned**2).sum(axis=1), 0))
            passed = np.triu(turned @ turned.T + left[:, None] * left >= self.cosine, 1).sum()
            cost[n] = 0.016 * n + 100 * passed / max(1, len(part) * (len(part) - 1) // 2)
        best = min(cost, key=cost.get)
        return None if best == size else np.ascontiguousarray(axes[:, :best])

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return nearest_word(unit[:, : self.cut], self.words[0]), nearest_word(unit[:, self.cut :], self.words[1])

    def bounds(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return region_bounds(unit[:, : self.cut], self.words[0]), region_bounds(unit[:, self.cut :], self.words[1])

    def turned(self, unit: np.ndarray) -> np.ndarray:
        """Rows whose products bound those of the unit vectors from above."""
        if self.basis is None:
            return unit.astype("f4")
        turned = unit @ self.basis
        return np.column_stack([turned, np.sqrt(np.maximum(1 - (turned**2).sum(axis=1), 0))]).astype("f4")


class Block:
    """Entries ordered by cell; those that ask know the bounds of all codewords' regions."""

    def __init__(self, grid: Grid, found: pa.Table, kind: str, asks: bool = False):
        self.grid = grid
        self.entry, self.times, self.row, self.cell = (found.column(c).to_numpy() for c in ("entry", "times", "row", "cell"))
        self.raw = stacked(found.column("raw"), kind)
        #: By codeword; the least bound of each first one tells what the block can reach at all.
        self.first, self.second = (np.empty((len(words), len(self.raw)), "f4") for words in grid.words) if asks else (None, None)
        near, turned = [], []
        for here in (slice(at, at + 1024) for at in range(0, len(self.raw), 1024)):
            unit = unit_rows(self.raw[here].astype("f8"))
            near.append(unit.astype("f4"))
            turned.append(grid.turned(unit))
            if asks:  # rounded down, as single precision must not part what is in reach
                first, second = grid.bounds(unit)
                self.first[:, here], self.second[:, here] = first.T * (1 - 1e-6), second.T * (1 - 1e-6)
        self.near, self.turned = np.concatenate(near), np.concatenate(turned)
        self.least = self.first.min(axis=1) if asks else None

    def exact(self, places: np.ndarray) -> np.ndarray:
        return unit_rows(self.raw[places].astype("f8"))

    def runs(self) -> Iterator[tuple[int, np.ndarray, slice]]:
        """(first codeword, second codewords, entries): a crowded cell, or small ones of a row together."""
        cuts = np.flatnonzero(np.append(True, (np.diff(self.row) != 0) | (np.diff(self.cell) != 0)))
        start, cells = 0, []
        for a, b in zip(cuts, np.append(cuts[1:], len(self.row)), strict=True):
            cells.append(self.cell[a])
            if b - start >= RUN or b == len(self.row) or self.row[b] != self.row[a]:
                yield int(self.row[a]), np.array(cells), slice(start, b)
                start, cells = b, []

    def visits(self, stored: Block) -> Iterator[tuple[np.ndarray, slice]]:
        """(own entries, stored entries) of all cells within reach."""
        reach = np.float32(self.grid.reach)
        for row, cells, inside in stored.runs():
            if self.least[row] <= reach:
                second = self.second[cells[0]] if len(cells) == 1 else self.second[cells].min(axis=0)
                visiting = np.flatnonzero(self.first[row] + second <= reach)
                if len(visiting):
                    yield visiting, inside


def forest(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels of rows and columns of a boolean matrix: the smallest row linked to them by hits."""
    n = len(hits)
    rows = np.arange(n)
    while True:
        columns = np.where(hits, rows[:, None], n).min(axis=0)
        new = np.minimum(rows, np.where(hits, columns[None, :], n).min(axis=1))
        if (new == rows).all():
            return rows, columns
        rows = new


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id linked to it) of all ids but those smallest ones."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(ids))
    while (label[x] != label[y]).any():
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
    apart = label != np.arange(len(ids))
    return ids[apart], ids[label[apart]]


def link_vectors(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, sample: int = SAMPLE, chunk: int = CHUNK, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row."""
    spark = vectors.sparkSession
    id_type, list_type = (vectors.schema[c].dataType for c in (id_column, vector_column))
    kind = "f4" if getattr(list_type, "elementType", None) == T.FloatType() else "f8"  # as given: a cast would widen the tables

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            sizes, keys, raw = np.zeros(batch.num_rows, "i4"), [None] * batch.num_rows, [None] * batch.num_rows
            for places, x in matrices(batch.column(1)):
                for place, unit, given in zip(places, unit_rows(x), x.astype(kind), strict=True):
                    sizes[place], keys[place], raw[place] = len(unit), hashlib.blake2b(unit, digest_size=16).digest(), given.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "size", "key", "raw"])

    rows = vectors.select(F.col(f"`{id_column}`").alias("vec_id"), F.col(f"`{vector_column}`").alias("v"))
    rows = written(rows.mapInArrow(read, f"vec_id {id_type.simpleString()}, size int, key binary, raw binary"), "vectors")
    counts = {r["size"]: r["n"] for r in rows.filter("key IS NOT NULL").groupBy("size").agg(F.approx_count_distinct("key", 0.02).alias("n")).collect()}
    grids, most = {}, {}
    for size, n in counts.items():  # a row per vector length; the sample is that of least content hash
        fits = max(1, min(sample, SAMPLE_BYTES // (8 * size)))
        share = min(1.0, 2 * fits / n)  # of the hashes: those rows alone are shuffled
        below = F.lit(True) if share == 1 else F.col("key") < F.lit(bytearray(int(share * (1 << 128)).to_bytes(16, "big")))
        taken = rows.filter((F.col("size") == size) & F.col("key").isNotNull() & below).groupBy("key").agg(F.first("raw").alias("raw")).orderBy("key").limit(fits).collect()
        grids[size] = Grid(unit_rows(np.stack([np.frombuffer(r.raw, kind) for r in taken]).astype("f8")), n, cosine, recall)
        most[size] = max(1, min(chunk * max(1, min(CHUNKS, n // (chunk * BLOCKS))), BLOCK_BYTES // (size * np.dtype(kind).itemsize)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells, and equal vectors of a batch as one row."""
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == size)))
                _, once, times = np.unique(part.column("key").dictionary_encode().indices.to_numpy(), return_index=True, return_counts=True)
                part = part.take(pa.array(once))
                slices = (part.column("raw").slice(at, 1024) for at in range(0, part.num_rows, 1024))
                first, second = np.concatenate([grids[size].cells(unit_rows(stacked(s, kind).astype("f8"))) for s in slices], axis=1).astype("i4")
                yield pa.RecordBatch.from_arrays([part.column("size"), pa.array(first), pa.array(second), part.column("key"), pa.array(times), part.column("raw")], ["size", "row", "cell", "key", "times", "raw"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries of sorted rows: equal keys follow each other, also from batch to batch."""
        at, held = TaskContext.get().partitionId() << 33, None
        for batch in chain((b for b in batches if b.num_rows), [None]):
            if batch is None and held is None:
                return
            found = pa.Table.from_batches([b for b in (held, batch) if b is not None]).combine_chunks().to_batches()[0]
            key = found.column("key")
            starts = np.flatnonzero(np.append(True, pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)))
            times = np.add.reduceat(found.column("times").to_numpy(), starts)
            found = found.take(pa.array(starts))
            found = found.set_column(found.schema.get_field_index("times"), "times", pa.array(times))
            n = found.num_rows - (batch is not None)
            held = found.slice(n)
            yield pa.RecordBatch.from_arrays([pa.array(at + np.arange(n)), *found.slice(0, n).columns], ["entry", *found.schema.names])
            at += n

    cell, columns = ["size", "row", "cell", "key"], "size int, row int, cell int, key binary, times bigint, raw binary"
    placed = rows.filter("key IS NOT NULL").select("size", "key", "raw").mapInArrow(place, columns)
    parts = max(1, sum(-(-n // most[size]) for size, n in counts.items()))
    entries = written(placed.repartitionByRange(parts, *cell).sortWithinPartitions(*cell).mapInArrow(number, f"entry bigint, {columns}"), "vector-cells")
    files = entries.groupBy(F.input_file_name().alias("file"), "size").agg(F.count("*").alias("n"), F.min("entry").alias("at"), F.min("row").alias("low"), F.max("row").alias("high")).orderBy("at").collect()
    blocks: dict[int, list] = {size: [] for size in counts}  # a row per file, which has thousands of vectors
    for f in files:  # small files are one block
        near = blocks[f["size"]]
        if near and near[-1]["n"] + f["n"] <= most[f["size"]]:
            near[-1] = {"files": [*near[-1]["files"], f["file"]], "n": near[-1]["n"] + f["n"], "low": min(near[-1]["low"], f["low"]), "high": max(near[-1]["high"], f["high"])}
        else:
            near.append({"files": [f["file"]], "n": f["n"], "low": f["low"], "high": f["high"]})
    tasks = [(size, i) for size, found in blocks.items() for i in range(len(found))]

    def load(size: int, files: list[str], asks: bool = False) -> Block:
        found = []
        for file in files:
            store, path = fs.FileSystem.from_uri(qualified(file))
            found.append(pq.read_table(path, columns=["size", "entry", "times", "row", "cell", "raw"], filesystem=store, partitioning=None, use_threads=False))
        found = pa.concat_tables(found)
        if pc.min_max(found.column("size")).as_py() != {"min": size, "max": size}:
            found = found.filter(pc.equal(found.column("size"), size))
        return Block(grids[size], found.combine_chunks(), kind, asks)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for size, i in (tasks[t] for batch in batches for t in batch.column(0).to_pylist()):
            others = blocks[size]
            asked = load(size, others[i]["files"], True)
            links = np.zeros(len(asked.entry), "i8")
            yield from compare(asked, asked, links)
            for j in met(i, len(others), recall >= 1):
                if asked.least[others[j]["low"] : others[j]["high"] + 1].min() <= np.float32(grids[size].reach):
                    yield from compare(asked, load(size, others[j]["files"]), links, recall >= 1)
            yield counted(asked, links)

    found = spark.range(0, len(tasks), 1, max(1, len(tasks))).mapInArrow(link, "entry bigint, links bigint, other bigint")
    found = written(found, "vector-links")
    links = found.groupBy("entry").agg(F.sum("links").alias("links"))
    linked = components(found.filter("other IS NOT NULL").select(F.col("entry").alias("a"), F.col("other").alias("b")))
    known = entries.select("key", "entry", "times").join(links, "entry", "left").join(linked, F.col("entry") == F.col("id"), "left")
    known = known.filter("times > 1 OR links IS NOT NULL OR component IS NOT NULL")  # the others are alone
    known = known.select("key", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("links"), F.coalesce("component", "entry").alias("component"))
    known = written(known, "vector-links")
    least = rows.select("vec_id", "key").join(known, "key").groupBy("component").agg(F.min("vec_id").alias("component_id"))
    result = rows.select("vec_id", "key").join(known.join(least, "component").select("key", "links", "component_id"), "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return result.select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), (F.col("vec_id").eqNullSafe(component)).alias("kept"))


def met(block: int, blocks: int, once: bool) -> list[int]:
    """Blocks that a block's task reads: all others, or each pair of blocks in one of its two tasks."""
    if not once:
        return [b for b in range(blocks) if b != block]
    ahead = (blocks - 1) // 2 + (blocks % 2 == 0 and block < blocks // 2)
    return [(block + d) % blocks for d in range(1, ahead + 1)]


def counted(block: Block, links: np.ndarray) -> pa.RecordBatch:
    some = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([pa.array(block.entry[some]), pa.array(links[some]), pa.nulls(len(some), pa.int64())], ["entry", "links", "other"])


def compare(asked: Block, stored: Block, links: np.ndarray, both: bool = False) -> Iterator[pa.RecordBatch]:
    """Adds the links of the asking entries; edges, and with ``both`` the links of the stored ones, are given out."""
    grid, own = asked.grid, asked is stored
    ends, edges = np.zeros(len(stored.entry), "i8"), []
    for visiting, inside in asked.visits(stored):
        step = max(64, TILE // (inside.stop - inside.start))
        for start in range(0, len(visiting), step):
            part = visiting[start : start + step]
            bound = stored.turned[inside] @ asked.turned[part].T
            some = np.flatnonzero(bound.max(axis=0) >= grid.cosine - grid.margin)
            if not len(some):
                continue
            y, x = np.nonzero(bound[:, some] >= grid.cosine - grid.margin)
            x, y = part[some[x]], y + inside.start
            if own:
                x, y = x[x != y], y[x != y]
            a, b = (np.unique(x), np.unique(y)) if len(x) > 1024 else (x, y)
            if len(x) > 1024 and 16 * len(x) > len(a) * len(b):
                hits = verified(asked, stored, a, b)
                if own:
                    hits &= a[:, None] != b
                a, b, hits = a[hits.any(axis=1)], b[hits.any(axis=0)], hits[hits.any(axis=1)][:, hits.any(axis=0)]
                if not len(a):
                    continue
                links[a] += weighed(hits, stored.times[b])
                if both:
                    ends[b] += weighed(hits.T, asked.times[a])
                label_a, label_b = forest(hits)
                edges += [(asked.entry[a], asked.entry[a][label_a]), (stored.entry[b], asked.entry[a][label_b])]
            else:
                hit = linked(asked, stored, x, y)
                if not hit.any():
                    continue
                x, y = x[hit], y[hit]
                np.add.at(links, x, stored.times[y])
                if both:
                    np.add.at(ends, y, asked.times[x])
                edges.append((asked.entry[x], stored.entry[y]))
    if ends.any():
        yield counted(stored, ends)
    if edges:
        a, b = spanning(*(np.concatenate(c) for c in zip(*edges, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64()), pa.array(b)], ["entry", "links", "other"])


def linked(asked: Block, stored: Block, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the entries of each pair are linked: in double precision, where single does not rule it out."""
    grid, hit, step = asked.grid, np.zeros(len(x), bool), max(1, (1 << 20) // asked.raw.shape[1])
    for at in range(0, len(x), step):
        open_ = at + np.flatnonzero(np.einsum("ij,ij->i", asked.near[x[at : at + step]], stored.near[y[at : at + step]]) >= grid.cosine - grid.margin)
        if len(open_):
            hit[open_] = np.einsum("ij,ij->i", asked.exact(x[open_]), stored.exact(y[open_])) >= grid.cosine
    return hit


def verified(asked: Block, stored: Block, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same for all pairs of rows and columns; those that single precision leaves open are computed again."""
    product = asked.near[a] @ stored.near[b].T
    hits = product >= asked.grid.cosine
    x, y = np.nonzero(np.abs(product - asked.grid.cosine) <= asked.grid.margin)
    hits[x, y] = linked(asked, stored, a[x], b[y])
    return hits


def weighed(hits: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Sums of the counts of the columns hit, by row."""
    return hits.sum(axis=1) if (times == 1).all() else hits @ times


def query(spark: SparkSession, folder: str) -> DataFrame:
    return link_vectors(table(spark, folder, "embeddings"))
