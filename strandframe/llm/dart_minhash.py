"""Near-duplicate documents by DartMinHash and banding.

A document is the weighted set of its shingles of ``SHINGLE`` words (all its words, if fewer). Darts lie
in the plane (weight, rank) of every shingle: each unit cell holds a Poisson number of them, placed by
hashes of shingle and cell, so all documents see the same darts. Those under the shingle's weight
and under a rank that lets through about K ln K + 2K of them hit the document; each falls on one of K
coordinates, and the earliest per coordinate is the signature, at a cost of shingles plus darts. If a
coordinate stays empty the rank doubles. Two coordinates agree with the weighted Jaccard similarity.

1. Documents with the same weighted set form a class; one of each goes on, whatever the copies.
2. Bands of the signatures put them into buckets; buckets joined at shared members give candidate
   components, so every text goes to one place once.
3. There pairs of a common bucket that are not linked yet are compared by their shingles. A component
   larger than ``BLOCK`` texts is compared block against block.
4. Verified links give components again.

With ``BANDS`` bands of ``ROWS`` a pair at similarity 0.8 is missed with probability 3e-6, more similar
pairs less. A signature that agrees on under ``agreement_floor()`` of the coordinates (5 standard deviations
below the least similarity) saves the comparison.

Weights are 1 (``weights="set"``) or the counts of a shingle (``"count"``). Texts without words, null ones too,
link with nothing. Repeated rows are exact copies. Of a group the smallest id is kept (null first), of
equal ids the first row. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm.common import components, table, text_or_empty, written
from strandframe.llm.recompress import word_bounds, word_symbols
from strandframe.llm.shards import BATCH_BYTES, Marks, PrefixHash, Shards, in_batches, joined, mix, read_shard, without_rows

SHINGLE, SIMILARITY, BANDS, ROWS, BLOCK = 5, 0.8, 32, 5, 2000
# Cumulated Poisson(1) probabilities: the number of darts in a cell.
_POISSON = np.cumsum([1, 1, 1 / 2, 1 / 6, 1 / 24, 1 / 120, 1 / 720, 1 / 5040, 1 / 40320]) / np.e


def shingle_sets(texts: list[bytes], size: int = SHINGLE, weights: str = "set") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, weight, text number), sorted by text and shingle."""
    data, bounds = joined(texts)
    begin, end, owner = word_bounds(data, bounds)
    if not len(begin):
        return np.zeros(0, "u8"), np.zeros(0), np.zeros(0, "i8")
    hashed = PrefixHash(word_symbols(data, begin, end))
    last = np.cumsum(np.bincount(owner, minlength=len(texts)))[owner]
    first = last - np.bincount(owner, minlength=len(texts))[owner]
    start = np.flatnonzero((np.arange(len(begin)) + size <= last) | (np.arange(len(begin)) == first))
    shingle, text = hashed.of(start, np.minimum(start + size, last[start])), owner[start]
    by = np.lexsort((shingle, text))
    shingle, text = shingle[by], text[by]
    new = np.flatnonzero(np.append(True, (shingle[1:] != shingle[:-1]) | (text[1:] != text[:-1])))
    count = np.diff(np.append(new, len(shingle))).astype("f8")
    return shingle[new], count if weights == "count" else np.ones(len(new)), text[new]


def signatures(shingle: np.ndarray, weight: np.ndarray, text: np.ndarray, texts: int, coordinates: int) -> np.ndarray:
    """texts x coordinates: the earliest dart of each coordinate; all ones for an empty text."""
    empty = np.uint64((1 << 64) - 1)
    out = np.full(texts * coordinates, empty, "u8")
    total = np.bincount(text, weight, texts)
    aim = coordinates * np.log(coordinates) + 2 * coordinates
    todo = np.flatnonzero(total > 0)
    while len(todo):
        reach = np.zeros(texts)
        reach[todo] = aim / total[todo]
        mine = np.flatnonzero(reach[text] > 0)
        for piece in np.array_split(mine, max(1, int(reach[text[mine]].sum() + len(mine)) // 2_000_000)):
            throw(shingle[piece], weight[piece], text[piece], reach, coordinates, out)
        todo = todo[(out.reshape(texts, coordinates)[todo] == empty).any(axis=1)]
        aim *= 2
    return out.reshape(texts, coordinates)


def throw(shingle, weight, text, reach, coordinates, out) -> None:
    """Darts of all cells under the weights and ranks, each taken to its coordinate."""
    layers, steps = np.ceil(weight).astype("i8"), np.ceil(reach[text]).astype("i8")
    cells = layers * steps
    of = np.repeat(np.arange(len(shingle)), cells)
    cell = np.arange(len(of)) - np.repeat(np.cumsum(cells) - cells, cells)
    layer, step = cell // steps[of], cell % steps[of]
    seed = mix(shingle[of] + mix(layer.astype("u8") * np.uint64(0xD1B54A32D192ED03) + step.astype("u8") * np.uint64(0x8CB92BA72F3D8DD7) + np.uint64(1)))
    darts = np.searchsorted(_POISSON, (seed >> np.uint64(11)) * 2.0**-53, "right")
    at = np.repeat(np.arange(len(of)), darts)
    number = np.arange(len(at)) - np.repeat(np.cumsum(darts) - darts, darts)
    dart = mix(seed[at] + (number.astype("u8") + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    inside = dart >> np.uint64(24)  # place in the cell along the ranks, 40 bits
    where, owner = of[at], text[of[at]]
    hits = step[at] + inside * 2.0**-40 <= reach[owner]
    fraction = weight[where] - layer[at]
    if (fraction < 1).any():
        hits &= (mix(dart) >> np.uint64(11)) * 2.0**-53 <= fraction
    coordinate = ((dart & np.uint64(0xFFFFFF)) * np.uint64(coordinates)) >> np.uint64(24)
    rank = (step[at].astype("u8") << np.uint64(40)) | inside
    np.minimum.at(out, (owner * coordinates + coordinate.astype("i8"))[hits], rank[hits])


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, -1)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype="u8"), parts.shape[:2]) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(parts.shape[2]):
        keys = mix(keys + parts[:, :, i])
    return keys


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sorted sets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][i], b[1][j]).sum()
    return float(least / (a[1].sum() + b[1].sum() - least))


def linked_pairs(sets: list[tuple[np.ndarray, np.ndarray]], signature: np.ndarray, side: np.ndarray | None, bands: int, least: float, floor: float) -> list[tuple[int, int]]:
    """Verified links that join all that a link between bucket mates joins; ``side``: only across."""
    root = np.arange(len(sets))
    links, tested = [], set()
    keys = band_keys(signature, bands)
    for band in range(bands):
        by = np.argsort(keys[:, band], kind="stable")
        edges = np.flatnonzero(np.append(True, keys[by][1:, band] != keys[by][:-1, band]))
        for a, b in zip(edges, np.append(edges[1:], len(by)), strict=True):
            members = by[a:b]
            while len(members) > 1 and (root[members] != root[members[0]]).any():
                lead, members = members[0], members[1:]
                other = members[root[members] != root[lead]]
                if side is not None:
                    other = other[side[other] != side[lead]]
                other = other[(signature[other] == signature[lead]).mean(axis=1) >= floor]
                for o in other:
                    pair = (min(lead, o), max(lead, o))
                    if root[o] == root[lead] or pair in tested:
                        continue
                    tested.add(pair)
                    if similarity(sets[lead], sets[o]) >= least:
                        links.append(pair)
                        root[root == root[o]] = root[lead]
    return links


def agreement_floor(least: float, coordinates: int) -> float:
    """The share of coordinates that hardly any pair of similarity ``least`` stays under."""
    return least - 5 * (least * (1 - least) / coordinates) ** 0.5


def copies_batch(rows: list[tuple]) -> pa.RecordBatch:
    """Shingle sets on their way to the pairs of blocks that compare them."""
    types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["component", "i", "j", "own", "uid", "shingles", "weights"])


def verifying_tasks(marks: DataFrame, block: int, least: int) -> int:
    """Tasks of about one pair of blocks each; a text is sent once to every block of its component."""
    copies = marks.agg(F.sum("blocks")).first()[0] or 0
    return max(least, -(-copies // (2 * block)))


def block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one (component, i, j) at a time, from batches in that order; no more of them are held."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("component", "i", "j")], axis=1)
        new = np.append(0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1)
        for a, b in zip(new, np.append(new[1:], len(keys)), strict=True):
            if held and key != tuple(keys[a]):
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            key = tuple(keys[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE, weights: str = "set", block: int = BLOCK, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, kept) per row; ids are those of the kept rows."""
    shards = Shards(docs.select(F.col(f"`{id_column}`").alias("doc_id"), text_or_empty(text_column).alias("text")), "dart-docs")
    return group_rows(shards, least, bands, rows, size, weights, block).drop("uid")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` (doc_id, text and other columns) with one row of each group; kept rows are unchanged."""
    shards = Shards(docs, "dart-docs")
    grouped = group_rows(shards, **options).filter("NOT kept")
    return without_rows(shards, grouped.select(F.shiftright("uid", 32).cast("int").alias("shard"), F.col("uid").bitwiseAND(0xFFFFFFFF).cast("int").alias("row")))


def group_rows(shards: Shards, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE, weights: str = "set", block: int = BLOCK) -> DataFrame:
    """(uid, doc_id, n_shingles, class_id, component_id, kept) of every row; uid is shard and row in one."""
    coordinates = bands * rows

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_batches(batches, 3):
            texts = [(t or "").encode("utf8", "surrogatepass") for t in batch.column(3).to_pylist()]
            shingle, weight, text = shingle_sets(texts, size, weights)
            weighed = mix(shingle + weight.astype("u8") * np.uint64(0xA24BAED4963EE407))
            both = [np.zeros(len(texts), "u8") for _ in range(2)]
            for total, values in zip(both, (weighed, mix(weighed ^ np.uint64(0x5851F42D4C957F2D))), strict=True):
                np.add.at(total, text, values)
            n = np.bincount(text, minlength=len(texts))
            keys = band_keys(signatures(shingle, weight, text, len(texts), coordinates), bands).view("i8")
            uid = (batch.column(0).to_numpy().astype("i8") << 32) | batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(uid), batch.column(2), pa.array(n), *(pa.array(x.view("i8")) for x in both), pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), bands).cast(pa.list_(pa.int64()))],
                ["uid", "doc_id", "n", "a", "b", "bands"])

    id_type = shards.schema["doc_id"].dataType.simpleString()
    signed = written(shards.rows("doc_id", "text").mapInArrow(sign, f"uid bigint, doc_id {id_type}, n bigint, a bigint, b bigint, bands array<bigint>"), "dart-signed")
    here = F.struct("doc_id", "uid")
    classes = signed.filter("n > 0").groupBy("a", "b", "n").agg(F.min(here).alias("first"), F.min(F.struct("doc_id", "uid", "bands"))["bands"].alias("bands"))
    classes = written(classes, "dart-classes")
    buckets = classes.select(F.col("first.uid").alias("uid"), F.explode("bands").alias("key"))
    least_of = buckets.groupBy("key").agg(F.min("uid").alias("m"), F.count("*").alias("members")).filter("members > 1").select("key", "m")
    candidates = components(buckets.join(least_of, "key").filter("uid != m").select(F.col("uid").alias("a"), F.col("m").alias("b")))
    sizes = candidates.groupBy("component").agg(F.count("*").alias("texts"))
    marks = candidates.join(sizes, "component").select(
        F.shiftright("id", 32).cast("int").alias("shard"), F.col("id").bitwiseAND(0xFFFFFFFF).cast("int").alias("row"), "component", F.ceil(F.col("texts") / F.lit(block)).cast("int").alias("blocks"))
    marks = written(marks, "dart-marks")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = Marks(batches, ["component", "blocks"])
        for shard, uri in stream.shards():
            if not stream.any():
                continue
            for first, rows_here in read_shard(uri, ["text"]):
                row, component, blocks = stream.upto(first + rows_here.num_rows)
                if not len(row):
                    continue
                texts = [t.encode("utf8", "surrogatepass") for t in rows_here.column(0).take(pa.array(row - first)).to_pylist()]
                shingle, weight, text = shingle_sets(texts, size, weights)
                cuts = np.searchsorted(text, np.arange(len(texts) + 1))
                out, held = [], 0
                for k in range(len(row)):
                    uid = (shard << 32) | int(row[k])
                    parts, own = int(blocks[k]), int(mix(np.asarray([uid], "u8"))[0] % np.uint64(blocks[k]))
                    mine = shingle[cuts[k] : cuts[k + 1]].tobytes(), weight[cuts[k] : cuts[k + 1]].astype("f4").tobytes()
                    for other in range(parts):
                        out.append((int(component[k]), min(own, other), max(own, other), own, uid, *mine))
                        held += len(mine[0]) + len(mine[1])
                        if held > BATCH_BYTES:
                            yield copies_batch(out)
                            out, held = [], 0
                if out:
                    yield copies_batch(out)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chosen in block_pairs(batches):
            if chosen.num_rows < 2:
                continue
            i, j, own, uid = (chosen.column(c).to_numpy() for c in ("i", "j", "own", "uid"))
            found = [(np.frombuffer(s, "u8"), np.frombuffer(w, "f4").astype("f8")) for s, w in zip(chosen.column("shingles").to_pylist(), chosen.column("weights").to_pylist(), strict=True)]
            count = [len(s) for s, _ in found]
            signature = signatures(np.concatenate([s for s, _ in found]), np.concatenate([w for _, w in found]), np.repeat(np.arange(len(found)), count), len(found), coordinates)
            side = own if i[0] != j[0] else None
            links = linked_pairs(found, signature, side, bands, least, agreement_floor(least, coordinates))
            if links:
                x, y = np.array(links).T
                yield pa.RecordBatch.from_arrays([pa.array(uid[x]), pa.array(uid[y])], ["a", "b"])

    tasks = verifying_tasks(marks, block, int(shards.spark.conf.get("spark.sql.shuffle.partitions")))
    pairs = shards.beside(marks, ["component", "blocks"]).mapInArrow(sets, "component bigint, i int, j int, own int, uid bigint, shingles binary, weights binary")
    links = written(pairs.repartition(tasks, "component", "i", "j").sortWithinPartitions("component", "i", "j", "uid").mapInArrow(verify, "a bigint, b bigint"), "dart-links")
    linked = components(links)
    # The class of every row, the component of every class, and the smallest row of every component.
    placed = classes.select("a", "b", "n", "first").join(linked, F.col("first.uid") == F.col("id"), "left").select(
        "a", "b", "n", F.col("first").alias("class_first"), F.coalesce("component", F.col("first.uid")).alias("component"))
    firsts = placed.groupBy("component").agg(F.min("class_first").alias("group_first"))
    placed = placed.join(firsts, "component").select("a", "b", "n", "class_first", "group_first")
    rows_out = signed.select("uid", "doc_id", "n", "a", "b").join(placed, ["a", "b", "n"], "left")
    own = F.struct("doc_id", "uid")
    result = rows_out.select(
        "uid", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_first", own)["doc_id"].alias("class_id"), F.coalesce("group_first", own)["doc_id"].alias("component_id"),
        (F.coalesce("group_first", own)["uid"] == F.col("uid")).alias("kept"))
    return result


def query(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))
