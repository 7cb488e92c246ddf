"""Toxicity by a chain of linear classifiers.

Categories are predicted in order; each model sees the words of a text and the probabilities of the
categories before it. While training, those are out-of-fold: for every part of the rows they come from
models fitted on the other parts, so a later model does not trust them more than new texts warrant.

Features are the distinct words of the whole text (ASCII lower-cased, punctuation apart), hashed to
``2 ** BITS`` places. A model is a logistic regression by proximal AdaGrad; the penalty of a word is
``STRICT`` standard deviations of its gradient under no effect, so a word counts only if its
association is significant, and long texts do not add up noise; the words chosen are fitted again without it. The cut of each category maximises
F1 on the out-of-fold probabilities.

At most ``SAMPLE`` labelled rows (those of least id hash) train the chain, in one task that holds their
word places; every row is scored. Null and unlabelled ids are not trained on, a null label counts as
no, of repeated labels the largest counts. Null and empty texts get the models' intercepts. Without
labelled rows every probability is 0. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandframe.llm.common import table, text_or_empty
from strandframe.llm.decontaminate import _WORD_BYTES
from strandframe.llm.recompress import word_bounds, word_symbols
from strandframe.llm.shards import in_batches, joined

BITS, SAMPLE, FOLDS, ROUNDS, STRICT, LEARNING_RATE = 18, 12_000, 3, 40, 4.0, 0.5
REFIT_ROUNDS, RIDGE = 300, 0.1
CATEGORIES = ("low_quality", "toxic")


@dataclass
class Linear:
    """Weights of the places that count, of the earlier categories, and the intercept."""

    places: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    intercept: float
    cut: float

    def scores(self, places: np.ndarray, rows: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
        total = np.full(n, self.intercept) + earlier[:, : len(self.earlier)] @ self.earlier
        if len(self.places):
            at = np.minimum(np.searchsorted(self.places, places), len(self.places) - 1)
            hit = np.flatnonzero(self.places[at] == places)
            pairs = np.unique(rows[hit] * len(self.places) + at[hit])  # each word of a text counts once
            total += np.bincount(pairs // len(self.places), self.weights[pairs % len(self.places)], n)
        return sigmoid(total)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def word_places(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(place, text number) of every word of joined texts."""
    data, bounds = joined([t.encode("utf8", "surrogatepass").translate(_WORD_BYTES) for t in texts])
    begin, end, owner = word_bounds(data, bounds)
    if not len(begin):
        return np.zeros(0, "i8"), np.zeros(0, "i8")
    return (word_symbols(data, begin, end) >> np.uint64(64 - bits)).astype("i8"), owner


def fit_linear(places: np.ndarray, rows: np.ndarray, target: np.ndarray, earlier: np.ndarray, bits: int = BITS) -> Linear:
    """``places``/``rows``: distinct (row, place) pairs."""
    n, rate = len(target), float(np.clip(target.mean(), 1e-6, 1 - 1e-6)) if len(target) else 1e-6
    start = float(np.log(rate / (1 - rate)))
    if not n or target.min() == target.max():
        return Linear(np.zeros(0, "i8"), np.zeros(0), np.zeros(earlier.shape[1]), start if n else -40.0, 0.5)
    frequent = np.bincount(places, minlength=1 << bits)
    used = np.flatnonzero(frequent >= 5)
    index = np.full(1 << bits, -1)
    index[used] = np.arange(len(used))
    keep = index[places] >= 0
    column, row, width = index[places][keep], rows[keep], len(used) + earlier.shape[1] + 1
    penalty = np.zeros(width)
    penalty[: len(used)] = STRICT * np.sqrt(rate * (1 - rate) * frequent[used]) / n
    weight, squares = np.zeros(width), np.full(width, 1e-12)
    weight[-1] = start
    for _ in range(ROUNDS):
        score = np.bincount(row, weight[column], n) + earlier @ weight[len(used) : -1] + weight[-1]
        residual = (sigmoid(score) - target) / n
        gradient = np.concatenate([np.bincount(column, residual[row], len(used)), residual @ earlier, [residual.sum()]])
        squares += gradient**2
        step = LEARNING_RATE / np.sqrt(squares)
        weight -= step * gradient
        weight = np.sign(weight) * np.maximum(np.abs(weight) - step * penalty, 0)
    # The penalty chose the words; without it they get their full weights, held by a slight ridge.
    counted = np.flatnonzero(weight[: len(used)])
    index = np.full(len(used), -1)
    index[counted] = np.arange(len(counted))
    keep = index[column] >= 0
    column, row = index[column][keep], row[keep]
    weight = np.concatenate([weight[counted], weight[len(used) :]])
    squares = np.full(len(weight), 1e-12)
    for _ in range(REFIT_ROUNDS):
        score = np.bincount(row, weight[column], n) + earlier @ weight[len(counted) : -1] + weight[-1]
        residual = (sigmoid(score) - target) / n
        gradient = np.concatenate([np.bincount(column, residual[row], len(counted)), residual @ earlier, [residual.sum()]])
        gradient[:-1] += RIDGE / n * weight[:-1]
        squares += gradient**2
        weight -= LEARNING_RATE / np.sqrt(squares) * gradient
    return Linear(used[counted], weight[: len(counted)], weight[len(counted) : -1], float(weight[-1]), 0.5)


def best_cut(probability: np.ndarray, target: np.ndarray) -> float:
    if not target.any():
        return 1.0
    by = np.argsort(-probability)
    hits, taken = np.cumsum(target[by]), np.arange(1, len(by) + 1)
    f1 = 2 * hits / (taken + target.sum())
    f1[:-1][probability[by][1:] == probability[by][:-1]] = 0  # equal ones fall on one side
    best = int(np.argmax(f1))
    after = probability[by][best + 1] if best + 1 < len(by) else 0.0
    return float((probability[by][best] + after) / 2)


def fit_chain(places: np.ndarray, rows: np.ndarray, targets: np.ndarray, fold: np.ndarray) -> list[Linear]:
    n, chain = len(targets), []
    outside = np.zeros((n, targets.shape[1]))  # out-of-fold probabilities
    for k in range(targets.shape[1]):
        target, earlier = targets[:, k], outside[:, :k]
        for f in range(int(fold.max(initial=-1)) + 1):
            train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if not len(train) or not len(test):
                continue
            number = np.full(n, -1)
            number[train] = np.arange(len(train))
            mine = number[rows] >= 0
            part = fit_linear(places[mine], number[rows[mine]], target[train], earlier[train])
            number[:] = -1
            number[test] = np.arange(len(test))
            mine = number[rows] >= 0
            outside[test, k] = part.scores(places[mine], number[rows[mine]], len(test), earlier[test])
        model = fit_linear(places, rows, target, earlier)
        model.cut = best_cut(outside[:, k], target)
        chain.append(model)
    return chain


def train_chain(docs: DataFrame, labels: DataFrame, categories: Sequence[str] = CATEGORIES, sample: int = SAMPLE, folds: int = FOLDS) -> list[Linear]:
    """Fitted on ``sample`` labelled documents at most; ``labels``: (doc_id, one boolean per category).

    Labels of absent documents are not counted among them. Of rows that repeat an id the least text is used.
    """
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.max(F.coalesce(c, F.lit(False))).alias(c) for c in categories])
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(known, "doc_id").groupBy("doc_id", *categories).agg(F.min("text").alias("text")).select(
        "text", F.pmod(F.xxhash64("doc_id"), F.lit(folds)).cast("int").alias("fold"), F.array(*[F.col(c).cast("double") for c in categories]).alias("targets"))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_batches(batches, 0):
            place, row = word_places(batch.column(0).to_pylist())
            pairs = np.unique(row << BITS | place)
            cuts = np.searchsorted(pairs >> BITS, np.arange(batch.num_rows + 1))
            found = [(pairs[a:b] & ((1 << BITS) - 1)).astype("<u4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1), batch.column(2)], ["places", "fold", "targets"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        each = [np.frombuffer(x, "<u4").astype("i8") for x in rows.column("places").to_pylist()]
        row = np.repeat(np.arange(len(each)), [len(x) for x in each])
        targets = np.array(rows.column("targets").to_pylist())
        for model in fit_chain(np.concatenate(each), row, targets, rows.column("fold").to_numpy()):
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (model.places.tolist(), model.weights.tolist(), model.earlier.tolist())] + [pa.array([model.intercept]), pa.array([model.cut])],
                                             ["places", "weights", "earlier", "intercept", "cut"]).cast(_MODEL_SCHEMA)

    # One task holds the word places of at most ``sample`` rows and gives one row per category.
    chain = texts.mapInArrow(places, "places binary, fold int, targets array<double>").repartition(1).mapInArrow(
        fit, "places array<bigint>, weights array<double>, earlier array<double>, intercept double, cut double").collect()
    if not chain:
        return [Linear(np.zeros(0, "i8"), np.zeros(0), np.zeros(k), -np.inf, 1.0) for k in range(len(categories))]
    return sorted((Linear(np.array(m.places, "i8"), np.array(m.weights), np.array(m.earlier), m.intercept, m.cut) for m in chain), key=lambda m: len(m.earlier))


_MODEL_SCHEMA = pa.schema([("places", pa.list_(pa.int64())), ("weights", pa.list_(pa.float64())), ("earlier", pa.list_(pa.float64())), ("intercept", pa.float64()), ("cut", pa.float64())])


def score_chain(docs: DataFrame, chain: list[Linear], categories: Sequence[str] = CATEGORIES, text_column: str = "text", prefix: str = "p_") -> DataFrame:
    """``docs`` with a probability column per category, named prefix + category; it replaces one of that name."""
    from pyspark.sql.pandas.types import to_arrow_schema

    names = [prefix + c for c in categories]
    docs = docs.drop(*names)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])
    target, at = to_arrow_schema(schema), docs.columns.index(text_column)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_batches(batches, at):
            n = batch.num_rows
            place, row = word_places([t or "" for t in batch.column(at).to_pylist()])
            found = np.zeros((n, len(chain)))
            for k, model in enumerate(chain):
                found[:, k] = model.scores(place, row, n, found) if np.isfinite(model.intercept) else 0.0
            columns = [*batch.columns, *(pa.array(found[:, k]) for k in range(len(chain)))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    return docs.mapInArrow(score, schema)


def label_categories(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", (F.col("quality") == 0).alias("low_quality"), (F.col("toxic") == 1).alias("toxic"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    chain = train_chain(docs, label_categories(table(spark, folder, "labels")))
    return score_chain(docs, chain).select("doc_id", "p_low_quality", "p_toxic", (F.col("p_toxic") >= chain[-1].cut).alias("toxic"))
