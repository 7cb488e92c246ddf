"""A training corpus from raw documents: five stages, each written and read by the next.

A stage takes documents (doc_id, text and any other columns, which no name of its own can clash with)
and gives rows of the same columns; the last one gives pieces. Null texts count as empty but stay null. Rows
that repeat an id or a text are documents of their own. An empty table gives an empty one.

Intermediate tables of a stage lie in the shared folder until the next stage starts: by then its result
has been written. Those of the last stage stay, as its result reads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm import dart_minhash, decontaminate, packing, recompress, toxicity
from strandframe.llm.common import collected, release, table, unused_prefix, written
from strandframe.llm.tokens import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents the classifier chain rejects; others unchanged.

    An empty or null text has no words and the model's base rate, which no text of the kind reaches the
    cut with. Equal texts share their verdict. Labels of null or absent ids are not used; without any
    label of toxicity nothing is rejected.
    """
    chain = toxicity.train_chain(docs, toxicity.label_categories(table(spark, sf_dir, "labels")))
    prefix = unused_prefix(docs.columns, "p_")
    scored = toxicity.score_chain(docs, chain, prefix=prefix)
    return scored.filter(F.col(f"{prefix}toxic") < chain[-1].cut).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies, unchanged: the smallest id, null first, then the first row.

    Texts without words, empty and null ones too, are copies of nothing and stay.
    """
    return dart_minhash.drop_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, texts without the passages that start earlier too; ``n_chars`` counted again.

    Earlier is a smaller id, null first, then the row's place, then the start. Texts without such a
    passage stay as they are, null ones null; one that is all passage becomes empty.
    """
    return recompress.cut_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold benchmark items beyond the limit; others unchanged.

    A text without words, null or empty, holds none; without items all documents stay.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece with its sequence and place. A null or empty text is its end token alone; rows that repeat
    an id have pieces each."""
    return packing.packed(*packing.pack_documents(docs, vocabulary("word_bpe_49k.json")))


_tables: dict[str, list[str]] = {}


def _stage(name: str, work, before: str | None):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(_tables.pop(before, []))
        with collected() as made:
            result = work(spark, docs, sf_dir)
        _tables.setdefault(name, []).extend(made)
        return result

    run_stage.__doc__ = work.__doc__
    return name, run_stage


STAGES = [
    _stage("toxicity", drop_toxic, None),
    _stage("near_dedup", drop_near_duplicates, "toxicity"),
    _stage("substring_dedup", cut_repeats, "near_dedup"),
    _stage("decontamination", drop_contaminated, "substring_dedup"),
    _stage("packing", pack, "decontamination"),
]

# Trained models, hashed sketches and a linear program have no SQL form; tests/llm compares every
# stage with a plain version on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with collected() as made:
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}")  # the next stage reads it
        release(before)
        before = made
    result = STAGES[-1][1](spark, docs, sf_dir)
    _tables.pop(STAGES[-1][0], None)  # they belong to the result from now on
    return result
