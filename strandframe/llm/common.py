"""Helpers shared by the corpus operators: tables, the shared folder, links to components."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.session import shared_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_collecting: ContextVar[list[str] | None] = ContextVar("collecting", default=None)


@contextmanager
def collected() -> Iterator[list[str]]:
    """The paths of all intermediate tables made inside, for ``release()`` once the results that read them are written."""
    paths: list[str] = []
    token = _collecting.set(paths)
    try:
        yield paths
    finally:
        _collecting.reset(token)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that every executor reaches; it stays until it is released."""
    path = f"{shared_folder(spark)}/llm-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    paths = _collecting.get()
    if paths is not None:
        paths.append(path)
    return path


def release(paths: list[str]) -> None:
    """Removes the given tables; a result that still reads one of them can no longer be computed."""
    while paths:
        store, folder = fs.FileSystem.from_uri(qualified(paths.pop()))
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


def unused(names: Iterable[str], wanted: str) -> str:
    """``wanted``, with underscores before it until no column of that name is there, in any case."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def unused_prefix(names: Iterable[str], wanted: str) -> str:
    """``wanted``, with underscores before it until no column begins with it, in any case."""
    taken = [n.lower() for n in names]
    while any(n.startswith(wanted.lower()) for n in taken):
        wanted = f"_{wanted}"
    return wanted


def qualified(path: str) -> str:
    """Spark writes ``file:/x`` where others write ``file:///x``; a bare path is a local one."""
    if path.startswith("/"):
        return f"file://{path}"
    return path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back; cuts lineage, survives executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b): the smallest id reachable.

    Alternating large-star and small-star rounds, logarithmic in practice. Stars are formed by
    a per-id minimum that is combined before the shuffle and joined back, so an id with very
    many links is never gathered in one task. Ids and links stay in Spark tables.
    """
    links = written(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(),
        "links",
    )
    for _ in range(max_rounds):
        if _are_stars(links):
            break
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.greatest("v", "m").alias("u"), F.col("m").alias("v")).filter("u != v")
        own = least.select("u", F.col("m").alias("v"))
        links = written(small.union(own).distinct(), "links")
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


def _are_stars(links: DataFrame) -> bool:
    """Whether every id has one link, to an id without links: the rounds end in that form."""
    ends = links.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(links.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up > 0 AND down > 0").isEmpty()
