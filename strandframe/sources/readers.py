"""Reading position tables: one file, many files, or one file per condition."""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import CONDITION, for_condition, target_for
from ..functions.numeric import to_number

FORMAT_OF_EXTENSION = {"csv": "csv", "tsv": "tsv", "json": "json", "parquet": "parquet"}
# Files whose first lines or footers are looked at side by side.
LOOKING = 16
# Fixed: the naming rule of the files.
CONDITION_FILE_PATTERN = r"temperature_(\d+|average)_.*\.csv"


def nan_to_null(df: DataFrame) -> DataFrame:
    """Only null means missing after this; no other operator looks for NaN."""
    return df.select(
        *[
            F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def detect_format(spark: SparkSession, path: str) -> str:
    """Format by extension, else by the first line: a tab wins over a comma, then csv."""
    extension = path.rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if extension in FORMAT_OF_EXTENSION:
        return FORMAT_OF_EXTENSION[extension]
    first = spark.read.text(path).limit(1).collect()
    return "tsv" if first and "\t" in first[0][0] else "csv"


def is_whole_json(spark: SparkSession, path: str) -> bool:
    """Whether a file is one JSON value, told by its first line: lines hold an object each."""
    first = spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()
    text = first[0][0].strip() if first else "{}"
    try:
        return not isinstance(json.loads(text), dict)
    except ValueError:
        return True


def read_file(
    spark: SparkSession, path: str | Sequence[str], fmt: str | None = None, schema: T.StructType | None = None, whole: bool | None = None
) -> DataFrame:
    """Read one file, folder of part files, glob or list of files of one layout in any supported format.

    Give ``schema`` for large text files; without it Spark reads them twice to infer types.
    ``whole`` says whether a JSON file is one value, which cannot be split, or a value per line;
    None looks at the first line.
    """
    fmt = fmt or detect_format(spark, path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if fmt in ("csv", "tsv"):
        reader = reader.option("header", True).option("sep", "\t" if fmt == "tsv" else ",")
        df = (reader if schema is not None else reader.option("inferSchema", True)).csv(path)
    elif fmt == "json":
        df = reader.option("multiLine", is_whole_json(spark, path) if whole is None else whole).json(path)
    elif fmt == "parquet":
        df = reader.parquet(*([path] if isinstance(path, str) else path))
    else:
        raise ValueError(f"unsupported file format: {fmt}")
    return nan_to_null(df)


def list_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Paths under ``folder`` whose name matches a glob; only metadata is read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .load(folder)
        .select("path", "length", "modificationTime")
    )


def condition_of_file(file_name) -> tuple:
    """(condition, condition as number) parsed from a file-name column."""
    name = F.regexp_extract(file_name, CONDITION_FILE_PATTERN, 1)
    condition = F.when(name != "", name)
    return condition, condition.try_cast("int")


def condition_files(spark: SparkSession, folder: str, pattern: str = "temperature_*.csv") -> DataFrame:
    """Condition and path of every file following the naming rule."""
    files = list_files(spark, folder, pattern)
    condition, number = condition_of_file(F.element_at(F.split("path", "/"), -1))
    return files.select(condition.alias(CONDITION), number.alias("condition_k"), "path").filter(
        F.col(CONDITION).isNotNull()
    )


def union_tables(tables: Sequence[DataFrame]) -> DataFrame:
    """Stack tables by column name; a column missing somewhere is null there."""
    if not tables:
        raise ValueError("no tables to combine")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def _opened(read, name: str, failed: list[tuple[str, str]] | None) -> DataFrame | None:
    """The table, or None with the reason noted in ``failed`` and as a warning."""
    try:
        return read()
    except (AnalysisException, FileNotFoundError, ValueError) as problem:
        reason = str(problem).splitlines()[0]
        warnings.warn(f"left out {name}: {reason}", stacklevel=3)
        if failed is not None:
            failed.append((name, reason))
        return None


def failure_table(spark: SparkSession, failed: Sequence[tuple[str, str]]) -> DataFrame:
    """What was left out, as rows."""
    return spark.createDataFrame(list(failed), "name string, reason string")


def _layout(path: str) -> tuple | None:
    """What files must have in common to be read by one reader: format, and columns in their order.

    Told by the footer or the first line, which alone are read. None for folders, globs, whole-file JSON,
    unknown formats and file systems that only Spark opens; those are read on their own.
    """
    if any(mark in path for mark in "*?[{"):
        return None
    try:
        store, place = fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
    except (pa.ArrowException, ValueError, OSError, ImportError):
        return None
    kind = store.get_file_info(place).type
    if kind == fs.FileType.NotFound:
        raise FileNotFoundError(f"no such file: {path}")
    fmt = FORMAT_OF_EXTENSION.get(place.rsplit(".", 1)[-1].lower())
    if kind != fs.FileType.File or fmt is None:
        return None
    if fmt == "parquet":
        with store.open_input_file(place) as stream:
            schema = pq.read_schema(stream)
        return fmt, tuple((f.name, str(f.type)) for f in schema)
    with store.open_input_stream(place) as stream:
        head = b""
        while b"\n" not in head and (more := stream.read(1 << 16)):
            head += more
    line = head.split(b"\n", 1)[0].decode("utf-8", "replace").strip()
    if fmt == "json":
        try:
            lines = isinstance(json.loads(line or "{}"), dict)
        except ValueError:
            lines = False
        return (fmt, ()) if lines else None
    return fmt, tuple(line.split("\t" if fmt == "tsv" else ","))


def merge_files(
    spark: SparkSession,
    paths: Iterable[str],
    schema: T.StructType | None = None,
    failed: list[tuple[str, str]] | None = None,
) -> DataFrame:
    """Files stacked by column name. Those that cannot be opened are noted in ``failed``.

    Files of one format and layout are one scan, whatever their number.
    """
    paths, layouts = list(paths), {}

    def look(path: str):
        try:
            return _layout(path)
        except (pa.ArrowException, OSError, ValueError) as problem:
            return problem

    with ThreadPoolExecutor(LOOKING) as pool:
        for path, found in zip(paths, pool.map(look, paths), strict=True):
            if isinstance(found, Exception):
                _opened(lambda p=found: _raise(p), path, failed)
            else:
                layouts.setdefault((path,) if found is None else found, []).append(path)
    usable = []
    for alike in layouts.values():
        fmt = None if len(alike) == 1 else FORMAT_OF_EXTENSION[alike[0].rsplit(".", 1)[-1].lower()]
        frame = _opened(lambda p=alike, f=fmt: read_file(spark, p[0] if len(p) == 1 else p, f, schema, False if f else None), ", ".join(alike[:3]), failed if len(alike) == 1 else [])
        if frame is not None:
            usable.append(frame)
        elif len(alike) > 1:  # one of them spoils the rest: find out which
            single = [_opened(lambda p=p: read_file(spark, p, schema=schema), p, failed) for p in alike]
            usable += [f for f in single if f is not None]
    if not usable:
        raise ValueError(f"none of {len(paths)} paths gave a table")
    return union_tables(usable)


def _raise(problem: Exception):
    raise FileNotFoundError(str(problem)) if isinstance(problem, OSError) else ValueError(str(problem))


def read_condition(
    spark: SparkSession,
    folder: str,
    condition: int | str,
    available: Iterable[int | str],
    file_pattern: str = "temperature_{temperature}_train.csv",
    schema: T.StructType | None = None,
) -> DataFrame:
    """One condition's table from all files and part folders that match; it must be ``available``."""
    if str(condition) not in {str(c) for c in available}:
        raise ValueError(f"condition {condition} is not available")
    pattern = for_condition(file_pattern, condition)
    try:
        table = read_file(spark, f"{folder}/{pattern}", schema=schema)
    except AnalysisException as problem:
        if problem.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        raise FileNotFoundError(f"nothing for condition {condition} matches {pattern} in {folder}") from problem
    return table.withColumn(CONDITION, F.lit(str(condition)))


def read_all_conditions(
    spark: SparkSession,
    folder: str,
    available: Iterable[int | str],
    file_pattern: str = "temperature_{temperature}_train.csv",
    failed: list[tuple[str, str]] | None = None,
) -> DataFrame:
    """All conditions in one long table with ``condition`` and ``target`` columns.

    Conditions without a readable file are noted in ``failed``; none at all is an error.
    """
    available, tables = list(available), []
    for condition in available:
        table = _opened(lambda c=condition: read_condition(spark, folder, c, available, file_pattern), str(condition), failed)
        if table is None:
            continue
        name = target_for(condition)
        target = to_number(name) if name in table.columns else F.lit(None).cast("double")
        others = [c for c in table.columns if not c.startswith("rmsf_")]
        tables.append(table.select(*others, target.alias("target")))
    if not tables:
        raise ValueError("no condition could be loaded")
    return union_tables(tables)
