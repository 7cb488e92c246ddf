"""Writing result tables and reading them back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..columns import CONDITION


def write_results(
    df: DataFrame, path: str, partition_by: Sequence[str] = (CONDITION,), mode: str = "overwrite"
) -> str:
    """Parquet, one folder per condition, so that reading one condition prunes the rest."""
    columns = [c for c in partition_by if c in df.columns]
    df.write.mode(mode).partitionBy(*columns).parquet(path)
    return path


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """CSV with a header; a folder of part files, written in parallel."""
    df.write.mode(mode).option("header", True).csv(path)
    return path


def write_chunks(df: DataFrame, path: str, rows_per_file: int, mode: str = "overwrite") -> str:
    """Files of at most ``rows_per_file`` rows each."""
    df.write.mode(mode).option("maxRecordsPerFile", rows_per_file).parquet(path)
    return path


def read_results(
    spark: SparkSession, path: str, conditions: Sequence[int | str] | None = None
) -> DataFrame:
    """Results of the wanted conditions; the filter prunes partition folders."""
    df = spark.read.parquet(path)
    df = df.withColumn(CONDITION, df[CONDITION].cast("string"))
    if conditions is None:
        return df
    return df.filter(df[CONDITION].isin(*[str(c) for c in conditions]))
