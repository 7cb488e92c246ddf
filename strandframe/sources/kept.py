"""Intermediate tables that several results read: computed once, written to the shared folder, removed when done."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..session import shared_folder


class Kept:
    """``with Kept() as keep: table = keep(df)``: ``table`` reads what ``df`` gave once, until the block ends.

    Results that read such tables are computed inside. Without ``with``, ``release()`` removes them.
    """

    def __init__(self):
        self.places: list[tuple] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        path = f"{shared_folder(spark)}/strandframe-{spark.sparkContext.applicationId}/kept-{uuid.uuid4().hex[:12]}"
        self.places.append((spark, path))
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        while self.places:
            spark, path = self.places.pop()
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

    def __enter__(self) -> Kept:
        return self

    def __exit__(self, *_) -> None:
        self.release()
