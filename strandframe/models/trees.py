"""A fitted forest as a table of its nodes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_folder


def node_table(spark: SparkSession, forest) -> DataFrame:
    """(tree, node, prediction, rows, gain, left, right, feature, threshold) of every node.

    Read from the model's own saved form, which is written to the shared folder; nodes are numbered in
    preorder, children and feature are -1 at leaves.
    """
    path = f"{shared_folder(spark)}/strandframe-{spark.sparkContext.applicationId}/nodes-{uuid.uuid4().hex[:12]}"
    forest.write().save(path)
    saved = spark.read.parquet(f"{path}/data")
    data = F.col("nodeData")
    return saved.select(
        F.col("treeID").alias("tree"),
        data["id"].alias("node"),
        data["prediction"].alias("prediction"),
        data["rawCount"].alias("rows"),
        data["gain"].alias("gain"),
        data["leftChild"].alias("left"),
        data["rightChild"].alias("right"),
        data["split"]["featureIndex"].alias("feature"),
        F.get(data["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
    )


def leaf_table(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, prediction): leaves numbered from the left, as the leaf column of a forest numbers them."""
    number = F.row_number().over(Window.partitionBy("tree").orderBy("node")) - 1  # a tree's leaves
    return nodes.filter("left < 0").select("tree", number.alias("leaf"), "prediction")


def tree_chunks(leaves: DataFrame, limit: int) -> list[tuple[int, int]]:
    """Ranges [first, after) of trees that hold about ``limit`` leaves together."""
    sizes = leaves.groupBy("tree").count().orderBy("tree").collect()  # a row per tree
    chunks, start, held = [], 0, 0
    for tree, n in sizes:
        if held and held + n > limit:
            chunks.append((start, tree))
            start, held = tree, 0
        held += n
    return [*chunks, (start, len(sizes))]


def leaf_values(leaves: DataFrame, first: int, after: int) -> Column:
    """The leaf values of some trees, an array per tree, as a subquery of the plan."""
    chosen = leaves.filter(F.col("tree").between(first, after - 1))
    per_tree = chosen.groupBy("tree").agg(F.array_sort(F.collect_list(F.struct("leaf", "prediction"))).alias("values"))
    values = F.transform("values", lambda v: v["prediction"])
    listed = per_tree.select(F.struct("tree", values.alias("values")).alias("t")).agg(F.array_sort(F.collect_list("t")).alias("trees"))
    return listed.select(F.transform("trees", lambda t: t["values"])).scalar()
