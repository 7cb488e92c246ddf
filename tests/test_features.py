import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.operators import clean, features, filters, sequence
from strandframe.plans.preparation import prepare

SCHEMA = "domain_id string, resid int, resname string, x double, n int"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [
            ("a", 1, "GLY", 1.0, 5), ("a", 3, "ALA", None, 6), ("a", 4, "ALA", 3.0, 7),
            ("b", 9, "PRO", 4.0, 8),
            (None, 1, "GLY", 9.0, 1), (None, 2, "GLY", 9.5, 1),
        ],
        SCHEMA,
    )


def as_dict(df, *columns):
    return {(r["domain_id"], r["resid"]): tuple(r[c] for c in columns) for r in df.collect()}


def test_neighbors_skip_gaps_and_use_edge_values(rows):
    around = features.neighbor_columns(rows, ["x", "n", "resname"], 1)
    found = as_dict(around, "x_offset_-1", "x_offset_1", "n_offset_-1", "n_offset_1", "resname_offset_1")
    assert found[("a", 1)] == (None, None, 0, 6, "ALA")
    assert found[("a", 4)] == (None, None, 6, 0, None)
    assert found[("b", 9)] == (None, None, 0, 0, None)
    assert found[(None, 1)] == (None, None, None, None, None)


def test_neighbors_without_work_are_unchanged(rows):
    assert features.neighbor_columns(rows, ["x"], 0).columns == rows.columns
    assert features.neighbor_columns(rows, ["nope"], 2).columns == rows.columns
    with pytest.raises(ValueError):
        features.neighbor_columns(rows.drop("resid"), ["x"], 1)


def test_fill_statistics(rows):
    # median of 1, 3, 4, 9, 9.5; most frequent n is 1; ALA and GLY: GLY occurs three times
    assert features.fill_statistics(rows, ["x", "n", "resname"]) == {"x": 4.0, "n": 1, "resname": "GLY"}
    empty = rows.filter(F.lit(False))
    assert features.fill_statistics(empty, ["x", "n", "resname"]) == {"x": 0.0, "n": 0, "resname": ""}


def test_mode_ties_take_the_smallest(spark):
    df = spark.createDataFrame([(3, "b"), (3, "b"), (1, "a"), (1, "a"), (2, "c")], "n int, s string")
    assert features.fill_statistics(df, ["n", "s"]) == {"n": 1, "s": "a"}


def test_filled_neighbors_keep_integer_edges(rows):
    around = features.add_neighbors(rows, ["x", "n"], 1)
    found = as_dict(around, "x_offset_-1", "x_offset_1", "n_offset_-1", "n_offset_1")
    assert found[("a", 1)] == (4.0, 4.0, 0, 6)
    assert found[(None, 2)] == (4.0, 4.0, 1, 1)


def test_blocks_equal_one_window_for_a_hot_group(spark):
    """One group holds more than a third of the rows; ties on position are broken by id."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 50).cast("string"))).alias("domain_id"),
        (F.col("id") * 7919 % 1000).cast("int").alias("resid"),
        F.col("id").alias("tie"),
        F.sin(F.col("id").cast("double")).alias("x"),
    )
    order = ["resid", "tie"]
    plain = features.neighbor_columns(df, ["x"], 3, order=order)
    blocks = features.neighbor_columns(df, ["x"], 3, order=order, max_group_rows=100, block_rows=17)
    assert blocks.count() == 3000
    assert plain.exceptAll(blocks.select(plain.columns)).isEmpty()


def test_group_columns(rows):
    found = as_dict(features.add_group_columns(rows), "normalized_resid", "protein_size")
    assert found[("a", 3)] == (pytest.approx(2 / 3), 3)
    assert found[("b", 9)] == (0.0, 1)
    assert found[(None, 1)] == (None, None)


def test_group_columns_keep_present_ones(rows):
    given = rows.withColumn("protein_size", F.lit(77)).withColumn("normalized_resid", F.lit(0.5))
    assert as_dict(features.add_group_columns(given), "protein_size", "normalized_resid")[("a", 1)] == (77, 0.5)


def test_cleaning(spark):
    df = spark.createDataFrame(
        [(1, None, None, "2.5"), (2, "E", "bad", None), (3, "H", "0.25", "3.5")],
        "i int, dssp string, relative_accessibility string, esm_rmsf string",
    )
    cleaned = clean.clean(df).orderBy("i").collect()
    assert [r["dssp"] for r in cleaned] == ["C", "E", "H"]
    assert [r["relative_accessibility"] for r in cleaned] == [0.5, 0.5, 0.25]
    assert [r["esm_rmsf"] for r in cleaned] == [2.5, 3.0, 3.5]
    nothing = df.withColumn("esm_rmsf", F.lit(None).cast("double"))
    assert {r["esm_rmsf"] for r in clean.clean(nothing).collect()} == {0.0}


def test_target(rows):
    assert as_dict(clean.prepare_target(rows, "x"), "x")[("a", 3)] == (0.0,)
    with pytest.raises(ValueError):
        clean.prepare_target(rows, "rmsf_320")


def test_feature_order_is_text_order(spark):
    df = spark.createDataFrame([(1, 2.0)], "b int, a double")
    df = features.neighbor_columns(df.withColumn("domain_id", F.lit("g")).withColumn("resid", F.lit(1)), ["a", "b"], 10)
    names = features.feature_names(df, ["b", "a", "missing"], 10)
    assert names[:2] == ["a", "b"]
    assert names[2:] == sorted(names[2:])
    assert names.index("a_offset_-10") < names.index("a_offset_-2")
    with pytest.raises(ValueError):
        features.feature_names(df, ["missing"])


def test_filters(rows):
    def groups(df):
        return sorted({r[0] for r in df.select("domain_id").collect()}, key=str)

    assert groups(filters.include_groups(rows, [])) == [None, "a", "b"]
    assert groups(filters.include_groups(rows, ["a"])) == ["a"]
    assert groups(filters.exclude_groups(rows, ["a"])) == [None, "b"]
    assert groups(filters.filter_group_size(rows, 1, 1)) == ["b"]
    assert groups(filters.filter_group_size(rows, 3)) == ["a"]
    # size is counted after the lists are applied
    assert groups(filters.filter_groups(rows, exclude=["b"], minimum=1)) == ["a"]
    many = [f"k{i}" for i in range(2000)] + ["a"]
    assert groups(filters.include_groups(rows, many)) == ["a"]
    assert filters.positive_pairs(rows, "x", "n").count() == 5
    assert filters.complete_pairs(rows, "x", "n").count() == 5


def test_sequence_complexity(spark):
    letters = ["GLY", "GLY", "ALA", "UNK", "TRP", "HSD", "HIS"]
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate(letters)], "domain_id string, resid int, resname string")
    code = {"GLY": "G", "ALA": "A", "UNK": "X", "TRP": "W", "HSD": "H", "HIS": "H"}
    for size in (1, 3, 4, 5):
        half = size // 2
        padded = ["X"] * half + [code[v] for v in letters] + ["X"] * half
        expected = []
        for i in range(len(letters)):
            window = padded[i : i + 2 * half + 1]
            shares = [window.count(c) / size for c in sorted(set(window))]
            top = np.log2(min(20, size))
            expected.append(-sum(p * np.log2(p) for p in shares) / top if top else 0.0)
        found = sequence.sequence_complexity(df, size).orderBy("resid").collect()
        assert [r["complexity"] for r in found] == pytest.approx(expected)


def test_fills_see_groups_that_are_filtered_out(spark):
    df = spark.createDataFrame(
        [("a", 1, "GLY", 1.0), ("a", 2, "GLY", 2.0), ("b", 1, "GLY", 100.0)],
        "domain_id string, resid int, resname string, rmsf_320 double",
    )
    ready = prepare(df, 320, ["rmsf_320"], k=1, exclude=["b"])
    found = as_dict(ready, "rmsf_320_offset_-1")
    assert found == {("a", 1): (2.0,), ("a", 2): (1.0,)}
    with pytest.raises(ValueError):
        prepare(df, 450, ["rmsf_320"])
