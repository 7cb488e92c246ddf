import pytest
from pyspark.sql import functions as F

from strandframe.operators import splits


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(2000).select(F.concat(F.lit("g"), (F.col("id") % 37).cast("string")).alias("domain_id"), "id").persist()


def sizes(df, column, of="domain_id"):
    return {r[0]: r[1] for r in df.groupBy(column).agg(F.countDistinct(of)).collect()}


def test_group_split_is_disjoint_complete_and_exact(rows):
    split = splits.split_groups(rows)
    assert split.count() == 2000
    assert split.groupBy("domain_id").agg(F.countDistinct("split").alias("n")).filter("n > 1").isEmpty()
    # 37 groups: ceil(7.4) test, ceil(29 * 0.1875) validation
    assert sizes(split, "split") == {"test": 8, "validation": 6, "train": 23}


def test_split_repeats_and_depends_on_the_seed(rows):
    first = splits.split_groups(rows.repartition(7))
    assert first.exceptAll(splits.split_groups(rows)).isEmpty()
    assert not first.exceptAll(splits.split_groups(rows, seed=7)).isEmpty()


def test_threshold_split_keeps_groups_whole(rows):
    split = splits.split_groups(rows, exact=False)
    assert split.groupBy("domain_id").agg(F.countDistinct("split").alias("n")).filter("n > 1").isEmpty()


def test_few_groups_fall_back_to_rows(rows):
    two = rows.withColumn("domain_id", (F.col("id") % 2).cast("string"))
    split = splits.split_groups(two, row_keys=["id"])
    assert sizes(split, "split", "id") == {"test": 400, "validation": 300, "train": 1300}


def test_bad_shares():
    with pytest.raises(ValueError):
        splits.split_sizes(10, 1.0, 0.1)
    with pytest.raises(ValueError):
        splits.split_sizes(10, 0.6, 0.5)


def test_folds(rows):
    assert sorted(sizes(splits.even_folds(rows, 5), "fold").values()) == [7, 7, 7, 8, 8]
    assert sum(sizes(splits.hash_folds(rows, 5), "fold").values()) == 37
    by_row = sizes(splits.hash_folds(rows, 4, ["id"]), "fold", "id")
    assert set(by_row) == {0, 1, 2, 3} and sum(by_row.values()) == 2000


def test_null_group_gets_a_split(rows):
    with_null = rows.withColumn("domain_id", F.when(F.col("domain_id") != "g3", F.col("domain_id")))
    assert splits.split_groups(with_null).count() == 2000


def test_sample(rows):
    assert splits.sample_rows(rows, 100, ["id"]).count() == 100
    assert splits.sample_rows(rows, 5000, ["id"]).count() == 2000
    assert splits.members(rows, rows.filter("id < 3")).select("domain_id").distinct().count() == 3


def test_exact_splits_shuffle_no_rows(rows):
    for split in (splits.split_groups(rows), splits.split_rows(rows, ["id"], exact=True), splits.range_folds(rows, 5)):
        assert "Exchange" not in split._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limit", [10_000, 0])
def test_exact_counts_with_repeated_and_colliding_keys(spark, rows, monkeypatch, limit):
    monkeypatch.setattr(splits, "CUT_ROWS", limit)
    few = rows.select((F.col("id") % 7).alias("k"), F.when(F.col("id") % 3 > 0, F.col("id") % 2).alias("z"), "id")
    split = splits.split_rows(few, ["k", "z"], exact=True)
    assert sizes(split, "split", "id") == {"test": 400, "validation": 300, "train": 1300} and split.count() == 2000
    # hashes of one value: the order of the keys alone decides
    monkeypatch.setattr(splits, "key_hash", lambda keys, seed: F.lit(5).cast("long"))
    split = splits.split_groups(rows)
    assert sizes(split, "split") == {"test": 8, "validation": 6, "train": 23}
    first = sorted(r.domain_id for r in split.filter("split = 'test'").select("domain_id").distinct().collect())
    assert first == sorted(f"g{i}" for i in range(37))[:8]


def test_range_folds(spark, rows):
    assert sorted(sizes(splits.range_folds(rows, 5), "fold").values()) == [7, 7, 7, 8, 8]
    two = rows.withColumn("domain_id", F.when(F.col("id") % 2 > 0, "x"))
    folds = splits.range_folds(two, 5)
    assert folds.count() == 2000 and folds.groupBy("domain_id").agg(F.countDistinct("fold").alias("n")).filter("n > 1").isEmpty()
    assert splits.range_folds(rows.limit(0), 5).count() == 0
