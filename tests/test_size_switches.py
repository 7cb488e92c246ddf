"""Plans that change with the size of the input give the same rows on nulls, NaN, ties and text."""

import json
import math

import pytest
from pyspark.sql import functions as F

from strandframe.columns import offset_name
from strandframe.models.estimators import forest_regressor
from strandframe.operators import conditions, features, filters, metrics, ranking
from strandframe.sources import readers


@pytest.mark.parametrize("kind", ["long", "string", "double"])
def test_neighbours_in_blocks_keep_every_row(spark, kind):
    positions = [None if i % 5 == 0 else i // 2 for i in range(60)]
    if kind == "string":
        positions = [None if p is None else f"prefix-{p:03d}" for p in positions]
    if kind == "double":
        positions = [math.nan if i % 7 == 0 else None if p is None else float(p) for i, p in enumerate(positions)]
    frame = spark.createDataFrame([("g" if i % 3 else None, p, i, i * 10) for i, p in enumerate(positions)], f"domain_id string, resid {kind}, id int, v int")
    rows = []
    for limit in (1000, 3):
        out = features.neighbor_columns(frame, ["v"], 2, order=("resid", "id"), max_group_rows=limit, block_rows=4)
        rows.append(sorted((r.id, r[offset_name("v", -2)], r[offset_name("v", 1)]) for r in out.collect()))
    assert rows[0] == rows[1] and len(rows[0]) == 60


def test_medians_do_not_depend_on_group_size(spark):
    values = [math.nan, 1.0, 2.0, 3.0, None, 2.0]
    frame = spark.createDataFrame([(k, v) for k in ("a", None) for v in values], "k string, v double")
    found = [
        sorted((str(r.k), r.m) for r in ranking.aggregate_with_medians(frame, ["k"], [F.count("*").alias("n")], {"m": F.col("v")}, limit).collect())
        for limit in (1000, 2)
    ]
    assert found[0] == found[1] == [("None", 2.0), ("a", 2.0)]


@pytest.mark.parametrize("inline", [1000, 1])
def test_lists_with_null_do_not_depend_on_length(spark, monkeypatch, inline):
    monkeypatch.setattr(filters, "INLINE_KEYS", inline)
    frame = spark.createDataFrame([("a",), ("b",), (None,)], "domain_id string")
    keys = lambda df: sorted(str(r.domain_id) for r in df.collect())
    assert keys(filters.include_groups(frame, ["a", None, "c"])) == ["a"]
    assert keys(filters.exclude_groups(frame, ["a", None, "c"])) == ["None", "b"]
    assert keys(filters.include_groups(frame, [None])) == []
    assert keys(filters.exclude_groups(frame, [None])) == ["None", "a", "b"]
    listed = spark.createDataFrame([("a",), (None,)], "k string")
    assert keys(filters.exclude_groups(frame, listed)) == ["None", "b"]


def test_repeated_keys_stop_the_pivot(spark):
    long = spark.createDataFrame([("d", 1, "r", "1", 1.0, 9.0), ("d", 1, "r", "1", 5.0, 2.0)], "domain_id string, resid int, resname string, condition string, actual double, m_predicted double")
    with pytest.raises(Exception, match="repeats within a condition"):
        conditions.align_conditions(long, [1], ["m"]).select("resid").collect()
    assert conditions.align_conditions(long, [1], ["m"], unique_keys=False).count() == 2


@pytest.mark.parametrize("n", [10, 99_998])
def test_rank_correlation_of_constants_and_perfect_pairs(spark, n):
    frame = spark.range(n).select(F.col("id").alias("a"), (F.col("id") * 3).alias("b"), (-F.col("id")).alias("d"), F.lit(4).alias("c"))
    values = [metrics.rank_correlation(frame, "a", x).first()["spearman_correlation"] for x in ("b", "d", "c")]
    assert values == [1.0, -1.0, None]


def test_depth_beyond_the_limit_is_an_error():
    with pytest.raises(ValueError, match="31"):
        forest_regressor(max_depth=31)


def test_json_lines_whole_json_and_part_folders(spark, tmp_path):
    (tmp_path / "lines.json").write_text("\n".join(json.dumps({"a": i}) for i in range(10)))
    (tmp_path / "whole.json").write_text(json.dumps([{"a": i} for i in range(10)], indent=1))
    (tmp_path / "object.json").write_text(json.dumps({"a": 1}, indent=1))
    assert [readers.read_file(spark, f"{tmp_path}/{n}.json").count() for n in ("lines", "whole", "object")] == [10, 10, 1]
    assert readers.read_file(spark, f"{tmp_path}/lines.json", whole=False).count() == 10
    parts = tmp_path / "temperature_320_train.csv"
    parts.mkdir()
    for i in range(3):
        (parts / f"part-{i}.csv").write_text(f"domain_id,rmsf_320\nd{i},0.5\n")
    failed = []
    with pytest.warns(UserWarning, match="348"):
        table = readers.read_all_conditions(spark, str(tmp_path), [320, 348], failed=failed)
    assert table.count() == 3 and [name for name, _ in failed] == ["348"]
    assert readers.failure_table(spark, failed).count() == 1
