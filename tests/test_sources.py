import json

import pytest
from pyspark.sql import functions as F

from strandframe.columns import input_schema
from strandframe.sources import checks, profile, readers, sinks
from strandframe.sources.kept import Kept


@pytest.fixture()
def files(tmp_path):
    for t, factor in ((320, 1), (450, 2), ("average", 3)):
        lines = ["domain_id,resid,resname,rmsf_%s" % t] + [f"d{i % 2},{i},GLY,{i * factor}.5" for i in range(6)]
        (tmp_path / f"temperature_{t}_train.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "notes.csv").write_text("a,b\n1,2\n")
    (tmp_path / "rows.tsv").write_text("a\tb\n1\tx\n")
    (tmp_path / "rows.json").write_text(json.dumps([{"a": 1, "b": "x"}, {"a": 2, "b": None}]))
    (tmp_path / "odd.dat").write_text("a\tb,c\n1\t2\n")
    (tmp_path / "plain.dat").write_text("a,b\n1,2\n")
    return str(tmp_path)


def test_formats(spark, files):
    assert readers.detect_format(spark, f"{files}/odd.dat") == "tsv"
    assert readers.detect_format(spark, f"{files}/plain.dat") == "csv"
    assert readers.read_file(spark, f"{files}/rows.tsv").collect() == [(1, "x")]
    assert readers.read_file(spark, f"{files}/rows.json").count() == 2
    assert readers.read_file(spark, f"{files}/notes.csv").columns == ["a", "b"]
    with pytest.raises(ValueError):
        readers.read_file(spark, f"{files}/notes.csv", "hdf5")


def test_condition_files(spark, files):
    found = {(r["condition"], r["condition_k"]) for r in readers.condition_files(spark, files).collect()}
    assert found == {("320", 320), ("450", 450), ("average", None)}


def test_one_and_all_conditions(spark, files):
    available = [320, 450, "average", 999]
    one = readers.read_condition(spark, files, 450, available)
    assert one.filter(F.col("rmsf_450") == 10.5).count() == 1
    typed = readers.read_condition(spark, files, 320, available, schema=input_schema([320], ["domain_id", "resid", "resname", "rmsf_320"]))
    assert typed.schema["rmsf_320"].dataType.simpleString() == "double"
    every = readers.read_all_conditions(spark, files, available)
    assert {r["condition"]: r["count"] for r in every.groupBy("condition").count().collect()} == {"320": 6, "450": 6, "average": 6}
    with pytest.raises(ValueError):
        readers.read_condition(spark, files, 100, available)
    with pytest.raises(FileNotFoundError):
        readers.read_condition(spark, files, 999, available)
    with pytest.raises(ValueError):
        readers.read_all_conditions(spark, files, [999])


def test_merge(spark, files):
    merged = readers.merge_files(spark, [f"{files}/notes.csv", f"{files}/gone.csv", f"{files}/temperature_320_train.csv"])
    assert merged.count() == 7 and set(merged.columns) == {"a", "b", "domain_id", "resid", "resname", "rmsf_320"}
    with pytest.raises(ValueError):
        readers.merge_files(spark, [f"{files}/gone.csv"])
    with pytest.raises(ValueError):
        readers.merge_files(spark, [])


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "v double, n int")
    assert [r["v"] for r in readers.nan_to_null(df).orderBy("n").collect()] == [None, 2.0]


def test_checks(spark):
    df = spark.createDataFrame([("d", 1, "GLY", 1.0), ("d", 1, "GLY", 2.0)], "domain_id string, resid int, resname string, rmsf_320 double")
    assert checks.require_columns(df, 320) is df
    assert checks.missing_columns(df, ["rmsf_{temperature}"], 450) == ["rmsf_450"]
    assert checks.duplicate_keys(df).collect() == [("d", 1, "GLY", 2)]


def test_profile(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), (None, 3.0)], "domain_id string, rmsf_320 double")
    columns = {r["column"]: r for r in profile.column_profile(df).collect()}
    assert (columns["rmsf_320"]["null_count"], columns["rmsf_320"]["null_percentage"], columns["rmsf_320"]["is_target"]) == (1, 25.0, True)
    assert profile.group_profile(df).first().asDict() == {"num_groups": 3, "min_size": 1, "max_size": 2, "mean_size": 1.5, "median_size": 1.5}


def test_results_prune_partitions(spark, tmp_path):
    df = spark.createDataFrame([("320", 1), ("450", 2), ("average", 3)], "condition string, v int")
    path = sinks.write_results(df, str(tmp_path / "r"))
    one = sinks.read_results(spark, path, [320])
    assert one.collect()[0]["v"] == 1
    assert sinks.read_results(spark, path).count() == 3


def test_a_thousand_files_are_a_few_scans(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    paths = []
    for i in range(1000):
        if i % 4 == 0:
            (tmp_path / f"{i}.csv").write_text(f"a,b\n{i},x\n" if i % 8 else f"b,a\nx,{i}\n")
            paths.append(f"{tmp_path}/{i}.csv")
        elif i % 4 == 1:
            (tmp_path / f"{i}.json").write_text(json.dumps({"a": i, "c": [1]}) + "\n" + json.dumps({"a": -i}))
            paths.append(f"file:{tmp_path}/{i}.json")
        else:
            pq.write_table(pa.table({"a": pa.array([i], "int32" if i % 4 == 2 else "int64"), "d": [0.5]}), tmp_path / f"{i}.parquet")
            paths.append(f"file://{tmp_path}/{i}.parquet")
    (tmp_path / "spoilt.parquet").write_bytes(b"PAR1 not a file")
    paths += [f"{tmp_path}/spoilt.parquet", f"{tmp_path}/gone.csv"]
    failed = []
    with pytest.warns(UserWarning, match="spoilt"):
        merged = readers.merge_files(spark, paths, failed=failed)
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 5  # two orders of csv columns, json lines, two types of parquet
    assert sorted(p.rsplit("/", 1)[-1] for p, _ in failed) == ["gone.csv", "spoilt.parquet"]
    assert set(merged.columns) == {"a", "b", "c", "d"} and merged.schema["a"].dataType.simpleString() == "bigint"
    rows = merged.select("a", "b", "d").collect()
    assert len(rows) == 1250 and sorted(r.a for r in rows if r.a >= 0) == list(range(1000))
    assert {r.b for r in rows if r.a % 4 == 0 and r.a >= 0} == {"x"}


def test_a_spoilt_file_leaves_the_others(spark, tmp_path):
    for name, text in (("a", '{"v": 1}\n'), ("b", '{"v": 2}\n')):
        (tmp_path / f"{name}.json").write_text(text)
    (tmp_path / "whole.json").write_text(json.dumps([{"v": 3}, {"v": 4}], indent=1))
    (tmp_path / "empty.csv").write_text("")
    merged = readers.merge_files(spark, [f"{tmp_path}/{n}" for n in ("a.json", "whole.json", "b.json", "a.json")])
    assert sorted(r.v for r in merged.collect()) == [1, 1, 2, 3, 4]


def test_kept_tables_are_computed_once_and_go(spark):
    import os

    counted = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def touch(x):
        counted.add(1)
        return x

    with Kept() as keep:
        table = keep(spark.range(5).select(touch("id").alias("v")))
        assert table.count() == 5 and table.agg(F.sum("v")).first()[0] == 10 and counted.value == 5
        places = [path.removeprefix("file://") for _, path in keep.places]
        assert all(os.path.isdir(p) for p in places)
    assert not any(os.path.exists(p) for p in places)
