"""The scored lines: what their plan moves, and their rows."""

import pytest
from pyspark.sql import functions as F

from catalog import base


@pytest.fixture
def tables(spark, tmp_path):
    lines = spark.range(40).selectExpr(
        "id AS l_orderkey", "CASE WHEN id <> 7 THEN id % 5 END AS l_partkey", "id % 3 AS l_suppkey", "CAST(id % 7 AS INT) AS l_linenumber", "CAST(id % 50 AS DOUBLE) AS l_quantity",
        "id * 10.5D AS l_extendedprice", "0.05D AS l_discount", "0.02D AS l_tax", "'A' AS l_returnflag", "'O' AS l_linestatus", "TIMESTAMP '1996-01-01 00:00:00' AS l_shipdate")
    # a part twice, a part without a brand, a brand without lines
    parts = spark.createDataFrame(
        [(0, "one", 1, 10.0), (1, "one", 2, 11.0), (2, "two", 3, 12.0), (2, "one", 4, 13.0), (3, None, 5, 14.0), (9, "none", 6, 15.0)],
        "p_partkey bigint, p_brand string, p_size int, p_retailprice double")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    parts.write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_lines_are_not_moved_by_brand(spark, tables):
    scored = base.results(spark, tables)
    joins = [line for line in scored._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert "l_partkey" in joins[0], joins  # the outermost: a few brands hold all lines
    found = scored.groupBy("resname").agg(F.count("*"), F.sum("cents"), F.min("beta_cents"), F.max("beta_cents")).orderBy("resname").collect()
    # lines of parts 0, 1 and 2 (twice); line 7 has no part
    chosen = {"one": [i for i in range(40) if i % 5 in (0, 1, 2) and i != 7], "two": [i for i in range(40) if i % 5 == 2 and i != 7]}
    for brand, n, cents, low, high in found:
        expected = [1050 * i for i in chosen[brand]]
        assert (n, cents, low, high) == (len(expected), sum(expected), sum(expected) // len(expected), sum(expected) // len(expected))
    assert [row[0] for row in found] == ["one", "two"]
