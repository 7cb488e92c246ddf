"""Q2 reads its rows once."""

from strandframe.models import validation


def test_q_squared_computes_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def noted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(0, 100, 1, 2).selectExpr("id", "CAST(id AS DOUBLE) AS x", "2.0D * id + id % 3 AS label").mapInArrow(noted, "id long, x double, label double")
    assert validation.q_squared(rows, ["x"], ["id"]) > 0.99
    assert seen.value == 100
