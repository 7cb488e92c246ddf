import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandframe.models import importance, records, scoring, trees, validation
from strandframe.models.estimators import VALIDATION_FLAG, estimator, fit, load_model, save_model, validation_flag
from strandframe.operators import reports

FEATURES = ["a", "b", "noise"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    n = 600
    data = pd.DataFrame({"id": range(n), "domain_id": [f"g{i % 12}" for i in range(n)], **{f: rng.random(n) for f in FEATURES}})
    data["label"] = 3 * data.a + np.sin(4 * data.b) + rng.normal(0, 0.05, n)
    return spark.createDataFrame(data).persist()


@pytest.fixture(scope="module")
def forest(rows):
    return fit(estimator("random_forest", FEATURES, n_estimators=6, max_depth=5), rows)


@pytest.mark.parametrize("limit", [10**6, 40])
def test_tree_mean_is_the_prediction(rows, forest, limit):
    scored = scoring.predict_with_std(forest, scoring.predict(forest, rows, "plain"), "p", "s", leaves_per_literal=limit)
    worst, least = scored.agg(F.max(F.abs(F.col("p") - F.col("plain"))), F.min("s")).first()
    assert worst < 1e-12 and least >= 0


def test_tree_std_is_over_the_trees(rows, forest):
    sample = rows.filter("id < 40")
    found = [r["uncertainty"] for r in scoring.predict_with_std(forest, sample).orderBy("id").collect()]
    assembler, model = forest.stages
    ready = assembler.transform(sample)
    per_tree = [[r["prediction"] for r in t.transform(ready).orderBy("id").collect()] for t in model.trees]
    assert found == pytest.approx(list(np.std(per_tree, axis=0)))


def test_forest_of_200_deep_trees(rows):
    """Leaf values come from the node table: means and spreads equal those of the single trees."""
    model = fit(estimator("random_forest", FEATURES, n_estimators=200, max_depth=12), rows)
    regressor = model.stages[-1]
    nodes = trees.node_table(rows.sparkSession, regressor)
    assert nodes.count() == regressor.totalNumNodes
    leaves = trees.leaf_table(nodes)
    assert [r.n for r in leaves.groupBy("tree").agg(F.max("leaf").alias("n")).orderBy("tree").collect()] == [(t.numNodes + 1) // 2 - 1 for t in regressor.trees]
    chunks = trees.tree_chunks(leaves, 5000)
    assert len(chunks) > 3 and chunks[0][0] == 0 and chunks[-1][1] == 200 and all(a[1] == b[0] for a, b in zip(chunks, chunks[1:]))
    sample = rows.filter("id < 12")
    scored = scoring.predict_with_std(model, scoring.predict(model, sample, "plain"), "p", "s", leaves_per_literal=5000).orderBy("id").collect()
    assert [r.p for r in scored] == pytest.approx([r.plain for r in scored], abs=1e-12)
    vectors = [r.features for r in model.stages[0].transform(sample).orderBy("id").collect()]
    per_tree = [[t.predict(v) for v in vectors] for t in regressor.trees[:200]]
    assert [r.s for r in scored] == pytest.approx(list(np.std(per_tree, axis=0)))


def test_equal_trees_have_no_spread(rows):
    model = fit(estimator("random_forest", FEATURES, n_estimators=5, max_depth=6, bootstrap=False, max_features="all"), rows)
    assert scoring.predict_with_std(model, rows).agg(F.max("uncertainty")).first()[0] < 1e-12


def test_split_size_is_refused(rows):
    with pytest.raises(ValueError, match="min_samples_split 5"):
        estimator("random_forest", FEATURES, min_samples_split=5)
    assert estimator("random_forest", FEATURES, min_samples_split=2) is not None


def test_rotations_are_permutations(spark, rows, forest):
    assert importance.rotations(1, 3, 42) == [0, 0, 0] and importance.rotations(2, 3, 42) == [1, 1, 1]
    assert all(1 <= s < 600 for s in importance.rotations(600, 50, 1))
    plan = importance.permutation_importance(forest, rows, ["id"], 10)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number()") <= 2  # the numbering, once on each side of the join
    one = importance.permutation_importance(forest, rows.filter("id = 1"), ["id"], 2)
    assert {r.importance for r in one.collect()} == {None}  # one row has no R2


def test_records_of_a_fit(spark, rows, forest, tmp_path):
    assert records.write_records(forest, rows, str(tmp_path / "f")) == ["importances"]
    assert records.read_record(spark, str(tmp_path / "f"), "importances").agg(F.sum("importance")).first()[0] == pytest.approx(1)
    model = fit(estimator("boosted", FEATURES, epochs=3, max_depth=2, tolerance=0.0), rows, ["id"])
    flagged = rows.withColumn(VALIDATION_FLAG, validation_flag(["id"]))
    assert records.write_records(model, flagged, str(tmp_path / "b")) == ["importances", "history"]
    assert reports.training_curve(records.read_record(spark, str(tmp_path / "b"), "history")).count() == 3
    assert records.write_records(fit(estimator("linear", FEATURES), rows), rows, str(tmp_path / "l")) == []


def test_members_see_their_own_rows(rows):
    parts = [{r.id for r in scoring.subsample_rows(rows, ["id"], 0.7, seed).select("id").collect()} for seed in (43, 44)]
    assert all(0.6 * 600 < len(p) < 0.8 * 600 for p in parts) and parts[0] != parts[1]
    assert parts[0] == {r.id for r in scoring.subsample_rows(rows.repartition(7), ["id"], 0.7, 43).select("id").collect()}


def test_save_and_load(rows, forest, tmp_path):
    loaded = load_model(save_model(forest, str(tmp_path / "m")))
    both = scoring.predict(loaded, scoring.predict(forest, rows, "x"), "y")
    assert both.filter(F.col("x") != F.col("y")).isEmpty()


def test_importances(rows, forest):
    built_in = {r["feature"]: r["importance"] for r in importance.built_in_importance(forest, rows).collect()}
    assert sum(built_in.values()) == pytest.approx(1)
    assert reports.top_importances(importance.built_in_importance(forest, rows), 1).first()["feature"] == "a"
    shuffled = {r["feature"]: r["importance"] for r in importance.permutation_importance(forest, rows, ["id"], 3).collect()}
    assert set(shuffled) == set(FEATURES)
    assert shuffled["a"] > shuffled["b"] > shuffled["noise"] and abs(shuffled["noise"]) < 0.05


def test_boosting_history(rows):
    model = fit(estimator("boosted", FEATURES, epochs=5, max_depth=3, learning_rate=0.3, tolerance=0.0), rows, ["id"])
    history = scoring.training_history(model, rows.withColumn(VALIDATION_FLAG, validation_flag(["id"])))
    curve = reports.training_curve(history).collect()
    losses = [r["train_loss"] for r in curve]
    assert losses == sorted(losses, reverse=True) and {"val_loss", "val_r2", "train_r2"} <= set(curve[0].asDict())
    with pytest.raises(ValueError):
        fit(estimator("boosted", FEATURES), rows)


def test_ensemble(rows):
    models = scoring.fit_ensemble("boosted", rows, FEATURES, ["id"], size=2, epochs=2, max_depth=2)
    scored = scoring.score_new_data(models, rows, "label", with_uncertainty=True, with_quality=True)
    assert scored.filter((F.col("label_uncertainty") < 0) | F.col("label_uncertainty").isNull()).isEmpty()
    assert "label_z_score" in scored.columns


def test_search(rows):
    fitted, table = validation.search(
        estimator("random_forest", FEATURES, n_estimators=3), rows, {"max_depth": [1, 5], "max_features": ["sqrt", 0.7]}, n=3, folds=2)
    assert table.count() == 3
    best = table.orderBy("mse").first()
    assert "'max_depth': 5" in best["parameters"]
    assert fitted.bestModel.stages[-1].getNumTrees == 3
    assert len(validation.parameter_sets({"x": [1, 2], "y": [3, 4]})) == 4


def test_cross_validation(rows):
    summary, scored = validation.cross_validate(lambda: estimator("random_forest", FEATURES, n_estimators=3, max_depth=4), rows, folds=3, keys=["id"])
    assert scored.count() == rows.count()
    assert scored.groupBy("domain_id").agg(F.countDistinct("fold").alias("n")).filter("n > 1").isEmpty()
    found = {r["metric"]: (r["mean"], r["std"]) for r in summary.collect()}
    assert set(found) == {"rmse", "mae", "r2", "pearson_correlation", "uncertainty_std"}
    assert 0.8 < found["r2"][0] < 1 and found["r2"][1] >= 0


def test_q_squared(rows):
    assert 0.7 < validation.q_squared(rows, FEATURES, ["id"]) < 1


def test_evaluate_and_new_data(rows, forest):
    table, scored = scoring.evaluate_models({"random_forest": forest}, rows, n_features=3)
    assert 0.8 < table.first()["r2"] < 1
    assert {"random_forest_predicted", "random_forest_abs_error", "random_forest_uncertainty"} <= set(scored.columns)
    new = scoring.score_new_data(forest, rows.drop("label"), "label")
    assert "label_predicted" in new.columns and "label_error" not in new.columns


def test_conditions_go_on_after_a_failure(rows):
    def one(condition):
        if condition == 348:
            raise ValueError("no data")
        return fit(estimator("linear", ["a"]), rows)

    fitted, failed = scoring.fit_conditions(one, [320, 348, 450])
    assert list(fitted) == [320, 450] and failed == {348: "no data"}
    with pytest.raises(ValueError):
        estimator("unheard_of", FEATURES)
