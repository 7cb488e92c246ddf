"""Model fitting, scoring, validation, search and importance.

Trees have a SQL form where their inputs have few values: a tree deep enough holds the mean label of
every combination of inputs, a tree of one split the means by the input that explains most. Linear
regression has one anyway. Trees on other inputs are covered by ``tests/test_models.py``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.models import importance, records, scoring, validation
from strandframe.models.estimators import VALIDATION_FLAG, estimator, fit, load_model, save_model, validation_flag
from strandframe.operators import metrics, reports
from strandframe.operators.splits import part, split_groups
from strandframe.sources.readers import union_tables

from .base import RESULTS, ROW_KEYS, fix, p_value_sql, query, r, ra, results, scratch, with_

FEATURES = ["bulky", "reduced", "structure", "surface"]
PAIR = FEATURES[:2]
# Trees that see all rows and all inputs are alike, and split until every combination of inputs has its
# own leaf, so a prediction is the mean label of the combination.
FOREST = {"n_estimators": 8, "max_depth": 5, "bootstrap": False, "max_features": "all"}
# Two rounds of one split each: the mean by one input, then a share of what the other one explains.
BOOSTED = {"epochs": 2, "max_depth": 1, "tolerance": 0.0}
RATE = 0.1

_HASH = "CAST('0x' || substring(md5({} || '-{}'), 1, 13) AS BIGINT)"
_LINE = " || '-' || ".join(f"CAST({k} AS VARCHAR)" for k in ROW_KEYS)
_GROUP_HASH = _HASH.format("CAST(domain_id AS VARCHAR)", 42)
_PLACES = f"SELECT domain_id, row_number() OVER (ORDER BY {_GROUP_HASH}, domain_id) - 1 AS place, count(*) OVER () AS groups FROM (SELECT DISTINCT domain_id FROM results)"
_TESTED = (
    f"placed AS (SELECT *, ceil(groups * 0.2::DOUBLE) AS t FROM ({_PLACES})), "
    "tested AS (SELECT results.* FROM results JOIN placed USING (domain_id) WHERE place < t)"
)


def labelled(spark, folder):
    """All scored lines with the price in thousands as label."""
    rows = results(spark, folder)
    return rows.select(*ROW_KEYS, "domain_id", "shipyear", "l_quantity", (F.col("actual") / 1000).alias("label"))


def classed(spark, folder):
    """All scored lines by inputs of two or three values, the first model's value in thousands and the discount in percent as label."""
    rows = results(spark, folder)
    return rows.select(
        *ROW_KEYS, "domain_id",
        (F.col("l_quantity") > 25).cast("int").alias("bulky"), (F.col("l_discount") > 0.05).cast("int").alias("reduced"),
        F.col("secondary_structure_encoded").alias("structure"), F.col("core_exterior_encoded").alias("surface"),
        (F.col("alpha_predicted") / 1000 + 100 * F.col("l_discount")).alias("label"),
    )


_ROWS = RESULTS + f""", rows AS MATERIALIZED (
  SELECT {", ".join(ROW_KEYS)}, domain_id, CAST(l_quantity > 25 AS INTEGER) AS bulky, CAST(l_discount > 0.05 AS INTEGER) AS reduced,
    secondary_structure_encoded AS structure, core_exterior_encoded AS surface, alpha_cents / 100.0::DOUBLE / 1000 + 100 * l_discount AS y,
    {_HASH.format(_LINE, 42)} AS h, {_GROUP_HASH} AS gh
  FROM results)"""
_SHARE = 0.15 / (1 - 0.2)
_PARTS = _ROWS + f""",
parted AS (SELECT rows.*, CASE WHEN place < t THEN 'test' WHEN place < t + ceil((groups - t) * {_SHARE!r}::DOUBLE) THEN 'validation' ELSE 'train' END AS part
  FROM rows JOIN (SELECT *, ceil(groups * 0.2::DOUBLE) AS t FROM ({_PLACES})) USING (domain_id)),
train AS MATERIALIZED (SELECT * FROM parted WHERE part = 'train'), test AS MATERIALIZED (SELECT * FROM parted WHERE part = 'test')"""
_HELD_OUT = f"h < {int(0.2 * 2**52)}"


def _means(name: str, train: str, test: str, inputs=FEATURES) -> str:
    """``test`` with p, the mean label of the same inputs in ``train``."""
    using = ", ".join(inputs)
    return f"{name} AS (SELECT * FROM {test} JOIN (SELECT {using}, avg(y) AS p FROM {train} GROUP BY {using}) USING ({using}))"


def _stumps(name: str, train: str, test: str, rate: float = RATE) -> str:
    """``test`` with p1 and p2, the predictions after one and two rounds fitted on ``train``."""
    def pick(number: int) -> str:
        return f"CASE (SELECT f FROM {name}_best{number}) WHEN 'bulky' THEN bulky ELSE reduced END"

    def chosen(number: int, source: str, label: str) -> str:
        gains = " UNION ALL ".join(f"SELECT '{f}' AS f, sum(n * m * m) AS g FROM (SELECT count(*) AS n, avg({label}) AS m FROM {source} GROUP BY {f})" for f in PAIR)
        return (f"{name}_best{number} AS (SELECT f FROM ({gains}) ORDER BY g DESC LIMIT 1), "
                f"{name}_tree{number} AS (SELECT {pick(number)} AS v{number}, avg({label}) AS m{number} FROM {source} GROUP BY 1)")

    return (f"{chosen(1, train, 'y')}, {name}_rest AS (SELECT s.*, 2 * (y - m1) AS e FROM {train} s JOIN {name}_tree1 ON v1 = {pick(1)}), "
            f"{chosen(2, f'{name}_rest', 'e')}, "
            f"{name} AS (SELECT s.*, m1 AS p1, m1 + {rate} * m2 AS p2 FROM {test} s JOIN {name}_tree1 ON v1 = {pick(1)} JOIN {name}_tree2 ON v2 = {pick(2)})")


_MSE = "avg((y - {0}) * (y - {0}))"
_R2 = "1 - sum((y - {0}) * (y - {0})) / (var_pop(y) * count(y))"


def _scores(model: str, source: str, p: str = "p", digits: int = 6) -> str:
    return f"SELECT '{model}' AS model, count(*) AS n, {ra(f'sqrt({_MSE.format(p)})', 'rmse', digits)}, {ra(_R2.format(p), 'r2', digits)} FROM {source}"


def _split(spark, folder):
    rows = split_groups(classed(spark, folder)).persist()
    return part(rows, "train"), part(rows, "test")


def _forest(train):
    return fit(estimator("random_forest", FEATURES, **FOREST), train)


def _boosted(train):
    return fit(estimator("boosted", PAIR, **BOOSTED), train, ROW_KEYS)


_BOOSTED_TRAIN = f", fitted AS (SELECT * FROM train WHERE NOT {_HELD_OUT}), "


@query("m1_forest_fit", with_(_PARTS + ", " + _means("scored", "train", "test"), _scores("random_forest", "scored")))
def _(spark, folder):
    train, test = _split(spark, folder)
    scored = scoring.predict(_forest(train), test)
    return fix(metrics.regression_metrics(scored, "label", {"random_forest": "prediction"}, metrics=("rmse", "r2")), 6)


@query(
    "m2_forest_uncertainty",
    with_(_PARTS + ", " + _means("scored", "train", "test"), f"SELECT {', '.join(ROW_KEYS)}, {ra('p', 'prediction', 6)}, 0.0::DOUBLE AS uncertainty FROM scored"),
)
def _(spark, folder):
    train, test = _split(spark, folder)
    return fix(scoring.predict_with_std(_forest(train), test).select(*ROW_KEYS, "prediction", "uncertainty"), 6)


def _folded(name: str, folds: int, cte, source: str, fold: str = "gh") -> str:
    """CTEs of one model per fold, each scored on its own fold, and their union."""
    parts = [
        f"train{i} AS (SELECT * FROM {source} WHERE {fold} % {folds} <> {i}), test{i} AS (SELECT * FROM {source} WHERE {fold} % {folds} = {i}), {cte(i)}"
        for i in range(folds)
    ]
    return ", ".join(parts) + f", {name} AS (" + " UNION ALL ".join(f"SELECT {i} AS fold, * FROM scored{i}" for i in range(folds)) + ")"


_SEARCHED = {"max_depth": [5, 6], "min_samples_leaf": [1, 10**9], "n_estimators": [2, 4]}


def _searched_sql() -> str:
    """Leaves of one row at least: the means; of more rows than there are: the mean of all."""
    ctes = _folded("scored", 2, lambda i: _means(f"scored{i}", f"train{i}", f"(SELECT *, (SELECT avg(y) FROM train{i}) AS base FROM test{i})"), "train")
    sets = " UNION ALL ".join(
        f"SELECT $${chosen}$$ AS parameters, {r('avg(mse)' if chosen['min_samples_leaf'] == 1 else 'avg(base_mse)', 6)} AS mse FROM folds"
        for chosen in validation.parameter_sets(_SEARCHED, 4))
    return with_(f"{_PARTS}, {ctes}, folds AS (SELECT {_MSE.format('p')} AS mse, {_MSE.format('base')} AS base_mse FROM scored GROUP BY fold)", sets)


@query("m3_forest_search", _searched_sql())
def _(spark, folder):
    train, _ = _split(spark, folder)
    pipeline = estimator("random_forest", FEATURES, bootstrap=False, max_features="all")
    return fix(validation.search(pipeline, train, _SEARCHED, n=4, folds=2)[1], 6)


@query("m4_boosted_fit", with_(_PARTS + _BOOSTED_TRAIN + _stumps("scored", "fitted", "test"), _scores("boosted", "scored", "p2")))
def _(spark, folder):
    train, test = _split(spark, folder)
    scored = scoring.predict(_boosted(train), test)
    return fix(metrics.regression_metrics(scored, "label", {"boosted": "prediction"}, metrics=("rmse", "r2")), 6)


_HISTORY_SQL = with_(
    _PARTS + _BOOSTED_TRAIN + _stumps("scored", "fitted", "train") + ", " + ", ".join(
        f"{name} AS (SELECT " + ", ".join(f"{_MSE.format(p)} AS l_{p}, {_R2.format(p)} AS r_{p}" for p in ("p1", "p2")) + f" FROM scored WHERE {which})"
        for name, which in (("fit_rows", f"NOT {_HELD_OUT}"), ("val_rows", _HELD_OUT))),
    " UNION ALL ".join(
        f"SELECT {epoch}::INTEGER AS epoch, {ra(f'f.l_{p}', 'train_loss', 6)}, {ra(f'f.r_{p}', 'train_r2', 6)}, {ra(f'v.l_{p}', 'val_loss', 6)}, {ra(f'v.r_{p}', 'val_r2', 6)} FROM fit_rows f, val_rows v"
        for epoch, p in enumerate(("p1", "p2"))))


@query("m4_training_history", _HISTORY_SQL)
def _(spark, folder):
    train, _ = _split(spark, folder)
    flagged = train.withColumn(VALIDATION_FLAG, validation_flag(ROW_KEYS))
    return fix(reports.training_curve(scoring.training_history(_boosted(train), flagged)), 6)


@query("r12_model_history", _HISTORY_SQL)
def _(spark, folder):
    """The training curve from the table that a fit has written."""
    train, _ = _split(spark, folder)
    path = f"{scratch(spark)}/boosted"
    records.write_records(_boosted(train), train.withColumn(VALIDATION_FLAG, validation_flag(ROW_KEYS)), path)
    return fix(reports.training_curve(records.read_record(spark, path, records.HISTORY)), 6)


_MEMBERS = {"epochs": 1, "max_depth": 2}
_ENSEMBLE = ", ".join(
    f"member{i} AS (SELECT bulky, reduced, avg(y) AS p{i} FROM train WHERE NOT {_HELD_OUT} AND {_HASH.format(_LINE, 43 + i)} < {int(0.7 * 2**52)} GROUP BY bulky, reduced)" for i in range(3)
) + ", joined AS (SELECT *, (p0 + p1 + p2) / 3 AS p FROM test JOIN member0 USING (bulky, reduced) JOIN member1 USING (bulky, reduced) JOIN member2 USING (bulky, reduced)), " \
    "scored AS (SELECT *, sqrt(((p0 - p) ** 2 + (p1 - p) ** 2 + (p2 - p) ** 2) / 3) AS s FROM joined)"


@query(
    "m5_ensemble_uncertainty",
    with_(f"{_PARTS}, {_ENSEMBLE}", f"SELECT {', '.join(ROW_KEYS)}, {ra('p', 'prediction', 6)}, {ra('s', 'uncertainty', 6)} FROM scored"),
)
def _(spark, folder):
    train, test = _split(spark, folder)
    models = scoring.fit_ensemble("boosted", train, PAIR, ROW_KEYS, size=3, **_MEMBERS)
    return fix(scoring.ensemble_predict(models, test).select(*ROW_KEYS, "prediction", "uncertainty"), 6)


_GRID = {"epochs": [1, 2], "learning_rate": [0.1, 0.3]}


def _grid_sql() -> str:
    ctes = _folded("scored", 2, lambda i: _stumps(f"scored{i}", f"train{i}", f"test{i}", 1.0), "train")

    def mse(chosen: dict) -> str:
        # p2 - p1 is what the second round adds at a rate of 1
        return _MSE.format("p1" if chosen["epochs"] == 1 else f"(p1 + {chosen['learning_rate']} * (p2 - p1))")

    sets = " UNION ALL ".join(
        f"SELECT $${chosen}$$ AS parameters, {r('avg(mse)', 6)} AS mse FROM (SELECT {mse(chosen)} AS mse FROM scored GROUP BY fold)" for chosen in validation.parameter_sets(_GRID))
    return with_(f"{_PARTS}, {ctes}", sets)


@query("m6_boosted_search", _grid_sql())
def _(spark, folder):
    train, _ = _split(spark, folder)
    pipeline = estimator("boosted", PAIR, max_depth=1, early_stopping=False)
    return fix(validation.search(pipeline, train, _GRID, folds=2)[1], 6)


def _importance_sql() -> str:
    """The first split by the input that explains more; below it both sides split by the other."""
    inside = {f: f"(SELECT sum(n * v) FROM (SELECT count(*) AS n, var_pop(y) AS v FROM train GROUP BY {f}))" for f in (*PAIR, ", ".join(PAIR))}
    ctes = (f"sums AS (SELECT (SELECT count(*) * var_pop(y) FROM train) AS whole, {inside[PAIR[0]]} AS by0, {inside[PAIR[1]]} AS by1, {inside[', '.join(PAIR)]} AS by_both), "
            "gains AS (SELECT whole - least(by0, by1) AS first, least(by0, by1) - by_both AS second, by0 < by1 AS zero FROM sums)")
    return with_(f"{_PARTS}, {ctes}",
                 f"SELECT '{PAIR[0]}' AS feature, {ra('CASE WHEN zero THEN first ELSE second END / (first + second)', 'importance', 6)} FROM gains UNION ALL "
                 f"SELECT '{PAIR[1]}', {r('CASE WHEN zero THEN second ELSE first END / (first + second)', 6)} FROM gains")


def _shallow(train):
    return fit(estimator("random_forest", PAIR, **(FOREST | {"max_depth": 2})), train)


@query("m7_built_in_importance", _importance_sql())
def _(spark, folder):
    train, _ = _split(spark, folder)
    return fix(reports.top_importances(importance.built_in_importance(_shallow(train), train)), 6)


@query("t1_model_importances", _importance_sql())
def _(spark, folder):
    """The highest importances from the table that a fit has written."""
    train, _ = _split(spark, folder)
    path = f"{scratch(spark)}/forest"
    records.write_records(_shallow(train), train, path)
    return fix(reports.top_importances(records.read_record(spark, path, records.IMPORTANCES), 15), 6)


def _permutation_sql(repeats: int) -> str:
    order, using = ", ".join(ROW_KEYS), ", ".join(FEATURES)
    shift = ", ".join("(1 + " + _HASH.format(f"'repeat-{i}'", 42) + " % (n - 1))" for i in range(repeats))
    swapped = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, shift, o.y, " + ", ".join(f"{'d' if g == f else 'o'}.{g}" for g in FEATURES) + " FROM shifted o JOIN numbered d ON d.place = (o.place + o.shift) % o.n"
        for f in FEATURES)
    ctes = (f"means AS (SELECT {using}, avg(y) AS p FROM train GROUP BY {using}), "
            f"numbered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY h, {order}) - 1 AS place, count(*) OVER () AS n FROM test), "
            f"shifted AS (SELECT *, unnest([{shift}]) AS shift FROM numbered), swapped AS ({swapped}), "
            f"base AS (SELECT {_R2.format('p')} AS r2 FROM numbered JOIN means USING ({using})), "
            f"scored AS (SELECT feature, shift, {_R2.format('p')} AS r2 FROM swapped JOIN means USING ({using}) GROUP BY feature, shift)")
    return with_(f"{_PARTS}, {ctes}", f"SELECT feature, {ra('avg(base.r2 - scored.r2)', 'importance', 6)} FROM scored, base GROUP BY feature")


@query("m8_permutation_importance", _permutation_sql(3))
def _(spark, folder):
    train, test = _split(spark, folder)
    return fix(importance.permutation_importance(_forest(train), test, ROW_KEYS, n_repeats=3), 6)


@query(
    "m9_score_new_data",
    with_(f"{_PARTS}, {_ENSEMBLE}", f"SELECT {', '.join(ROW_KEYS)}, {ra('p', 'label_predicted', 4)}, {ra('s', 'label_uncertainty', 4)}, "
          f"CASE WHEN s > 0 THEN {r('abs(p - y) / s', 4)} END AS label_z_score FROM scored"),
)
def _(spark, folder):
    train, test = _split(spark, folder)
    models = scoring.fit_ensemble("boosted", train, PAIR, ROW_KEYS, size=3, **_MEMBERS)
    return fix(scoring.score_new_data(models, test, "label", with_uncertainty=True, with_quality=True).select(
        *ROW_KEYS, "label_predicted", "label_uncertainty", "label_z_score"), 4)


def _evaluated_sql(model: str, p: str) -> str:
    ranked = (f"(SELECT *, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry, "
              f"rank() OVER (ORDER BY {p}) + (count(*) OVER (PARTITION BY {p}) - 1) / 2.0::DOUBLE AS rp FROM {model}_scored)")
    summed = (f"SELECT count(*) AS n, sqrt({_MSE.format(p)}) AS rmse, avg(abs(y - {p})) AS mae, {_R2.format(p)} AS r2, corr(y, {p}) AS pearson, corr(ry, rp) AS spearman FROM {ranked}")
    return (f"SELECT '{model}' AS model, n, {ra('rmse', 'rmse', 6)}, {ra('mae', 'mae', 6)}, {ra('r2', 'r2', 6)}, {ra('pearson', 'pearson_correlation', 6)}, "
            f"{ra(p_value_sql('pearson', 'n'), 'pearson_p_value', 6)}, {ra('spearman', 'spearman_correlation', 6)}, {ra(p_value_sql('spearman', 'n'), 'spearman_p_value', 6)}, "
            f"{ra('rmse', 'root_mean_square_absolute_error', 6)} FROM ({summed})")


@query(
    "m10_evaluate_models",
    with_(_PARTS + ", " + _means("random_forest_scored", "train", "test") + _BOOSTED_TRAIN + _stumps("boosted_scored", "fitted", "test"),
          _evaluated_sql("random_forest", "p") + " UNION ALL " + _evaluated_sql("boosted", "p2")),
)
def _(spark, folder):
    train, test = _split(spark, folder)
    models = {"random_forest": _forest(train), "boosted": _boosted(train)}
    return fix(scoring.evaluate_models(models, test, n_features=len(FEATURES))[0], 6)


@query(
    "m11_fit_conditions",
    with_(RESULTS + ", rows AS (SELECT shipyear, actual / 1000 AS y, l_quantity AS x FROM results WHERE shipyear BETWEEN 1995 AND 2001), "
          "fitted AS (SELECT shipyear, regr_slope(y, x) AS slope, regr_intercept(y, x) AS base FROM rows GROUP BY 1), "
          "scored AS (SELECT shipyear, y, base + slope * x AS p FROM rows JOIN fitted USING (shipyear))",
          f"SELECT shipyear, 'linear' AS model, count(*) AS n, {ra('sqrt(avg((y - p) * (y - p)))', 'rmse', 5)}, "
          f"{ra('1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y))', 'r2', 5)} FROM scored GROUP BY 1"),
)
def _(spark, folder):
    rows = labelled(spark, folder).persist()
    years = list(range(1995, 2002))

    def fit_year(year):
        return fit(estimator("linear", ["l_quantity"]), rows.filter(F.col("shipyear") == year))

    fitted, _ = scoring.fit_conditions(fit_year, years)
    scored = [
        scoring.predict(model, rows.filter(F.col("shipyear") == year)) for year, model in fitted.items()
    ]
    tested = metrics.regression_metrics(
        union_tables(scored), "label", {"linear": "prediction"}, by=["shipyear"], metrics=("rmse", "r2"))
    return fix(tested, 5)


@query(
    "m11_failed_condition",
    with_(RESULTS, "SELECT y AS shipyear, (SELECT count(*) FROM results WHERE shipyear = y) > 0 AS fitted FROM (VALUES (1900), (1995)) AS t(y)"),
)
def _(spark, folder):
    """A condition without rows fails and is reported; the other goes on."""
    rows = labelled(spark, folder)

    def fit_year(year):
        return fit(estimator("linear", ["l_quantity"]), rows.filter(F.col("shipyear") == year))

    fitted, failed = scoring.fit_conditions(fit_year, [1900, 1995])
    return spark.createDataFrame([(y, True) for y in fitted] + [(y, False) for y in failed], "shipyear int, fitted boolean")


_LINE_FIT = (
    "moments AS (SELECT avg(y) AS my, avg(bulky) AS m1, avg(reduced) AS m2, covar_pop(bulky, y) AS c1, covar_pop(reduced, y) AS c2, "
    "covar_pop(bulky, reduced) AS c12, var_pop(bulky) AS v1, var_pop(reduced) AS v2 FROM train), "
    "slopes AS (SELECT *, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS b1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS b2 FROM moments), "
    "lined AS (SELECT y, my + b1 * (bulky - m1) + b2 * (reduced - m2) AS p FROM test, slopes)"
)


@query(
    "m12_estimators",
    with_(_PARTS + ", " + _means("means", "train", "test", PAIR) + _BOOSTED_TRAIN + _stumps("stumps", "fitted", "test") + ", " + _LINE_FIT,
          " UNION ALL ".join([_scores("random_forest", "means"), _scores("boosted", "stumps", "p2"), _scores("linear", "lined")])),
)
def _(spark, folder):
    train, test = _split(spark, folder)
    scored = test
    small = {"random_forest": FOREST | {"n_estimators": 3, "max_depth": 3}, "boosted": BOOSTED, "linear": {}}
    for name, params in small.items():
        model = fit(estimator(name, PAIR, **params), train, ROW_KEYS)
        scored = scoring.predict(model, scored, f"{name}_predicted")
    return fix(metrics.regression_metrics(scored, "label", {n: f"{n}_predicted" for n in small}, metrics=("rmse", "r2")), 6)


@query("s11_saved_model", with_(RESULTS + ", " + _TESTED, "SELECT count(*) AS n, count(*) AS same FROM tested"))
def _(spark, folder):
    """A reloaded forest predicts what the fitted one does."""
    train, test = _split(spark, folder)
    model = _forest(train)
    loaded = load_model(save_model(model, f"{scratch(spark)}/forest"))
    both = scoring.predict(loaded, scoring.predict(model, test, "fitted"), "loaded")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("fitted") == F.col("loaded")).alias("same"))


_FITTED = (
    ", fitted AS (SELECT k, regr_slope(y, x) AS slope, regr_intercept(y, x) AS base FROM rows, (SELECT unnest(range(5)) AS k) "
    "WHERE fold <> k GROUP BY k), scored AS (SELECT fold, y, base + slope * x AS p FROM rows JOIN fitted ON fold = k)"
)
_FOLD_R2 = "1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y))"


@query(
    "a11_q_squared",
    with_(RESULTS + f", rows AS (SELECT CAST({_HASH.format(_LINE, 42)} % 5 AS INTEGER) AS fold, actual / 1000 AS y, l_quantity AS x FROM results)" + _FITTED,
          f"SELECT {ra('avg(r2)', 'q2', 6)} FROM (SELECT {_FOLD_R2} AS r2 FROM scored GROUP BY fold)"),
)
def _(spark, folder):
    rows = labelled(spark, folder)
    q2 = validation.q_squared(rows, ["l_quantity"], ROW_KEYS)
    return fix(spark.createDataFrame([(q2,)], "q2 double"), 6)


@query(
    "a11_q2_in_metrics",
    with_(_PARTS + ", " + _means("scored", "train", "test") + ", rows2 AS (SELECT h % 5 AS fold, y, bulky AS x FROM test)"
          + _FITTED.replace("FROM rows", "FROM rows2").replace(", fitted", ", slopes").replace("JOIN fitted", "JOIN slopes").replace("scored", "lined")
          + f", folds AS (SELECT {_FOLD_R2} AS r2 FROM lined GROUP BY fold)",
          _scores("random_forest", "scored").replace("FROM scored", f", (SELECT {r('avg(r2)', 6)} FROM folds) AS q2 FROM scored")),
)
def _(spark, folder):
    train, test = _split(spark, folder)
    found, _ = scoring.evaluate_models({"random_forest": _forest(train)}, test, metrics=("rmse", "r2", "q2"), features=["bulky"], keys=ROW_KEYS)
    return fix(found, 6)


_FOLD_METRICS = {
    "rmse": "sqrt(avg((y - p) * (y - p)))", "mae": "avg(abs(y - p))", "r2": _FOLD_R2, "pearson_correlation": "corr(y, p)",
}


@query(
    "a13_cross_validation",
    with_(RESULTS + ", placed AS (SELECT domain_id, CAST((row_number() OVER (ORDER BY " + _GROUP_HASH
          + ", domain_id) - 1) % 5 AS INTEGER) AS fold FROM (SELECT DISTINCT domain_id FROM results)), "
          "rows AS (SELECT fold, actual / 1000 AS y, l_quantity AS x FROM results JOIN placed USING (domain_id))" + _FITTED
          + ", folds AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _FOLD_METRICS.items()) + " FROM scored GROUP BY fold)",
          " UNION ALL ".join(f"SELECT '{n}' AS metric, {ra(f'avg({n})', 'mean', 6)}, {ra(f'stddev_pop({n})', 'std', 6)} FROM folds" for n in _FOLD_METRICS)),
)
def _(spark, folder):
    rows = labelled(spark, folder).persist()
    summary, _ = validation.cross_validate(lambda: estimator("linear", ["l_quantity"]), rows, keys=ROW_KEYS)
    return fix(summary, 6)


_FOREST_FOLDS = _folded("scored", 3, lambda i: _means(f"scored{i}", f"train{i}", f"test{i}"), "numbered", "place")


@query(
    "a13_cross_validated_forest",
    with_(_ROWS + f", numbered AS (SELECT * FROM rows JOIN ({_PLACES}) USING (domain_id)), {_FOREST_FOLDS}, "
          "folds AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _FOLD_METRICS.items()) + ", 0.0::DOUBLE AS uncertainty_std FROM scored GROUP BY fold)",
          " UNION ALL ".join(f"SELECT '{n}' AS metric, {ra(f'avg({n})', 'mean', 6)}, {ra(f'stddev_pop({n})', 'std', 6)} FROM folds" for n in (*_FOLD_METRICS, "uncertainty_std"))),
)
def _(spark, folder):
    rows = classed(spark, folder).persist()
    build = lambda: estimator("random_forest", FEATURES, **(FOREST | {"n_estimators": 4}))
    return fix(validation.cross_validate(build, rows, folds=3, keys=ROW_KEYS)[0], 6)
