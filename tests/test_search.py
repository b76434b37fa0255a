"""Searches through a ledger, depths of one tree, and paths from sums of products."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortide.models import estimators as est, paths, search
from cohortide.models.ledger import TrialLedger, settings_key, study_of
from cohortide.models.prepare import split, vectors, with_fold
from cohortide.params import COHORT_KEY, TARGET
from cohortide.plans import model_selection
from micro import PARAMS

FEATURES = list(PARAMS.feature_columns)


@pytest.fixture(scope="module")
def train(spark):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        x = [float(rng.randrange(40)) for _ in FEATURES]
        x[2] = 0.0  # a feature without spread
        target = 0.5 * x[0] - 0.2 * x[3] + (5 if x[1] > 20 else 0) + rng.gauss(0, 2)
        rows.append((dt.date(2018, 7, 1) + dt.timedelta(i % 60), f"s{i % 5}", "IOS", f"c{i}", target, *x))
    names = [*COHORT_KEY, TARGET, *FEATURES]
    types = ["date", "string", "string", "string"] + ["double"] * (1 + len(FEATURES))
    wide = spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in zip(names, types)))
    return split(wide)[0].cache()


@pytest.fixture(scope="module")
def rows(train):
    return search.fold_rows(train, PARAMS, 4)


class Killed(Exception):
    pass


def test_a_killed_search_goes_on_where_it_stopped(spark, rows, tmp_path, monkeypatch):
    grid = {"maxDepth": [2, 3], "numTrees": [2, 3], "minInstancesPerNode": [1, 10]}
    ledger = TrialLedger(spark, str(tmp_path / "ledger"))
    study = study_of(rows, PARAMS.feature_columns, 4, search.MODEL_SEED, False)
    monkeypatch.setattr(search, "FLUSH", 4)

    def stop(done):
        if done == 13:
            raise Killed

    with pytest.raises(Killed):
        search.search("random_forest", rows, PARAMS, grid, ledger, 4, 2, after=stop, nested=False)
    finished = ledger.finished(study, "random_forest")
    assert len(finished) == 12
    fits = []
    got = search.search("random_forest", rows, PARAMS, grid, ledger, 4, 2, after=fits.append, nested=False).collect()
    assert len(fits) == 32 - 12 and len(ledger.finished(study, "random_forest")) == 32
    again = []
    assert search.search("random_forest", rows, PARAMS, grid, ledger, 4, after=again.append,
                         nested=False).collect() == got
    assert not again
    # Another ledger and another order of work, the same scores.
    other = TrialLedger(spark, str(tmp_path / "other"))
    fresh = search.search("random_forest", rows, PARAMS, grid, other, 4, 3, nested=False).collect()
    assert [r.rmse for r in fresh] == pytest.approx([r.rmse for r in got])
    assert [r.settings for r in got][:2] == [
        {"maxDepth": 2.0, "numTrees": 2.0, "minInstancesPerNode": 1.0},
        {"maxDepth": 2.0, "numTrees": 2.0, "minInstancesPerNode": 10.0}]


def test_a_search_scores_as_cross_validation_does(spark, train, rows, tmp_path):
    grid = {"maxDepth": [2, 4], "numTrees": [3]}
    model, _ = model_selection.tune("random_forest", train, PARAMS, grid, folds=4)
    got = search.search("random_forest", rows, PARAMS, grid, TrialLedger(spark, str(tmp_path / "l")), 4).collect()
    # Sampling of rows follows the partitions, which differ, so the scores are near but not equal.
    assert [r.rmse for r in got] == pytest.approx(model.avgMetrics, rel=0.2)
    linear = search.search("ridge", rows, PARAMS, est.RIDGE_GRID, TrialLedger(spark, str(tmp_path / "l")), 4)
    want, _ = model_selection.tune("ridge", train, PARAMS, est.RIDGE_GRID, folds=4)
    assert [r.rmse for r in linear.collect()] == pytest.approx(want.avgMetrics, rel=1e-6)


def test_other_rows_are_another_study(rows):
    name = study_of(rows, "a")
    assert name == study_of(rows.repartition(5), "a")
    assert len({name, study_of(rows, "b"), study_of(rows.where("fold > 0"), "a"),
                study_of(rows.withColumn(TARGET, F.col(TARGET) + 1), "a")}) == 4
    assert settings_key({"b": 1, "a": 2.0}) == settings_key({"a": 2, "b": 1.0})


def test_one_tree_scores_all_depths(spark, rows, tmp_path):
    depths = list(range(2, 10))
    for least in (1, 10, 50):
        held, rest = rows.where("fold = 0"), rows.where("fold <> 0")
        deep = est.tree(maxDepth=9, minInstancesPerNode=least, maxBins=16).fit(rest)
        got = search.score_depths(deep, held, depths)
        for depth, own in zip(depths, got):
            alone = est.tree(maxDepth=depth, minInstancesPerNode=least, maxBins=16).fit(rest)
            assert own == pytest.approx(search.score(alone, held))
    grid = {"maxBins": [8, 16], "maxDepth": [2, 5], "minInstancesPerNode": [1, 10]}
    fits = []
    got = search.search("decision_tree", rows, PARAMS, grid, TrialLedger(spark, str(tmp_path / "l")), 4,
                        after=fits.append).collect()
    assert len(got) == 8 and len(fits) == 4 * 4 and all(r.rmse > 0 for r in got)
    assert search.score_depths(est.tree(maxDepth=2).fit(rows), rows.limit(0), [1, 2]) == [(0.0, 0)] * 2


def test_a_forest_is_cut_at_every_depth(spark, rows, tmp_path):
    held, rest = rows.where("fold = 0"), rows.where("fold <> 0")
    forest = est.forest(maxDepth=6, numTrees=8).fit(rest)
    got = search.score_depths(forest, held, [0, 3, 6, 9])
    assert got[2] == pytest.approx(search.score(forest, held)) and got[3] == got[2]
    # Uncut trees predict what they do in MLlib; cut at the root, every row gets the mean of the roots.
    nodes = search.node_table(forest, str(tmp_path / "nodes"))
    roots = np.mean(nodes.prediction[nodes.roots])
    error = [(r[TARGET] - roots) ** 2 for r in held.collect()]
    assert got[0] == pytest.approx((np.mean(error) ** 0.5, len(error)))
    grid = {"maxBins": [8, 16], "maxDepth": [2, 4, 6], "numTrees": [3, 5]}
    fits, ledger = [], TrialLedger(spark, str(tmp_path / "l"))
    results = search.search("random_forest", rows, PARAMS, grid, ledger, 4, after=fits.append).collect()
    assert len(results) == 12 and len(fits) == 4 * 4 and all(r.rmse > 0 for r in results)
    # Near to what separate fits score, with other draws.
    alone = search.search("random_forest", rows, PARAMS, grid, ledger, 4, nested=False).collect()
    assert [r.rmse for r in results] == pytest.approx([r.rmse for r in alone], rel=0.15)


def test_paths_equal_every_fit(spark, train):
    folds = with_fold(train, 4)
    moments = paths.fold_moments(folds.repartition(5), FEATURES, 4)
    assert [m.rows for m in moments] == [folds.where(f"fold = {k}").count() for k in range(4)]
    whole = paths.Moments(np.sum([m.table for m in moments], axis=0))
    data = vectors(train, PARAMS)
    for mix in (0.0, 0.3, 0.5, 0.9, 1.0):
        found = paths.path(whole, est.RIDGE_GRID["regParam"], mix)
        for reg in est.RIDGE_GRID["regParam"]:
            model = est.linear("ridge").copy().setElasticNetParam(mix).setRegParam(reg).setTol(1e-10).fit(data)
            w, b = found[reg]
            assert np.allclose(w, model.coefficients.toArray(), atol=2e-4), (mix, reg)
            assert b == pytest.approx(model.intercept, abs=1e-2)
            error = data.select(F.lit(b).alias("b"), TARGET, *FEATURES).collect()
            want = np.sqrt(np.mean([(r[TARGET] - b - np.dot(w, [r[c] for c in FEATURES])) ** 2 for r in error]))
            assert whole.rmse(w, b) == pytest.approx(want)


def test_features_that_hang_together_settle_in_few_sweeps(monkeypatch):
    monkeypatch.setattr(paths, "MAX_SWEEPS", 100)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 1)) + 0.01 * rng.normal(size=(400, 12))
    x = np.column_stack([x, x[:, 0], 1000 * x[:, 1] + rng.normal(size=400)])
    y = x[:, :5] @ np.array([3.0, -2.0, 1.0, 0.0, 4.0]) + rng.normal(size=400)
    z = np.column_stack([np.ones(400), x, y])
    moments = paths.Moments(z.T @ z)
    gram, cross, _, deviation = moments.centred()
    for mix in (0.1, 0.5, 1.0):
        for reg, (w, _) in paths.path(moments, [0.001, 0.01, 0.1, 1.0], mix).items():
            slope = cross - gram @ w - (1 - mix) * reg / deviation * w
            off = np.where(w != 0, np.abs(slope - mix * reg * np.sign(w)), np.abs(slope) - mix * reg)
            assert (off <= 1e-8 * np.sqrt(np.diag(gram))).all(), (mix, reg)


def test_linear_search_scores_as_cross_validation_does(spark, train):
    for kind, grid in (("lasso", est.LASSO_GRID), ("elastic_net", {"regParam": [0.1, 5.0], "elasticNetParam": [0.1, 0.9]})):
        got = search.search_linear(kind, train, PARAMS, grid, 4).collect()
        want, _ = model_selection.tune(kind, train, PARAMS, grid, folds=4)
        assert [r.rmse for r in got] == pytest.approx(want.avgMetrics, rel=1e-4)
    best = search.best_point(spark.createDataFrame(got))
    assert best == min(got, key=lambda r: r.rmse).settings
    assert search.refit("elastic_net", best, vectors(train, PARAMS)).getOrDefault("regParam") == best["regParam"]


def test_models_are_stored_with_their_kind(spark, train, tmp_path):
    data = vectors(train, PARAMS)
    for name, model in (("tree", est.tree(maxDepth=3).fit(data)), ("line", est.linear("ridge").fit(data))):
        path = str(tmp_path / name)
        est.save_model(model, path, PARAMS)
        loaded = est.load_model(spark, path, PARAMS)
        assert type(loaded) is type(model)
        assert loaded.transform(data).select("prediction").collect() == model.transform(data).select(
            "prediction").collect()
        with pytest.raises(ValueError):
            est.load_model(spark, path, PARAMS.but(metrics=PARAMS.metrics[::-1]))
