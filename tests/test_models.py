import datetime as dt
import random

import numpy as np
import pytest

from cohortide.models import estimators as est
from cohortide.models.prepare import (PCA_COLUMNS, minmax_pipeline, split, split_three,
                                      vector_columns, vectors)
from cohortide.params import COHORT_KEY, SESSION_AVERAGES, TARGET
from cohortide.plans import model_selection, scoring
from cohortide.sources.tables import read_params, write_params
from micro import PARAMS

FEATURES = list(PARAMS.feature_columns)


@pytest.fixture(scope="module")
def wide(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        x = [float(rng.randrange(50)) for _ in FEATURES]
        x[0] = x[0] if i % 7 else 0.0
        target = 0.3 * x[0] + 0.1 * x[3] + rng.random()
        rows.append((dt.date(2018, 7, 1) + dt.timedelta(i % 60), f"s{i % 5}", "IOS", f"c{i}",
                     target, *x))
    names = [*COHORT_KEY, TARGET, *FEATURES]
    types = ["date", "string", "string", "string"] + ["double"] * (1 + len(FEATURES))
    schema = ", ".join(f"{n} {t}" for n, t in zip(names, types))
    return spark.createDataFrame(rows, schema).cache()


def matrix(df):
    return np.array([[r[c] for c in FEATURES] for r in df.collect()])


def test_split_does_not_move_with_the_partitioning(wide):
    train, test = split(wide)
    again, _ = split(wide.repartition(11))
    assert sorted(map(repr, train.collect())) == sorted(map(repr, again.collect()))
    assert train.count() + test.count() == 300 and 200 < train.count() < 280


def test_ridge_solves_the_penalised_normal_equations(wide):
    train, test = split(vectors(wide, PARAMS))
    model = est.linear("ridge", reg_param=2.0).fit(train)
    x, y = matrix(train), np.array([r[TARGET] for r in train.collect()])
    xc, yc = x - x.mean(0), y - y.mean()
    # The label is divided by its deviation while fitting, and so is the penalty.
    penalty = 2.0 / y.std(ddof=1) * np.eye(x.shape[1])
    w = np.linalg.solve(xc.T @ xc / len(y) + penalty, xc.T @ yc / len(y))
    assert np.allclose(model.coefficients.toArray(), w, rtol=1e-4, atol=1e-6)
    scores = dict((m, s) for m, _, s in model_selection.evaluate({"ridge": model}, test, "test"))
    base = est.rmse_table(est.baseline(train, test)).collect()[0].rmse
    assert scores["ridge"] < base
    rmse = est.rmse_evaluator().evaluate(est.baseline(train, test))
    assert base == pytest.approx(rmse)


def test_models_beat_the_mean(wide):
    train, test = model_selection.training_parts(wide, PARAMS)
    table = {(r.model, r.part): r.rmse
             for r in model_selection.compare_default_models(train, test).collect()}
    assert len(table) == 14
    for name in ("decision_tree", "random_forest", "chosen_forest"):
        assert table[(name, "test")] < table[("baseline", "test")]


def test_minmax(wide):
    scaled = minmax_pipeline(PARAMS).fit(wide).transform(wide)
    got = np.array([[r[c] for c in FEATURES] for r in vector_columns(
        scaled.select("features"), "features", FEATURES).collect()])
    x = matrix(wide)
    assert np.allclose(got, (x - x.min(0)) / (x.max(0) - x.min(0)))


def test_cross_validation_lists_and_refits(spark, wide):
    train, _ = split(wide)
    search, best = model_selection.tune("decision_tree", train, PARAMS,
                                        {"maxDepth": [1, 3, 5]}, folds=3)
    results = est.cv_results(spark, search)
    rows = results.orderBy("grid_index").collect()
    assert [r.settings["maxDepth"] for r in rows] == [1.0, 3.0, 5.0]
    top = min(rows, key=lambda r: r.rmse)
    assert best.getOrDefault("maxDepth") == top.settings["maxDepth"]
    near = sorted(r.grid_index for r in est.around_best(results).collect())
    assert near == [i for i in range(3) if abs(i - top.grid_index) <= 1]
    assert {r["name"] for r in est.settings_table(spark, best).collect()} >= {"maxBins", "seed"}


def test_components_match_a_direct_decomposition(wide):
    model, pca, train, test = model_selection.pca_tree(wide, PARAMS)
    metrics = list(PARAMS.metric_columns)
    x = np.array([[r[c] for c in metrics] for r in wide.collect()])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    values, vecs = np.linalg.eigh(np.cov(x.T))
    top = vecs[:, np.argsort(values)[::-1][:4]]
    rows = train.unionByName(test).collect()
    got = {r.country: [r[c] for c in PCA_COLUMNS] for r in rows}
    for row, want in zip(wide.collect(), np.abs(x @ top)):
        assert np.allclose(np.abs(got[row.country]), want, atol=1e-8)
    assert model.numFeatures == len(SESSION_AVERAGES) + 4
    assert np.allclose(pca.stages[-1].explainedVariance, sorted(values)[::-1][:4] / values.sum())


def test_forest_round_trip_checks_the_feature_order(spark, wide, tmp_path):
    model = est.forest(maxDepth=3, numTrees=5).fit(vectors(wide, PARAMS))
    path = str(tmp_path / "model")
    est.save_forest(model, path, PARAMS)
    loaded = est.load_forest(spark, path, PARAMS)
    assert loaded.getNumTrees == 5
    with pytest.raises(ValueError):
        est.load_forest(spark, path, PARAMS.but(metrics=PARAMS.metrics[::-1]))


def test_each_request_gets_its_cohorts_prediction(spark, wide):
    model = est.forest(maxDepth=3, numTrees=5).fit(vectors(wide, PARAMS))
    key = [tuple(r[c] for c in COHORT_KEY) for r in wide.limit(20).collect()]
    asked = [(f"q{i}", *key[i % 20]) for i in range(50)] + [
        ("none", dt.date(2000, 1, 1), "s1", "IOS", "c1")]
    requests = spark.createDataFrame(
        asked, "request_id string, first_touch_date date, traffic_source string, os string, "
               "country string")
    one = {tuple(r[c] for c in COHORT_KEY): r.prediction
           for r in scoring.score_cohorts(wide, model, PARAMS).collect()}
    got = {r.request_id: r.predicted_ltv
           for r in scoring.score_requests(requests, wide, model, PARAMS).collect()}
    assert got == {q: one.get(tuple(k)) for q, *k in asked}
    known = scoring.request_features(requests, wide).where("known").count()
    assert known == 50
    mean = scoring.predict(wide, model, PARAMS).collect()[0].predicted_ltv
    assert mean == pytest.approx(np.mean(list(one.values())))


def test_params_file(spark, tmp_path):
    path = str(tmp_path / "params")
    write_params(spark, est.CHOSEN_FOREST, path)
    assert read_params(spark, path) == est.CHOSEN_FOREST


def test_three_parts_cover_all_rows_once(wide):
    parts = [{tuple(r) for r in p.select(*COHORT_KEY).collect()} for p in split_three(wide)]
    assert len(set.union(*parts)) == sum(map(len, parts)) == wide.count()
    assert all(parts)
