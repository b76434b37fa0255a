"""The registered queries: each runs over the whole driver tables of one scale folder."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.ml.feature import PCA
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortide.functions.time import utc_day
from cohortide.models import estimators as est, ledger, paths, search
from cohortide.models.prepare import (PCA_COLUMNS, assembler, l2_normalized, minmax_pipeline,
                                      split, split_three, stable_bucket, vector_columns, vectors,
                                      with_fold)
from cohortide.operators import activity, event_metrics, features, quality, revenue
from cohortide.operators import session_metrics, timeline
from cohortide.params import COHORT_KEY, SESSION_AVERAGES, TARGET, CohortRequest
from cohortide.plans import cohort_queries, feature_build, model_selection, scoring
from cohortide.plans import sql as cohort_sql
from cohortide.session import materialize, pin_utc, scratch_path
from cohortide.sources import messages as msg, tables
from cohortide.sources.events import (CUSTOMER, NATION, TABLE_PARAMS as P, events_from_tables,
                                      read_day_shards, read_events, table, write_day_shards)
from cohortide.streaming import routing, state
from cohortide.streaming.loop import LoopPaths, start_loop

POOLED = P.but(cross_user_gaps=True)
ONE_COHORT = CohortRequest(dt.date(2024, 1, 1), "FURNITURE", "IOS", "NATION_20")
METRICS = P.metric_names


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, so that both engines hash the same type."""
    return df.withColumns({n: F.col(n).cast("double")
                           for n, t in df.dtypes if t.startswith("decimal")})


def wide(spark: SparkSession, folder: str) -> DataFrame:
    return feature_build.wide_features(events_from_tables(spark, folder), P)


def stored_wide(spark: SparkSession, folder: str) -> DataFrame:
    return materialize(wide(spark, folder), "wide")


def on_events(operator, params=P):
    return lambda spark, folder: plain(operator(events_from_tables(spark, folder), params))


def on_event_rows(operator):
    return on_events(lambda e, p: operator(event_metrics.event_session_metrics(e, p), p))


def bucket_completion(spark, folder):
    rows = event_metrics.event_session_metrics(events_from_tables(spark, folder), P)
    done = event_metrics.complete_buckets(materialize(rows, "event-rows"), P)
    return plain(done.select(*COHORT_KEY, "user_pseudo_id", "user_session_id", "activity_day",
                             "d_cat", *METRICS))


def on_wide(operator):
    return lambda spark, folder: plain(operator(wide(spark, folder)))


def active_days(spark, folder):
    return activity.active_days(events_from_tables(spark, folder))


def first_touch(spark, folder):
    return activity.first_touch(events_from_tables(spark, folder))


def explode_params(spark, folder):
    return timeline.explode_params(events_from_tables(spark, folder), ("view", "purchase"),
                                   ("k", "screen"))


def sessionize(spark, folder):
    return timeline.sessionize(events_from_tables(spark, folder), P).drop("event_params")


def features_joined(params):
    return on_events(feature_build.joined_features, params)


def features_from_timeline(spark, folder):
    """The three queries from one stored timeline, joined."""
    stored = timeline.store_timeline(events_from_tables(spark, folder), P)
    return plain(features.join_features(
        *[cohort_queries.QUERIES[n](stored, P) for n in ("ltv", "event", "session")], P))


def filtered(name):
    def run(spark, folder):
        return plain(cohort_queries.QUERIES[name](events_from_tables(spark, folder), P, ONE_COHORT))
    return run


def dq_profile(spark, folder):
    """The profile that is observed while the feature table is written."""
    return feature_build.store_profiled(events_from_tables(spark, folder), P)[1]


def dq_profile_of_table(spark, folder):
    """The same by a pass over the rows."""
    rows = features.unfilled_features(events_from_tables(spark, folder), P)
    return quality.dq_profile(rows)


def database(spark, label):
    space = f"{label}_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {space} LOCATION '{scratch_path(spark, space)}'")
    return space


def features_from_buckets(spark, folder):
    """The three stored tables, dealt to buckets by the cohort key, and joined without a shuffle."""
    space = database(spark, "buckets")
    feature_build.store_cohort_tables(events_from_tables(spark, folder), P, space)
    return plain(feature_build.features_of_tables(spark, space, P))


def log_days(events):
    """Days that the log has, in order."""
    day = utc_day(F.col("event_timestamp")).alias("day")
    return [r.day for r in events.select(day).distinct().orderBy("day").collect()]


def features_incremental(spark, folder):
    """Features from a timeline table built in four steps, the last of which gives a day again."""
    events = events_from_tables(spark, folder)
    path, days = scratch_path(spark, "timeline"), log_days(events)
    third = -(-len(days) // 3)
    steps = [days[i:i + third] for i in range(0, len(days), third)]
    # One day comes with half of its events first, and whole afterwards.
    late = days[len(days) // 2]
    part = events.where((utc_day(F.col("event_timestamp")) != F.lit(late)) | (F.col("event_timestamp") % 2 == 0))
    for own in steps:
        timeline.update_timeline(part, P, path, own)
    timeline.update_timeline(events, P, path, [late])
    return plain(features.fused_features(timeline.read_timeline(spark, path, P), P))


def sql_cohorts(job):
    """A cohort query called by SQL text with named arguments, over variables set by SQL."""
    def run(spark, folder):
        events = events_from_tables(spark, folder)
        cohort_sql.declare(spark, P.but(gap_minutes=30))
        spark.sql("SET VAR gap_minutes = :minutes", args={"minutes": P.gap_minutes})
        params = cohort_sql.variables(spark, P)
        cohort_sql.register(spark, timeline.store_timeline(events, params), params)
        text = (f"SELECT * FROM {job}_data(country_name => :country, os_name => :os, "
                "source => :source, day => :day)")
        args = {"day": ONE_COHORT.date, "source": ONE_COHORT.traffic_source, "os": ONE_COHORT.os,
                "country": ONE_COHORT.country}
        return plain(spark.sql(text, args=args))
    return run


def minmax_scaled(spark, folder):
    rows = stored_wide(spark, folder)
    scaled = minmax_pipeline(P).fit(rows).transform(rows)
    out = vector_columns(scaled.select(*COHORT_KEY, "features"), "features", P.feature_columns)
    return out.select(*COHORT_KEY, *[F.round(c, 9).alias(c) for c in P.feature_columns])


def l2(spark, folder):
    rows = l2_normalized(wide(spark, folder), P.metric_columns)
    out = vector_columns(rows.select(*COHORT_KEY, "norm_features"), "norm_features",
                         P.metric_columns)
    return out.select(*COHORT_KEY, *[F.round(c, 9).alias(c) for c in P.metric_columns])


def train_test_split(spark, folder):
    part = F.when(stable_bucket(COHORT_KEY, 143, 100) < 80, "train").otherwise("test")
    return wide(spark, folder).select(*COHORT_KEY, TARGET, part.alias("part"))


def baseline_rmse(spark, folder):
    train, test = split(stored_wide(spark, folder))
    mean = train.agg(F.avg(TARGET)).scalar()
    return est.rmse_table(est.baseline(train, test)).select(
        F.round(mean, 9).alias("target_avg"), F.round("rmse", 9).alias("rmse"),
        F.col("rows").alias("test_rows"))


def table_roundtrip(spark, folder):
    rows = session_metrics.session_cohort_metrics(events_from_tables(spark, folder), P)
    path = scratch_path(spark, "session-table")
    tables.write_table(rows, "session_data", fmt="parquet", options={"path": path}, mode="error")
    return spark.read.schema(rows.schema).parquet(path)


def stored_features(form):
    """Both feature tables saved to the catalog; one of them read back by name."""
    def run(spark, folder):
        space = database(spark, "features")
        feature_build.store_features(events_from_tables(spark, folder), P, namespace=space)
        return plain(tables.read_table(spark, form, space))
    return run


def day_shards(spark, folder):
    root = scratch_path(spark, "shards")
    events_from_tables(spark, folder).withColumn("event_date", utc_day(F.col("event_timestamp"))) \
        .repartition("event_date").write.partitionBy("event_date").parquet(root)
    return root


def by_day(events):
    return events.groupBy(utc_day(F.col("event_timestamp")).alias("activity_day")).agg(
        F.count(F.lit(1)).alias("n_events"), F.countDistinct("user_pseudo_id").alias("n_users"))


def event_shards(spark, folder):
    """The log written by day, and all its shards read by a glob."""
    return by_day(read_events(spark, f"{day_shards(spark, folder)}/event_date=*"))


def event_shards_pruned(spark, folder):
    """The same, of the days of one week; the others' files are not opened."""
    return by_day(read_events(spark, day_shards(spark, folder), since="2024-01-08",
                              until="2024-01-14"))


def suffix_shards(spark, folder):
    """The log as ``events_YYYYMMDD`` shards, of which those of one week are read."""
    events = events_from_tables(spark, folder)
    prefix = f"{scratch_path(spark, 'day-shards')}/events_"
    write_day_shards(events, prefix, [d for d in log_days(events)
                                      if dt.date(2024, 1, 5) <= d <= dt.date(2024, 1, 20)])
    rows = read_day_shards(spark, prefix, dt.date(2024, 1, 8), dt.date(2024, 1, 14), day_column="shard")
    return rows.groupBy(F.col("shard").alias("activity_day")).agg(
        F.count(F.lit(1)).alias("n_events"), F.countDistinct("user_pseudo_id").alias("n_users"))


def in_order(name):
    """A cohort query sorted for presentation."""
    return on_events(lambda e, p: cohort_queries.QUERIES[name](e, p, ordered=True))


# --- models -------------------------------------------------------------------------------------
# Every tuning query searches its whole stored grid over ten folds; the forest's grid is dealt to
# three queries by the number of trees.

def parts(spark, folder):
    return model_selection.training_parts(wide(spark, folder), P)


def default_models(spark, folder):
    return model_selection.compare_default_models(*parts(spark, folder))


def linear_cv(spark, folder):
    """Every stored grid of the linear models over ten folds, from one pass over the rows; the best
    point of each is fitted again by MLlib and scored on the test part."""
    train, test = parts(spark, folder)
    out = []
    for name, (kind, grid) in LINEAR_GRIDS.items():
        results = search.search_linear(kind, train, P, grid)
        best = search.refit(kind, search.best_point(results), train)
        scores = model_selection.evaluate({name: best}, test, "test")
        out.append((name, float(results.agg(F.min("rmse")).first()[0]), scores[0][2]))
    return spark.createDataFrame(out, "model string, cv_rmse double, test_rmse double")


LINEAR_GRIDS = {"lasso": ("lasso", est.LASSO_GRID), "ridge": ("ridge", est.RIDGE_GRID),
                "ridge_second": ("ridge", est.RIDGE_SECOND_GRID),
                "elastic_net": ("elastic_net", est.ELASTIC_GRID)}


def searched(spark, folder, kind, grid):
    """Scores of the grid on the training part, through the session's ledger, and both parts."""
    train, test = parts(spark, folder)
    rows = search.fold_rows(train, P)
    return search.search(kind, rows, P, grid, ledger.TrialLedger(spark)), train, test


def tree_cv(spark, folder):
    """The whole grid over ten folds; one fit scores all eight depths, so 160 fits."""
    return searched(spark, folder, "decision_tree", est.TREE_GRID)[0]


def cv_neighbours(spark, folder):
    train, _ = parts(spark, folder)
    return est.around_best(search.search_linear("lasso", train, P, est.LASSO_GRID))


def forest_cv(trees):
    """All points of the stored grid with that many trees over ten folds: 960 fits. The queries of
    20, 50 and 100 trees together search the whole grid."""
    def run(spark, folder):
        grid = est.FOREST_GRID | {"numTrees": [trees]}
        results, train, test = searched(spark, folder, "random_forest", grid)
        best = search.refit("random_forest", search.best_point(results), train)
        scores = model_selection.evaluate({"random_forest": best}, test, "test")
        return results.withColumn("test_rmse", F.lit(scores[0][2]))
    return run


def best_params(spark, folder):
    """The settings that win on the whole grid of the tree, stored and read back."""
    results, train, _ = searched(spark, folder, "decision_tree", est.TREE_GRID)
    model = search.refit("decision_tree", search.best_point(results), train)
    path = scratch_path(spark, "best-params")
    tables.write_params(spark, est.settings_of(model), path)
    stored = tables.read_params(spark, path)
    return spark.createDataFrame([(k, str(v)) for k, v in sorted(stored.items())],
                                 "name string, value string")


def tuned_scores(spark, folder):
    """RMSE of the winners of all searches but the forest's on train, test and hold-out part, and of
    the stored tree, which is loaded for it."""
    train, test, holdout = [vectors(r, P) for r in split_three(stored_wide(spark, folder))]
    models = {}
    for name, (kind, grid) in LINEAR_GRIDS.items():
        models[name] = search.refit(kind, search.best_point(search.search_linear(kind, train, P, grid)), train)
    results = search.search("decision_tree", search.fold_rows(train, P), P, est.TREE_GRID,
                            ledger.TrialLedger(spark))
    path = scratch_path(spark, "tree")
    est.save_model(search.refit("decision_tree", search.best_point(results), train), path, P)
    models["decision_tree"] = est.load_model(spark, path, P)
    scores = [row for part, rows in (("train", train), ("test", test), ("holdout", holdout))
              for row in model_selection.evaluate(models, rows, part)]
    return spark.createDataFrame(scores, "model string, part string, rmse double")


def path_scores(spark, folder, points):
    """Mean RMSE over ten folds of linear models on one feature; SQL can say the same."""
    train, _ = split(stored_wide(spark, folder))
    moments = paths.fold_moments(with_fold(train, 10), [SESSION_AVERAGES[0]], 10)
    return [(*point, round(s, 6)) for point, (s, _) in zip(points, paths.cross_validated(moments, points))]


def ridge_path(spark, folder):
    points = [(reg, 0.0) for reg in est.RIDGE_GRID["regParam"]]
    return spark.createDataFrame([(reg, s) for reg, _, s in path_scores(spark, folder, points)],
                                 "reg_param double, rmse double")


def elastic_path(spark, folder):
    """The whole grid of the elastic net, and the lasso, which is its other end."""
    points = [(reg, mix) for reg in est.ELASTIC_GRID["regParam"]
              for mix in (*est.ELASTIC_GRID["elasticNetParam"], 1.0)]
    return spark.createDataFrame(path_scores(spark, folder, points), "reg_param double, mix double, rmse double")


def path_neighbours(spark, folder):
    """The best penalty of the ridge path and its neighbours."""
    points = [(reg, 0.0) for reg in est.RIDGE_GRID["regParam"] + est.RIDGE_SECOND_GRID["regParam"][1:]]
    rows = [(i, reg, s) for i, (reg, _, s) in enumerate(path_scores(spark, folder, points))]
    return est.around_best(spark.createDataFrame(rows, "grid_index int, reg_param double, rmse double"))


def one_feature(spark, folder, feature):
    """The training part with one feature as its vector."""
    train, _ = split(stored_wide(spark, folder))
    return assembler([feature], "features").transform(train)


def stored_ridge(spark, folder):
    """Slope and intercept of a ridge that was saved and loaded."""
    model = est.linear("ridge", reg_param=2.0).fit(one_feature(spark, folder, SESSION_AVERAGES[0]))
    path = scratch_path(spark, "ridge")
    est.save_model(model, path, P)
    loaded = est.load_model(spark, path, P)
    return spark.createDataFrame(
        [(round(float(loaded.coefficients[0]), 6), round(float(loaded.intercept), 6))],
        "slope double, intercept double")


def tree_stump(spark, folder):
    """The split and the two means of a tree of one level on one feature, all thresholds allowed."""
    rows = one_feature(spark, folder, "session_claimed_ad_rewards_d_1")
    model = est.tree(maxDepth=1, maxBins=max(2, rows.count())).fit(rows)
    nodes = search.node_table(model, scratch_path(spark, "stump"))
    root = nodes.roots[0]
    return spark.createDataFrame(
        [(float(nodes.threshold[root]), *(round(float(nodes.prediction[k[root]]), 6) for k in (nodes.left, nodes.right)))],
        "threshold double, low_mean double, high_mean double")


def pca_two(spark, folder):
    """Shares of variance of two components of two features, which have a closed form."""
    rows = assembler(SESSION_AVERAGES, "pair").transform(stored_wide(spark, folder))
    model = PCA(k=2, inputCol="pair", outputCol="components").fit(rows)
    return spark.createDataFrame([tuple(round(float(v), 9) for v in model.explainedVariance)],
                                 "first double, second double")


def cv_folds(spark, folder):
    """Rows that each of the ten folds trains on and is scored on."""
    train, _ = split(wide(spark, folder))
    sizes = with_fold(train, 10).groupBy("fold").agg(F.count(F.lit(1)).alias("scored_rows"))
    total = train.agg(F.count(F.lit(1)).alias("n")).scalar()
    return sizes.select("fold", "scored_rows", (total - F.col("scored_rows")).alias("train_rows"))


def ridge_one_feature(spark, folder):
    """Slope and intercept of a ridge on one feature, which has a closed form."""
    train, _ = split(stored_wide(spark, folder))
    rows = assembler([SESSION_AVERAGES[0]], "features").transform(train)
    model = est.linear("ridge", reg_param=2.0).fit(rows)
    return spark.createDataFrame(
        [(round(float(model.coefficients[0]), 6), round(float(model.intercept), 6))],
        "slope double, intercept double")


def three_part_split(spark, folder):
    named = zip(("train", "test", "holdout"), split_three(wide(spark, folder)))
    out = [rows.select(*COHORT_KEY, TARGET, F.lit(name).alias("part")) for name, rows in named]
    return out[0].unionByName(out[1]).unionByName(out[2])


def holdout_scores(spark, folder):
    """RMSE of the mean, of every default model and of the chosen forest on three parts."""
    train, test, holdout = [vectors(r, P) for r in split_three(stored_wide(spark, folder))]
    return model_selection.compare_default_models(train.cache(), test, holdout)


def pca_tree_scores(spark, folder):
    """RMSE of the tree on session averages and principal components, on both parts."""
    model, _, train, test = model_selection.pca_tree(stored_wide(spark, folder), P)
    scores = [s for part, rows in (("train", train), ("test", test))
              for s in model_selection.evaluate({"pca_tree": model}, rows, part)]
    return spark.createDataFrame(scores, "model string, part string, rmse double")


def model_settings(spark, folder):
    train, _ = parts(spark, folder)
    return est.settings_table(spark, est.tree().fit(train))


def pca_components(spark, folder):
    rows = stored_wide(spark, folder)
    model, pca, train, test = model_selection.pca_tree(rows, P)
    explained = F.array(*[F.lit(float(v)) for v in pca.stages[-1].explainedVariance])
    return model.transform(train.unionByName(test)).select(
        *COHORT_KEY, *PCA_COLUMNS, "prediction", explained.alias("explained_variance"))


def fitted_forest(spark, rows):
    train, _ = split(rows)
    path = scratch_path(spark, "model")
    est.save_forest(est.forest(**est.CHOSEN_FOREST).fit(vectors(train, P).cache()), path, P)
    return est.load_forest(spark, path, P)


def forest_predictions(spark, folder):
    rows = stored_wide(spark, folder)
    return scoring.score_cohorts(rows, fitted_forest(spark, rows), P)


# --- requests and streams -----------------------------------------------------------------------

def requests(spark, folder):
    """One cohort request per customer."""
    pin_utc(spark)
    customer = table(spark, folder, "customer", CUSTOMER)
    nation = table(spark, folder, "nation", NATION)
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("r"), F.col("c_custkey").cast("string")).alias("request_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 4).cast("int"))
        .alias("first_touch_date"),
        F.col("c_mktsegment").alias("traffic_source"),
        F.when(F.col("c_custkey") % 2 == 0, "IOS").otherwise("ANDROID").alias("os"),
        F.col("n_name").alias("country"), "c_custkey", "c_acctbal", "c_name")


def request_features(spark, folder):
    asked = requests(spark, folder).select("request_id", *COHORT_KEY)
    return scoring.request_features(asked, wide(spark, folder)).select(
        "request_id", *COHORT_KEY, "known", TARGET, "avg_session_duration_sec")


def score_requests(spark, folder):
    rows = stored_wide(spark, folder)
    asked = requests(spark, folder).select("request_id", *COHORT_KEY)
    return scoring.score_requests(asked, rows, fitted_forest(spark, rows), P)


def requests_answered(spark, folder):
    """Which requests got a prediction: those of a known cohort."""
    return score_requests(spark, folder).select(
        "request_id", F.col("predicted_ltv").isNotNull().alias("answered"))


def prepared_requests(spark, folder):
    """All requests prepared together, and the features of their cohorts read from that."""
    root = scratch_path(spark, "prepared")
    scoring.prepare_requests(events_from_tables(spark, folder), P,
                             requests(spark, folder).select("request_id", *COHORT_KEY), root)
    return scoring.prepared_features(spark, root, P).select(
        "request_id", *COHORT_KEY, "known", TARGET, "avg_session_duration_sec")


def prepared_answers(spark, folder):
    """Which of the requests that were prepared together get a prediction."""
    root = scratch_path(spark, "prepared")
    scoring.prepare_requests(events_from_tables(spark, folder), P,
                             requests(spark, folder).select("request_id", *COHORT_KEY), root)
    model = fitted_forest(spark, stored_wide(spark, folder))
    return scoring.predict_requests(spark, root, model, P).select(
        "request_id", F.col("predicted_ltv").isNotNull().alias("answered"))


def csv_roundtrip(spark, folder):
    """A number stored as a request's prediction and read back."""
    root = scratch_path(spark, "csv")
    mean = wide(spark, folder).agg(F.round(F.avg(TARGET), 6).alias("predicted_ltv"))
    tables.write_prediction(mean, root, "r0")
    return tables.read_prediction(spark, root, "r0")


def request_folder(job):
    """One of the three tables of a request's folder, read back."""
    def run(spark, folder):
        root = scratch_path(spark, "requests")
        scoring.prepare_request(events_from_tables(spark, folder), P, ONE_COHORT, root, "r0")
        return plain(tables.read_request_tables(spark, root, "r0")[job])
    return run


def prediction_csv_roundtrip(spark, folder):
    """One cohort through the request folder: three tables, prediction as CSV, done message."""
    events = events_from_tables(spark, folder)
    root = scratch_path(spark, "requests")
    scoring.prepare_request(events, P, ONE_COHORT, root, "r0")
    model = fitted_forest(spark, stored_wide(spark, folder))
    return scoring.predict_request(spark, root, "r0", model, P)


def customer_messages(spark, folder):
    """One message per customer: requests (some that also carry another key), predict and done
    messages, and text that is no message at all."""
    r = requests(spark, folder)
    data = F.struct("country", F.date_format("first_touch_date", "yyyy-MM-dd").alias("date"),
                    "os", "traffic_source").alias("input_data")
    ident = F.col("request_id")
    body = {
        0: F.to_json(F.struct(data, ident)),
        1: F.to_json(F.struct(ident.alias("bucket_folder_id"))),
        2: F.to_json(F.struct(ident.alias("data_id"), F.col("c_acctbal").alias("predicted_ltv"))),
        3: F.to_json(F.struct(ident.alias("data_id"), data, ident)),
    }
    value = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(
        F.to_json(F.struct(F.col("c_name").alias("note"))))
    for kind, text in body.items():
        value = F.when(F.col("c_custkey") % 5 == kind, text).otherwise(value)
    return msg.envelopes(r.withColumn("value", value), "any", "c_custkey")


def run_stream(spark, source, handler, checkpoint):
    query = (msg.read_files(spark, source).writeStream.foreachBatch(handler)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def stream_route(spark, folder):
    source, out = scratch_path(spark, "messages"), scratch_path(spark, "routed")
    customer_messages(spark, folder).write.json(source)

    def store(batch, batch_id):
        routing.route(batch).select(
            "kind", "id", F.when(F.col("kind") == "done", F.col("m.predicted_ltv"))
            .alias("predicted_ltv")).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    run_stream(spark, source, store, scratch_path(spark, "progress"))
    return spark.read.schema("kind string, id string, predicted_ltv double, batch_id long").parquet(
        out).drop("batch_id")


def two_rounds(spark, folder, compacted=False):
    """The state folder after two rounds of messages through one resumed stream; the second
    updates some fields. The first may be folded to a generation in between."""
    source, root = scratch_path(spark, "messages"), scratch_path(spark, "state")
    progress = scratch_path(spark, "progress")

    def store(batch, batch_id):
        state.append_updates(state.updates_of(routing.route(batch)), root, batch_id)

    first = customer_messages(spark, folder)
    first.write.json(f"{source}/first")
    run_stream(spark, source, store, progress)
    if compacted:
        state.compact(spark, root, 0)
    routed = routing.route(first)
    done = F.struct(F.col("id").alias("data_id"),
                    F.when(F.col("kind") == "done", F.col("m.predicted_ltv") + 1)
                    .otherwise(0.25).alias("predicted_ltv"))
    second = routed.where(F.col("kind").isin("predict", "done")).withColumn(
        "value", F.to_json(done)).withColumn("position", F.col("offset") + 1000000000)
    msg.envelopes(second, "any", "position").write.json(f"{source}/second")
    run_stream(spark, source, store, progress)
    return root


def stream_latest_state(spark, folder):
    root = two_rounds(spark, folder, compacted=True)
    return state.latest_state(state.read_updates(spark, root))


def stream_ingest(spark, folder):
    """Requests that come without an id through a stream, twice; a replay gives the same ids."""
    source, out = scratch_path(spark, "asked"), scratch_path(spark, "ingested")
    asked = requests(spark, folder)
    data = F.struct("country", F.date_format("first_touch_date", "yyyy-MM-dd").alias("date"),
                    "os", "traffic_source").alias("input_data")
    msg.envelopes(asked.withColumn("value", F.to_json(F.struct(data))), msg.APP_REQUEST, "c_custkey"
                  ).write.json(source)

    def store(batch, batch_id):
        routing.ingest(batch).write.mode("append").parquet(out)

    for _ in range(2):
        run_stream(spark, source, store, scratch_path(spark, "progress"))
    return spark.read.parquet(out).select("request_id", *COHORT_KEY, "value").distinct()


def stream_lookup(spark, folder):
    """What the state holds of one id, rounded for display."""
    return state.lookup(spark, two_rounds(spark, folder), "r2")


def request_messages(spark, folder):
    """One request message per customer. Its position, and so its time, does not depend on the partitions of
    the table: ids are kept for a time, and numbers by partition are two hours of it apart."""
    asked = routing.request_message(requests(spark, folder), "c_custkey")
    return msg.envelopes(asked, msg.APP_REQUEST, "c_custkey")


def stream_score(spark, folder):
    """The whole loop: requests are announced, scored and answered over three resumed runs."""
    rows = stored_wide(spark, folder)
    model = fitted_forest(spark, rows)
    source = scratch_path(spark, "messages")
    request_messages(spark, folder).write.json(f"{source}/requests")
    paths = LoopPaths(*[scratch_path(spark, n) for n in
                        ("state", "rejected", "progress")])
    for _ in msg.TOPICS:
        start_loop(msg.read_files(spark, source), rows, model, P, paths, msg.file_sink(source),
                   availableNow=True).awaitTermination()
    return state.latest_state(state.read_updates(spark, paths.state))


def stream_answers(spark, folder):
    """Which requests the loop answered with a prediction: those of a known cohort."""
    return stream_score(spark, folder).select(
        "id", "bucket_folder_id", F.col("prediction").isNotNull().alias("answered"))


def queries():
    return {
        "active_days": active_days,
        "first_touch": first_touch,
        "daily_activity": on_events(activity.daily_activity),
        "explode_params": explode_params,
        "sessionize": sessionize,
        "session_durations": on_events(session_metrics.session_durations),
        "session_cohort_metrics": on_events(session_metrics.session_cohort_metrics),
        "event_session_metrics": on_events(event_metrics.event_session_metrics),
        "event_session_metrics_corrected": on_events(event_metrics.event_session_metrics,
                                                     P.but(corrected_metrics=True)),
        "bucket_presence": on_event_rows(event_metrics.bucket_presence),
        "bucket_completion": bucket_completion,
        "event_bucket_pivot": on_event_rows(event_metrics.event_bucket_pivot),
        "revenue_daily": on_events(revenue.revenue_daily),
        "revenue_daily_pooled": on_events(revenue.revenue_daily, POOLED),
        "cohort_ltv": on_events(revenue.cohort_ltv),
        "cohort_ltv_pooled": on_events(revenue.cohort_ltv, POOLED),
        "cohort_ltv_dedup": on_events(lambda e, p: revenue.dedupe_ltv(revenue.cohort_ltv(e, p))),
        "features_wide": on_events(feature_build.wide_features),
        "features_wide_joined": features_joined(P),
        "features_from_timeline": features_from_timeline,
        "features_wide_pooled": on_events(feature_build.wide_features, POOLED),
        "features_long": on_wide(lambda w: features.to_long(w, P)),
        "cohort_filtered_session": filtered("session"),
        "cohort_filtered_event": filtered("event"),
        "cohort_filtered_ltv": filtered("ltv"),
        "duplicate_cohorts": on_events(
            lambda e, p: quality.duplicate_cohorts(revenue.cohort_ltv(e, p))),
        "features_from_buckets": features_from_buckets,
        "features_incremental": features_incremental,
        "sql_session": sql_cohorts("session"),
        "sql_event": sql_cohorts("event"),
        "sql_ltv": sql_cohorts("ltv"),
        "dq_profile": dq_profile,
        "dq_profile_of_table": dq_profile_of_table,
        "counts_by_traffic_source": on_wide(lambda w: quality.counts_by(w, "traffic_source")),
        "counts_by_os": on_wide(lambda w: quality.counts_by(w, "os")),
        "preview": on_wide(lambda w: quality.preview(w, 3, COHORT_KEY)),
        "minmax_scaled": minmax_scaled,
        "l2_normalized": l2,
        "train_test_split": train_test_split,
        "baseline_rmse": baseline_rmse,
        "table_roundtrip": table_roundtrip,
        "stored_features": stored_features("processed_data"),
        "stored_features_long": stored_features("processed_data_long"),
        "event_shards": event_shards,
        "event_shards_pruned": event_shards_pruned,
        "suffix_shards": suffix_shards,
        "cohort_event_ordered": in_order("event"),
        "cohort_ltv_ordered": in_order("ltv"),
        "default_models": default_models,
        "cv_folds": cv_folds,
        "ridge_one_feature": ridge_one_feature,
        "ridge_path": ridge_path,
        "elastic_path": elastic_path,
        "path_neighbours": path_neighbours,
        "stored_ridge": stored_ridge,
        "tree_stump": tree_stump,
        "pca_two": pca_two,
        "three_part_split": three_part_split,
        "holdout_scores": holdout_scores,
        "pca_tree_scores": pca_tree_scores,
        "model_settings": model_settings,
        "pca_components": pca_components,
        "forest_predictions": forest_predictions,
        "request_features": request_features,
        "score_requests": score_requests,
        "requests_answered": requests_answered,
        "prepared_requests": prepared_requests,
        "prepared_answers": prepared_answers,
        "csv_roundtrip": csv_roundtrip,
        "request_folder_session": request_folder("session"),
        "request_folder_event": request_folder("event"),
        "request_folder_ltv": request_folder("ltv"),
        "prediction_csv_roundtrip": prediction_csv_roundtrip,
        "stream_route": stream_route,
        "stream_latest_state": stream_latest_state,
        "stream_lookup": stream_lookup,
        "stream_ingest": stream_ingest,
        "stream_score": stream_score,
        "stream_answers": stream_answers,
    }


def tuning_queries():
    """The searches of whole grids. Each takes minutes, so they are listed after all others."""
    return {
        "linear_cv": linear_cv,
        "tree_cv": tree_cv,
        "forest_cv": forest_cv(20),
        "forest_cv_50": forest_cv(50),
        "forest_cv_100": forest_cv(100),
        "cv_neighbours": cv_neighbours,
        "best_params": best_params,
        "tuned_scores": tuned_scores,
    }
