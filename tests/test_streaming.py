import datetime as dt
import itertools
import json

import pandas as pd
import pytest

from checks import registry
from cohortide.models import estimators as est
from cohortide.models.prepare import vectors
from cohortide.operators.features import fused_features
from cohortide.operators.timeline import store_timeline
from cohortide.params import COHORT_KEY, CohortRequest
from cohortide.plans import scoring
from cohortide.plans.cohort_queries import QUERIES
from cohortide.plans.feature_build import store_features
from cohortide.sources import files, messages as msg, tables
from cohortide.streaming import loop, routing, state
from cohortide.streaming.loop import LoopPaths, remember, start_loop
from micro import PARAMS, frame, random_events

INPUT = {"country": "Cyprus", "date": "2018-07-01", "os": "IOS", "traffic_source": "cpc"}


def batch(spark, values):
    rows = [("t", 0, i, dt.datetime(2018, 7, 1, 0, i // 60, i % 60), v) for i, v in enumerate(values)]
    return spark.createDataFrame(
        rows, "topic string, partition int, offset long, timestamp timestamp, value string")


@pytest.mark.parametrize("value, kind, ident", [
    (json.dumps({"request_id": "r", "input_data": INPUT}), "request", "r"),
    (json.dumps({"bucket_folder_id": "b"}), "predict", "b"),
    (json.dumps({"data_id": "d", "predicted_ltv": 1.5}), "done", "d"),
    (json.dumps({"data_id": "d", "predicted_ltv": None}), "done", "d"),
    (json.dumps({"data_id": "d", "request_id": "r", "input_data": INPUT}), "request", "r"),
    (json.dumps({"data_id": "d", "bucket_folder_id": "b"}), "predict", "b"),
    (json.dumps({"request_id": "r"}), "rejected", None),
    (json.dumps({"request_id": "r", "input_data": {}}), "rejected", None),
    (json.dumps({"request_id": "r", "input_data": {**INPUT, "date": "soon"}}), "rejected", None),
    (json.dumps({"request_id": "r", "input_data": {**INPUT, "os": None}}), "rejected", None),
    (json.dumps({"data_id": "d"}), "rejected", None),
    (json.dumps({"data_id": "d", "predicted_ltv": "abc"}), "rejected", None),
    (json.dumps({"data_id": "d", "predicted_ltv": {"a": 1}}), "rejected", None),
    (json.dumps({"request_id": None, "data_id": "d"}), "rejected", None),
    (json.dumps({"other": 1}), "rejected", None),
    ("not json", "rejected", None), ("[1]", "rejected", None), (None, "rejected", None)])
def test_routing(spark, value, kind, ident):
    row = routing.route(batch(spark, [value])).collect()[0]
    assert (row.kind, row.id) == (kind, ident)


def test_messages_round_trip(spark):
    rows = routing.requests_of(routing.route(batch(
        spark, [json.dumps({"request_id": "r", "input_data": INPUT})])))
    assert rows.collect()[0].first_touch_date == dt.date(2018, 7, 1)
    text = routing.request_message(rows).collect()[0].value
    assert json.loads(text) == {"request_id": "r", "input_data": INPUT}
    fresh = rows.withColumn("request_id", rows.request_id.substr(9, 1)).selectExpr(
        "nullif(request_id, '') request_id", *COHORT_KEY)
    assert len(json.loads(routing.request_message(fresh).collect()[0].value)["request_id"]) == 36


def test_positions_of_requests_do_not_depend_on_partitions(spark, tmp_path):
    # By partition they would be hours apart, and ids are kept for a time.
    one = "/root/testdata/sf0.001"
    spark.read.parquet(f"{one}/customer.parquet").repartition(5).write.parquet(f"{tmp_path}/customer.parquet")
    spark.read.parquet(f"{one}/nation.parquet").write.parquet(f"{tmp_path}/nation.parquet")
    got = sorted(map(tuple, registry.request_messages(spark, str(tmp_path)).collect()))
    assert got == sorted(map(tuple, registry.request_messages(spark, one).collect())) and len(got) > 100


def test_state_keeps_the_last_value_of_each_field_and_survives_a_replay(spark, tmp_path):
    root = str(tmp_path / "state")
    first = batch(spark, ['{"bucket_folder_id": "x"}', '{"data_id": "x", "predicted_ltv": 1.0}',
                          '{"data_id": "x", "predicted_ltv": 2.0}'])
    second = batch(spark, ['{"data_id": "y", "predicted_ltv": 3.456}',
                           '{"bucket_folder_id": "x"}'])
    for _ in range(2):
        for number, rows in enumerate((first, second)):
            state.append_updates(state.updates_of(routing.route(rows)), root, number)
        assert state.read_updates(spark, root).count() == 5
        got = {r.id: (r.bucket_folder_id, r.prediction)
               for r in state.latest_state(state.read_updates(spark, root)).collect()}
        assert got == {"x": ("x", 2.0), "y": (None, 3.456)}
    assert state.lookup(spark, root, "y").collect()[0].prediction == 3.46
    assert state.lookup(spark, root, "unknown").count() == 0
    folded = state.compact(spark, root, 1)
    again = state.latest_state(state.read_updates(spark, folded)).collect()
    assert {r.id: (r.bucket_folder_id, r.prediction) for r in again} == got


def state_of(spark, root):
    return {r.id: (r.bucket_folder_id, r.prediction)
            for r in state.latest_state(state.read_updates(spark, root)).collect()}


def done(spark, root, number, **values):
    rows = batch(spark, [json.dumps({"data_id": k, "predicted_ltv": v}) for k, v in values.items()])
    state.append_updates(state.updates_of(routing.route(rows)), root, number)


def test_generations_replace_the_history(spark, tmp_path):
    root = str(tmp_path / "state")
    done(spark, root, 0, x=1.0, y=1.0)
    done(spark, root, 1, x=2.0)
    before = state.read_updates(spark, root)
    state.compact(spark, root, 1)
    now = state.manifest(spark, root)
    assert (now.generation, now.upto) == (1, 1)
    assert state.read_updates(spark, root).count() == 2  # one row per id
    assert before.count() == 3  # a reader of the old manifest goes on
    done(spark, root, 1, x=2.0)  # a replay of a folded batch changes nothing
    done(spark, root, 2, y=5.0, z=7.0)
    assert state_of(spark, root) == {"x": (None, 2.0), "y": (None, 5.0), "z": (None, 7.0)}
    state.compact(spark, root, 1)  # nothing new to fold
    assert state.manifest(spark, root).generation == 1
    state.compact(spark, root, 2)
    assert state_of(spark, root) == {"x": (None, 2.0), "y": (None, 5.0), "z": (None, 7.0)}
    assert files.names(spark, f"{root}/updates") == ["batch_id=2"]
    done(spark, root, 3, x=9.0)
    state.compact(spark, root, 3)
    assert files.names(spark, f"{root}/generations") == ["2", "3"]
    assert state_of(spark, root)["x"] == (None, 9.0)


def test_only_one_of_two_compactions_is_published(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "state")
    done(spark, root, 0, x=1.0)
    seen = state.manifest(spark, root)
    state.compact(spark, root, 0)
    monkeypatch.setattr(state, "manifest", lambda *_: seen)
    state.compact(spark, root, 0)  # one that has read the manifest before the other published
    monkeypatch.undo()
    assert state.manifest(spark, root).version == 1 and state_of(spark, root) == {"x": (None, 1.0)}
    assert files.names(spark, f"{root}/generations") == ["1"]


def test_a_lookup_opens_the_files_of_one_bucket(spark, tmp_path):
    root = str(tmp_path / "state")
    for number in range(3):
        done(spark, root, number, **{f"k{i}": float(i + number) for i in range(200)})
    state.compact(spark, root, 1)
    found = state.lookup(spark, root, "k7")
    assert [tuple(r) for r in found.collect()] == [("k7", None, 9.0)]
    opened = found.inputFiles()
    assert 0 < len(opened) <= 2 and len({f.split("bucket=")[1].split("/")[0] for f in opened}) == 1
    assert len(state.read_updates(spark, root).inputFiles()) > 20


def test_ids_come_from_the_position(spark):
    rows = batch(spark, [json.dumps({"input_data": INPUT}), json.dumps({"input_data": INPUT}),
                         json.dumps({"input_data": INPUT, "request_id": "own"}), "noise", None])
    first = sorted(map(tuple, routing.ingest(rows).select("request_id", "offset").collect()))
    again = sorted(map(tuple, routing.ingest(rows.repartition(3)).select("request_id", "offset").collect()))
    assert first == again and len(first) == 2 and first[0][0] != first[1][0]
    assert all(len(ident) == 36 for ident, _ in first)
    routed = routing.route(routing.ingest(rows))
    assert {r.kind for r in routed.collect()} == {"request"}


@pytest.fixture(scope="module")
def fitted(spark):
    events = frame(spark, random_events(9, 900)).cache()
    wide = fused_features(events, PARAMS).cache()
    return events, wide, est.forest(maxDepth=3, numTrees=5).fit(vectors(wide, PARAMS))


def test_the_loop_answers_every_request(spark, fitted, tmp_path):
    _, wide, model = fitted
    cohorts = wide.select(*COHORT_KEY).where("country <> 'Rest of the World'").collect()
    values = [json.dumps({"request_id": f"r{i}", "input_data": {
        "country": c.country, "date": str(c.first_touch_date), "os": c.os,
        "traffic_source": c.traffic_source}}) for i, c in enumerate(cohorts)]
    unknown = json.dumps({"request_id": "lost", "input_data": {**INPUT, "country": "Nowhere"}})
    source = str(tmp_path / "messages")
    batch(spark, [*values, unknown, "noise"]).write.json(f"{source}/in")
    paths = LoopPaths(*[str(tmp_path / n) for n in ("state", "rejected", "progress")])
    for _ in range(3):
        start_loop(msg.read_files(spark, source), wide, model, PARAMS, paths,
                   msg.file_sink(source), availableNow=True).awaitTermination()
    got = {r.id: (r.bucket_folder_id, r.prediction)
           for r in state.latest_state(state.read_updates(spark, paths.state)).collect()}
    one = {tuple(r[c] for c in COHORT_KEY): r.prediction
           for r in scoring.score_cohorts(wide, model, PARAMS).collect()}
    want = {f"r{i}": (f"r{i}", one[tuple(c)]) for i, c in enumerate(cohorts)}
    assert got == {**want, "lost": ("lost", None)}
    assert [r.value for r in spark.read.json(paths.rejected).collect()] == ["noise"]


def ask(ident, cohort):
    return json.dumps({"request_id": ident, "input_data": {
        "country": cohort.country, "date": str(cohort.first_touch_date), "os": cohort.os,
        "traffic_source": cohort.traffic_source}})


def run_loop(spark, fitted, source, root, sink=None, **how):
    _, wide, model = fitted
    paths = LoopPaths(*[f"{root}/{n}" for n in ("state", "rejected", "progress")])
    query = start_loop(msg.read_files(spark, source), wide, model, PARAMS, paths,
                       sink or (lambda rows, _: rows.write.mode("append").json(f"{root}/out")),
                       availableNow=True, **how)
    query.awaitTermination()
    return query


def test_a_batch_touches_its_own_ids_only(spark, fitted, tmp_path):
    _, wide, model = fitted
    cohorts = wide.select(*COHORT_KEY).where("country <> 'Rest of the World'").limit(3).collect()
    source, root = str(tmp_path / "messages"), str(tmp_path)
    batch(spark, [ask(f"r{i}", cohorts[i % 3]) for i in range(60)]).write.json(f"{source}/a")
    first = run_loop(spark, fitted, source, root)
    assert sum(s["numRowsTotal"] for s in first.lastProgress["stateOperators"]) == 60
    batch(spark, ['{"bucket_folder_id": "r5"}', '{"bucket_folder_id": "r7"}',
                  '{"bucket_folder_id": "unknown"}', '{"bucket_folder_id": "r5"}']).write.json(f"{source}/b")
    second = run_loop(spark, fitted, source, root)  # a restart: the registry is read from the checkpoint
    updated = sum(s["numRowsUpdated"] for s in second.lastProgress["stateOperators"])
    assert updated == 2 and sum(s["numRowsTotal"] for s in second.lastProgress["stateOperators"]) == 60
    answers = [json.loads(r.value) for r in spark.read.json(f"{root}/out").collect()
               if "data_id" in json.loads(r.value)]
    one = {tuple(r[c] for c in COHORT_KEY): r.prediction
           for r in scoring.score_cohorts(wide, model, PARAMS).collect()}
    assert sorted(answers, key=str) == sorted(
        [{"data_id": f"r{i}", "predicted_ltv": one[tuple(cohorts[i % 3])]} for i in (5, 7)]
        + [{"data_id": "unknown", "predicted_ltv": None}], key=str)


def test_a_request_of_two_cohorts_is_answered_by_their_mean(spark, fitted, tmp_path):
    _, wide, model = fitted
    a, b = wide.select(*COHORT_KEY).where("country <> 'Rest of the World'").limit(2).collect()
    source, root = str(tmp_path / "messages"), str(tmp_path)
    batch(spark, [ask("r", a), ask("r", b), ask("r", a), '{"bucket_folder_id": "r"}']).write.json(f"{source}/a")
    run_loop(spark, fitted, source, root)
    answers = [json.loads(r.value) for r in spark.read.json(f"{root}/out").collect()]
    one = {tuple(r[c] for c in COHORT_KEY): r.prediction
           for r in scoring.score_cohorts(wide, model, PARAMS).collect()}
    assert [m["predicted_ltv"] for m in answers if "data_id" in m] == [
        pytest.approx((one[tuple(a)] + one[tuple(b)]) / 2)]
    assert sum("bucket_folder_id" in m for m in answers) == 3


def test_the_registry_keeps_text_and_days_as_they_are(spark, fitted, tmp_path):
    # 2300 is beyond the instants that pandas can hold.
    odd = json.dumps({"request_id": 'r "\u00e9\n\\', "input_data": {**INPUT, "date": "2300-01-31"}})
    source, root = str(tmp_path / "messages"), str(tmp_path)
    batch(spark, [odd, json.dumps({"bucket_folder_id": 'r "\u00e9\n\\'})]).write.json(f"{source}/a")
    run_loop(spark, fitted, source, root)
    answers = [json.loads(r.value) for r in spark.read.json(f"{root}/out").collect()]
    assert sorted(answers, key=str) == [{"bucket_folder_id": 'r "\u00e9\n\\'},
                                        {"data_id": 'r "\u00e9\n\\', "predicted_ltv": None}]


def test_an_id_goes_through_the_registry_as_one_column():
    class Held:
        hasTimedOut = exists = False

        def update(self, value):
            self.cohorts = json.loads(value[0])

        def getCurrentWatermarkMs(self):
            return 0

        def setTimeoutTimestamp(self, millis):
            self.millis = millis

    row = {"id": "r", "kind": "request", "first_touch_date": "2018-07-01", "traffic_source": "cpc",
           "os": "IOS", "country": "Cyprus", "partition": 0, "offset": 1, "timestamp": 5, "millis": 7}
    asked = {"id": "r", "kind": "predict", "partition": 0, "offset": 0, "timestamp": 6, "millis": 8}
    held = Held()
    out, = remember()(("r",), iter([pd.DataFrame({"row": [json.dumps(asked), json.dumps(row)]})]), held)
    got = [json.loads(text) for text in out["row"]]
    assert list(out.columns) == ["row"] and [r["step"] for r in got] == ["announce", "score"]
    assert held.cohorts == [[row[c] for c in COHORT_KEY]] == [[got[1][c] for c in COHORT_KEY]]
    assert held.millis == 8


def test_ids_of_a_group_are_served_together_and_forgotten_one_by_one():
    class Held:
        hasTimedOut, exists, watermark, writes = False, False, 0, 0

        def update(self, value):
            self.get, self.exists, self.writes = value, True, self.writes + 1

        def remove(self):
            self.exists = False

        def getCurrentWatermarkMs(self):
            return self.watermark

        def setTimeoutTimestamp(self, millis):
            assert millis > self.watermark
            self.millis = millis

    def send(ident, kind, millis, country="Cyprus"):
        cohort = dict(zip(COHORT_KEY, ("2018-07-01", "cpc", "IOS", country))) if kind == "request" else {}
        return json.dumps({"id": ident, "kind": kind, "partition": 0, "offset": millis, "timestamp": millis,
                           "millis": millis} | cohort)

    def serve(*texts):
        frames = iter([pd.DataFrame({"row": [text]}) for text in texts])
        return [(row["step"], row["id"], row.get("country")) for frame in remember()((3,), frames, held)
                for row in map(json.loads, frame["row"])]

    held = Held()
    got = serve(send("a", "request", 5), send("a", "predict", 6), send("b", "request", 7, "Nowhere"),
                send("b", "request", 9), send("c", "predict", 8))
    assert sorted(got, key=str) == [("announce", "a", None), ("announce", "b", None), ("announce", "b", None),
                                    ("score", "a", "Cyprus"), ("score", "c", None)]
    assert held.millis == 6 and held.writes == 1
    assert serve(send("b", "predict", 12)) == [("score", "b", "Nowhere"), ("score", "b", "Cyprus")]
    assert serve(send("c", "predict", 30)) == [("score", "c", None)] and held.writes == 2
    held.watermark = 8  # "a" was last heard of at 6
    assert serve(send("b", "predict", 14), send("a", "request", 20, "Malta")) == [
        ("score", "b", "Nowhere"), ("score", "b", "Cyprus"), ("announce", "a", None)]
    held.watermark, held.hasTimedOut = 15, True
    assert serve() == [] and held.exists and held.millis == 20
    held.hasTimedOut = False
    assert serve(send("a", "predict", 20), send("b", "predict", 21)) == [
        ("score", "a", "Cyprus"), ("score", "a", "Malta"), ("score", "b", None)]
    held.watermark, held.hasTimedOut = 21, True
    assert serve() == [] and not held.exists


def test_many_ids_share_few_groups(spark, fitted, tmp_path, monkeypatch):
    monkeypatch.setattr(loop, "GROUPS", 4)
    _, wide, model = fitted
    cohorts = wide.select(*COHORT_KEY).where("country <> 'Rest of the World'").limit(3).collect()
    source, root = str(tmp_path / "messages"), str(tmp_path)
    batch(spark, [ask(f"r{i}", cohorts[i % 3]) for i in range(60)]).write.json(f"{source}/a")
    first = run_loop(spark, fitted, source, root)
    assert sum(s["numRowsTotal"] for s in first.lastProgress["stateOperators"]) == 4
    batch(spark, [json.dumps({"bucket_folder_id": f"r{i}"}) for i in range(80)]).write.json(f"{source}/b")
    run_loop(spark, fitted, source, root)  # a restart: the registry is read from the checkpoint
    answers = [json.loads(r.value) for r in spark.read.json(f"{root}/out").collect()]
    one = {tuple(r[c] for c in COHORT_KEY): r.prediction
           for r in scoring.score_cohorts(wide, model, PARAMS).collect()}
    assert sorted(m["bucket_folder_id"] for m in answers if "data_id" not in m) == sorted(f"r{i}" for i in range(60))
    assert {m["data_id"]: m["predicted_ltv"] for m in answers if "data_id" in m} == {
        f"r{i}": one[tuple(cohorts[i % 3])] if i < 60 else None for i in range(80)}
    assert len(answers) == 140


def test_unanswered_ids_expire(spark, fitted, tmp_path):
    _, wide, _ = fitted
    cohort = wide.select(*COHORT_KEY).where("country <> 'Rest of the World'").first()
    source, root = str(tmp_path / "messages"), str(tmp_path)
    batch(spark, [ask("old", cohort)]).write.json(f"{source}/a")
    first = run_loop(spark, fitted, source, root, keep_minutes=0.05)
    assert sum(s["numRowsTotal"] for s in first.lastProgress["stateOperators"]) == 1
    # Messages of the next five seconds; ids are kept for three.
    batch(spark, ['{"bucket_folder_id": "other"}'] * 6).write.json(f"{source}/b")
    later = run_loop(spark, fitted, source, root, keep_minutes=0.05)
    assert sum(s["numRowsTotal"] for s in later.lastProgress["stateOperators"]) == 0


def test_prepared_requests_are_stored_by_cohort_and_predicted_together(spark, fitted, tmp_path):
    events, wide, model = fitted
    some = wide.where("country <> 'Rest of the World'").select(*COHORT_KEY).limit(3).collect()
    asked = [(f"q{i}", *some[i % 3]) for i in range(30)] + [("lost", dt.date(2000, 1, 1), "cpc", "IOS", "Cyprus")]
    rows = spark.createDataFrame(asked, "request_id string, first_touch_date date, traffic_source string, "
                                        "os string, country string")
    root = str(tmp_path)
    scoring.prepare_requests(events, PARAMS, rows, root)
    one = {tuple(r[c] for c in COHORT_KEY): r.prediction
           for r in scoring.score_cohorts(wide, model, PARAMS).collect()}
    got = {r.request_id: r.predicted_ltv for r in scoring.predict_requests(spark, root, model, PARAMS).collect()}
    assert got == {q: one.get(tuple(c)) for q, *c in asked}
    assert scoring.read_prepared(spark, root, "session").count() == 3
    known = {r.request_id for r in scoring.prepared_features(spark, root, PARAMS).where("known").collect()}
    assert known == set(got) - {"lost"}


def test_a_request_folder_predicts_like_the_batch(spark, fitted, tmp_path):
    events, wide, model = fitted
    cohort = wide.where("country <> 'Rest of the World'").first()
    request = CohortRequest(*[cohort[c] for c in COHORT_KEY])
    root = str(tmp_path)
    scoring.prepare_request(events, PARAMS, request, root, "one")
    done = scoring.predict_request(spark, root, "one", model, PARAMS).collect()
    want = scoring.score_cohorts(wide, model, PARAMS).where(
        (wide.first_touch_date == cohort.first_touch_date) & (wide.country == cohort.country)
        & (wide.os == cohort.os) & (wide.traffic_source == cohort.traffic_source)).collect()
    assert len(done) == 1 and done[0].data_id == "one"
    assert done[0].predicted_ltv == pytest.approx(want[0].prediction)
    missing = CohortRequest(dt.date(2000, 1, 1), "cpc", "IOS", "Cyprus")
    scoring.prepare_request(events, PARAMS, missing, root, "two")
    assert scoring.predict_request(spark, root, "two", model, PARAMS).collect()[0][1] is None


def test_requested_cohort_is_the_same_rows_of_the_full_query(spark, fitted):
    events, wide, _ = fitted
    cohort = wide.where("country <> 'Rest of the World'").first()
    request = CohortRequest(cohort.first_touch_date, cohort.traffic_source, cohort.os)
    stored = store_timeline(events, PARAMS)
    for source, query in itertools.product((stored, events), QUERIES.values()):
        some = query(source, PARAMS, request).collect()
        every = [r for r in query(events, PARAMS).collect()
                 if (r.first_touch_date, r.traffic_source, r.os) == (
                     cohort.first_touch_date, cohort.traffic_source, cohort.os)]
        assert sorted(map(repr, some)) == sorted(map(repr, every)) and some


def test_many_requests_are_prepared_together(spark, fitted, tmp_path):
    events, wide, _ = fitted
    some = wide.where("country <> 'Rest of the World'").select(*COHORT_KEY).limit(2).collect()
    asked = spark.createDataFrame(
        [("a", *some[0]), ("b", *some[0]), ("c", *some[1])],
        "request_id string, first_touch_date date, traffic_source string, os string, "
        "country string")
    scoring.prepare_requests(events, PARAMS, asked, str(tmp_path))
    for job, query in QUERIES.items():
        every = scoring.prepared_rows(spark, str(tmp_path), job)
        for name, cohort in (("a", some[0]), ("b", some[0]), ("c", some[1])):
            got = every.where(f"request_id = '{name}'")
            want = query(events, PARAMS, CohortRequest(*cohort))
            columns = want.columns
            assert sorted(map(repr, got.select(*columns).collect())) == sorted(
                map(repr, want.collect()))


def test_feature_tables_are_stored_once(spark, fitted):
    events, wide, _ = fitted
    stored = store_features(events, PARAMS, "wide_t", "long_t")
    assert sorted(map(repr, stored.collect())) == sorted(map(repr, wide.collect()))
    assert spark.table("wide_t").count() == wide.count()
    assert spark.table("long_t").count() == wide.count() * len(PARAMS.metric_columns)
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        store_features(events, PARAMS, "wide_t", "long_t")


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "n long, s string")
    where = {"path": str(tmp_path / "t")}
    tables.write_table(df, "t", fmt="parquet", options=where)
    with pytest.raises(Exception):
        tables.write_table(df, "t", fmt="parquet", options=where)
    with pytest.raises(Exception):
        tables.read_table(spark, "no_such_table").collect()
    df.createOrReplaceTempView("small")
    assert tables.read_table(spark, "small").count() == 1


def test_connectors_are_told_the_name_in_their_own_way():
    assert tables._address("jdbc", "a.t", {"url": "u"}) == {"dbtable": "a.t", "url": "u"}
    assert tables._address("warehouse", "a.t", None) == {"table": "a.t"}
    assert tables._address("lake", "a.t", {"path": "p"}) == {"path": "p"}
