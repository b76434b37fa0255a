"""The request loop as one streaming query: request in, prediction and state out.

The registry of requests is the query's own keyed state: a stateful operator holds the cohorts of each
request id, ids being dealt to many small groups by hash. A batch reads and writes the groups of its ids
and no others, and a timer drops ids that nothing has been heard of for a time. Time is that of the
messages, so a replay expires the same ids. The state lives in the checkpoint and comes back after a restart.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.ml import Model
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cohortide.params import COHORT_KEY, CohortParams
from cohortide.plans.scoring import score_requests
from cohortide.sources.messages import PREDICTION_COMPLETE, PREDICTION_REQUEST, Sink
from cohortide.streaming import routing, state

#: How long an id without new messages stays registered. A message that is as much older than the
#: newest one comes too late to be registered or answered.
KEEP_MINUTES = 7 * 24 * 60


@dataclass(frozen=True)
class LoopPaths:
    """Folders of one loop: state updates, rejected messages, checkpoint."""

    state: str
    rejected: str
    checkpoint: str


#: Groups that ids are dealt to in the registry's state. Calling Python costs far more for each group than
#: for each of its rows, so a batch of many ids pays for this many groups at most; a batch of a few reads
#: and writes the groups of its ids. A checkpoint goes with one number.
GROUPS = 1 << 15

# The messages that the registry gets and the steps that it gives, ``announce`` and ``score``, are JSON with
# no more than it or a batch needs of them: each column that pandas gets or gives for a group costs more
# than all its work. Instants are microseconds, days text.
_ASKED = ("id", *COHORT_KEY[1:], "kind", "partition", "offset")
_STEPS = ("step string, id string, first_touch_date string, traffic_source string, os string, "
          "country string, timestamp bigint")
_POSITION = ("timestamp", "partition", "offset")


def remember():
    """The registry of one group of ids: requests are stored and announced, predict messages are given
    the cohorts stored for their id by then (requests of the same batch included), or none.

    The state is the cohorts that the group's ids asked for, each once, and by id the time to forget it
    and the places of its cohorts. The timer is that of the id to be forgotten first."""

    def position(row: dict) -> list[tuple[bool, int]]:
        return [(row.get(c) is None, row.get(c) or 0) for c in _POSITION]

    def packed(cohorts: list[list], ids: dict[str, tuple[int, list[int]]]) -> tuple[str, str]:
        # Without cohorts that no id asks for any more.
        used = {place: n for n, place in enumerate(sorted({p for _, own in ids.values() for p in own}))}
        return (json.dumps([cohorts[place] for place in used]),
                json.dumps({ident: (until, [used[place] for place in own])
                            for ident, (until, own) in ids.items()}))

    def serve(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        texts = [] if held.hasTimedOut else [text for frame in frames for text in frame["row"]]
        messages = {}
        for row in sorted(json.loads(f"[{','.join(texts)}]"), key=position):
            messages.setdefault(row["id"], []).append(row)
        cohorts, ids = map(json.loads, held.get) if held.exists else ([], {})
        places = {tuple(cohort): place for place, cohort in enumerate(cohorts)}
        # The watermark stays behind the newest message by the time that ids are kept.
        now = held.getCurrentWatermarkMs()
        kept = {ident: (until, own) for ident, (until, own) in ids.items()
                if until >= now or ident in messages}
        changed, out = len(kept) < len(ids), []
        for ident, rows in messages.items():
            own = list(kept[ident][1]) if ident in kept else []
            asked = None
            for row in rows:
                if row["kind"] == "request":
                    cohort = [row[c] for c in COHORT_KEY]
                    place = places.setdefault(tuple(cohort), len(cohorts))
                    if place == len(cohorts):
                        cohorts.append(cohort)
                    if place not in own:
                        own.append(place)
                    out.append({"step": "announce", "id": ident, "timestamp": row.get("timestamp")})
                else:
                    asked = row
            if own:
                heard = [row["millis"] for row in rows if row.get("millis") is not None]
                kept[ident] = max([now + 1, *heard]), own
                changed = True
            if asked:
                last = {"step": "score", "id": ident, "timestamp": asked.get("timestamp")}
                out += [last | dict(zip(COHORT_KEY, cohorts[place])) for place in own] or [last]
        if kept:
            if changed:
                held.update(packed(cohorts, kept))
            held.setTimeoutTimestamp(max(now + 1, min(until for until, _ in kept.values())))
        elif held.exists:
            held.remove()
        if out:
            yield pd.DataFrame({"row": [json.dumps(row) for row in out]})

    return serve


def served(messages: DataFrame, keep_minutes: float = KEEP_MINUTES) -> DataFrame:
    """Messages as what a batch has to do for them."""
    routed = routing.route(messages)
    payload = [F.lit(None).cast("string").alias("step"), "id",
               F.col("m.input_data.date").try_cast("date").alias(COHORT_KEY[0]),
               *[F.col(f"m.input_data.{name}").alias(name) for name in COHORT_KEY[1:]],
               "kind", F.col("m.predicted_ltv").alias("predicted_ltv"),
               "topic", "partition", "offset", "timestamp", "value"]
    rows = routed.select(*payload)
    # A watermark begins at the epoch, and what is not after it is late: a day later, nothing is.
    heard = F.col("timestamp") + F.expr("INTERVAL 1 DAY")
    asked = rows.where(F.col("kind").isin("request", "predict")).withColumn("heard", heard).withColumn(
        "millis", F.unix_millis("heard"))
    texts = F.to_json(F.struct(
        *_ASKED, F.col(COHORT_KEY[0]).cast("string").alias(COHORT_KEY[0]),
        F.unix_micros("timestamp").alias("timestamp"), "millis"))
    registered = (asked.select(state.bucket_of(F.col("id"), GROUPS).alias("group"), "heard", texts.alias("row"))
                  .withWatermark("heard", f"{int(keep_minutes * 60_000)} milliseconds").groupBy("group")
                  .applyInPandasWithState(remember(), "row string", "cohorts string, ids string", "append",
                                          GroupStateTimeout.EventTimeTimeout)
                  .select(F.from_json("row", _STEPS).alias("row")).select("row.*")
                  .withColumns({COHORT_KEY[0]: F.col(COHORT_KEY[0]).cast("date"),
                                "timestamp": F.timestamp_micros("timestamp")}))
    plain = rows.where(F.col("kind").isin("predict", "done", "rejected")).withColumn("step", F.col("kind"))
    return registered.unionByName(plain, allowMissingColumns=True)


def handle_batch(features: DataFrame, model: Model, params: CohortParams, paths: LoopPaths,
                 sink: Sink) -> Callable[[DataFrame, int], None]:
    """Serve all messages of a micro-batch together.

    * Requests are announced by a predict message.
    * Of predict messages, every cohort they ask for is scored once and answered by a done message.
      An id that nobody registered is answered by a null.
    * Predict and done messages update the state table.

    Every output is a directory named by the batch and stamped with the batch's latest message, so
    a replayed batch repeats itself.
    """
    def serve(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        try:
            respond(rows, batch_id)
        finally:
            rows.unpersist()

    def respond(rows: DataFrame, batch_id: int) -> None:
        def of(step):
            return rows.where(F.col("step") == step)

        of("rejected").select("topic", "offset", "value").write.mode("overwrite").json(
            f"{paths.rejected}/batch_id={batch_id}")
        asked = of("score").select(F.col("id").alias("request_id"), *COHORT_KEY)
        scored = score_requests(asked, features, model, params)
        announced = routing.predict_message(of("announce"), "id").withColumn(
            "topic", F.lit(PREDICTION_REQUEST))
        answered = routing.done_message(scored).withColumn("topic", F.lit(PREDICTION_COMPLETE))
        stamp = {"partition": F.lit(0), "offset": F.lit(batch_id).cast("bigint"),
                 "timestamp": rows.agg(F.max("timestamp").alias("latest")).scalar()}
        sink(announced.unionByName(answered).withColumns(stamp), batch_id)
        updates = rows.where(F.col("step").isin("predict", "done")).withColumn(
            "m", F.struct("predicted_ltv"))
        state.append_updates(state.updates_of(updates), paths.state, batch_id)

    return serve


def start_loop(messages: DataFrame, features: DataFrame, model: Model, params: CohortParams,
               paths: LoopPaths, sink: Sink, keep_minutes: float = KEEP_MINUTES, **trigger
               ) -> StreamingQuery:
    """Start serving. ``trigger`` is passed on, e.g. ``availableNow=True``."""
    return (served(messages, keep_minutes).writeStream
            .foreachBatch(handle_batch(features, model, params, paths, sink))
            .option("checkpointLocation", paths.checkpoint)
            .trigger(**(trigger or {"processingTime": "1 second"}))
            .start())
