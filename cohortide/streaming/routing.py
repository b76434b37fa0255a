"""Decode messages and route them by the key they carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortide.params import COHORT_KEY
from cohortide.sources.schemas import MESSAGE


def route(messages: DataFrame) -> DataFrame:
    """Add ``kind`` (request, predict, done or rejected), ``id`` and the decoded payload.

    A message goes to the first of ``request_id``, ``bucket_folder_id``, ``data_id`` that its
    top-level object has, whatever topic it came from. Text that is not a JSON object, objects
    with none of the keys and incomplete payloads are rejected rather than ending the stream: a
    request needs all four parts of the cohort key and a date that is one, a done message a number
    or an explicit null. Works on streams and on batches alike.
    """
    keys = F.json_object_keys("value")

    def has(key):
        return F.coalesce(F.array_contains(keys, key), F.lit(False))

    def sound(kind, complete):
        return F.when(complete, kind).otherwise("rejected")

    m = F.from_json("value", MESSAGE)
    decoded = messages.withColumns({"m": m, "_request": has("request_id"),
                                    "_predict": has("bucket_folder_id"), "_done": has("data_id")})
    cohort = F.col("m.input_data.date").try_cast("date").isNotNull()
    for name in COHORT_KEY[1:]:
        cohort = cohort & F.col(f"m.input_data.{name}").isNotNull()
    number = F.col("m.predicted_ltv")
    answer = has("predicted_ltv") & F.when(number.isNotNull(), ~F.isnan(number)).otherwise(
        F.get_json_object("value", "$.predicted_ltv").isNull())
    kind = (
        F.when(F.col("_request"), sound("request", F.col("m.request_id").isNotNull() & cohort))
        .when(F.col("_predict"), sound("predict", F.col("m.bucket_folder_id").isNotNull()))
        .when(F.col("_done"), sound("done", F.col("m.data_id").isNotNull() & answer))
        .otherwise("rejected"))
    ident = (F.when(F.col("kind") == "request", F.col("m.request_id"))
             .when(F.col("kind") == "predict", F.col("m.bucket_folder_id"))
             .when(F.col("kind") == "done", F.col("m.data_id")))
    return (decoded.withColumn("kind", kind).withColumn("id", ident)
            .drop("_request", "_predict", "_done"))


def requests_of(routed: DataFrame) -> DataFrame:
    """Typed cohort requests among routed messages."""
    return routed.where(F.col("kind") == "request").select(
        F.col("id").alias("request_id"),
        F.col("m.input_data.date").try_cast("date").alias(COHORT_KEY[0]),
        *[F.col(f"m.input_data.{name}").alias(name) for name in COHORT_KEY[1:]])


def position_id(*position: str) -> Column:
    """An id from a message's topic, partition and offset: the same one whenever it is replayed."""
    digest = F.md5(F.concat_ws("/", *[F.col(c).cast("string") for c in position]))
    return F.concat_ws("-", *[F.substring(digest, a, n) for a, n in
                              ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def ingest(messages: DataFrame) -> DataFrame:
    """Requests that came without an id, as messages that have one, by their position."""
    m = F.from_json("value", MESSAGE)
    rows = messages.withColumn("m", m).where(
        F.col("m.input_data").isNotNull() & F.col("m.request_id").isNull()
        & F.col("m.bucket_folder_id").isNull() & F.col("m.data_id").isNull())
    asked = rows.select(
        position_id("topic", "partition", "offset").alias("request_id"),
        F.col("m.input_data.date").try_cast("date").alias(COHORT_KEY[0]),
        *[F.col(f"m.input_data.{name}").alias(name) for name in COHORT_KEY[1:]],
        "topic", "partition", "offset", "timestamp")
    return asked.withColumn("value", _request_text(F.col("request_id")))


def _request_text(ident: Column) -> Column:
    data = F.struct("country", F.date_format("first_touch_date", "yyyy-MM-dd").alias("date"),
                    "os", "traffic_source")
    return F.to_json(F.struct(data.alias("input_data"), ident.alias("request_id")))


def request_message(requests: DataFrame, *keep: str) -> DataFrame:
    """Requests as ``value`` texts, beside the columns to keep. A request without an id gets one from its
    position in the topic, where it has a position, else a random one."""
    position = [c for c in ("topic", "partition", "offset") if c in requests.columns]
    fresh = position_id(*position) if len(position) == 3 else F.uuid()
    ident = F.coalesce("request_id", fresh)
    return requests.select(_request_text(ident).alias("value"), *keep)


def predict_message(ids: DataFrame, column: str = "request_id") -> DataFrame:
    return ids.select(F.to_json(F.struct(F.col(column).alias("bucket_folder_id"))).alias("value"))


def done_message(scored: DataFrame, column: str = "request_id") -> DataFrame:
    """Done messages; a prediction that could not be made is sent as an explicit null."""
    return scored.select(F.to_json(
        F.struct(F.col(column).alias("data_id"), "predicted_ltv"),
        {"ignoreNullFields": "false"}).alias("value"))
