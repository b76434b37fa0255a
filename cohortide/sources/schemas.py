"""Declared schemas: nothing on the hot path is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

PARAM = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StructType([
        T.StructField("string_value", T.StringType()),
        T.StructField("int_value", T.LongType()),
        T.StructField("double_value", T.DoubleType()),
    ])),
])

EVENTS = T.StructType([
    T.StructField("user_pseudo_id", T.StringType()),
    T.StructField("event_timestamp", T.LongType()),
    T.StructField("event_name", T.StringType()),
    T.StructField("event_params", T.ArrayType(PARAM)),
    T.StructField("traffic_source", T.StructType([T.StructField("medium", T.StringType())])),
    T.StructField("device", T.StructType([T.StructField("operating_system", T.StringType())])),
    T.StructField("geo", T.StructType([T.StructField("country", T.StringType())])),
])

INPUT_DATA = T.StructType([
    T.StructField("country", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("os", T.StringType()),
    T.StructField("traffic_source", T.StringType()),
])

MESSAGE = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("input_data", INPUT_DATA),
    T.StructField("bucket_folder_id", T.StringType()),
    T.StructField("data_id", T.StringType()),
    T.StructField("predicted_ltv", T.DoubleType()),
])

# The columns of a message source that routing and state need, with the source's own names.
ENVELOPE = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("value", T.StringType()),
])

PREDICTION = T.StructType([T.StructField("predicted_ltv", T.DoubleType())])
