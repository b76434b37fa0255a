"""Message sources and sinks: a broker in production, files wherever there is none."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortide.sources.schemas import ENVELOPE

# Topic names.
TOPICS = ("app_request", "prediction_request", "prediction_complete")
APP_REQUEST, PREDICTION_REQUEST, PREDICTION_COMPLETE = TOPICS


def read_broker(spark: SparkSession, servers: str, topics: Sequence[str] = TOPICS,
                options: Mapping[str, str] | None = None) -> DataFrame:
    """Stream of messages from a broker, newest onwards unless options say otherwise. Progress
    is kept in the query's checkpoint."""
    settings = {"startingOffsets": "latest", **dict(options or {})}
    raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
           .option("subscribe", ",".join(topics)).options(**settings).load())
    return raw.select("topic", "partition", "offset", "timestamp",
                      F.col("value").cast("string").alias("value"))


def read_files(spark: SparkSession, path: str, options: Mapping[str, str] | None = None
               ) -> DataFrame:
    """The same stream from JSON files of message envelopes."""
    return (spark.readStream.schema(ENVELOPE).options(**dict(options or {}))
            .option("recursiveFileLookup", True).json(path))


def envelopes(df: DataFrame, topic: str, *order: str) -> DataFrame:
    """``value`` rows as envelopes; ``order`` names the columns giving offset and time."""
    offset = F.col(order[0]) if order else F.monotonically_increasing_id()
    return df.select(F.lit(topic).alias("topic"), F.lit(0).alias("partition"),
                     offset.cast("bigint").alias("offset"),
                     F.timestamp_micros(offset.cast("bigint")).alias("timestamp"), "value")


Sink = Callable[[DataFrame, int], None]


def broker_sink(servers: str, options: Mapping[str, str] | None = None) -> Sink:
    """Sink for ``topic, value`` rows of one micro-batch."""
    def send(rows: DataFrame, _batch: int) -> None:
        # Only these two: a partition column would pin every message to one partition.
        (rows.select("topic", "value").write.format("kafka")
         .option("kafka.bootstrap.servers", servers).options(**dict(options or {})).save())
    return send


def file_sink(root: str) -> Sink:
    """The same to JSON files; a replayed batch replaces its own output."""
    def send(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").json(f"{root}/out-{batch}")
    return send
