"""Latest fields per id, as a log-structured table.

A state folder holds

* ``updates/batch_id=N/bucket=K``: the field updates of micro-batch N. A replayed batch replaces its
  own folder, so no update counts twice.
* ``generations/G/bucket=K``: the folded state up to some batch, one row per id.
* ``manifest/V.json``: which generation is current and up to which batch it goes, and the number of
  buckets. A version appears by a rename and is never changed; the newest one counts.

Ids are dealt to buckets by hash, so a lookup opens the files of one bucket. Reading takes the current
generation and the batches after it, and folds: per id and field the last non-null value wins.
Compaction writes the next generation, publishes it and drops what only older generations needed, so
what a reader folds is bounded by the ids and the batches since, not by the history. A reader that has
read the manifest before goes on with the previous generation, which stays until the next compaction.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortide.sources import files

FIELDS = ("bucket_folder_id", "prediction")
SCHEMA = ("id string, bucket_folder_id string, prediction double, timestamp timestamp, "
          "partition int, offset bigint, batch_id bigint")
#: Buckets of a state folder that does not say otherwise.
BUCKETS = 16


@dataclass(frozen=True)
class Manifest:
    """What readers need to know of a state folder."""

    version: int = 0
    generation: int = 0
    upto: int = -1
    buckets: int = BUCKETS
    #: Batches that the generation before this one still needs.
    held_from: int = 0


def manifest(spark: SparkSession, root: str) -> Manifest:
    found = [n for n in files.names(spark, f"{root}/manifest") if n.endswith(".json")]
    if not found:
        return Manifest()
    return Manifest(**json.loads(files.read_text(spark, f"{root}/manifest/{found[-1]}")))


def publish(spark: SparkSession, root: str, new: Manifest) -> bool:
    """False if another writer has published that version."""
    name = f"{root}/manifest/{new.version:012d}.json"
    return files.publish_text(spark, name, json.dumps(asdict(new), sort_keys=True))


def bucket_of(ident, buckets: int) -> Column:
    return F.pmod(F.xxhash64(ident), F.lit(buckets)).cast("int")


def updates_of(routed: DataFrame) -> DataFrame:
    """Field updates carried by predict and done messages."""
    return routed.where(F.col("kind").isin("predict", "done")).select(
        "id", F.when(F.col("kind") == "predict", F.col("id")).alias("bucket_folder_id"),
        F.when(F.col("kind") == "done", F.col("m.predicted_ltv")).alias("prediction"),
        "timestamp", "partition", "offset")


def _write(rows: DataFrame, buckets: int, path: str) -> None:
    # One task for each bucket, so a batch leaves at most that many files.
    (rows.withColumn("bucket", bucket_of(F.col("id"), buckets)).repartition(buckets, "bucket")
     .write.mode("overwrite").partitionBy("bucket").parquet(path))


def append_updates(updates: DataFrame, root: str, batch: int) -> None:
    buckets = manifest(updates.sparkSession, root).buckets
    _write(updates, buckets, f"{root}/updates/batch_id={batch}")


def _batches(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(n.partition("=")[2]) for n in files.names(spark, f"{root}/updates")
                  if n.startswith("batch_id="))


def _parts(spark: SparkSession, paths: list[str], bucket: int | None) -> list[str]:
    """The folders of one bucket, or of all."""
    if bucket is None:
        return paths
    want = f"bucket={bucket}"
    return [f"{p}/{want}" for p in paths if want in files.names(spark, p)]


def read_updates(spark: SparkSession, root: str, bucket: int | None = None) -> DataFrame:
    """The rows to fold: the current generation, as of its last batch, and all later updates."""
    now = manifest(spark, root)
    folded = [f"{root}/generations/{now.generation}"] if now.generation else []
    later = [f"{root}/updates/batch_id={b}" for b in _batches(spark, root) if b > now.upto]
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    body = ", ".join(SCHEMA.split(", ")[:-1])
    out = spark.createDataFrame([], SCHEMA)
    for paths, batch in ((folded, F.lit(now.upto)), (later, None)):
        paths = _parts(spark, paths, bucket)
        if not paths:
            continue
        rows = spark.read.schema(body).option("recursiveFileLookup", True).parquet(*paths)
        number = batch if batch is not None else F.regexp_extract(
            F.col("_metadata.file_path"), "batch_id=([0-9]+)", 1)
        out = out.unionByName(rows.withColumn("batch_id", number.cast("bigint")).select(*columns))
    return out


def latest_state(updates: DataFrame) -> DataFrame:
    """One row per id. Combines on the map side, so an id with many updates costs no more."""
    order = F.struct("batch_id", "timestamp", "partition", "offset")
    return updates.groupBy("id").agg(*[
        F.max_by(f, F.when(F.col(f).isNotNull(), order)).alias(f) for f in FIELDS])


def lookup(spark: SparkSession, root: str, ident: str, places: int | None = 2) -> DataFrame:
    """The state of one id, from its bucket. ``places`` rounds for display."""
    buckets = manifest(spark, root).buckets
    bucket = spark.range(1).select(bucket_of(F.lit(ident), buckets)).first()[0]
    state = latest_state(read_updates(spark, root, bucket).where(F.col("id") == ident))
    if places is None:
        return state
    return state.withColumn("prediction", F.round("prediction", places))


def compact(spark: SparkSession, root: str, last_batch: int) -> str:
    """Fold everything up to ``last_batch``, which must be complete, into a new generation.

    If another writer publishes first, this one's generation is left out and removed."""
    now = manifest(spark, root)
    if last_batch <= now.upto:
        return root
    done = read_updates(spark, root).where(F.col("batch_id") <= last_batch)
    empty = {"timestamp": F.lit(None).cast("timestamp"), "partition": F.lit(None).cast("int"),
             "offset": F.lit(None).cast("bigint")}
    generation = max([0, *map(int, files.names(spark, f"{root}/generations"))]) + 1
    target = f"{root}/generations/{generation}"
    _write(latest_state(done).withColumns(empty), now.buckets, target)
    new = Manifest(now.version + 1, generation, last_batch, now.buckets, now.upto + 1)
    if not publish(spark, root, new):
        files.remove(spark, target)
        return root
    for name in files.names(spark, f"{root}/generations"):
        if int(name) not in (generation, now.generation):
            files.remove(spark, f"{root}/generations/{name}")
    for batch in _batches(spark, root):
        if batch < new.held_from:
            files.remove(spark, f"{root}/updates/batch_id={batch}")
    return root
