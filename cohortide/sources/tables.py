"""Table, request-folder, CSV and JSON sources and sinks. Executors do all reading and writing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortide.sources.schemas import PREDICTION

REQUEST_JOBS = ("session", "event", "ltv")
# A missing prediction needs a spelling: a lone empty cell would be read back as no row at all.
CSV = {"header": "true", "nullValue": "NULL"}


# The option by which a connector is told the table's name, where it is not ``table``.
NAME_OPTIONS = {"jdbc": "dbtable"}


def _address(fmt: str, full: str, options: Mapping[str, str] | None) -> dict[str, str]:
    given = dict(options or {})
    return given if "path" in given else {NAME_OPTIONS.get(fmt, "table"): full, **given}


def read_table(spark: SparkSession, name: str, namespace: str | None = None,
               fmt: str | None = None, options: Mapping[str, str] | None = None) -> DataFrame:
    """A catalog table, or with ``fmt`` a table of any installed connector: a warehouse by its
    ``table`` option, JDBC by ``dbtable``, a lake format by the option ``path``, which then stands
    in place of the name. A missing table raises."""
    full = f"{namespace}.{name}" if namespace else name
    if fmt is None:
        return spark.table(full)
    return spark.read.format(fmt).options(**_address(fmt, full, options)).load()


def write_table(df: DataFrame, name: str, namespace: str | None = None, fmt: str | None = None,
                mode: str = "error", options: Mapping[str, str] | None = None) -> None:
    """Save a feature table. The default refuses to replace an existing one."""
    full = f"{namespace}.{name}" if namespace else name
    if fmt is None:
        df.write.mode(mode).saveAsTable(full)
    else:
        df.write.format(fmt).options(**_address(fmt, full, options)).mode(mode).save()


def write_request_table(df: DataFrame, root: str, request_id: str, job: str) -> str:
    path = f"{root}/{request_id}/{job}.parquet"
    df.write.mode("overwrite").parquet(path)
    return path


def read_request_tables(spark: SparkSession, root: str, request_id: str) -> dict[str, DataFrame]:
    return {job: spark.read.parquet(f"{root}/{request_id}/{job}.parquet") for job in REQUEST_JOBS}


def write_prediction(df: DataFrame, root: str, request_id: str) -> str:
    path = f"{root}/{request_id}/prediction"
    df.write.mode("overwrite").options(**CSV).csv(path)
    return path


def read_prediction(spark: SparkSession, root: str, request_id: str) -> DataFrame:
    """The stored prediction as a done message's columns."""
    return (spark.read.schema(PREDICTION).options(**CSV)
            .csv(f"{root}/{request_id}/prediction")
            .select(F.lit(request_id).alias("data_id"), "predicted_ltv"))


def write_params(spark: SparkSession, values: Mapping[str, object], path: str) -> None:
    """Model parameters as one JSON object."""
    import json

    text = json.dumps(values, indent=None, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").write.mode("overwrite").text(path)


def read_params(spark: SparkSession, path: str) -> dict[str, object]:
    import json

    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def write_bucketed(df: DataFrame, name: str, key: Sequence[str], buckets: int, mode: str = "error",
                   options: Mapping[str, str] | None = None) -> None:
    """Save a table with its rows dealt to buckets by ``key`` and sorted within them, one file each.

    Tables of one key and number of buckets join, and aggregate by the key, without a shuffle."""
    (df.repartition(buckets, *key).write.mode(mode).options(**dict(options or {}))
     .bucketBy(buckets, *key).sortBy(*key).saveAsTable(name))
