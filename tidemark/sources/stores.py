"""The two persistent tables: seen postings and site health.

A posting is only ever marked seen when its key is not in the store yet, so the store grows by
one folder per run and nothing already written is rewritten. Site health has one row per site and
is written as a new snapshot.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import schemas


def _read(spark: SparkSession, ddl: str | StructType, path: str) -> DataFrame:
    """A store, empty before the first run."""
    try:
        return spark.read.schema(ddl).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ddl)


def read_seen(spark: SparkSession, path: str, without: str | None = None) -> DataFrame:
    """Whole store over all runs; select ``dedup_key`` for look-ups, the scan prunes the rest.

    ``without`` leaves out the folder of one run: a run that is repeated does not find its own keys.
    """
    rows = _read(spark, f"{schemas.SEEN}, run_id string", path)
    if without is not None:
        rows = rows.filter(F.col("run_id") != without)
    return rows.drop("run_id")


def read_rows(spark: SparkSession, schema, path: str) -> DataFrame:
    """Rows of ``schema`` with their ``run_id``, none before the first run."""
    names = StructType([*schema.fields, StructField("run_id", StringType())])
    return _read(spark, names, path)


def seen_keys(seen: DataFrame) -> DataFrame:
    return seen.select("dedup_key")


def append_seen(rows: DataFrame, path: str, run_id: str) -> None:
    """Write one run's new rows; repeating the run replaces its own folder only."""
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/run_id={run_id}")


def read_health(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, schemas.HEALTH, path)


def write_health(health: DataFrame, path: str) -> None:
    """Write a snapshot to a new folder: the input being read is never overwritten."""
    health.write.mode("errorifexists").parquet(path)


def utc_times(health: DataFrame) -> DataFrame:
    """Times of last success as timestamps; text without an offset is UTC, bad text NULL."""
    return health.withColumn(
        "last_success_at", F.try_to_timestamp(F.col("last_success_at").cast("string"))
    )


def last_run(health: DataFrame) -> DataFrame:
    return utc_times(health).select("site_name", "last_success_at")


def site_last_run(sites: DataFrame, health: DataFrame) -> DataFrame:
    return sites.join(last_run(health), "site_name", "left")


def site_zeros(sites: DataFrame, health: DataFrame) -> DataFrame:
    """Zero counter per site, 0 for a site the store does not know."""
    return sites.join(health.select("site_name", "consecutive_zeros"), "site_name", "left").withColumn(
        "consecutive_zeros", F.coalesce("consecutive_zeros", F.lit(0))
    )
