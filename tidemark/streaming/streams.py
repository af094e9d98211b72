"""The incremental steps as Structured Streaming jobs over arriving files.

Each runs to the end of what has arrived (``availableNow``) and goes on from its checkpoint the
next time, which is what a scheduled run does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import incremental
from ..sources import keystore, schemas, snapshots


def arriving(spark: SparkSession, schema, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files as a stream; ``path`` may be a glob."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def drain(
    rows: DataFrame, checkpoint: str, out: str | None = None, mode: str = "append",
    each: Callable[[DataFrame, int], None] | None = None,
) -> None:
    """Process everything that has arrived, into parquet or through ``each`` batch."""
    writer = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(each) if each else writer.format("parquet").option("path", out)
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def stream_captures(
    arrived: DataFrame, read: Callable[[DataFrame], DataFrame], checkpoint: str, out: str
) -> None:
    """Apply a stateless page reader to captures that came since the last run."""
    drain(read(arrived), checkpoint, out)


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """Name of this stream alone: another stream, or a new checkpoint, has another id."""
    return spark.read.json(f"{checkpoint.rstrip('/')}/metadata").first()["id"]


def stream_dedup(postings: DataFrame, checkpoint: str, out: str) -> None:
    """Write each key of ``postings`` once to the key store ``out``; which duplicate comes through is not determined.

    What has been written is the memory, so no state grows in the executors, and a batch reads only the
    buckets that its keys may be in (``sources.keystore``).
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        keystore.append_new(spark, out, batch.dropDuplicates(["dedup_key"]), _stream_id(spark, checkpoint), batch_id)

    drain(postings, checkpoint, each=write)


def stream_upsert(
    postings: DataFrame, store: str, checkpoint: str, run_at: Column, score: Callable[[DataFrame], DataFrame] | None = None
) -> None:
    """Add each batch's new postings to the key store at ``store``, first occurrence first.

    ``score(new)`` gives (dedup_key, best_score) of the new postings of a batch; without it, or without a row, the
    stored score is NULL. A batch that is repeated after a failure is known by its stream and number, and no
    stream touches what another wrote. A store that does not exist yet is empty.
    """

    def upsert(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession

        def rows(new: DataFrame) -> DataFrame:
            scores = score(new) if score else spark.createDataFrame([], "dedup_key string, best_score double")
            return incremental.seen_rows(new, scores, run_at)

        keystore.append_new(spark, store, incremental.first_occurrence(batch), _stream_id(spark, checkpoint), batch_id, rows)

    drain(postings, checkpoint, each=upsert)


def drain_health(runs: DataFrame, checkpoint: str, out: str) -> None:
    """Merge arrived runs (site_name, run_at, job_count) into the health state under ``out``.

    A batch reads the newest state, not the history, and writes the next (``incremental.health_state``). Runs that
    come twice count once, so a batch that is repeated after a failure changes nothing.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        old = snapshots.newest(spark, out, schemas.RUNS)
        snapshots.write_next(incremental.health_state(old, batch), out)

    drain(runs, checkpoint, each=merge)


def latest_health(spark: SparkSession, out: str) -> DataFrame:
    """Zero counter and last success per site, in whatever order runs arrived."""
    return incremental.zero_streak(snapshots.newest(spark, out, schemas.RUNS))
