"""A small table that is replaced as a whole: numbered folders, of which the newest complete one counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KEPT = 3  # versions that readers may still be at


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the folders that have been written to their end, ascending."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return []
    names = [s.getPath().getName() for s in files.listStatus(place) if s.isDirectory()]
    done = [n for n in names if n.isdigit() and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(map(int, done))


def newest(spark: SparkSession, path: str, schema) -> DataFrame:
    """The newest version, empty before the first."""
    versions = _versions(spark, path)
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{versions[-1]:08d}")


def write_next(table: DataFrame, path: str) -> None:
    """Write ``table``, which may read the newest version, as the next one, and delete versions before the last few."""
    spark = table.sparkSession
    versions = _versions(spark, path)
    following = versions[-1] + 1 if versions else 0
    table.write.mode("overwrite").parquet(f"{path}/{following:08d}")  # over what a failed try has left
    for old in versions[: max(0, len(versions) - KEPT)]:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{old:08d}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
