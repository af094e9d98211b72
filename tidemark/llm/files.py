"""Binary files in the shared folder, opened inside tasks by any scheme the installed Arrow knows.

A task that is retried or runs twice writes another file: names are unique for each attempt, and only
the names that finished tasks report (the manifest) are ever read.
"""

from __future__ import annotations

import re
import uuid

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from ..sources.staging import new_folder, stage


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def create(uri: str):
    system, path = _at(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def open_stream(uri: str):
    system, path = _at(uri)
    return system.open_input_stream(path, compression=None)


def open_random(uri: str):
    system, path = _at(uri)
    return system.open_input_file(path)


def part_name(folder: str, number: int, suffix: str) -> str:
    """A name of this attempt of this task alone."""
    part = TaskContext.get().partitionId()
    return f"{folder}/part-{part:06d}-{number:04d}-{uuid.uuid4().hex}{suffix}"


def folder_for(spark: SparkSession, name: str, folder: str | None) -> str:
    return folder.rstrip("/") if folder else new_folder(spark, name)


def written(manifest: DataFrame, name: str) -> DataFrame:
    """Run the writing tasks once and go on from their manifest."""
    return stage(manifest, name)


def one_file_a_task(manifest: DataFrame) -> DataFrame:
    """The rows of a manifest, dealt out one to a partition."""
    return manifest.repartition(max(1, manifest.count()))
