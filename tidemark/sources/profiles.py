"""Profile documents: every Markdown file of a folder, kept whole."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import profile_label


def read_profiles(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md").select(
        F.col("_metadata.file_name").alias("filename"), F.col("value").alias("content")
    )
    profiles = labelled(files)
    if profiles.isEmpty():
        raise ValueError(f"no .md profile found in {folder}")
    return profiles


def write_profiles(profiles: DataFrame, folder: str) -> int:
    """Write each profile (filename, content) as a file of its own in ``folder``, which all workers see; number of files.

    A file is written under another name first, so that a task that is tried again leaves no half of one. A missing
    content is an empty file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from uuid import uuid4

        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if posixpath.basename(name) != name or not name.endswith(".md"):
                    raise ValueError(f"{name} is no name of a .md file")
                part = f"{root}/.{uuid4().hex}"
                with files.open_output_stream(part) as out:
                    out.write((content or "").encode())
                files.move(part, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    written = profiles.select("filename", "content").mapInArrow(run, "n long")
    return written.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def labelled(files: DataFrame) -> DataFrame:
    return files.select("filename", profile_label(F.col("filename")).alias("role_label"), "content")


def sorted_profiles(profiles: DataFrame) -> DataFrame:
    return profiles.orderBy("filename")
