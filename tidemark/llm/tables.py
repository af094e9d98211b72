"""Small helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule; everything else belongs to a word.
SPACE = r"[\x20\x09-\x0D]"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """The text, a missing one read as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """Words in order: runs of anything but SPACE."""
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def unused(name: str, taken: list[str]) -> str:
    """``name``, with underscores in front until no column of ``taken`` has it in any case."""
    lowered = {t.lower() for t in taken}
    while name.lower() in lowered:
        name = "_" + name
    return name
