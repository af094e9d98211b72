"""Corpus pipeline: quality rules, line dedup, near duplicates, decontamination, piece ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. A stage's result is
written as a table in the shared folder and read again, so that a lost executor costs no earlier stage.

Edge cases: documents with a missing or empty text fail the quality rules and go. A document of which line
dedup leaves no word goes; one that had no recurring line stays as it is. Documents without an id pass line
dedup and the near-duplicate stage as they are. Rows that repeat an id stay or go together. All stages but
the last keep the columns of the input, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, jaccard, pieces, quality, templates
from tidemark.llm.queries import on_path, tokenizer_file
from tidemark.llm.tables import SPACE, read
from tidemark.sources.staging import stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current policy."""
    return quality.passing(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; those of which nothing is left go."""
    left = F.col("text").rlike(SPACE.replace("[", "[^"))
    return templates.drop_lines(docs).where(left)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each component of similar documents."""
    return jaccard.representatives(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stands in benchmark windows."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"), mode="documents")


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the documents in the vocabulary of the piece model, as the model's library gives them."""
    coded = pieces.encode(docs.select("doc_id", "text"), tokenizer_file("piece_bpe_32k.model"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids")


STAGES = [
    ("quality_rules", on_path(quality_rules)),
    ("line_dedup", on_path(line_dedup)),
    ("near_duplicates", on_path(near_duplicates)),
    ("benchmark_decontamination", on_path(benchmark_decontamination)),
    ("piece_ids", on_path(piece_ids)),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
