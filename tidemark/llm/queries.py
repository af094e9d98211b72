"""Registered queries of the numbered operators; the SQL of those that SQL can express is in oracles.py."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clustering, decontaminate, html, jaccard, lm, pieces, pii, quality, sequences, spelling, superminhash, templates, warc
from .oracles import ORACLES  # noqa: F401
from .tables import read, text_of

def tokenizer_file(name: str) -> str:
    """Where the installed package of public tokenizers has a file; executors have it at the same place."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def on_path(fn: Callable) -> Callable:
    """``fn``, after telling Python workers where this package stands (beside what they have installed)."""

    @functools.wraps(fn)
    def run(spark: SparkSession, *rest) -> DataFrame:
        root = str(Path(__file__).resolve().parents[2])
        env = spark.sparkContext.environment
        if root not in env.get("PYTHONPATH", "").split(os.pathsep):
            env["PYTHONPATH"] = os.pathsep.join(filter(None, (root, env.get("PYTHONPATH"))))
        return fn(spark, *rest)

    return run


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = on_path(fn)
    return fn


@query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    base = F.col("base")
    return pii.find(read(spark, sf_dir, "documents")).withColumn("base", pii.base_only(F.col("spans"))).select(
        "doc_id", *[pii.count(base, kind).alias(f"n_{kind}") for kind in pii.BASE],
        F.sha2(F.encode(pii.listed(base), "UTF-8"), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"),
    )


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its recurring lines."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return templates.drop_lines(docs, counts=True)


@query
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of at least 80 in 100 shared 5-word shingles."""
    return jaccard.join(read(spark, sf_dir, "documents"))


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger of every document with the verdict of the current policy."""
    base = F.col("fail_bits").bitwiseAND(F.lit(quality.mask(quality.BASE))) != 0
    return quality.ledger(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), quality.kept().alias("kept"), "fail_bits",
    )


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of benchmark windows in every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        decontaminate.items_sha256(F.col("items")).alias("items_sha256"), "contaminated",
    )


@query
def op5_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document under a network trained on all of them."""
    docs = read(spark, sf_dir, "documents")
    return lm.score(docs, lm.fit(docs))


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records and read back."""
    manifest = warc.write_archives(warc.chunks(read(spark, sf_dir, "pages")))
    whole = warc.read_archives(manifest, with_data=False).where("last")
    return whole.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents encoded, written as framed records and read back."""
    manifest = sequences.write(read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=2)
    return sequences.read(manifest).select("doc_id", "start", "n_tokens", F.col("crc32").alias("ids_crc32"))


@query
def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract(read(spark, sf_dir, "pages"))


@query
def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document by the batched Viterbi and by merges, as the model's library gives them, and whether
    both decode to its text."""
    docs = read(spark, sf_dir, "documents").select("doc_id", text_of("text").alias("text"))
    coded = pieces.encode_and_check(docs, tokenizer_file("piece_bpe_32k.model"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_xxhash64"),
        F.size("merged").cast("long").alias("n_merged"), F.xxhash64("merged").alias("merged_xxhash64"), "round_trip",
    )


@query
def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector after three rounds."""
    return clustering.report(clustering.cluster(read(spark, sf_dir, "embeddings")))


@query
def op12_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of at least 80 in 100 shared 4-word shingles."""
    return superminhash.join(read(spark, sf_dir, "documents"))


@query
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, form and root of every frequent word."""
    return spelling.variants(read(spark, sf_dir, "documents"))
