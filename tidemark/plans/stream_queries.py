"""Streams over the given tables, run to their end; twins are the batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import html_clean
from ..functions.urls import site_of
from ..functions.values import dedup_key, dedup_type
from ..sources import keystore, schemas, staging
from ..streaming import streams
from . import bindings as b
from . import oracle as o
from .registry import query


def _pages(spark, sf):
    # The trailing wildcard lets the table be a file or a folder.
    schema = b.table(spark, sf, "pages").schema
    return streams.arriving(spark, schema, f"{sf}/pages.parquet*")


@query(f"SELECT page_id, {o.SITE} AS site_name, {o.clean('html')} AS text FROM pages")
def stream_captures(spark, sf):
    def read(pages):
        return pages.select(
            "page_id", site_of(F.col("url")).alias("site_name"), html_clean(F.col("html")).alias("text")
        )

    state, out = staging.new_folder(spark, "state"), staging.new_folder(spark, "captures")
    streams.stream_captures(_pages(spark, sf), read, state, out)
    # A second run finds nothing new and adds no row.
    streams.stream_captures(_pages(spark, sf), read, state, out)
    return spark.read.parquet(out)


def _stream_postings(spark, sf):
    job_id = b.number_in_url(F.col("url"))
    return _pages(spark, sf).select(
        F.col("page_id").alias("site_ord"),
        F.lit(0).alias("page_num"),
        F.lit(0).alias("pos"),
        "url",
        F.concat(F.lit("Role "), job_id).alias("title"),
        site_of(F.col("url")).alias("company"),
        dedup_key(job_id, F.col("url")).alias("dedup_key"),
        dedup_type(job_id).alias("dedup_type"),
    )


@query(f"SELECT DISTINCT {o.KEY} AS dedup_key FROM pages")
def stream_dedup(spark, sf):
    state, out = staging.new_folder(spark, "state"), staging.new_folder(spark, "keys")
    streams.stream_dedup(_stream_postings(spark, sf).select("dedup_key"), state, out)
    return keystore.read(spark, out, "dedup_key string")


@query(f"""
WITH {o.STREAK} SELECT site_name, consecutive_zeros, strftime(last_success_at, '%Y-%m-%d') AS last_success_day FROM streak""")
def stream_health(spark, sf):
    history = staging.new_folder(spark, "history")
    b.run_history(spark, sf).write.parquet(history)
    state, out = staging.new_folder(spark, "state"), staging.new_folder(spark, "health")
    schema = spark.read.parquet(history).schema
    streams.drain_health(streams.arriving(spark, schema, history), state, out)
    return streams.latest_health(spark, out).select(
        "site_name", "consecutive_zeros",
        F.date_format("last_success_at", "yyyy-MM-dd").alias("last_success_day"),
    )


@query(f"""
WITH {o.SEEN}, n AS (
  SELECT {o.KEY} AS dedup_key, url, {o.SITE} AS company FROM pages
  QUALIFY row_number() OVER (PARTITION BY {o.KEY} ORDER BY page_id) = 1)
SELECT dedup_key, 'https://stored.example.com/' || dedup_key AS url, 'stored' AS company FROM seen
UNION ALL SELECT dedup_key, url, company FROM n WHERE dedup_key NOT IN (SELECT dedup_key FROM seen)""")
def stream_upsert(spark, sf):
    store, state = staging.new_folder(spark, "seen"), staging.new_folder(spark, "state")
    keystore.append_new(spark, store, b.seen_store(spark, sf), "before", 0)
    now = F.lit("2024-02-01 06:00:00").cast("timestamp")
    streams.stream_upsert(_stream_postings(spark, sf), store, state, now)
    return keystore.read(spark, store, schemas.SEEN).select("dedup_key", "url", "company")
