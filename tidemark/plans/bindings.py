"""The driver's tables read as this engine's concepts (sites, captures, stores, replies).

"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.urls import site_of
from ..functions.values import dedup_key, dedup_type, parse_time
from ..sources.profiles import labelled
from ..sources.staging import stage

RANK_CHUNK = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def number_in_url(url: Column) -> Column:
    return F.regexp_extract(url, r"/(\d+)", 1)


def site_pages(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """``pages`` with its site; only the asked-for columns besides."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", *columns, site_of(F.col("url")).alias("site_name"))


def page_numbers(pages: DataFrame) -> DataFrame:
    """(page_id, site_name, page_num): position of a page within its site by ``page_id``.

    Ranks are taken within ranges of ``page_id`` and shifted by the sizes of the earlier ranges,
    so a site with a large share of all pages is still ranked by many tasks.
    """
    chunked = pages.select(
        "page_id", "site_name", F.floor(F.col("page_id") / RANK_CHUNK).alias("chunk")
    )
    earlier = Window.partitionBy("site_name").orderBy("chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    shifts = (
        chunked.groupBy("site_name", "chunk")
        .agg(F.count("*").alias("n"))
        .select("site_name", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    )
    within = Window.partitionBy("site_name", "chunk").orderBy("page_id")
    return (
        chunked.withColumn("rank", F.row_number().over(within))
        .join(shifts, ["site_name", "chunk"])
        .select(
            "page_id", "site_name", (F.col("shift") + F.col("rank") - 1).cast("int").alias("page_num")
        )
    )


def numbered_pages(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    pages = site_pages(spark, sf_dir, *columns)
    return pages.join(page_numbers(pages).drop("site_name"), "page_id")


def targets_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One target per site: most with a page limit above the pages there are, so that a run reads
    whole sites; some with a partial or no pagination block. Written out, as a site list is."""
    kind = F.col("site_ord") % 9
    block = F.when(
        kind == 1,
        F.struct(
            F.lit("page").alias("param"),
            F.lit(None).cast("int").alias("step"),
            F.lit(None).cast("int").alias("max_pages"),
        ),
    ).when(
        kind > 1,
        F.struct(
            F.lit("start").alias("param"),
            F.lit(10).alias("step"),
            (F.col("n") + 2).cast("int").alias("max_pages"),
        ),
    )
    sites = site_pages(spark, sf_dir).groupBy("site_name").agg(
        F.min("page_id").alias("site_ord"),
        F.min_by("url", "page_id").alias("url"),
        F.count("*").alias("n"),
    )
    return stage(
        sites.select(
            "site_ord",
            F.col("site_name").alias("name"),
            "url",
            F.when(F.col("site_ord") % 4 == 1, "playwright").otherwise("http").alias("scrape_tier"),
            block.alias("pagination"),
        ),
        "targets",
    )


def dated_html() -> Column:
    """Page HTML behind a JSON-LD date (not for every 7th page) and a time element (every 3rd)."""
    day = F.date_format(
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 30).cast("int")),
        "yyyy-MM-dd",
    )
    clock = F.lpad((F.col("page_id") % 24).cast("string"), 2, "0")
    posting = F.when(
        F.col("page_id") % 7 != 0,
        F.concat(
            F.lit('<script type="application/ld+json">{"@type": "JobPosting", "datePosted": "'),
            day,
            F.lit('"}</script>'),
        ),
    )
    stamp = F.when(
        F.col("page_id") % 3 == 0,
        F.concat(F.lit('<time datetime="'), day, F.lit("T"), clock, F.lit(':00:00Z">a while</time>')),
    )
    return F.concat_ws("", posting, stamp, F.col("html"))


def captures(pages: DataFrame, html: Column) -> DataFrame:
    """Both tiers' attempts per page; http fails on every 6th page, both on every 30th. On every 18th the browser shows a
    page that was sent with status 403."""
    lost = F.col("page_id") % 30 == 0
    attempts = F.array(
        F.struct(
            F.lit("http").alias("tier"), F.when(F.col("page_id") % 6 == 0, 503).otherwise(200).alias("status"), F.col("html")
        ),
        F.struct(
            F.lit("playwright").alias("tier"),
            F.when(lost, 0).when(F.col("page_id") % 18 == 0, 403).otherwise(200).alias("status"),
            F.when(~lost, F.col("html")).alias("html"),
        ),
    )
    return pages.withColumn("html", html).withColumn("attempt", F.explode(attempts)).select(
        "site_name", "page_num", "url", "attempt.tier", "attempt.status", "attempt.html"
    )


def page_postings(pages: DataFrame) -> DataFrame:
    """Narrow postings, one per page, without touching the HTML."""
    job_id = number_in_url(F.col("url"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 30).cast("int"))
    clock = F.concat(F.lpad((F.col("page_id") % 24).cast("string"), 2, "0"), F.lit(":00"))
    return pages.select(
        *[c for c in ("site_name", "page_num", "page_id") if c in pages.columns],
        F.lit(0).alias("pos"),
        "url",
        job_id.alias("job_id"),
        F.when(F.col("page_id") % 7 != 0, day).alias("posted_date"),
        F.when(F.col("page_id") % 3 == 0, parse_time(clock)).alias("posted_time"),
        dedup_key(job_id, F.col("url")).alias("dedup_key"),
        dedup_type(job_id).alias("dedup_type"),
    )


def seen_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store of an earlier run, as a written table: the documents of ``labels``."""
    key = F.col("doc_id").cast("string")
    rows = (
        table(spark, sf_dir, "labels")
        .groupBy(key.alias("dedup_key"))
        .agg(F.max("quality").alias("quality"))
        .select(
            "dedup_key",
            F.lit("job_id").alias("dedup_type"),
            F.concat(F.lit("Stored "), "dedup_key").alias("title"),
            F.concat(F.lit("https://stored.example.com/"), "dedup_key").alias("url"),
            F.lit("stored").alias("company"),
            F.when(F.col("quality") == 1, 0.75).alias("match_score"),
            F.lit("2024-01-15 12:00:00").cast("timestamp").alias("seen_at"),
        )
    )
    return stage(rows, "seen")


def health_text(raw: DataFrame) -> DataFrame:
    """Health of the sites in ``targets_raw`` with textual times: NULL, naive and with an offset;
    sites first met over plain http are unknown."""
    first = F.col("site_ord")
    return raw.filter(F.col("url").startswith("https:")).select(
        F.col("name").alias("site_name"),
        (first % 5).cast("int").alias("consecutive_zeros"),
        F.when(first % 4 == 2, "2024-01-15T12:00:00")
        .when(first % 4 == 3, "2024-01-15T14:00:00+02:00")
        .alias("last_success_at"),
    )


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(
        table(spark, sf_dir, "benchmark").select(
            F.format_string("profile_%05d.md", "item_id").alias("filename"),
            F.col("text").alias("content"),
        )
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("dedup_key"), F.col("text").alias("description")
    )


# ``orders`` as listing pages with many postings each: newest orders on the first page.

def order_key() -> Column:
    """Three orders in a row, mostly of different sites, share a key."""
    return F.floor(F.col("o_orderkey") / 3).cast("string")


def order_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    site = F.col("o_custkey") % 50
    dated = (site >= 10) & (F.col("o_orderkey") % 7 != 0)
    clock = F.concat(F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0"), F.lit(":30"))
    return table(spark, sf_dir, "orders").select(
        F.format_string("site-%02d", site).alias("site_name"),
        site.alias("site_ord"),
        (2001 - F.year("o_orderdate")).alias("page_num"),
        F.col("o_orderkey").alias("pos"),
        order_key().alias("dedup_key"),
        F.when(dated, F.to_date("o_orderdate")).alias("posted_date"),
        F.when((site >= 20) & (F.col("o_orderkey") % 3 == 0), parse_time(clock)).alias("posted_time"),
    )


def order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        order_postings(spark, sf_dir)
        .select("site_name", "site_ord", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("page_num"))
        .distinct()
    )


def order_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of finished orders."""
    store = (
        table(spark, sf_dir, "orders")
        .filter("o_orderstatus = 'F'")
        .select(order_key().alias("dedup_key"))
        .distinct()
    )
    return stage(store, "order-seen")


def order_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("o_custkey") % 50
    at = F.date_add(F.lit("1997-01-01").cast("date"), (F.col("n") * 30).cast("int")).cast("timestamp")
    sites = table(spark, sf_dir, "orders").select(number.alias("n")).distinct()
    health = sites.select(
        F.format_string("site-%02d", "n").alias("site_name"),
        F.when(F.col("n") % 6 != 0, at + F.expr("interval 12 hours")).alias("last_success_at"),
    )
    return stage(health, "order-health")


def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs from ``events``: a site per user, a run per day, purchases as postings found."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(
            F.concat(F.lit("site-"), F.col("user_id").cast("string")).alias("site_name"),
            F.date_trunc("day", "ts").alias("run_at"),
        )
        .agg(F.count_if(F.col("event_type") == "purchase").alias("job_count"))
    )


# Model replies built from ``pages`` (extraction) and ``documents`` (matching).

def extraction_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0 to 64 postings per reply; some fenced, some cut off, some followed by other text."""
    n = F.col("page_id")

    def job(i: Column) -> Column:
        key = n * 100 + i
        return F.concat(
            F.format_string('{"title": "Role %d"', key),
            F.when(
                i % 5 != 0,
                F.concat(F.lit(', "url": "/jobs/'), key.cast("string"), F.lit('"')),
            ).otherwise(F.lit(', "url": ""')),
            F.when(i % 3 == 0, F.concat(F.lit(', "job_id": '), key.cast("string")))
            .when(i % 3 == 1, F.lit(', "job_id": null'))
            .otherwise(F.lit("")),
            F.when(i % 4 == 0, F.lit(', "posted_date": "2024-01-1'))
            .when(i % 4 == 1, F.lit(', "posted_date": "soon 1'))
            .otherwise(F.lit(', "posted_date": "2024020')),
            (i % 10).cast("string"),
            F.lit('", "posted_time": "'),
            F.when(i % 2 == 0, "09:15").otherwise("25:00"),
            F.lit('"'),
            F.when(i % 6 == 0, F.lit(', "description": null')).otherwise(
                F.when(i % 6 == 1, F.lit("")).otherwise(F.lit(', "description": "text"'))
            ),
            F.lit("}"),
        )

    count = (n % 65).cast("int")
    jobs = F.transform(
        F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(
            F.array().cast("array<int>")
        ),
        lambda i: job(i.cast("bigint")),
    )
    body = F.concat(F.lit('{"jobs": ['), F.array_join(jobs, ", "), F.lit("]}"))
    text = (
        F.when(n % 9 == 4, F.concat(F.lit("```json\n"), body, F.lit("\n```\n")))
        .when(n % 9 == 5, F.concat(body, F.lit(" I hope this helps.")))
        .when(n % 9 == 6, F.concat(F.lit('{"jobs": [{"title": "cut'), n.cast("string")))
        .otherwise(body)
    )
    return table(spark, sf_dir, "pages").select(
        n.cast("string").alias("request_id"),
        site_of(F.col("url")).alias("site_name"),
        "url",
        text.alias("text"),
        F.length("url").cast("bigint").alias("input_tokens"),
        (n % 65 * 40).alias("output_tokens"),
    )


def match_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One match reply per document; known, unknown and missing profiles and scores."""
    n = F.col("doc_id")
    name = F.format_string("profile_%05d.md", n % 50)
    second = F.format_string("profile_%05d.md", (n * 7) % 60)
    body = F.concat(
        F.lit('{"best_resume_filename": "'),
        name,
        F.lit('"'),
        F.when(n % 8 == 1, "")
        .when(n % 8 == 2, F.lit(', "best_score": null'))
        .when(n % 8 == 3, F.lit(', "best_score": "high"'))
        .otherwise(F.format_string(', "best_score": 0.%02d', n % 100)),
        F.format_string(', "match_reason": "reason %d"', n),
        F.when(n % 5 == 0, "").otherwise(
            F.concat(F.lit(', "missing_keywords": ["k'), (n % 10).cast("string"), F.lit('", "sql"]'))
        ),
        F.when(n % 6 == 0, F.lit(', "runner_up_filename": null')).otherwise(
            F.concat(F.lit(', "runner_up_filename": "'), second, F.lit('"'))
        ),
        F.when(n % 7 == 0, F.lit(', "runner_up_score": null')).otherwise(
            F.format_string(', "runner_up_score": 0.%02d', n % 50)
        ),
        F.lit("}"),
    )
    text = (
        F.when(n % 11 == 3, F.concat(F.lit("```\n"), body, F.lit("\n```")))
        .when(n % 11 == 4, F.concat(body, F.lit("}")))
        .when(n % 11 == 5, F.substring(body, 1, 40))
        .otherwise(body)
    )
    return table(spark, sf_dir, "documents").select(
        n.cast("string").alias("dedup_key"),
        text.alias("text"),
        F.length("text").cast("bigint").alias("input_tokens"),
        (n % 90 + 10).alias("output_tokens"),
    )


def reported_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches to report, one per page, in site order."""
    n = F.col("page_id")
    pages = numbered_pages(spark, sf_dir)
    orders = targets_raw(spark, sf_dir).select(F.col("name").alias("site_name"), "site_ord")
    return (
        pages.join(orders, "site_name")
        .select(
            F.col("site_name").alias("company"),
            "site_ord",
            "page_num",
            F.lit(0).alias("pos"),
            F.concat(F.lit("Role "), number_in_url(F.col("url"))).alias("title"),
            F.format_string("Profile %05d", n % 40).alias("best_label"),
            (F.lit(0.7) + (n * 37 % 300) / 1000).alias("best_score"),
            F.format_string("shares %d terms", n % 50).alias("match_reason"),
            F.when(
                n % 3 == 1, F.array(F.lit("spark"), F.concat(F.lit("k"), n.cast("string")))
            )
            .otherwise(F.array().cast("array<string>"))
            .alias("missing_keywords"),
            F.when(n % 5 != 1, F.format_string("Profile %05d", n % 30)).alias("runner_up_label"),
            F.when(n % 7 != 1, (n * 13 % 700) / 1000).alias("runner_up_score"),
            "url",
        )
    )
