"""From page text, anchors or model replies to postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markup import listed_items
from ..functions.text import ANY_TAG, html_clean, html_title, let, strip, strip_fences, unescape
from ..functions.urls import resolve_url
from ..functions.values import (
    dedup_key,
    dedup_type,
    parse_date,
    parse_time,
    usage_cost,
)

MAX_POSTINGS = 50  # fixed value: postings taken from one page
# An anchor ends at its closing tag, at the next anchor or with the page; attributes before ``href`` hold no tags.
ANCHOR = (
    r"(?is)<a\s(?:[^<>]*?[\s\"'/])?href\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>]+)[^<>]*>"
    r"[^<]*+(?:<(?!/?a[\s/>])[^<]*+)*+"
)
HREF = r"(?is)^<a\s(?:[^<>]*?[\s\"'/])?href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+))"
DATE_LINE = r"(?m)^datePosted: (\S+)"
ISO_STAMP = r"(?m)^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}(?::\d{2})?)"


def with_keys(postings: DataFrame) -> DataFrame:
    return postings.withColumn("dedup_key", dedup_key(F.col("job_id"), F.col("url"))).withColumn(
        "dedup_type", dedup_type(F.col("job_id"))
    )


def extract_input(company: Column, url: Column, text: Column) -> Column:
    return F.concat(
        F.lit("Company: "), company, F.lit("\nSite URL: "), url, F.lit("\n\n"), text
    )


def extract_postings(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Rule-based reading of a detail page: one posting per page, straight from its text.

    The numeric part of the URL path is the ID; the date comes from a JSON-LD date line or an
    ISO time stamp in the text, the clock time from the stamp only.
    """
    stamp_day = F.nullif(F.regexp_extract("text", ISO_STAMP, 1), F.lit(""))
    day = F.coalesce(F.nullif(F.regexp_extract("text", DATE_LINE, 1), F.lit("")), stamp_day)
    clock = F.nullif(F.regexp_extract("text", ISO_STAMP, 2), F.lit(""))
    keep = [*(keep or []), *(c for c in ("site_ord", "page_id") if c in pages.columns)]
    postings = pages.select(
        *keep,
        "site_name",
        "page_num",
        F.col("pos") if "pos" in pages.columns else F.lit(0).alias("pos"),
        "title",
        "url",
        F.col("site_name").alias("company"),
        F.col("text").alias("description"),
        F.nullif(F.regexp_extract("url", r"/(\d+)", 1), F.lit("")).alias("job_id"),
        parse_date(day).alias("posted_date"),
        parse_time(clock).alias("posted_time"),
    )
    return with_keys(postings)


def listing_postings(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """A posting for each item of a listing page, in page order; a page without a listing is one posting.

    Items are children of one element that look alike and have links of their own (``functions.markup.page_items``): the link
    is the posting's URL, dates and the ID are read from the item as from a detail page.
    """
    items = pages.withColumn("items", listed_items(F.col("html")))
    single = F.array(F.struct(F.lit("").alias("href"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("text")))
    each = items.select(
        *[F.col(c) for c in pages.columns], F.posexplode(F.when(F.size("items") > 0, F.col("items")).otherwise(single)).alias("pos", "item")
    )
    whole = F.col("item.text").isNull()
    read = each.withColumns(
        {
            "title": F.when(whole, html_title(F.col("html"))).otherwise(F.col("item.title")),
            "text": F.when(whole, html_clean(F.when(whole, F.col("html")))).otherwise(F.col("item.text")),
            "url": F.when(whole, F.col("url")).otherwise(resolve_url(F.col("item.href"), F.col("url"))),
        }
    )
    return extract_postings(read.drop("html", "item"), keep)


def link_postings(pages: DataFrame) -> DataFrame:
    """Every anchor of a page with its text and absolute URL, in page order."""

    def link(anchor: Column) -> Column:
        href = F.concat(*[F.regexp_extract(anchor, HREF, i) for i in (1, 2, 3)])
        return F.struct(
            unescape(href).alias("href"),
            strip(unescape(F.regexp_replace(anchor, ANY_TAG, ""))).alias("title"),
        )

    keep = [c for c in pages.columns if c != "html"]
    anchors = F.regexp_extract_all(F.col("html"), F.lit(ANCHOR), F.lit(0))
    return (
        pages.select(*keep, F.posexplode(anchors).alias("pos", "anchor"))
        .withColumn("link", link(F.col("anchor")))
        .select(
            *[c for c in keep if c != "url"],
            "pos",
            "link.title",
            resolve_url(F.col("link.href"), F.col("url")).alias("url"),
        )
    )


def reply_jobs(text: Column) -> Column:
    """The ``jobs`` array of a reply as string maps, NULL when the reply is not valid JSON.

    Maps keep a missing key apart from an explicit null. Reading the reply as the only element of
    an array makes text after the object an error, as it is for a strict reader.
    """
    wrapped = F.concat(F.lit("["), strip_fences(text), F.lit("]"))
    parsed = F.from_json(
        wrapped,
        "array<struct<jobs:array<map<string,string>>>>",
        {"allowSingleQuotes": "false"},
    )
    return let(parsed, lambda a: F.when(F.size(a) == 1, F.element_at(a, 1)["jobs"]))


def cap_postings(jobs: Column, most: int = MAX_POSTINGS) -> Column:
    """First postings of a page in reply order, cut before the array becomes rows."""
    return F.slice(jobs, 1, most)


def parse_postings(replies: DataFrame, most: int | None = None) -> DataFrame:
    """Reply text to raw postings, in reply order; invalid replies yield no rows.

    ``most`` keeps the first postings of a reply only; by default all are read.
    """
    jobs = reply_jobs(F.col("text"))
    keep = [c for c in replies.columns if c not in ("text", "input_tokens", "output_tokens")]
    return replies.select(
        *keep, F.posexplode(jobs if most is None else cap_postings(jobs, most)).alias("pos", "job")
    )


def posting_projection(raw: DataFrame, company: str = "site_name", base: str = "url") -> DataFrame:
    """Typed posting from a raw one: defaults, absolute URL, dates, key; company = site name."""
    job = F.col("job")

    def text_or_empty(name: str) -> Column:
        return F.when(F.map_contains_key(job, name), job[name]).otherwise(F.lit(""))

    keep = [c for c in ("request_id", "site_ord", "page_id", "site_name", "page_num") if c in raw.columns]
    postings = raw.select(
        *keep,
        "pos",
        text_or_empty("title").alias("title"),
        resolve_url(job["url"], F.col(base)).alias("url"),
        F.col(company).alias("company"),
        text_or_empty("description").alias("description"),
        text_or_empty("snippet").alias("snippet"),
        F.nullif(job["job_id"], F.lit("")).alias("job_id"),
        parse_date(job["posted_date"]).alias("posted_date"),
        parse_time(job["posted_time"]).alias("posted_time"),
        job["location"].alias("location"),
    )
    return with_keys(postings)


def extraction_cost(replies: DataFrame) -> DataFrame:
    """Cost per reply; a reply that cannot be read is reported as free."""
    paid = usage_cost("extract", F.col("input_tokens"), F.col("output_tokens"))
    return replies.withColumn(
        "cost_usd", F.when(is_json_object(F.col("text")), paid).otherwise(F.lit(0.0))
    )


def is_json_object(text: Column) -> Column:
    wrapped = F.concat(F.lit("["), strip_fences(text), F.lit("]"))
    parsed = F.from_json(wrapped, "array<map<string,string>>", {"allowSingleQuotes": "false"})
    return F.coalesce((F.size(parsed) == 1) & F.element_at(parsed, 1).isNotNull(), F.lit(False))
