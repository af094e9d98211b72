"""From targets and captures to clean page text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_clean, html_title
from ..functions.urls import page_url
from ..functions.values import estimated_tokens
from ..sources.captures import FLAG, answered, rendered

TOKEN_BUDGET = 150_000  # fixed value: estimated tokens of one page
PAGE_RANGE = 1024  # page numbers generated per row


def page_count() -> Column:
    """Pages a target may have: one without a pagination parameter."""
    return F.when(F.col("pagination_param").isNull(), F.lit(1)).otherwise(F.col("max_pages"))


def page_offsets(targets: DataFrame) -> DataFrame:
    """Every page a run may visit, with its offset and URL.

    Page numbers are generated by ranges, so a very high limit never becomes one large array.
    """
    last = page_count() - 1
    rows = (
        targets.filter(last >= 0)
        .withColumn("range", F.explode(F.sequence(F.lit(0), last, F.lit(PAGE_RANGE))))
        .withColumn(
            "page_num",
            F.explode(
                F.sequence(F.col("range"), F.least(last, F.col("range") + (PAGE_RANGE - 1)))
            ),
        )
        .drop("range")
        .withColumn("page_offset", F.col("page_num") * F.col("pagination_step"))
    )
    return rows.withColumn(
        "page_url",
        F.when(F.col("pagination_param").isNull(), F.col("url")).otherwise(
            page_url(F.col("url"), F.col("pagination_param"), F.col("page_offset"))
        ),
    )


def in_scope(captures: DataFrame, targets: DataFrame) -> DataFrame:
    """Captures below their target's page limit, with the target's order and tier.

    The only join of wide rows with the site list. The list is a small table of known size, so
    Spark broadcasts it; a very long list is shuffled, and a site with a large share of all
    captures is then split by adaptive skew handling.
    """
    keep = [c for c in ("site_ord", "scrape_tier") if c in targets.columns]
    scope = targets.select(F.col("name").alias("site_name"), *keep, page_count().alias("page_limit"))
    return (
        captures.join(scope, "site_name")
        .filter(F.col("page_num") < F.col("page_limit"))
        .drop("page_limit")
    )


def page_limit(pages: DataFrame, targets: DataFrame) -> DataFrame:
    """Captured pages below their target's page limit."""
    return in_scope(pages, targets).select(*pages.columns)


def tier_fallback(captures: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """The capture to use per page: http first where the target says so, else the browser's.

    ``targets`` may be left out for captures from ``in_scope``. Rows of the first tier flow
    through without a shuffle; only the fallback tier is compared, by page, with the pages the
    first tier answered, which are found by their status and read no HTML. Captures in buckets by page
    (``sources.captures.write_bucketed``) are compared where they are.
    """
    if targets is not None:
        tiers = targets.select(F.col("name").alias("site_name"), "scrape_tier")
        captures = captures.join(tiers, "site_name")
    first = captures.filter((F.col("scrape_tier") == "http") & (F.col("tier") == "http") & answered())
    second = captures.filter((F.col("tier") == "playwright") & rendered(captures)).join(
        first.select("site_name", "page_num"), ["site_name", "page_num"], "left_anti"
    )
    return (
        first.withColumn("html", F.coalesce("html", F.lit("")))
        .unionByName(second)
        .withColumnRenamed("tier", "tier_used")
        .drop("scrape_tier", "status", FLAG)
    )


def page_text(chosen: DataFrame) -> DataFrame:
    """Title and clean text instead of the HTML."""
    return chosen.select(
        *[c for c in chosen.columns if c != "html"],
        html_title(F.col("html")).alias("title"),
        html_clean(F.col("html")).alias("text"),
    )


def in_budget(text: Column, budget: int = TOKEN_BUDGET) -> Column:
    return (text != "") & (estimated_tokens(text) <= budget)


def token_budget(pages: DataFrame, budget: int = TOKEN_BUDGET) -> DataFrame:
    """Drop empty pages and pages above the budget; they yield nothing and cost nothing.

    The test goes through a generator: as a plain filter it would be moved below the projection
    that cleans the HTML, and the cleaning would run once more for it.
    """
    kept = F.filter(F.array("text"), lambda text: in_budget(text, budget))
    return pages.withColumn("text", F.explode(kept))
