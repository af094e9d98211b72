"""Rows that a step cannot use, beside the rows it can: found = kept + quarantined, at every step.

A step tags its rows with a reason, NULL where there is none, in the pass that reads them; results and quarantine are
two readings of the tagged rows. Quarantined rows of all steps have one layout: where they come from, the step and
the reason. Nothing in here raises: what would end a site in a program that reads row by row is a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Steps, reasons and which of the reasons are errors that somebody has to look at.
CAPTURE, REQUEST, EXTRACT, MATCH = "capture", "request", "extract", "match"
NO_CAPTURE = "no usable capture"
EMPTY_PAGE, LONG_PAGE = "empty page", "above the token budget"
NO_REPLY, BAD_REPLY = "no reply", "unreadable reply"
BEYOND_CAP = "beyond the cap"
BAD_SCORE, UNKNOWN_PROFILE = "bad score", "unknown profile"
UNEXPECTED = (BAD_SCORE,)
COLUMNS = ["site_name", "page_num", "pos", "step", "reason"]


def tagged(rows: DataFrame, *rules: tuple[Column, str]) -> DataFrame:
    """``rows`` with the reason of the first rule that holds, NULL where none does."""
    reason = F.lit(None).cast("string")
    for holds, why in reversed(rules):
        reason = F.when(F.coalesce(holds, F.lit(False)), F.lit(why)).otherwise(reason)
    return rows.withColumn("reason", reason)


def kept(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("reason").isNull()).drop("reason")


def held(rows: DataFrame, step: str) -> DataFrame:
    """Quarantined rows of a step; a page has no position."""
    pos = F.col("pos").cast("int") if "pos" in rows.columns else F.lit(None).cast("int")
    found = rows.where(F.col("reason").isNotNull())
    return found.select("site_name", F.col("page_num").cast("int").alias("page_num"), pos.alias("pos"), F.lit(step).alias("step"), "reason")


def counts(quarantined: DataFrame) -> DataFrame:
    return quarantined.groupBy("step", "reason").agg(F.count("*").alias("n"))


def unexpected(quarantined: DataFrame) -> DataFrame:
    """Errors of a site (site_name, error_type, error) that deserve an alert: not pages that failed to load, which are
    part of the site's result, nor replies that are skipped."""
    bad = quarantined.where(F.col("reason").isin(*UNEXPECTED)).groupBy("site_name", "reason").agg(F.count("*").alias("n"))
    text = F.format_string("%d posting(s) with a score that is null or not a number", "n")
    return bad.select("site_name", F.lit("ValueError").alias("error_type"), text.alias("error"))
