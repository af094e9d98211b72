"""Page captures: one row per site, page and tier, with the outcome of the attempt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas


FLAG = "has_page"


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Captures, with the flag whether there is HTML where ``write_captures`` has written it."""
    flag = f", {FLAG} boolean" if FLAG in spark.read.parquet(path).columns else ""
    return spark.read.schema(schemas.CAPTURES + flag).parquet(path)


def _flagged(captures: DataFrame) -> DataFrame:
    return captures.withColumn(FLAG, F.col("html").isNotNull())


def write_captures(captures: DataFrame, path: str) -> None:
    """One folder per tier, so that a step that needs one tier reads no page of the other."""
    _flagged(captures).write.partitionBy("tier").mode("append").parquet(path)


def write_bucketed(captures: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """A catalog table with the pages of a site and number in one bucket: what compares tiers by page shuffles no HTML."""
    writer = _flagged(captures).write.partitionBy("tier").bucketBy(buckets, "site_name", "page_num").sortBy("site_name", "page_num")
    (writer.option("path", path) if path else writer).mode("append").format("parquet").saveAsTable(table)


def answered() -> Column:
    """Whether the first tier has its page: by its status alone, so that looking it up reads no HTML."""
    return F.col("status").between(200, 299)


def rendered(captures: DataFrame) -> Column:
    """Whether the browser has its page: it shows what it gets whatever the status, and nothing when it fails. Read from the
    flag of stored captures, so that looking it up reads no HTML either."""
    return F.col(FLAG) if FLAG in captures.columns else F.col("html").isNotNull()


def capture_status(captures: DataFrame) -> DataFrame:
    """The HTML of attempts that have one, if only an empty one, else NULL and a reason.

    The first tier needs a 2xx status, the browser tier a page. The capture table writes a timeout as status 0 and
    a connection error as status -1 or NULL; a browser attempt without a page and with another status is an error of
    the browser.
    """
    status, browser = F.col("status"), F.col("tier") == "playwright"
    ok = F.coalesce(F.when(browser, rendered(captures)).otherwise(answered()), F.lit(False))
    reason = (
        F.when(ok, F.lit(None).cast("string"))
        .when(status == 0, "timeout")
        .when(status.isNull() | (status < 0), "connection error")
        .when(browser, "browser error")
        .otherwise(F.concat(F.lit("HTTP "), status.cast("string")))
    )
    html = F.when(ok, F.coalesce("html", F.lit("")))
    return captures.withColumns({"reason": reason, "html": html})


def tier_recommend(captures: DataFrame) -> DataFrame:
    """Per site: http if that tier answered 200, else playwright above 200 characters."""
    http_ok = (F.col("tier") == "http") & (F.col("status") == 200)
    browser_ok = (F.col("tier") == "playwright") & (F.length("html") > 200)
    return (
        captures.groupBy("site_name")
        .agg(F.max(F.coalesce(http_ok, F.lit(False))).alias("http_ok"),
             F.max(F.coalesce(browser_ok, F.lit(False))).alias("browser_ok"))
        .select(
            "site_name",
            F.when(F.col("http_ok"), "http")
            .when(F.col("browser_ok"), "playwright")
            .otherwise("failed")
            .alias("recommended_tier"),
        )
    )
