"""Site list: nested, optional pagination settings; tier check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas

# Capture tiers and pagination defaults.
TIERS = ("http", "playwright")
DEFAULT_STEP = 20
DEFAULT_MAX_PAGES = 5


def read_targets_raw(spark: SparkSession, path: str) -> DataFrame:
    """Site entries from JSON lines, parquet or a hand-written YAML file with a ``sites`` list.

    The site order is the place in the YAML list; tables bring it as ``site_ord``, and where they
    do not a hash of the name stands in.
    """
    if path.endswith((".yaml", ".yml")):
        import yaml  # optional: only this format needs it

        text = spark.read.text(path, wholetext=True).first()["value"]
        sites = (yaml.safe_load(text) or {}).get("sites") or []
        rows = [
            (i, s["name"], s["url"], s["scrape_tier"], _settings(s.get("pagination")))
            for i, s in enumerate(sites)
        ]
        return spark.createDataFrame(rows, f"site_ord bigint, {schemas.TARGETS_RAW}")
    reader = spark.read.schema(f"site_ord bigint, {schemas.TARGETS_RAW}")
    rows = reader.parquet(path) if path.rstrip("/").endswith(".parquet") else reader.json(path)
    return rows.withColumn("site_ord", F.coalesce("site_ord", F.xxhash64("name")))


def _settings(block: dict | None):
    return (block.get("param"), block.get("step"), block.get("max_pages")) if block else None


def site_targets(raw: DataFrame) -> DataFrame:
    """Flatten the pagination block; absent, null and partial blocks get the defaults."""
    keep = ["site_ord"] if "site_ord" in raw.columns else []
    return raw.select(
        *keep,
        "name",
        "url",
        "scrape_tier",
        F.col("pagination.param").alias("pagination_param"),
        F.coalesce("pagination.step", F.lit(DEFAULT_STEP)).alias("pagination_step"),
        F.coalesce("pagination.max_pages", F.lit(DEFAULT_MAX_PAGES)).alias("max_pages"),
    )


def valid_targets(raw: DataFrame) -> DataFrame:
    return raw.filter(F.col("scrape_tier").isin(*TIERS))


def _repeated(raw: DataFrame, key: Column, label: str) -> DataFrame:
    counted = raw.groupBy(key.alias("name")).agg(F.count("*").alias("n")).filter("n > 1")
    return counted.select("name", F.format_string(f"{label} used %d times", "n").alias("problem"))


def refused(raw: DataFrame) -> DataFrame:
    """Entries that no run can use: an unknown tier, or a name that stands twice."""
    bad_tier = raw.filter(
        F.col("scrape_tier").isNull() | ~F.col("scrape_tier").isin(*TIERS)
    ).select(
        "name",
        F.format_string(
            "Invalid scrape_tier '%s' for site '%s'. Must be one of: ['http', 'playwright']",
            "scrape_tier",
            "name",
        ).alias("problem"),
    )

    return bad_tier.unionByName(_repeated(raw, F.col("name"), "name"))


def invalid_targets(raw: DataFrame) -> DataFrame:
    """Entries that are refused, and URL hosts used more than once."""
    host = F.regexp_extract("url", r"//([^/?#]+)", 1)
    return refused(raw).unionByName(_repeated(raw, host, "host"))


def require_sites(targets: DataFrame) -> DataFrame:
    """An empty site list is an error."""
    if targets.isEmpty():
        raise ValueError("targets list is empty: add at least one site")
    return targets
