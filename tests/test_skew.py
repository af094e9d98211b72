"""A site or key with a large share of all rows is split by Spark, not gathered in one task."""

import contextlib

import pytest
from pyspark.sql import functions as F

from tidemark.operators import capture
from tidemark.operators import incremental as inc
from tidemark.sources.staging import stage

SMALL_SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
}


@contextlib.contextmanager
def settings(spark, values):
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def pages(spark):
    """24,000 pages, half of them of one site, with one stop and one failure there."""
    n = F.col("id")
    site = F.when(n < 12_000, "hot").otherwise(F.concat(F.lit("s"), (n % 400).cast("string")))
    rows = spark.range(0, 24_000, numPartitions=16).select(
        site.alias("site_name"), n.cast("int").alias("page_num"),
        F.sha2(n.cast("string"), 512).alias("payload"),
        (n == 11_000).alias("stop"), (n == 11_500).alias("failed"),
    )
    return stage(rows, "skew-pages")


def test_hot_site_in_the_visited_cut(spark, pages):
    with settings(spark, SMALL_SKEW):
        visited = inc.visited_pages(pages)
        assert "skew=true" in final_plan(visited)
        assert visited.filter("site_name = 'hot'").count() == 11_001
        assert visited.filter("site_name <> 'hot'").count() == 12_000


def test_hot_site_in_the_page_limit(spark, pages):
    targets = stage(
        pages.select(F.col("site_name").alias("name")).distinct().select(
            "name", F.lit("p").alias("pagination_param"), F.lit(20_000).alias("max_pages"),
        ),
        "skew-targets",
    )
    with settings(spark, SMALL_SKEW):
        kept = capture.page_limit(pages, targets)
        assert "skew=true" in final_plan(kept)
        assert kept.count() == 20_000


def test_hot_key_against_the_store(spark, pages):
    keyed = stage(pages.select(F.col("site_name").alias("dedup_key"), "payload"), "skew-keys")
    store = stage(spark.createDataFrame([("s1",), ("s2",)], "dedup_key string"), "skew-store")
    with settings(spark, SMALL_SKEW):
        new = inc.new_postings(keyed, store)
        assert "skew=true" in final_plan(new)
        assert new.count() == 24_000 - 60
