"""What is new, how far back a site is read, and what the two stores hold afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import posted_at
from ..sources.staging import stage

POSTING_ORDER = ["site_ord", "page_num", "pos"]
STALE_AFTER = 3  # fixed value: runs in a row without a posting


def known_keys(postings: DataFrame, seen: DataFrame) -> DataFrame:
    """Keys of these postings that the store holds: at most as many as there are postings.

    The store is the left side of a semi join, so it is only scanned (one column) and never
    shuffled while the run's keys are small enough to broadcast, however large it has grown.
    """
    keys = postings.select("dedup_key").distinct()
    return seen.select("dedup_key").join(keys, "dedup_key", "left_semi")


def new_postings(postings: DataFrame, seen: DataFrame) -> DataFrame:
    """Postings whose key the store does not hold."""
    return postings.join(seen.select("dedup_key"), "dedup_key", "left_anti")


def seen_postings(postings: DataFrame, seen: DataFrame) -> DataFrame:
    return postings.join(seen.select("dedup_key"), "dedup_key", "left_semi")


def first_occurrence(
    postings: DataFrame, keys: list[str] | None = None, order: list[str] | None = None
) -> DataFrame:
    """Keep the first posting of each key in run order.

    The rank filter is applied before the shuffle as well, so each task sends at most one row per
    key and a key that holds a large share of all rows never gathers in one task.
    """
    window = Window.partitionBy(*(keys or ["dedup_key"])).orderBy(*(order or POSTING_ORDER))
    return postings.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")


def new_first_occurrence(postings: DataFrame, seen: DataFrame) -> DataFrame:
    """New postings of a run, one per key: duplicates go first, so that frequent keys are down to
    one row before they meet the store."""
    return new_postings(first_occurrence(postings), seen)


def page_newness(postings: DataFrame, seen: DataFrame) -> DataFrame:
    """New postings per page: not in the store and first of their key within the site."""
    first_pages = postings.groupBy("site_name", "dedup_key").agg(
        F.min("page_num").alias("page_num")
    )
    return (
        new_postings(first_pages, seen)
        .groupBy("site_name", "page_num")
        .agg(F.count("*").alias("new_jobs"))
    )


def page_stats(pages: DataFrame, postings: DataFrame, seen: DataFrame) -> DataFrame:
    """Per page: postings, new postings, presence and maxima of dates; empty pages survive."""
    stamp = posted_at(F.col("posted_date"), F.col("posted_time"))
    stats = postings.groupBy("site_name", "page_num").agg(
        F.count("*").alias("jobs"),
        F.max(F.col("posted_date").isNotNull()).alias("has_date"),
        F.max(F.col("posted_time").isNotNull()).alias("has_time"),
        F.max(stamp).alias("newest_at"),
        F.max("posted_date").alias("newest_date"),
    )
    page = ["site_name", "page_num"]
    joined = pages.join(stats, page, "left").join(page_newness(postings, seen), page, "left")
    return joined.withColumns(
        {
            "jobs": F.coalesce("jobs", F.lit(0)),
            "new_jobs": F.coalesce("new_jobs", F.lit(0)),
            "has_date": F.coalesce("has_date", F.lit(False)),
            "has_time": F.coalesce("has_time", F.lit(False)),
        }
    )


def stop_after(last_run: Column) -> Column:
    """Whether the page just read is the last one worth reading, from its ``page_stats``.

    No posting stops; no earlier run goes on; otherwise the newest time stamp, else the newest
    date (one day of slack), else the absence of new postings decides.
    """
    cutoff = F.to_date(last_run - F.expr("interval 1 day"))
    return (
        F.when(F.col("jobs") == 0, True)
        .when(last_run.isNull(), False)
        .when(F.col("newest_at").isNotNull(), F.col("newest_at") < last_run)
        .when(F.col("has_date"), F.col("newest_date") < cutoff)
        .otherwise(F.col("new_jobs") == 0)
    )


def freshness_stop(stats: DataFrame, health: DataFrame) -> DataFrame:
    """Add ``last_run`` and ``stop`` to page statistics."""
    runs = health.select("site_name", F.col("last_success_at").alias("last_run"))
    return stats.join(runs, "site_name", "left").withColumn("stop", stop_after(F.col("last_run")))


def site_cuts(pages: DataFrame) -> DataFrame:
    """Per site: the first page that stops, the first that failed, and failure of the start."""
    return pages.groupBy("site_name").agg(
        F.min(F.when(F.col("stop") & ~F.col("failed"), F.col("page_num"))).alias("stop_page"),
        F.min(F.when(F.col("failed"), F.col("page_num"))).alias("fail_page"),
    )


def visited_pages(pages: DataFrame) -> DataFrame:
    """Pages up to and including the first stop and before the first failure.

    ``pages`` needs ``stop`` and ``failed``. The cuts are a partial aggregate, written as a table
    of one row per site: its size is known to the join back, and a site with a large share of all
    pages is neither gathered nor sorted in one task.
    """
    return (
        pages.join(stage(site_cuts(pages), "cuts"), "site_name")
        .filter(
            (F.col("stop_page").isNull() | (F.col("page_num") <= F.col("stop_page")))
            & (F.col("fail_page").isNull() | (F.col("page_num") < F.col("fail_page")))
        )
        .drop("stop_page", "fail_page")
    )


def seen_rows(new: DataFrame, scores: DataFrame, run_at: Column) -> DataFrame:
    """Store rows for a run's new postings; the score is NULL where there is no result."""
    return new.join(
        scores.select("dedup_key", F.col("best_score").alias("match_score")), "dedup_key", "left"
    ).select(
        "dedup_key",
        "dedup_type",
        "title",
        "url",
        "company",
        "match_score",
        run_at.alias("seen_at"),
    )


def seen_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Whole store after a run: new rows win over stored rows of the same key.

    ``sources.stores.append_seen`` is the incremental form for rows known to be new.
    """
    return old.join(new.select("dedup_key"), "dedup_key", "left_anti").unionByName(new)


def health_upsert(old: DataFrame, counts: DataFrame, run_at: Column) -> DataFrame:
    """Zero counters and last successes after a run with ``counts(site_name, job_count)``.

    A success resets the counter and sets the time; a zero adds one and keeps the old time; sites
    that took no part are carried over unchanged.
    """
    success = F.col("job_count") > 0
    zeros = F.coalesce("consecutive_zeros", F.lit(0))
    return old.join(counts, "site_name", "full_outer").select(
        "site_name",
        F.when(F.col("job_count").isNull(), zeros)
        .when(success, F.lit(0))
        .otherwise(zeros + 1)
        .alias("consecutive_zeros"),
        F.when(success, run_at).otherwise(F.col("last_success_at")).alias("last_success_at"),
    )


def streak_days(runs: DataFrame) -> DataFrame:
    """(site_name, day, last_success_at, zeros) of a run history: the last success of a day, and the runs without one after it."""
    ok = F.col("job_count") > 0
    daily = runs.groupBy("site_name", F.to_date("run_at").alias("day")).agg(
        F.max(F.when(ok, F.col("run_at"))).alias("last_success_at"),
        F.collect_list(F.col("run_at")).alias("times"),
    )
    after = F.filter("times", lambda t: F.col("last_success_at").isNull() | (t > F.col("last_success_at")))
    return daily.select("site_name", "day", "last_success_at", F.size(after).alias("zeros"))


def zero_streak(runs: DataFrame) -> DataFrame:
    """Per site, from a run history: runs since the last success (zero runs), and that success.

    History is read once. Days are mergeable: of two spans, one before the other, the later one's success ends the
    streak of the earlier. A task folds the days of a site, which are as many as the calendar has, not its runs.
    """
    days = F.array_sort(F.collect_list(F.struct("day", "last_success_at", "zeros")))
    start = F.struct(F.lit(0).alias("zeros"), F.lit(None).cast("timestamp").alias("last_success_at"))

    def later(state: Column, day: Column) -> Column:
        carried = F.when(day["last_success_at"].isNull(), state["zeros"]).otherwise(F.lit(0))
        return F.struct(
            (carried + day["zeros"]).alias("zeros"),
            F.coalesce(day["last_success_at"], state["last_success_at"]).alias("last_success_at"),
        )

    folded = streak_days(runs).groupBy("site_name").agg(F.aggregate(days, start, later).alias("s"))
    return folded.select("site_name", F.col("s.zeros").alias("consecutive_zeros"), F.col("s.last_success_at").alias("last_success_at"))


def health_state(old: DataFrame, runs: DataFrame) -> DataFrame:
    """(site_name, run_at, job_count) that decide a site's health, from the same of before and runs that came since.

    A site keeps its last success and the runs without one after it: a late success drops those it follows, a
    late zero before the last success is dropped itself. However long a history is, what it keeps is the
    streak. Runs that come twice are one.
    """
    both = old.unionByName(runs.select(*old.columns)).distinct()
    last = both.groupBy("site_name").agg(F.max(F.when(F.col("job_count") > 0, F.col("run_at"))).alias("last"))
    return both.join(last, "site_name").where("last IS NULL OR run_at >= last").drop("last")


def stale_sites(health: DataFrame, after: int = STALE_AFTER) -> DataFrame:
    """Sites without a posting for several runs, with their warning."""
    return health.filter(F.col("consecutive_zeros") >= after).select(
        "site_name",
        "consecutive_zeros",
        F.format_string(
            "\n⚠️ %s has returned 0 jobs for %d consecutive runs — scraper may need updating",
            "site_name",
            "consecutive_zeros",
        ).alias("warning"),
    )
