"""New postings, freshness, visited pages and the two stores."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import incremental as inc
from tidemark.sources import schemas, stores

D = datetime.date
LAST_RUN = datetime.datetime(2024, 1, 15, 12, 0)
POSTINGS = "site_name string, page_num int, pos int, dedup_key string, posted_date date, posted_time string"

# (dates and times on the page), new postings, last run known -> stop
FRESHNESS = [
    ([], 0, True, True),
    ([], 0, False, True),
    ([(D(2020, 1, 1), None)], 0, False, False),
    ([(D(2024, 1, 14), "08:00:00"), (D(2024, 1, 15), "10:00:00")], 0, True, True),
    ([(D(2024, 1, 15), "14:00:00"), (D(2024, 1, 14), "08:00:00")], 0, True, False),
    ([(D(2024, 1, 15), "11:59:59")], 0, True, True),
    ([(D(2024, 1, 15), "12:00:00")], 0, True, False),
    ([(D(2024, 1, 13), None), (D(2024, 1, 12), None)], 0, True, True),
    ([(D(2024, 1, 14), None)], 0, True, False),
    ([(D(2024, 1, 15), None)], 0, True, False),
    ([(D(2024, 1, 10), None), (D(2024, 1, 14), None)], 0, True, False),
    ([(None, None)], 0, True, True),
    ([(None, None)] * 3, 3, True, False),
    # a time without a date decides nothing
    ([(None, "09:00:00")], 0, True, True),
    ([(None, "09:00:00"), (D(2024, 1, 14), None)], 0, True, False),
    # an undated posting next to a stamped one is ignored
    ([(None, None), (D(2024, 1, 14), "08:00:00")], 2, True, True),
]


def test_freshness_table(spark):
    pages, postings, seen, health = [], [], [], []
    for i, (dates, new, known, _) in enumerate(FRESHNESS):
        site = f"s{i:02d}"
        pages.append((site, 0))
        if known:
            health.append((site, 0, LAST_RUN))
        for pos, (day, clock) in enumerate(dates):
            key = f"{site}-{pos}"
            postings.append((site, 0, pos, key, day, clock))
            if pos >= new:
                seen.append((key,))
    judged = inc.freshness_stop(
        inc.page_stats(
            spark.createDataFrame(pages, "site_name string, page_num int"),
            spark.createDataFrame(postings, POSTINGS),
            spark.createDataFrame(seen, "dedup_key string"),
        ),
        spark.createDataFrame(health, schemas.HEALTH),
    )
    got = {r["site_name"]: (r["new_jobs"], r["stop"]) for r in judged.collect()}
    want = {f"s{i:02d}": (new, stop) for i, (_, new, _, stop) in enumerate(FRESHNESS)}
    assert got == want


def test_newness_counts_a_key_once_per_site(spark):
    rows = [("a", 0, 0, "k", None, None), ("a", 1, 0, "k", None, None), ("b", 0, 0, "k", None, None)]
    new = inc.page_newness(
        spark.createDataFrame(rows, POSTINGS), spark.createDataFrame([], "dedup_key string")
    )
    assert sorted(tuple(r) for r in new.collect()) == [("a", 0, 1), ("b", 0, 1)]


@pytest.mark.parametrize(
    ("stops", "fails", "want"),
    [
        ([], [], [0, 1, 2, 3]),
        ([1], [], [0, 1]),
        ([0], [], [0]),
        ([], [0], []),
        ([], [2], [0, 1]),
        ([2], [1], [0]),
        ([1], [1], [0]),
        ([3], [], [0, 1, 2, 3]),
    ],
)
def test_visited_pages(spark, stops, fails, want):
    rows = [("s", p, p in stops, p in fails) for p in range(4)]
    pages = spark.createDataFrame(rows, "site_name string, page_num int, stop boolean, failed boolean")
    assert sorted(r["page_num"] for r in inc.visited_pages(pages).collect()) == want


def test_first_occurrence_keeps_run_order_and_prunes_before_the_shuffle(spark):
    rows = [(2, 0, 0, "k"), (1, 3, 0, "k"), (1, 2, 5, "k"), (1, 2, 4, "k"), (3, 0, 0, "z")]
    postings = spark.createDataFrame(rows, "site_ord int, page_num int, pos int, dedup_key string")
    first = inc.first_occurrence(postings)
    assert sorted(tuple(r) for r in first.collect()) == [(1, 2, 4, "k"), (3, 0, 0, "z")]
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_one_hot_key(spark):
    """Half of all rows share a key: exact counts, and one row per task is shuffled for it."""
    rows = spark.range(0, 20_000, numPartitions=8).select(
        F.col("id").alias("site_ord"), F.lit(0).alias("page_num"), F.lit(0).alias("pos"),
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("dedup_key"),
    )
    first = inc.first_occurrence(rows).cache()
    assert first.count() == 10_001
    assert first.filter("dedup_key = 'hot'").first()["site_ord"] == 0
    seen = spark.createDataFrame([("hot",)], "dedup_key string")
    assert inc.new_postings(rows, seen).count() == 10_000
    assert inc.seen_postings(rows, seen).count() == 10_000


def test_known_keys_stand_in_for_the_store(spark):
    rows = [("a", 0, 0, k, None, None) for k in ("x", "x", "y", "z")]
    postings = spark.createDataFrame(rows, POSTINGS)
    store = spark.createDataFrame([("x",), ("z",), ("other",)], "dedup_key string")
    known = inc.known_keys(postings, store)
    assert sorted(r["dedup_key"] for r in known.collect()) == ["x", "z"]
    assert [r["dedup_key"] for r in inc.new_postings(postings, known).collect()] == ["y"]


def seen_row(key, score=None):
    return (key, "job_id", f"t-{key}", "u", "c", score, LAST_RUN)


def test_seen_upsert_is_idempotent(spark):
    old = spark.createDataFrame([seen_row("a", 0.5), seen_row("b")], schemas.SEEN)
    new = spark.createDataFrame([seen_row("b", 0.9), seen_row("c")], schemas.SEEN)
    once = inc.seen_upsert(old, new)
    twice = inc.seen_upsert(once, new)
    want = [("a", 0.5), ("b", 0.9), ("c", None)]
    for result in (once, twice):
        assert sorted((r["dedup_key"], r["match_score"]) for r in result.collect()) == want


def test_store_appends_and_repeated_run_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "seen")
    stores.append_seen(spark.createDataFrame([seen_row("a")], schemas.SEEN), path, "r1")
    for _ in range(2):
        stores.append_seen(spark.createDataFrame([seen_row("b")], schemas.SEEN), path, "r2")
    store = stores.read_seen(spark, path)
    assert sorted(r["dedup_key"] for r in store.collect()) == ["a", "b"]
    keys = stores.seen_keys(store)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<dedup_key:string>" in keys


def test_seen_rows_keep_low_scores_and_missing_results(spark):
    new = spark.createDataFrame([seen_row("a")[:5], seen_row("b")[:5]], "dedup_key string, dedup_type string, title string, url string, company string")
    scores = spark.createDataFrame([("a", 0.4)], "dedup_key string, best_score double")
    rows = inc.seen_rows(new, scores, F.lit(LAST_RUN))
    assert sorted((r["dedup_key"], r["match_score"]) for r in rows.collect()) == [("a", 0.4), ("b", None)]


def test_health_upsert(spark):
    old = spark.createDataFrame(
        [("zero", 2, LAST_RUN), ("won", 5, None), ("absent", 4, LAST_RUN)], schemas.HEALTH
    )
    counts = spark.createDataFrame([("zero", 0), ("won", 10), ("fresh", 0)], "site_name string, job_count bigint")
    now = datetime.datetime(2024, 2, 1)
    got = {r[0]: (r[1], r[2]) for r in inc.health_upsert(old, counts, F.lit(now)).collect()}
    assert got == {"zero": (3, LAST_RUN), "won": (0, now), "absent": (4, LAST_RUN), "fresh": (1, None)}


def test_last_run_reads_naive_and_offset_times_as_utc(spark):
    health = spark.createDataFrame(
        [("a", 0, "2023-11-30T23:15:30-01:30"), ("b", 0, "2023-12-01 00:45:30"), ("c", 0, None), ("d", 0, "yesterday")],
        "site_name string, consecutive_zeros int, last_success_at string",
    )
    got = {r[0]: r[1] for r in stores.last_run(health).collect()}
    at = datetime.datetime(2023, 12, 1, 0, 45, 30)
    assert got == {"a": at, "b": at, "c": None, "d": None}
    sites = spark.createDataFrame([("a",), ("x",)], "site_name string")
    assert {r[0]: r[1] for r in stores.site_last_run(sites, health).collect()} == {"a": at, "x": None}
    assert {r[0]: r[1] for r in stores.site_zeros(sites, health).collect()} == {"a": 0, "x": 0}


def test_zero_streak_equals_counting_run_by_run(spark):
    runs = [(f"s{s}", datetime.datetime(2024, 1, 1 + r), (s * 7 + r * r) % 3 // 2) for s in range(9) for r in range(12)]
    kept = {}
    for site, at, n in sorted(runs, key=lambda r: r[1]):
        zeros, last = kept.get(site, (0, None))
        kept[site] = (0, at) if n else (zeros + 1, last)
    got = inc.zero_streak(spark.createDataFrame(runs, schemas.RUNS))
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == kept


def test_stale_sites(spark):
    health = spark.createDataFrame([("Still", 3, None), ("Quiet", 5, None), ("Ok", 2, None)], schemas.HEALTH)
    rows = {r["site_name"]: r["warning"] for r in inc.stale_sites(health).collect()}
    assert set(rows) == {"Still", "Quiet"}
    assert "0 jobs for 5 consecutive runs" in rows["Quiet"]
