"""Streams over files that arrive in several batches equal the batch results."""

import datetime
import os
import random

from pyspark.sql import functions as F

from tidemark.operators import incremental as inc
from tidemark.sources import keystore, schemas, snapshots
from tidemark.streaming import streams

POSTING = "site_ord bigint, page_num int, pos int, dedup_key string, dedup_type string, title string, url string, company string"


def arrive(spark, rows, ddl, path):
    spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(str(path))


def test_captures_are_processed_once(spark, tmp_path):
    src, state, out = (str(tmp_path / n) for n in ("src", "state", "out"))
    for batch in ([("a",), ("b",)], [], [("c",)]):
        if batch:
            arrive(spark, batch, "html string", src)
        arrived = streams.arriving(spark, "html string", src)
        streams.stream_captures(arrived, lambda df: df.select(F.upper("html").alias("t")), state, out)
    assert sorted(r["t"] for r in spark.read.parquet(out).collect()) == ["A", "B", "C"]


def test_dedup_over_batches(spark, tmp_path):
    src, state, out = (str(tmp_path / n) for n in ("src", "state", "out"))
    for batch in ([("a",), ("a",), ("b",)], [("b",), ("c",)]):
        arrive(spark, batch, "dedup_key string", src)
        streams.stream_dedup(streams.arriving(spark, "dedup_key string", src), state, out)
    assert sorted(r["dedup_key"] for r in keystore.read(spark, out, "dedup_key string").collect()) == ["a", "b", "c"]


def posting(ord_, key):
    return (ord_, 0, 0, key, "job_id", f"t{ord_}", "u", "c")


def test_upsert_over_batches_and_after_a_lost_commit(spark, tmp_path):
    src, state, store = (str(tmp_path / n) for n in ("src", "state", "store"))
    now = F.lit(datetime.datetime(2024, 2, 1))
    keystore.append_new(spark, store, spark.createDataFrame([("old", "job_id", "t", "u", "c", 0.5, None)], schemas.SEEN), "before", 0)
    arrive(spark, [posting(2, "a"), posting(1, "a"), posting(3, "old")], POSTING, src)
    streams.stream_upsert(streams.arriving(spark, POSTING, src), store, state, now)
    want = [("a", "t1"), ("old", "t")]
    assert sorted((r["dedup_key"], r["title"]) for r in keystore.read(spark, store, schemas.SEEN).collect()) == want
    # The batch was written but its checkpoint got lost: a new one repeats it.
    streams.stream_upsert(streams.arriving(spark, POSTING, src), store, str(tmp_path / "state2"), now)
    assert sorted((r["dedup_key"], r["title"]) for r in keystore.read(spark, store, schemas.SEEN).collect()) == want
    arrive(spark, [posting(1, "a"), posting(4, "z")], POSTING, src)
    streams.stream_upsert(streams.arriving(spark, POSTING, src), store, state, now)
    assert sorted(r["dedup_key"] for r in keystore.read(spark, store, schemas.SEEN).collect()) == ["a", "old", "z"]


def test_upsert_keeps_what_other_streams_wrote(spark, tmp_path):
    now, store = F.lit(datetime.datetime(2024, 2, 1)), str(tmp_path / "store")  # no store before the first batch
    for name, keys in (("one", "ab"), ("two", "xy"), ("three", "bz")):
        arrive(spark, [posting(i, k) for i, k in enumerate(keys)], POSTING, tmp_path / name)
        arrived = streams.arriving(spark, POSTING, str(tmp_path / name))
        streams.stream_upsert(arrived, store, str(tmp_path / f"state-{name}"), now)
    assert sorted(r["dedup_key"] for r in keystore.read(spark, store, schemas.SEEN).collect()) == ["a", "b", "x", "y", "z"]
    # the same files under a new checkpoint add nothing and lose nothing
    streams.stream_upsert(streams.arriving(spark, POSTING, str(tmp_path / "one")), store, str(tmp_path / "again"), now)
    assert sorted(r["dedup_key"] for r in keystore.read(spark, store, schemas.SEEN).collect()) == ["a", "b", "x", "y", "z"]


def test_health_of_late_runs(spark, tmp_path):
    src, state, out = (str(tmp_path / n) for n in ("src", "state", "out"))
    day = lambda d: datetime.datetime(2024, 1, d)
    batches = [[("late zero", day(10), 4), ("late success", day(8), 0), ("late success", day(9), 0)],
               [("late zero", day(5), 0), ("late success", day(7), 3)], [("late success", day(3), 1)]]
    for batch in batches:
        arrive(spark, batch, schemas.RUNS, src)
        streams.drain_health(streams.arriving(spark, schemas.RUNS, src), state, out)
    got = {r[0]: (r[1], r[2]) for r in streams.latest_health(spark, out).collect()}
    assert got == {"late zero": (0, day(10)), "late success": (2, day(7))}


def test_health_over_batches(spark, tmp_path):
    src, state, out = (str(tmp_path / n) for n in ("src", "state", "out"))
    runs = [
        (f"s{s}", datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d), (s * 5 + d * d) % 4 // 3)
        for d in range(12) for s in range(6)
    ]
    for first in (0, 4, 8):
        batch = [r for r in runs if first <= (r[1] - datetime.datetime(2024, 1, 1)).days < first + 4]
        arrive(spark, batch, schemas.RUNS, src)
        streams.drain_health(streams.arriving(spark, schemas.RUNS, src), state, out)
    got = sorted(map(tuple, streams.latest_health(spark, out).collect()))
    want = inc.zero_streak(spark.createDataFrame(runs, schemas.RUNS))
    assert got == sorted(map(tuple, want.collect()))


def test_health_reads_its_state_and_not_the_history(spark, tmp_path):
    """Runs of 60 days in ten batches, shuffled so that zeros and successes come late, some twice."""
    src, state, out = (str(tmp_path / n) for n in ("src", "state", "out"))
    rng = random.Random(4)
    first = datetime.datetime(2024, 1, 1)
    runs = [(f"s{s}", first + datetime.timedelta(hours=7 * d + s), rng.choice((0, 0, 0, s))) for d in range(200) for s in range(5)]
    rng.shuffle(runs)
    for k in range(10):
        arrive(spark, runs[100 * k : 100 * k + 120], schemas.RUNS, src)
        streams.drain_health(streams.arriving(spark, schemas.RUNS, src), state, out)
        kept = snapshots.newest(spark, out, schemas.RUNS)
        seen = sorted(set(runs[: 100 * k + 120]))
        want = {}
        for site in {r[0] for r in seen}:
            own = [r for r in seen if r[0] == site]
            last = max((r[1] for r in own if r[2]), default=None)
            want[site] = (sum(last is None or r[1] > last for r in own), last)
        assert {r[0]: (r[1], r[2]) for r in streams.latest_health(spark, out).collect()} == want
        assert kept.count() == sum(n for n, _ in want.values()) + sum(last is not None for _, last in want.values())
    assert len([d for d in os.listdir(out) if d.isdigit()]) <= snapshots.KEPT + 1


def test_scores_reach_the_store(spark, tmp_path):
    src, state, store = (str(tmp_path / n) for n in ("src", "state", "store"))
    arrive(spark, [posting(1, "a"), posting(2, "b"), posting(3, "a")], POSTING, src)

    def score(new):
        return new.where("dedup_key = 'a'").select("dedup_key", (F.col("site_ord") / 2).alias("best_score"))

    streams.stream_upsert(streams.arriving(spark, POSTING, src), store, state, F.lit(datetime.datetime(2024, 2, 1)), score)
    got = keystore.read(spark, store, schemas.SEEN).collect()
    assert {r["dedup_key"]: r["match_score"] for r in got} == {"a": 0.5, "b": None}
