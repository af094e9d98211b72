"""The key store: what a batch reads, merging, repeated and rival batches."""

import os
import random

import pytest

from tidemark.sources import keystore

ROWS = "dedup_key string, n int"


def rows(spark, keys, n=0):
    return spark.createDataFrame([(k, n) for k in keys], ROWS).coalesce(1)


def keys(spark, path):
    return sorted(r.dedup_key for r in keystore.read(spark, path, ROWS).collect())


def files(path):
    return sum(f.endswith(".parquet") for _, _, names in os.walk(path) for f in names)


@pytest.fixture(autouse=True)
def few_buckets(monkeypatch):
    monkeypatch.setattr(keystore, "BUCKETS", 4)


def test_files_stay_bounded_over_many_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keystore, "FAN", 3)
    path, rng, want, most = str(tmp_path / "store"), random.Random(1), set(), 0
    for batch in range(30):
        own = {f"k{rng.randrange(200)}" for _ in range(6)}
        assert keystore.append_new(spark, path, rows(spark, own, batch), "s", batch)
        want |= own
        now = keystore.manifest(spark, path)
        assert len(now["folders"]) <= 2 * 4  # fewer than FAN of a level, log of the batches in levels
        most = max(most, files(path))
    assert keys(spark, path) == sorted(want)
    assert most <= (8 + 3) * 5 and max(f["level"] for f in now["folders"]) >= 2


def test_a_batch_reads_only_buckets_its_keys_may_be_in(spark, tmp_path):
    path = str(tmp_path / "store")
    keystore.append_new(spark, path, rows(spark, [f"k{i}" for i in range(1000)]), "s", 0)
    keystore.append_new(spark, path, rows(spark, [f"other{i}" for i in range(1000)]), "s", 1)
    maybe, where = keystore.touched(spark, path, rows(spark, ["k5", "new"]))
    assert 1 <= len(where) <= 2 and "k5" in {r.dedup_key for r in maybe.collect()}
    found = keystore.known_keys(spark, path, rows(spark, ["k5", "new", "other7"]))
    assert {r.dedup_key for r in found.collect()} == {"k5", "other7"}
    read = {f.split("/data/")[1].split("/")[0] for f in keystore.known_keys(spark, path, rows(spark, ["k5"])).inputFiles() if "/data/" in f}
    assert len(read) == 1
    maybe, _ = keystore.touched(spark, path, rows(spark, [f"absent{i}" for i in range(1000)]))
    assert maybe.count() < 400  # of 2,000 look-ups


def test_repeated_batches_and_empty_ones(spark, tmp_path):
    path = str(tmp_path / "store")
    assert keystore.read(spark, path, ROWS).count() == 0 and keystore.known_keys(spark, path, rows(spark, "a")).count() == 0
    assert keystore.append_new(spark, path, rows(spark, "ab"), "s", 0)
    assert not keystore.append_new(spark, path, rows(spark, "abc"), "s", 0)
    assert keystore.append_new(spark, path, rows(spark, "abc", 1), "t", 0)
    assert keystore.append_new(spark, path, rows(spark, []), "t", 1)
    assert keys(spark, path) == ["a", "b", "c"]
    assert {r.dedup_key: r.n for r in keystore.read(spark, path, ROWS).collect()} == {"a": 0, "b": 0, "c": 1}


def test_the_later_of_two_writers_looks_again(spark, tmp_path, monkeypatch):
    path, real, once = str(tmp_path / "store"), keystore._write, []

    def rival(spark, path, new, buckets, level):
        if not once:
            once.append(1)
            assert keystore.append_new(spark, path, rows(spark, "ab", 2), "rival", 0)
        return real(spark, path, new, buckets, level)

    monkeypatch.setattr(keystore, "_write", rival)
    assert keystore.append_new(spark, path, rows(spark, "bc", 1), "s", 0)
    assert {r.dedup_key: r.n for r in keystore.read(spark, path, ROWS).collect()} == {"a": 2, "b": 2, "c": 1}


def test_a_manifest_that_is_not_written_to_its_end_does_not_count(spark, tmp_path):
    path = str(tmp_path / "store")
    keystore.append_new(spark, path, rows(spark, "ab"), "s", 0)
    with open(tmp_path / "store" / "_manifest" / "00000002.json", "w") as file:
        file.write('{"version": 2, "fol')
    assert keys(spark, path) == ["a", "b"]
