"""Clusters against a plain loop in Python integers, and the defined edge cases."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import clustering

SCHEMA = "vec_id long, embedding array<float>, cluster string, ID string"


def brute(rows, k=16, rounds=3, dims=64):
    kept = []
    for vec_id, vector, *_ in rows:
        if vector is not None and len(vector) == dims and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((vec_id, [math.floor(64 * float(np.float32(x))) for x in vector]))
    name = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest()
    centroids = [v for _, v in sorted((name(i), v) for i, v in kept if i is not None)[:k]]

    def assign():
        out = []
        for i, v in kept:
            out.append((i, *min((sum((x - y) ** 2 for x, y in zip(v, c)), n) for n, c in enumerate(centroids)), v))
        return out

    for _ in range(rounds):
        groups = {}
        for _, _, c, v in assign():
            groups.setdefault(c, []).append(v)
        for c, members in groups.items():
            centroids[c] = [sum(col) // len(members) for col in zip(*members)]
    final = assign()
    inertia = {c: sum(r[1] for r in final if r[2] == c) for c in {r[2] for r in final}}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), names[c]) for i, d, c, _ in final), key=str)


def vectors(rng, n):
    return [(i, [rng.choice((rng.gauss(0, 1), float(rng.randrange(-2, 3)))) for _ in range(64)], "x", "y") for i in range(n)]


def got(spark, rows):
    found = clustering.report(clustering.cluster(spark.createDataFrame(rows, SCHEMA)))
    return sorted((tuple(r)[:6] for r in found.collect()), key=str)


def test_equals_a_plain_loop(spark):
    rng = random.Random(4)
    rows = vectors(rng, 300)
    rows += [(7, rows[9][1], "x", "y"), (8, rows[8][1], "x", "y"), (None, rows[3][1], None, None)]  # repeated, missing ids
    rows += [(400 + i, rows[0][1], "x", "y") for i in range(200)]  # a hot group of equal vectors
    bad = [None, [], [0.0] * 63, [0.0] * 65, [0.0] * 63 + [None], [0.0] * 63 + [math.nan], [math.inf] + [0.0] * 63]
    rows += [(900 + i, v, "x", "y") for i, v in enumerate(bad)]
    assert got(spark, rows) == brute(rows)


def test_blocks_and_partitions_play_no_part(spark, monkeypatch):
    rows = vectors(random.Random(5), 100)
    table = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    monkeypatch.setattr(clustering, "BLOCK", 7)
    for n in (1, 5):
        found = clustering.report(clustering.cluster(table.repartition(n)))
        assert sorted((tuple(r)[:6] for r in found.collect()), key=str) == want


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = vectors(random.Random(6), 5)
    assert got(spark, rows) == brute(rows)
    assert [r[2] for r in got(spark, rows)] == [0] * 5
    assert got(spark, [(1, None, None, None)]) == []


def test_far_values_are_left_out(spark):
    rows = vectors(random.Random(7), 20)
    assert got(spark, rows + [(99, [3e38] * 64, "x", "y")]) == brute(rows)


def test_empty_centroids_stay(spark):
    vector = [0.5] * 64
    rows = [(i, vector, "x", "y") for i in range(40)]
    found = clustering.cluster(spark.createDataFrame(rows, SCHEMA))
    assert len(found.centroids) == 16 and {tuple(c) for c in found.centroids} == {(32,) * 64}
    assert found.rows.where("cluster = 0 AND distance = 0").count() == 40


@pytest.mark.parametrize("kind", ["array<double>", "array<float>"])
def test_floor_of_doubles(spark, kind):
    row = [(1, [0.1] * 63 + [-0.015625])]
    table = spark.createDataFrame(row, "vec_id int, embedding array<double>").withColumn("embedding", F.col("embedding").cast(kind))
    assert clustering.cluster(table).centroids == [[6] * 63 + [-1]]
