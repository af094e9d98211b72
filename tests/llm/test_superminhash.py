"""Signatures against the element-wise rule, components against all pairs, linking tasks, edge cases."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import linking, superminhash
from tidemark.llm.hashing import mix


def shingles(text, size=4):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * inter >= 80 * (len(sets[i]) + len(sets[j]) - inter):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    named = [(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]
    return sorted(((d, n, c, d == c) for d, n, c in named), key=str)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    text = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    out, shared = [], text(60)
    for _ in range(30):
        base = text(rng.choice((5, 12, 50, 120, 400)))
        out += [base] + [edited(rng, base, k * max(1, len(base) // 60)) for k in range(rng.randrange(5))]
    near = text(200)
    for _ in range(25):  # a chain
        near = edited(rng, near, 3)
        out.append(near)
    hot = text(100)
    out += [edited(rng, hot, rng.randrange(1, 6)) for _ in range(80)] + [hot] * 30  # pairs on both sides of the limit
    out += [shared + text(20) for _ in range(20)]
    out = [" ".join(t) for t in out] + ["a b c", "A  b\tC", "a b", "", " \n", None, "one two three four", "é É", " ".join(text(9000))]
    order = list(range(len(out)))
    rng.shuffle(order)
    return [(i, out[k]) for i, k in enumerate(order)] + [(None, "a b c"), (None, "nobody else has this"), (3, out[order[3]]), (3, "another text")]


@pytest.mark.parametrize("weight", [1 << 21, 3000, 400])
def test_components_equal_all_pairs(docs, rows, monkeypatch, weight):
    """A chain in one task, a task for each bucket, and blocks of buckets."""
    monkeypatch.setattr(linking, "WEIGHT", weight)
    got = superminhash.join(docs(rows).withColumn("kept", F.lit("x")).withColumn("N", F.lit(1))).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_signatures_are_those_of_the_element_wise_rule():
    rng = np.random.default_rng(2)
    size = 12
    counts = np.array([1, 0, 3, 40, 7])
    keys = rng.integers(0, 1 << 63, counts.sum()).astype(np.uint64)
    got = superminhash.signatures(keys, counts, size)
    at = 0
    for row, n in zip(got, counts):
        want = [(1 << 64) - 1] * size
        for key in keys[at : at + n]:
            order = list(range(size))
            for j in range(size):
                bits = int(mix(np.array([(int(key) + (j + 1) * superminhash._STEP) % (1 << 64)], np.uint64))[0])
                k = j + ((bits >> 32) * (size - j) >> 32)
                order[j], order[k] = order[k], order[j]
                want[order[j]] = min(want[order[j]], j << 32 | bits & 0xFFFFFFFF)
        assert row.tolist() == want
        at += n


def test_variance_is_below_that_of_independent_minima():
    rng = np.random.default_rng(3)
    shares = []
    for _ in range(60):
        a = rng.integers(0, 1 << 63, 300).astype(np.uint64)
        b = np.concatenate((a[:200], rng.integers(0, 1 << 63, 100).astype(np.uint64)))
        x, y = superminhash.signatures(np.concatenate((a, b)), np.array([300, 300]))
        shares.append((x == y).mean())
    assert abs(np.mean(shares) - 0.5) < 0.02 and np.std(shares) < 0.9 * (0.25 / superminhash.SIZE) ** 0.5


def test_forest_joins_what_links_join():
    rng = random.Random(4)
    for sides in (1, 2):
        base = [rng.sample(range(1000), 60) for _ in range(4)]
        sets = [sorted(set(rng.choice(base)[: 60 - rng.randrange(9)] + rng.sample(range(10**6), rng.randrange(9)))) for _ in range(120)]
        roots = np.array([i if i % 7 else 0 for i in range(120)])
        side = np.array([1 + i % sides for i in range(120)])

        def closed(links):
            root = list(roots)
            for i, j in links:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
            return root

        pairs = []
        for i in range(120):
            for j in range(i):
                inter = len(set(sets[i]) & set(sets[j]))
                if 100 * inter >= 80 * (len(sets[i]) + len(sets[j]) - inter) and (sides == 1 or side[i] != side[j]):
                    pairs.append((i, j))
        found = linking.forest([np.array(s, np.uint64) for s in sets], roots, side, 80)
        assert {tuple(sorted(p, reverse=True)) for p in found} <= set(pairs)
        assert closed(found) == closed(pairs) and len(found) < 120


def test_a_hot_group_just_below_the_limit_makes_no_pairs(docs):
    """Copies that differ in a few words each: some pairs link, none becomes a row of its own."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    table = [(i, " ".join(edited(rng, base, 1 + i % 4))) for i in range(400)]
    got = superminhash.join(docs(table)).collect()
    assert sorted(map(tuple, got), key=str) == brute(table)


def test_representatives(docs, rows):
    table = docs(rows).withColumn("component_id", F.lit("x"))
    kept = superminhash.representatives(table)
    assert kept.columns == table.columns
    names = {d for d, _, c, k in brute(rows) if d is not None and k}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((d for d, _ in rows if d is None or d in names), key=str)


def test_empty_tables_and_text_ids(spark, docs):
    assert superminhash.join(docs([(1, "a")]).limit(0)).count() == 0
    assert {r.component_id for r in superminhash.join(docs([(1, None), (2, "")])).collect()} == {1, 2}
    named = spark.createDataFrame([("b", "x y z"), ("a", "x y z")], "doc_id string, text string")
    assert {r.component_id for r in superminhash.join(named).collect()} == {"a"}
