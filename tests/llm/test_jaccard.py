"""Components against all pairs, the box join, hot groups and the defined edge cases."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import jaccard, linking
from tidemark.llm.components import components


def shingles(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lowered) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


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
    return sorted(
        ((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str
    )


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    text = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    out, shared = [], " ".join(text(60))
    for _ in range(30):
        base = text(rng.choice((6, 12, 50, 120, 400)))
        out.append(" ".join(base))
        for k in range(rng.randrange(5)):
            out.append(edited(rng, base, k * max(1, len(base) // 60)))
    near = text(200)  # a chain: each differs a little from the one before
    for _ in range(25):
        near = edited(rng, near, 2).split()
        out.append(" ".join(near))
    hot = text(100)
    out += [edited(rng, hot, 1) for _ in range(60)] + [" ".join(hot)] * 30
    out += [f"{shared} {' '.join(text(20))}" for _ in range(20)]  # mostly a shared passage
    out += ["a b c", "A  b\tC", "a b", "", " \n", None, "one two three four five", "é É"]
    order = list(range(len(out)))
    rng.shuffle(order)
    return [(i, out[k]) for i, k in enumerate(order)] + [(None, "a b c"), (None, "nobody else has this"), (3, out[order[3]])]


def test_components_equal_all_pairs(docs, rows):
    got = jaccard.join(docs(rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


@pytest.mark.parametrize("weight", [3000, 400])
def test_blocks_of_a_bucket_meet(docs, rows, monkeypatch, weight):
    """A task for each bucket, and blocks of buckets."""
    monkeypatch.setattr(linking, "WEIGHT", weight)
    got = jaccard.join(docs(rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_parts_of_a_hot_bucket_lose_no_link(docs, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", 2)
    got = jaccard.join(docs(rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_a_near_copy_alone_in_every_part_is_linked(docs, monkeypatch):
    """Many exact copies make all shingles hot, but there are only two nodes."""
    monkeypatch.setattr(jaccard, "HOT", 2)
    base = [f"w{i}" for i in range(100)]
    for k in range(4):
        rows = [(i, " ".join(base)) for i in range(60)] + [(100, " ".join([*base, f"one{k}"]))]
        assert {r.component_id for r in jaccard.join(docs(rows)).collect()} == {0}


def test_the_tree_loses_no_allowed_point(monkeypatch):
    rng = np.random.default_rng(1)
    for n, sides in ((40, 1), (40, 2), (3, 1)):
        base = rng.poisson(3, (6, jaccard.DIMS))
        points = np.concatenate([np.maximum(b + rng.integers(-1, 2, (n, jaccard.DIMS)), 0) for b in base])
        sizes = points.sum(axis=1)
        roots = rng.integers(0, 30, len(points))
        side = 1 + np.arange(len(points)) % sides
        got = jaccard.allowed(points, sizes, roots, side, [None] * len(points))
        want, root = np.zeros(len(points), bool), np.arange(len(points))
        for a in range(len(points)):
            for b in range(len(points)):
                bound = 180 * np.minimum(points[a], points[b]).sum() >= 80 * (sizes[a] + sizes[b])
                ratio = 100 * min(sizes[a], sizes[b]) >= 80 * max(sizes[a], sizes[b])
                if bound and ratio and roots[a] != roots[b] and (sides == 1 or side[a] != side[b]):
                    want[a] = True
                    root[root == root[a]] = root[b]
        assert ((got >= 0) == want).all()
        chains = {(int(g), int(r)) for g, r, w in zip(got, root, want) if w}
        assert len(chains) == len({g for g, _ in chains}) == len({r for _, r in chains})


def test_the_tree_prunes_from_the_top():
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.multinomial(300, rng.dirichlet(np.ones(jaccard.DIMS) * 0.2), 200) for _ in range(20)])
    tree = jaccard.Tree(points, points.sum(axis=1), np.arange(len(points)))
    i, _ = jaccard.box_pairs(tree, tree)
    assert len(tree.levels) > 1 and len(i) < len(tree.levels[0][1]) ** 2 / 4


def test_finer_points_bound_overlaps_and_tell_long_documents_apart():
    rng = np.random.default_rng(3)
    make = lambda n: rng.integers(0, 1 << 63, n).astype(np.uint64)
    fine = lambda keys: np.frombuffer(jaccard._fine(keys), "<u4")
    for n, m in ((1024, 1200), (3000, 3100), (6000, 7000), (20000, 16500)):
        a = make(n)
        near = np.concatenate((a[: int(0.9 * n)], make(max(0, m - int(0.9 * n)))))
        inter, total = len(np.intersect1d(a, near)), n + len(near)
        groups = min(len(fine(a)), len(fine(near)))
        assert np.minimum(jaccard._folded(fine(a), groups), jaccard._folded(fine(near), groups)).sum() >= inter
        assert jaccard._finely(fine(a), fine(near), total) or 100 * inter < 80 * (total - inter)
        assert not jaccard._finely(fine(a), fine(make(m)), n + m) and jaccard._finely(fine(a), None, n + m)


def test_long_documents_of_a_size_with_a_shared_passage(docs):
    rng = random.Random(9)
    shared = " ".join(f"s{i}" for i in range(40))
    rows = [(i, " ".join([*(f"w{rng.randrange(10**6)}" for _ in range(3000)), shared])) for i in range(20)]
    rows += [(100 + i, edited(rng, t.split(), 40)) for i, t in rows[:5]] + [(200 + i, edited(rng, t.split(), 90)) for i, t in rows[:5]]
    assert sorted(map(tuple, jaccard.join(docs(rows)).collect())) == brute_by_index(rows)


def test_a_group_of_near_copies_around_the_limit(docs):
    """2,000 copies of which pairs are similar and others not: a chain of buckets, no row for each pair."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, edited(rng, base, rng.randrange(1, 5))) for i in range(2000)]
    table = docs(rows)
    assert sorted(map(tuple, jaccard.join(table).collect())) == brute_by_index(rows)


def brute_by_index(rows):
    """As ``brute``, overlaps counted over an index of shingles."""
    sets = [shingles(t) for _, t in rows]
    names = {g: k for k, g in enumerate({g for s in sets for g in s})}
    table = np.zeros((len(sets), len(names)), np.float32)
    for i, s in enumerate(sets):
        table[i, [names[g] for g in s]] = 1
    inter, sizes = (table @ table.T).astype(int), table.sum(axis=1).astype(int)
    linked = 100 * inter >= 80 * (sizes[:, None] + sizes - inter)
    root = np.arange(len(rows))
    while True:
        least = np.where(linked, root[None, :], len(rows)).min(axis=1)
        if (least == root).all():
            return [(d, int(n), rows[r][0]) for (d, _), n, r in zip(rows, sizes, root)]
        root = least


def test_long_texts_hash_alike_in_pieces(monkeypatch):
    from tidemark.llm import hashing

    text = " ".join(f"W{i % 977}\t" for i in range(5000))
    whole = hashing.word_hashes([text, "x", text])
    monkeypatch.setattr(hashing._pieces, "__defaults__", (1000,))
    parts = hashing.word_hashes([text, "x", text])
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all() and whole[1].tolist() == [5000, 1, 5000]


def test_a_group_of_copies_makes_a_star_and_not_its_pairs(docs):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(300)]
    table = docs([(i, edited(rng, base, 2)) for i in range(400)])
    texts = table.select(F.col("doc_id").alias("id"), "text")
    stars = jaccard._stars(jaccard._prefixes(texts, np.zeros(1 << jaccard.SLOT_BITS, np.int64)))
    assert stars.select("pivot", "node").distinct().count() < 400 * 25
    got = jaccard.join(table).collect()
    assert {r.component_id for r in got} == {0}


def test_representatives(docs, rows):
    table = docs(rows).withColumn("component_id", F.lit("x")).withColumn("N_SHINGLES", F.lit(1))
    kept = jaccard.representatives(table)
    assert kept.columns == table.columns
    want = sorted((d for d, _, c in brute(rows) if d is None or d == c), key=str)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == want


def test_ids_of_other_types(spark):
    table = spark.createDataFrame([("2024-01-02", "x y z"), ("2024-01-01", "x y z")], "d string, text string").selectExpr("to_date(d) AS doc_id", "text")
    assert {str(r.component_id) for r in jaccard.join(table).collect()} == {"2024-01-01"}


def test_empty_table(docs):
    assert jaccard.join(docs([(1, "a")]).limit(0)).count() == 0
    assert jaccard.join(docs([(1, None), (2, "")])).select("component_id").collect()[0][0] in (1, 2)


def test_components_of_chains_and_rings(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (203, 201), (201, 203)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (100, 101, 102)} == {100} and got[203] == 201
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
