"""Words, near words, forms and roots against a plain loop over all pairs, and the defined edge cases."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries, spelling
from tidemark.llm.tables import read


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                n[run] += 1
    words = sorted(w for w in n if n[w] >= 5)
    around, blank = {w: [] for w in words}, {}
    for w in words:  # near words share themselves with one letter struck out, or one is the other's strike
        for key in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            blank.setdefault(key, set()).add(w)
    for group in blank.values():
        group = sorted(group)
        for i, a in enumerate(group):
            for b in group[:i]:
                if near(a, b):
                    around[a].append(b), around[b].append(a)
    form, out = {}, []
    for w in words:
        around[w] = sorted(set(around[w]), key=lambda x: (-n[x], x))
        if around[w] and n[around[w][0]] >= 5 * n[w]:
            form[w] = around[w][0]
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(around[w]), n[form[w]] if w in form else None))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(13)
    letters = "abcdeéß"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 10))) for _ in range(60)]
    for w in words[:40]:
        i = rng.randrange(len(w))
        words += [w[:i] + rng.choice(letters) + w[i:], w[:i] + w[i + 1 :], w[:i] + "ÿ" + w[i + 1 :], w[1] + w[0] + w[2:]]
    weights = [5 ** rng.randrange(6) for _ in words]
    out = [(i, " ".join(rng.choices(words, weights, k=300))) for i in range(40)]
    out += [(100 + i, "Abcdef " * 9 + "ABCDEFÉ abcdefé" + "x" * 300 + " " + "x" * 301) for i in range(6)]
    # a chain of forms, and ties of n
    chain = ["chainword", "chainwords", "chainwordsa", "chainwordsab"]
    out += [(200, " ".join(w for k, w in enumerate(chain) for _ in range(5 * 6**k)))]
    out += [(300, "tiefirst " * 50 + "tiesecst " * 50 + "tiexxxst " * 5 + "tieyirst " * 5 + "tieyecst " * 5)]
    return out + [(None, "a1b nobody " * 7), (7, None), (8, ""), (9, "  1 2"), (3, out[3][1]), (10**12, "Ünïcöde× " * 6 + "\U0001f600verylongend")]


def test_equals_all_pairs(docs, rows):
    got = spelling.variants(docs(rows).withColumn("word", F.lit("x")).withColumn("N", F.lit(1))).collect()
    want = brute(rows)
    assert sorted(map(tuple, got)) == want
    assert any(f for _, f, *_ in want) and any(r not in (f, w) for w, f, r, *_ in want)


def test_leaves_and_blocks_lose_no_pair(docs, rows, monkeypatch):
    monkeypatch.setattr(spelling, "LEAF", 6)
    monkeypatch.setattr(spelling, "LEAST_SAMPLED", 1)
    monkeypatch.setattr(spelling, "BLOCK", 2)
    assert sorted(map(tuple, spelling.variants(docs(rows)).collect())) == brute(rows)


def test_trees_do_not_change_the_result(spark, docs, rows, monkeypatch):
    """A tree of a few words, and lengths that the sample does not hold."""
    words = spelling.count_words(docs(rows)).cache()
    some = [r.word for r in words.collect()][::5]
    sizes = Counter(len(r.word) for r in words.collect())
    monkeypatch.setattr(spelling, "LEAF", 4)
    monkeypatch.setattr(spelling, "LEAST_SAMPLED", 1)
    forest = spelling.Forest(some, dict(sizes))
    found = spelling.near(spelling.route(words, forest)).groupBy("word").agg(F.sum("n_near").alias("n")).collect()
    assert {r.word: r.n for r in found} == {w: n for w, _, _, _, n, _ in brute(rows) if n}


def test_search_equals_all_pairs_and_prunes(monkeypatch):
    monkeypatch.setattr(spelling, "BOX", 8)
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(3000)})
    leaf = spelling.Leaf(words, np.ones(len(words), np.int64))
    for length in (6, 7):
        asked = sorted({"".join(rng.choice("abcdefgh") for _ in range(length)) for _ in range(200)})
        i, j = leaf.search(spelling.points(asked), spelling._coded(asked)[0].reshape(len(asked), -1), 2 if length == 7 else 1)
        got = {(asked[a], leaf.words[b]) for a, b in zip(i, j)}
        assert got == {(a, b) for a in asked for b in words if near(a, b)} and len(got) == len(i)
    boxes = spelling.box_distance(spelling.points(asked), leaf.low, leaf.high, 2) <= 2
    assert boxes.mean() < 0.5


def test_long_texts_count_alike_in_pieces(monkeypatch):
    text = " ".join(f"word{'abcdefghij'[i % 10] * (i % 7)}É,x" for i in range(3000))
    whole = spelling.words_of_text(4, text)
    monkeypatch.setattr(spelling, "_PIECE", 50)
    assert spelling.words_of_text(4, text) == whole and sum(whole.values()) > 1000


def test_no_words(docs):
    assert spelling.variants(docs([(1, "abcdefg")]).limit(0)).count() == 0
    assert spelling.variants(docs([(1, "abcdefg")])).count() == 0


def test_query_equals_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in read(spark, sf, "documents").collect()]
    assert sorted(map(tuple, queries.QUERIES["op13_spelling"](spark, sf).collect())) == brute(docs)
