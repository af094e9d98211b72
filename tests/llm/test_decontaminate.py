"""Hits against a plain scan, blocks of the benchmark, cut passages, edge cases."""

import random
import re

import pytest

from tidemark.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    own, hit, found = words(text), set(), set()
    for name, item in items:
        theirs = words(item)
        size = min(13, len(theirs))
        windows = {tuple(theirs[i : i + size]) for i in range(len(theirs) - size + 1)} if size else set()
        for i in range(len(own) - size + 1 if size else 0):
            if tuple(own[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                found |= {str(name)} if name is not None else set()
    return len(own), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(own)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(3)
    make = lambda n: " ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(n))
    items = [(i, make(n)) for i, n in enumerate((40, 20, 13, 5, 3, 14))]
    items += [(7, None), (8, " .,"), (None, make(15)), (9, items[0][1]), (10, "ÉCOLE Zürich 42")]
    texts = [None, "", "...", make(300), items[0][1].upper().replace(" ", "--"), "école zürich 42", "École Zürich 42 x"]
    texts += [f"{make(30)} {items[k][1]}, {make(40)}" for k in range(6)] + [make(500) + " " + items[8][1], make(12)]
    return texts, items


@pytest.mark.parametrize("block_bytes", [1, 1 << 20])
def test_report_equals_a_plain_scan(docs, spark, case, block_bytes):
    texts, items = case
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dc.decontaminate(docs(list(enumerate(texts))), bench, block_bytes=block_bytes).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.n_hit, list(r["items"]), r.contaminated) == brute(texts[r.doc_id], items)


def test_one_word_in_twenty_is_the_border(docs, spark):
    bench = spark.createDataFrame([(1, "needle")], "item_id long, text string")
    rows = docs([(n, "needle " + "hay " * (n - 1)) for n in (19, 20, 21, 140)])
    got = {r.doc_id: r.contaminated for r in dc.decontaminate(rows, bench).collect()}
    assert got == {19: True, 20: True, 21: False, 140: False}


def test_modes_keep_columns_and_rows(docs, spark, case):
    texts, items = case
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = docs([*enumerate(texts), (None, texts[3]), (3, texts[3])])
    table = table.selectExpr("*", "'a' AS n_hit", "1 AS ITEMS")
    report = dc.decontaminate(table, bench)
    assert report.columns == [*table.columns, "n_words", "_n_hit", "_items", "contaminated"]
    kept = dc.decontaminate(table, bench, mode="documents")
    assert kept.columns == table.columns
    bad = report.where("contaminated").count()
    assert kept.count() == table.count() - bad and 0 < bad < table.count()
    cut = dc.decontaminate(table, bench, mode="spans")
    assert cut.columns == table.columns and cut.count() == table.count()
    for r in cut.collect():
        whole = texts[r.doc_id] if r.doc_id is not None else texts[3]
        n, hit, *_ = brute(whole, items)
        assert len(words(r.text)) == n - hit
        assert hit or r.text == whole


def test_empty_tables(docs, spark, case):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in dc.decontaminate(docs([(1, "a b c")]), none).collect()} == {0}
    assert dc.decontaminate(docs([(1, "a")]).limit(0), none).count() == 0
