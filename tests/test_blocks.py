"""Matching in blocks: any size of block and of part gives what a plain join on terms gives, without that join."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.text import terms
from tidemark.operators import blocks, matching
from tidemark.plans import registry


@pytest.fixture(scope="module")
def tables(spark):
    """Words of very uneven frequency, ties, names in other than byte order, rows without terms, text or key."""
    rng = random.Random(7)
    weights = [1 / (i + 1) for i in range(300)]
    text = lambda n: " ".join(f"w{i}" for i in rng.choices(range(300), weights, k=n))
    names = [f"{c}{i}.md" for i in range(20) for c in ("a", "B", "é", "\U0001f600", "｡")]
    rows = [(name, "L", text(rng.choice((1, 3, 20, 60)))) for name in names] + [("lone.md", "L", "lonely"), ("no.md", "L", " "), ("null.md", "L", None)]
    posted = [(str(i), text(rng.choice((1, 5, 40, 150)))) for i in range(60)]
    posted += [("x", "lonely"), ("y", "unheard"), ("z", ""), ("n", None), (None, "w0 w1")]
    return (
        spark.createDataFrame(posted, "dedup_key string, description string"),
        spark.createDataFrame(rows, "filename string, role_label string, content string"),
    )


@pytest.fixture(params=[(7, 50), (40, 3000), (8192, 1 << 21)])
def sizes(request, monkeypatch):
    monkeypatch.setattr(blocks, "PROFILES", request.param[0])
    monkeypatch.setattr(blocks, "MEETINGS", request.param[1])


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def operators(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("least", [0.0, 0.25, 1.0])
def test_pairs_in_blocks(tables, sizes, least):
    got = matching.posting_x_profile(*tables, least=least)
    want = matching.term_scores(*tables).where(F.col("score") >= least)
    assert rows(got, "dedup_key", "filename", "n_shared") == rows(want, "dedup_key", "filename", "n_shared")
    assert "Join" not in operators(got)  # a row for each term that a posting shares with a profile


def test_no_profiles(tables):
    assert matching.posting_x_profile(tables[0], tables[1].limit(0)).count() == 0


def test_top_two_in_blocks(tables, sizes):
    got = matching.top_two(*tables)
    want = matching.best_and_runner_up(matching.term_scores(*tables))
    assert got.dtypes == want.dtypes
    assert rows(got, *want.columns) == rows(want, *want.columns)
    assert "Join" not in operators(got)


def test_requests_take_texts_through_no_join_on_terms(tables):
    """One join by key, for the texts, and two with the profiles that were found."""
    got = matching.match_input(*tables)
    assert operators(got).count("Join") == 3
    named = matching.best_and_runner_up(matching.term_scores(*tables)).collect()
    sections = {r.filename: f"--- Resume: {r.filename} (L) ---\n{r.content}" for r in tables[1].collect()}
    want = {r.dedup_key: "\n\n".join(sections[f] for f in (r.best_filename, r.runner_up_filename) if f) for r in named}
    for r in got.where("dedup_key IS NOT NULL AND description IS NOT NULL").collect():
        head = f"--- Job Description ---\n{r.description}"
        assert r.request == (f"{head}\n\n{want[r.dedup_key]}" if r.dedup_key in want else head)


def test_terms_are_taken_where_texts_meet_a_block(tables):
    """Before the shuffle as many tasks would take them as a file has row groups, and lists of terms would travel."""
    assert "regexp_extract_all" not in operators(matching.top_two(*tables))


def test_terms_of_a_text_are_those_of_the_expression(spark):
    letters = [chr(c) for c in [*range(0x870), *range(0x1E00, 0x2C00), *range(0xFE00, 0x10000)] if c]
    odd = ["ΑΣ ΑΣΑ İI aΣ.", "e\u0301t\u0301 x_y-z", "½²Ⅷ٣ 数字12", "", "\x85a\u2028b\u00a0c", None]
    texts = [f"aSx{c}Yz" for c in letters] + odd
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", terms(F.col("t")).alias("x")).collect()
    assert [r.t for r in got if {w.decode() for w in blocks.term_set(r.t)} != set(r.x or [])] == []


def test_gaps_in_blocks(tables, sizes):
    got = matching.lexical_match(*tables)
    plain = matching.best_and_runner_up(matching.term_scores(*tables)).drop("n_shared", "n_terms")
    want = matching.with_labels(matching.with_gaps(plain, *tables), tables[1])
    assert rows(got, *want.columns) == rows(want, *want.columns)
    assert operators(got).count("Join") == 2  # labels; no join of terms for gaps, no second reading of the texts


def test_first_gaps_leave_a_task_alone(tables, sizes):
    whole, some = (matching.match_scores(*tables, gaps=True, first=n) for n in (None, 8))
    want = [(k, found[:8]) for k, found in rows(whole, "dedup_key", "missing_keywords")]
    assert rows(some, "dedup_key", "missing_keywords") == want
    assert max(len(found) for _, found in rows(whole, "dedup_key", "missing_keywords")) > 8


@pytest.mark.parametrize("name", ["missing_keywords", "missing_top8"])
def test_gap_queries_read_texts_once(spark, name):
    registry.load()
    assert "Join" not in operators(registry.QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_scores_of_a_function_in_blocks(tables, sizes):
    """Pairs are found where they are scored: no join on terms before, one with the postings after it."""

    def overlap(batch):
        wanted = [set(c.split()) for c in batch["content"]]
        return pd.Series([len(w & set(d.split())) / len(w) for d, w in zip(batch["description"], wanted)])

    postings = tables[0].where("dedup_key IS NOT NULL")
    columns = ("dedup_key", "best_filename", "best_score", "runner_up_filename", "runner_up_score")
    want = matching.best_and_runner_up(matching.term_scores(*tables))
    for cell in (7, 256):
        got = matching.score_with(postings, tables[1], overlap, cell=cell)
        assert rows(got.where("best_filename IS NOT NULL"), *columns) == rows(want, *columns)
        assert got.count() == postings.count() and operators(got).count("Join") == 1


def test_a_function_gets_many_pairs_in_a_call(spark):
    """Whatever it does for each text of a batch, it does once a call and not again for every few postings."""
    postings = spark.range(800).selectExpr("CAST(id AS STRING) AS dedup_key", "'w' AS description")
    profiles = spark.range(100).selectExpr("CAST(id AS STRING) AS filename", "'' AS role_label", "'w' AS content")
    got = matching.score_with(postings, profiles, lambda batch: pd.Series([float(len(batch))] * len(batch)))
    assert got.agg(F.min("best_score")).first()[0] > 4096
