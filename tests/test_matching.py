"""Lexical scores, replies and the scoring hook."""

import hashlib
import json
import random
import re

import pandas as pd
import pytest

from tidemark.operators import blocks, extract, matching
from tidemark.plans import registry

registry.load()

PROFILES = [
    ("a.md", "A", "spark sql python"),
    ("b.md", "B", "spark sql python"),
    ("c.md", "C", "welding steel"),
]


@pytest.fixture(scope="module")
def profiles(spark):
    return spark.createDataFrame(PROFILES, "filename string, role_label string, content string")


@pytest.fixture(scope="module")
def postings(spark):
    rows = [("p1", "Spark and SQL, and more Spark"), ("p2", "Steel WELDING; python"), ("p3", "nothing here")]
    return spark.createDataFrame(rows, "dedup_key string, description string")


def by_key(df):
    return {r["dedup_key"]: r for r in df.collect()}


def test_lexical_match(postings, profiles):
    got = by_key(matching.lexical_match(postings, profiles))
    assert set(got) == {"p1", "p2"}
    assert (got["p1"]["best_filename"], got["p1"]["runner_up_filename"]) == ("a.md", "b.md")
    assert got["p1"]["best_score"] == pytest.approx(2 / 3)
    assert got["p1"]["missing_keywords"] == ["and", "more"]
    assert (got["p2"]["best_label"], got["p2"]["runner_up_label"]) == ("C", "A")
    assert got["p2"]["match_reason"] == "shares 2 of 2 profile terms"


def test_scores_are_the_same_without_broadcast(spark, postings, profiles):
    plain = sorted(map(tuple, matching.term_scores(postings, profiles).collect()))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = matching.term_scores(postings, profiles)
        assert "Broadcast" not in shuffled._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, shuffled.collect())) == plain
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_threshold_is_inclusive(spark):
    rows = spark.createDataFrame([("a", 0.7), ("b", 0.69), ("c", None)], "dedup_key string, best_score double")
    assert [r["dedup_key"] for r in matching.match_threshold(rows).collect()] == ["a"]


def test_request_holds_the_whole_description_and_two_whole_profiles(spark, profiles):
    long = "y" * 20_000
    more = profiles.union(spark.createDataFrame([("d.md", "D", "sql " + "z" * 20_000)], profiles.schema))
    rows = spark.createDataFrame([("p", f"sql {long}"), ("none", long)], "dedup_key string, description string")
    got = by_key(matching.match_input(rows, more))
    sections = {f: f"--- Resume: {f} ({label}) ---\n{c}" for f, label, c in map(tuple, more.collect())}
    assert got["p"]["request"] == f"--- Job Description ---\nsql {long}\n\n{sections['d.md']}\n\n{sections['a.md']}"
    assert got["none"]["request"] == f"--- Job Description ---\n{long}"


def test_request_with_every_profile(spark):
    """In the order of their files, whatever they share with a posting, and rows of any key stay."""
    names = [f"{c}{i}.md" for i in (2, 10, 1) for c in ("b", "B", "\u00e9")]
    known = spark.createDataFrame([(f, f.upper(), f"text of {f}\n") for f in names], "filename string, role_label string, content string")
    texts = [("p", "text of b1"), ("p", "the same key"), (None, "no key"), ("unheard", "\u6570 x"), ("empty", ""), ("null", None)]
    posted = spark.createDataFrame(texts, "dedup_key string, description string")
    sections = "".join(f"\n\n--- Resume: {f} ({f.upper()}) ---\ntext of {f}\n" for f in sorted(names))
    for profiles, end in ((known, sections), (known.limit(0), "")):
        got = matching.match_input(posted, profiles, every=True)
        want = [(*row, None if row[1] is None else f"--- Job Description ---\n{row[1]}{end}") for row in texts]
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Repartition" not in plan


def test_requests_of_the_query_hold_every_profile(spark):
    """Those of the given tables, beside a plain loop over their rows."""
    sf = "/root/testdata/sf0.001"
    known = {f"{r.item_id:05d}": r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    sections = "\n\n".join(f"--- Resume: profile_{i}.md (Profile {i}) ---\n{known[i]}" for i in sorted(known))
    got = {r.dedup_key: (r.request_chars, r.request_sha256) for r in registry.QUERIES["match_input"](spark, sf).collect()}
    want = {}
    for row in spark.read.parquet(f"{sf}/documents.parquet").collect():
        request = f"--- Job Description ---\n{row.text}\n\n{sections}"
        want[str(row.doc_id)] = len(request), hashlib.sha256(request.encode()).hexdigest()
    assert len(known) == 40 and got == want


@pytest.fixture(scope="module")
def many(spark):
    """2,000 profiles that all share frequent terms, each with two of its own."""
    rows = [(f"{i:04d}.md", "L", f"common words everywhere own{i} also{i}") for i in range(2000)]
    return spark.createDataFrame(rows, "filename string, role_label string, content string")


@pytest.fixture(scope="module")
def texts(spark):
    texts = [(f"p{i}", f"common words everywhere own{7 * i} also{7 * i + 1}") for i in range(100)]
    return spark.createDataFrame(texts, "dedup_key string, description string")


def test_pairs_of_a_least_score(many, texts):
    pairs = matching.posting_x_profile(texts, many, least=0.7).collect()
    assert {(r.dedup_key, r.filename, r.n_shared) for r in pairs} == {
        (f"p{i}", f"{7 * i + k:04d}.md", 4) for i in range(100) for k in (0, 1)
    }
    assert matching.posting_x_profile(texts.limit(3), many).count() == 3 * 2000


def test_top_two_scores_far_fewer_than_all_pairs(many, texts):
    offered, index = matching.posting_terms(texts), matching.profile_index(many)
    scored = matching.candidates(offered, index, matching.second_bests(offered, index, many)).count()
    assert scored == 200  # of 200,000
    got = by_key(matching.top_two(texts, many))
    assert len(got) == 100
    for i in range(100):
        r = got[f"p{i}"]
        assert (r.best_filename, r.runner_up_filename, r.best_score) == (f"{7 * i:04d}.md", f"{7 * i + 1:04d}.md", 0.8)


@pytest.mark.parametrize("seed", range(3))
def test_top_two_equals_all_pairs_on_random_texts(spark, seed):
    """Words of very uneven frequency, short and long profiles, ties, postings that meet one profile or none."""
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(400)]
    text = lambda n: " ".join(f"w{i}" for i in rng.choices(range(400), weights, k=n))
    rows = [(f"{i:03d}.md", "L", text(rng.choice((1, 3, 20, 60)))) for i in range(150)] + [("lone.md", "L", "lonely"), ("no.md", "L", " ")]
    known = spark.createDataFrame(rows, "filename string, role_label string, content string")
    posted = [(str(i), text(rng.choice((1, 5, 40, 150)))) for i in range(80)] + [("x", "lonely"), ("y", "unheard"), ("z", "")]
    posted = spark.createDataFrame(posted, "dedup_key string, description string")
    got = sorted(map(tuple, matching.top_two(posted, known).collect()))
    assert got == sorted(map(tuple, matching.best_and_runner_up(matching.term_scores(posted, known)).collect()))
    offered, index = matching.posting_terms(posted), matching.profile_index(known)
    pairs = matching.candidates(offered, index, matching.second_bests(offered, index, known))
    assert len(got) > 75 and pairs.count() < matching.sharing_pairs(posted, known).count()


def reply(**fields):
    base = {"best_resume_filename": "a.md", "best_score": 0.85, "match_reason": "r", "missing_keywords": ["k"],
            "runner_up_filename": "b.md", "runner_up_score": 0.7}
    base.update(fields)
    return json.dumps({k: v for k, v in base.items() if v != "absent"})


def test_match_replies(spark, profiles):
    replies = {
        "ok": reply(), "low": reply(best_score=0.2), "no_second": reply(runner_up_filename=None, runner_up_score=None),
        "unknown": reply(best_resume_filename="x.md"), "second_unknown": reply(runner_up_filename="x.md"),
        "invalid": "not json", "no_score": reply(best_score="absent"), "null_score": reply(best_score=None),
        "fenced": "```json\n" + reply() + "\n```", "trailing": reply() + " ok?",
    }
    df = spark.createDataFrame([(k, t, 1, 1) for k, t in replies.items()], "dedup_key string, text string, input_tokens bigint, output_tokens bigint")
    parsed = by_key(matching.parse_match(df))
    assert parsed["null_score"]["bad_score"] and not parsed["ok"]["bad_score"]
    assert parsed["trailing"]["best_filename"] is None and parsed["invalid"]["best_filename"] is None
    got = by_key(matching.resolve_profile(matching.parse_match(df), profiles))
    assert set(got) == {"ok", "low", "no_second", "second_unknown", "no_score", "null_score", "fenced"}
    assert got["ok"]["missing_keywords"] == ["k"] and got["ok"]["runner_up_label"] == "B"
    assert got["no_score"]["best_score"] == 0.0
    assert got["second_unknown"]["runner_up_filename"] is None
    assert got["second_unknown"]["runner_up_score"] == 0.7


def test_score_with_loses_only_the_failing_pair(postings, profiles):
    def fn(batch: pd.DataFrame) -> pd.Series:
        if (batch["filename"] == "b.md").any():
            raise RuntimeError("no answer")
        return batch["content"].str.len() / 100

    got = by_key(matching.score_with(postings.coalesce(1), profiles, fn))
    assert set(got) == {"p1", "p2", "p3"} and got["p3"]["best_filename"] is got["p3"]["error"] is None
    assert (got["p1"]["best_filename"], got["p1"]["best_score"], got["p1"]["runner_up_filename"]) == ("a.md", 0.16, None)
    assert (got["p2"]["best_filename"], got["p2"]["runner_up_filename"]) == ("a.md", "c.md")
    assert got["p1"]["error"] == got["p2"]["error"] == "RuntimeError: no answer"


def test_score_with_finds_the_exact_top_two(spark):
    """All terms of the best profile are terms of more profiles than a rare one has."""
    rows = [(f"{i}.md", "L", "spark sql python" if i < 4 else f"spark own{i} more{i}") for i in range(8)]
    known = spark.createDataFrame(rows, "filename string, role_label string, content string")
    texts = [("all", "spark sql python own6"), ("frequent", "only spark and sql")]
    posted = spark.createDataFrame(texts, "dedup_key string, description string")

    def overlap(batch: pd.DataFrame) -> pd.Series:
        wanted = [set(c.split()) for c in batch["content"]]
        return pd.Series([len(w & set(d.split())) / len(w) for d, w in zip(batch["description"], wanted)])

    got = by_key(matching.score_with(posted, known, overlap))
    want = by_key(matching.best_and_runner_up(matching.term_scores(posted, known)))
    columns = ("best_filename", "best_score", "runner_up_filename", "runner_up_score")
    assert {k: [r[c] for c in columns] for k, r in got.items()} == {k: [r[c] for c in columns] for k, r in want.items()}
    assert got["all"]["best_filename"] == "0.md" and set(got) == {"all", "frequent"}


@pytest.mark.parametrize("cell", [1, 3, 1000])
def test_score_with_in_cells_of_any_size(spark, cell):
    """Given pairs only, each text once in a cell; pairs of unknown names have no score."""
    known = spark.createDataFrame([(f"{i}.md", "L", "c" * (i + 1)) for i in range(7)], "filename string, role_label string, content string")
    posted = spark.createDataFrame([(f"p{i}", "d" * i) for i in range(9)], "dedup_key string, description string")
    pairs = [(f"p{i}", f"{j}.md") for i in range(8) for j in range(8) if (i + j) % 3]
    given = spark.createDataFrame(pairs + pairs[:5], "dedup_key string, filename string")

    def fn(batch: pd.DataFrame) -> pd.Series:
        if (batch["filename"] == "5.md").any():
            raise RuntimeError("no answer")
        return -(batch["content"].str.len() - batch["description"].str.len()).abs()

    got = by_key(matching.score_with(posted, known, fn, given, cell))
    assert set(got) == {f"p{i}" for i in range(9)}
    for i in range(9):
        own = [j for p, f in pairs if p == f"p{i}" and (j := int(f[0])) != 7]
        best = sorted((abs(j + 1 - i), f"{j}.md") for j in own if j != 5)[:2]
        r = got[f"p{i}"]
        want = [(f, -float(d)) for d, f in best] + [(None, None)] * (2 - len(best))
        assert [(r.best_filename, r.best_score), (r.runner_up_filename, r.runner_up_score)] == want
        assert r.error == ("RuntimeError: no answer" if 5 in own else None)


def job(i, **fields):
    return {"title": f"Job {i}", "url": f"/roles/{i}", "job_id": str(i), "description": "d", "snippet": "s",
            "posted_date": "2024-01-15", "posted_time": "14:30", "location": None, **fields}


def test_extraction_replies(spark):
    texts = {
        "many": json.dumps({"jobs": [job(i) for i in range(60)]}), "none": json.dumps({"jobs": []}),
        "bad": '{"jobs": [{"title": "x"}, {"ti', "quotes": "{'jobs': [{'title': 'x'}]}", "list": "[1]",
        "edge": json.dumps({"jobs": [{"url": "", "job_id": None}, job(1, url="https://other.com/x", posted_date=None, posted_time="bad", description=None)]}),
    }
    rows = [(k, t, 1_000_000, 1_000_000, "Acme", "https://firm.test/open-roles") for k, t in texts.items()]
    df = spark.createDataFrame(rows, "request_id string, text string, input_tokens bigint, output_tokens bigint, site_name string, url string")
    got = extract.posting_projection(extract.parse_postings(df)).orderBy("request_id", "pos").collect()
    assert [r["request_id"] for r in got].count("many") == 60
    capped = extract.parse_postings(df, most=extract.MAX_POSTINGS)
    assert capped.filter("request_id = 'many'").count() == 50
    assert {r["request_id"] for r in got} == {"many", "edge"}
    first, second = [r for r in got if r["request_id"] == "edge"]
    assert (first["title"], first["url"], first["job_id"], first["dedup_type"]) == ("", "https://firm.test/open-roles", None, "url_hash")
    assert (second["url"], second["posted_date"], second["posted_time"], second["description"]) == ("https://other.com/x", None, None, None)
    many = [r for r in got if r["request_id"] == "many"][3]
    assert (many["url"], many["posted_time"], many["company"]) == ("https://firm.test/roles/3", "14:30:00", "Acme")
    costs = {r["request_id"]: r["cost_usd"] for r in extract.extraction_cost(df).collect()}
    assert costs["many"] == pytest.approx(4.8) and costs["bad"] == 0.0 and costs["none"] == pytest.approx(4.8)


def test_links(spark):
    html = "<a href='/roles/1'>One &amp; only</a><p><A class=x HREF=rel/2><b>Two</b></A><a name=x>no</a><a href=\"\">Here</a>"
    df = spark.createDataFrame([("https://example.com/c/list?x=1", html)], "url string, html string")
    got = [(r["pos"], r["title"], r["url"]) for r in extract.link_postings(df).orderBy("pos").collect()]
    assert got == [
        (0, "One & only", "https://example.com/roles/1"),
        (1, "Two", "https://example.com/c/rel/2"),
        (2, "Here", "https://example.com/c/list?x=1"),
    ]


def test_term_overlap_equals_a_plain_loop(monkeypatch):
    """Any pairs in any order, and each text is read once a call, whatever the number of its pairs."""
    texts = [f"Spark_SQL  caf\u00e9{i % 3} w{i % 5}, w{i % 7}" + " \u00c9t\u00e9 x-y" * (i % 2) for i in range(40)] + ["", "of its own"]
    known = [f"W{i % 4} sql w{i % 6} \u00e9t\u00e9" for i in range(9)]
    pairs = [(i, k) for k in range(9) for i in range(42) if (i * k) % 5 != 1]
    batch = pd.DataFrame([(f"p{i}", f"{k}.md", texts[i], known[k]) for i, k in pairs], columns=["dedup_key", "filename", "description", "content"])
    read = []
    monkeypatch.setattr(blocks, "term_set", lambda text, fn=blocks.term_set: read.append(text) or fn(text))
    words = lambda text: set(re.findall(r"[^\W_]+", text.lower()))
    want = [len(words(texts[i]) & words(known[k])) / len(words(known[k])) for i, k in pairs]
    assert matching.term_overlap(batch).tolist() == want
    assert len(read) == 42 + 9
