"""Runs end to end on small captures."""

import datetime
import json

import pytest

from tidemark.operators import incremental as inc
from tidemark.operators import matching, report
from tidemark.plans import full_run as fr
from tidemark.sources import schemas, stores

RUN_AT = datetime.datetime(2024, 2, 1, 6)
SITES = [
    (0, "Acme", "https://acme.com/jobs", "http", "start", 20, 3),
    (1, "Down", "https://down.com/jobs", "http", None, 20, 5),
    (2, "Late", "https://late.com/jobs", "playwright", "p", 10, 4),
]
TARGETS = "site_ord bigint, name string, url string, scrape_tier string, pagination_param string, pagination_step int, max_pages int"


def page(text, day=None):
    date = f'<script type="application/ld+json">{{"datePosted": "{day}"}}</script>' if day else ""
    return f"<html><head><title>{text}</title></head><body>{date}<p>{text}</p></body></html>"


CAPTURES = [
    ("Acme", 0, "https://acme.com/jobs/1", "http", 200, page("spark sql python lead")),
    ("Acme", 1, "https://acme.com/jobs/2", "http", 503, None),
    ("Acme", 1, "https://acme.com/jobs/2", "playwright", 200, page("welding")),
    ("Acme", 2, "https://acme.com/jobs/1", "http", 200, page("spark sql python lead again")),
    ("Acme", 3, "https://acme.com/jobs/9", "http", 200, page("beyond the limit")),
    ("Down", 0, "https://down.com/jobs/5", "http", 0, None),
    ("Late", 0, "https://late.com/jobs/20", "playwright", 200, page("spark sql", "2024-01-31")),
    ("Late", 1, "https://late.com/jobs/21", "playwright", 200, page("python", "2024-01-02")),
    ("Late", 2, "https://late.com/jobs/22", "playwright", 200, page("spark sql python unreachable", "2024-01-31")),
]


@pytest.fixture
def inputs(spark):
    return {
        "captures": spark.createDataFrame(CAPTURES, schemas.CAPTURES),
        "targets": spark.createDataFrame(SITES, TARGETS),
        "profiles": spark.createDataFrame([("a.md", "A", "spark sql python"), ("b.md", "B", "welding")], schemas.PROFILES),
        "seen": spark.createDataFrame([], schemas.SEEN),
        "health": spark.createDataFrame([("Late", 0, datetime.datetime(2024, 1, 20)), ("Gone", 2, None)], schemas.HEALTH),
    }


def test_two_runs(spark, inputs):
    first = fr.full_run(**inputs, run_at=RUN_AT, reply_tokens=(10, 10))
    sites = {r["site_name"]: r for r in first["site_results"].collect()}
    # Acme: the second /jobs/1 is the same key; page 3 is above the limit.
    assert [sites["Acme"][c] for c in ("jobs_found", "new_jobs", "n_matches", "tier_used", "error")] == [3, 2, 2, "http", None]
    assert sites["Down"]["error"] == "All scraping tiers failed for Down (https://down.com/jobs)"
    assert (sites["Down"]["tier_used"], sites["Down"]["cost_usd"]) == ("none", 0.0)
    # Late: page 1 is older than the last run, so page 2 is never read.
    assert [sites["Late"][c] for c in ("jobs_found", "new_jobs", "n_matches")] == [2, 2, 0]
    total = first["run_summary"].first()
    assert (total["sites_attempted"], total["sites_succeeded"], total["sites_failed"]) == (3, 2, 1)
    assert (total["total_jobs_found"], total["new_jobs"], total["n_matches"]) == (5, 4, 2)
    assert [r["error"] for r in first["run_errors"].collect()] == ["Down — All scraping tiers failed for Down (https://down.com/jobs)"]
    health = {r[0]: (r[1], r[2]) for r in first["health_next"].collect()}
    assert health == {"Acme": (0, RUN_AT), "Down": (1, None), "Late": (0, RUN_AT), "Gone": (2, None)}
    seen = {r["dedup_key"]: r["match_score"] for r in first["seen_new"].collect()}
    assert set(seen) == {"1", "2", "20", "21"} and seen["1"] == 1.0 and seen["21"] == pytest.approx(1 / 3)
    (message,) = report.messages(fr.digest_of(first)).collect()
    assert "2 new match(es)" in message["text"] and "⚠️ Failed: Down" in message["text"]
    # A page that could not be loaded is part of the site's result and no alert.
    assert first["failures"].count() == 0
    assert sorted(tuple(r) for r in first["quarantine"].collect()) == [("Down", 0, None, "capture", "no usable capture")]

    again = {**inputs, "seen": inc.seen_upsert(inputs["seen"], first["seen_new"]), "health": first["health_next"]}
    second = fr.full_run(**again, run_at=RUN_AT + datetime.timedelta(hours=2))
    total = second["run_summary"].first()
    assert (total["new_jobs"], total["n_matches"]) == (0, 0)
    assert {r[0]: r[1] for r in second["health_next"].collect()}["Down"] == 2
    (message,) = report.messages(fr.digest_of(second)).collect()
    assert "no new matches" in message["text"]


def test_new_and_seen_make_up_found(spark, inputs):
    _, postings = fr.discover(inputs["captures"], inputs["targets"])
    seen = spark.createDataFrame([("1",), ("20",)], "dedup_key string")
    new, known = inc.new_postings(postings, seen), inc.seen_postings(postings, seen)
    assert new.count() + known.count() == postings.count()
    assert known.count() == 3


def test_run_on_replies(spark, inputs):
    """Extraction and match replies instead of the rule-based reader and the lexical score."""
    jobs = [{"title": "One", "url": "/j/1", "job_id": "1", "description": "d"}, {"title": "Two", "url": "", "job_id": "2"},
            {"title": "Three", "url": "", "job_id": None}]
    replies = [
        ("Acme", 0, json.dumps({"jobs": jobs}), 1000, 100),
        ("Acme", 1, "no json", 1000, 100),
        ("Late", 0, "```json\n" + json.dumps({"jobs": jobs[:1]}) + "\n```", 1000, 100),
    ]
    extraction = spark.createDataFrame(replies, "site_name string, page_num int, text string, input_tokens bigint, output_tokens bigint")
    pages, postings = fr.discover_from_replies(inputs["captures"], inputs["targets"], extraction)
    answers = [("1", json.dumps({"best_resume_filename": "a.md", "best_score": 0.9, "missing_keywords": ["k8s"],
                                 "runner_up_filename": "zz.md", "runner_up_score": 0.5}), 1000, 100),
               ("2", json.dumps({"best_resume_filename": "zz.md", "best_score": 0.95}), 1000, 100)]
    matched = spark.createDataFrame(answers, "dedup_key string, text string, input_tokens bigint, output_tokens bigint")
    out = fr.run(inputs["targets"], pages, postings, inputs["profiles"], inputs["seen"], inputs["health"], RUN_AT,
                 score=lambda texts, profiles: matching.reply_scores(matched))
    sites = {r["site_name"]: r for r in out["site_results"].collect()}
    # Acme page 1 has no posting, which ends its reading; Late's posting has the key of Acme's.
    assert [sites["Acme"][c] for c in ("jobs_found", "new_jobs", "n_matches")] == [3, 3, 1]
    assert [sites["Late"][c] for c in ("jobs_found", "new_jobs", "n_matches")] == [1, 0, 0]
    # The reply that names an unknown profile is paid, but gives no result.
    assert sites["Acme"]["cost_usd"] == pytest.approx(0.0008 + 0.0004 + 2 * (0.003 + 0.0015))
    (match,) = out["matches"].collect()
    assert (match["title"], match["best_label"], match["missing_keywords"]) == ("One", "A", ["k8s"])
    assert (match["runner_up_label"], match["runner_up_score"]) == (None, 0.5)
    seen = {r["title"]: r["match_score"] for r in out["seen_new"].collect()}
    assert seen == {"One": 0.9, "Two": None, "Three": None}


def test_quarantine_of_a_run_on_replies(spark, inputs):
    """Every row that a step found is kept or has a reason; alerts come from bad scores alone."""
    long = ("Late", 1, "https://late.com/jobs/21", "playwright", 200, page("x" * 700_000))
    blank = ("Acme", 2, "https://acme.com/jobs/1", "http", 200, "<p> </p>")
    captured = spark.createDataFrame([*CAPTURES[:3], blank, *CAPTURES[4:7], long], schemas.CAPTURES)
    jobs = [{"title": f"T{i}", "url": f"/j/{i}", "job_id": str(i), "description": "d"} for i in range(6)]
    replies = [
        ("Acme", 0, json.dumps({"jobs": jobs}), 1000, 100), ("Acme", 0, "[not the one", 1000, 100),
        ("Acme", 1, json.dumps({"jobs": jobs[5:]}), 1000, 100), ("Acme", 2, json.dumps({"jobs": jobs}), 10, 10),
        ("Late", 0, "no json", 1000, 100),
    ]
    replies = spark.createDataFrame(replies, "site_name string, page_num int, text string, input_tokens bigint, output_tokens bigint")
    answer = lambda **f: json.dumps({"best_resume_filename": "a.md", "best_score": 0.9, **f})
    answers = [("0", answer()), ("1", answer(best_score=None)), ("2", answer(best_resume_filename="zz.md")), ("3", "{"), ("5", answer(best_score="high"))]
    answers = spark.createDataFrame([(k, t, 10, 1) for k, t in answers], "dedup_key string, text string, input_tokens bigint, output_tokens bigint")
    given = {**inputs, "captures": captured}
    out = fr.run_on_replies(**given, run_at=RUN_AT, replies=replies, match_replies=answers, most=5)
    put_aside = {tuple(r) for r in out["quarantine"].collect()}
    assert put_aside == {
        ("Acme", 2, None, "request", "empty page"), ("Acme", 0, 5, "extract", "beyond the cap"),
        ("Acme", 0, 1, "match", "bad score"), ("Acme", 0, 2, "match", "unknown profile"), ("Acme", 0, 3, "match", "unreadable reply"),
        ("Acme", 0, 4, "match", "no reply"), ("Acme", 1, 0, "match", "bad score"),
        ("Late", 0, None, "extract", "unreadable reply"), ("Down", 0, None, "capture", "no usable capture"),
    }
    # the reply to Acme's empty page is not read, two replies to a page do not double it
    assert out["new_postings"].count() == 6 and out["site_results"].where("site_name = 'Acme'").first()["jobs_found"] == 6
    assert out["new_postings"].count() == out["matches"].count() + sum(step == "match" for *_, step, _ in put_aside)
    (alert,) = out["failures"].collect()
    assert "ValueError: 2 posting(s) with a score that is null or not a number" in alert["alert"] and "processing Acme" in alert["alert"]
    _, _, quarantined = fr.discover_replies(captured, inputs["targets"], replies)
    assert ("Late", 1, None, "request", "above the token budget") in {tuple(r) for r in quarantined.collect()}


def test_very_long_pages_are_read_without_a_model(spark, inputs):
    long = ("Late", 3, "https://late.com/jobs/77", "playwright", 200, page("x" * 700_000))
    captured = spark.createDataFrame([*CAPTURES, long], schemas.CAPTURES)
    _, postings = fr.discover(captured, inputs["targets"])
    assert {r["job_id"] for r in postings.where("site_name = 'Late'").collect()} == {"20", "21", "22", "77"}


def test_job_writes_stores_and_gates_only_the_digest(spark, inputs, tmp_path):
    from tidemark import job

    inputs["captures"].write.parquet(str(tmp_path / "captures"))
    sites = [{"name": s[1], "url": s[2], "scrape_tier": s[3], "pagination": {"param": s[4], "step": s[5], "max_pages": s[6]}} for s in SITES]
    (tmp_path / "targets.yaml").write_text(json.dumps({"sites": sites}))
    (tmp_path / "profiles").mkdir()
    (tmp_path / "profiles" / "a.md").write_text("spark sql python")

    def arguments(n, *more):
        return job.parse([
            "--captures", str(tmp_path / "captures"), "--targets", str(tmp_path / "targets.yaml"),
            "--profiles", str(tmp_path / "profiles"), "--seen", str(tmp_path / "seen"),
            "--health-in", str(tmp_path / f"health{n - 1}"), "--health-out", str(tmp_path / f"health{n}"),
            "--digest", str(tmp_path / f"digest{n}"), "--run-id", f"r{n}", *more,
        ])

    assert job.main(spark, arguments(1, "--dry-run"), RUN_AT) == 1
    assert not (tmp_path / "digest1").exists()
    assert stores.read_seen(spark, str(tmp_path / "seen")).count() == 5
    # the same run once more, as after a failure between its writes
    again = arguments(1, "--dry-run", "--health-out", str(tmp_path / "health1-again"))
    assert job.main(spark, again, RUN_AT) == 1
    assert stores.read_seen(spark, str(tmp_path / "seen")).count() == 5
    assert job.main(spark, arguments(2), RUN_AT + datetime.timedelta(hours=2)) == 1
    assert stores.read_seen(spark, str(tmp_path / "seen")).count() == 5
    (message,) = report.messages(spark.read.parquet(str(tmp_path / "digest2"))).collect()
    assert "no new matches" in message["text"]
    health = {r[0]: r[1] for r in stores.read_health(spark, str(tmp_path / "health2")).collect()}
    assert health == {"Acme": 0, "Down": 2, "Late": 0}


def test_job_on_replies_and_alerts(spark, inputs, tmp_path):
    from tidemark import job

    inputs["captures"].write.parquet(str(tmp_path / "captures"))
    sites = [{"name": s[1], "url": s[2], "scrape_tier": s[3], "pagination": {"param": s[4], "step": s[5], "max_pages": s[6]}} for s in SITES]
    (tmp_path / "targets.json").write_text("\n".join(json.dumps(s) for s in sites))
    (tmp_path / "profiles").mkdir()
    (tmp_path / "profiles" / "a.md").write_text("spark sql python")
    posts = json.dumps({"jobs": [{"title": "One", "url": "/j/1", "job_id": "1"}, {"title": "Two", "url": "", "job_id": "2"}]})
    (tmp_path / "replies").mkdir()
    (tmp_path / "replies" / "r.json").write_text(json.dumps({"site_name": "Acme", "page_num": 0, "text": posts, "input_tokens": 10, "output_tokens": 1}))
    (tmp_path / "answers").mkdir()
    answers = [("1", {"best_resume_filename": "a.md", "best_score": 0.8}), ("2", {"best_resume_filename": "a.md", "best_score": None})]
    (tmp_path / "answers" / "r.json").write_text(
        "\n".join(json.dumps({"dedup_key": k, "text": json.dumps(t), "input_tokens": 10, "output_tokens": 1}) for k, t in answers)
    )

    def arguments(*more, **other):
        paths = {"captures": "captures", "targets": "targets.json", "profiles": "profiles", "seen": "seen", "health-in": "h0",
                 "health-out": "h1", "digest": "digest", "quarantine": "aside", **other}
        return job.parse([x for k, v in paths.items() for x in (f"--{k}", str(tmp_path / v))] + ["--run-id", "r1", *more])

    replies = ["--replies", str(tmp_path / "replies"), "--match-replies", str(tmp_path / "answers")]
    assert job.main(spark, arguments(*replies), RUN_AT) == 1
    assert {r["title"]: r["match_score"] for r in stores.read_seen(spark, str(tmp_path / "seen")).collect()} == {"One": 0.8, "Two": None}
    (alert,) = spark.read.parquet(str(tmp_path / "digest-alerts")).collect()
    assert "processing Acme" in alert["alert"]
    aside = {(r["site_name"], r["step"], r["reason"]) for r in spark.read.parquet(str(tmp_path / "aside")).collect()}
    assert ("Acme", "match", "bad score") in aside and ("Late", "extract", "no reply") in aside
    # a run that cannot start
    (tmp_path / "twice.json").write_text("\n".join(json.dumps(s) for s in [*sites, sites[0]]))
    with pytest.raises(ValueError, match="name used 2 times"):
        job.main(spark, arguments(targets="twice.json", digest="other"), RUN_AT)
    (alert,) = spark.read.parquet(str(tmp_path / "other-alerts")).collect()
    assert "ValueError: Acme: name used 2 times" in alert["alert"] and "job startup" in alert["alert"]
    with pytest.raises(ValueError):
        job.main(spark, arguments("--dry-run", targets="twice.json", digest="third"), RUN_AT)
    assert not (tmp_path / "third-alerts").exists()


def test_other_session_zones_are_refused(spark, inputs):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        with pytest.raises(ValueError):
            fr.run(inputs["targets"], inputs["captures"], inputs["captures"], inputs["profiles"],
                   inputs["seen"], inputs["health"], RUN_AT)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
