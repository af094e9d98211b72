"""Targets, profiles, captures, tiers."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import capture
from tidemark.sources import captures, profiles, replies, schemas, staging, targets

SITES = [
    {"name": "A", "url": "https://a.com", "scrape_tier": "http"},
    {"name": "B", "url": "https://b.com?x=1", "scrape_tier": "playwright", "pagination": None},
    {"name": "C", "url": "https://c.com", "scrape_tier": "http", "pagination": {"param": "start"}},
    {"name": "D", "url": "https://d.com#f", "scrape_tier": "http", "pagination": {"param": "p", "step": 10, "max_pages": 2}},
]
FLAT = {"A": (None, 20, 5), "B": (None, 20, 5), "C": ("start", 20, 5), "D": ("p", 10, 2)}


@pytest.mark.parametrize("form", ["json", "yaml"])
def test_targets_from_files(spark, tmp_path, form):
    path = tmp_path / f"targets.{form}"
    if form == "json":
        path.write_text("\n".join(json.dumps(s) for s in SITES))
    else:
        path.write_text(json.dumps({"sites": SITES}))  # JSON is YAML
    flat = targets.site_targets(targets.read_targets_raw(spark, str(path)))
    got = {r["name"]: (r["pagination_param"], r["pagination_step"], r["max_pages"]) for r in flat.collect()}
    assert got == FLAT


def test_invalid_targets(spark):
    rows = [("A", "https://x.com/1", "ftp", None), ("B", "https://x.com/2", "http", None), ("C", "https://c.com", None, None)]
    raw = spark.createDataFrame(rows, schemas.TARGETS_RAW)
    problems = {(r["name"], r["problem"].split(" ")[0]) for r in targets.invalid_targets(raw).collect()}
    assert problems == {("A", "Invalid"), ("C", "Invalid"), ("x.com", "host")}
    assert [r["name"] for r in targets.valid_targets(raw).collect()] == ["B"]
    with pytest.raises(ValueError):
        targets.require_sites(raw.limit(0))


def test_profiles_folder(spark, tmp_path):
    (tmp_path / "ai_engineer.md").write_text("line one\nline two\n")
    (tmp_path / "lead_welder.md").write_text("x" * 10_000)
    (tmp_path / "notes.txt").write_text("ignored")
    got = [(r["filename"], r["role_label"], len(r["content"])) for r in
           profiles.sorted_profiles(profiles.read_profiles(spark, str(tmp_path))).collect()]
    assert got == [("ai_engineer.md", "AI Engineer", 18), ("lead_welder.md", "Lead Welder", 10_000)]
    empty = tmp_path / "empty"
    empty.mkdir()
    (empty / "x.txt").write_text("x")
    with pytest.raises(ValueError):
        profiles.read_profiles(spark, str(empty))


def test_profiles_are_written_and_read(spark, tmp_path):
    rows = [(f"p_{i:03d}.md", f"text {i}\nwith \u00e9 and {'x' * i}\n") for i in range(40)]
    table = spark.createDataFrame(rows, "filename string, content string").repartition(5)
    assert profiles.write_profiles(table, str(tmp_path / "out")) == 40
    profiles.write_profiles(table.limit(3), f"file://{tmp_path}/out")  # once more, over what is there
    back = profiles.read_profiles(spark, str(tmp_path / "out"))
    assert sorted((r.filename, r.content) for r in back.collect()) == rows and back.first()["role_label"].startswith("P ")
    assert not [f for f in os.listdir(tmp_path / "out") if f.startswith(".") and not f.endswith(".crc")]
    with pytest.raises(Exception, match="no name of a .md file"):
        profiles.write_profiles(spark.createDataFrame([("../x.md", "t")], "filename string, content string"), str(tmp_path))


def test_replies_are_written_and_read(spark, tmp_path):
    rows = [("1", '{"jobs": []}', 10, 2), ("2", "line\n\u00e9 \"quoted\"", None, 0), ("3", None, 1, 1)]
    replies.write_replies(spark.createDataFrame(rows, schemas.REPLIES), str(tmp_path / "replies"))
    assert sorted(map(tuple, replies.read_replies(spark, str(tmp_path / "replies")).collect())) == rows


CAPTURED = [
    ("A", 0, "u", "http", 200, "a-http"), ("A", 0, "u", "playwright", 200, "a-pw"),
    ("A", 1, "u", "http", 403, "x"), ("A", 1, "u", "playwright", 200, "a1-pw" + "x" * 300),
    ("A", 2, "u", "http", 0, None), ("A", 2, "u", "playwright", None, None),
    ("B", 0, "u", "http", 200, "b-http"), ("B", 0, "u", "playwright", 204, "b-pw"),
    ("B", 1, "u", "http", 200, "b1-http"),
]


def test_tier_fallback_and_status(spark, tmp_path):
    caps = spark.createDataFrame(CAPTURED, schemas.CAPTURES)
    sites = spark.createDataFrame([("A", "u", "http", None), ("B", "u", "playwright", None)], schemas.TARGETS_RAW)
    got = {(r["site_name"], r["page_num"]): (r["tier_used"], r["html"][:5]) for r in
           capture.tier_fallback(caps, targets.site_targets(sites)).collect()}
    stored = str(tmp_path / "captures")
    captures.write_captures(caps, stored)
    again = capture.tier_fallback(captures.read_captures(spark, stored), targets.site_targets(sites))
    assert {(r["site_name"], r["page_num"]): (r["tier_used"], r["html"][:5]) for r in again.collect()} == got
    keys = again.select("site_name")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<site_name" in keys and "html" not in keys
    assert got == {("A", 0): ("http", "a-htt"), ("A", 1): ("playwright", "a1-pw"), ("B", 0): ("playwright", "b-pw")}
    reasons = [r["reason"] for r in captures.capture_status(caps).orderBy("site_name", "page_num", "tier").collect()]
    assert reasons == [None, None, "HTTP 403", None, "timeout", "connection error", None, None, None]
    tiers = {r[0]: r[1] for r in captures.tier_recommend(caps.filter("page_num = 1")).collect()}
    assert tiers == {"A": "playwright", "B": "http"}
    shown = spark.createDataFrame([("F", 0, "u", "http", 403, "no"), ("F", 0, "u", "playwright", 403, "y" * 201)], schemas.CAPTURES)
    assert captures.tier_recommend(shown).first()["recommended_tier"] == "playwright"
    only_failed = spark.createDataFrame([("F", 0, "u", "http", 503, None), ("F", 0, "u", "playwright", 200, "short")], schemas.CAPTURES)
    assert captures.tier_recommend(only_failed).first()["recommended_tier"] == "failed"


def test_page_offsets_and_limit(spark):
    raw = spark.createDataFrame(
        [(s["name"], s["url"], s["scrape_tier"], s.get("pagination") and (s["pagination"].get("param"), s["pagination"].get("step"), s["pagination"].get("max_pages"))) for s in SITES],
        schemas.TARGETS_RAW,
    )
    flat = targets.site_targets(raw)
    pages = capture.page_offsets(flat)
    got = {(r["name"], r["page_num"]): r["page_url"] for r in pages.collect()}
    assert len(got) == 1 + 1 + 5 + 2
    assert got["B", 0] == "https://b.com?x=1"
    assert got["C", 3] == "https://c.com?start=60"
    assert got["D", 1] == "https://d.com?p=10#f"
    many = flat.filter("name = 'C'").selectExpr("name", "url", "scrape_tier", "pagination_param", "pagination_step", "3000 as max_pages")
    assert capture.page_offsets(many).selectExpr("count(distinct page_num)", "max(page_num)").first()[:] == (3000, 2999)
    caps = spark.createDataFrame([("D", p, "u", "http", 200, "x") for p in range(4)], schemas.CAPTURES)
    assert capture.page_limit(caps, flat).count() == 2


def test_token_budget_is_inclusive(spark):
    texts = [("a", ""), ("b", "x" * 43), ("c", "x" * 44), ("d", "😀" * 43)]
    df = spark.createDataFrame(texts, "k string, text string")
    assert sorted(r["k"] for r in capture.token_budget(df, 10).collect()) == ["b", "d"]


def test_staged_tables_are_deleted_and_others_are_not(spark, tmp_path):
    table = staging.stage(spark.range(5), "numbers")
    other = staging.stage(table.selectExpr("id * 2 AS id"), "others")
    staging.discard(table)
    assert sorted(r.id for r in other.collect()) == [0, 2, 4, 6, 8]
    assert not os.path.exists(table.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0].replace("///", "/"))
    spark.range(3).write.parquet(str(tmp_path / "mine"))
    with pytest.raises(ValueError, match="not a staged table"):
        staging.discard(spark.read.parquet(str(tmp_path / "mine")))


def test_the_browser_tier_counts_by_its_content(spark):
    rows = [
        ("A", 0, "u", "http", 403, "no"), ("A", 0, "u", "playwright", 403, "shown all the same"),
        ("A", 1, "u", "http", 500, None), ("A", 1, "u", "playwright", 200, None),
        ("A", 2, "u", "http", 204, None), ("A", 2, "u", "playwright", 200, "not needed"),
        ("A", 3, "u", "playwright", None, "no first try"),
    ]
    caps = spark.createDataFrame(rows, schemas.CAPTURES)
    sites = spark.createDataFrame([("A", "u", "http", None)], schemas.TARGETS_RAW)
    got = {r["page_num"]: (r["tier_used"], r["html"]) for r in capture.tier_fallback(caps, targets.site_targets(sites)).collect()}
    assert got == {0: ("playwright", "shown all the same"), 2: ("http", ""), 3: ("playwright", "no first try")}
    reasons = [r["reason"] for r in captures.capture_status(caps).orderBy("page_num", "tier").collect()]
    assert reasons == ["HTTP 403", None, "HTTP 500", "browser error", None, None, None]


def test_captures_in_buckets_shuffle_no_html(spark, tmp_path):
    rows = [(f"s{i % 7}", i // 7, "u", t, 200 if (i + k) % 3 else 503, f"{t}{i}") for i in range(60) for k, t in enumerate(("http", "playwright"))]
    plain = spark.createDataFrame(rows, schemas.CAPTURES).withColumn("scrape_tier", F.lit("http"))
    captures.write_bucketed(plain, "bucketed_captures", 4, str(tmp_path / "bucketed"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        chosen = capture.tier_fallback(spark.table("bucketed_captures"))
        got = sorted(map(tuple, chosen.select("site_name", "page_num", "tier_used", "html").collect()))
        assert "Exchange" not in chosen._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("DROP TABLE bucketed_captures")
    assert got == sorted(map(tuple, capture.tier_fallback(plain).select("site_name", "page_num", "tier_used", "html").collect()))
    assert len(got) == 60
