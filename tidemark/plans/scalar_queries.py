"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls, values
from ..operators import capture, extract, matching, report
from . import bindings as b
from . import oracle as o
from .registry import query


@query(f"SELECT page_id, {o.clean('html')} AS text FROM pages")
def html_clean(spark, sf):
    return b.table(spark, sf, "pages").select("page_id", tx.html_clean(F.col("html")).alias("text"))


@query(f"""
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'datePosted: 2024-03-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') || chr(10)
       ELSE '' END || {o.clean('html')} AS text FROM pages""")
def jsonld_date(spark, sf):
    # A script element before each page: with a date, with a broken body, with another type.
    n = F.col("page_id")
    day = F.lpad((n % 28 + 1).cast("string"), 2, "0")
    script = (
        F.when(
            n % 3 == 0,
            F.concat(
                F.lit('<script type="application/ld+json">{"url": "'), "url",
                F.lit('", "datePosted": "2024-03-'), day, F.lit('"}</script>'),
            ),
        )
        .when(n % 3 == 1, F.lit('<script type="application/ld+json">{"datePosted": {{{</script>'))
        .otherwise(F.lit('<script type="text/javascript">{"datePosted": "2024-03-01"}</script>'))
    )
    return b.table(spark, sf, "pages").select(
        "page_id", tx.html_clean(F.concat(script, "html")).alias("text")
    )


@query(f"""
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '1999-12-31' ELSE 'at noon' END || chr(10)
       || {o.clean('html')} AS text FROM pages""")
def time_tag(spark, sf):
    tag = F.when(
        F.col("page_id") % 2 == 0,
        F.lit('<time lang="de" datetime="1999-12-31">New <b>Year</b></time>'),
    ).otherwise(F.lit("<time>at noon</time>"))
    return b.table(spark, sf, "pages").select(
        "page_id", tx.html_clean(F.concat(tag, "html")).alias("text")
    )


@query(f"""
SELECT page_id, {o.with_param('url', "'page'", "CAST(page_id % 7 * 20 AS VARCHAR)")} AS page_url,
       {o.with_param('url', "'start'", "CAST(page_id % 7 * 20 AS VARCHAR)")} AS start_url FROM pages""")
def page_url(spark, sf):
    offset = F.col("page_id") % 7 * 20
    return b.table(spark, sf, "pages").select(
        "page_id",
        urls.page_url(F.col("url"), F.lit("page"), offset).alias("page_url"),
        urls.page_url(F.col("url"), F.lit("start"), offset).alias("start_url"),
    )


@query(f"""
WITH {o.TG}, {o.EXPECTED}
SELECT name, page_num, CAST(page_num * step AS INTEGER) AS page_offset,
       CASE WHEN param IS NULL THEN url ELSE {o.with_param('url', 'param', 'CAST(page_num * step AS VARCHAR)')} END AS page_url
FROM ex""")
def page_offsets(spark, sf):
    from ..sources.targets import site_targets

    pages = capture.page_offsets(site_targets(b.targets_raw(spark, sf)))
    return pages.select("name", "page_num", "page_offset", "page_url")


_BASE = "regexp_extract(url, '^([^?#]*)')"
_HOST = "regexp_extract(url, '^[a-z]+://[^/]+')"
_DIR = f"regexp_replace({_BASE}, '[^/]*$', '')"
_UP = f"CASE WHEN {_DIR} = {_HOST} || '/' THEN {_DIR} ELSE regexp_replace({_DIR}, '[^/]+/$', '') END"


@query(f"""
SELECT page_id, CASE page_id % 9
  WHEN 0 THEN url WHEN 1 THEN {_HOST} || '/jobs/' || page_id
  WHEN 2 THEN regexp_extract(url, '^[a-z]+:') || '//other.example.com/x'
  WHEN 3 THEN {_BASE} || '?q=' || page_id
  WHEN 4 THEN regexp_extract(url, '^[^#]*') || '#apply'
  WHEN 5 THEN {_DIR} || 'rel/' || page_id || '.html'
  WHEN 6 THEN {_UP} || 'up?x=1#y'
  WHEN 7 THEN 'mailto:jobs@example.com'
  ELSE {_HOST} || '/b/' END AS resolved FROM pages""")
def resolve_url(spark, sf):
    n = F.col("page_id")
    number = n.cast("string")
    link = (
        F.when(n % 9 == 0, "")
        .when(n % 9 == 1, F.concat(F.lit("/jobs/"), number))
        .when(n % 9 == 2, "//other.example.com/x")
        .when(n % 9 == 3, F.concat(F.lit("?q="), number))
        .when(n % 9 == 4, "#apply")
        .when(n % 9 == 5, F.concat(F.lit("rel/./"), number, F.lit(".html")))
        .when(n % 9 == 6, "../up?x=1#y")
        .when(n % 9 == 7, "mailto:jobs@example.com")
        .otherwise("/a/../../b/.")
    )
    return b.table(spark, sf, "pages").select(
        "page_id", urls.resolve_url(link, F.col("url")).alias("resolved")
    )


_DAY = "CAST(o_orderdate AS DATE)"


@query(f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (0, 1, 2, 3) THEN strftime({_DAY}, '%Y-%m-%d') END AS parsed
FROM orders""")
def parse_date(spark, sf):
    n, day = F.col("o_orderkey"), F.col("o_orderdate")
    monday = F.date_trunc("week", day)
    weekday = F.datediff(day, monday) + 1
    iso_year = F.year(F.date_add(F.to_date(monday), 3)).cast("string")
    week = F.lpad(F.weekofyear(day).cast("string"), 2, "0")
    raw = (
        F.when(n % 6 == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(n % 6 == 1, F.date_format(day, "yyyyMMdd"))
        .when(n % 6 == 2, F.concat(iso_year, F.lit("-W"), week, F.lit("-"), weekday.cast("string")))
        .when(n % 6 == 3, F.concat(iso_year, F.lit("W"), week, weekday.cast("string")))
        .when(n % 6 == 4, F.date_format(day, "yyyy-M"))
        .otherwise(F.concat(F.year(day).cast("string"), F.lit("-02-30")))
    )
    return b.table(spark, sf, "orders").select(
        "o_orderkey", values.parse_date(raw).cast("string").alias("parsed")
    )


@query("""
SELECT event_id, CASE event_id % 5
  WHEN 0 THEN strftime(ts, '%H:%M:00') WHEN 1 THEN strftime(ts, '%H:%M:%S') WHEN 2 THEN strftime(ts, '%H:%M:%S')
  END AS parsed FROM events""")
def parse_time(spark, sf):
    n, ts = F.col("event_id"), F.col("ts")
    raw = (
        F.when(n % 5 == 0, F.date_format(ts, "HH:mm"))
        .when(n % 5 == 1, F.date_format(ts, "HH:mm:ss"))
        .when(n % 5 == 2, F.date_format(ts, "'T'HHmmss'+02:00'"))
        .when(n % 5 == 3, F.date_format(ts, "'2'5:mm"))
        .otherwise("not-a-time")
    )
    return b.table(spark, sf, "events").select("event_id", values.parse_time(raw).alias("parsed"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 3 = 0 THEN
  strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d ') || printf('%02d:30:00', o_orderkey % 24) END AS posted_at
FROM orders""")
def posted_at(spark, sf):
    n = F.col("o_orderkey")
    day = F.when(n % 7 != 0, F.to_date("o_orderdate"))
    clock = F.when(n % 3 == 0, F.format_string("%02d:30:00", n % 24))
    return b.table(spark, sf, "orders").select(
        "o_orderkey",
        F.date_format(values.posted_at(day, clock), "yyyy-MM-dd HH:mm:ss").alias("posted_at"),
    )


@query(f"""
SELECT page_id, CASE WHEN page_id % 2 = 0 OR page_id % 10 = 1 THEN substr(sha256(url), 1, 16) ELSE {o.KEY} END AS dedup_key,
       CASE WHEN page_id % 2 = 0 OR page_id % 10 = 1 THEN 'url_hash' ELSE 'job_id' END AS dedup_type
FROM pages""")
def dedup_key(spark, sf):
    n = F.col("page_id")
    job_id = F.when(n % 2 == 0, F.lit(None)).when(n % 10 == 1, "").otherwise(
        b.number_in_url(F.col("url"))
    )
    return b.table(spark, sf, "pages").select(
        "page_id",
        values.dedup_key(job_id, F.col("url")).alias("dedup_key"),
        values.dedup_type(job_id).alias("dedup_type"),
    )


@query(f"""
WITH {o.REPLIES} SELECT request_id, {o.unfenced('text')} AS body FROM replies""")
def strip_fences(spark, sf):
    return b.extraction_replies(spark, sf).select(
        "request_id", tx.strip_fences(F.col("text")).alias("body")
    )


@query(f"""
WITH {o.REPLIES},
r AS (SELECT request_id, {o.unfenced('text')} AS t FROM replies),
j AS (SELECT request_id, unnest(json_extract(t, '$.jobs[*]')) AS job,
             generate_subscripts(json_extract(t, '$.jobs[*]'), 1) - 1 AS pos
      FROM r WHERE json_valid(t))
SELECT request_id, CAST(pos AS INTEGER) AS pos, job->>'$.title' AS title, job->>'$.job_id' AS raw_job_id FROM j""")
def parse_postings(spark, sf):
    return extract.parse_postings(b.extraction_replies(spark, sf)).select(
        "request_id", "pos", F.col("job")["title"].alias("title"),
        F.col("job")["job_id"].alias("raw_job_id"),
    )


@query(f"""
WITH {o.PARSED_MATCH}
SELECT dedup_key, best_filename, best_score, match_reason, missing_keywords, runner_up_filename, runner_up_score,
       coalesce(ok AND best_score IS NULL, false) AS bad_score FROM parsed""")
def parse_match(spark, sf):
    return matching.parse_match(b.match_replies(spark, sf)).select(
        "dedup_key", "best_filename", "best_score", "match_reason",
        F.array_join("missing_keywords", ",").alias("missing_keywords"),
        "runner_up_filename", "runner_up_score", "bad_score",
    )


@query("""
WITH s AS (SELECT printf('profile_%05d.md', item_id) AS filename, chr(10) || chr(10) || '--- Resume: ' || printf('profile_%05d.md', item_id)
        || ' (Profile ' || printf('%05d', item_id) || ') ---' || chr(10) || text AS section FROM benchmark),
a AS (SELECT coalesce(string_agg(section, '' ORDER BY filename, section), '') AS sections FROM s),
r AS (SELECT CAST(doc_id AS VARCHAR) AS dedup_key, '--- Job Description ---' || chr(10) || text || sections AS request FROM documents, a)
SELECT dedup_key, length(request) AS request_chars, sha256(request) AS request_sha256 FROM r""")
def match_input(spark, sf):
    requests = matching.match_input(b.documents(spark, sf), b.profiles(spark, sf), every=True)
    return requests.select(
        "dedup_key",
        F.length("request").cast("bigint").alias("request_chars"),
        F.sha2("request", 256).alias("request_sha256"),
    )


@query(f"""
SELECT conv_id, turn, 'Company: ' || role || chr(10) || 'Site URL: https://example.com/' || conv_id
       || chr(10) || chr(10) || text AS request FROM conversations""")
def extract_input(spark, sf):
    url = F.concat(F.lit("https://example.com/"), F.col("conv_id").cast("string"))
    return b.table(spark, sf, "conversations").select(
        "conv_id", "turn", extract.extract_input(F.col("role"), url, F.col("text")).alias("request")
    )


@query("""
WITH f AS (SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN 'ai_engineer.md' WHEN 1 THEN 'data_scientist.md'
    WHEN 2 THEN 'software_engineer_ai.md' WHEN 3 THEN source || '_data2analyst.md'
    ELSE 'senior_' || lang || '_' || upper(source) || '.v' || doc_id % 4 || '.md' END AS filename FROM documents)
SELECT doc_id, filename, CASE filename WHEN 'ai_engineer.md' THEN 'AI Engineer' WHEN 'data_scientist.md' THEN 'Data Scientist'
  WHEN 'software_engineer_ai.md' THEN 'Software Engineer (AI Focused)' ELSE array_to_string(list_transform(
  regexp_extract_all(replace(regexp_replace(filename, '\\.md$', ''), '_', ' '), '[A-Za-z]+|[^A-Za-z]+'),
  lambda w: upper(w[1]) || lower(w[2:])), '') END AS label FROM f""")
def profile_label(spark, sf):
    n = F.col("doc_id")
    filename = (
        F.when(n % 10 == 0, "ai_engineer.md")
        .when(n % 10 == 1, "data_scientist.md")
        .when(n % 10 == 2, "software_engineer_ai.md")
        .when(n % 10 == 3, F.concat("source", F.lit("_data2analyst.md")))
        .otherwise(
            F.concat(
                F.lit("senior_"), "lang", F.lit("_"), F.upper("source"), F.lit(".v"),
                (n % 4).cast("string"), F.lit(".md"),
            )
        )
    )
    return (
        b.table(spark, sf, "documents")
        .select("doc_id", filename.alias("filename"))
        .withColumn("label", values.profile_label(F.col("filename")))
    )


_SCORE = "(o_orderkey % 201 / 200.0::DOUBLE)"


@query(f"""
SELECT o_orderkey, CAST(CAST(round_even({_SCORE} * 100, 0) AS BIGINT) AS VARCHAR) || '%' AS pct FROM orders""")
def score_pct(spark, sf):
    score = F.col("o_orderkey") % 201 / F.lit(200.0)
    return b.table(spark, sf, "orders").select("o_orderkey", values.score_pct(score).alias("pct"))


@query(f"""
SELECT o_orderkey, CASE WHEN {_SCORE} >= 0.9 THEN 'exceptional' WHEN {_SCORE} >= 0.75 THEN 'strong'
  WHEN {_SCORE} >= 0.6 THEN 'moderate' ELSE 'weak' END AS band FROM orders""")
def score_band(spark, sf):
    score = F.col("o_orderkey") % 201 / F.lit(200.0)
    return b.table(spark, sf, "orders").select("o_orderkey", values.score_band(score).alias("band"))


@query("SELECT o_orderkey, printf('$%.4f', o_totalprice / 1000000) AS cost FROM orders")
def cost_str(spark, sf):
    cost = F.col("o_totalprice") / 1_000_000
    return b.table(spark, sf, "orders").select("o_orderkey", values.cost_str(cost).alias("cost"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS run_time FROM events")
def run_time_str(spark, sf):
    return b.table(spark, sf, "events").select(
        "event_id", values.run_time_str(F.col("ts")).alias("run_time")
    )


MATCH_ROWS = f"""{o.PG}, {o.TG},
mr AS (
  SELECT site_name AS company, site_ord, page_num, page_id AS n, 'Role ' || job_id AS title,
         'Profile ' || printf('%05d', page_id % 40) AS best_label, 0.7 + (page_id * 37 % 300) / 1000 AS best_score,
         'shares ' || page_id % 50 || ' terms' AS match_reason,
         CASE WHEN page_id % 3 = 1 THEN 'spark, k' || page_id END AS missing,
         CASE WHEN page_id % 5 <> 1 THEN 'Profile ' || printf('%05d', page_id % 30) END AS runner_up_label,
         CASE WHEN page_id % 7 <> 1 THEN (page_id * 13 % 700) / 1000 END AS runner_up_score, pg.url
  FROM pg JOIN tg ON pg.site_name = tg.name),
ml AS (
  SELECT *, concat_ws(chr(10), '├ 🎯 <b>' || title || '</b>',
    '│  Resume: <i>' || best_label || '</i> · Match: <b>' || CAST(round_even(best_score * 100, 0) AS BIGINT) || '%</b>',
    '│  ' || match_reason, '│  ⚠️ Missing: ' || missing,
    '│  Runner-up: ' || runner_up_label || ' · ' || CAST(round_even(runner_up_score * 100, 0) AS BIGINT) || '%',
    '│  <a href="' || url || '">View Job →</a>') AS lines
  FROM mr)"""


@query(f"WITH {MATCH_ROWS} SELECT company, page_num, lines FROM ml")
def digest_lines(spark, sf):
    return b.reported_matches(spark, sf).select(
        "company", "page_num", report.digest_lines().alias("lines")
    )


@query("""
WITH r AS (
  SELECT o_custkey, max(o_orderdate) AS run_at, count(*) AS attempted, count(*) FILTER (o_orderstatus = 'F') AS failed,
         sum(o_orderkey) AS jobs, sum(o_orderkey % 10) AS new, count(*) FILTER (o_orderstatus = 'P') AS matches,
         round(sum(o_totalprice) / 1000000, 3) AS cost
  FROM orders GROUP BY o_custkey)
SELECT o_custkey,
  CASE WHEN matches = 0 THEN '✅ <b>Posting digest — no new matches</b>' || chr(10) || '<i>' || strftime(run_at, '%Y-%m-%d %H:%M')
    || ' UTC</i>' || chr(10) || chr(10) || '📊 Sites: ' || attempted || ' · Jobs: ' || CAST(jobs AS BIGINT) || ' · New: '
    || CAST(new AS BIGINT) || ' · Matches: 0' || chr(10) || '💰 Cost: ' || printf('$%.4f', cost)
  ELSE '🔍 <b>Posting digest — ' || matches || ' new match(es)</b>' || chr(10) || '<i>' || strftime(run_at, '%Y-%m-%d %H:%M')
    || ' UTC</i>' || chr(10) END AS header,
  CASE WHEN matches > 0 THEN chr(10) || '──────────────────' || chr(10) || '📊 <b>Run summary</b>' || chr(10) || 'Sites: '
    || attempted || ' checked · ' || (attempted - failed) || ' OK · ' || failed || ' failed' || chr(10) || 'Jobs: '
    || CAST(jobs AS BIGINT) || ' found · ' || CAST(new AS BIGINT) || ' new · ' || matches || ' matches' || chr(10)
    || '💰 Cost: ' || printf('$%.4f', cost) END AS footer
FROM r""")
def digest_header_footer(spark, sf):
    # One run per customer.
    runs = (
        b.table(spark, sf, "orders")
        .groupBy("o_custkey")
        .agg(
            F.max("o_orderdate").alias("run_at"),
            F.count("*").alias("sites_attempted"),
            F.count_if(F.col("o_orderstatus") != "F").alias("sites_succeeded"),
            F.count_if(F.col("o_orderstatus") == "F").alias("sites_failed"),
            F.sum("o_orderkey").alias("total_jobs_found"),
            F.sum(F.col("o_orderkey") % 10).alias("new_jobs"),
            F.count_if(F.col("o_orderstatus") == "P").alias("n_matches"),
            F.round(F.sum("o_totalprice") / 1_000_000, 3).alias("total_cost_usd"),
        )
    )
    return runs.select(
        "o_custkey", report.digest_header().alias("header"), report.digest_footer().alias("footer")
    )
