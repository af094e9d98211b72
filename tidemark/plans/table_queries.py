"""Sources, filters, joins, aggregates and order-dependent rules over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.values import usage_cost as cost_of
from ..operators import capture, extract, incremental, matching, report
from ..sources import captures as cap
from ..sources import profiles as prof
from ..sources import replies, staging, stores, targets
from . import bindings as b
from . import oracle as o
from .registry import query
from .scalar_queries import MATCH_ROWS

RUN_AT = "2024-02-01 06:00:00"


def stamp(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


# Sources

@query(f"""
WITH {o.TG} SELECT name, url, scrape_tier, param AS pagination_param, CAST(step AS INTEGER) AS pagination_step,
  CAST(max_pages AS INTEGER) AS max_pages FROM tg""")
def site_targets(spark, sf):
    return targets.site_targets(b.targets_raw(spark, sf)).drop("site_ord")


@query(f"""
WITH {o.TG},
t AS (SELECT regexp_replace(name, '^(www|blog|m)\\.', '') AS name, url,
             CASE WHEN site_ord % 11 = 0 THEN 'ftp' ELSE scrape_tier END AS scrape_tier FROM tg)
SELECT name, 'Invalid scrape_tier ''' || scrape_tier || ''' for site ''' || name
       || '''. Must be one of: [''http'', ''playwright'']' AS problem FROM t WHERE scrape_tier = 'ftp'
UNION ALL SELECT name, 'name used ' || count(*) || ' times' FROM t GROUP BY name HAVING count(*) > 1
UNION ALL SELECT h, 'host used ' || count(*) || ' times'
          FROM (SELECT regexp_extract(url, '//([^/?#]+)', 1) AS h FROM t) GROUP BY h HAVING count(*) > 1""")
def invalid_targets(spark, sf):
    raw = b.targets_raw(spark, sf).withColumns(
        {
            "name": F.regexp_replace("name", r"^(www|blog|m)\.", ""),
            "scrape_tier": F.when(F.col("site_ord") % 11 == 0, "ftp").otherwise(F.col("scrape_tier")),
        }
    )
    return targets.invalid_targets(raw)


@query("""
SELECT printf('profile_%05d.md', item_id) AS filename, 'Profile ' || printf('%05d', item_id) AS role_label,
       text AS content FROM benchmark""")
def profiles(spark, sf):
    folder = staging.new_folder(spark, "profiles")
    prof.write_profiles(b.profiles(spark, sf), folder)
    return prof.read_profiles(spark, folder)


@query("""
SELECT printf('profile_%05d.md', item_id) AS filename, 'Profile ' || printf('%05d', item_id) AS role_label,
       length(text) AS n_chars FROM benchmark ORDER BY filename""")
def sorted_profiles(spark, sf):
    return prof.sorted_profiles(b.profiles(spark, sf)).select(
        "filename", "role_label", F.length("content").cast("bigint").alias("n_chars")
    )


_CAPS = f"""{o.PG},
cap AS (
  SELECT page_id, site_name, page_num, url, 'http' AS tier, CASE WHEN page_id % 6 = 0 THEN 503 ELSE 200 END AS status, html FROM pg
  UNION ALL
  SELECT page_id, site_name, page_num, url, 'playwright', CASE WHEN page_id % 30 = 0 THEN 0 WHEN page_id % 18 = 0 THEN 403 ELSE 200 END,
         CASE WHEN page_id % 30 <> 0 THEN html END FROM pg)"""


def _captures(spark, sf):
    return b.captures(b.numbered_pages(spark, sf, "html"), F.col("html"))


@query(f"""
WITH {_CAPS} SELECT site_name, page_num, url, tier, status, sha256(html) AS html_sha256 FROM cap""")
def page_captures(spark, sf):
    folder = staging.new_folder(spark, "captures")
    cap.write_captures(_captures(spark, sf), folder)
    return cap.read_captures(spark, folder).select(
        "site_name", "page_num", "url", "tier", "status", F.sha2("html", 256).alias("html_sha256")
    )


@query(f"""
WITH {_CAPS} SELECT site_name, page_num, tier, CASE WHEN status = 200 OR tier = 'playwright' THEN coalesce(length(html), 0) ELSE 0 END AS html_chars,
  CASE status WHEN 503 THEN 'HTTP 503' WHEN 0 THEN 'timeout' END AS reason FROM cap""")
def capture_status(spark, sf):
    return cap.capture_status(_captures(spark, sf)).select(
        "site_name", "page_num", "tier",
        F.coalesce(F.length("html"), F.lit(0)).cast("bigint").alias("html_chars"), "reason",
    )


@query(f"""
WITH {_CAPS}
SELECT site_name, CASE WHEN bool_or(tier = 'http' AND status = 200) THEN 'http'
  WHEN bool_or(tier = 'playwright' AND length(html) > 200) THEN 'playwright' ELSE 'failed' END AS recommended_tier
FROM cap GROUP BY site_name""")
def tier_recommend(spark, sf):
    return cap.tier_recommend(_captures(spark, sf))


@query(f"""
WITH {o.PG}, {o.TG},
u AS (SELECT site_name, page_num, html, CASE WHEN scrape_tier = 'http' AND page_id % 6 <> 0 THEN 'http'
             WHEN page_id % 30 <> 0 THEN 'playwright' END AS tier_used FROM pg JOIN tg ON name = site_name)
SELECT site_name, page_num, tier_used, length(html) AS html_chars FROM u WHERE tier_used IS NOT NULL""")
def tier_fallback(spark, sf):
    flat = targets.site_targets(b.targets_raw(spark, sf))
    return capture.tier_fallback(_captures(spark, sf), flat).select(
        "site_name", "page_num", "tier_used", F.length("html").cast("bigint").alias("html_chars")
    )


@query(f"""
WITH {o.PG}, {o.TG} SELECT site_name, page_num, page_id FROM pg JOIN tg ON name = site_name
WHERE page_num < CASE WHEN param IS NULL THEN 1 ELSE max_pages END""")
def page_limit(spark, sf):
    flat = targets.site_targets(b.targets_raw(spark, sf))
    return capture.page_limit(b.numbered_pages(spark, sf), flat).select(
        "site_name", "page_num", "page_id"
    )


@query(f"""
WITH t AS (SELECT page_id, {o.clean('html')} AS text FROM pages)
SELECT page_id, length(text) // 4 AS estimated_tokens FROM t WHERE text <> '' AND length(text) // 4 <= 2000""")
def token_budget(spark, sf):
    from ..functions.text import html_clean
    from ..functions.values import estimated_tokens

    texts = b.table(spark, sf, "pages").select("page_id", html_clean(F.col("html")).alias("text"))
    return capture.token_budget(texts, 2000).select(
        "page_id", estimated_tokens(F.col("text")).alias("estimated_tokens")
    )


@query(f"WITH {o.REPLIES} SELECT request_id, text, input_tokens, output_tokens FROM replies")
def model_replies(spark, sf):
    folder = staging.new_folder(spark, "replies")
    replies.write_replies(b.extraction_replies(spark, sf), folder)
    return replies.read_replies(spark, folder)


# Extraction

_JOBS = f"""{o.REPLIES},
r AS (SELECT request_id, site_name, url AS base, {o.unfenced('text')} AS t FROM replies),
j AS (SELECT request_id, site_name, base, unnest(json_extract(t, '$.jobs[*]')) AS job,
             CAST(generate_subscripts(json_extract(t, '$.jobs[*]'), 1) - 1 AS INTEGER) AS pos
      FROM r WHERE json_valid(t))"""


@query(f"WITH {_JOBS} SELECT request_id, count(*) AS n_jobs, max(pos) AS last_pos FROM j WHERE pos < 50 GROUP BY request_id")
def cap_postings(spark, sf):
    return (
        extract.parse_postings(b.extraction_replies(spark, sf), most=extract.MAX_POSTINGS)
        .groupBy("request_id")
        .agg(F.count("*").alias("n_jobs"), F.max("pos").alias("last_pos"))
    )


@query(f"""
WITH {_JOBS},
p AS (SELECT *, job->>'$.job_id' AS job_id, job->>'$.posted_date' AS d,
        CASE WHEN job->>'$.url' = '' THEN base ELSE regexp_extract(base, '^[a-z]+://[^/]+') || (job->>'$.url') END AS url
      FROM j)
SELECT request_id, pos, job->>'$.title' AS title, url, site_name AS company,
  CASE WHEN json_type(job, '$.description') IS NULL THEN '' ELSE job->>'$.description' END AS description, '' AS snippet, job_id,
  CASE WHEN d LIKE '2024-01-1%' THEN d WHEN d LIKE '2024020%' AND d <> '20240200' THEN
    substr(d, 1, 4) || '-' || substr(d, 5, 2) || '-' || substr(d, 7, 2) END AS posted_date,
  CASE job->>'$.posted_time' WHEN '09:15' THEN '09:15:00' END AS posted_time,
  coalesce(job_id, substr(sha256(url), 1, 16)) AS dedup_key, CASE WHEN job_id IS NULL THEN 'url_hash' ELSE 'job_id' END AS dedup_type
FROM p""")
def posting_projection(spark, sf):
    raw = extract.parse_postings(b.extraction_replies(spark, sf))
    return (
        extract.posting_projection(raw)
        .withColumn("posted_date", F.col("posted_date").cast("string"))
        .drop("location", "site_name")
    )


@query(f"""
WITH {o.PG}, t AS (SELECT *, {o.clean('html')} AS text FROM pg)
SELECT page_id, job_id AS dedup_key, 'job_id' AS dedup_type, site_name AS company,
  trim({o.decode("regexp_extract(html, '<title[^>]*>(.*?)</title>', 1)")}) AS title,
  sha256(text) AS description_sha256,
  CASE WHEN page_id % 7 <> 0 OR page_id % 3 = 0 THEN strftime(day, '%Y-%m-%d') END AS posted_date,
  CASE WHEN page_id % 3 = 0 THEN printf('%02d:00:00', page_id % 24) END AS posted_time
FROM t""")
def extract_postings(spark, sf):
    from ..functions.text import html_clean, html_title, let

    pages = b.numbered_pages(spark, sf, "html").select(
        "page_id", "site_name", "page_num", "url",
        html_title(F.col("html")).alias("title"),
        html_clean(b.dated_html()).alias("text"),
    )
    # The two date lines put in front are taken off again for the comparison of texts.
    own = F.regexp_replace(
        "description", r"^(?:datePosted: \S+\n)?(?:\d{4}-\d\d-\d\dT\d\d:00:00Z\n)?", ""
    )
    return extract.extract_postings(pages).select(
        "page_id", "dedup_key", "dedup_type", "company", "title",
        F.sha2(own, 256).alias("description_sha256"),
        F.col("posted_date").cast("string").alias("posted_date"), "posted_time",
    )


@query(f"""
WITH a AS (SELECT page_id, url, regexp_extract_all(html, '<a [^>]*>.*?</a>') AS links FROM pages),
l AS (SELECT page_id, url, unnest(links) AS link, CAST(generate_subscripts(links, 1) - 1 AS INTEGER) AS pos FROM a)
SELECT page_id, pos, replace(regexp_extract(link, '>(.*)</a>', 1), '&amp;', '&') AS title,
  regexp_extract(url, '^[a-z]+://[^/]+') || replace(regexp_extract(link, 'href="([^"]*)"', 1), '&amp;', '&') AS url FROM l""")
def link_postings(spark, sf):
    pages = b.table(spark, sf, "pages").select("page_id", "url", "html")
    return extract.link_postings(pages)


@query(f"""
WITH {o.REPLIES}, {o.PARSED_MATCH}
SELECT 'extract' AS step, request_id, round(CASE WHEN json_valid({o.unfenced('text')}) THEN
  input_tokens * 0.8 / 1000000 + output_tokens * 4.0 / 1000000 ELSE 0 END, 9) AS cost_usd FROM replies
UNION ALL SELECT 'match', dedup_key, round(input_tokens * 3.0 / 1000000 + output_tokens * 15.0 / 1000000, 9) FROM parsed""")
def usage_cost(spark, sf):
    read = extract.extraction_cost(b.extraction_replies(spark, sf)).select(
        F.lit("extract").alias("step"), "request_id", F.round("cost_usd", 9).alias("cost_usd")
    )
    paid = cost_of("match", F.col("input_tokens"), F.col("output_tokens"))
    matched = b.match_replies(spark, sf).select(
        F.lit("match").alias("step"), F.col("dedup_key").alias("request_id"),
        F.round(paid, 9).alias("cost_usd"),
    )
    return read.unionByName(matched)


# Stores

@query(f"WITH {o.SEEN} SELECT dedup_key FROM seen")
def read_seen(spark, sf):
    return stores.seen_keys(b.seen_store(spark, sf))


@query(f"""
WITH {o.TG}, {o.HEALTH} SELECT site_name, strftime(last_success_at, '%Y-%m-%d %H:%M:%S') AS last_success_at FROM health""")
def last_run(spark, sf):
    return stores.last_run(b.health_text(b.targets_raw(spark, sf))).withColumn(
        "last_success_at", stamp("last_success_at")
    )


@query(f"""
WITH {o.TG}, {o.HEALTH} SELECT name AS site_name, strftime(last_success_at, '%Y-%m-%d %H:%M:%S') AS last_success_at
FROM tg LEFT JOIN health ON name = site_name""")
def site_last_run(spark, sf):
    sites = report.distinct_sites(b.site_pages(spark, sf))
    return stores.site_last_run(sites, b.health_text(b.targets_raw(spark, sf))).withColumn(
        "last_success_at", stamp("last_success_at")
    )


@query(f"""
WITH {o.TG}, {o.HEALTH} SELECT name AS site_name, coalesce(consecutive_zeros, 0) AS consecutive_zeros
FROM tg LEFT JOIN health ON name = site_name""")
def site_zeros(spark, sf):
    return stores.site_zeros(report.distinct_sites(b.site_pages(spark, sf)), b.health_text(b.targets_raw(spark, sf)))


@query(f"SELECT DISTINCT {o.SITE} AS site_name FROM pages")
def distinct_sites(spark, sf):
    return report.distinct_sites(b.site_pages(spark, sf))


@query(f"""
WITH {o.PG}, {o.SEEN}
SELECT page_id, job_id AS dedup_key FROM pg WHERE job_id NOT IN (SELECT dedup_key FROM seen)""")
def new_postings(spark, sf):
    found = b.page_postings(b.site_pages(spark, sf))
    return incremental.new_postings(found, b.seen_store(spark, sf)).select("page_id", "dedup_key")


@query(f"""
WITH {o.PG}, {o.SEEN}
SELECT page_id, job_id AS dedup_key FROM pg WHERE job_id IN (SELECT dedup_key FROM seen)""")
def seen_postings(spark, sf):
    found = b.page_postings(b.site_pages(spark, sf))
    return incremental.seen_postings(found, b.seen_store(spark, sf)).select("page_id", "dedup_key")


@query(f"""
WITH {o.OP} SELECT dedup_key, site_name, page_num, pos FROM op
QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY site_ord, page_num, pos) = 1""")
def first_occurrence(spark, sf):
    return incremental.first_occurrence(b.order_postings(spark, sf)).select(
        "dedup_key", "site_name", "page_num", "pos"
    )


@query(f"""
WITH {o.SEEN},
new AS (SELECT {o.KEY} AS dedup_key, min(page_id) AS page_id, arg_min(url, page_id) AS url FROM pages GROUP BY 1)
SELECT dedup_key, 'Stored ' || dedup_key AS title, CASE WHEN quality = 1 THEN CAST(0.75 AS DOUBLE) END AS match_score,
  '2024-01-15 12:00:00' AS seen_at FROM seen WHERE dedup_key NOT IN (SELECT dedup_key FROM new)
UNION ALL SELECT dedup_key, 'New ' || dedup_key, CASE WHEN url LIKE 'https:%' THEN page_id % 10 / 10 END, '{RUN_AT}' FROM new""")
def seen_upsert(spark, sf):
    new = (
        b.page_postings(b.site_pages(spark, sf))
        .groupBy("dedup_key", "dedup_type")
        .agg(F.min("page_id").alias("page_id"), F.min_by("url", "page_id").alias("url"))
        .withColumns({"title": F.concat(F.lit("New "), "dedup_key"), "company": F.lit("new")})
    )
    scores = new.filter(F.col("url").startswith("https:")).select(
        "dedup_key", (F.col("page_id") % 10 / 10).alias("best_score")
    )
    rows = incremental.seen_rows(new, scores, F.lit(RUN_AT).cast("timestamp"))
    return incremental.seen_upsert(b.seen_store(spark, sf), rows).select(
        "dedup_key", "title", "match_score", stamp("seen_at").alias("seen_at")
    )


@query(f"""
WITH {o.TG}, {o.HEALTH}, {o.RUNS},
counts AS (SELECT name AS site_name, CASE WHEN site_ord % 3 = 0 THEN 0 ELSE site_ord END AS job_count FROM tg
           WHERE regexp_matches(name, '^(www|blog|m)\\.'))
SELECT coalesce(h.site_name, c.site_name) AS site_name,
  CAST(CASE WHEN job_count IS NULL THEN consecutive_zeros WHEN job_count > 0 THEN 0
       ELSE coalesce(consecutive_zeros, 0) + 1 END AS INTEGER) AS consecutive_zeros,
  CASE WHEN job_count > 0 THEN '{RUN_AT}' ELSE strftime(last_success_at, '%Y-%m-%d %H:%M:%S') END AS last_success_at
FROM health h FULL JOIN counts c USING (site_name)""")
def health_upsert(spark, sf):
    first = F.col("site_ord")
    counts = (
        b.targets_raw(spark, sf)
        .filter(F.col("name").rlike(r"^(www|blog|m)\."))
        .select(F.col("name").alias("site_name"), F.when(first % 3 == 0, 0).otherwise(first).alias("job_count"))
    )
    old = stores.utc_times(b.health_text(b.targets_raw(spark, sf)))
    return incremental.health_upsert(old, counts, F.lit(RUN_AT).cast("timestamp")).withColumn(
        "last_success_at", stamp("last_success_at")
    )


@query(f"""
WITH {o.STREAK} SELECT site_name, consecutive_zeros, strftime(last_success_at, '%Y-%m-%d') AS last_success_day FROM streak""")
def zero_streak(spark, sf):
    return incremental.zero_streak(b.run_history(spark, sf)).select(
        "site_name", "consecutive_zeros",
        F.date_format("last_success_at", "yyyy-MM-dd").alias("last_success_day"),
    )


@query(f"""
WITH {o.STREAK} SELECT site_name, consecutive_zeros, chr(10) || '⚠️ ' || site_name || ' has returned 0 jobs for '
  || consecutive_zeros || ' consecutive runs — scraper may need updating' AS warning
FROM streak WHERE consecutive_zeros >= 3""")
def stale_sites(spark, sf):
    return incremental.stale_sites(incremental.zero_streak(b.run_history(spark, sf)))


# Pages of a listing

def _stats(spark, sf):
    return incremental.page_stats(
        b.order_pages(spark, sf), b.order_postings(spark, sf), b.order_seen(spark, sf)
    )


def _judged(spark, sf):
    return incremental.freshness_stop(_stats(spark, sf), b.order_health(spark, sf))


@query(f"""
WITH {o.OP} SELECT site_name, page_num, jobs, new_jobs, has_date, has_time,
  strftime(newest_at, '%Y-%m-%d %H:%M:%S') AS newest_at, strftime(newest_date, '%Y-%m-%d') AS newest_date FROM stats_o""")
def page_stats(spark, sf):
    return _stats(spark, sf).select(
        "site_name", "page_num", "jobs", "new_jobs", "has_date", "has_time",
        stamp("newest_at").alias("newest_at"), F.col("newest_date").cast("string").alias("newest_date"),
    )


@query(f"""
WITH {o.OP} SELECT site_name, page_num, strftime(last_run, '%Y-%m-%d %H:%M:%S') AS last_run, stop FROM judged_o""")
def freshness_stop(spark, sf):
    return _judged(spark, sf).select("site_name", "page_num", stamp("last_run").alias("last_run"), "stop")


@query(f"""
WITH {o.OP},
f AS (SELECT *, page_num = site_ord % 12 AS failed FROM judged_o),
c AS (SELECT *, bool_or(stop OR failed) OVER (PARTITION BY site_name ORDER BY page_num
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM f)
SELECT site_name, page_num, stop FROM c WHERE NOT coalesce(ended, false) AND NOT failed""")
def visited_pages(spark, sf):
    failed = F.col("page_num") == F.col("site_ord") % 12
    return incremental.visited_pages(_judged(spark, sf).withColumn("failed", failed)).select(
        "site_name", "page_num", "stop"
    )


# Matching

_SC = o.overlap("documents", "CAST(doc_id AS VARCHAR)", "text")


@query(f"WITH {_SC} SELECT dedup_key, filename, n_shared FROM sc WHERE score >= 0.25")
def posting_x_profile(spark, sf):
    return matching.posting_x_profile(b.documents(spark, sf), b.profiles(spark, sf), least=0.25)


@query(f"""
WITH {_SC} SELECT dedup_key, best_filename, round(best_score, 9) AS best_score, runner_up_filename,
  round(runner_up_score, 9) AS runner_up_score FROM bm""")
def best_and_runner_up(spark, sf):
    return matching.top_two(b.documents(spark, sf), b.profiles(spark, sf)).select(
        "dedup_key", "best_filename", F.round("best_score", 9).alias("best_score"),
        "runner_up_filename", F.round("runner_up_score", 9).alias("runner_up_score"),
    )


_GAPS = f"""{_SC},
g AS (SELECT bm.*, list_sort(list_filter({o.terms('d.text')}, lambda t: NOT list_contains(pf.terms, t))) AS gaps, pf.role_label AS best_label
      FROM bm JOIN documents d ON CAST(d.doc_id AS VARCHAR) = dedup_key JOIN pf ON pf.filename = best_filename)"""


@query(f"""
WITH {_GAPS}
SELECT g.dedup_key, best_filename, best_label, round(best_score, 9) AS best_score,
  'shares ' || n_shared || ' of ' || n_terms || ' profile terms' AS match_reason, array_to_string(gaps, ',') AS missing_keywords,
  runner_up_filename, r.role_label AS runner_up_label, round(runner_up_score, 9) AS runner_up_score
FROM g LEFT JOIN pf r ON r.filename = runner_up_filename""")
def lexical_match(spark, sf):
    return matching.lexical_match(b.documents(spark, sf), b.profiles(spark, sf)).select(
        "dedup_key", "best_filename", "best_label", F.round("best_score", 9).alias("best_score"),
        "match_reason", F.array_join("missing_keywords", ",").alias("missing_keywords"),
        "runner_up_filename", "runner_up_label", F.round("runner_up_score", 9).alias("runner_up_score"),
    )


def _gaps(spark, sf, first=None):
    matches = matching.match_scores(b.documents(spark, sf), b.profiles(spark, sf), gaps=True, first=first)
    return matches.select("dedup_key", F.col("missing_keywords").alias("gaps"))


@query(f"WITH {_GAPS} SELECT dedup_key, len(gaps) AS n_missing, sha256(array_to_string(gaps, ',')) AS gaps_sha256 FROM g")
def missing_keywords(spark, sf):
    return _gaps(spark, sf).select(
        "dedup_key", F.size("gaps").cast("bigint").alias("n_missing"),
        F.sha2(F.array_join("gaps", ","), 256).alias("gaps_sha256"),
    )


@query(f"WITH {_GAPS} SELECT dedup_key, array_to_string(gaps[1:8], ',') AS top_gaps FROM g")
def missing_top8(spark, sf):
    return _gaps(spark, sf, matching.MAX_MISSING).select(
        "dedup_key", F.array_join(matching.missing_top8(F.col("gaps")), ",").alias("top_gaps")
    )


@query(f"WITH {_SC} SELECT dedup_key, best_filename, round(best_score, 9) AS best_score FROM bm WHERE best_score >= 0.70")
def match_threshold(spark, sf):
    scored = matching.match_scores(b.documents(spark, sf), b.profiles(spark, sf))
    return matching.match_threshold(scored).select(
        "dedup_key", "best_filename", F.round("best_score", 9).alias("best_score")
    )


@query(f"""
WITH {o.PARSED_MATCH}, pf AS (SELECT printf('profile_%05d.md', item_id) AS filename, 'Profile ' || printf('%05d', item_id) AS role_label FROM benchmark)
SELECT dedup_key, best_filename, b.role_label AS best_label, best_score, r.filename AS runner_up_filename,
       r.role_label AS runner_up_label, runner_up_score
FROM parsed JOIN pf b ON b.filename = best_filename LEFT JOIN pf r ON r.filename = runner_up_filename""")
def resolve_profile(spark, sf):
    parsed = matching.parse_match(b.match_replies(spark, sf))
    return matching.resolve_profile(parsed, b.profiles(spark, sf)).select(
        "dedup_key", "best_filename", "best_label", "best_score", "runner_up_filename",
        "runner_up_label", "runner_up_score",
    )


@query(f"""
WITH {_SC} SELECT CAST(d.doc_id AS VARCHAR) AS dedup_key, best_filename, round(best_score, 9) AS best_score
FROM documents d LEFT JOIN bm ON bm.dedup_key = CAST(d.doc_id AS VARCHAR)""")
def score_with(spark, sf):
    return matching.score_with(b.documents(spark, sf), b.profiles(spark, sf), matching.term_overlap).select(
        "dedup_key", "best_filename", F.round("best_score", 9).alias("best_score")
    )


# Report

@query(f"""
WITH {MATCH_ROWS}, o AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY site_ord, page_num) AS r FROM mr)
SELECT company, site_ord, CAST(min(page_num) AS INTEGER) AS page_num, count(*) AS n_matches FROM o GROUP BY ALL""")
def company_groups(spark, sf):
    return report.company_groups(b.reported_matches(spark, sf)).select(
        "company", "first_seen.site_ord", "first_seen.page_num", "n_matches"
    )


@query(f"WITH {MATCH_ROWS} SELECT site_ord, page_num, company, title FROM mr ORDER BY site_ord, page_num")
def all_matches(spark, sf):
    rows = b.reported_matches(spark, sf)
    http = rows.filter(F.col("url").startswith("http:"))
    https = rows.filter(~F.col("url").startswith("http:"))
    return report.all_matches(http, https).select("site_ord", "page_num", "company", "title").orderBy(
        "site_ord", "page_num"
    )


PACKED = f"""{MATCH_ROWS},
blk AS (SELECT company, min(site_ord) AS site_ord, sum(length(lines) + 1) + length(company) + 8 AS block_len
        FROM ml GROUP BY company),
b AS (SELECT *, row_number() OVER (ORDER BY site_ord) AS i FROM blk),
pack AS (
  SELECT i, company, block_len, 1 AS part_no, HEAD + block_len AS used FROM b WHERE i = 1
  UNION ALL
  SELECT b.i, b.company, b.block_len, CASE WHEN used + b.block_len > 4000 THEN part_no + 1 ELSE part_no END,
         CASE WHEN used + b.block_len > 4000 THEN HEAD + b.block_len ELSE used + b.block_len END
  FROM pack JOIN b ON b.i = pack.i + 1)"""


@query("WITH RECURSIVE " + PACKED.replace("HEAD", "100") + """
SELECT company, CAST(block_len AS BIGINT) AS block_len, CAST(part_no AS BIGINT) AS part_no FROM pack""")
def message_pack(spark, sf):
    blocks = report.company_blocks(b.reported_matches(spark, sf))
    return report.message_pack(blocks, 100).join(blocks, "company").select(
        "company", "block_len", "part_no"
    )


@query(f"""
WITH {o.PG} SELECT site_name, page_num, '🚨 <b>Posting digest — run failed</b>' || chr(10) || '<i>2024-02-01 06:00 UTC</i>' || chr(10)
  || chr(10) || '<b>Error:</b> ScrapingFailedError: All scraping tiers failed for ' || site_name || ' (' || url || ')' || chr(10)
  || '<b>Context:</b> processing ' || site_name || chr(10) || chr(10) || 'Check the run logs for the full traceback.' AS alert
FROM pg WHERE page_id % 30 = 0""")
def failure_rows(spark, sf):
    failed = F.when(
        F.col("page_id") % 30 == 0,
        F.format_string("All scraping tiers failed for %s (%s)", "site_name", "url"),
    )
    errors = b.numbered_pages(spark, sf).select(
        "site_name", "page_num", F.lit("ScrapingFailedError").alias("error_type"), failed.alias("error")
    )
    return report.failure_rows(errors, F.lit(RUN_AT).cast("timestamp")).select(
        "site_name", "page_num", "alert"
    )
