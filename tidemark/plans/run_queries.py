"""Whole runs over ``pages`` and ``benchmark``."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..operators import quarantine as held_back
from ..operators import report
from ..sources import schemas, staging
from ..sources.targets import site_targets
from . import bindings as b
from . import full_run as fr
from . import oracle as o
from .registry import query

RUN_AT = datetime.datetime(2024, 2, 1, 6, 0)
THRESHOLD = 0.3
REPLY_TOKENS = (200, 100)


def run_all(spark, sf):
    pages = b.numbered_pages(spark, sf, "html")
    raw = b.targets_raw(spark, sf)
    return fr.full_run(
        b.captures(pages, b.dated_html()),
        site_targets(raw),
        b.profiles(spark, sf),
        b.seen_store(spark, sf),
        b.health_text(raw),
        RUN_AT,
        threshold=THRESHOLD,
        reply_tokens=REPLY_TOKENS,
    )


_TEXT = f"""concat_ws(chr(10),
  CASE WHEN page_id % 7 <> 0 THEN 'datePosted: ' || strftime(day, '%Y-%m-%d') END,
  CASE WHEN page_id % 3 = 0 THEN strftime(day, '%Y-%m-%d') || printf('T%02d:00:00Z', page_id % 24) END,
  {o.clean('html')})"""

RUN = f"""{o.PG}, {o.TG}, {o.SEEN}, {o.HEALTH},
{o.EXPECTED},
expected AS (
  SELECT name AS site_name, site_ord, scrape_tier, page_num,
         CASE WHEN param IS NULL THEN url ELSE {o.with_param('url', 'param', 'CAST(page_num * step AS VARCHAR)')} END AS page_url
  FROM ex),
rd AS (
  SELECT e.site_name, e.site_ord, e.page_num, e.page_url, pg.page_id, pg.job_id, pg.url, pg.day,
         CASE WHEN scrape_tier = 'http' AND page_id % 6 <> 0 THEN 'http' WHEN page_id % 30 <> 0 THEN 'playwright' END AS tier_used,
         {_TEXT} AS text
  FROM expected e LEFT JOIN pg USING (site_name, page_num)),
po AS (
  SELECT *, length(text) // 4 AS tokens,
         CASE WHEN page_id % 7 <> 0 OR page_id % 3 = 0 THEN day END AS posted_date,
         CASE WHEN page_id % 3 = 0 THEN CAST(day AS TIMESTAMP) + page_id % 24 * INTERVAL 1 HOUR END AS posted_at
  FROM rd WHERE tier_used IS NOT NULL),
fresh AS (
  SELECT site_name, page_num, count(*) AS n FROM (SELECT site_name, job_id, min(page_num) AS page_num FROM po GROUP BY ALL)
  WHERE job_id NOT IN (SELECT dedup_key FROM seen) GROUP BY ALL),
judged AS (
  SELECT rd.site_name, rd.page_num, rd.tier_used IS NULL AS failed,
         CASE WHEN rd.tier_used IS NULL THEN true WHEN last_success_at IS NULL THEN false
              WHEN posted_at IS NOT NULL THEN posted_at < last_success_at
              WHEN posted_date IS NOT NULL THEN posted_date < CAST(last_success_at - INTERVAL 1 DAY AS DATE)
              ELSE coalesce(fresh.n, 0) = 0 END AS stop
  FROM rd LEFT JOIN po USING (site_name, page_num) LEFT JOIN fresh USING (site_name, page_num) LEFT JOIN health USING (site_name)),
ended AS (
  SELECT *, bool_or(stop OR failed) OVER (PARTITION BY site_name ORDER BY page_num
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM judged),
visited AS (SELECT site_name, page_num FROM ended WHERE NOT coalesce(past, false) AND NOT failed),
found AS (SELECT po.* FROM po JOIN visited USING (site_name, page_num)),
new AS (
  SELECT *, job_id AS dedup_key FROM found WHERE job_id NOT IN (SELECT dedup_key FROM seen)
  QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY site_ord, page_num) = 1),
{o.overlap('new', 'dedup_key', 'text')},
matched AS (SELECT bm.*, new.site_name, new.site_ord, new.page_num FROM bm JOIN new USING (dedup_key) WHERE best_score >= {THRESHOLD}),
results AS (
  SELECT tg.site_ord, tg.name AS site_name,
         (SELECT count(*) FROM found WHERE found.site_name = tg.name) AS jobs_found,
         (SELECT count(*) FROM new WHERE new.site_name = tg.name) AS new_jobs,
         (SELECT count(*) FROM matched WHERE matched.site_name = tg.name) AS n_matches,
         coalesce((SELECT arg_max(tier_used, page_num) FROM found WHERE found.site_name = tg.name), 'none') AS tier_used,
         coalesce((SELECT sum(tokens * 0.8 / 1000000 + {REPLY_TOKENS[0]} * 4.0 / 1000000) FROM found WHERE found.site_name = tg.name), 0)
         + coalesce((SELECT sum(tokens * 3.0 / 1000000 + {REPLY_TOKENS[1]} * 15.0 / 1000000) FROM new WHERE new.site_name = tg.name), 0) AS cost_usd,
         (SELECT 'All scraping tiers failed for ' || rd.site_name || ' (' || page_url || ')' FROM rd
          WHERE rd.site_name = tg.name AND page_num = 0 AND tier_used IS NULL) AS error
  FROM tg)"""


@query(f"""
WITH {RUN} SELECT site_ord, site_name, jobs_found, new_jobs, n_matches, tier_used, round(cost_usd, 6) AS cost_usd, error FROM results""")
def site_results(spark, sf):
    return run_all(spark, sf)["site_results"].select(
        "site_ord", "site_name", "jobs_found", "new_jobs", "n_matches", "tier_used",
        F.round("cost_usd", 6).alias("cost_usd"), "error",
    )


@query(f"""
WITH {RUN} SELECT '2024-02-01 06:00' AS run_at, count(*) AS sites_attempted, count(*) FILTER (error IS NULL) AS sites_succeeded,
  count(error) AS sites_failed, CAST(sum(jobs_found) AS BIGINT) AS total_jobs_found, CAST(sum(new_jobs) AS BIGINT) AS new_jobs,
  CAST(sum(n_matches) AS BIGINT) AS n_matches, round(sum(cost_usd), 6) AS total_cost_usd FROM results""")
def run_summary(spark, sf):
    return run_all(spark, sf)["run_summary"].withColumns(
        {
            "run_at": F.date_format("run_at", "yyyy-MM-dd HH:mm"),
            "total_cost_usd": F.round("total_cost_usd", 6),
        }
    )


@query(f"""
WITH {RUN} SELECT dedup_key, site_name, page_num, best_filename, round(best_score, 9) AS best_score, runner_up_filename FROM matched""")
def full_run(spark, sf):
    return run_all(spark, sf)["matches"].select(
        "dedup_key", "site_name", "page_num", "best_filename",
        F.round("best_score", 9).alias("best_score"), "runner_up_filename",
    )


# A run on a model's replies: pages without a reply, replies cut off or fenced, match replies of every kind.

NO_REPLY_EVERY = 13


def reply_run(spark, sf):
    pages = b.numbered_pages(spark, sf, "html")
    numbers = pages.select(F.col("page_id").cast("string").alias("request_id"), "site_name", "page_num")
    replies = b.extraction_replies(spark, sf).drop("site_name", "url").where(F.col("request_id").cast("bigint") % NO_REPLY_EVERY != 0)
    return fr.run_on_replies(
        b.captures(pages, F.col("html")),
        site_targets(b.targets_raw(spark, sf)),
        b.profiles(spark, sf),
        spark.createDataFrame([], schemas.SEEN),
        spark.createDataFrame([], schemas.HEALTH),
        RUN_AT,
        replies.join(numbers, "request_id").drop("request_id"),
        b.match_replies(spark, sf),
    )


REPLY_RUN = f"""{o.PG}, {o.TG}, {o.EXPECTED}, {o.PARSED_MATCH}, {o.REPLIES},
r AS (SELECT CAST(request_id AS BIGINT) AS page_id, {o.unfenced('text')} AS t, input_tokens, output_tokens FROM replies
      WHERE CAST(request_id AS BIGINT) % {NO_REPLY_EVERY} <> 0),
rd AS (
  SELECT ex.name AS site_name, ex.site_ord, ex.page_num, pg.page_id, pg.url AS base, {o.clean('pg.html')} AS text, r.t,
         coalesce(json_valid(r.t), false) AS ok, r.input_tokens, r.output_tokens,
         CASE WHEN ex.scrape_tier = 'http' AND pg.page_id % 6 <> 0 THEN 'http' WHEN pg.page_id % 30 <> 0 THEN 'playwright' END AS tier_used,
         CASE WHEN param IS NULL THEN ex.url ELSE {o.with_param('ex.url', 'param', 'CAST(ex.page_num * step AS VARCHAR)')} END AS page_url
  FROM ex LEFT JOIN pg ON pg.site_name = ex.name AND pg.page_num = ex.page_num LEFT JOIN r ON r.page_id = pg.page_id),
pa AS (
  SELECT *, tier_used IS NULL AS failed,
         CASE WHEN text = '' THEN 'empty page' WHEN length(text) // 4 > 150000 THEN 'above the token budget' END AS not_asked FROM rd),
pb AS (
  SELECT *, CASE WHEN NOT failed AND not_asked IS NULL THEN
           CASE WHEN t IS NULL THEN 'no reply' WHEN NOT ok THEN 'unreadable reply' ELSE 'kept' END END AS answer FROM pa),
js AS (
  SELECT site_name, site_ord, page_num, base, unnest(json_extract(t, '$.jobs[*]')) AS job,
         CAST(generate_subscripts(json_extract(t, '$.jobs[*]'), 1) - 1 AS INTEGER) AS pos FROM pb WHERE answer = 'kept'),
jd AS (
  SELECT pb.*, failed OR NOT EXISTS (SELECT 1 FROM js WHERE js.site_name = pb.site_name AND js.page_num = pb.page_num) AS ends FROM pb),
je AS (
  SELECT *, coalesce(bool_or(ends) OVER (PARTITION BY site_name ORDER BY page_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS past
  FROM jd),
visited AS (SELECT * FROM je WHERE NOT past AND NOT failed),
found AS (
  SELECT js.*, job->>'$.job_id' AS job_id, CASE WHEN job->>'$.url' = '' THEN js.base
           ELSE regexp_extract(js.base, '^[a-z]+://[^/]+') || (job->>'$.url') END AS url
  FROM js JOIN visited USING (site_name, page_num)),
new AS (
  SELECT *, coalesce(job_id, substr(sha256(url), 1, 16)) AS dedup_key FROM found
  QUALIFY row_number() OVER (PARTITION BY coalesce(job_id, substr(sha256(url), 1, 16)) ORDER BY site_ord, page_num, pos) = 1),
pf AS (SELECT printf('profile_%05d.md', item_id) AS filename FROM benchmark),
matched AS (
  SELECT new.site_name, p.best_score, p.input_tokens, p.output_tokens,
         CASE WHEN p.dedup_key IS NULL THEN 'no reply' WHEN NOT p.ok THEN 'unreadable reply' WHEN p.best_score IS NULL THEN 'bad score'
              WHEN p.best_filename NOT IN (SELECT filename FROM pf) THEN 'unknown profile' ELSE 'kept' END AS answer
  FROM new LEFT JOIN parsed p USING (dedup_key))"""


@query(f"""
WITH {REPLY_RUN}
SELECT tg.name AS site_name,
  (SELECT count(*) FROM found WHERE found.site_name = tg.name) AS jobs_found,
  (SELECT count(*) FROM new WHERE new.site_name = tg.name) AS new_jobs,
  (SELECT count(*) FROM matched m WHERE m.site_name = tg.name AND answer = 'kept' AND best_score >= 0.70) AS n_matches,
  round(coalesce((SELECT sum(CASE WHEN ok THEN input_tokens * 0.8 / 1000000 + output_tokens * 4.0 / 1000000 ELSE 0 END)
                  FROM visited v WHERE v.site_name = tg.name AND v.not_asked IS NULL), 0)
      + coalesce((SELECT sum(input_tokens * 3.0 / 1000000 + output_tokens * 15.0 / 1000000)
                  FROM matched m WHERE m.site_name = tg.name), 0), 6) AS cost_usd,
  (SELECT 'All scraping tiers failed for ' || pa.site_name || ' (' || page_url || ')' FROM pa
   WHERE pa.site_name = tg.name AND page_num = 0 AND failed) AS error
FROM tg""")
def run_on_replies(spark, sf):
    return reply_run(spark, sf)["site_results"].select(
        "site_name", "jobs_found", "new_jobs", "n_matches", F.round("cost_usd", 6).alias("cost_usd"), "error"
    )


@query(f"""
WITH {REPLY_RUN}
SELECT 'capture' AS step, 'kept' AS reason, count(*) AS n FROM visited HAVING count(*) > 0
UNION ALL SELECT 'capture', 'no usable capture', count(*) FROM je WHERE NOT past AND failed HAVING count(*) > 0
UNION ALL SELECT 'request', coalesce(not_asked, 'kept'), count(*) FROM visited GROUP BY ALL
UNION ALL SELECT 'extract', answer, count(*) FROM visited WHERE answer IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'match', answer, count(*) FROM matched GROUP BY ALL""")
def quarantine(spark, sf):
    """What every step has found: kept rows and, by reason, those put aside."""
    outputs = reply_run(spark, sf)
    visited, aside = outputs["visited"], outputs["quarantine"]
    used = outputs["scores"].where("best_label IS NOT NULL AND best_score IS NOT NULL").join(outputs["new_postings"], "dedup_key", "left_semi")

    def left(step, rows, *before):
        # what a step keeps is what reached it without what it put aside itself
        gone = aside.where(F.col("step").isin(*before)).groupBy().agg(F.count("*").alias("gone"))
        return rows.agg(F.count("*").alias("n")).select(F.lit(step).alias("step"), F.lit("kept").alias("reason"), (F.col("n") - gone.scalar()).alias("n"))

    kept = left("capture", visited).unionByName(left("request", visited, "request"))
    kept = kept.unionByName(left("extract", visited, "request", "extract")).unionByName(left("match", used))
    return held_back.counts(aside).unionByName(kept).where("n > 0")


# A run on listing pages: the list of links on every page stands in a section instead of a menu.

LINK_RUN = rf"""{o.PG}, {o.TG}, {o.EXPECTED},
li AS (
  SELECT site_name, page_num, page_id, url AS base, regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>') AS items FROM pg),
it AS (SELECT *, unnest(items) AS item, CAST(generate_subscripts(items, 1) - 1 AS INTEGER) AS pos FROM li WHERE len(items) >= 3),
po AS (
  SELECT site_name, page_num, pos, trim(regexp_extract(item, '>([^<]*)</a>', 1)) AS title,
         regexp_extract(base, '^[a-z]+://[^/]+') || regexp_extract(item, 'href="([^"]*)"', 1) AS url FROM it
  UNION ALL SELECT site_name, page_num, 0, NULL, base FROM li WHERE len(items) < 3),
rd AS (
  SELECT ex.name AS site_name, ex.site_ord, ex.page_num,
         pg.page_id IS NULL OR NOT (ex.scrape_tier = 'http' AND pg.page_id % 6 <> 0 OR pg.page_id % 30 <> 0) AS failed
  FROM ex LEFT JOIN pg ON pg.site_name = ex.name AND pg.page_num = ex.page_num),
je AS (
  SELECT *, coalesce(bool_or(failed) OVER (PARTITION BY site_name ORDER BY page_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS past
  FROM rd),
found AS (
  SELECT po.*, site_ord, nullif(regexp_extract(url, '/(\d+)', 1), '') AS job_id
  FROM po JOIN je USING (site_name, page_num) WHERE NOT past AND NOT failed),
new AS (
  SELECT *, coalesce(job_id, substr(sha256(url), 1, 16)) AS dedup_key FROM found
  QUALIFY row_number() OVER (PARTITION BY coalesce(job_id, substr(sha256(url), 1, 16)) ORDER BY site_ord, page_num, pos) = 1)"""


@query(f"WITH {LINK_RUN} SELECT dedup_key, site_name, page_num, pos, CASE WHEN title IS NOT NULL THEN title END AS title, url FROM new")
def run_on_links(spark, sf):
    html = F.replace(F.replace(F.col("html"), F.lit("<nav>"), F.lit("<section>")), F.lit("</nav>"), F.lit("</section>"))
    outputs = fr.full_run(
        b.captures(b.numbered_pages(spark, sf, "html"), html),
        site_targets(b.targets_raw(spark, sf)),
        b.profiles(spark, sf),
        spark.createDataFrame([], schemas.SEEN),
        spark.createDataFrame([], schemas.HEALTH),
        RUN_AT,
        reader=fr.discover_listings,
    )
    return outputs["new_postings"].select("dedup_key", "site_name", "page_num", "pos", "title", "url")


# A digest over matches taken from ``pages`` and stale sites from ``events``.
from .scalar_queries import MATCH_ROWS  # noqa: E402
from .table_queries import PACKED  # noqa: E402

_HEADER = """'🔍 <b>Posting digest — ' || (SELECT count(*) FROM mr) || ' new match(es)</b>' || chr(10)
  || '<i>2024-02-01 06:00 UTC</i>' || chr(10)"""
_PIECES = f"""{PACKED.replace('HEAD', f'length({_HEADER})')},
{o.STREAK},
last_part AS (SELECT max(part_no) AS part_no FROM pack),
stale AS (SELECT CAST(substr(site_name, 6) AS BIGINT) AS site_ord, chr(10) || '⚠️ ' || site_name || ' has returned 0 jobs for '
          || consecutive_zeros || ' consecutive runs — scraper may need updating' AS warning FROM streak WHERE consecutive_zeros >= 3),
err AS (SELECT page_id AS site_ord, {o.SITE} || ' — error ' || page_id AS error FROM pages WHERE page_id % 30 = 0),
pieces AS (
  SELECT DISTINCT part_no, 0 AS section, 0 AS site_ord, 0 AS is_line, 0 AS page_num, {_HEADER} AS text FROM pack
  UNION ALL SELECT part_no, 1, site_ord, 0, 0, chr(10) || '<b>' || company || '</b>' FROM pack JOIN blk USING (company)
  UNION ALL SELECT part_no, 1, site_ord, 1, page_num, chr(10) || lines FROM pack JOIN ml USING (company)
  UNION ALL SELECT part_no, 2, 0, 0, 0, chr(10) || '──────────────────' || chr(10) || '📊 <b>Run summary</b>' || chr(10)
    || 'Sites: ' || (SELECT count(*) FROM tg) || ' checked · ' || (SELECT count(*) FROM tg) || ' OK · 0 failed' || chr(10)
    || 'Jobs: ' || (SELECT count(*) FROM pages) || ' found · ' || (SELECT count(*) FROM mr) || ' new · ' || (SELECT count(*) FROM mr)
    || ' matches' || chr(10) || '💰 Cost: $0.2500' FROM last_part
  UNION ALL SELECT part_no, 3, site_ord, 1, 0, chr(10) || '⚠️ Failed: ' || error FROM last_part, err
  UNION ALL SELECT part_no, 4, -1, 0, 0, chr(10) FROM last_part WHERE EXISTS (SELECT 1 FROM stale)
  UNION ALL SELECT part_no, 4, site_ord, 1, 0, warning FROM last_part, stale)"""


@query(f"""
WITH RECURSIVE {_PIECES}
SELECT CAST(part_no AS BIGINT) AS part_no, CAST(section AS INTEGER) AS section,
       CASE section WHEN 1 THEN site_ord ELSE 0 END AS block_ord, CAST(is_line AS INTEGER) AS is_line,
       CASE WHEN is_line = 0 THEN 0 WHEN section = 1 THEN CAST(page_num AS BIGINT) ELSE site_ord END AS line_ord, text
FROM pieces""")
def digest_out(spark, sf):
    from ..operators.incremental import stale_sites, zero_streak

    matches = b.reported_matches(spark, sf)
    total = b.table(spark, sf, "pages").agg(F.count("*").alias("total_jobs_found"))
    sites = b.targets_raw(spark, sf).agg(F.count("*"))
    summary = matches.agg(F.count("*").alias("n_matches")).select(
        F.lit(RUN_AT).alias("run_at"),
        sites.scalar().alias("sites_attempted"),
        sites.scalar().alias("sites_succeeded"),
        F.lit(0).cast("bigint").alias("sites_failed"),
        total.scalar().alias("total_jobs_found"),
        F.col("n_matches").alias("new_jobs"),
        "n_matches",
        F.lit(0.25).alias("total_cost_usd"),
    )
    errors = (
        b.site_pages(spark, sf)
        .select(
            F.col("page_id").alias("site_ord"),
            F.when(
                F.col("page_id") % 30 == 0,
                F.format_string("%s — error %d", "site_name", "page_id"),
            ).alias("error"),
        )
        .filter(F.col("error").isNotNull())
    )
    stale = stale_sites(zero_streak(b.run_history(spark, sf))).withColumn(
        "site_ord", F.substring("site_name", 6, 20).cast("bigint")
    )
    pieces = report.digest(matches, summary, errors, stale)
    path = staging.new_folder(spark, "digest")
    report.digest_out(pieces, path)
    line = F.when(F.col("section") == report.BLOCKS, F.col("line_ord.page_num").cast("bigint"))
    return spark.read.parquet(path).select(
        "part_no", "section", F.col("block_ord.site_ord").alias("block_ord"), "is_line",
        F.coalesce(line, F.col("line_ord.site_ord")).alias("line_ord"), "text",
    )
