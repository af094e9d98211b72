"""SQL fragments shared by the twins of the registered queries (DuckDB dialect)."""

from __future__ import annotations

WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def decode(x: str) -> str:
    """The character references of the test pages; titles are cut, so one may lack its end."""
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "©"), ("middot", "·")):
        x = f"replace({x}, '&{name};', '{char}')"
    x = f"regexp_replace({x}, '&amp([^a-zA-Z0-9;]|\\z)', '&amp;\\1', 'g')"
    return f"replace({x}, '&amp;', '&')"


def clean(html: str) -> str:
    """Visible text of the test pages, which nest no menu in itself."""
    x = f"regexp_replace({html}, '(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', chr(1), 'g')"
    for tag in ("nav", "footer", "header"):
        x = rf"regexp_replace({x}, '(?is)<{tag}(\s[^>]*)?>.*?</{tag}\s*>', chr(1), 'g')"
    x = f"regexp_replace({x}, '<([!?]|/?[a-zA-Z])[^>]*>', chr(1), 'g')"
    x = decode(x)
    x = f"regexp_replace({x}, '[{WS}]*\\x01[{WS}\\x01]*', chr(10), 'g')"
    x = f"regexp_replace({x}, '^[{WS}]+|[{WS}]+\\z', '', 'g')"
    return f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')"


def terms(text: str) -> str:
    return rf"list_distinct(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+'))"


SITE = "regexp_extract(url, '//([^/]+)', 1)"
KEY = r"regexp_extract(url, '/(\d+)', 1)"

# Pages with site, position and key.
PG = rf"""pg AS (
  SELECT page_id, url, html, site_name, {KEY} AS job_id,
         CAST(row_number() OVER (PARTITION BY site_name ORDER BY page_id) - 1 AS INTEGER) AS page_num,
         CAST(DATE '2024-01-01' + CAST(page_id % 30 AS INTEGER) AS DATE) AS day
  FROM (SELECT *, {SITE} AS site_name FROM pages))"""

TG = f"""tg AS (
  SELECT site_name AS name, min(page_id) AS site_ord, arg_min(url, page_id) AS url,
         CASE WHEN min(page_id) % 4 = 1 THEN 'playwright' ELSE 'http' END AS scrape_tier,
         CASE min(page_id) % 9 WHEN 0 THEN NULL WHEN 1 THEN 'page' ELSE 'start' END AS param,
         CASE WHEN min(page_id) % 9 > 1 THEN 10 ELSE 20 END AS step,
         CASE WHEN min(page_id) % 9 > 1 THEN count(*) + 2 ELSE 5 END AS max_pages
  FROM (SELECT *, {SITE} AS site_name FROM pages) GROUP BY site_name)"""

# Every page a run may visit.
EXPECTED = """ex AS (
  SELECT *, CAST(unnest(range(CASE WHEN param IS NULL THEN 1 ELSE max_pages END)) AS INTEGER) AS page_num FROM tg)"""

SEEN = """seen AS (
  SELECT CAST(doc_id AS VARCHAR) AS dedup_key, max(quality) AS quality FROM labels GROUP BY 1)"""

HEALTH = """health AS (
  SELECT name AS site_name, CAST(site_ord % 5 AS INTEGER) AS consecutive_zeros,
         CASE WHEN site_ord % 4 IN (2, 3) THEN TIMESTAMP '2024-01-15 12:00:00' END AS last_success_at
  FROM tg WHERE url LIKE 'https:%')"""

# Page URL with ``param`` set to ``value``; the test URLs have five endings.
def with_param(url: str, param: str, value: str) -> str:
    head = f"regexp_extract({url}, '^[^?#]*')"
    query = f"regexp_extract({url}, '\\?([^#]*)', 1)"
    tail = f"regexp_extract({url}, '#.*$')"
    replaced = f"regexp_replace({query}, '(^|&)' || {param} || '=[^&]*', '\\1' || {param} || '=' || {value})"
    return (
        f"{head} || '?' || CASE WHEN {query} = '' THEN {param} || '=' || {value}"
        f" WHEN regexp_matches({query}, '(^|&)' || {param} || '=') THEN {replaced}"
        f" ELSE {query} || '&' || {param} || '=' || {value} END || {tail}"
    )


# ``orders`` as listing pages.
OP = """op AS (
  SELECT printf('site-%02d', o_custkey % 50) AS site_name, o_custkey % 50 AS site_ord,
         CAST(2001 - year(o_orderdate) AS INTEGER) AS page_num, o_orderkey AS pos,
         CAST(o_orderkey // 3 AS VARCHAR) AS dedup_key,
         CASE WHEN o_custkey % 50 >= 10 AND o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS posted_date,
         CASE WHEN o_custkey % 50 >= 20 AND o_orderkey % 3 = 0 THEN o_orderkey % 24 END AS posted_hour
  FROM orders),
pages_o AS (
  SELECT site_name, site_ord, CAST(p AS INTEGER) AS page_num
  FROM (SELECT DISTINCT site_name, site_ord FROM op), range(10) r(p)),
seen_o AS (SELECT DISTINCT CAST(o_orderkey // 3 AS VARCHAR) AS dedup_key FROM orders WHERE o_orderstatus = 'F'),
health_o AS (
  SELECT printf('site-%02d', n) AS site_name,
         CASE WHEN n % 6 <> 0 THEN TIMESTAMP '1997-01-01 12:00:00' + n * 30 * INTERVAL 1 DAY END AS last_run
  FROM (SELECT DISTINCT o_custkey % 50 AS n FROM orders)),
stats_o AS (
  SELECT p.site_name, p.site_ord, p.page_num, count(o.pos) AS jobs,
         coalesce(any_value(n.new_jobs), 0) AS new_jobs,
         coalesce(bool_or(o.posted_date IS NOT NULL), false) AND count(o.pos) > 0 AS has_date,
         coalesce(bool_or(o.posted_hour IS NOT NULL), false) AND count(o.pos) > 0 AS has_time,
         max(CAST(o.posted_date AS TIMESTAMP) + o.posted_hour * INTERVAL 1 HOUR + INTERVAL 30 MINUTE) AS newest_at,
         max(o.posted_date) AS newest_date
  FROM pages_o p LEFT JOIN op o USING (site_name, page_num)
  LEFT JOIN (SELECT site_name, page_num, count(*) AS new_jobs
             FROM (SELECT site_name, dedup_key, min(page_num) AS page_num FROM op GROUP BY ALL)
             WHERE dedup_key NOT IN (SELECT dedup_key FROM seen_o) GROUP BY ALL) n USING (site_name, page_num)
  GROUP BY ALL),
judged_o AS (
  SELECT s.*, last_run,
         CASE WHEN jobs = 0 THEN true WHEN last_run IS NULL THEN false
              WHEN newest_at IS NOT NULL THEN newest_at < last_run
              WHEN has_date THEN newest_date < CAST(last_run - INTERVAL 1 DAY AS DATE)
              ELSE new_jobs = 0 END AS stop
  FROM stats_o s LEFT JOIN health_o USING (site_name))"""

RUNS = """runs AS (
  SELECT 'site-' || user_id AS site_name, date_trunc('day', ts) AS run_at,
         count(*) FILTER (event_type = 'purchase') AS job_count
  FROM events GROUP BY ALL)"""

STREAK = f"""{RUNS},
last AS (SELECT site_name, max(run_at) FILTER (job_count > 0) AS last_success_at FROM runs GROUP BY ALL),
streak AS (
  SELECT site_name, CAST(count(*) FILTER (last_success_at IS NULL OR run_at > last_success_at) AS INTEGER)
           AS consecutive_zeros, any_value(last_success_at) AS last_success_at
  FROM runs JOIN last USING (site_name) GROUP BY site_name)"""

# Term overlap of documents and profiles.
def overlap(postings: str, key: str, text: str) -> str:
    return f"""
pf AS (SELECT printf('profile_%05d.md', item_id) AS filename, 'Profile ' || printf('%05d', item_id) AS role_label,
              {terms('text')} AS terms FROM benchmark),
pt AS (SELECT filename, len(terms) AS n_terms, unnest(terms) AS term FROM pf),
dt AS (SELECT {key} AS dedup_key, unnest({terms(text)}) AS term FROM {postings}),
cnt AS (SELECT dedup_key, filename, n_terms, count(*) AS n_shared FROM dt JOIN pt USING (term) GROUP BY ALL),
sc AS (SELECT *, n_shared / n_terms AS score FROM cnt),
rk AS (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY score DESC, filename) AS r FROM sc),
bm AS (SELECT dedup_key, max(filename) FILTER (r = 1) AS best_filename, max(score) FILTER (r = 1) AS best_score,
              max(n_shared) FILTER (r = 1) AS n_shared, max(n_terms) FILTER (r = 1) AS n_terms,
              max(filename) FILTER (r = 2) AS runner_up_filename, max(score) FILTER (r = 2) AS runner_up_score
       FROM rk WHERE r <= 2 GROUP BY dedup_key)"""


# Model replies, written as the Spark binding writes them.
_JOB = """'{"title": "Role ' || (n * 100 + i) || '"'
  || CASE WHEN i % 5 <> 0 THEN ', "url": "/jobs/' || (n * 100 + i) || '"' ELSE ', "url": ""' END
  || CASE i % 3 WHEN 0 THEN ', "job_id": ' || (n * 100 + i) WHEN 1 THEN ', "job_id": null' ELSE '' END
  || CASE i % 4 WHEN 0 THEN ', "posted_date": "2024-01-1' WHEN 1 THEN ', "posted_date": "soon 1'
     ELSE ', "posted_date": "2024020' END || (i % 10)
  || '", "posted_time": "' || CASE WHEN i % 2 = 0 THEN '09:15' ELSE '25:00' END || '"'
  || CASE i % 6 WHEN 0 THEN ', "description": null' WHEN 1 THEN '' ELSE ', "description": "text"' END || '}'"""
REPLIES = f"""job AS (
  SELECT n, i, {_JOB} AS job FROM (SELECT page_id AS n, unnest(range(page_id % 65)) AS i FROM pages)),
body AS (
  SELECT page_id AS n, url, {SITE} AS site_name,
         '{{"jobs": [' || coalesce((SELECT string_agg(job, ', ' ORDER BY i) FROM job WHERE job.n = page_id), '')
         || ']}}' AS body FROM pages),
replies AS (
  SELECT CAST(n AS VARCHAR) AS request_id, site_name, url,
         CASE n % 9 WHEN 4 THEN '```json' || chr(10) || body || chr(10) || '```' || chr(10)
                    WHEN 5 THEN body || ' I hope this helps.'
                    WHEN 6 THEN '{{"jobs": [{{"title": "cut' || n ELSE body END AS text,
         CAST(length(url) AS BIGINT) AS input_tokens, n % 65 * 40 AS output_tokens
  FROM body)"""


def unfenced(text: str) -> str:
    trimmed = f"regexp_replace({text}, '^[{WS}]+|[{WS}]+\\z', '', 'g')"
    body = f"regexp_replace({trimmed}, '^[^\\n]*\\n', '')"
    inner = f"regexp_replace({body}, '(?s)^(.*)```.*\\z', '\\1')"
    return (
        f"CASE WHEN starts_with({trimmed}, '```')"
        f" THEN regexp_replace({inner}, '^[{WS}]+|[{WS}]+\\z', '', 'g') ELSE {trimmed} END"
    )


MATCH_REPLIES = """mbody AS (
  SELECT doc_id AS n, length(text) AS len,
         '{"best_resume_filename": "' || printf('profile_%05d.md', doc_id % 50) || '"'
         || CASE doc_id % 8 WHEN 1 THEN '' WHEN 2 THEN ', "best_score": null' WHEN 3 THEN ', "best_score": "high"'
            ELSE printf(', "best_score": 0.%02d', doc_id % 100) END
         || printf(', "match_reason": "reason %d"', doc_id)
         || CASE WHEN doc_id % 5 = 0 THEN '' ELSE ', "missing_keywords": ["k' || (doc_id % 10) || '", "sql"]' END
         || CASE WHEN doc_id % 6 = 0 THEN ', "runner_up_filename": null'
            ELSE ', "runner_up_filename": "' || printf('profile_%05d.md', doc_id * 7 % 60) || '"' END
         || CASE WHEN doc_id % 7 = 0 THEN ', "runner_up_score": null'
            ELSE printf(', "runner_up_score": 0.%02d', doc_id % 50) END || '}' AS body
  FROM documents),
mreplies AS (
  SELECT CAST(n AS VARCHAR) AS dedup_key, n,
         CASE n % 11 WHEN 3 THEN '```' || chr(10) || body || chr(10) || '```' WHEN 4 THEN body || '}'
                     WHEN 5 THEN substr(body, 1, 40) ELSE body END AS text,
         CAST(len AS BIGINT) AS input_tokens, n % 90 + 10 AS output_tokens
  FROM mbody)"""


def _parsed_match() -> str:
    t = unfenced("text")
    return f"""pm AS (
  SELECT dedup_key, n, input_tokens, output_tokens, json_valid({t}) AS ok,
         CASE WHEN json_valid({t}) THEN {t} END AS j FROM mreplies),
parsed AS (
  SELECT dedup_key, n, ok, input_tokens, output_tokens,
         CASE WHEN ok THEN coalesce(j->>'$.best_resume_filename', '') END AS best_filename,
         CASE WHEN ok THEN CASE WHEN json_type(j, '$.best_score') IS NULL THEN 0.0
              ELSE try_cast(j->>'$.best_score' AS DOUBLE) END END AS best_score,
         CASE WHEN ok THEN coalesce(j->>'$.match_reason', '') END AS match_reason,
         CASE WHEN ok THEN coalesce(array_to_string(CAST(json_extract_string(j, '$.missing_keywords[*]') AS VARCHAR[]), ','), '') END
           AS missing_keywords,
         nullif(j->>'$.runner_up_filename', '') AS runner_up_filename,
         try_cast(j->>'$.runner_up_score' AS DOUBLE) AS runner_up_score
  FROM pm)"""


PARSED_MATCH = f"{MATCH_REPLIES},\n{_parsed_match()}"
