"""Table layouts, written as DDL."""

PAGINATION = "struct<param:string, step:int, max_pages:int>"
TARGETS_RAW = f"name string, url string, scrape_tier string, pagination {PAGINATION}"
CAPTURES = "site_name string, page_num int, url string, tier string, status int, html string"
PROFILES = "filename string, role_label string, content string"
REPLIES = "request_id string, text string, input_tokens bigint, output_tokens bigint"
PAGE_REPLIES = "site_name string, page_num int, text string, input_tokens bigint, output_tokens bigint"
MATCH_REPLIES = "dedup_key string, text string, input_tokens bigint, output_tokens bigint"
SEEN = (
    "dedup_key string, dedup_type string, title string, url string, company string, "
    "match_score double, seen_at timestamp"
)
HEALTH = "site_name string, consecutive_zeros int, last_success_at timestamp"
RUNS = "site_name string, run_at timestamp, job_count bigint"
