"""A whole run: captures and stores in, results, stores and digest out.

Two tables are written on the way, each once: what was read from the pages, so that no later step
cleans HTML again, and the decisions about new postings with their scores. Decisions are taken on
narrow columns; page text is fetched again only for postings that are new.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import estimated_tokens, usage_cost
from ..operators import capture, extract, incremental, matching, quarantine, report
from ..sources.staging import require_utc, stage
from ..sources.stores import utc_times

PAGE = ["site_name", "page_num"]
POSTING = [*PAGE, "pos"]


def discover_listings(captures: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages read, and a posting for each item of the listings on them (``extract.listing_postings``)."""
    chosen = capture.tier_fallback(capture.in_scope(captures, targets))
    read = extract.listing_postings(chosen, keep=["tier_used"]).withColumns(
        {"readable": F.col("description") != "", "input_tokens": estimated_tokens(F.col("description"))}
    )
    detail = stage(read, "listings")
    pages = detail.groupBy(*PAGE, "tier_used").agg(F.max("readable").alias("readable"), F.sum("input_tokens").alias("input_tokens"))
    return pages, detail.filter("readable").drop("readable", "tier_used")


def discover(captures: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages read, and their postings by the rule-based reader, which needs no token budget: it asks no model. An empty page
    has no posting.

    ``targets`` is flat (``sources.targets.site_targets``) and carries ``site_ord``.
    """
    chosen = capture.tier_fallback(capture.in_scope(captures, targets))
    read = extract.extract_postings(capture.page_text(chosen), keep=["tier_used"]).withColumns(
        {
            "readable": F.col("description") != "",
            "input_tokens": estimated_tokens(F.col("description")),
        }
    )
    detail = stage(read, "detail")
    pages = detail.select(*PAGE, "tier_used", "readable", "input_tokens")
    return pages, detail.filter("readable").drop("readable", "tier_used")


def discover_replies(
    captures: DataFrame, targets: DataFrame, replies: DataFrame, most: int | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages, their postings from extraction replies, and the quarantine of both steps.

    ``replies(site_name, page_num, text, input_tokens, output_tokens)`` answers the requests of
    ``operators.extract.extract_input``. Pages that are empty or above the token budget are not requested. Of several
    replies to a page a readable one counts, the first by its text, and all are paid. ``most`` keeps the first
    postings of a reply.
    """
    chosen = capture.tier_fallback(capture.in_scope(captures, targets))
    texts = capture.page_text(chosen).select(
        *PAGE, "site_ord", "url", "tier_used", (F.col("text") == "").alias("empty"),
        capture.in_budget(F.col("text")).alias("readable"),
    )
    ok = extract.is_json_object(F.col("text"))
    answers = extract.extraction_cost(replies).withColumn("ok", ok).groupBy(*PAGE).agg(
        F.min_by("text", F.struct(~F.col("ok"), F.col("text"))).alias("text"), F.max("ok").alias("ok"),
        F.sum("cost_usd").alias("cost_usd"), F.sum("input_tokens").alias("input_tokens"),
    )
    asked = quarantine.tagged(
        texts, (F.col("empty"), quarantine.EMPTY_PAGE), (~F.col("readable"), quarantine.LONG_PAGE)
    ).withColumnRenamed("reason", "not_asked")
    # One table of a row a page: the pages' texts have done their part.
    read = stage(asked.join(answers, PAGE, "left"), "replies")
    pages = read.select(
        *PAGE, "tier_used", "readable", "input_tokens", F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd")
    )
    requested = quarantine.tagged(
        read.where("not_asked IS NULL"), (F.col("text").isNull(), quarantine.NO_REPLY), (~F.col("ok"), quarantine.BAD_REPLY)
    )
    raw = extract.parse_postings(quarantine.kept(requested).select(*PAGE, "site_ord", "url", "text"))
    found = raw if most is None else raw.where(F.col("pos") < most)
    postings = stage(extract.posting_projection(found), "postings")
    quarantined = quarantine.held(read.withColumnRenamed("not_asked", "reason"), quarantine.REQUEST).unionByName(
        quarantine.held(requested, quarantine.EXTRACT)
    )
    if most is not None:
        beyond = quarantine.tagged(raw, (F.col("pos") >= most, quarantine.BEYOND_CAP))
        quarantined = quarantined.unionByName(quarantine.held(beyond, quarantine.EXTRACT))
    return pages, postings, quarantined


def discover_from_replies(
    captures: DataFrame, targets: DataFrame, replies: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Pages and postings of ``discover_replies``."""
    return discover_replies(captures, targets, replies)[:2]


def posting_tokens(postings: DataFrame) -> DataFrame:
    """Estimated tokens per posting, where the reader did not measure them."""
    if "input_tokens" in postings.columns:
        return postings
    return postings.withColumn("input_tokens", estimated_tokens(F.col("description")))


def run(
    targets: DataFrame,
    pages: DataFrame,
    postings: DataFrame,
    profiles: DataFrame,
    seen: DataFrame,
    health: DataFrame,
    run_at: datetime.datetime,
    threshold: float = matching.THRESHOLD,
    reply_tokens: tuple[int, int] = (0, 0),
    title: str = "Posting digest",
    score: Callable[[DataFrame, DataFrame], DataFrame] = matching.match_scores,
    quarantined: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """All outputs of one run but the digest (``digest_of``). ``run_at`` is the only clock.

    ``pages`` needs ``tier_used``, ``readable`` and ``input_tokens`` for every page that could be
    read; ``reply_tokens`` are the output tokens charged per page read and per posting matched,
    unless pages or scores bring a ``cost_usd`` column. ``score(texts, profiles)`` gives best and
    runner-up per ``dedup_key``; without ``missing_keywords`` they are taken from the texts. ``quarantined`` are rows
    that reading the pages has put aside; those of pages that count are part of the run's own. Alerts are for
    errors that were not foreseen, which a capture that failed is not.
    """
    require_utc(targets.sparkSession)
    now = F.lit(run_at).cast("timestamp")
    health_now = utc_times(health)
    narrow = posting_tokens(postings).drop("description", "snippet")
    # The store is met once; from here on only the keys this run shares with it matter.
    known = stage(incremental.known_keys(narrow, seen), "known")

    # Which pages count.
    expected = capture.page_offsets(targets).select(
        F.col("name").alias("site_name"), "page_num", "page_url"
    )
    stats = incremental.page_stats(
        expected.join(pages, PAGE, "left").withColumn("failed", F.col("tier_used").isNull()),
        narrow,
        known,
    )
    judged = stage(incremental.freshness_stop(stats, health_now), "judged")
    visited = incremental.visited_pages(judged)
    errors = expected.filter("page_num = 0").join(pages, PAGE, "left_anti").select(
        "site_name",
        F.format_string(
            "All scraping tiers failed for %s (%s)", "site_name", "page_url"
        ).alias("error"),
    )

    # Which postings are new, and how they score.
    found = narrow.join(visited.select(*PAGE), PAGE, "left_semi")
    new = stage(incremental.new_first_occurrence(found, known), "new")
    texts = postings.select(*POSTING, "description").join(
        new.select(*POSTING, "dedup_key"), POSTING
    )
    scores = stage(matching.resolve_scores(score(texts, profiles), profiles), "scores")
    reported = matching.match_threshold(scores, threshold)
    matches = reported
    if "missing_keywords" not in scores.columns:
        matches = matching.with_gaps(reported, texts, profiles)
    matches = matches.join(new, "dedup_key")

    # What was put aside.
    cuts = incremental.site_cuts(judged).where("fail_page IS NOT NULL AND (stop_page IS NULL OR fail_page <= stop_page)")
    lost = quarantine.held(
        cuts.select("site_name", F.col("fail_page").alias("page_num"), F.lit(quarantine.NO_CAPTURE).alias("reason")), quarantine.CAPTURE
    )
    if quarantined is not None:
        lost = lost.unionByName(quarantined.join(visited.select(*PAGE), PAGE, "left_semi").select(*quarantine.COLUMNS))
    if "bad_score" in scores.columns:  # scores are replies
        answered = new.select(*POSTING, "dedup_key").join(
            scores.select("dedup_key", "bad_score", "unreadable", "best_label", F.lit(True).alias("replied")), "dedup_key", "left"
        )
        unmatched = quarantine.tagged(
            answered, (F.col("replied").isNull(), quarantine.NO_REPLY), (F.col("unreadable"), quarantine.BAD_REPLY),
            (F.col("bad_score"), quarantine.BAD_SCORE), (F.col("best_label").isNull(), quarantine.UNKNOWN_PROFILE),
        )
        lost = lost.unionByName(quarantine.held(unmatched, quarantine.MATCH))

    # What the run amounts to.
    costs = _costs(visited.filter("readable"), "extract", reply_tokens[0]).unionByName(
        _costs(new.join(scores.select("dedup_key", "cost_usd"), "dedup_key"), "match", 0)
        if "cost_usd" in scores.columns
        else _costs(new, "match", reply_tokens[1])
    )
    results = stage(
        report.site_results(
            targets, visited, found, new, reported.join(new, "dedup_key"), costs, errors
        ),
        "results",
    )
    summary = report.run_summary(results, now)
    counts = results.select("site_name", F.col("jobs_found").alias("job_count"))
    health_next = incremental.health_upsert(health_now, counts, now)
    stale = incremental.stale_sites(health_next).join(
        results.select("site_name", "site_ord"), "site_name"
    )
    return {
        "visited": visited,
        "new_postings": new,
        "scores": scores,
        "matches": matches,
        "site_results": results,
        "run_summary": summary,
        "run_errors": report.run_errors(results),
        "quarantine": lost,
        "failures": report.failure_rows(quarantine.unexpected(lost), now, title),
        "stale_sites": stale,
        "seen_new": incremental.seen_rows(new, scores, now),
        "health_next": health_next,
    }


def _costs(rows: DataFrame, step: str, output_tokens: int) -> DataFrame:
    cost = usage_cost(step, F.col("input_tokens"), F.lit(output_tokens))
    if "cost_usd" in rows.columns:
        cost = F.col("cost_usd")
    return rows.select("site_name", cost.alias("cost_usd"))


def digest_of(outputs: dict[str, DataFrame], title: str = "Posting digest") -> DataFrame:
    """Message pieces of a run."""
    parts = [outputs[name] for name in ("run_summary", "run_errors", "stale_sites")]
    return report.digest(stage(outputs["matches"], "matches"), *parts, title=title)


def full_run(
    captures: DataFrame, targets: DataFrame, profiles: DataFrame, seen: DataFrame,
    health: DataFrame, run_at: datetime.datetime, reader: Callable = discover, **options,
) -> dict[str, DataFrame]:
    """A run on captures by a rule-based ``reader``: ``discover`` for detail pages, ``discover_listings`` for listings."""
    pages, postings = reader(captures, targets)
    return run(targets, pages, postings, profiles, seen, health, run_at, **options)


def run_on_replies(
    captures: DataFrame, targets: DataFrame, profiles: DataFrame, seen: DataFrame, health: DataFrame, run_at: datetime.datetime,
    replies: DataFrame, match_replies: DataFrame, most: int | None = None, **options,
) -> dict[str, DataFrame]:
    """A run on a model's replies: ``replies`` to pages, ``match_replies(dedup_key, text, input_tokens, output_tokens)`` to
    new postings."""
    pages, postings, quarantined = discover_replies(captures, targets, replies, most)
    return run(
        targets, pages, postings, profiles, seen, health, run_at, quarantined=quarantined,
        score=lambda texts, known: matching.reply_scores(match_replies), **options,
    )
