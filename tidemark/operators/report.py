"""Per-site results, the run summary and the digest."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import cost_str, run_time_str, score_pct
from ..sources.staging import stage

# Python workers get these functions with the plan and need not find the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_PART_CHARS = 4000  # fixed value: characters of one message
WITHIN_BITS = 18  # of a chunk's number: its place within its partition
LEVEL_BITS, LEVELS = 12, 3  # chunks of a run of the lowest level, and levels that hold all numbers of chunks
CHUNK_BLOCKS = 4096  # company blocks packed by one task
BLOCK_ORDER = ["site_ord", "page_num", "pos"]

# Order of the pieces of a message.
HEADER, BLOCKS, FOOTER = 0, 1, 2


def distinct_sites(rows: DataFrame) -> DataFrame:
    return rows.select("site_name").distinct()


def all_matches(matches: DataFrame, *more: DataFrame) -> DataFrame:
    """Concatenation of match tables; run order is in their order columns."""
    for other in more:
        matches = matches.unionByName(other)
    return matches


def site_results(
    targets: DataFrame, visited: DataFrame, postings: DataFrame, new: DataFrame,
    matches: DataFrame, costs: DataFrame, errors: DataFrame,
) -> DataFrame:
    """One row per target: counts, cost, tier of the last page read, error.

    ``visited`` has a page per row with its tier, ``costs`` any number of cost rows per site and
    ``errors`` at most one row per site. Every count is aggregated before it is joined.
    """

    def counted(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("site_name").agg(F.count("*").alias(name))

    tiers = visited.groupBy("site_name").agg(F.max_by("tier_used", "page_num").alias("tier_used"))
    cost = costs.groupBy("site_name").agg(F.sum("cost_usd").alias("cost_usd"))
    rows = targets.select("site_ord", F.col("name").alias("site_name"), "url")
    for part in (
        counted(postings, "jobs_found"),
        counted(new, "new_jobs"),
        counted(matches, "n_matches"),
        tiers,
        cost,
        errors,
    ):
        rows = rows.join(part, "site_name", "left")
    return rows.withColumns(
        {
            "jobs_found": F.coalesce("jobs_found", F.lit(0)),
            "new_jobs": F.coalesce("new_jobs", F.lit(0)),
            "n_matches": F.coalesce("n_matches", F.lit(0)),
            "tier_used": F.coalesce("tier_used", F.lit("none")),
            "cost_usd": F.coalesce("cost_usd", F.lit(0.0)),
        }
    )


def run_summary(results: DataFrame, run_at: Column) -> DataFrame:
    """One row of counts per run; the error texts are the rows of ``run_errors``."""
    failed = F.coalesce(F.col("error") != "", F.lit(False))
    return results.agg(
        F.count("*").alias("sites_attempted"),
        F.count_if(~failed).alias("sites_succeeded"),
        F.count_if(failed).alias("sites_failed"),
        F.coalesce(F.sum("jobs_found"), F.lit(0)).alias("total_jobs_found"),
        F.coalesce(F.sum("new_jobs"), F.lit(0)).alias("new_jobs"),
        F.coalesce(F.sum("n_matches"), F.lit(0)).alias("n_matches"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("total_cost_usd"),
    ).select(run_at.alias("run_at"), "*")


def run_errors(results: DataFrame) -> DataFrame:
    return results.filter(F.coalesce(F.col("error") != "", F.lit(False))).select(
        "site_ord", F.concat("site_name", F.lit(" — "), "error").alias("error")
    )


def failure_rows(
    errors: DataFrame, run_at: Column, title: str = "Posting digest",
    hint: str = "Check the run logs for the full traceback.",
) -> DataFrame:
    """One alert text per row of ``errors(site_name, error_type, error)``; a ``context`` column
    replaces the note on the site."""
    known = "context" in errors.columns
    context = F.col("context") if known else F.concat(F.lit("processing "), "site_name")
    return errors.filter(F.col("error").isNotNull()).withColumn(
        "alert",
        F.concat(
            F.lit(f"🚨 <b>{title} — run failed</b>\n<i>"),
            run_time_str(run_at),
            F.lit(" UTC</i>\n\n<b>Error:</b> "),
            F.col("error_type"),
            F.lit(": "),
            F.col("error"),
            F.lit("\n<b>Context:</b> "),
            context,
            F.lit(f"\n\n{hint}"),
        ),
    )


def company_groups(matches: DataFrame) -> DataFrame:
    """Companies in order of their first match, with size; members stay rows of ``matches``."""
    return matches.groupBy("company").agg(
        F.min(F.struct("site_ord", "page_num", "pos")).alias("first_seen"),
        F.count("*").alias("n_matches"),
    )


def digest_lines(escape: bool = False) -> Column:
    """Text of one match; the lines on gaps and runner-up appear only when there is something."""

    def shown(name: str) -> Column:
        text = F.coalesce(F.col(name), F.lit(""))
        if not escape:
            return text
        for char, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            text = F.replace(text, F.lit(char), F.lit(ref))
        return text

    gaps = F.array_join("missing_keywords", ", ")
    second = F.col("runner_up_label").isNotNull() & F.col("runner_up_score").isNotNull()
    return F.concat_ws(
        "\n",
        F.concat(F.lit("├ 🎯 <b>"), shown("title"), F.lit("</b>")),
        F.concat(
            F.lit("│  Resume: <i>"),
            shown("best_label"),
            F.lit("</i> · Match: <b>"),
            score_pct(F.col("best_score")),
            F.lit("</b>"),
        ),
        F.concat(F.lit("│  "), shown("match_reason")),
        F.when(F.size("missing_keywords") > 0, F.concat(F.lit("│  ⚠️ Missing: "), gaps)),
        F.when(
            second,
            F.concat(
                F.lit("│  Runner-up: "),
                shown("runner_up_label"),
                F.lit(" · "),
                score_pct(F.col("runner_up_score")),
            ),
        ),
        F.concat(F.lit('│  <a href="'), shown("url"), F.lit('">View Job →</a>')),
    )


def digest_header(title: str = "Posting digest") -> Column:
    """First lines of a message, from a row of ``run_summary``."""
    time = run_time_str(F.col("run_at"))
    return F.when(
        F.col("n_matches") == 0,
        F.concat(
            F.lit(f"✅ <b>{title} — no new matches</b>\n<i>"),
            time,
            F.format_string(
                " UTC</i>\n\n📊 Sites: %d · Jobs: %d · New: %d · Matches: 0\n💰 Cost: ",
                "sites_attempted",
                "total_jobs_found",
                "new_jobs",
            ),
            cost_str(F.col("total_cost_usd")),
        ),
    ).otherwise(
        F.concat(
            F.lit(f"🔍 <b>{title} — "),
            F.col("n_matches").cast("string"),
            F.lit(" new match(es)</b>\n<i>"),
            time,
            F.lit(" UTC</i>\n"),
        )
    )


def digest_footer() -> Column:
    """Counts at the end of the last message; NULL when there is no match."""
    return F.when(
        F.col("n_matches") > 0,
        F.concat(
            F.format_string(
                "\n──────────────────\n📊 <b>Run summary</b>\n"
                "Sites: %d checked · %d OK · %d failed\nJobs: %d found · %d new · %d matches\n",
                "sites_attempted",
                "sites_succeeded",
                "sites_failed",
                "total_jobs_found",
                "new_jobs",
                "n_matches",
            ),
            F.lit("💰 Cost: "),
            cost_str(F.col("total_cost_usd")),
        ),
    )


def _openings(lengths: np.ndarray, header: int, limit: int) -> np.ndarray:
    """For each block as first of a part: index of the block that opens the next part."""
    ends = np.cumsum(lengths)
    starts = ends - lengths
    after = np.searchsorted(ends, starts + limit - header, side="right")
    return np.maximum(after, np.arange(1, len(lengths) + 1))


def _first_split(ends: np.ndarray, carried: int, limit: int) -> int:
    return int(np.searchsorted(ends, limit - carried, side="right"))


def _walk(opening: np.ndarray, first: int) -> list[int]:
    opened = []
    while first < len(opening):
        opened.append(first)
        first = int(opening[first])
    return opened


def in_chunks(blocks: DataFrame, rows: int = CHUNK_BLOCKS) -> DataFrame:
    """Number ordered ranges of at most ``rows`` blocks, in as many partitions as a shuffle has.

    Numbers grow along the order: the partition's, then the range's within its sorted partition. Written, so
    that the numbers are fixed.
    """
    ranges = blocks.repartitionByRange(*BLOCK_ORDER).sortWithinPartitions(*BLOCK_ORDER)
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    chunk = F.shiftleft(F.spark_partition_id().cast("bigint"), WITHIN_BITS) + F.floor(within / rows)
    return stage(ranges.withColumn("chunk", chunk), "chunks")


class Transfer:
    """What a run of blocks does to the part that is open where it begins.

    Row i holds when the part is carried on by ``reach[i - 1]`` characters but not by ``reach[i]``: that many parts are then
    opened in the run, and the last part holds ``tail`` characters of it. Rows that no carried length can reach
    are left out, so there are no more than blocks that fit into one part.
    """

    def __init__(self, reach, opened, tail):
        self.reach, self.opened, self.tail = np.asarray(reach, float), np.asarray(opened, np.int64), np.asarray(tail, np.int64)

    def after(self, carried: int, header: int, limit: int) -> tuple[int, int]:
        """(characters of the open part, parts opened) behind the run."""
        i = int(np.searchsorted(self.reach, limit - carried, side="right"))
        return (header + int(self.tail[i]), int(self.opened[i])) if self.opened[i] else (carried + int(self.tail[i]), 0)

    def then(self, other: Transfer, header: int, limit: int) -> Transfer:
        """Both runs one behind the other; the order in which runs are put together plays no part."""
        reach, opened, tail = [], [], []
        for r, n, t in zip(self.reach, self.opened, self.tail):
            if n:
                open_, more = other.after(header + int(t), header, limit)
                reach.append(r), opened.append(n + more), tail.append(open_ - header)
            else:  # all of the first run goes on with the part that is open
                reach += (other.reach + t).tolist()
                opened += other.opened.tolist()
                tail += np.where(other.opened > 0, other.tail, other.tail + t).tolist()
        last = int(np.searchsorted(reach, limit - header - 1, side="right")) + 1
        return Transfer(reach[:last], opened[:last], tail[:last])

    def frame(self, **names) -> pd.DataFrame:
        return pd.DataFrame({**names, "row": range(len(self.reach)), "reach": self.reach, "opened": self.opened, "tail": self.tail})


_TRANSFER = "row bigint, reach double, opened bigint, tail bigint"


def _transfers(rows: pd.DataFrame) -> list[tuple[int, Transfer]]:
    """(run, transfer) in order."""
    ordered = rows.sort_values(["run", "row"])
    return [(int(run), Transfer(own["reach"], own["opened"], own["tail"])) for run, own in ordered.groupby("run")]


def message_pack(
    blocks: DataFrame, header_len: int, limit: int = MAX_PART_CHARS, chunk_rows: int = CHUNK_BLOCKS
) -> DataFrame:
    """Assign company blocks to message parts, greedily and in order.

    ``blocks(company, site_ord, page_num, pos, block_len)``: a part is closed before the block
    that would make it longer than ``limit``; a single longer block stays whole in a part of its
    own. Greedy packing is sequential, but what a run of blocks does to the open part is a small table, and
    tables of neighbours combine: chunks are combined into runs of up to 2**LEVEL_BITS, these again, and from
    the top the part that is open is handed down to where each chunk begins. Then chunks are packed on their
    own. Only lengths are read; no task holds more than one chunk or the tables of one run.
    """
    blocks = in_chunks(blocks, chunk_rows)

    def outcomes(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = pdf.sort_values(BLOCK_ORDER)["block_len"].to_numpy()
        ends = np.cumsum(lengths)
        opening = _openings(lengths, header_len, limit)
        # The part open at the chunk's start holds a header and a block at least.
        last = min(_first_split(ends, header_len + 1, limit), len(lengths))
        rows = []
        for split in range(last + 1):
            opened = _walk(opening, split)
            tail = ends[-1] - (ends[opened[-1]] - lengths[opened[-1]]) if opened else ends[-1]
            rows.append((float(ends[split]) if split < len(lengths) else np.inf, len(opened), int(tail)))
        return Transfer(*zip(*rows)).frame(run=key[0])

    def combined(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        (_, whole), *rest = _transfers(pdf)
        for _, one in rest:
            whole = whole.then(one, header_len, limit)
        return whole.frame(run=key[0])

    def handed(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        carried, parts, out = int(right["carried"].iloc[0]), int(right["parts"].iloc[0]), []
        for run, one in _transfers(left):
            out.append((run, carried, parts))
            carried, opened = one.after(carried, header_len, limit)
            parts += opened
        return pd.DataFrame(out, columns=["run", "carried", "parts"])

    above = F.shiftright("run", LEVEL_BITS)
    levels = [blocks.groupBy(F.col("chunk").alias("run")).applyInPandas(outcomes, f"run bigint, {_TRANSFER}")]
    for _ in range(LEVELS - 1):
        levels.append(levels[-1].groupBy(above.alias("run")).applyInPandas(combined, f"run bigint, {_TRANSFER}"))
    # Before the first block the open part counts as full.
    starts = blocks.sparkSession.createDataFrame([(0, limit + 1, 0)], "run bigint, carried bigint, parts bigint")
    for level in reversed(levels):
        starts = (
            level.withColumn("above", above).groupBy("above").cogroup(starts.groupBy("run"))
            .applyInPandas(handed, "run bigint, carried bigint, parts bigint")
        )

    def packed(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(BLOCK_ORDER)
        lengths = left["block_len"].to_numpy()
        carried, parts = int(right["carried"].iloc[0]), int(right["parts"].iloc[0])
        first = _first_split(np.cumsum(lengths), carried, limit)
        opened = _walk(_openings(lengths, header_len, limit), first)
        part = parts + np.searchsorted(np.array(opened), np.arange(len(left)), side="right")
        return pd.DataFrame({"company": left["company"], "part_no": part})

    return (
        blocks.groupBy("chunk")
        .cogroup(starts.groupBy("run"))
        .applyInPandas(packed, "company string, part_no bigint")
    )


def company_blocks(matches: DataFrame) -> DataFrame:
    """Place and length of each company's block; texts are measured, not gathered."""
    lines = F.length(digest_lines()) + 1
    return (
        matches.select("company", "site_ord", "page_num", "pos", lines.alias("chars"))
        .groupBy("company")
        .agg(
            F.min(F.struct(*BLOCK_ORDER)).alias("first_seen"),
            F.sum("chars").alias("chars"),
        )
        .select(
            "company",
            "first_seen.*",
            (F.col("chars") + F.length(company_line())).alias("block_len"),
        )
    )


def company_line() -> Column:
    return F.concat(F.lit("\n<b>"), F.col("company"), F.lit("</b>"))


def digest(
    matches: DataFrame, summary: DataFrame, errors: DataFrame, stale: DataFrame,
    title: str = "Posting digest", limit: int = MAX_PART_CHARS,
) -> DataFrame:
    """Messages of a run as ordered pieces: their texts, put together in order, are the parts.

    A company's block may be as long as its matches are many, so a part is never one value; see
    ``messages`` for the texts of parts of ordinary size. ``summary`` is read once for the length
    of the header. ``stale`` needs ``site_ord`` and ``warning``.
    """
    header = digest_header(title)
    head = summary.select("n_matches", F.length(header).alias("chars")).first()
    nowhere = F.struct(
        F.lit(0).cast("bigint").alias("site_ord"),
        F.lit(0).alias("page_num"),
        F.lit(0).alias("pos"),
    )

    def piece(rows: DataFrame, section: int, text: Column, part=None, block=None, line=None):
        return rows.select(
            (F.lit(1).cast("bigint") if part is None else part).alias("part_no"),
            F.lit(section).alias("section"),
            (nowhere if block is None else block).alias("block_ord"),
            F.lit(0 if line is None else 1).alias("is_line"),
            (nowhere if line is None else line).alias("line_ord"),
            text.alias("text"),
        )

    def at(site_ord: Column) -> Column:
        return F.struct(
            site_ord.cast("bigint").alias("site_ord"),
            F.lit(0).alias("page_num"),
            F.lit(0).alias("pos"),
        )

    if head["n_matches"] == 0:
        return piece(summary, HEADER, header).unionByName(
            piece(stale, FOOTER, F.col("warning"), line=at(F.col("site_ord")))
        )

    blocks = company_blocks(matches)
    parts = message_pack(blocks, head["chars"], limit)
    # One row per company, written once; its size is known where matches are joined to it.
    placed = stage(
        blocks.join(parts, "company").select(
            "company", "part_no", F.struct("site_ord", "page_num", "pos").alias("block_ord")
        ),
        "placed",
    )
    part, block = F.col("part_no"), F.col("block_ord")
    own = F.struct("site_ord", "page_num", "pos")
    last = placed.agg(F.max("part_no")).scalar()
    headers = placed.select("part_no").distinct().withColumn(
        "text", summary.select(header).scalar()
    )
    gap = stale.agg(F.count("*").alias("n")).filter("n > 0")
    return (
        piece(headers, HEADER, F.col("text"), part)
        .unionByName(piece(placed, BLOCKS, company_line(), part, block))
        .unionByName(
            piece(
                matches.join(placed, "company"),
                BLOCKS,
                F.concat(F.lit("\n"), digest_lines()),
                part,
                block,
                own,
            )
        )
        .unionByName(piece(summary, FOOTER, digest_footer(), last))
        .unionByName(
            piece(
                errors,
                FOOTER + 1,
                F.concat(F.lit("\n⚠️ Failed: "), F.col("error")),
                last,
                line=at(F.col("site_ord")),
            )
        )
        .unionByName(piece(gap, FOOTER + 2, F.lit("\n"), last))
        .unionByName(piece(stale, FOOTER + 2, F.col("warning"), last, line=at(F.col("site_ord"))))
    )


PIECE_ORDER = ["part_no", "section", "block_ord", "is_line", "line_ord"]


def messages(pieces: DataFrame, most: int = 16 * MAX_PART_CHARS) -> DataFrame:
    """Texts of all parts, to be read in ``PIECE_ORDER``: a part of up to ``most`` characters is one row without a place, a
    longer one is the rows of its pieces, which put together in order are its text."""
    sizes = pieces.groupBy("part_no").agg(F.sum(F.length("text")).alias("chars"))
    sized = pieces.join(sizes, "part_no")
    places = [F.lit(None).cast(pieces.schema[c].dataType).alias(c) for c in PIECE_ORDER[1:]]
    ordered = F.array_sort(F.collect_list(F.struct(*PIECE_ORDER[1:], "text")))
    whole = sized.where(F.col("chars") <= most).groupBy("part_no", "chars").agg(
        F.array_join(F.transform(ordered, lambda p: p["text"]), "").alias("text")
    )
    rest = sized.where(F.col("chars") > most).select(*PIECE_ORDER, "chars", "text")
    return whole.select("part_no", *places, "chars", "text").union(rest)


def digest_out(pieces: DataFrame, path: str, dry_run: bool = False) -> DataFrame:
    """Write the pieces in order; a dry run only hands them back."""
    ordered = pieces.orderBy(*PIECE_ORDER)
    if not dry_run:
        ordered.write.mode("errorifexists").parquet(path)
    return ordered
