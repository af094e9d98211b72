"""Dates, times, keys, scores and number formats as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Display names of known profile files.
KNOWN_LABELS = {
    "software_engineer_ai.md": "Software Engineer (AI Focused)",
    "ai_engineer.md": "AI Engineer",
    "data_scientist.md": "Data Scientist",
}
# USD per million tokens (input, output) of the two model steps.
PRICES = {"extract": (0.80, 4.00), "match": (3.00, 15.00)}

WEEK_DATE = r"^(\d{4})-?W(\d{2})(?:-?([1-7]))?$"
# Hour, minute and second with colons or without; the offset may have either form of its own.
_HOUR, _SIXTY = r"([01]\d|2[0-3])", r"([0-5]\d)"
CLOCK = (
    rf"^T?(?:{_HOUR}(?::{_SIXTY}(?::{_SIXTY}(?:[.,]\d+)?)?)?|{_HOUR}{_SIXTY}(?:{_SIXTY}(?:[.,]\d+)?)?)"
    r"(?:Z|[+-](?:[01]\d|2[0-3])(?::[0-5]\d(?::[0-5]\d(?:[.,]\d+)?)?|[0-5]\d(?:[0-5]\d(?:[.,]\d+)?)?)?)?$"
)


def parse_date(value: Column) -> Column:
    """ISO calendar or week date, NULL for anything else."""
    year = F.regexp_extract(value, WEEK_DATE, 1).cast("int")
    week = F.regexp_extract(value, WEEK_DATE, 2).cast("int")
    day = F.coalesce(F.nullif(F.regexp_extract(value, WEEK_DATE, 3), F.lit("")), F.lit("1"))
    first_monday = F.to_date(F.date_trunc("week", F.make_date(year, F.lit(1), F.lit(4))))
    from_week = let(
        F.date_add(first_monday, (week - 1) * 7),
        # The Thursday of an ISO week lies in the year the week belongs to.
        lambda monday: F.when(
            (week >= 1) & (F.year(F.date_add(monday, 3)) == year),
            F.date_add(monday, day.cast("int") - 1),
        ),
    )
    return (
        F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(value, "yyyy-MM-dd"))
        .when(value.rlike(r"^\d{8}$"), F.try_to_date(value, "yyyyMMdd"))
        .when(value.rlike(WEEK_DATE), from_week)
    )


def parse_time(value: Column) -> Column:
    """Clock time as ``HH:mm:ss``; fractions and offsets are dropped, NULL when invalid."""
    # groups 1 to 3 with colons, 4 to 6 without: one of the two rows is empty
    parts = [
        F.coalesce(
            F.nullif(F.concat(F.regexp_extract(value, CLOCK, i), F.regexp_extract(value, CLOCK, i + 3)), F.lit("")),
            F.lit("00"),
        )
        for i in (1, 2, 3)
    ]
    return F.when(value.rlike(CLOCK), F.concat_ws(":", *parts))


def posted_at(day: Column, clock: Column) -> Column:
    """Date and clock time read as UTC; NULL when either is missing."""
    return F.when(
        day.isNotNull() & clock.isNotNull(),
        F.try_to_timestamp(F.concat_ws(" ", day.cast("string"), clock)),
    )


def dedup_key(job_id: Column, url: Column) -> Column:
    return F.coalesce(F.nullif(job_id, F.lit("")), F.substring(F.sha2(url, 256), 1, 16))


def dedup_type(job_id: Column) -> Column:
    return F.when(F.coalesce(job_id, F.lit("")) == "", F.lit("url_hash")).otherwise(
        F.lit("job_id")
    )


def profile_label(filename: Column) -> Column:
    """Known name, else the file stem with a capital at the start of every run of letters."""
    stem = F.replace(F.regexp_replace(filename, r"(?<=.)\.[^.]*$", ""), F.lit("_"), F.lit(" "))
    runs = F.regexp_extract_all(stem, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    titled = F.array_join(
        F.transform(
            runs,
            lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, F.lit(2), F.length(r)))),
        ),
        "",
    )
    label = titled
    for name, known in KNOWN_LABELS.items():
        label = F.when(filename == name, F.lit(known)).otherwise(label)
    return label


def score_pct(score: Column) -> Column:
    """Whole percent, ties to even."""
    return F.concat(F.bround(score * 100, 0).cast("bigint").cast("string"), F.lit("%"))


def score_band(score: Column) -> Column:
    return (
        F.when(score >= 0.9, "exceptional")
        .when(score >= 0.75, "strong")
        .when(score >= 0.6, "moderate")
        .when(score.isNotNull(), "weak")
    )


def usage_cost(step: str, input_tokens: Column, output_tokens: Column) -> Column:
    price_in, price_out = PRICES[step]
    return input_tokens * F.lit(price_in / 1e6) + output_tokens * F.lit(price_out / 1e6)


def cost_str(cost: Column) -> Column:
    """Dollars with four decimals, rounded by the exact binary value of a cost >= 0.

    ``format_string`` rounds the shortest decimal form instead and differs on near ties. Here the
    distance to the tie is exact: the cost is split in two halves whose multiples have no error.
    """

    def rounded(c: Column) -> Column:
        scaled = F.floor(c * 10_000)
        high = c * 134_217_729.0 - (c * 134_217_729.0 - c)
        past_tie = (high * 20_000 - (scaled * 2 + 1)) + (c - high) * 20_000
        up = (past_tie > 0) | ((past_tie == 0) & (scaled % 2 == 1))
        return scaled + F.when(up, 1).otherwise(0)

    return let(
        rounded(cost),
        lambda n: F.concat(
            F.lit("$"),
            F.floor(n / 10_000).cast("string"),
            F.lit("."),
            F.lpad((n % 10_000).cast("string"), 4, "0"),
        ),
    )


def run_time_str(run_at: Column) -> Column:
    return F.date_format(run_at, "yyyy-MM-dd HH:mm")


def estimated_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4)
