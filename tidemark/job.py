"""A scheduled run as a Spark job.

    spark-submit --py-files tidemark.zip -m tidemark.job --captures ... --targets ... --profiles ...
        --seen ... --health-in ... --health-out ... --digest ... --run-id 2024020106

With ``--replies`` and ``--match-replies`` a model's replies are read instead of the pages' own text and a lexical
score; ``--listings`` reads the items of listing pages. ``--quarantine`` names a folder for rows that were put
aside. A dry run keeps the digest and the alerts unwritten; the stores are updated all the same. The exit code is
1 when a site failed. When a run cannot start or ends early, an alert is written beside the digest.
"""

from __future__ import annotations

import argparse
import datetime
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import matching, report
from .plans import full_run as fr
from .sources import captures, profiles, schemas, stores, targets


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("captures", "targets", "profiles", "seen", "health-in", "health-out", "digest", "run-id"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--threshold", type=float, default=matching.THRESHOLD)
    parser.add_argument("--title", default="Posting digest")
    for name in ("replies", "match-replies", "quarantine"):
        parser.add_argument(f"--{name}")
    parser.add_argument("--listings", action="store_true")
    parser.add_argument("--dry-run", action="store_true")
    return parser.parse_args(argv)


def _alert(spark: SparkSession, args: argparse.Namespace, error: Exception, run_at: datetime.datetime) -> None:
    """The error that ended a run, in a folder beside the digest."""
    row = [(type(error).__name__, str(error), "job startup")]
    errors = spark.createDataFrame(row, "error_type string, error string, context string")
    alerts = report.failure_rows(errors, F.lit(run_at).cast("timestamp"), args.title).select("alert")
    alerts.write.mode("overwrite").parquet(f"{args.digest.rstrip('/')}-alerts")


def main(spark: SparkSession, args: argparse.Namespace, run_at: datetime.datetime) -> int:
    """Run once and write; number of failed sites."""
    try:
        return _run(spark, args, run_at)
    except Exception as error:
        if not args.dry_run:
            _alert(spark, args, error, run_at)
        raise


def _run(spark: SparkSession, args: argparse.Namespace, run_at: datetime.datetime) -> int:
    if (args.replies is None) != (args.match_replies is None):
        raise ValueError("replies to pages and to postings come together")
    listed = targets.read_targets_raw(spark, args.targets)
    refused = targets.refused(targets.require_sites(listed)).first()
    if refused is not None:
        raise ValueError(f"{refused['name']}: {refused['problem']}, see sources.targets.invalid_targets")
    inputs = {
        "captures": captures.read_captures(spark, args.captures),
        "targets": targets.site_targets(listed),
        "profiles": profiles.read_profiles(spark, args.profiles),
        "seen": stores.read_seen(spark, args.seen, without=args.run_id),
        "health": stores.read_health(spark, args.health_in),
        "run_at": run_at,
        "threshold": args.threshold,
        "title": args.title,
    }
    if args.replies is not None:
        pages = spark.read.schema(schemas.PAGE_REPLIES).json(args.replies)
        postings = spark.read.schema(schemas.MATCH_REPLIES).json(args.match_replies)
        outputs = fr.run_on_replies(**inputs, replies=pages, match_replies=postings)
    else:
        outputs = fr.full_run(**inputs, reader=fr.discover_listings if args.listings else fr.discover)
    pieces = fr.digest_of(outputs, args.title)
    stores.append_seen(outputs["seen_new"], args.seen, args.run_id)
    stores.write_health(outputs["health_next"], args.health_out)
    if args.quarantine:
        outputs["quarantine"].write.mode("overwrite").parquet(f"{args.quarantine.rstrip('/')}/run_id={args.run_id}")
    if not args.dry_run and not outputs["failures"].isEmpty():
        outputs["failures"].select("alert").write.mode("overwrite").parquet(f"{args.digest.rstrip('/')}-alerts")
    report.digest_out(pieces, args.digest, args.dry_run)
    return outputs["run_summary"].first()["sites_failed"]


if __name__ == "__main__":
    session = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    now = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
    sys.exit(1 if main(session, parse(), now) else 0)
