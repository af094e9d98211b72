"""Digest texts, and packing against a plain greedy loop."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import report

AT = datetime.datetime(2024, 6, 1, 12, 0)
MATCH = (
    "company string, site_ord bigint, page_num int, pos int, title string, url string, best_label string, "
    "best_score double, match_reason string, missing_keywords array<string>, runner_up_label string, runner_up_score double"
)
SUMMARY = (
    "run_at timestamp, sites_attempted bigint, sites_succeeded bigint, sites_failed bigint, "
    "total_jobs_found bigint, new_jobs bigint, n_matches bigint, total_cost_usd double"
)


def match(company, ord_, title="Welder", missing=(), second="B", second_score=0.61, pos=0):
    return (company, ord_, 0, pos, title, "https://x/1", "A", 0.93, "why not", list(missing), second, second_score)


def summary(spark, n, failed=0):
    return spark.createDataFrame([(AT, 6, 6 - failed, failed, 208, 31, n, 1.5)], SUMMARY)


def stale_rows(spark, *rows):
    return spark.createDataFrame(list(rows), "site_name string, site_ord bigint, warning string")


def errors(spark, *rows):
    return spark.createDataFrame(list(rows), "site_ord bigint, error string")


def greedy(lengths, header, limit):
    parts, part, used = [], 1, None
    for n in lengths:
        if used is not None and used + n > limit:
            part, used = part + 1, header + n
        else:
            used = (header if used is None else used) + n
        parts.append(part)
    return parts


def pack(spark, lengths, chunk, header=100, limit=4000):
    rows = [(f"c{i:06d}", i, 0, 0, n) for i, n in enumerate(lengths)]
    random.Random(1).shuffle(rows)
    blocks = spark.createDataFrame(
        rows, "company string, site_ord bigint, page_num int, pos int, block_len bigint"
    )
    return [r["part_no"] for r in sorted(report.message_pack(blocks, header, limit, chunk).collect())]


@pytest.mark.parametrize("chunk", [3, 50, 10_000])
def test_packing_equals_the_greedy_loop(spark, chunk):
    rng = random.Random(chunk)
    for sizes in ((90, 400), (1000, 6000), (3900, 3900), (3899, 3902)):
        lengths = [rng.randint(*sizes) for _ in range(120)]
        assert pack(spark, lengths, chunk) == greedy(lengths, 100, 4000)


def test_oversized_block_stays_whole_in_its_own_part(spark):
    assert pack(spark, [100, 9000, 100, 100], 2) == [1, 2, 3, 3]


def texts(pieces):
    return [r["text"] for r in report.messages(pieces).orderBy("part_no").collect()]  # parts of ordinary size: one row each


def test_digest_without_matches(spark):
    none = spark.createDataFrame([], MATCH)
    stale = stale_rows(spark, ("Still", 1, "\nW1"), ("Quiet", 2, "\nW2"))
    got = texts(report.digest(none, summary(spark, 0, 1), errors(spark, (1, "A — x")), stale))
    assert got == [
        "✅ <b>Posting digest — no new matches</b>\n<i>2024-06-01 12:00 UTC</i>\n\n"
        "📊 Sites: 6 · Jobs: 208 · New: 31 · Matches: 0\n💰 Cost: $1.5000\nW1\nW2"
    ]


def test_digest_with_matches(spark):
    rows = [
        match("Zeta", 1, missing=["welding", "rust"]),
        match("Alpha", 2, second=None),
        match("Zeta", 3, title="ML", second_score=None),
    ]
    stale = stale_rows(spark, ("Still", 1, "\nW1"))
    got = texts(report.digest(spark.createDataFrame(rows, MATCH), summary(spark, 3, 1), errors(spark, (4, "Q — boom")), stale))
    link = '│  <a href="https://x/1">View Job →</a>'
    head = "│  Resume: <i>A</i> · Match: <b>93%</b>\n│  why not\n"
    assert got == [
        "🔍 <b>Posting digest — 3 new match(es)</b>\n<i>2024-06-01 12:00 UTC</i>\n"
        f"\n<b>Zeta</b>\n├ 🎯 <b>Welder</b>\n{head}│  ⚠️ Missing: welding, rust\n│  Runner-up: B · 61%\n{link}"
        f"\n├ 🎯 <b>ML</b>\n{head}{link}"
        f"\n<b>Alpha</b>\n├ 🎯 <b>Welder</b>\n{head}{link}"
        "\n──────────────────\n📊 <b>Run summary</b>\nSites: 6 checked · 5 OK · 1 failed\n"
        "Jobs: 208 found · 31 new · 3 matches\n💰 Cost: $1.5000\n⚠️ Failed: Q — boom\n\nW1"
    ]


@pytest.mark.parametrize("over", [-1, 0, 1])
def test_a_part_is_full_at_the_limit(spark, over):
    """Two blocks that together fill a part to one below, exactly to, or one above the limit."""
    header, limit, first = 100, 4000, 1700
    lengths = [first, limit - header - first + over, 40]
    got = pack(spark, lengths, 2, header, limit)
    assert got == ([1, 2, 2] if over > 0 else [1, 1, 2]) == greedy(lengths, header, limit)


def test_every_part_of_a_digest_has_its_header_and_whole_companies(spark):
    rng = random.Random(6)
    rows = [match(f"Firm {i:02d}", i, title="t" * rng.randint(1, 900), missing=["rust"] * (i % 3)) for i in range(33)]
    got = texts(report.digest(spark.createDataFrame(rows, MATCH), summary(spark, 33), errors(spark), stale_rows(spark)))
    heads = {t.split("\n", 1)[0] for t in got}
    assert heads == {"🔍 <b>Posting digest — 33 new match(es)</b>"} and 1 < len(got) < 33
    assert max(map(len, got)) <= 4000
    firms = [w for t in got for w in sorted({f"Firm {i:02d}" for i in range(33) if f"<b>Firm {i:02d}</b>" in t})]
    assert firms == [f"Firm {i:02d}" for i in range(33)]


def test_very_long_company_is_read_in_pieces(spark):
    rows = [match("Big", 1, pos=i, title="x" * 300) for i in range(200)] + [match("Small", 2)]
    pieces = report.digest(spark.createDataFrame(rows, MATCH), summary(spark, 201), errors(spark), stale_rows(spark))
    ordered = report.messages(pieces).orderBy(*report.PIECE_ORDER).collect()
    parts = {}
    for r in ordered:
        parts.setdefault(r["part_no"], []).append(r["text"])
    assert len(parts[1]) == 202 and len("".join(parts[1])) > 64_000 and "".join(parts[1]).count("View Job") == 200
    assert len(parts[2]) == 1 and parts[2][0].count("View Job") == 1
    whole = report.messages(pieces, most=10**9).where("part_no = 1").collect()
    assert [r["text"] for r in whole] == ["".join(parts[1])] and whole[0]["chars"] == len(whole[0]["text"])


@pytest.mark.parametrize("seed", range(3))
def test_transfers_combine_in_any_order(seed):
    """Runs of blocks put together pairwise, from the left or from the right, do what the plain loop does."""
    rng = random.Random(seed)
    header, limit = 100, 1000
    lengths = [rng.choice((5, 60, 300, 700, 899, 900, 901, 1500)) for _ in range(60)]

    def one(n):
        return report.Transfer([n, float("inf")], [1, 0], [n, n]) if n <= limit - header - 1 else report.Transfer([n], [1], [n])

    def left(runs):
        whole = runs[0]
        for run in runs[1:]:
            whole = whole.then(run, header, limit)
        return whole

    def halves(runs):
        middle = len(runs) // 2
        return runs[0] if len(runs) == 1 else halves(runs[:middle]).then(halves(runs[middle:]), header, limit)

    singles = [one(n) for n in lengths]
    for carried in (header + 1, 400, limit, limit + 1):
        used, parts = carried, 0
        for n in lengths:
            used, parts = (header + n, parts + 1) if used + n > limit else (used + n, parts)
        assert left(singles).after(carried, header, limit) == halves(singles).after(carried, header, limit) == (used, parts)
    assert len(halves(singles).reach) <= 200


def test_packing_has_no_task_for_all(spark):
    """Runs of many chunks: numbers of partitions do not grow with the blocks."""
    rng = random.Random(9)
    lengths = [rng.randint(200, 2500) for _ in range(3000)]
    rows = [(f"c{i:06d}", i, 0, 0, n) for i, n in enumerate(lengths)]
    blocks = spark.createDataFrame(rows, "company string, site_ord bigint, page_num int, pos int, block_len bigint")
    chunks = report.in_chunks(blocks, 20)
    assert chunks.select("chunk").distinct().count() >= 150
    by_chunk = [r.chunk for r in chunks.orderBy("site_ord").collect()]
    assert by_chunk == sorted(by_chunk)
    plan = report.message_pack(blocks, 100, 4000, 20)
    assert "SinglePartition" not in plan._jdf.queryExecution().executedPlan().toString()
    assert [r["part_no"] for r in sorted(plan.collect())] == greedy(lengths, 100, 4000)


def test_html_is_escaped_on_request(spark):
    row = spark.createDataFrame([match("A", 1, title="C<D & E")], MATCH)
    plain, escaped = row.select(report.digest_lines(), report.digest_lines(escape=True)).first()
    assert "<b>C<D & E</b>" in plain and "<b>C&lt;D &amp; E</b>" in escaped


def test_dry_run_writes_nothing(spark, tmp_path):
    pieces = report.digest(
        spark.createDataFrame([match("A", 1)], MATCH), summary(spark, 1), errors(spark), stale_rows(spark)
    )
    path = tmp_path / "digest"
    assert report.digest_out(pieces, str(path), dry_run=True).count() == 4  # header, company, match, footer
    assert not path.exists()
    report.digest_out(pieces, str(path))
    assert spark.read.parquet(str(path)).count() == 4


def test_failure_alert(spark):
    rows = spark.createDataFrame([("Acme", "ValueError", "went wrong"), ("Ok", None, None)], "site_name string, error_type string, error string")
    alerts = [r["alert"] for r in report.failure_rows(rows, F.lit(AT)).collect()]
    assert len(alerts) == 1
    assert "<b>Error:</b> ValueError: went wrong\n<b>Context:</b> processing Acme" in alerts[0]
