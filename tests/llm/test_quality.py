"""The ledger against a plain loop, policies and ablations, and the defined edge cases."""

import re
from collections import Counter

from pyspark.sql import functions as F

from tidemark.llm import quality

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def brute(text):
    words = [w for w in SPACE.split(text or "") if w]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if SPACE.sub("", x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text or ""), "n_shouts": len(re.findall("[A-Z]{4}", text or "")),
        "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit),
    }


TEXTS = [
    None, "", " \n\t ", "a", "a b", "a b c", "a b c a b c", "a a a a", "x y z x y z x y z q", "one\ntwo\none\n\n one\none",
    "# $ % a|b <c>", "LOUD WORDS HERE\x0bend\x0c", "é ü 漢字 😀😀", "w " * 5000, " ".join(f"w{i}" for i in range(3000)),
    "p q r s " * 10 + " ".join(f"u{i}" for i in range(60)), "ABCDEFGHI " * 60,
]


def test_measures_equal_a_plain_loop(docs):
    rows = quality.measure(docs(list(enumerate(TEXTS)))).collect()
    assert len(rows) == len(TEXTS)
    for row in rows:
        assert {k: row[k] for k in quality.MEASURES} == brute(TEXTS[row.doc_id]), TEXTS[row.doc_id]


def test_bits_policies_and_passing(docs, spark):
    table = docs([*enumerate(TEXTS), (None, TEXTS[14]), (14, TEXTS[14])])
    ledger = quality.ledger(table).withColumn("ok", quality.kept()).collect()
    for row in ledger:
        failed = {r.name for r in quality.RULES if row.fail_bits >> r.bit & 1}
        assert ("few_words" in failed) == (row.n_words < 50)
        assert ("repeated_words" in failed) == (100 * row.n_repeat_words > 50 * row.n_words)
        assert row.ok == (not failed & set(quality.POLICIES[quality.CURRENT]))
    clash = table.withColumn("row", F.lit(1)).withColumn("_text", F.lit("x")).withColumn("fail_bits", F.lit(2))
    kept = quality.passing(clash)
    assert kept.columns == clash.columns
    assert sorted(kept.collect(), key=str) == sorted(
        (r for r in clash.collect() if r.text and brute(r.text)["n_words"] >= 50 and r.doc_id in (14, 15, None)
         and 2 * brute(r.text)["n_repeat_words"] <= brute(r.text)["n_words"]), key=str)
    assert quality.passing(clash.limit(0)).count() == 0


def test_ablation_counts_what_one_rule_alone_rejects(docs):
    ledger = quality.ledger(docs(list(enumerate(TEXTS))))
    bits = [r.fail_bits & quality.mask(quality.POLICIES["2024.1"]) for r in ledger.collect()]
    rows = {r.rule: r for r in quality.ablation(ledger, "2024.1").collect()}
    assert set(rows) == set(quality.POLICIES["2024.1"])
    for rule in quality.RULES:
        if rule.name in rows:
            bit = 1 << rule.bit
            row = rows[rule.name]
            assert row.n_failed == sum(bool(b & bit) for b in bits)
            assert row.n_only == sum(b == bit for b in bits)
            assert row.n_kept_without == sum(b & ~bit == 0 for b in bits)
    assert all(r.n_rows == 0 for r in quality.ablation(ledger.limit(0)).collect())


def test_plan_has_no_python(docs):
    plan = quality.ledger(docs([(1, "a")]).select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
