"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger stores the measurements and one bit per failed
rule; a policy is a named, versioned mask over those bits, so that changing a policy, comparing two,
or asking what a rule alone rejects never reads a text again.

Edge cases: a missing or empty text has no words and measures 0 everywhere, so it fails ``few_words``.
A missing ``doc_id`` and repeated rows are kept as they are, one ledger row for each input row. Other
columns of the input play no part. An empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import SPACE, text_of, words_of


@dataclass(frozen=True)
class Rule:
    """A rule that a document fails where ``fails`` (SQL over the measurements) is true."""

    bit: int
    name: str
    fails: str


#: Bits are never reused: a rule that changes gets a new bit, and old ledgers stay readable.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 20 * n_words"),
    Rule(3, "repeated_lines", "100 * n_dup_lines > 40 * n_lines"),
    Rule(4, "short_words", "10 * word_chars < 20 * n_words"),
    Rule(5, "long_words", "word_chars > 20 * n_words"),
    Rule(6, "shouting", "100 * n_shouts > 30 * n_words"),
)

BASE = ("few_words", "repeated_words")
POLICIES = {
    "base": BASE,
    "2024.1": (*BASE, "symbols", "repeated_lines"),
    "2024.2": tuple(rule.name for rule in RULES),
}
CURRENT = "2024.2"


MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_shouts", "n_lines", "n_dup_lines", "n_repeat_words",
)


def mask(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    bits = {rule.name: 1 << rule.bit for rule in rules}
    return sum(bits[name] for name in set(names))


def _covered(ordered: Column) -> Column:
    """Words inside a window that occurs at least twice; ``ordered``: (window, start) in order.

    Neighbours that agree are repeats. Each start covers three words, less what was covered before.
    """

    def repeated(window: Column, i: Column) -> Column:
        before, after = F.get(ordered, i - 1)["h"], F.get(ordered, i + 1)["h"]
        return F.coalesce(before == window["h"], F.lit(False)) | F.coalesce(after == window["h"], F.lit(False))

    starts = F.sort_array(F.transform(F.filter(ordered, repeated), lambda w: w["i"]))
    return F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda at, s: F.struct(
            (at["n"] + s + 3 - F.greatest(s, at["end"])).alias("n"), (s + 3).alias("end")
        ),
        lambda at: at["n"],
    )


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and the measurements of every whole text, as long."""
    text = F.col("_text")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(SPACE.replace("[", "[^")))
    window = lambda i: F.xxhash64(*[F.get(F.col("_words"), i + k) for k in range(3)])
    windows = F.when(
        F.size("_words") >= 3, F.transform(F.sequence(F.lit(0), F.size("_words") - 3), window)
    ).otherwise(F.array().cast("array<bigint>"))
    return (
        docs.select(F.col(id_col), text_of(text_col).alias("_text"))
        .select(id_col, "_text", words_of(text).alias("_words"), lines.alias("_lines"))
        .select(
            id_col,
            F.size("_words").alias("n_words"),
            F.length(F.array_join("_words", "")).alias("word_chars"),
            F.regexp_count(text, F.lit("[#*$%&|<>]")).alias("n_symbols"),
            F.regexp_count(text, F.lit("[A-Z]{4}")).alias("n_shouts"),
            F.size("_lines").alias("n_lines"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
            windows.alias("_windows"),
        )
        .withColumn(
            "_ordered",  # only where a window repeats at all
            F.when(
                F.size(F.array_distinct("_windows")) < F.size("_windows"),
                F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            ),
        )
        .withColumn("n_repeat_words", F.coalesce(_covered(F.col("_ordered")), F.lit(0)))
        .select(
            id_col,
            *[F.col(c).cast("long").alias(c) for c in MEASURES],
        )
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measurements and ``fail_bits`` (long): bit ``rule.bit`` is set where the rule fails."""
    bits = F.lit(0).cast("long")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(0).cast("long"))
    return measure(docs, id_col, text_col).withColumn("fail_bits", bits)


def kept(policy: str = CURRENT, fail_bits: str = "fail_bits") -> Column:
    """Whether a ledger row passes a policy."""
    return F.col(fail_bits).bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablation(rows: DataFrame, policy: str = CURRENT, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of a policy: rows it fails, rows it alone rejects, rows kept with and without it.

    Rows are first counted by bit pattern, so that only a handful of patterns is combined with the rules.
    """
    names = POLICIES[policy]
    whole = mask(names, rules)
    counts = rows.groupBy((F.col("fail_bits").bitwiseAND(F.lit(whole))).alias("bits")).agg(F.count("*").alias("n"))
    sums = [F.sum("n").alias("n_rows"), F.sum(F.when(F.col("bits") == 0, F.col("n")).otherwise(0)).alias("n_kept")]
    parts = []
    for rule in (r for r in rules if r.name in names):
        bit = F.lit(1 << rule.bit).cast("long")
        fails = F.sum(F.when(F.col("bits").bitwiseAND(bit) != 0, F.col("n")).otherwise(0))
        alone = F.sum(F.when(F.col("bits") == bit, F.col("n")).otherwise(0))
        parts.append(F.struct(F.lit(rule.name).alias("rule"), fails.alias("n_failed"), alone.alias("n_only")))
    return (
        counts.agg(*sums, F.array(*parts).alias("rules"))
        .select("n_rows", "n_kept", F.explode("rules").alias("r"))
        .select(
            F.lit(policy).alias("policy"), "r.rule", F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
            F.coalesce("r.n_failed", F.lit(0)).alias("n_failed"), F.coalesce("r.n_only", F.lit(0)).alias("n_only"),
            F.coalesce("n_kept", F.lit(0)).alias("n_kept"),
            F.coalesce(F.col("n_kept") + F.col("r.n_only"), F.lit(0)).alias("n_kept_without"),
        )
    )


def passing(docs: DataFrame, policy: str = CURRENT, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass a policy, with all their columns and no others.

    The ledger runs beside the row as one struct, so no join brings the decision back to the text.
    """
    at = docs.columns.index(text_col)
    whole = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))]).select(
        F.struct("*").alias("row"), F.col(f"_{at}").alias("text")
    )
    # a filter on a numbered row is not pushed below the measurements, where it would repeat them
    good = ledger(whole, "row", "text").withColumn("at", F.monotonically_increasing_id())
    good = good.where(kept(policy) & (F.col("at") >= 0))
    return good.select(*[F.col(f"row._{i}").alias(name) for i, name in enumerate(docs.columns)])
