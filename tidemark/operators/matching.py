"""Scoring postings against profiles."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, strip_fences, terms
from ..functions.values import usage_cost
from . import blocks

# Python workers get these functions with the plan and need not find the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

THRESHOLD = 0.70  # fixed value: lowest score that is reported
MAX_MISSING = 8  # fixed value: missing terms listed per match
LEVELS = 4  # parts of a profile's terms, from the rarest to the most frequent, that are joined apart
SEEDS = 4  # profiles of a posting that are scored for its bound
CELL = 256  # postings, and profiles, that a task of ``score_with`` is meant to hold
CALL = 16384  # pairs of one call of a scoring function; a text that it prepares is prepared once a call


def profile_section() -> Column:
    """A profile as request text."""
    head = F.concat(F.lit("--- Resume: "), F.col("filename"), F.lit(" ("), F.col("role_label"), F.lit(") ---\n"))
    return F.concat(head, F.col("content"))


def profile_sections(profiles: DataFrame) -> DataFrame:
    """One row: all profiles as request text in the order of their files, each behind a blank line."""
    section = F.concat(F.lit("\n\n"), profile_section())
    ordered = F.array_sort(F.collect_list(F.struct("filename", section.alias("section"))))
    return profiles.agg(F.array_join(F.transform(ordered, lambda s: s["section"]), "").alias("sections"))


def match_input(postings: DataFrame, profiles: DataFrame, every: bool = False) -> DataFrame:
    """Request text per posting: its whole description, then its best and its second profile, or ``every`` one.

    Two profiles are chosen by shared terms, so requests do not grow with the number of profiles; a
    posting without a term in common with any has its description alone. With ``every`` nothing is chosen: a request holds
    all profiles in the order of their files, whatever they share with the posting. Their text is part of each
    value, so it is made once and attached, and neither side is shuffled; a posting without a description has no request.
    """
    description = F.concat(F.lit("--- Job Description ---\n"), F.col("description"))
    if every:
        return postings.withColumn("request", F.concat(description, profile_sections(profiles).scalar()))
    named = top_two(postings, profiles)
    for side in ("best", "runner_up"):
        sections = profiles.select(F.col("filename").alias(f"{side}_filename"), profile_section().alias(f"_{side}"))
        named = named.join(sections, f"{side}_filename", "left")
    return (
        postings.join(named.select("dedup_key", "_best", "_runner_up"), "dedup_key", "left")
        .withColumn("request", F.concat_ws("\n\n", description, "_best", "_runner_up"))
        .drop("_best", "_runner_up")
    )


def posting_terms(postings: DataFrame) -> DataFrame:
    """(dedup_key, terms) spread by key: the one shuffle of a match, reused where it recurs in a plan.

    Its uses take terms apart with ``explode_outer``: for ``explode`` a filter on the number of terms is put before the
    shuffle, which reads the texts twice and makes another shuffle of it.
    """
    keyed = postings.where(F.col("dedup_key").isNotNull())
    return keyed.select("dedup_key", terms(F.col("description")).alias("terms")).repartition("dedup_key")


def profile_terms(profiles: DataFrame) -> DataFrame:
    return profiles.select("filename", terms(F.col("content")).alias("terms"))


def profile_index(profiles: DataFrame) -> DataFrame:
    """(term, filename, n_terms, rest, level) of all terms of all profiles.

    Terms of a profile are ordered from those of the fewest profiles to those of the most; ``rest`` counts a term
    and those after it. A posting whose rarest common term with a profile has ``rest`` r shares r terms at
    most with it. ``level`` is r / n_terms in ``LEVELS`` steps, the rarest terms standing in the highest.
    """
    wanted = profile_terms(profiles).select("filename", F.explode("terms").alias("term"))
    often = wanted.groupBy("term").agg(F.count("*").alias("n_profiles"))
    ordered = wanted.join(often, "term").groupBy("filename").agg(
        F.array_sort(F.collect_list(F.struct("n_profiles", "term"))).alias("ordered")
    )
    placed = ordered.select("filename", F.size("ordered").alias("n_terms"), F.posexplode("ordered").alias("pos", "at"))
    rest = F.col("n_terms") - F.col("pos")
    return placed.select("filename", "n_terms", F.col("at.term").alias("term"), rest.alias("rest")).withColumn(
        "level", F.expr(f"({LEVELS} * rest + n_terms - 1) div n_terms")
    )


def exact_scores(pairs: DataFrame, offered: DataFrame, profiles: DataFrame) -> DataFrame:
    """Shared terms and score of the pairs (dedup_key, filename); ``offered`` are ``posting_terms``."""
    wanted = profile_terms(profiles).withColumnRenamed("terms", "wanted")
    return (
        pairs.join(offered, "dedup_key")
        .join(wanted, "filename")
        .select(
            "dedup_key", "filename", F.size("wanted").alias("n_terms"),
            F.size(F.array_intersect("terms", "wanted")).cast("bigint").alias("n_shared"),
        )
        .withColumn("score", F.col("n_shared") / F.col("n_terms"))
    )


def _ranked(scores: DataFrame, most: int = 2) -> DataFrame:
    window = Window.partitionBy("dedup_key").orderBy(F.col("score").desc(), "filename")
    return scores.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= most)


def second_bests(offered: DataFrame, index: DataFrame, profiles: DataFrame) -> DataFrame:
    """(dedup_key, n_shared, n_terms) of a profile that scores no better than the second best of a posting.

    Of the ``SEEDS`` profiles that share most of their rarer half of terms with the posting, scored exactly, the second.
    Postings that meet fewer than two profiles this way are missing.
    """
    rare = offered.select("dedup_key", F.explode_outer("terms").alias("term")).join(
        index.where(2 * F.col("level") > LEVELS).select("term", "filename", "n_terms"), "term"
    )
    partial = rare.groupBy("dedup_key", "filename", "n_terms").agg(F.count("*").alias("n"))
    seeds = _ranked(partial.withColumn("score", F.col("n") / F.col("n_terms")), SEEDS).select("dedup_key", "filename")
    return _ranked(exact_scores(seeds, offered, profiles)).where("_rank = 2").select("dedup_key", "n_shared", "n_terms")


def candidates(offered: DataFrame, index: DataFrame, bounds: DataFrame) -> DataFrame:
    """Pairs (dedup_key, filename) that may reach the bound n_shared / n_terms of their posting in ``bounds``.

    For scores that cost more than counting terms, which ``top_two`` does in blocks without this choice.
    A profile that reaches it has a common term with the posting whose ``rest`` reaches it: more frequent terms are
    not joined. Postings without a bound are paired with every profile they share a term with.
    """
    own = offered.join(bounds.select("dedup_key", F.col("n_shared").alias("s"), F.col("n_terms").alias("of")), "dedup_key", "left")
    least = F.expr(f"greatest(1L, coalesce(({LEVELS} * s + of - 1) div of, 1L))")
    own = own.select(
        "dedup_key", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("of", F.lit(1)).alias("of"),
        F.sequence(least, F.lit(LEVELS).cast("bigint")).alias("levels"), F.explode_outer("terms").alias("term"),
    )
    own = own.select("dedup_key", "s", "of", "term", F.explode_outer("levels").alias("level"))
    reached = F.col("rest") * F.col("of") >= F.col("s") * F.col("n_terms")
    return own.join(index, ["term", "level"]).where(reached).select("dedup_key", "filename").distinct()


def top_two(postings: DataFrame, profiles: DataFrame, gaps: bool = False, first: int | None = None) -> DataFrame:
    """Best and second profile of every posting by shared terms, exact.

    Every part of the postings meets every block of profiles (``blocks.meet``) and two rows a posting leave a block.
    ``gaps`` adds the terms that the best profile lacks, in alphabetical order: terms are at hand where profiles are
    compared, and need not be taken from the texts again. With ``first`` only so many of them leave a task. Postings that share no term with any profile have no row.
    """

    def run(part: blocks.Part) -> pa.Table:
        shared = part.shared()
        left = np.where(shared > 0, part.scores(shared), -1.0)
        every, out = np.arange(len(left)), []
        for rank in range(min(2, left.shape[1])):
            at = left.argmax(axis=1)  # the first by name of equal ones
            own = np.flatnonzero(left[every, at] > 0)
            profile = at[own]
            columns = {
                "dedup_key": part.names.take(pa.array(own)), "filename": part.block.names.take(pa.array(profile)),
                "n_terms": pa.array(part.block.n_terms[profile].astype(np.int32)), "n_shared": pa.array(shared[own, profile]),
                "score": pa.array(left[own, profile]),
            }
            if gaps:
                empty = pa.nulls(len(own), pa.list_(pa.string()))
                columns["gaps"] = empty if rank else part.lacking(own, profile, first)
            out.append(pa.table(columns))
            left[every, at] = -1.0
        return pa.concat_tables(out)

    schema = "dedup_key string, filename string, n_terms int, n_shared bigint, score double"
    return best_and_runner_up(blocks.meet(postings, profiles, run, schema + (", gaps array<string>" if gaps else "")))


def posting_x_profile(postings: DataFrame, profiles: DataFrame, least: float = 0.0) -> DataFrame:
    """All pairs (dedup_key, filename) with a common term and a score of ``least`` or more, with their shared terms.

    By default these are all pairs that share anything. Pairs are counted in blocks (``blocks.meet``), and only those
    that reach ``least`` leave a task.
    """

    def run(part: blocks.Part) -> pa.Table:
        shared = part.shared()
        row, profile = np.nonzero((shared > 0) & (part.scores(shared) >= least))
        return pa.table({
            "dedup_key": part.names.take(pa.array(row)), "filename": part.block.names.take(pa.array(profile)),
            "n_shared": pa.array(shared[row, profile]),
        })

    return blocks.meet(postings, profiles, run, "dedup_key string, filename string, n_shared bigint")


def sharing_pairs(postings: DataFrame, profiles: DataFrame) -> DataFrame:
    """Every pair (dedup_key, filename) with a term in common, frequent or rare."""
    return term_scores(postings, profiles).select("dedup_key", "filename")


def term_scores(postings: DataFrame, profiles: DataFrame) -> DataFrame:
    """Share of each profile's terms that a posting has, for all pairs with a term in common.

    An inner join on terms. Terms are spread by posting first, so that counting and ranking need
    no shuffle of (posting, profile) pairs. Spark broadcasts the profile terms while they are
    below its size limit; above it both sides shuffle by term, and a frequent term is split by
    adaptive skew handling.
    """
    wanted = profile_terms(profiles).select(
        "filename", F.size("terms").alias("n_terms"), F.explode("terms").alias("term")
    )
    offered = posting_terms(postings).select("dedup_key", F.explode_outer("terms").alias("term"))
    return (
        offered.join(wanted, "term")
        .groupBy("dedup_key", "filename", "n_terms")
        .agg(F.count("*").alias("n_shared"))
        .withColumn("score", F.col("n_shared") / F.col("n_terms"))
    )


def best_and_runner_up(scores: DataFrame) -> DataFrame:
    """Two best profiles per posting side by side; ties go to the first file name."""
    top = _ranked(scores)

    def at(rank: int, column: str) -> Column:
        return F.max(F.when(F.col("_rank") == rank, F.col(column)))

    found = [
        at(1, "filename").alias("best_filename"),
        at(1, "score").alias("best_score"),
        at(1, "n_shared").alias("n_shared"),
        at(1, "n_terms").alias("n_terms"),
        at(2, "filename").alias("runner_up_filename"),
        at(2, "score").alias("runner_up_score"),
    ]
    if "gaps" in scores.columns:
        found.append(F.array_sort(at(1, "gaps")).alias("missing_keywords"))
    return top.groupBy("dedup_key").agg(*found)


def missing_keywords(posting_terms: Column, best_terms: Column) -> Column:
    """Posting terms the profile lacks, in alphabetical order."""
    return F.array_sort(F.array_except(posting_terms, best_terms))


def missing_top8(gaps: Column) -> Column:
    return F.slice(F.array_sort(gaps), 1, MAX_MISSING)


def match_scores(postings: DataFrame, profiles: DataFrame, gaps: bool = False, first: int | None = None) -> DataFrame:
    """Lexical match: what the store and the threshold need, with ``gaps`` also the missing terms of all postings, or the ``first``."""
    return top_two(postings, profiles, gaps, first).withColumn(
        "match_reason",
        F.format_string("shares %d of %d profile terms", "n_shared", "n_terms"),
    ).drop("n_shared", "n_terms")


def with_gaps(
    matches: DataFrame, postings: DataFrame, profiles: DataFrame, top8: bool = False
) -> DataFrame:
    """Add the missing terms, or the first of them; meant for reported matches, after the threshold."""
    best = profile_terms(profiles).select(
        F.col("filename").alias("best_filename"), F.col("terms").alias("best_terms")
    )
    gaps = missing_keywords(F.col("terms"), F.col("best_terms"))
    return (
        posting_terms(postings)
        .join(matches, "dedup_key")
        .join(best, "best_filename")
        .withColumn("missing_keywords", missing_top8(gaps) if top8 else gaps)
        .drop("terms", "best_terms")
    )


def with_labels(matches: DataFrame, profiles: DataFrame) -> DataFrame:
    labels = profiles.select("filename", "role_label")

    def named(side: str) -> DataFrame:
        return labels.select(
            F.col("filename").alias(f"{side}_filename"), F.col("role_label").alias(f"{side}_label")
        )

    return matches.join(named("best"), "best_filename", "left").join(
        named("runner_up"), "runner_up_filename", "left"
    )


def lexical_match(postings: DataFrame, profiles: DataFrame) -> DataFrame:
    """Best profile, runner-up, scores and missing terms for every posting."""
    return with_labels(match_scores(postings, profiles, gaps=True), profiles)


def match_threshold(matches: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Keep results at or above the threshold; no result is dropped as well."""
    return matches.filter(F.col("best_score") >= threshold)


def parse_match(replies: DataFrame, keep_tokens: bool = False) -> DataFrame:
    """Reply text to match fields; an unreadable reply gives NULLs.

    A missing score counts as 0. A null or non-numeric score cannot be used: the row is flagged
    ``bad_score`` and only that row loses its result.
    """
    wrapped = F.concat(F.lit("["), strip_fences(F.col("text")), F.lit("]"))
    parsed = F.from_json(wrapped, "array<map<string,string>>", {"allowSingleQuotes": "false"})
    dropped = ("text",) if keep_tokens else ("text", "input_tokens", "output_tokens")
    keep = [c for c in replies.columns if c not in dropped]
    reply = F.col("reply")
    has_score = F.map_contains_key(reply, "best_score")
    score = F.when(has_score, reply["best_score"].try_cast("double")).when(
        reply.isNotNull(), F.lit(0.0)
    )

    def or_default(name: str, default: Column) -> Column:
        return F.when(F.map_contains_key(reply, name), reply[name]).when(reply.isNotNull(), default)

    return replies.select(
        *keep, let(parsed, lambda a: F.when(F.size(a) == 1, F.element_at(a, 1))).alias("reply")
    ).select(
        *keep,
        or_default("best_resume_filename", F.lit("")).alias("best_filename"),
        score.alias("best_score"),
        or_default("match_reason", F.lit("")).alias("match_reason"),
        F.from_json(or_default("missing_keywords", F.lit("[]")), "array<string>").alias(
            "missing_keywords"
        ),
        F.nullif(reply["runner_up_filename"], F.lit("")).alias("runner_up_filename"),
        reply["runner_up_score"].try_cast("double").alias("runner_up_score"),
        (reply.isNotNull() & score.isNull()).alias("bad_score"),
    )


def resolve_scores(scores: DataFrame, profiles: DataFrame) -> DataFrame:
    """Attach profile labels; an unknown best profile leaves the row without a score, an unknown
    runner-up loses its name only."""
    known = F.col("best_label").isNotNull()
    second = F.col("runner_up_label").isNotNull()
    return with_labels(scores, profiles).withColumns(
        {
            "best_filename": F.when(known, F.col("best_filename")),
            "best_score": F.when(known, F.col("best_score")),
            "runner_up_filename": F.when(second, F.col("runner_up_filename")),
        }
    )


def resolve_profile(parsed: DataFrame, profiles: DataFrame) -> DataFrame:
    """Replies with their profiles; those without a known best one have no result."""
    return resolve_scores(parsed, profiles).filter(F.col("best_label").isNotNull())


def reply_scores(replies: DataFrame) -> DataFrame:
    """Match replies as scores of a run, one a key, with its cost; unreadable ones are paid as well.

    Of several replies to a key the readable one of the highest score counts, of equal ones the first
    by profile name and reason; the cost is that of all of them.
    """
    paid = usage_cost("match", F.col("input_tokens"), F.col("output_tokens"))
    parsed = parse_match(replies, keep_tokens=True).withColumn("cost_usd", paid)
    key = Window.partitionBy("dedup_key")
    best = key.orderBy(F.col("best_score").desc_nulls_last(), "best_filename", "match_reason", "runner_up_filename")
    return (
        parsed.withColumns({"cost_usd": F.sum("cost_usd").over(key), "unreadable": F.col("best_filename").isNull()})
        .withColumn("_rank", F.row_number().over(best))
        .where("_rank = 1")
        .drop("_rank", "input_tokens", "output_tokens")
    )


def _tried(fn: Callable[[pd.DataFrame], pd.Series], batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Scores of a batch; one that fails is halved until the failing rows are found."""
    try:
        found = fn(batch)
        if len(found) != len(batch):
            raise ValueError("one score per row expected")
        score = pd.Series(found).astype("float64").to_numpy()
        yield batch[["dedup_key", "filename"]].assign(score=score, error=None)
    except Exception as error:
        if len(batch) == 1:
            yield batch[["dedup_key", "filename"]].assign(score=float("nan"), error=f"{type(error).__name__}: {error}")
        else:
            half = len(batch) // 2
            yield from _tried(fn, batch.iloc[:half])
            yield from _tried(fn, batch.iloc[half:])


def term_overlap(batch: pd.DataFrame) -> pd.Series:
    """Share of a profile's words that a posting has, a function for ``score_with``.

    A text is read once a call, and a posting is held against all profiles of the call at once through the words they share.
    """

    def distinct(name: str, text: str) -> tuple[np.ndarray, list[set[bytes]]]:
        codes = pd.factorize(batch[name])[0]
        first = np.unique(codes, return_index=True)[1]
        return codes, [blocks.term_set(t) for t in batch[text].to_numpy(object)[first]]

    (posting, offered), (profile, wanted) = distinct("dedup_key", "description"), distinct("filename", "content")
    owners: dict[bytes, list[int]] = {}
    for i, own in enumerate(wanted):
        for word in own:
            owners.setdefault(word, []).append(i)
    known, at = frozenset(owners), {word: np.array(own) for word, own in owners.items()}
    shared = np.zeros((len(offered), len(wanted)), np.int32)
    for row, own in zip(shared, offered):
        if met := [at[word] for word in own & known]:
            row[:] = np.bincount(np.concatenate(met), minlength=len(wanted))
    return pd.Series(shared[posting, profile] / np.array([len(own) for own in wanted])[profile])


def _cells(chosen: DataFrame, postings: DataFrame, profiles: DataFrame) -> DataFrame:
    """Rows (p, f, dedup_key, filename, filenames, text) of every cell: its postings with the profiles they are
    paired with, and these profiles, each text once."""
    by_cell = chosen.groupBy("p", "f", "dedup_key").agg(F.collect_list("filename").alias("filenames"))
    texts = postings.select("dedup_key", F.col("description").alias("text"))
    held = by_cell.join(texts, "dedup_key").select("p", "f", "dedup_key", F.lit(None).cast("string").alias("filename"), "filenames", "text")
    needed = chosen.select("p", "f", "filename").distinct()
    contents = profiles.select("filename", F.col("content").alias("text"))
    known = needed.join(contents, "filename").select(
        "p", "f", F.lit(None).cast("string").alias("dedup_key"), "filename", F.lit(None).cast("array<string>").alias("filenames"), "text"
    )
    return held.union(known)


def score_with(
    postings: DataFrame,
    profiles: DataFrame,
    fn: Callable[[pd.DataFrame], pd.Series],
    pairs: DataFrame | None = None,
    cell: int = CELL,
) -> DataFrame:
    """Best and second profile of every posting by a caller's function over pairs.

    ``fn(batch)`` returns a score per row of (dedup_key, filename, description, content). Pairs (dedup_key, filename) are
    given by the caller; without them they are all those with a term in common (as ``sharing_pairs`` has them): nothing is
    known about ``fn``, so none of them can be ruled out before it has a score.

    A block join: a task holds the profiles of one block of about ``cell``, and postings come past in batches
    (``blocks.meet``), so that pairs without ``pairs`` are found where they are scored. Given pairs are dealt into blocks of
    both sides by hashes of their names, each text once in a block however many pairs it is in. Two rows a
    posting leave a task. When a call fails, its rows are halved until the failing ones are found; these have
    no score, and ``error`` tells why, the first one of a posting by profile name. A posting without a score
    has a row without profiles.
    """

    def best(own: Iterator[pd.DataFrame], posting: np.ndarray, profile: np.ndarray, keys: pa.Array, names: pa.Array) -> pa.Table:
        """Two best pairs and the first failed one of every posting; ``own`` are the pairs in calls of ``fn``."""
        tried = [part for batch in own for part in _tried(fn, batch)]
        score = np.concatenate([np.empty(0), *(part["score"].to_numpy() for part in tried)])
        error = np.concatenate([np.empty(0, object), *(part["error"].to_numpy(object) for part in tried)])
        order = np.lexsort((profile, -score, posting))
        ranks = np.arange(len(order))
        first = np.diff(posting[order], prepend=-1) != 0
        ranks -= np.maximum.accumulate(np.where(first, ranks, 0))
        kept = order[(ranks < 2) & ~np.isnan(score[order])]
        failed = np.flatnonzero(pd.notna(error))
        failed = failed[np.lexsort((profile[failed], posting[failed]))]
        failed = failed[np.diff(posting[failed], prepend=-1) != 0]
        at = np.concatenate([kept, failed])
        columns = [keys.take(pa.array(posting[at])), names.take(pa.array(profile[at])), pa.array(score[at], from_pandas=True), pa.array(error[at], pa.string(), from_pandas=True)]
        return pa.table(columns, ["dedup_key", "filename", "score", "error"])

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pandas()
        known = rows[rows["filename"].notna()].set_index("filename")["text"]
        own = rows[rows["dedup_key"].notna()].sort_values("dedup_key")
        own = own[["dedup_key", "text", "filenames"]].explode("filenames").rename(columns={"text": "description", "filenames": "filename"})
        own = own[own["filename"].isin(known.index)]
        own["content"] = known.reindex(own["filename"]).to_numpy()
        own = own[["dedup_key", "filename", "description", "content"]].reset_index(drop=True)
        calls = (own.iloc[at : at + CALL].reset_index(drop=True) for at in range(0, len(own), CALL))
        (posting, keys), (profile, names) = (pd.factorize(own[c], sort=True) for c in ("dedup_key", "filename"))
        return best(calls, posting, profile, pa.array(keys, pa.string()), pa.array(names, pa.string()))

    def run_part(part: blocks.Part) -> pa.Table:
        posting, profile = np.nonzero(part.shared())
        keys, texts, names, contents = (
            column.to_pandas().to_numpy(object) for column in (part.names, part.texts, part.block.names, part.block.texts)
        )

        def calls() -> Iterator[pd.DataFrame]:
            for at in range(0, len(posting), CALL):
                p, f = posting[at : at + CALL], profile[at : at + CALL]
                yield pd.DataFrame({"dedup_key": keys[p], "filename": names[f], "description": texts[p], "content": contents[f]})

        return best(calls(), posting, profile, part.names, part.block.names)

    schema = "dedup_key string, filename string, score double, error string"
    if pairs is None:
        found = blocks.meet(postings, profiles, run_part, schema, most=cell)
    else:
        chosen = pairs.select("dedup_key", "filename").distinct()
        for name, column, table in (("p", "dedup_key", postings), ("f", "filename", profiles)):
            dealt = F.greatest(F.lit(1), F.ceil(table.agg(F.count("*")).scalar() / cell))
            chosen = chosen.withColumn(name, F.pmod(F.xxhash64(column), dealt))
        found = _cells(chosen, postings, profiles).groupBy("p", "f").applyInArrow(run, schema)
    window = Window.partitionBy("dedup_key").orderBy(F.col("score").desc_nulls_last(), "filename")
    ranked = found.withColumn("_rank", F.when(F.col("score").isNotNull(), F.row_number().over(window)))

    def at(rank: int, column: str) -> Column:
        return F.max(F.when(F.col("_rank") == rank, F.col(column)))

    top = ranked.groupBy("dedup_key").agg(
        at(1, "filename").alias("best_filename"), at(1, "score").alias("best_score"),
        at(2, "filename").alias("runner_up_filename"), at(2, "score").alias("runner_up_score"),
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("filename"))).alias("error"),
    )
    return postings.select("dedup_key").join(top, "dedup_key", "left")
