"""Recurring lines and templates, what stays, and the defined edge cases."""

from pyspark.sql import functions as F

from tidemark.llm import templates

LONG = "this passage is long enough to be read as one line of a log"


def dropped(df):
    out = templates.drop_lines(df, counts=True)
    return {r.doc_id: (r.text, r.n_dropped) for r in out.collect()}


def test_first_of_a_recurring_line_stays(docs):
    got = dropped(docs([(1, f"alpha\n{LONG}\nbeta"), (2, f"{LONG}\ngamma"), (3, f"x\n{LONG}\n{LONG}"), (4, "y\ndelta")]))
    assert got == {1: (f"alpha\n{LONG}\nbeta", 0), 2: ("gamma", 1), 3: ("x", 2), 4: ("y\ndelta", 0)}


def test_repeats_inside_one_document_stay(docs):
    rows = [(1, f"{LONG}\n{LONG}\nread more"), (2, "read on\n" + LONG.upper()), (3, "read")]
    assert {k: v[1] for k, v in dropped(docs(rows)).items()} == {1: 0, 2: 0, 3: 0}


def test_short_lines_recur_as_they_stand(docs):
    license_ = "Licensed under the Apache License, Version 2.0."
    rows = [(i, f"text of its own {i}\n{license_}") for i in range(20)] + [(30, "licensed  under\nother words"), (31, "Version 3.0\nlast"), (32, "Version 4.0")]
    got = dropped(docs(rows))
    assert got[0] == (f"text of its own 0\n{license_}", 0) and all(got[i] == (f"text of its own {i}", 1) for i in range(1, 20))
    assert got[30][1] == got[31][1] == got[32][1] == 0


def test_rows_that_repeat_an_id_keep_their_own_lines(docs):
    rows = [(7, f"a first line that stands nowhere else in all the table\n{LONG}"), (7, f"{LONG}\nsecond"), (7, f"{LONG}\nsecond"), (9, LONG)]
    out = sorted((r.text, r.n_dropped) for r in templates.drop_lines(docs(rows), counts=True).collect())
    kept = [t for t, _ in out]
    assert kept.count("second") in (0, 2) and any(t.startswith("a first line") for t in kept) and "" in kept
    assert sum(LONG in t for t in kept) in (1, 2)  # of equal rows both keep the line or neither


def brute(rows):
    """Lines that stay, by a plain reading of the rules over one task."""
    import re
    from collections import Counter

    lines = []  # (doc, line number, key of its leaf, words)
    for doc, text in enumerate(rows):
        for k, one in enumerate((text or "").split("\n")):
            words = one.split()
            if words:
                masks = ["<*>" if re.search(r"[0-9@]|://", w) else w for w in words]
                long = len(words) >= 8
                lines.append((doc, k, (len(words), *masks[:2]) if long else ("short", *words), tuple(masks) if long else tuple(words)))
    docs_of, count = {}, Counter()
    for doc, _, leaf, words in lines:
        for place, word in enumerate(words):
            docs_of.setdefault((leaf, place, word), set()).add(doc)
            count[leaf, place, word] += 1
    groups = {}
    for doc, k, leaf, words in lines:
        need = (75 * len(words) + 99) // 100
        constant = [(-count[leaf, p, w], p, w) for p, w in enumerate(words) if len(docs_of[leaf, p, w]) > 1]
        ranked = sorted(constant)
        general = leaf[0] != "short" and len(constant) >= need
        groups.setdefault((leaf, frozenset(c[1:] for c in ranked[:need])) if general else (leaf, words), []).append((doc, k))
    gone = {place for own in groups.values() if len({d for d, _ in own}) > 1 for place in sorted(own)[1:]}
    return ["\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone) if t and any(g[0] == d for g in gone) else t for d, t in enumerate(rows)]


def test_equals_a_plain_tree(docs):
    import random

    rng = random.Random(3)
    names = [f"name{chr(97 + i)}" for i in range(20)]
    shapes = [
        lambda: f"posted by {rng.choice(names)} on 2024-01-{rng.randrange(1, 28):02d} with several comments so far today",
        lambda: f"posted by the editors on 2024-01-{rng.randrange(1, 28):02d} with several comments so far today",
        lambda: f"share this article with {rng.choice(names)} or with all of your other friends right now please",
        lambda: " ".join(rng.choice(names) for _ in range(rng.randrange(8, 12))),
        lambda: rng.choice(("read more", "Version 2.0", "all rights reserved", "home", "", "  ")),
        lambda: " ".join(f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(12)),
    ]
    rows = ["\n".join(rng.choice(shapes)() for _ in range(rng.randrange(1, 7))) for _ in range(60)] + [None, ""]
    got = {r.doc_id: r.text for r in templates.drop_lines(docs(list(enumerate(rows)))).collect()}
    assert [got[i] for i in range(len(rows))] == brute(rows)


def test_variable_words_are_generalised(docs):
    line = "posted by {} on 2024-01-{:02d} at https://x.org/{} with 12 comments so far today"
    people = ["anna", "boris", "carla", "dmitri"]
    rows = [(i, f"own text {i}\n" + line.format(p, i + 1, p)) for i, p in enumerate(people)]
    rows.append((9, "posted by nobody here because quite another line of that length was wanted now ok"))
    got = dropped(docs(rows))
    assert got[0][1] == 0 and all(got[i] == (f"own text {i}", 1) for i in (1, 2, 3)) and got[9][1] == 0


def test_values_that_recur_stay_variable(docs):
    line = "posted by {} from {} on 2024-01-02 at https://x.org with 12 comments so far today"
    people, cities = ["anna", "boris", "carla", "dmitri"], ["oslo", "paris", "rome"]
    rows = [(i, f"own text {i}\n" + line.format(people[i % 4], cities[i % 3])) for i in range(48)]
    rows += [(100, line.format("newcomer", "lima")), (101, line.format("anna", "lima"))]
    got = dropped(docs(rows))
    assert got[0][1] == 0 and all(n == 1 for i, (_, n) in got.items() if i)


def test_lines_that_share_too_little_stay(docs):
    rows = [(i, "the same start then " + " ".join(f"w{chr(97 + i)}{chr(97 + k)}" for k in range(9))) for i in range(6)]
    assert all(n == 0 for _, n in dropped(docs(rows)).values())


def test_edge_cases_and_clashing_names(docs):
    rows = [(None, LONG), (None, LONG), (1, None), (2, ""), (3, LONG), (3, LONG), (4, "\n\n")]
    table = docs(rows).withColumn("DROPS", F.lit("d")).withColumn("n_lines", F.lit("k")).withColumn("id", F.lit(5))
    out = templates.drop_lines(table)
    assert out.columns == table.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, table.collect()), key=str)
    assert templates.drop_lines(table, counts=True).columns[-2:] == ["_n_lines", "n_dropped"]
    assert templates.drop_lines(table.limit(0)).count() == 0


def test_a_hot_line_and_a_very_long_text(docs):
    rows = [(i, f"{LONG}\nown {i}") for i in range(500)] + [(1000, "\n".join(f"{LONG} {chr(97 + i % 26)} {i}" for i in range(3000)))]
    got = dropped(docs(rows))
    assert sum(n for k, (_, n) in got.items() if k < 1000) == 499 and got[0][1] == 0


def test_lines_without_enough_constants_go_before_the_join(spark):
    """Three of nine words agree in line 1, seven in line 2: only the keys of line 2 are joined with their counts."""
    keys = [(i * 0x9E3779B97F4A7C15) % 2**64 - 2**63 for i in range(1, 19)]
    worded = spark.createDataFrame([(1, keys[:9]), (2, keys[9:])], "line long, keys array<long>")
    agreed = spark.createDataFrame([(k,) for k in keys[:3] + keys[11:]], "key long")
    (bits,) = templates._bitmaps(agreed, templates.KEY_BITS, "true")
    got = templates._placed(worded, bits).collect()
    assert [(r["line"], r["most"], r["keys"]) for r in got] == [(2, 7, keys[11:])]


def test_words_are_counted_where_they_are_read(spark):
    """Documents and occurrences travel with a line's words: no table of all distinct lines is joined for them."""
    line = "a line of nine words that stands here twice"
    table = spark.createDataFrame([(1, 5, f"{line}\n{line}"), (2, -7, line), (None, 9, line)], "id long, doc long, text string")
    got = templates._worded(table.coalesce(1), b"\xff" * ((1 << templates.LEAF_BITS) // 8)).collect()
    assert [(r.low, r.high, r.often, len(r["keys"])) for r in got] == [(-7, 5, 3, 9)]


def test_a_text_is_taken_apart_once(docs):
    """Cutting takes time in proportion to a text, however many lines it has."""
    out = templates.drop_lines(docs([(1, LONG), (2, f"{LONG}\nbeta")]))
    assert "lambdafunction(split(" not in out._jdf.queryExecution().optimizedPlan().toString()
