"""The network as a distribution, its gradient, held-out scores, edge cases."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import lm


def test_probabilities_of_all_classes_add_up_to_one():
    flat = lm.start()
    around = np.tile(np.array([[3], [5], [lm.CLASSES], [7]]), lm.CLASSES)
    total = np.exp(lm.log_probabilities(flat, np.arange(lm.CLASSES), around)).sum()
    assert abs(total - 1) < 1e-4


def test_one_step_follows_the_slope():
    rng = np.random.default_rng(0)
    ids, around = rng.integers(0, lm.CLASSES, 64), rng.integers(0, lm.CLASSES, (4, 64))
    flat = lm.start()
    before = lm.log_probabilities(flat, ids, around).sum()
    for _ in range(5):
        lm.train(flat, np.zeros(lm.N_PARAMETERS, np.float32) + 1e-4, ids, around)
    assert lm.log_probabilities(flat, ids, around).sum() > before + 10


def test_windows_stop_at_documents():
    ids, around, counts = lm.windows(["a b c", None, "d", ""])
    assert counts.tolist() == [3, 0, 1, 0] and len(ids) == 4
    out = lm.CLASSES
    assert around[:, 0].tolist() == [out, out, ids[1], ids[2]]
    assert around[:, 2].tolist() == [ids[0], ids[1], out, out]
    assert around[:, 3].tolist() == [out] * 4


def test_held_out_text_scores_above_shuffled_text(docs):
    rng = random.Random(4)
    cycle = [f"word{i}" for i in range(40)]

    def text():
        at = rng.randrange(40)
        return " ".join(cycle[(at + k) % 40] for k in range(400))

    network = lm.fit(docs([(i, text()) for i in range(60)]).repartition(2))
    held = [text() for _ in range(5)]
    rows = [(i, t) for i, t in enumerate(held)] + [(10 + i, " ".join(rng.sample(t.split(), 400))) for i, t in enumerate(held)]
    got = {r.doc_id: r for r in lm.score(docs(rows), network).collect()}
    for i in range(5):
        assert got[i].n_words == 400
        assert got[i].mean_log_prob > got[10 + i].mean_log_prob + 0.5
        assert abs(got[i].log_prob - 400 * got[i].mean_log_prob) < 1e-6


def test_scores_do_not_depend_on_neighbours_and_edge_cases(docs):
    table = docs([(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, None), (3, ""), (4, "x " * 50_000)])
    table = table.withColumn("log_prob", F.lit("clash"))
    network = lm.fit(table)
    rows = lm.score(table, network).collect()
    same = {round(r.log_prob, 9) for r in rows if r.doc_id in (1, None)}
    assert len(rows) == 6 and len(same) == 1
    assert [(r.n_words, r.log_prob, r.mean_log_prob) for r in rows if r.doc_id in (2, 3)] == [(0, 0.0, None)] * 2
    assert (lm.fit(table.limit(0)) == lm.start()).all() and lm.score(table.limit(0), network).count() == 0
