"""Ids against the library, the best segmentation against a plain loop, round trips, edge cases."""

import random

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from tidemark.llm import pieces

PATH = str(public_tokenizers.path("piece_bpe_32k.model"))
TEXTS = [
    "", " ", "  a", "a  ", "Hello  world.\nNew line\t\x00", "héllo 漢字😀 x", "the of and in it", "a" * 300, " ".join("qz" * 40 for _ in range(3)),
    "\n\n", "don't stop!! (now) 3.14", "öäüß çéè ñ", "   ", "x" * 70 + "th" * 30 + " " * 20 + "y",
]


def some(n, seed=3):
    rng = random.Random(seed)
    syllables = ["th", "er", "on", "an", "re", "ing", "é", "ö", "ß", "1", "Q", "ion", ",", ".", "\n"]
    return [" ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def best_score(model, word):
    best = [0.0] + [float("-inf")] * len(word)
    for end in range(1, len(word) + 1):
        for begin in range(max(0, end - model.longest), end):
            piece = model.by_text.get(word[begin:end])
            score = model.scores[piece] if piece is not None else model.unknown_score if end - begin == 1 else float("-inf")
            best[end] = max(best[end], best[begin] + score)
    return best[-1]


def test_merges_give_the_ids_of_the_library():
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    coder = pieces.Encoder(PATH)
    texts = TEXTS + some(300)
    for text, ids in zip(texts, coder.encode(texts)):
        assert ids.tolist() == library.encode(text), text


def test_long_words_merge_alike():
    model = pieces.Model(PATH)
    for word in ["▁" + "".join(w.split()) for w in some(60, 8)]:
        if word != "▁":
            assert model._merge_long(word) == model._merge(model._by_start([word]))[0].tolist()


def plain_viterbi(model, word):
    """Pieces of the best segmentation, of equals the one that takes the longest last piece."""
    best, back = [0.0] + [float("-inf")] * len(word), [0] * (len(word) + 1)
    for end in range(1, len(word) + 1):
        for begin in range(max(0, end - model.longest), end):
            piece = model.by_text.get(word[begin:end])
            score = model.scores[piece] if piece is not None else model.unknown_score if end - begin == 1 else float("-inf")
            if best[begin] + score > best[end]:
                best[end], back[end] = best[begin] + score, begin
    ids, end = [], len(word)
    while end:
        piece = model.by_text.get(word[back[end] : end])
        ids = ([piece] if piece is not None else [model.byte_ids[b] for b in word[back[end] : end].encode()]) + ids
        end = back[end]
    return ids


def test_both_ways_at_once_give_the_ids_of_each(spark):
    model, both = pieces.Model(PATH), pieces.Encoder(PATH, "both")
    texts = TEXTS + some(80, 9)
    viterbi, merged = both.encode_ways(texts)
    assert [x.tolist() for x in merged] == [x.tolist() for x in pieces.Encoder(PATH, "merge").encode(texts)]
    for text, ids in zip(texts, viterbi):
        words = both.cut.findall("▁" + text.replace(" ", "▁")) if text else []
        assert ids.tolist() == [i for w in words for i in plain_viterbi(model, w)], text
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "ids long, text string")
    rows = pieces.encode_and_check(df, PATH).collect()
    assert all(r.round_trip for r in rows) and rows[0].asDict().keys() == {"ids", "text", "_ids", "merged", "round_trip"}


def test_remembered_words_are_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_BYTES", 3000)
    coder = pieces.Encoder(PATH, "both")
    want = pieces.Encoder(PATH).encode(some(50, 10))
    for _ in range(2):
        for text, ids in zip(some(50, 10), want):
            assert coder.encode_ways([text])[1][0].tolist() == ids.tolist()
            assert coder.held < 3000 + 100 * 400


def test_a_worker_of_one_way_remembers_little(monkeypatch):
    import tracemalloc

    coder = pieces.Encoder(PATH)
    monkeypatch.setattr(coder.model, "encode_words", lambda words, how: [[w.encode()[-12:].rjust(12) for w in words]])
    tracemalloc.start()
    try:
        for at in range(0, 1_000_000, 20_000):
            coder.encode([" ".join(f"word{i}" for i in range(at, at + 20_000))])
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 96 << 20


def test_viterbi_finds_the_highest_score(monkeypatch):
    model = pieces.Model(PATH)
    words = sorted({"▁" + w for t in some(60, 5) for w in t.split(" ") if w} | {"▁", "▁▁▁", "zq", "漢字" * 9})
    for cells in (2_000_000, 64):  # in one table, and in parts of a few positions
        monkeypatch.setattr(pieces, "_CELLS", cells)
        for word, ids in zip(words, model.encode_words(words, "viterbi")[0]):
            assert b"".join(model.raw[i] for i in np.frombuffer(ids, "<i4")).decode() == word
            raw = model._viterbi([word])[0].tolist()
            total = sum(model.scores[i] if i >= 0 else model.unknown_score for i in raw)
            assert total == best_score(model, word), word


def test_round_trip_both_ways():
    texts = TEXTS + some(200, 6)
    for how in ("merge", "viterbi"):
        coder = pieces.Encoder(PATH, how)
        assert [coder.model.decode(i.tolist()) for i in coder.encode(texts)] == texts


def test_table_and_edge_cases(docs):
    rows = [*enumerate(TEXTS), (None, "a b"), (6, TEXTS[6]), (99, None), (100, "ab " * 60_000), (101, "x▁y")]
    table = docs(rows).withColumn("IDS", F.lit("clash")).withColumn("made", F.lit(1))
    coded = pieces.encode(table, PATH)
    assert coded.columns == [*table.columns, "_ids"]
    back = pieces.decode(coded, PATH, ids_col="_ids")
    got = back.collect()
    assert len(got) == len(rows) and all(r["decoded"] == (r.text or "").replace("▁", " ") for r in got)
    assert [list(r["_ids"]) for r in got if r.doc_id == 99] == [[]]
    assert pieces.decode(pieces.encode(table.limit(0), PATH), PATH, ids_col="_ids").count() == 0
