"""Every stage against a plain version on its own input, the whole run, and the defined edge cases."""

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm.tables import read
from tidemark.sources.staging import stage

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    out = [read(spark, SF, "documents")]
    for name, step in corpus_pipeline.STAGES:
        out.append(stage(step(spark, out[-1], SF), name))
    return out


def test_stages_keep_the_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "line_dedup", "near_duplicates", "benchmark_decontamination", "piece_ids"
    ]
    for table in steps[1:-1]:
        assert table.columns == steps[0].columns and table.count() > 0


def test_quality_and_decontamination_decide_as_the_rules_do(spark, steps):
    from test_decontaminate import brute as hits
    from test_quality import brute as measures

    for r in steps[0].collect():
        m = measures(r.text)
        bad = (
            m["n_words"] < 50 or 2 * m["n_repeat_words"] > m["n_words"] or 5 * m["n_symbols"] > m["n_words"]
            or 5 * m["n_dup_lines"] > 2 * m["n_lines"] or 100 * m["n_shouts"] > 30 * m["n_words"]
            or not 2 <= m["word_chars"] / max(1, m["n_words"]) <= 20
        )
        assert bad == (steps[1].where(F.col("doc_id") == r.doc_id).count() == 0) if r.doc_id % 20 == 0 else True
    items = [tuple(r) for r in read(spark, SF, "benchmark").select("item_id", "text").collect()]
    kept = {r.doc_id for r in steps[4].collect()}
    assert kept == {r.doc_id for r in steps[3].collect() if not hits(r.text, items)[3]}


def test_line_dedup_leaves_one_of_each_line(steps):
    before = {r.doc_id: r.text.split("\n") for r in steps[1].collect()}
    after = {r.doc_id: r.text.split("\n") for r in steps[2].collect()}
    lines = {}
    for doc_id, own in before.items():
        for line in set(own):
            if len(line.split()) >= 8:
                lines.setdefault(line, []).append(doc_id)
    for doc_id, own in before.items():
        if not any(len(lines.get(x, ())) > 1 for x in own) and doc_id in after:
            assert set(after[doc_id]) <= set(own)
    for line, ids in lines.items():
        assert sum(line in after.get(i, ()) for i in ids) <= 1


def test_one_document_of_each_group_stays(steps):
    from test_jaccard import brute

    rows = [(r.doc_id, r.text) for r in steps[2].collect()]
    assert {r.doc_id for r in steps[3].collect()} == {c for _, _, c in brute(rows)}


def test_ids_and_the_whole_run(spark, steps):
    library = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    text = {r.doc_id: r.text for r in steps[4].collect()}
    last = steps[5].collect()
    assert {r.doc_id for r in last} == set(text)
    assert all(list(r.ids) == library.encode(text[r.doc_id]) and r.n_ids == len(r.ids) for r in last)
    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, last))


def test_edge_cases(spark):
    long = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80))
    rows = [(None, long), (1, None), (2, ""), (3, long + " x"), (3, long + " x"), (4, long + " x y"), (5, long.upper()[::-1])]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    table = table.selectExpr("*", "NULL AS lang", "'s' AS source", "1L AS n_chars", "2 AS slot", "3 AS ids", "4 AS row")
    for docs in (table, table.limit(0)):
        for name, step in corpus_pipeline.STAGES[:-1]:
            out = step(spark, docs, SF)
            assert out.columns == docs.columns, name
            docs = out
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).columns == ["doc_id", "n_ids", "ids"]
    kept = table
    for _, step in corpus_pipeline.STAGES[:-1]:
        kept = step(spark, kept, SF)
    assert {r.doc_id for r in kept.collect()} >= {None, 3} and 1 not in {r.doc_id for r in kept.collect()}
