"""Registered queries: SQL twins, and brute force for those that SQL cannot express."""

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry_points
from compare import compare, connect
from tidemark.llm import oracles, pieces, queries
from tidemark.llm.tables import read

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in read(spark, SF, "documents").collect()}


def test_one_query_for_each_number():
    names = [n for n in entry_points.queries() if n.startswith("op")]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert set(names) == set(queries.QUERIES) and set(oracles.ORACLES) <= set(names)
    assert "pipeline" in entry_points.queries()


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_its_twin(spark, name):
    rows, problems = compare(entry_points.queries()[name](spark, SF), connect(SF), oracles.ORACLES[name])
    assert not problems and rows > 0


def test_personal_data(spark, texts):
    from test_pii import brute

    import hashlib

    rows = queries.QUERIES["op1_pii"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [base.count(k) for k in ("email:", "ip:", "card:", "phone:")]


def test_token_ids(spark, texts):
    coder = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    rows, at = sorted(queries.QUERIES["op7_token_ids"](spark, SF).collect(), key=lambda r: r.doc_id), 0
    assert len(rows) == len(texts)
    for r in rows:
        ids = [*coder.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_pages(spark):
    pages = {r.page_id: r for r in read(spark, SF, "pages").collect()}
    got = queries.QUERIES["op9_html"](spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        body = pages[r.page_id].html
        article = body[body.index("<article>") : body.index("</article>")]
        import html as references

        blocks = re.split(r"</?(?:p|h1)\b[^>]*>", article)
        want = [" ".join(references.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in blocks]
        assert r.text == "\n".join(filter(None, want)) and r.n_chars == len(r.text)
    records = queries.QUERIES["op6_warc"](spark, SF).collect()
    assert {r.page_id: r.payload_bytes for r in records} == {k: len((v.html or "").encode()) for k, v in pages.items()}


def test_pieces_and_scores_of_every_document(spark, texts):
    coder = pieces.Encoder(str(public_tokenizers.path("piece_bpe_32k.model")), "viterbi")
    got = queries.QUERIES["op10_pieces"](spark, SF).collect()
    assert {r.doc_id for r in got} == set(texts)
    for r in got:
        assert r.round_trip and r.n_pieces == len(coder.encode([texts[r.doc_id] or ""])[0])
    rows = queries.QUERIES["op5_pseudo_likelihood"](spark, SF).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        assert r.n_words == len([w for w in re.split(r"[\x20\x09-\x0D]+", texts[r.doc_id] or "") if w])
        assert (r.log_prob < 0) == (r.n_words > 0)


def test_merged_ids_are_those_of_the_library(spark, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    got = {r.doc_id: r for r in queries.QUERIES["op10_pieces"](spark, SF).collect()}
    rows = [(i, library.encode(t or "")) for i, t in texts.items()]
    want = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    want = want.select("doc_id", F.size("ids").alias("n"), F.xxhash64("ids").alias("hash"))
    assert {k: (r.n_merged, r.merged_xxhash64) for k, r in got.items()} == {r.doc_id: (r.n, r.hash) for r in want.collect()}
    assert all(r.round_trip for r in got.values())


def test_recurring_lines(spark, texts):
    rows = {r.doc_id: r for r in queries.QUERIES["op2_line_dedup"](spark, SF).collect()}
    where = {}
    for doc_id, text in texts.items():
        for line in set((text or "").split("\n")):
            if len(line.split()) >= 8:
                where.setdefault(line, []).append(doc_id)
    for line, ids in where.items():
        if len(ids) > 1:  # exact repeats: nowhere but at most in the first
            assert all(line not in rows[i].text.split("\n") for i in ids if i != min(ids))
    for i, r in rows.items():
        if not r.n_dropped:
            assert r.text == texts[i]
