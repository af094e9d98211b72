"""Files against the tokenizer itself, order, index, checksums, edge cases."""

import io
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import files
from tidemark.llm import sequences as sq

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
TEXTS = [
    None, "", " ", "Hello, world. It's 3.5% done!", "<|endoftext|> a <|ENDOFTEXT|>. b", "tab\tand\nline\x0bx\x0cy\rz",
    "a\xa0b c\x1cd\x85e", "\x01 mark \x01x", "İstanbul ΣΑΣ. é ́x ﬁ 漢字😀", "don't!? (x) y.z,, ...", "w " * 20_000,
    "UPPER lower Upper.", "x" * 3000,
]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = list(enumerate(TEXTS))
    out += [(100 + i, " ".join(rng.choice(["The", "cat.", "Sat,", "on", "é", f"n{i}"]) for _ in range(i))) for i in range(60)]
    return out + [(None, "no id"), (3, "again"), (3, "again"), (-5, "negative")]


def expected(rows):
    coder = Tokenizer.from_file(PATH)
    ids = [(d, coder.encode(t or "", add_special_tokens=False).ids + [2]) for d, t in rows]
    return sorted(ids, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def test_records_in_order_with_their_place(docs, rows):
    manifest = sq.write(docs(rows).repartition(5), PATH, end_id=2, file_bytes=2000)
    got = sq.read(manifest).collect()
    at, by_start = 0, sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in by_start] == [d for d, _ in expected(rows)]
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted(
        (str(d), np.array(i, "<u4").tobytes()) for d, i in expected(rows)
    )
    for r in by_start:
        assert r.start == at and r.n_tokens == len(r.ids) // 4 and r.crc32 == zlib.crc32(r.ids)
        at += r.n_tokens


def test_shuffled_read_by_the_index(docs, rows):
    manifest = sq.write(docs(rows), PATH, end_id=2, file_bytes=1500)
    plain = sorted((str(r.doc_id), r.ids) for r in sq.read(manifest).collect())
    orders = []
    for seed in (1, 1, 2):
        got = sq.read_shuffled(manifest, seed).collect()
        assert sorted((str(r.doc_id), r.ids) for r in got) == plain
        assert [r.order for r in got] == sorted(r.order for r in got)
        orders.append([r.doc_id for r in got])
    assert orders[0] == orders[1] != orders[2]


def test_checksums_find_damage():
    record = sq.frame(7, b"\x01\x00\x02\x00", 2)
    assert sq.read_frame(io.BytesIO(record)) == (7, b"\x01\x00\x02\x00", 2)
    assert sq.read_frame(io.BytesIO(sq.frame(None, b"", 4))) == (None, b"", 4)
    assert sq.read_frame(io.BytesIO(b"")) is None
    for at in (0, 9, 14, len(record) - 1):
        bad = bytearray(record)
        bad[at] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            sq.read_frame(io.BytesIO(bytes(bad)))
    with pytest.raises(ValueError, match="damaged"):
        sq.read_frame(io.BytesIO(record[:-2]))
    crc = zlib.crc32(record[:8])
    assert struct.unpack("<I", record[8:12])[0] == ((crc >> 15 | crc << 17) + 0xA282EAD8) % (1 << 32)


def test_index_names_every_record(docs, rows):
    for row in sq.write(docs(rows), PATH, end_id=2).collect():
        with files.open_stream(row.path + ".idx") as index, files.open_random(row.path) as data:
            entries = np.frombuffer(index.read(), "<u8").reshape(-1, 2)
            assert len(entries) == row.n_records and entries[:, 1].sum() == row.n_tokens
            for offset, n in entries.tolist():
                data.seek(offset)
                assert len(sq.read_frame(data)[1]) == 2 * n


def test_no_documents(docs, rows):
    manifest = sq.write(docs(rows).limit(0), PATH, end_id=2)
    assert manifest.count() == 0 and sq.read(manifest).count() == 0 and sq.read_shuffled(manifest, 1).count() == 0


def test_words_are_looked_up_once_for_many_texts():
    class Counted(dict):
        asked = 0

        def __getitem__(self, word):
            Counted.asked += 1
            return super().__getitem__(word)

    encoder = sq.WordEncoder(PATH)
    encoder.words = Counted()
    odd = ["", " ", "a  b\n\nc\t", "Straße, e\u0301té!? \x01 x", "\x0bWORD\x0c word. (word) don't <|endoftext|> 12.5", "数字 \U0001f600\u00a0z\u2028y"]
    texts = odd + ["the word of the Word, " * 50] * 100
    plain = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(ids, encoder.dtype).tolist() for ids in encoder.encode(texts)] == [e.ids for e in plain]
    assert Counted.asked < 100


def test_words_of_letters_go_to_the_model_alone():
    encoder = sq.WordEncoder(PATH)
    seen = []
    whole = encoder._encode
    encoder._encode = lambda texts: seen.extend(texts) or whole(texts)
    texts = ["Straße ÉTÉ, niñó ẞ Ÿ Å K İ ſ Ʒ e\u0301té a\u0308, naïve... É! ÷ × ª º", "don't ça: Ça? œuvre Ĳ ﬀ µ"]
    plain = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(ids, encoder.dtype).tolist() for ids in encoder.encode(texts)] == [e.ids for e in plain]
    assert not any(w in " ".join(seen) for w in ("straße", "niñó", "naïve"))
