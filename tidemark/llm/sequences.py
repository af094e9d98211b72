"""Token sequences as length-delimited binary records with a separate offset index.

A data file is a row of records: length (8 bytes), masked checksum of those 8 bytes (4), payload, masked
checksum of the payload (4), all little-endian. The payload is a document id (8 bytes), a flag (1) that
is 0 where the id is missing, the width of an id (1) and the ids. The checksum is CRC-32, rotated by 15
bits and shifted by a constant, so that checksums stored inside payloads do not look like checksums.
The index file next to it (``.idx``) has the offset and the number of ids of every record, 8 bytes each:
a shuffled read opens the data at any record without scanning.

Documents are range-partitioned by id and sorted inside a partition, so files are in ascending id order
and a task holds one record at a time. ``manifest`` lists the files in order with the ids before each.

Edge cases: a missing or empty text has the end id alone. Missing document ids come first. Rows with an
equal id are ordered by a hash of their text. Further columns are not written. No documents, no files.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import files
from .hashing import parts

FILE_BYTES = 256 << 20
MASK_DELTA = 0xA282EAD8
KEPT_WORDS = 1_000_000
MANIFEST = "part long, file_no long, path string, n_records long, n_tokens long, n_bytes long"
JOINED_WORDS = 2000
CODED_BYTES = 6 << 20  # texts that are encoded at once
_BREAKS = "\t\n\x0b\x0c\r"
_MARK = "\x01"
_PUNCTUATION = ".,!?;:"
_LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
_PLAIN = re.compile(f"[{_LETTERS}]+")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class WordEncoder:
    """A tokenizer of the ``tokenizers`` library, asked once for each distinct word.

    Valid for tokenizers that never join what ASCII white space separates, which ``__init__`` checks
    on the pre-tokenizer. Up to ``KEPT_WORDS`` words are remembered; rarer ones are encoded again.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        normal = self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer else str
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(normal("a b\tc\nd."))
        self.by_word = [p for p, _ in pieces] == ["a", "b", "c", "d", "."]
        self.lowers = normal("AZ") == "az"
        mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None  # an id that nothing but the mark has
        self.bare, self.shown = self._bare()
        self.words: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}

    def _bare(self) -> tuple[Tokenizer | None, dict[int, str]]:
        """The model without normalizer and pre-tokenizer, which take most of the time and leave words of ``_LETTERS`` as they
        are, and the characters that stand for bytes; none where ids of such words differ."""
        from tokenizers import Tokenizer, pre_tokenizers

        spec = json.loads(self.tokenizer.to_str())
        if not (self.by_word and self.lowers) or any(_PLAIN.fullmatch(t["content"].lower()) for t in spec["added_tokens"]):
            return None, {}
        bare = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": None, "post_processor": None}))
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        shown = {}
        for char in map(chr, range(0x100)):  # in UTF-8 these have all bytes that words of letters have
            shown.update(zip(char.encode(), level.pre_tokenize_str(char)[0][0]))
        tried = [*_LETTERS, _LETTERS, *(a + b for a in _LETTERS for b in _LETTERS)]
        coded = bare.encode_batch_fast([w.encode().decode("latin-1").translate(shown) for w in tried], add_special_tokens=False)
        whole = self.tokenizer.encode_batch_fast(tried, add_special_tokens=False)
        return (bare, shown) if [e.ids for e in coded] == [e.ids for e in whole] else (None, {})

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of single words: those of letters by the bare model, many others as one text with a mark between them."""
        if self.bare is not None:
            plain = [w for w in words if _PLAIN.fullmatch(w)]
            shown = [w if w.isascii() else w.encode().decode("latin-1").translate(self.shown) for w in plain]
            coded = self.bare.encode_batch_fast(shown, add_special_tokens=False)
            known = {w: np.array(e.ids, self.dtype).tobytes() for w, e in zip(plain, coded)}
            others = [w for w in words if w not in known]
            known.update(zip(others, self._encode_marked(others)))
            return [known[w] for w in words]
        return self._encode_marked(words)

    def _encode_marked(self, words: list[str]) -> list[bytes]:
        if self.mark is None or any(_MARK in w for w in words):
            return self._encode(words)
        texts = [f" {_MARK} ".join(words[at : at + JOINED_WORDS]) for at in range(0, len(words), JOINED_WORDS)]
        out = []
        for ids in self._encode(texts):
            cut = np.flatnonzero(np.frombuffer(ids, self.dtype) == self.mark) * self.width
            begin = [0, *(cut + self.width).tolist()]
            out += [ids[a:b] for a, b in zip(begin, [*cut.tolist(), len(ids)])]
        return out

    def _parts(self, word: str) -> tuple[str, str]:
        """A plain word in the case that the tokenizer sees, and the punctuation behind it."""
        stem = word.rstrip(_PUNCTUATION)
        if self.bare is not None and _PLAIN.fullmatch(low := stem.lower()):
            return low, word[len(stem) :]
        if not word.isascii() or "<|" in word:
            return word, ""
        if stem and stem[-1].isalnum():
            word, tail = stem, word[len(stem) :]
        else:
            tail = ""
        return (word.lower() if self.lowers else word), tail

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as little-endian unsigned integers of ``width`` bytes.

        Words are split, numbered and put together again as Arrow arrays: Python sees each distinct word of ``texts`` once.
        """
        if not self.by_word:
            return self._encode(texts)
        if len(self.words) > KEPT_WORDS:
            self.words = {}
        if len(self.stems) > KEPT_WORDS:
            self.stems = {}
        whole = pa.array(texts, pa.string())
        for char in _BREAKS:
            whole = pc.replace_substring(whole, char, " ")
        split = pc.split_pattern(whole, " ")
        numbered = split.flatten().dictionary_encode()
        words, known, stems = numbered.dictionary.to_pylist(), self.words, self.stems
        fresh = [w for w in words if w not in known]
        pairs = [self._parts(w) for w in fresh]
        new = list({p for pair in pairs for p in pair if p not in stems})
        stems.update(zip(new, self._encode_words(new)))
        known.update((w, stems[a] + stems[b]) for w, (a, b) in zip(fresh, pairs))
        ids = pa.array([known[w] for w in words], pa.binary()).take(numbered.indices)
        _, ends, data = ids.buffers()
        ends = np.frombuffer(ends, np.int32)[split.offsets.to_numpy()].tolist()
        data = data.to_pybytes() if data else b""
        return [data[a:b] for a, b in zip(ends, ends[1:])]


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    payload = struct.pack("<qBB", doc_id or 0, doc_id is not None, width) + ids
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def read_frame(stream) -> tuple[int | None, bytes, int] | None:
    """The next record: document id, ids and their width; None at the end. Checks both checksums."""
    head = stream.read(12)
    if not head:
        return None
    if len(head) < 12 or masked(head[:8]) != struct.unpack("<I", head[8:])[0]:
        raise ValueError("a record's length is damaged")
    size = struct.unpack("<Q", head[:8])[0]
    body = stream.read(size + 4)
    if len(body) < size + 4 or masked(body[:size]) != struct.unpack("<I", body[size:])[0]:
        raise ValueError("a record is damaged")
    doc_id, known, width = struct.unpack_from("<qBB", body)
    return (doc_id if known else None), body[10:size], width


def write(
    docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    folder: str | None = None, file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Encode and write documents in ascending id order; returns the manifest (``MANIFEST``)."""
    target = files.folder_for(docs.sparkSession, "sequences", folder)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keys = ("id", F.xxhash64("text"))
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        end = np.array([end_id], encode.dtype).tobytes()
        done, data, index, row = [], None, None, {}

        def close():
            nonlocal data
            if data is not None:
                data.close()
                index.close()
                done.append(row)
                data = None

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, to in parts(batch.column(1), CODED_BYTES):
                coded = encode.encode(texts[at:to])
                for doc_id, tokens in zip(ids[at:to], coded):
                    if data is not None and row["n_bytes"] >= file_bytes:
                        close()
                    if data is None:
                        path = files.part_name(target, len(done), ".bin")
                        data, index = files.create(path), files.create(f"{path}.idx")
                        row = {"part": TaskContext.get().partitionId(), "file_no": len(done), "path": path}
                        row |= {"n_records": 0, "n_tokens": 0, "n_bytes": 0}
                    record = frame(doc_id, tokens + end, encode.width)
                    n = len(tokens) // encode.width + 1
                    index.write(struct.pack("<QQ", row["n_bytes"], n))
                    data.write(record)
                    row["n_records"] += 1
                    row["n_tokens"] += n
                    row["n_bytes"] += len(record)
        close()
        if done:
            yield pa.RecordBatch.from_pylist(done)

    return files.written(rows.mapInArrow(save, MANIFEST), "sequences-manifest")


def starts(manifest: DataFrame) -> DataFrame:
    """The manifest with ``start``: ids in all files before. One row a file, so one window over all is small."""
    before = Window.orderBy("part", "file_no").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read(manifest: DataFrame) -> DataFrame:
    """Every record of the files: doc_id, start (ids before it), n_tokens, ids (binary, 4 bytes each), crc32."""
    listed = files.one_file_a_task(starts(manifest).select("path", "start"))
    schema = pa.schema(
        [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("crc32", pa.int64())]
    )

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                rows, size = [], 0
                with files.open_random(path) as raw:
                    stream = pa.BufferedInputStream(raw, 1 << 20)
                    while (record := read_frame(stream)) is not None:
                        doc_id, ids, width = record
                        wide = np.frombuffer(ids, f"<u{width}").astype("<u4")
                        plain = wide.tobytes()
                        rows.append((doc_id, at, len(wide), plain, zlib.crc32(plain)))
                        at, size = at + len(wide), size + len(plain)
                        if size >= 4 << 20 or len(rows) >= 5000:
                            yield _batch(rows, schema)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows, schema)

    return listed.mapInArrow(load, "doc_id long, start long, n_tokens long, ids binary, crc32 long")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def read_shuffled(manifest: DataFrame, seed: int) -> DataFrame:
    """Records in an order drawn from ``seed``: (order, doc_id, ids), the index giving each record's place.

    Index entries are shuffled, not sequences; each task then opens records at their offsets.
    """

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with files.open_stream(f"{path}.idx") as stream:
                    while block := stream.read(1 << 16):
                        offsets = np.frombuffer(block, "<u8")[::2].astype("int64")
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([path] * len(offsets)), pa.array(offsets)], ["path", "offset"]
                        )

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path, offset in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                with files.open_random(path) as raw:
                    raw.seek(offset)
                    doc_id, ids, width = read_frame(raw)
                found.append((doc_id, np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary())],
                ["order", "doc_id", "ids"],
            )

    places = files.one_file_a_task(manifest.select("path")).mapInArrow(entries, "path string, offset long")
    places = places.withColumn("order", F.xxhash64(F.lit(seed), "path", "offset")).repartitionByRange("order")
    return places.sortWithinPartitions("order").mapInArrow(fetch, "order long, doc_id long, ids binary")
