"""Benchmark decontamination with a broadcast hash set of benchmark windows.

Benchmark texts become windows of ``window`` consecutive normalised words (one shorter window for a
shorter item). Tasks hold a sorted array of window hashes and scan each document's words against it;
a hash hit is verified word by word before it counts. Words are bytes: A-Z lower-cased, split at every
ASCII character that is neither a letter nor a digit.

The benchmark is taken in blocks of at most ``block_bytes`` of text, and a block is all that a task
holds: a larger benchmark means more passes over each batch of documents, not more memory, and hits
of all blocks meet in the row, so that nothing is shuffled. An item above ``block_bytes`` is a block
of its own.

Edge cases: missing or empty texts have no words and no hits. Items without words hit nothing. An item
without an ``item_id`` marks words but is not listed. Equal items all count. Repeated rows and missing
document ids are kept, one result row for each input row. An empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import parts
from .tables import unused

WINDOW = 13
BLOCK_BYTES = 8 << 20
MODES = ("report", "documents", "spans")

_TABLE = bytearray(range(256))
for _b in range(128):
    _c = chr(_b)
    _TABLE[_b] = ord(_c.lower()) if _c.isascii() and _c.isalnum() else 32
_TABLE = bytes(_TABLE)
_MULT = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    """Normalised words; surrogates that UTF-8 has no form for never occur in a Spark string."""
    return text.encode().translate(_TABLE).split() if text else []


class WindowSet:
    """Windows of one block of items, by length, as sorted hashes of word numbers."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.numbers: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        for at, (_, text) in enumerate(items):
            ids = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words(text)], np.uint64)
            if len(ids):
                size = min(window, len(ids))
                found.setdefault(size, []).append((np.lib.stride_tricks.sliding_window_view(ids, size), at))
        self.sizes = {}
        for size, own in found.items():
            rows = np.concatenate([p for p, _ in own])
            owner = np.concatenate([np.full(len(p), at) for p, at in own])
            keys = self._keys(rows.T, size)
            order = np.argsort(keys, kind="stable")
            self.sizes[size] = (keys[order], rows[order], owner[order])

    @staticmethod
    def _keys(columns, size: int) -> np.ndarray:
        key = np.zeros(len(columns[0]), np.uint64)
        for k in range(size):
            key = (key ^ columns[k]) * _MULT
            key ^= key >> np.uint64(29)
        return key

    def scan(self, ids: np.ndarray) -> tuple[np.ndarray, set[int]]:
        """Which words a window covers, and the items whose windows occur."""
        hit, items = np.zeros(len(ids), bool), set()
        known = ids != 0
        for size, (keys, rows, owner) in self.sizes.items():
            if len(ids) < size:
                continue
            # only stretches of known words can hold a window
            total = np.concatenate(([0], np.cumsum(known)))
            starts = np.flatnonzero(total[size:] - total[:-size] == size)
            if not len(starts):
                continue
            probe = self._keys([ids[starts + k] for k in range(size)], size)
            low = np.searchsorted(keys, probe, "left")
            seen = (low < len(keys)) & (keys[np.minimum(low, len(keys) - 1)] == probe)
            for start, key, at in zip(starts[seen], probe[seen], low[seen]):
                while at < len(keys) and keys[at] == key:
                    if np.array_equal(rows[at], ids[start : start + size]):
                        hit[start : start + size] = True
                        items.add(int(owner[at]))
                    at += 1
        return hit, items


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list]:
    block, size = [], 0
    rows = benchmark.select(F.col(id_col).cast("string"), F.col(text_col)).toLocalIterator()
    for name, text in rows:
        n = len((text or "").encode())
        if block and size + n > block_bytes:
            yield block
            block, size = [], 0
        block.append((name, text))
        size += n
    yield block


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def cut_spans(text: str, hit: np.ndarray) -> str:
    """``text`` without the words of ``hit`` and without what stands between hit words of one run."""
    data = text.encode()
    table = np.frombuffer(data.translate(_TABLE), np.uint8) != 32
    begin, end = _runs(table)
    first, last = _runs(hit)
    left, at = [], 0
    for a, b in zip(first, last):
        left.append(data[at : begin[a]])
        at = end[b - 1]
    return b"".join([*left, data[at:]]).decode()


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    mode: str = "report",
    window: int = WINDOW,
    one_in: int = 20,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Documents and what of the benchmark they hold.

    ``report`` adds n_words, n_hit (long), items (array of item ids as sorted strings) and contaminated
    (n_hit above 0 and at least one word in ``one_in``) to the columns of ``docs``; a clashing name
    gets underscores in front. ``documents`` returns the rows that are not contaminated, ``spans`` all
    rows with the hit passages cut out of the text; both with the columns of ``docs``.
    """
    if mode not in MODES:
        raise ValueError(f"mode is {mode}, one of {MODES} is needed")
    spark = docs.sparkSession
    # one small broadcast for each block; tasks read them one after the other
    held = [
        spark.sparkContext.broadcast(block)
        for block in _blocks(benchmark, item_col, item_text_col, block_bytes)
    ]
    taken = list(docs.columns)
    names = []
    for name in ("n_words", "n_hit", "items", "contaminated"):
        names.append(unused(name, taken + names))
    kinds = (T.LongType(), T.LongType(), T.ArrayType(T.StringType()), T.BooleanType())
    place = taken.index(text_col)
    plain = docs.toDF(*[f"c{i}" for i in range(len(taken))])
    added = [T.StructField(f"r{i}", kind) for i, kind in enumerate(kinds)]
    schema = T.StructType([*plain.schema.fields, *added])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[int, WindowSet] = {}

        def block(k: int) -> WindowSet:
            if k not in ready:
                ready.clear()  # one block at a time
                ready[k] = WindowSet(held[k].value, window)
            return ready[k]

        # about a megabyte of text at a time, as its words take several times that
        for batch in (whole.slice(a, b - a) for whole in batches for a, b in parts(whole.column(place))):
            texts = batch.column(place).to_pylist()
            split = [words(t) for t in texts]
            hits = [np.zeros(len(w), bool) for w in split]
            items: list[set[str]] = [set() for _ in split]
            for k in range(len(held)):
                windows = block(k)
                number = windows.numbers.get
                for i, own in enumerate(split):
                    if own and windows.sizes:
                        ids = np.fromiter((number(w, 0) for w in own), np.uint64, len(own))
                        hit, at = windows.scan(ids)
                        hits[i] |= hit
                        items[i] |= {windows.names[x] for x in at if windows.names[x] is not None}
            n_hit = [int(h.sum()) for h in hits]
            bad = [n > 0 and one_in * n >= len(w) for n, w in zip(n_hit, split)]
            columns = list(batch.columns)
            if mode == "spans":
                columns[place] = pa.array(
                    [cut_spans(t, h) if n else t for t, h, n in zip(texts, hits, n_hit)],
                    batch.schema.field(place).type,
                )
            columns += [
                pa.array([len(w) for w in split], pa.int64()), pa.array(n_hit, pa.int64()),
                pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(bad, pa.bool_()),
            ]
            out = pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *(f"r{i}" for i in range(4))])
            yield out.filter(pa.array([not b for b in bad])) if mode == "documents" else out

    done = plain.mapInArrow(scan, schema)
    if mode == "report":
        return done.toDF(*taken, *names)
    return done.drop(*(f"r{i}" for i in range(4))).toDF(*taken)


def items_sha256(items):
    """Digest of an items column: hex SHA-256 of the comma-joined ids."""
    return F.sha2(F.encode(F.array_join(items, ","), "UTF-8"), 256)
