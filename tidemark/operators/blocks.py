"""Postings met with profiles in blocks, by shared terms.

Profiles are dealt into blocks, postings into about as many parts as give every task of a shuffle one part to meet with
one block. A task reads a block first and holds it as an index from terms to profiles; the postings of its part
follow in batches. So neither the number of postings nor that of profiles decides what a task holds, texts are
shuffled once for each block, and no row is made for a (posting, term, profile). Terms are taken from texts where they
meet a block: however few files or row groups a table was read from, all tasks of the shuffle share that work.

Edge cases: postings without a key meet nothing; those without terms share nothing, nor do profiles without any.
Letters and digits are those of Python's Unicode tables, which may know some scripts that the tables of a JVM lack.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Python workers get these functions with the plan and need not find the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROFILES = 8192  # profiles that a task is meant to hold
MEETINGS = 1 << 21  # (posting, profile) counts, and shared terms, that are worked on at once
LETTERS = 1 << 20  # code points of texts whose terms are held at once
_OTHER = re.compile(r"[^\x00-\x7F\w]")
_SPACED = bytes(i if i > 127 or chr(i).isalnum() else 32 for i in range(256))


def term_set(text: str | None) -> set[bytes]:
    """Distinct lower-case words of a text in UTF-8, as ``functions.text.terms`` has them."""
    low = (text or "").lower()
    return set((low if low.isascii() else _OTHER.sub(" ", low)).encode().translate(_SPACED).split())


class Block:
    """Profiles of one block in order of their names, and for each of their terms the profiles that have it."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by("name")
        self.names, self.texts = rows["name"], rows["text"]
        self.terms = [term_set(text) for text in rows["text"].to_pylist()]
        self.n_terms = np.array([len(own) for own in self.terms], np.int64)
        self.number = {word: i for i, word in enumerate(set().union(*self.terms))}
        self.words = frozenset(self.number)
        of = np.fromiter((self.number[w] for own in self.terms for w in own), np.int64, self.n_terms.sum())
        self.owners = np.repeat(np.arange(len(self.n_terms)), self.n_terms)[np.argsort(of, kind="stable")]
        self.often = np.bincount(of, minlength=len(self.words))
        self.ends = np.cumsum(self.often)


class Part:
    """Some postings: names, texts, sets of terms, and the numbers that a block gives to those terms that it has."""

    def __init__(self, block: Block, rows: pa.Table, terms: list[set[bytes]], words: list[np.ndarray]):
        self.block, self.names, self.texts = block, rows["name"], rows["text"]
        self.terms, self.words, self.lengths = terms, np.concatenate(words), np.array([len(w) for w in words], np.int64)

    def shared(self) -> np.ndarray:
        """Number of shared terms by posting and profile."""
        block, n, word = self.block, len(self.block.n_terms), self.words
        row = np.repeat(np.arange(len(self.lengths)), self.lengths)
        often = block.often[word]
        before = np.cumsum(often) - often
        at = np.arange(often.sum()) + np.repeat(block.ends[word] - often - before, often)
        met = np.repeat(row * n, often) + block.owners[at]
        return np.bincount(met, minlength=len(self.lengths) * n).reshape(-1, n)

    def scores(self, shared: np.ndarray) -> np.ndarray:
        """Share of each profile's terms that a posting has."""
        return shared / np.maximum(1, self.block.n_terms)

    def lacking(self, at: np.ndarray, profile: np.ndarray, first: int | None = None) -> pa.Array:
        """Terms of the postings ``at`` that the profile beside each lacks, all or the ``first`` in alphabetical order."""
        lost = [sorted(self.terms[a] - self.block.terms[f])[:first] for a, f in zip(at.tolist(), profile.tolist())]
        return pa.array(lost, pa.list_(pa.binary())).cast(pa.list_(pa.string()))


def _parts(block: Block, rows: pa.Table) -> Iterator[Part]:
    """Postings in parts whose counts and shared terms stay below ``MEETINGS``, and texts below ``LETTERS``, or of one posting."""
    if not len(block.words):
        return
    start, work, letters, terms, words = 0, 0, 0, [], []
    for at, text in enumerate(rows["text"].to_pylist()):
        own = term_set(text)
        known = np.fromiter(map(block.number.__getitem__, own & block.words), np.int64)
        more, size = int(block.often[known].sum()) + len(block.n_terms), len(text or "")
        if terms and (work + more > MEETINGS or letters + size > LETTERS):
            yield Part(block, rows.slice(start, at - start), terms, words)
            start, work, letters, terms, words = at, 0, 0, [], []
        work, letters = work + more, letters + size
        terms.append(own), words.append(known)
    if terms:
        yield Part(block, rows.slice(start), terms, words)


def meet(postings: DataFrame, profiles: DataFrame, work: Callable[[Part], pa.Table], schema: str, most: int | None = None) -> DataFrame:
    """``work`` of all parts of postings with all blocks of profiles, ``most`` in a block."""
    spark = postings.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = F.greatest(F.lit(1), F.ceil(profiles.agg(F.count("*")).scalar() / (most or PROFILES))).cast("int")
    parts = F.ceil(F.lit(tasks) / blocks).cast("int")

    def side(table: DataFrame, which: int, name: str, text: str) -> DataFrame:
        own = table.where(F.col(name).isNotNull()).select(F.col(name).alias("name"), F.col(text).alias("text"))
        dealt, others = (blocks, parts) if which == 0 else (parts, blocks)
        here, other = F.pmod(F.xxhash64("name"), dealt).cast("int"), F.col("other")
        cell = other * blocks + here if which == 0 else here * blocks + other
        own = own.select("*", F.explode_outer(F.sequence(F.lit(0), others - 1)).alias("other"))
        # a cell's profiles come before its postings
        return own.select(cell.alias("cell"), (cell.cast("long") * 2 + which).alias("turn"), "name", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, block = None, [], None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            turns = rows["turn"].to_numpy()
            cuts = np.flatnonzero(np.diff(turns) != 0) + 1
            for at, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(turns)]):
                if at == end:
                    continue
                of, posted = divmod(int(turns[at]), 2)
                if of != cell:
                    cell, held, block = of, [], None
                own = rows.slice(at, end - at)
                if not posted:
                    held.append(own)
                    continue
                if block is None and held:
                    block = Block(pa.concat_tables(held))
                    held = []
                if block is not None:
                    for part in _parts(block, own):
                        yield from work(part).to_batches()

    rows = side(profiles, 0, "filename", "content").union(side(postings, 1, "dedup_key", "description"))
    spread = rows.repartitionById(tasks, "cell").select("turn", "name", "text")
    return spread.sortWithinPartitions("turn").mapInArrow(run, schema)
