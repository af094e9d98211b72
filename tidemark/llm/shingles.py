"""Sets of word shingles of many texts at once, as sorted 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import mix, parts, word_hashes

SLOT_BITS = 20
_C = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(64)]


def shingle_sets(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text in order, and their number for each text."""
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    doc = np.repeat(np.arange(len(counts)), counts)
    first = np.flatnonzero(np.arange(len(words)) + size <= ends[doc]) if len(words) else np.zeros(0, np.int64)
    key = np.zeros(len(first), np.uint64)
    for k in range(size):
        key += words[first + k] * _C[k]
    keys, owners = [mix(key)], [doc[first]]
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        own = words[ends[i] - counts[i] : ends[i]]
        weights = np.array(_C[size : size + len(own)], np.uint64)
        keys.append(mix((own * weights).sum(keepdims=True) + np.uint64(len(own))))
        owners.append(np.array([i]))
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    return key[new], np.bincount(owner[new], minlength=len(texts)).astype(np.int64)


def set_keys(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A key of every set: the sum of its mixed hashes."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(keys ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)))
    ends = np.cumsum(counts)
    return mix(total[ends] - total[ends - counts] + counts.astype(np.uint64)).view(np.int64)


def sets_of(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, set) of the nodes in ``wanted``, once each, from the texts (id, text) again.

    A bitmap of fixed size keeps most other sets inside their tasks; the join that follows is exact.
    """
    slot = F.shiftrightunsigned(F.col("node"), 64 - SLOT_BITS)
    bits = np.zeros(1 << SLOT_BITS, bool)
    bits[wanted.select(slot.alias("s")).distinct().toPandas()["s"].to_numpy(np.int64)] = True
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for a, b in parts(batch.column(0)):
                keys, counts = shingle_sets(batch.column(0).slice(a, b - a).to_pylist(), shingle)
                nodes, ends = set_keys(keys, counts), np.cumsum(counts)
                here = held.value[(nodes.view(np.uint64) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
                own = []
                for i in np.flatnonzero(here & (counts > 0)).tolist():
                    if int(nodes[i]) not in seen:
                        if len(seen) < 1 << 20:
                            seen.add(int(nodes[i]))
                        own.append(i)
                found = pa.array([keys[ends[i] - counts[i] : ends[i]].tobytes() for i in own], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), found], ["node", "set"])

    found = docs.select("text").mapInArrow(run, "node long, set binary")
    return found.join(wanted, "node", "left_semi").dropDuplicates(["node"])
