"""Near duplicates by SuperMinHash signatures.

Every element of a set has a random permutation of the ``SIZE`` places of a signature and a random number for each
rank of it: at rank j the element offers j + r to the place that its permutation has at j, and a place keeps its
smallest offer. The ranks of one element are correlated, as it offers each place exactly once; this lowers the variance
against independent minima. Ranks are walked for all elements of many documents at once: offers of rank j are
below j + 1, so a document of which every place is filled after rank j is done (early stopping). A long document
ends after the first rank, a short one after some, a document of one element after all.

1. ``describe``: one pass over the texts gives the number of shingles, a key of the set and, once a task for equal sets,
   ``BANDS`` keys over ``ROWS`` places each.
2. Documents with the same key are one node. Nodes with an equal band meet in a bucket, and are held first against the
   smallest node of it, with their full sets.
3. Buckets that still hold two components go through ``linking``: exact, a set is sent once for a chain of buckets.
4. Links become components (union-find by stars in Spark), and one document of each stays.

Two sets of similarity s are candidates with probability 1 - (1 - s**ROWS)**BANDS: at 0.8 it is missed five times in
10**9, at 0.9 less than once in 10**18. What is linked is always confirmed on full sets (by 64-bit hashes of shingles).

Edge cases: a missing or empty text has no shingles and is linked with nothing; fewer words than a shingle make one
shingle. Equal texts are linked. Missing ids are kept and linked, but name no component (the component of such documents
alone is missing). Rows that repeat an id are kept, each with its own shingles. Ids may be of any type that Arrow
carries and that has an order. Other columns play no part. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import discard, stage
from . import linking
from .components import components
from .hashing import mix, parts
from .shingles import set_keys, sets_of, shingle_sets

SHINGLE = 4
SIMILAR = 80  # of 100
BANDS = 48
ROWS = 5
SIZE = BANDS * ROWS
_STEP = 0x9E3779B97F4A7C15
_LOW = np.uint64(0xFFFFFFFF)
_UNFILLED = np.uint64((1 << 64) - 1)


def signatures(keys: np.ndarray, counts: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Signature rows of sets that stand one after the other in ``keys``, ``counts`` members each.

    A value is rank * 2**32 + a random number below 2**32. Places of an empty set stay at the largest value.
    """
    n = len(counts)
    out = np.full(n * size, _UNFILLED, np.uint64)
    doc = np.repeat(np.arange(n), counts)
    order = None  # permutation so far of each element that is left, from rank 1 on
    for rank in range(size):
        if not len(doc):
            break
        bits = mix(keys + np.uint64((rank + 1) * _STEP % (1 << 64)))
        pick = (((bits >> np.uint64(32)) * np.uint64(size - rank)) >> np.uint64(32)).astype(np.int64) + rank
        if rank == 0:
            place, first = pick, pick
        else:
            row = np.arange(len(doc))
            place = order[row, pick].astype(np.int64)
            order[row, pick] = order[:, rank]
        np.minimum.at(out, doc * size + place, np.uint64(rank << 32) | (bits & _LOW))
        done = (out.reshape(n, size) != _UNFILLED).all(axis=1)
        left = ~done[doc]
        if rank == 0:
            keys, doc, first = keys[left], doc[left], first[left]
            order = np.tile(np.arange(size, dtype=np.uint8 if size <= 256 else np.uint32), (len(doc), 1))
            order[np.arange(len(doc)), first] = 0
        elif not left.all():
            keys, doc, order = keys[left], doc[left], order[left]
    return out.reshape(n, size)


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A key of every ``rows`` places in order; the band's number is part of it."""
    own = signature.reshape(len(signature), signature.shape[1] // rows, rows)
    key = np.broadcast_to(mix(np.arange(1, own.shape[1] + 1, dtype=np.uint64)), own.shape[:2]).copy()
    for r in range(rows):
        key = mix(key + own[:, :, r])
    return key


def describe(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(id, n, node, bands) of every document; bands are missing where the task has met the set before, or it is empty."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for a, b in parts(batch.column(1)):
                keys, counts = shingle_sets(batch.column(1).slice(a, b - a).to_pylist(), shingle)
                nodes = set_keys(keys, counts)
                fresh = np.zeros(len(counts), bool)
                for i in np.flatnonzero(counts).tolist():
                    if int(nodes[i]) not in seen:
                        if len(seen) < 1 << 20:  # of more sets a copy may be described twice, which changes nothing
                            seen.add(int(nodes[i]))
                        fresh[i] = True
                own = np.repeat(fresh, counts)
                found = bands(signatures(keys[own], counts[fresh])).view(np.int64)
                starts = np.cumsum(np.concatenate(([0], np.where(fresh, found.shape[1], 0))))
                listed = pa.ListArray.from_arrays(
                    pa.array(starts.astype(np.int32), mask=np.append(~fresh, False)), pa.array(found.ravel())
                )
                cols = [batch.column(0).slice(a, b - a), pa.array(counts), pa.array(nodes), listed]
                yield pa.RecordBatch.from_arrays(cols, ["id", "n", "node", "bands"])

    return docs.select("id", "text").mapInArrow(run, f"id {kind}, n long, node long, bands array<long>")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, share: int = SIMILAR) -> DataFrame:
    """Of every document: ``id_col``, n_shingles (long), component_id (the smallest id that links lead to) and kept."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = stage(describe(texts, shingle), "superminhash-documents")
    nodes = rows.where("bands IS NOT NULL").dropDuplicates(["node"])
    buckets = nodes.select("node", F.explode("bands").alias("bucket"))
    first = buckets.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count("*").alias("k")).where("k > 1")
    sizes = rows.where("n > 0").groupBy("node").agg(F.first("n").alias("n"))
    buckets = buckets.join(first, "bucket").select("bucket", "pivot", "node")
    buckets = stage(buckets, "superminhash-buckets")

    star = stage(buckets.where("pivot != node").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), "superminhash-pairs")
    own = sets_of(texts, star.select(F.explode(F.array("a", "b")).alias("node")).distinct(), shingle)
    sets = stage(own, "superminhash-sets")
    links = stage(linking.verified(star, sets, share), "superminhash-links")
    roots = stage(components(links), "superminhash-roots")

    placed = buckets.join(roots, "node", "left").join(sizes, "node").select(
        "bucket", "node", "n", F.coalesce("root", "node").alias("root"), F.lit(False).alias("split")
    )
    dealt = linking.tasks(linking.open_buckets(placed), share)
    more = stage(linking.joined(dealt, sets, share), "superminhash-links")
    discard(buckets, star, sets)
    roots = stage(components(links.union(more)), "superminhash-roots")

    placed = rows.select("id", "n", "node").join(roots, "node", "left").select("id", "n", F.coalesce("root", "node").alias("root"))
    names = placed.where("n > 0").groupBy("root").agg(F.min("id").alias("name"))
    return placed.join(names, "root", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("id")).alias("component_id"),
    ).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that name their component; rows without an id, and of an id that names one, stay."""
    copies = join(docs, id_col, text_col).groupBy(id_col).agg(F.bool_or("kept").alias("any")).where("NOT any")
    return docs.join(copies.where(F.col(id_col).isNotNull()).select(id_col), id_col, "left_anti").select(*docs.columns)
