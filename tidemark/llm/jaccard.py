"""N-gram Jaccard join: which documents share at least 80 in 100 of their word shingles.

A document's shingles are hashed to 64 bits. Hashing them once more into ``DIMS`` groups gives a vector of
counts, a point: the overlap of two documents is at most the sum of the smaller of each pair of counts,
so a pair whose sum is too small needs no comparison, nor does a pair of boxes around points whose sum
over the upper corners is too small for the smallest documents inside. ``DIMS`` groups tell unrelated documents apart
up to some 1,600 shingles; documents of ``FINE`` and more have a finer point as well, with about ``PER_CELL``
shingles a group, which pairs that pass the first bound have to pass too.

1. ``describe``: one pass over the texts gives every document's number of shingles, a key of the set, its point,
   and a table of fixed size with how often shingles fall into each of its slots, over all documents.
2. Documents with the same key are one node from here on.
3. Two similar documents share one of their rarest shingles: ordered by slot count, the first
   n - ceil(0.8 n) + 1 of both sets meet. Only these are shuffled, and only those that two nodes have are kept.
   Passages that many documents share are the most frequent shingles, so they are not among them.
4. Every node of such a bucket is held against the bucket's smallest node: a star, linear in the bucket.
   Points bound, sets verify, links become components. A group of near copies ends here, without its pairs.
5. Buckets of three or more nodes that still hold two components are dealt into tasks by ``linking``, a node
   once for a chain of such buckets. A task packs the points into a tree of boxes, sort-tile-recursive, each with its
   upper corner and its smallest and largest size, and prunes pairs of boxes from the top down. What leaves the task are
   the nodes of which a pair across components is allowed, with the chain of allowed pairs they are in, not the pairs.
   Their sets are sent once for a chain to one task, where overlaps are counted exactly and the links of a spanning
   forest are returned.

No link between different components is lost: a similar pair shares a bucket, and either has become one
component or is compared in step 5. No step has a row for each pair of a group.

Edge cases: a missing or empty text has no shingles and is linked with nothing; fewer words than a
shingle make one shingle. Equal texts are linked. Missing ids are kept and linked, but name no component
(the component of such documents alone is missing). Rows that repeat an id are kept, each with its own
shingles. Ids may be of any type that Arrow carries and that has an order. Other columns play no part. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.staging import discard, stage
from . import linking
from .components import components
from .hashing import groups, mix
from .shingles import set_keys, sets_of, shingle_sets

SHINGLE = 5
OF = 100
SIMILAR = 80  # of OF
DIMS = 64
SLOT_BITS = 18
HOT = 20_000  # estimated documents of a shingle from which its bucket is dealt out in parts
BOX = 32  # points of a leaf of the tree
FAN = 8  # boxes of a box one level up
FINE = 1024  # shingles from which a document has a finer point as well
PER_CELL = 12  # shingles of a cell of it, at most, on average
_CELLS = 1 << 22  # numbers that are compared at once


def _slots(keys: np.ndarray, bits: int = SLOT_BITS) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def _per_group(docs: DataFrame, make, schema: str) -> DataFrame:
    """``make(texts, ids)`` over groups of about a megabyte of text; a last call with None ends a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in groups(texts):
                yield from make(state, texts[a:b], batch.column(0).slice(a, b - a))
        yield from make(state, None, None)

    return docs.mapInArrow(run, schema)


def describe(docs: DataFrame) -> DataFrame:
    """Rows of documents (id, n, node, point, fine) and, apart from them, rows of the slot table (slot, slot_n)."""
    kind = docs.schema.fields[0].dataType
    arrow = to_arrow_type(kind)
    fields = pa.schema(
        [
            ("id", arrow), ("n", pa.int64()), ("node", pa.int64()), ("point", pa.binary()), ("fine", pa.binary()),
            ("slot", pa.int64()), ("slot_n", pa.int64()),
        ]
    )

    def make(state, texts, ids):
        table = state.setdefault("table", np.zeros(1 << SLOT_BITS, np.int64))
        if texts is None:
            used = np.flatnonzero(table)
            none = [pa.nulls(len(used), f.type) for f in list(fields)[:5]]
            if len(used):
                yield pa.RecordBatch.from_arrays([*none, pa.array(used), pa.array(table[used])], schema=fields)
            return
        keys, counts = shingle_sets(texts, SHINGLE)
        table += np.bincount(_slots(keys), minlength=1 << SLOT_BITS)
        cell = np.repeat(np.arange(len(texts)), counts) * DIMS + (keys % np.uint64(DIMS)).astype(np.int64)
        points = np.bincount(cell, minlength=len(texts) * DIMS).astype("<u4").reshape(-1, DIMS)
        none = [pa.nulls(len(texts), pa.int64())] * 2
        cols = [ids, pa.array(counts), pa.array(set_keys(keys, counts)), pa.array([p.tobytes() for p in points], pa.binary())]
        ends = np.cumsum(counts)
        fine = [_fine(keys[end - n : end]) if n >= FINE else None for n, end in zip(counts.tolist(), ends.tolist())]
        cols.append(pa.array(fine, pa.binary()))
        yield pa.RecordBatch.from_arrays([*cols, *none], schema=fields)

    return _per_group(
        docs, make, f"id {kind.simpleString()}, n long, node long, point binary, fine binary, slot long, slot_n long"
    )


def _prefixes(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """(shingle, part, split, node, n): the rarest shingles of every set, once a task for equal sets.

    ``split`` says whether the bucket of the shingle is dealt out in parts.
    """
    held = docs.sparkSession.sparkContext.broadcast(table)

    def make(state, texts, ids):
        if texts is None:
            return
        counts_of, seen = held.value, state.setdefault("seen", set())
        keys, counts = shingle_sets(texts, SHINGLE)
        nodes = set_keys(keys, counts)
        fresh = np.zeros(len(texts), bool)
        for i, (node, n) in enumerate(zip(nodes.tolist(), counts.tolist())):
            if n and node not in seen:
                seen.add(node)
                fresh[i] = True
        owner = np.repeat(np.arange(len(texts)), counts)
        use = fresh[owner]
        keys, owner = keys[use], owner[use]
        often = counts_of[_slots(keys)]
        order = np.lexsort((keys, often, owner))
        keys, owner, often = keys[order], owner[order], often[order]
        own = np.where(fresh, counts, 0)
        place = np.arange(len(keys)) - np.repeat(np.cumsum(own) - own, own)
        n = counts[owner]
        take = place < n - (SIMILAR * n + OF - 1) // OF + 1
        keys, owner, often, n = keys[take], owner[take], often[take], n[take]
        extra = np.maximum(often - counts_of.mean(), 0).astype(np.int64) // HOT + 1
        part = (mix(nodes[owner].view(np.uint64)) % extra.astype(np.uint64)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.view(np.int64)), pa.array(part), pa.array(extra > 1), pa.array(nodes[owner]), pa.array(n)],
            ["shingle", "part", "split", "node", "n"],
        )

    return _per_group(docs, make, "shingle long, part int, split boolean, node long, n long")


def _stars(prefixes: DataFrame) -> DataFrame:
    """(shingle, part, pivot, node, n) of all buckets with two nodes; the pivot is the first node of its part.

    Rows of a bucket arrive sorted and pass through one by one: a bucket is never held. A node alone in a part
    of several stays, as its partners may stand in the others: the pivots of parts are linked later.
    """
    dealt = prefixes.select("shingle", "part", "split", "node", "n").repartition("shingle", "part")
    dealt = dealt.sortWithinPartitions("shingle", "part", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, when it may still be alone in its bucket
        last, pivot = None, None
        for batch in batches:
            table = np.stack([np.asarray(c).astype(np.int64) for c in batch.columns])
            if held is not None:
                table = np.concatenate((held, table), axis=1)
            shingle, part, split, node, n = table
            new = np.ones(len(node), bool)
            new[1:] = (shingle[1:] != shingle[:-1]) | (part[1:] != part[:-1])
            if held is None and last == (shingle[0], part[0]):
                new[0] = False
            first = np.maximum.accumulate(np.where(new, np.arange(len(node)), -1))
            pivots = np.where(first >= 0, node[first], pivot if pivot is not None else 0)
            alone = new & np.append(new[1:], False) & (split == 0)
            pending = bool(new[-1]) and not split[-1]
            keep = ~alone
            if pending:
                keep[-1] = False
            held = table[:, -1:].copy() if pending else None
            last, pivot = (shingle[-1], part[-1]), pivots[-1]
            out = [shingle, part.astype(np.int32), pivots, node, n]
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in out], ["shingle", "part", "pivot", "node", "n"])

    return dealt.mapInArrow(run, "shingle long, part int, pivot long, node long, n long")


def _possible(points_a: np.ndarray, points_b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the smaller counts add up to what the sizes (sum of both) ask for."""
    return (OF + SIMILAR) * np.minimum(points_a, points_b).sum(axis=-1) >= SIMILAR * sizes


def _fine(keys: np.ndarray) -> bytes:
    """Counts of a long document's shingles in a power of two of groups."""
    groups_ = 1 << int(np.ceil(np.log2(len(keys) / PER_CELL)))
    return np.bincount((keys & np.uint64(groups_ - 1)).astype(np.int64), minlength=groups_).astype("<u4").tobytes()


def _folded(fine: np.ndarray, groups_: int) -> np.ndarray:
    """Counts in fewer groups; the low bits of a group's number name the larger one."""
    return fine.reshape(-1, groups_).sum(axis=0, dtype=np.int64)


def _finely(a: np.ndarray | None, b: np.ndarray | None, sizes: int) -> bool:
    """Whether finer points allow a pair; documents that have none are allowed."""
    if a is None or b is None:
        return True
    groups_ = min(len(a), len(b))
    return bool(_possible(_folded(a, groups_), _folded(b, groups_), sizes))


def _fines(column) -> list[np.ndarray | None]:
    return [np.frombuffer(v.as_buffer(), "<u4") if v.is_valid else None for v in column]


def _points(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, DIMS).astype(np.int64)


def _bounded(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that their points allow."""
    one = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("point").alias("pa"), F.col("fine").alias("fa"))
    two = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("point").alias("pb"), F.col("fine").alias("fb"))
    small, large = F.least("na", "nb"), F.greatest("na", "nb")
    joined = pairs.join(one, "a").join(two, "b").where(OF * small >= SIMILAR * large)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, pa_, pb, fa, fb = batch.columns
            sizes = np.asarray(na) + np.asarray(nb)
            good = _possible(_points(pa_), _points(pb), sizes)
            for i in np.flatnonzero(good).tolist():
                good[i] = _finely(*_fines([fa[i], fb[i]]), sizes[i])
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(good))

    return joined.select("a", "b", "na", "nb", "pa", "pb", "fa", "fb").mapInArrow(run, "a long, b long")


class Tree:
    """Points packed into boxes, and boxes into boxes: by level the upper corner and the sizes that occur in each."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, own: np.ndarray):
        order = own[np.argsort(sizes[own], kind="stable")]
        slab = BOX * max(1, int(np.sqrt(len(own) / BOX)))
        parts = []
        for at in range(0, len(order), slab):
            part = order[at : at + slab]
            widest = points[part].var(axis=0).argsort()[-3:]
            parts.append(part[np.lexsort(points[part][:, widest].T)])
        self.order = np.concatenate(parts)
        top, low, high = points[self.order], sizes[self.order], sizes[self.order]
        self.levels, step = [], BOX
        while not self.levels or len(low) > FAN:
            cuts = np.arange(0, len(low), step)
            top, low, high = np.maximum.reduceat(top, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            self.levels.append((top, low, high))
            step = FAN

    def box(self, i: int) -> np.ndarray:
        return self.order[i * BOX : (i + 1) * BOX]


def box_pairs(a: Tree, b: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves whose corners and sizes allow a similar pair of points, found from the top down."""
    while len(a.levels) != len(b.levels):
        short = a if len(a.levels) < len(b.levels) else b
        top, low, high = short.levels[-1]
        cuts = np.arange(0, len(low), FAN)
        short.levels.append((np.maximum.reduceat(top, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)))
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(a.levels[-1][1])), np.arange(len(b.levels[-1][1])), indexing="ij"))
    for level in range(len(a.levels) - 1, -1, -1):
        (top_a, low_a, high_a), (top_b, low_b, high_b) = a.levels[level], b.levels[level]
        fits = (OF * high_a[i] >= SIMILAR * low_b[j]) & (OF * high_b[j] >= SIMILAR * low_a[i])
        if a is b:
            fits &= i <= j
        i, j = i[fits], j[fits]
        step = _CELLS // DIMS
        fits = [_possible(top_a[i[k : k + step]], top_b[j[k : k + step]], low_a[i[k : k + step]] + low_b[j[k : k + step]]) for k in range(0, len(i), step)]
        fits = np.concatenate([np.zeros(0, bool), *fits])
        i, j = i[fits], j[fits]
        if level:
            x, y = (z.ravel() for z in np.meshgrid(np.arange(FAN), np.arange(FAN), indexing="ij"))
            i, j = (i[:, None] * FAN + x).ravel(), (j[:, None] * FAN + y).ravel()
            inside = (i < len(a.levels[level - 1][1])) & (j < len(b.levels[level - 1][1]))
            i, j = i[inside], j[inside]
    return i, j


def allowed(
    points: np.ndarray, sizes: np.ndarray, roots: np.ndarray, side: np.ndarray, fines: list[np.ndarray | None]
) -> np.ndarray:
    """For each point the number of another that chains of allowed pairs lead to, the same one for all of a chain; -1
    where there is no allowed pair. Pairs are of different roots (and sides, if there are two)."""
    label, met = np.arange(len(sizes)), np.zeros(len(sizes), bool)
    sides = [np.flatnonzero(side == s) for s in np.unique(side)]
    a = Tree(points, sizes, sides[0])
    b = a if len(sides) == 1 else Tree(points, sizes, sides[1])

    def test(x: np.ndarray, y: np.ndarray) -> None:
        apart = label[x][:, None] != label[y]  # what hangs together already needs no test
        x, y = x[apart.any(axis=1)], y[apart.any(axis=0)]
        good = _possible(points[x][:, None], points[y][None], sizes[x][:, None] + sizes[y])
        small, large = np.minimum(sizes[x][:, None], sizes[y]), np.maximum(sizes[x][:, None], sizes[y])
        good &= (OF * small >= SIMILAR * large) & (roots[x][:, None] != roots[y])
        for i, near in zip(x.tolist(), good):
            for j in y[near].tolist():
                if label[j] != label[i] and _finely(fines[i], fines[j], sizes[i] + sizes[j]):
                    met[i] = met[j] = True
                    label[label == label[j]] = label[i]

    i, j = box_pairs(a, b)
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    step = max(BOX, _CELLS // (DIMS * BOX))
    for k in np.unique(i).tolist():
        partners = np.concatenate([b.box(m) for m in j[np.searchsorted(i, k) : np.searchsorted(i, k, "right")]])
        for at in range(0, len(partners), step):
            test(a.box(k), partners[at : at + step])
    joined = np.bincount(label, weights=met, minlength=len(label)) > 0
    return np.where(joined[label], label, -1)


def _allowed_nodes(dealt: DataFrame, nodes: DataFrame) -> DataFrame:
    """(task, side, node, n, root, mate) of the nodes that may have a link to another component of their task; chains of
    allowed pairs have the same ``mate``."""
    sent = dealt.select("task", "side", "node", "n", "root").join(nodes.select("node", "point", "fine"), "node")
    sent = sent.select("task", "side", "node", "n", "root", "point", "fine").repartition("task").sortWithinPartitions("task")

    def keep(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        side, node, n, root = (table[c].to_numpy() for c in ("side", "node", "n", "root"))
        mate = allowed(_points(table["point"]), n, root, side, _fines(table["fine"]))
        cols = [table[c].combine_chunks() for c in ("task", "side", "node", "n", "root")]
        found = pa.RecordBatch.from_arrays([*cols, pa.array(node[mate])], ["task", "side", "node", "n", "root", "mate"])
        return found.filter(pa.array(mate >= 0))

    return linking.by_task(sent, keep, "task long, side int, node long, n long, root long, mate long")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every document: ``id_col``, n_shingles (long) and component_id, the smallest id that links lead to."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = stage(describe(texts), "jaccard-documents")
    rows = found.where("slot IS NULL").select("id", "n", "node", "point", "fine")
    counted = found.where("slot IS NOT NULL").groupBy("slot").agg(F.sum("slot_n").alias("n")).toPandas()
    table = np.zeros(1 << SLOT_BITS, np.int64)
    table[counted["slot"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)

    stars = stage(_stars(_prefixes(texts, table)), "jaccard-buckets")
    nodes = rows.join(stars.select("node").distinct(), "node", "left_semi")
    nodes = stage(nodes.dropDuplicates(["node"]).select("node", "n", "point", "fine"), "jaccard-nodes")
    star = stars.select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    pivots = stars.groupBy("shingle", "part").agg(F.min("pivot").alias("b"))
    tops = pivots.groupBy("shingle").agg(F.min("b").alias("a"), F.count("*").alias("k")).where("k > 1")
    star = star.union(pivots.join(tops, "shingle").select("a", "b")).where("a != b").distinct()
    near = stage(_bounded(star, nodes), "jaccard-pairs")
    sets = stage(sets_of(texts, near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), SHINGLE), "jaccard-sets")
    links = stage(linking.verified(near, sets, SIMILAR), "jaccard-links")
    discard(near, sets)
    roots = stage(components(links), "jaccard-roots")

    root = F.coalesce("root", "node").alias("root")
    placed = stars.join(roots, "node", "left").select(F.col("shingle").alias("bucket"), "node", "n", root, (F.col("part") > 0).alias("split"))
    dealt = linking.tasks(linking.open_buckets(placed), SIMILAR)
    dealt = stage(_allowed_nodes(dealt, nodes), "jaccard-allowed")
    discard(stars, nodes)
    dealt = stage(linking.regrouped(dealt), "jaccard-tasks")
    sets = stage(sets_of(texts, dealt.select("node").distinct(), SHINGLE), "jaccard-sets")
    more = stage(linking.joined(dealt, sets, SIMILAR), "jaccard-links")
    discard(dealt, sets)
    roots = stage(components(links.union(more)), "jaccard-roots")

    placed = rows.select("id", "n", "node").join(roots, "node", "left").select("id", "n", root)
    names = placed.where("n > 0").groupBy("root").agg(F.min("id").alias("component_id"))
    return placed.join(names, "root", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    )


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that name their component; the others are near copies of one of them.

    Rows that repeat such an id with the same text are kept once each; rows without an id are kept.
    """
    found = join(docs, id_col, text_col)
    copies = found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    return docs.join(copies, id_col, "left_anti").select(*docs.columns)
