"""Links between word sets that share buckets, without a row for each pair.

A bucket holds the nodes (distinct sets) that some key brings together; a pair of similar sets has a bucket in
common. First every node of a bucket meets the bucket's smallest node (``stars``): a group of copies becomes
one component there, linear in its size. Only buckets that still hold two components and a pair nobody has looked
at go on (``open_buckets``). Their nodes are dealt into tasks (``tasks``):

* a chain of open buckets whose sets are together at most ``WEIGHT`` long is one task, so that a node is sent once;
* of longer chains every bucket is a task;
* a bucket that is longer itself is cut into bands of set sizes, and these into blocks of about ``WEIGHT`` / 2 by a
  hash of the node; any two blocks whose sizes allow a link meet in one task.

A task holds its sets alone and returns the links of a spanning forest (``forest``): its pairs never become rows.

Edge cases: empty inputs give no links; equal sets are one node and play no part here; a set longer than ``WEIGHT``
makes blocks of its own. Repeated rows of a bucket count once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage
from .components import components

OF = 100
WEIGHT = 1 << 21  # set members that a task holds


def similar(inter, a, b, share: int):
    """Whether ``inter`` common members of sets of sizes ``a`` and ``b`` make ``share`` in 100 of their union."""
    return OF * inter >= share * (a + b - inter)


def verified(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The pairs (a, b) whose sets (node, set) are similar."""
    one = sets.select(F.col("node").alias("a"), F.col("set").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                good.append(similar(int((both[1:] == both[:-1]).sum()), len(x), len(y), share))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def open_buckets(placed: DataFrame) -> DataFrame:
    """(bucket, node, n, root, k, weight) of buckets with two components and a pair that no star has held together.

    ``placed`` has (bucket, node, n, root, split): ``split`` where a bucket has several stars. Of buckets with the same
    nodes one is enough; k is the number of nodes and weight the length of all sets.
    """
    nodes = F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("nodes")
    buckets = placed.groupBy("bucket").agg(
        F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("k"), F.sum("n").alias("weight"),
        F.max("split").alias("split"), nodes,
    )
    open_ = buckets.where("x != y AND (k > 2 OR split)").groupBy("k", "weight", "nodes").agg(F.min("bucket").alias("bucket"))
    return placed.join(open_.select("bucket", "k", "weight"), "bucket").select("bucket", "node", "n", "root", "k", "weight")


def _chains(buckets: DataFrame) -> DataFrame:
    """(root, chain): which components open buckets bring together."""
    first = buckets.groupBy("bucket").agg(F.min("root").alias("b"))
    edges = buckets.join(first, "bucket").select(F.col("root").alias("a"), "b").distinct()
    return components(edges).select(F.col("node").alias("root"), F.col("root").alias("chain"))


def _blocks(large: DataFrame, share: int) -> DataFrame:
    """Tasks of pairs of blocks of the buckets in ``large``: (task, side, same, node, n, root)."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(OF / share)) + 1e-9)
    own = large.select("bucket", "node", "n", "root", band.alias("band"))
    bands = own.groupBy("bucket", "band").agg(F.ceil(F.sum("n") / F.lit(WEIGHT // 2)).cast("int").alias("blocks"))
    own = own.join(bands, ["bucket", "band"]).withColumn("block", F.pmod(F.xxhash64(F.lit(7), "node"), "blocks").cast("int"))
    one = bands.select("bucket", F.col("band").alias("band1"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block1"))
    two = bands.select("bucket", F.col("band").alias("band2"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block2"))
    meet = one.join(two, "bucket").where("(band1 = band2 AND block1 <= block2) OR band2 = band1 + 1")
    task = F.xxhash64("bucket", "band1", "block1", "band2", "block2").alias("task")
    same = F.expr("band1 = band2 AND block1 = block2").alias("same")
    sides = [
        meet.select("bucket", F.col(f"band{s}").alias("band"), F.col(f"block{s}").alias("block"), task, F.lit(s).alias("side"), same)
        for s in (1, 2)
    ]
    return (
        sides[0].union(sides[1]).where("side = 1 OR NOT same").join(own, ["bucket", "band", "block"])
        .select("task", "side", "same", "node", "n", "root")
    )


def tasks(buckets: DataFrame, share: int) -> DataFrame:
    """(task, side, same, node, n, root): the nodes of open buckets, dealt out as the module says."""
    buckets = stage(buckets, "open-buckets")
    chained = buckets.join(_chains(buckets), "root")
    nodes = chained.select("chain", "node", "n", "root").distinct()
    size = nodes.groupBy("chain").agg(F.sum("n").alias("sum"))
    whole = nodes.join(size.where(F.col("sum") <= WEIGHT).select("chain"), "chain")
    whole = whole.select(F.xxhash64("chain").alias("task"), F.lit(1).alias("side"), F.lit(True).alias("same"), "node", "n", "root")
    rest = chained.join(size.where(F.col("sum") > WEIGHT).select("chain"), "chain")
    single = rest.where(F.col("weight") <= WEIGHT).select(
        F.xxhash64(F.lit(1), "bucket").alias("task"), F.lit(1).alias("side"), F.lit(True).alias("same"), "node", "n", "root"
    )
    return whole.union(single).union(_blocks(rest.where(F.col("weight") > WEIGHT), share))


def regrouped(dealt: DataFrame) -> DataFrame:
    """Tasks (task, side, node, root) by chains of possible pairs, a node once, where the chain is no longer than ``WEIGHT``.

    ``dealt`` has (task, side, node, n, root, mate): within a task, possible pairs have the same ``mate``. Nodes of longer
    chains stay in the tasks they are in.
    """
    chains = components(dealt.select(F.col("node").alias("a"), F.col("mate").alias("b")).distinct())
    chained = dealt.join(chains.select("node", F.col("root").alias("chain")), "node")
    nodes = chained.select("chain", "node", "n", "root").distinct()
    size = nodes.groupBy("chain").agg(F.sum("n").alias("sum"))
    whole = nodes.join(size.where(F.col("sum") <= WEIGHT).select("chain"), "chain")
    rest = chained.join(size.where(F.col("sum") > WEIGHT).select("chain"), "chain")
    return whole.select(F.xxhash64("chain").alias("task"), F.lit(1).alias("side"), "node", "root").union(
        rest.select("task", "side", "node", "root")
    )


def forest(sets: list[np.ndarray], roots: np.ndarray, side: np.ndarray, share: int) -> list[tuple[int, int]]:
    """Index pairs of similar sets that join all components of ``sets`` which links join.

    Sets with the same number in ``roots`` are known to hang together. Where ``side`` has two values, only links between
    the sides are asked for. A set is held against all others once at most, and only while it is outside of the
    largest component: whatever links it is found then. Overlaps of a few sets with all are products of 0/1 matrices.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    group = np.unique(roots, return_inverse=True)[1]
    if n < 2 or group.max() == 0:
        return []
    members, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    _, number, often = np.unique(members, return_inverse=True, return_counts=True)
    shared = often[number] > 1  # members of one set only join nothing
    number, owner = number[shared], owner[shared]
    begin = np.searchsorted(owner, np.arange(n + 1))
    two = side.min() != side.max()
    exact = np.float32 if sizes.max() < 1 << 24 else np.float64
    column = np.full(len(often), -1, np.int64)
    links, todo, most = [], np.ones(n, bool), 1
    while True:
        left = np.flatnonzero(todo & (group != np.bincount(group).argmax()))
        if not len(left):
            return links
        held = left[: max(1, int(np.searchsorted(np.cumsum(sizes[left]), WEIGHT)))][:most]
        most = min(2 * most, 128)
        todo[held] = False
        used = np.unique(np.concatenate([number[begin[i] : begin[i + 1]] for i in held]))
        if not len(used):
            continue
        column[used] = np.arange(len(used))

        def matrix(low: int, high: int) -> np.ndarray:
            at = slice(begin[low], begin[high])
            place = column[number[at]]
            out = np.zeros((high - low, len(used)), exact)
            out[owner[at][place >= 0] - low, place[place >= 0]] = 1
            return out

        own = np.concatenate([matrix(i, i + 1) for i in held])
        rows = max(1, (WEIGHT * 4) // len(used))
        inter = np.concatenate([own @ matrix(low, min(low + rows, n)).T for low in range(0, n, rows)], axis=1).astype(np.int64)
        column[used] = -1
        good = similar(inter, sizes[held][:, None], sizes, share)
        for i, near in zip(held.tolist(), good):
            if two:
                near &= side != side[i]
            others = np.flatnonzero(near & (group != group[i]))
            for j in others[np.unique(group[others], return_index=True)[1]].tolist():
                links.append((i, j))
                group[group == group[j]] = group[i]


def joined(dealt: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Links (a, b) that the tasks in ``dealt`` find between the sets (node, set)."""
    sent = dealt.select("task", "side", "node", "root").join(sets, "node").select("task", "side", "node", "root", "set")
    sent = sent.repartition("task").sortWithinPartitions("task")

    def links(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        side, node, root = (table[c].to_numpy() for c in ("side", "node", "root"))
        own = [np.frombuffer(v.as_buffer(), np.uint64) for chunk in table["set"].chunks for v in chunk]
        found = np.array(forest(own, root, side, share), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(node[found[:, 0]]), pa.array(node[found[:, 1]])], ["a", "b"])

    return by_task(sent, links, "a long, b long")


def by_task(sent: DataFrame, make: Callable[[list[pa.RecordBatch]], pa.RecordBatch], schema: str) -> DataFrame:
    """``make`` over the rows of every task; ``sent`` is sorted by its first column, the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            task = np.asarray(batch.column(0))
            cuts = np.concatenate(([0], np.flatnonzero(task[1:] != task[:-1]) + 1, [len(task)]))
            for a, b in zip(cuts[:-1], cuts[1:]):
                if held and task[a] != at:
                    yield make(held)
                    held = []
                at = task[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield make(held)

    return sent.mapInArrow(run, schema)
