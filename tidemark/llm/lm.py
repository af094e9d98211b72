"""Masked pseudo-likelihood of documents with a small bidirectional network.

Every word is a class (a bucket of its hash). A network predicts the class at a masked place from the two
classes on either side: an embedding for each place of the window, their sum through tanh, and an output in
two levels, which group of classes and which class of the group, so that probabilities of all classes add up
to 1 at a small cost. A document's score is the sum of the logarithms over all its words.

Training covers every word of every document. Each task trains on its own documents from the same start;
the networks are averaged with the number of words as weight, in a shuffle of (parameter, weighted sum), and
only the average, of fixed size, reaches the driver. More data means more tasks and more to average.

Edge cases: a missing or empty text has no words and a score of 0, and its mean is missing. Missing ids and
repeated rows are kept. Other columns play no part. An empty corpus leaves the network as it starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import groups, word_hashes

SIDE = 32
CLASSES = SIDE * SIDE
WIDTH = 16
OFFSETS = (-2, -1, 1, 2)
BATCH = 1024
RATE = 0.1
SEED = 7

_SHAPES = {
    "embed": (len(OFFSETS), CLASSES + 1, WIDTH),  # class CLASSES stands outside of the text
    "hidden": (WIDTH,), "group": (WIDTH, SIDE), "group_bias": (SIDE,),
    "member": (WIDTH, SIDE), "member_bias": (SIDE, SIDE),
}
N_PARAMETERS = sum(int(np.prod(s)) for s in _SHAPES.values())


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    """The parameters by name, as views into one array."""
    out, at = {}, 0
    for name, shape in _SHAPES.items():
        size = int(np.prod(shape))
        out[name] = flat[at : at + size].reshape(shape)
        at += size
    return out


def start() -> np.ndarray:
    flat = np.zeros(N_PARAMETERS, np.float32)
    random = np.random.default_rng(SEED)
    for name in ("embed", "group", "member"):
        own = views(flat)[name]
        own[:] = random.normal(0, 0.1, own.shape)
    return flat


def windows(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of all texts: their class, the classes around (one row an offset), words of each text."""
    hashes, counts = word_hashes(texts)
    ids = (hashes % np.uint64(CLASSES)).astype(np.int64)
    reach = max(OFFSETS)
    doc = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(ids)) + reach * (doc + 1)
    padded = np.full(len(ids) + reach * (len(counts) + 2), CLASSES, np.int64)
    padded[place] = ids
    return ids, np.stack([padded[place + k] for k in OFFSETS]), counts


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def _forward(p: dict[str, np.ndarray], ids: np.ndarray, around: np.ndarray):
    total = p["hidden"] + sum(p["embed"][k][around[k]] for k in range(len(OFFSETS)))
    h = np.tanh(total)
    group = _softmax(h @ p["group"] + p["group_bias"])
    member = _softmax(h @ p["member"] + p["member_bias"][ids // SIDE])
    return h, group, member


def log_probabilities(flat: np.ndarray, ids: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Of every word given those around it."""
    p, out = views(flat), np.empty(len(ids))
    for at in range(0, len(ids), 8192):
        own = ids[at : at + 8192]
        _, group, member = _forward(p, own, around[:, at : at + 8192])
        rows = np.arange(len(own))
        out[at : at + 8192] = np.log(group[rows, own // SIDE].astype(float) * member[rows, own % SIDE])
    return out


def train(flat: np.ndarray, seen: np.ndarray, ids: np.ndarray, around: np.ndarray) -> None:
    """One pass over words in place; ``seen`` holds the squared gradients so far."""
    p = views(flat)
    grad = np.zeros(N_PARAMETERS, np.float32)
    g = views(grad)
    for at in range(0, len(ids), BATCH):
        own, near = ids[at : at + BATCH], around[:, at : at + BATCH]
        h, group, member = _forward(p, own, near)
        rows = np.arange(len(own))
        group[rows, own // SIDE] -= 1
        member[rows, own % SIDE] -= 1
        grad[:] = 0
        g["group"][:] = h.T @ group
        g["group_bias"][:] = group.sum(axis=0)
        g["member"][:] = h.T @ member
        np.add.at(g["member_bias"], own // SIDE, member)
        back = (group @ p["group"].T + member @ p["member"].T) * (1 - h * h)
        g["hidden"][:] = back.sum(axis=0)
        for k in range(len(OFFSETS)):
            np.add.at(g["embed"][k], near[k], back)
        grad /= len(own)
        seen += grad * grad
        flat -= RATE * grad / np.sqrt(seen + 1e-8)


def fit(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The averaged network, trained on every word of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, n = start(), 0
        seen = np.zeros(N_PARAMETERS, np.float32)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in groups(texts):
                ids, around, _ = windows(texts[a:b])
                train(flat, seen, ids, around)
                n += len(ids)
        if n:
            for at in range(0, N_PARAMETERS, 1 << 14):
                part = flat[at : at + (1 << 14)].astype(float) * n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(at, at + len(part))), pa.array(part), pa.array(np.full(len(part), float(n)))],
                    ["parameter", "weighted", "n"],
                )

    rows = docs.select(text_col).mapInArrow(run, "parameter long, weighted double, n double")
    found = rows.groupBy("parameter").agg((F.sum("weighted") / F.sum("n")).alias("value")).toPandas()
    flat = start()
    flat[found["parameter"].to_numpy()] = found["value"].to_numpy(np.float32)
    return flat


def score(docs: DataFrame, network: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_words (long), log_prob (double, the sum) and mean_log_prob (double) of every text."""
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, sums = batch.column(1).to_pylist(), [], []
            for a, b in groups(texts):
                ids, around, n = windows(texts[a:b])
                logs = np.concatenate(([0.0], np.cumsum(log_probabilities(held.value, ids, around))))
                ends = np.cumsum(n)
                counts.append(n)
                sums.append(logs[ends] - logs[ends - n])
            n = np.concatenate([np.zeros(0, np.int64), *counts])
            total = np.concatenate([np.zeros(0), *sums])
            mean = pa.array(np.divide(total, n, out=np.zeros(len(n)), where=n > 0), mask=n == 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(total), mean], ["id", "n_words", "log_prob", "mean_log_prob"]
            )

    kind = plain.schema["id"].dataType.simpleString()
    out = plain.mapInArrow(run, f"id {kind}, n_words long, log_prob double, mean_log_prob double")
    return out.toDF(id_col, "n_words", "log_prob", "mean_log_prob")
