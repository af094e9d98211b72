"""Spelling variant grouping: which words differ by one letter, and what each is a variant of.

Words are counted over all texts. A word's letter counts make a point; one inserted, deleted or replaced letter moves it
by an L1 distance of at most two, so near words stand in or beside each other's box of a k-d tree.

1. ``count_words``: one pass over the texts, counts of a task before the shuffle.
2. ``fit``: k-d splits of the points, a tree for each word length, from a sample of about ``SAMPLE`` words that a hash
   chooses. The splits only say how the work is dealt out; every word is placed and searched.
3. ``route``: every word goes to the leaf that holds it, and to the leaves whose boxes a near word may stand in: at most two
   away in the tree of its own length, one away in that of the next length. Each pair of lengths meets once.
4. ``near``: a task holds the words of one leaf (or a block of ``BLOCK`` of them), splits them into small tight boxes,
   and lets the words that visit pass by. Boxes and points prune, the order of letters verifies. What leaves a task is one
   row a word: how many near words it met and the best of them.
5. ``variants``: the best near word of all tasks is the word's form if it is frequent enough; roots follow forms by
   doubling, which ends as counts grow along a chain.

Edge cases: missing and empty texts have no words; a missing id counts as an empty one in the deletion rule. Rows that
repeat an id are counted each. Words of any length are kept whole; letter counts beyond 127 count as 127, which only
makes pruning weaker. Ties of n go to the word that is smaller in code-point order. No frequent word gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage

LETTERS = "A-Za-zÀ-ÿ"
DELETE_EVERY = 199
LEAST_LENGTH = 6
LEAST_COUNT = 5
FORM_RATIO = 5
DIMS = 32
SAMPLE = 1 << 16
LEAF = 1 << 13  # words that a leaf is meant to hold
LEAST_SAMPLED = 16  # sampled words that a leaf has to hold
BLOCK = 1 << 16  # words of a leaf that one task holds
BOX = 64
_PIECE = 1 << 20
_HELD = 200_000  # words that a task counts before it hands them on
_UPPER = {c: c + 32 for c in range(65, 91)}
_AXIS = np.array([c - 97 if 97 <= c < 123 else 26 + c % 6 for c in range(256)])


def _pieces(text: str, outside: re.Pattern) -> Iterator[str]:
    """``text`` in parts of about ``_PIECE`` code points that end where no word goes on."""
    at = 0
    while at < len(text):
        end = outside.search(text, at + _PIECE)
        stop = end.end() if end else len(text)
        yield text[at:stop]
        at = stop


def words_of_text(doc_id, text: str, least: int = LEAST_LENGTH, every: int = DELETE_EVERY) -> Counter:
    """Words of a text with their counts, after the deletion rule."""
    word, outside = re.compile(f"[{LETTERS}]{{{least},}}"), re.compile(f"[^{LETTERS}]")
    raw: Counter = Counter()
    for piece in _pieces(text, outside):
        raw.update(word.findall(piece))
    out: Counter = Counter()
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in raw.items():
        run = run if run.islower() and run.isascii() else run.translate(_UPPER)
        h = zlib.crc32(run.encode(), start)
        if h % every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < least:
                continue
        out[run] += n
    return out


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                if text.is_valid:
                    held.update(words_of_text(doc_id.as_py(), text.as_py()))
                if len(held) > _HELD:
                    yield out()
                    held.clear()
        yield out()

    found = docs.select(id_col, text_col).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _coded(words) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words one after the other (all are below 256), and the words' lengths."""
    joined = "".join(words).encode("latin-1")
    return np.frombuffer(joined, np.uint8), np.array([len(w) for w in words], np.int64)


def points(words) -> np.ndarray:
    """Letter counts (DIMS x words, uint8): a dimension for each of a-z, the other letters share the rest."""
    letters, lengths = _coded(words)
    cell = _AXIS[letters] * len(lengths) + np.repeat(np.arange(len(lengths)), lengths)
    counts = np.bincount(cell, minlength=DIMS * len(lengths)).reshape(DIMS, -1)
    return np.minimum(counts, 127).astype(np.uint8)


def _cut(at: np.ndarray) -> tuple[int, int] | None:
    """(dimension, value) that halves the points best: values up to it go left; None where all points are equal."""
    best, n = None, at.shape[1]
    for d in np.flatnonzero(at.max(axis=1) > at.min(axis=1)).tolist():
        upto = np.cumsum(np.bincount(at[d]))
        value = int(np.abs(upto[:-1] - n / 2).argmin())
        off = abs(int(upto[value]) - n / 2)
        if best is None or off < best[0]:
            best = (off, d, value)
    return best and best[1:]


def split(at: np.ndarray, most: float, least: int = 1) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Leaves of a k-d tree of the points: lower and upper corners (leaves x DIMS) of their cells, and their members."""
    low, high, members = [], [], []
    todo = [(np.arange(at.shape[1]), np.zeros(DIMS, np.uint8), np.full(DIMS, 127, np.uint8))]
    while todo:
        own, lo, hi = todo.pop()
        cut = _cut(at[:, own]) if len(own) > most and len(own) >= 2 * least else None
        if cut is None:
            low.append(lo), high.append(hi), members.append(own)
            continue
        d, value = cut
        left = at[d, own] <= value
        to_left, to_right = hi.copy(), lo.copy()
        to_left[d], to_right[d] = value, value + 1
        todo += [(own[left], lo, to_left), (own[~left], to_right, hi)]
    return np.array(low), np.array(high), members


def box_distance(at: np.ndarray, low: np.ndarray, high: np.ndarray, most: int) -> np.ndarray:
    """L1 distances (points x boxes) from points to boxes, right up to ``most`` and larger than it beyond."""
    out = np.zeros((at.shape[1], len(low)), np.uint8)
    for d in range(DIMS):
        x, lo, hi = at[d][:, None], low[:, d], high[:, d]
        if lo.any():
            out += np.minimum(np.maximum(lo, x) - x, most + 1)
        if (hi < 127).any():
            out += np.minimum(x - np.minimum(hi, x), most + 1)
    return out


class Forest:
    """Cells of a k-d tree for each word length, numbered one after the other."""

    def __init__(self, sample: list[str], sizes: dict[int, int]):
        by_length: dict[int, list[str]] = {}
        for word in sample:
            by_length.setdefault(len(word), []).append(word)
        self.cells: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        self.count = 0
        for length in sorted(sizes):
            own = by_length.get(length, [])
            most = LEAF * len(own) / sizes[length]
            low, high, _ = split(points(own), most, LEAST_SAMPLED)
            self.cells[length] = (self.count, low, high)
            self.count += len(low)

    def visited(self, length: int, at: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, cell) of all cells of ``length`` that are at most ``radius`` away."""
        if length not in self.cells or not at.shape[1]:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first, low, high = self.cells[length]
        step = max(1, (1 << 22) // len(low))
        found = [(a, *np.nonzero(box_distance(at[:, a : a + step], low, high, radius) <= radius)) for a in range(0, at.shape[1], step)]
        return np.concatenate([a + i for a, i, _ in found]), first + np.concatenate([j for _, _, j in found])


def fit(words: DataFrame) -> Forest:
    sizes = {r.length: r["count"] for r in words.groupBy(F.length("word").alias("length")).count().collect()}
    share = min(1.0, SAMPLE / max(1, sum(sizes.values())))
    chosen = words.where(F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(share * (1 << 20))).select("word")
    return Forest([r.word for r in chosen.collect()], sizes)


def _batches(batches: Iterator[pa.RecordBatch], most: int = 1 << 13):
    """(words, n) of at most ``most`` rows of one length each."""
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            part = batch.slice(at, most)
            words, n = part.column(part.num_columns - 2).to_pylist(), np.asarray(part.column(part.num_columns - 1))
            lengths = np.array([len(w) for w in words])
            for length in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == length)
                yield length, [words[i] for i in own], n[own]


def _home(forest: Forest, length: int, words: list[str], at: np.ndarray) -> np.ndarray:
    i, cell = forest.visited(length, at, 0)
    home = np.empty(len(words), np.int64)
    home[i] = cell
    return home


def route(words: DataFrame, forest: Forest) -> DataFrame:
    """(task, visits, word, n): every word in its own leaf, and as a visitor where near words may stand."""

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for length, own, n in _batches(batches):
            home = _home(forest, length, own, points(own))
            cell, count = np.unique(home, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(count)], ["cell", "n"])

    placed = words.select("word", "n").mapInArrow(homes, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    blocks = np.ones(forest.count + 1, np.int64)
    for row in placed.collect():  # one row a leaf
        blocks[row.cell] = -(-row.n // BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for length, own, n in _batches(batches):
            at = points(own)
            home = _home(forest, length, own, at)
            block = np.array([zlib.crc32(w.encode()) for w in own], np.int64) % blocks[home]
            i, cell = forest.visited(length, at, 2)
            j, following = forest.visited(length + 1, at, 1)
            later = cell >= home[i]
            i, cell = np.concatenate((i[later], j)), np.concatenate((cell[later], following))
            spread = blocks[cell]
            i, cell = np.repeat(i, spread), np.repeat(cell, spread)
            part = np.arange(len(i)) - np.repeat(np.cumsum(spread) - spread, spread)
            keep = (cell != home[i]) | (part > block[i])
            i, cell, part = i[keep], cell[keep], part[keep]
            rows = np.concatenate((np.arange(len(own)), i))
            task = np.concatenate((home << 20 | block, cell << 20 | part))
            visits = np.concatenate((np.zeros(len(own), bool), np.ones(len(i), bool)))
            names = pa.array(own, pa.string()).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(task), pa.array(visits), names, pa.array(n[rows])], ["task", "visits", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "task long, visits boolean, word string, n long")


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of letters differ by one replaced letter, or ``b`` has one more than ``a``."""
    length = a.shape[1]
    if b.shape[1] == length:
        return (a != b).sum(axis=1) == 1
    front, back = a != b[:, :length], (a != b[:, 1:])[:, ::-1]
    upto = np.where(front.any(axis=1), front.argmax(axis=1), length)
    since = np.where(back.any(axis=1), back.argmax(axis=1), length)
    return upto + since >= length


class Leaf:
    """Words of one length in small tight boxes, to be searched by others."""

    def __init__(self, words: list[str], n: np.ndarray):
        at = points(words)
        _, _, boxes = split(at, BOX)
        order = np.concatenate(boxes)
        self.words, self.n, self.points = [words[i] for i in order], n[order], np.ascontiguousarray(at[:, order])
        self.letters = _coded(self.words)[0].reshape(len(words), -1)
        self.ends = np.cumsum([0, *map(len, boxes)])
        self.low = np.array([at[:, b].min(axis=1) for b in boxes])
        self.high = np.array([at[:, b].max(axis=1) for b in boxes])

    def search(self, at: np.ndarray, letters: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(visitor, word) pairs one edit apart."""
        visitors, found = [], []
        near = box_distance(at, self.low, self.high, radius) <= radius
        for box in np.flatnonzero(near.any(axis=0)).tolist():
            a, b = self.ends[box], self.ends[box + 1]
            who = np.flatnonzero(near[:, box])
            distance = np.zeros((len(who), b - a), np.uint8)
            for d in np.flatnonzero(self.high[box]).tolist():  # other letters are not in the box
                x, y = at[d, who][:, None], self.points[d, a:b]
                distance += np.maximum(x, y) - np.minimum(x, y)
            rest = np.flatnonzero(self.high[box] == 0)
            distance += at[np.ix_(rest, who)].sum(axis=0).clip(0, 3).astype(np.uint8)[:, None]
            i, j = np.nonzero(distance <= radius)
            i, j = who[i], a + j
            step = max(1, (1 << 22) // max(1, letters.shape[1]))
            for at_ in range(0, len(i), step):
                x, y = i[at_ : at_ + step], j[at_ : at_ + step]
                good = one_edit(letters[x], self.letters[y])
                visitors.append(x[good]), found.append(y[good])
        empty = np.zeros(0, np.int64)
        return np.concatenate([empty, *visitors]), np.concatenate([empty, *found])


def _best(own: list[str], to: list[str], n: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """Of every word in ``own`` that has a near one (i, j): how many it has, and the most frequent, of equal ones the smallest."""
    rank = np.empty(len(to), np.int64)
    rank[np.array(sorted(range(len(to)), key=to.__getitem__), np.int64)] = np.arange(len(to))
    order = np.lexsort((rank[j], -n[j], i))
    i, j = i[order], j[order]
    first = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else i
    counts = np.diff(np.append(first, len(i)))
    cols = [pa.array([own[k] for k in i[first]], pa.string()), pa.array(counts), pa.array([to[k] for k in j[first]], pa.string()), pa.array(n[j[first]])]
    return pa.RecordBatch.from_arrays(cols, ["word", "n_near", "form", "form_n"])


def near(routed: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n): near words of a word that its tasks have found, and the best of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_task, held, leaf = None, [], None

        def close() -> Leaf:
            words = pa.chunked_array([b.column(2) for b in held]).to_pylist()
            return Leaf(words, np.concatenate([np.asarray(b.column(3)) for b in held]))

        def among(leaf: Leaf):
            for a in range(0, len(leaf.words), 1 << 13):
                part = slice(a, a + (1 << 13))
                i, j = leaf.search(leaf.points[:, part], leaf.letters[part], 2)
                i, j = a + i[a + i < j], j[a + i < j]  # each pair once
                yield _best(leaf.words, leaf.words, leaf.n, i, j)
                yield _best(leaf.words, leaf.words, leaf.n, j, i)

        for batch in batches:
            task = np.asarray(batch.column(0)) * 2 + np.asarray(batch.column(1)).astype(np.int64)
            cuts = np.concatenate(([0], np.flatnonzero(task[1:] != task[:-1]) + 1, [len(task)])) if len(task) else [0]
            for a, b in zip(cuts[:-1], cuts[1:]):
                part, number, visits = batch.slice(a, b - a), int(task[a]) >> 1, int(task[a]) & 1
                if number != at_task:
                    if held:
                        yield from among(close())
                    at_task, held, leaf = number, [], None
                if not visits:
                    held.append(part)
                    continue
                if held:
                    leaf, held = close(), []
                    yield from among(leaf)
                if leaf is None:
                    continue  # no word lives here
                for length, words, n in _batches([part]):
                    letters = _coded(words)[0].reshape(len(words), -1)
                    i, j = leaf.search(points(words), letters, 2 if length == leaf.letters.shape[1] else 1)
                    yield _best(words, leaf.words, leaf.n, i, j)
                    yield _best(leaf.words, words, n, j, i)
        if held:
            yield from among(close())

    sent = routed.repartition("task").sortWithinPartitions("task", "visits")
    return sent.mapInArrow(run, "word string, n_near long, form string, form_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of all words that have a form, by doubling."""
    now = stage(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        after = stage(joined, "spelling-roots")
        if not after.where("moved").limit(1).count():
            return after.select("word", "root")
        now = after.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every frequent word: word, form, root, n, n_near and form_n."""
    words = stage(count_words(docs, id_col, text_col), "spelling-words")
    found = near(route(words, fit(words)))
    best = F.min(F.struct((-F.col("form_n")).alias("order"), "form")).alias("best")
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    joined = words.join(found, "word", "left")
    form_n = -F.col("best.order")
    is_form = form_n >= FORM_RATIO * F.col("n")
    rows = stage(joined.select(
        "word", F.when(is_form, F.col("best.form")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, form_n).alias("form_n"),
    ), "spelling-forms")
    roots = _roots(rows.where("form IS NOT NULL"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
