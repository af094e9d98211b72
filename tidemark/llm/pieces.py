"""SentencePiece encoding and decoding with a batched Viterbi in numpy.

Within a batch of documents the distinct words are gathered, grouped by length and advanced together, one
position a step: hashes of the substrings that end there probe the sorted hashes of the pieces, hits are
compared character by character, and the maximum over the starts gives the backpointer. Ties go to the
longest piece. That is the segmentation of the highest total score, what the library gives for a unigram
table. A character in no piece becomes its bytes where the model has byte pieces, else the unknown id.

Scores of a merge (BPE) table are ranks, and their highest sum is not what such a model means: it cuts
frequent words into early pieces. For such a table ``how="merge"`` takes, in the same groups and from the
same probes, the best adjacent pair of every word in each step, which gives the library's ids. The
default follows the kind that the model file states.

Words are cut before each run of spaces and around characters of no piece, which no piece can cross;
``Model`` refuses a piece that would. The normalizer has to be the identity, spaces become U+2581, one
is put in front of the text, and decoding takes it off again.

Edge cases: a missing or empty text has no ids and decodes to the empty text. A text that holds U+2581
itself comes back with spaces there. Repeated rows and missing ids are kept; a clashing column name
gets underscores in front of the new one. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .hashing import parts
from .tables import unused

SPACE = "▁"
KEPT_BYTES = 192 << 20  # of words that a worker remembers with both ways' ids, and keeps while it runs other stages; of one way a third
_ENTRY = 350  # bytes that a word takes beside its letters and ids
LONG_WORD = 64
_CELLS = 2_000_000  # of the score table at once
_BASE = np.uint64(0x100000001B3)
_SPREAD, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(46)  # of a hash, to one of 2 ** 18 marks
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6
UNKNOWN_PENALTY = 10.0


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _message(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a serialized message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = (8, at) if kind == 1 else (4, at) if kind == 5 else _varint(data, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def _letters(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)


class Model:
    def __init__(self, path: str):
        with open(path, "rb") as file:
            data = file.read()
        self.text: list[str] = []
        scores, kinds, normal = [], [], {}
        for number, value in _message(data):
            if number == 1:
                piece = dict(_message(value))
                self.text.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, _NORMAL))
            elif number == 2:
                self.kind = {1: "viterbi", 2: "merge"}[dict(_message(value)).get(3, 1)]
            elif number == 3:
                normal = dict(_message(value))
        if normal.get(1, b"") != b"identity" or normal.get(4, 1):
            raise ValueError("only models with the identity normalizer that keep white space are read")
        self.prefix = bool(normal.get(3, 1))
        usable = [i for i, k in enumerate(kinds) if k in (_NORMAL, _USER)]
        if any(re.search(f"[^{SPACE}]{SPACE}", self.text[i]) for i in usable):
            raise ValueError("a piece goes on after a word's end")
        self.scores = np.array(scores, np.float64)
        self.unknown = kinds.index(_UNKNOWN)
        self.unknown_score = float(self.scores[usable].min()) - UNKNOWN_PENALTY
        self.byte_ids = {int(self.text[i][3:5], 16): i for i, k in enumerate(kinds) if k == _BYTE}
        self.raw = [bytes([int(t[3:5], 16)]) if k == _BYTE else t.encode() for t, k in zip(self.text, kinds)]
        self.raw = [b"" if k == 3 else r for r, k in zip(self.raw, kinds)]
        self.alphabet = {c for i in usable for c in self.text[i]}
        self.by_text = {self.text[i]: i for i in usable}
        self.longest = max(len(self.text[i]) for i in usable)
        # by length: sorted hashes, the piece of each and its characters, and marks that most hashes of no piece miss
        self.tables = {}
        for size in range(1, self.longest + 1):
            own = [i for i in usable if len(self.text[i]) == size]
            if own:
                chars = np.array([[ord(c) for c in self.text[i]] for i in own], np.uint32)
                key = np.zeros(len(own), np.uint64)
                for k in range(size):
                    key = key * _BASE + chars[:, k]
                order = np.argsort(key)
                marks = np.zeros(1 << 64 - int(_SHIFT), bool)
                marks[key * _SPREAD >> _SHIFT] = True
                self.tables[size] = (key[order], np.array(own)[order], chars[order], marks)

    def _probe(self, chars: np.ndarray, key: np.ndarray, begin: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces whose characters start at the columns ``begin``: the row, the start and the id of each."""
        keys, ids, text, marks = self.tables[size]
        row, col = np.divmod(np.flatnonzero(marks[key * _SPREAD >> _SHIFT]), max(1, key.shape[1]))
        own, start = key[row, col], begin[col]
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        same = keys[at] == own
        for k in range(size):
            same &= chars[row, start + k] == text[at, k]
        return row[same], start[same], ids[at[same]]

    def _by_start(self, words: list[str]) -> np.ndarray:
        """The piece (or -1) at every start and of every size in words of one length."""
        length = len(words[0])
        most = min(self.longest, length)
        chars = _letters(words)
        which = np.full((len(words), length, most + 1), -1, np.int32)
        key = np.zeros((len(words), length), np.uint64)
        for size in range(1, most + 1):
            begin = np.arange(length - size + 1)
            key = key[:, : len(begin)] * _BASE + chars[:, size - 1 : size - 1 + len(begin)]
            if size in self.tables:
                row, start, ids = self._probe(chars, key, begin, size)
                which[row, start, size] = ids
        return which

    def _short(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``_viterbi``, from the pieces by start."""
        n, length, most = which.shape[0], which.shape[1], which.shape[2] - 1
        score = np.append(self.scores, -np.inf)[which]  # the last, at -1, is that of no piece
        score[:, :, 1][which[:, :, 1] < 0] = self.unknown_score
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0
        back, piece = np.zeros((n, length + 1), np.int16), np.zeros((n, length + 1), np.int32)
        rows = np.arange(n)
        for end in range(1, length + 1):
            sizes = np.arange(min(most, end), 0, -1)  # of equals the longest
            total = best[:, end - sizes] + score[:, end - sizes, sizes]
            take = sizes[total.argmax(axis=1)]
            best[:, end] = total.max(axis=1)
            back[:, end] = take
            piece[:, end] = which[rows, end - take, take]
        return self._traced(back, piece)

    @staticmethod
    def _traced(back: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other and their numbers, from the last piece of each to the first."""
        n, length = back.shape[0], back.shape[1] - 1
        at, rows = np.full(n, length, np.int64), np.arange(n)
        ids, used = np.zeros((n, length), np.int32), np.zeros((n, length), bool)
        while len(rows):
            own = at[rows]
            size, found = back[rows, own], piece[rows, own]
            ids[rows, own - size] = np.where(found >= 0, found, -own)
            used[rows, own - size] = True
            at[rows] = own - size
            rows = rows[at[rows] > 0]
        return ids[used], used.sum(axis=1)

    def _viterbi(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Best pieces of words of one length, one word after the other, and their numbers; a character of no piece is
        -1 - its position."""
        n, length, most = len(words), len(words[0]), min(self.longest, len(words[0]))
        chars = _letters(words)
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0
        back, piece = np.zeros((n, length + 1), np.int16), np.zeros((n, length + 1), np.int32)
        step = max(most, _CELLS // (n * most))
        rows = np.arange(n)
        for low in range(0, length, step):
            high = min(length, low + step)
            # score[:, e - low, j]: the piece of length most - j that ends behind position e
            score = np.full((n, high - low, most), -np.inf)
            which = np.full((n, high - low, most), -1, np.int32)
            first = max(0, low - most + 1)
            key = np.zeros((n, high - first), np.uint64)
            for size in range(1, most + 1):
                begin = np.arange(first, high - size + 1)
                if not len(begin):
                    break
                key = key[:, : len(begin)] * _BASE + chars[:, first + size - 1 : first + size - 1 + len(begin)]
                if size in self.tables:
                    use = begin + size - 1 >= low
                    row, start, ids = self._probe(chars, key[:, use], begin[use], size)
                    ends = start + size - 1 - low
                    which[row, ends, most - size] = ids
                    score[row, ends, most - size] = self.scores[ids]
            alone = which[:, :, most - 1] < 0
            score[:, :, most - 1][alone] = self.unknown_score
            for end in range(low, high):
                sizes = min(most, end + 1)
                total = best[:, end + 1 - sizes : end + 1] + score[:, end - low, most - sizes :]
                take = total.argmax(axis=1)
                best[:, end + 1] = total[rows, take]
                back[:, end + 1] = sizes - take
                piece[:, end + 1] = which[rows, end - low, most - sizes + take]
        return self._traced(back, piece)

    def _merge(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of words of one length by merging the best pair, the leftmost of equals, again and again; as ``_viterbi``."""
        n, length, most = which.shape[0], which.shape[1], which.shape[2] - 1
        flat, score = which.ravel(), np.append(self.scores, -np.inf)  # as in ``_short``
        size = np.ones((n, length + 1), np.int64)  # of the segment that starts here; 0 inside of one
        size[:, length] = most  # no pair reaches over the end
        active, starts = np.arange(n), np.arange(length)
        while len(active):
            whole = size[active]
            own = whole[:, :length]
            follow = np.minimum(starts + own, length)
            both = own + np.take_along_axis(whole, follow, 1)
            fits = (own > 0) & (both <= most) & (follow < length)
            # a piece of size 0 is none
            pair = score[flat[(active[:, None] * length + starts) * (most + 1) + np.where(fits, both, 0)]]
            at = pair.argmax(axis=1)
            rows = np.arange(len(active))
            good = pair[rows, at] > -np.inf
            active, at, rows = active[good], at[good], rows[good]
            size[active, follow[rows, at]] = 0
            size[active, at] = both[rows, at]
        used = size[:, :length] > 0
        row, begin = np.nonzero(used)
        ids = which[row, begin, size[row, begin]]
        return np.where(ids >= 0, ids, -1 - begin).astype(np.int32), used.sum(axis=1)

    def _merge_long(self, word: str) -> list[int]:
        """The same for one long word, with a heap of pairs."""
        after = list(range(1, len(word) + 1))
        before = list(range(-1, len(word) - 1))
        part: list[str | None] = list(word)
        heap: list[tuple[float, int, str]] = []

        def offer(left: int) -> None:
            if left >= 0 and after[left] < len(word):
                both = part[left] + part[after[left]]
                if both in self.by_text:
                    heapq.heappush(heap, (-self.scores[self.by_text[both]], left, both))

        for left in range(len(word)):
            offer(left)
        while heap:
            _, left, both = heapq.heappop(heap)
            right = after[left]
            if part[left] is None or right >= len(word) or part[left] + part[right] != both:
                continue
            part[left], part[right] = both, None
            after[left] = after[right]
            if after[right] < len(word):
                before[after[right]] = left
            offer(before[left])
            offer(left)
        return [self.by_text.get(p, -1 - at) for at, p in enumerate(part) if p is not None]

    def encode_words(self, words: list[str], how: str | None = None) -> list[list[bytes]]:
        """Ids (as little-endian 32-bit integers) of words in which spaces are U+2581 already, a list for each way in
        ``how`` (both: Viterbi, then merges)."""
        how = how or self.kind
        ways = {"both": ("viterbi", "merge")}.get(how, (how,))
        out: list[list[bytes]] = [[b""] * len(words) for _ in ways]
        by_length: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            if word:
                by_length.setdefault(len(word), []).append(i)

        def step(part: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
            if len(part[0]) <= LONG_WORD:
                which = self._by_start(part)  # one probe of the pieces for all ways
                return [self._short(which) if way == "viterbi" else self._merge(which) for way in ways]
            merged = [self._merge_long(w) for w in part] if "merge" in ways else []
            flat = np.array([i for ids in merged for i in ids], np.int32), np.array([len(ids) for ids in merged])
            return [self._viterbi(part) if way == "viterbi" else flat for way in ways]

        for length, own in by_length.items():
            most = max(1, _CELLS // (length * min(self.longest, length)))
            for at in range(0, len(own), most):
                part = own[at : at + most]
                for found, (flat, counts) in zip(out, step([words[i] for i in part])):
                    ends = np.cumsum(counts)
                    data, stops = flat.astype("<i4").tobytes(), (4 * ends).tolist()
                    for i, begin, end in zip(part, [0, *stops], stops):
                        found[i] = data[begin:end]
                    if (flat < 0).any():
                        for k in np.unique(np.searchsorted(ends, np.flatnonzero(flat < 0), side="right")).tolist():
                            ids = self._bytes(words[part[k]], flat[ends[k] - counts[k] : ends[k]].tolist())
                            found[part[k]] = np.array(ids, "<i4").tobytes()
        return out

    def _bytes(self, word: str, ids: list[int]) -> list[int]:
        done = []
        for piece in ids:
            if piece >= 0:
                done.append(piece)
            elif self.byte_ids:
                done += [self.byte_ids[b] for b in word[-piece - 1].encode()]
            else:
                done.append(self.unknown)
        return done

    def decode(self, ids) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def model_at(path: str) -> Model:
    return Model(path)


class Encoder:
    """A model with the ids of words met before; ``how`` is viterbi, merge, both, or None for what the model states."""

    def __init__(self, path: str, how: str | None = None):
        self.model, self.how = model_at(path), how
        self.words: list[dict[str, bytes]] = [{} for _ in range(2 if how == "both" else 1)]
        self.held = 0
        breaks = "\n" if "\n" not in self.model.alphabet else ""
        self.cut = re.compile(f"\n|{SPACE}*[^{SPACE}{breaks}]+|{SPACE}+" if breaks else f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def encode_ways(self, texts: list[str]) -> list[list[np.ndarray]]:
        """Ids of all texts, a list for each way."""
        if self.held > (KEPT_BYTES if len(self.words) > 1 else KEPT_BYTES // 3):
            self.words, self.held = [{} for _ in self.words], 0
        front = SPACE if self.model.prefix else ""
        split = [self.cut.findall(front + t.replace(" ", SPACE)) if t else [] for t in texts]
        fresh = list(set().union(*split).difference(self.words[0]))
        for known, found in zip(self.words, self.model.encode_words(fresh, self.how)):
            known.update(zip(fresh, found))
            self.held += sum(map(len, found))
        self.held += _ENTRY * len(fresh) + 2 * sum(map(len, fresh))
        return [[np.frombuffer(b"".join(map(known.__getitem__, words)), np.int32) for words in split] for known in self.words]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.encode_ways(texts)[0]


@lru_cache(maxsize=2)
def encoder(path: str, how: str | None = None) -> Encoder:
    return Encoder(path, how)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.concatenate([np.zeros(0, np.int32), *rows]))


def _added(df: DataFrame, column: str, make, names: list[str], kinds: list[T.DataType]) -> DataFrame:
    """``df`` with columns that ``make`` derives from ``column``, about a megabyte at a time."""
    taken = list(df.columns)
    place = taken.index(column)
    plain = df.toDF(*[f"c{i}" for i in range(len(taken))])
    schema = T.StructType([*plain.schema.fields, *(T.StructField(f"made{i}", kind) for i, kind in enumerate(kinds))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            column = whole.column(place)
            texts = pa.types.is_string(column.type)
            for a, b in parts(column) if texts else ((at, at + 256) for at in range(0, whole.num_rows, 256)):
                batch = whole.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*batch.columns, *make(batch.column(place))], schema.names)

    added = []
    for name in names:
        added.append(unused(name, taken + added))
    return plain.mapInArrow(run, schema).toDF(*taken, *added)


_IDS = T.ArrayType(T.IntegerType())


def encode(df: DataFrame, model: str, text_col: str = "text", name: str = "ids", how: str | None = None) -> DataFrame:
    """``df`` with the ids (array of int) of its whole texts; ``how`` is viterbi, merge or what the model states."""

    def make(texts: pa.Array) -> list[pa.Array]:
        return [_lists(encoder(model, how).encode([t or "" for t in texts.to_pylist()]))]

    return _added(df, text_col, make, [name], [_IDS])


def decode(df: DataFrame, model: str, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """``df`` with the text of its ids; missing ids decode to the empty text."""

    def make(ids: pa.Array) -> list[pa.Array]:
        text = model_at(model).decode
        return [pa.array([text(i or ()) for i in ids.to_pylist()], pa.string())]

    return _added(df, ids_col, make, [name], [T.StringType()])


def encode_and_check(df: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """``df`` with ids (Viterbi), merged (merges, as the model's library gives them for a merge table), and round_trip:
    whether both decode to the text. One pass: the pieces of a word are probed once for both ways."""

    def make(texts: pa.Array) -> list[pa.Array]:
        own = [t or "" for t in texts.to_pylist()]
        coded = encoder(model, "both")
        ways = coded.encode_ways(own)
        text = coded.model.decode
        same = [all(text(way[i].tolist()) == t for way in ways) for i, t in enumerate(own)]
        return [*map(_lists, ways), pa.array(same, pa.bool_())]

    return _added(df, text_col, make, ["ids", "merged", "round_trip"], [_IDS, _IDS, T.BooleanType()])
