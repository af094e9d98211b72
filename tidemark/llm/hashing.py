"""Hashes of words, for many texts at once in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
PIECE = 1 << 20
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    out = []
    for base in (_BASE, _INVERSE):
        row = np.full(n, base, np.uint64)
        row[0] = 1
        out.append(np.cumprod(row, dtype=np.uint64))
    return tuple(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pieces(data: bytes, most: int = PIECE):
    """``data`` in parts of about ``most`` bytes that end at white space; a longer word stays whole."""
    at = 0
    while at < len(data):
        end = at + most
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield data[at:end]
        at = end


def _hash_piece(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``data`` and where they begin."""
    raw = np.frombuffer(data, np.uint8)
    word = np.concatenate(([False], ~_WHITE[raw], [False]))
    edge = np.flatnonzero(word[1:] != word[:-1])
    begin, end = edge[::2], edge[1::2]
    up, down = _powers(max(21, len(raw).bit_length()))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64)), begin


def word_hashes(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (uint64) of all words of all texts in order, and the number of words of each text.

    Words are runs of anything but space and U+0009 to U+000D; ``lower`` reads A-Z as a-z.
    """
    coded = [(t or "").encode() for t in texts]
    data = b" ".join(coded)
    if lower:
        data = data.translate(_LOWER)
    found, places, at = [], [], 0
    for piece in _pieces(data):
        hashes, begin = _hash_piece(piece)
        found.append(hashes)
        places.append(begin + at)
        at += len(piece)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    starts = np.cumsum([0, *(len(c) + 1 for c in coded)])
    where = np.searchsorted(np.concatenate(places), starts)
    return np.concatenate(found), np.diff(where)


def groups(texts: list[str | None], most: int = PIECE):
    """Index ranges of ``texts`` with about ``most`` characters each."""
    begin = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= most:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def parts(column: pa.Array, most: int = PIECE):
    """Index ranges of a column of texts with about ``most`` bytes each, without reading the texts."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    begin = size = 0
    for i, n in enumerate(sizes.tolist()):
        size += n
        if size >= most:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(sizes):
        yield begin, len(sizes)
