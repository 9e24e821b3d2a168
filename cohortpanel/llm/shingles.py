"""Word shingles of Arrow text columns as sets of 64-bit hashes, without a memory of words.

Bytes of a column are hashed where they lie: a word's hash is the sum of a random number for each of its bytes times a
random number for the byte's place. Long columns are taken in pieces that end between words, so scratch arrays are
bounded by the piece and the longest word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import SPACE

#: Bytes that are hashed at once, about.
PIECE = 1 << 18


def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in SPACE]] = True
_places = _mixed(np.arange(1000, 1256, dtype=np.uint64))


def _place(n: int) -> np.ndarray:
    """Numbers of the first n places; those of ordinary words are kept."""
    return _places if n <= len(_places) else _mixed(np.arange(1000, 1000 + n, dtype=np.uint64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the ends of its rows (one more than rows, the first is the beginning)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    _, ends, data = column.buffers()
    if not len(column) or data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    ends = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and how many words stand before each row's end (the first: 0)."""
    hashes, begins, at = [], [], 0
    while at < len(data):
        stop = min(len(data), at + PIECE)
        if stop < len(data):  # end between words, wherever the next gap is
            while stop < len(data) and not (gap := _BREAK[data[stop : stop + PIECE]]).any():
                stop += PIECE
            stop = min(len(data), stop + int(gap.argmax())) if stop < len(data) else len(data)
        piece = data[at:stop]
        inside = ~_BREAK[piece]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edges = ends[np.searchsorted(ends, at) : np.searchsorted(ends, stop)] - at  # rows part words too
        first[edges] = inside[edges]
        starts, here = np.flatnonzero(first), np.flatnonzero(inside)
        if len(starts):
            opening = np.flatnonzero(first[here])
            lengths = np.diff(np.append(opening, len(here)))
            place = _place(int(lengths.max()))[np.arange(len(here)) - np.repeat(opening, lengths)]
            hashes.append(_mixed(np.add.reduceat(_BYTE[piece[here]] * place, opening) + lengths.astype(np.uint64)))
            begins.append(starts + at)
        at = stop
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(ends), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(begins), ends)


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its n-word shingles; fewer words: one of them all; no word: empty."""
    words, ends = word_hashes(*text_bytes(column))
    windows = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        windows = _mixed(windows + words[k : k + len(windows)])
    windows = windows.view(np.int64)
    for a, b in zip(ends.tolist(), ends[1:].tolist()):
        if b - a >= n:
            yield np.unique(windows[a : b - n + 1])
        elif b > a:
            whole = np.full(1, b - a, np.uint64)  # apart from full windows, and from shorter and longer ones
            for word in words[a:b]:
                whole = _mixed(whole + word)
            yield whole.view(np.int64)
        else:
            yield np.empty(0, np.int64)
