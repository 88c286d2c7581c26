"""Words and word shingles of many texts at once, as NumPy arrays.

Texts are the UTF-8 bytes of an Arrow column; words are what stands between ASCII white
space, which never occurs inside a multi-byte character, so no text is decoded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_rng = np.random.default_rng(20240229)
#: A random number for each byte at each of 64 places; a word's hash is the mixed sum over its bytes.
ZOBRIST = _rng.integers(0, 2**64, (64, 256), np.uint64)
FACTORS = _rng.integers(0, 2**64, 64, np.uint64) | np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text taken at once, which bounds memory; a longer text is taken alone.
AT_ONCE = 1_500_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Texts:
    """data: all bytes; at: where each text starts, and the end; starts, ends: of words; doc: each word's text."""

    data: np.ndarray
    at: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    words_at: np.ndarray
    first: int

    def __len__(self) -> int:
        return len(self.at) - 1

    def raw(self, k: int) -> bytes:
        return self.data[self.at[k] : self.at[k + 1]].tobytes()


def runs(column, at_once: int = AT_ONCE) -> Iterator[Texts]:
    """The texts of an Arrow string column without nulls, some at a time."""
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(column.buffers()[2], np.uint8) if len(column) and column.buffers()[2] else np.empty(0, np.uint8)
    k = 0
    while k < len(column):
        stop = max(k + 1, int(np.searchsorted(offsets, offsets[k] + at_once, "right")) - 1)
        stop = min(stop, len(column))
        data = whole[offsets[k] : offsets[stop]]
        at = offsets[k : stop + 1] - offsets[k]
        word = ~SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True
        before = np.concatenate(([False], word[:-1])) & ~edge[:-1] if len(data) else word
        after = np.concatenate((word[1:], [False])) & ~edge[1:] if len(data) else word
        starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        doc = np.searchsorted(at, starts, "right") - 1
        yield Texts(data, at, starts, ends, doc, np.searchsorted(doc, np.arange(len(at))), k)
        k = stop


def word_hashes(t: Texts, lower: bool = False) -> np.ndarray:
    lengths = t.ends - t.starts
    if not len(lengths):
        return np.empty(0, np.uint64)
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    data = t.data[np.repeat(t.starts, lengths) + place]
    if lower:
        data = LOWER[data]
    part = ZOBRIST[place & 63, data]
    if int(lengths.max()) > 64:
        part = part * ((place >> 6).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    return mixed(np.add.reduceat(part, first) + lengths.astype(np.uint64))


def window_hashes(t: Texts, words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each run of `width` words inside a text, and the run's first word."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    first = np.flatnonzero(t.doc[:n] == t.doc[width - 1 :])
    out = np.zeros(len(first), np.uint64)
    for k in range(width):
        out += words[first + k] * FACTORS[k]
    return mixed(out), first


def shingle_sets(t: Texts, width: int = 5, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted inside a text, and where each text's start (and the end).

    A text of one to width-1 words has one shingle: all its words. One without words has none.
    """
    words = word_hashes(t, lower)
    hashes, first = window_hashes(t, words, width)
    doc = t.doc[first]
    counts = np.diff(t.words_at)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = counts[short] > k
            whole[has] += words[t.words_at[short[has]] + k] * FACTORS[32 + k]
        hashes = np.concatenate((hashes, mixed(whole + counts[short].astype(np.uint64))))
        doc = np.concatenate((doc, short))
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(len(t) + 1))
