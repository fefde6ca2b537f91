"""Word hashes, shingles and hashed vectors of whole Arrow batches, in numpy.

A word is a run of ASCII letters, digits and bytes above 127, A-Z lower-cased; so every
UTF-8 text can be cut at byte level.  Hashes are 64 bits wide and the same on every
machine.  Batches are worked on in blocks of bounded size; a longer text is a block alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20
POWERS = 64

_U = np.uint64
_WORD = np.zeros(256, bool)
_WORD[128:] = True
for _a, _b in ((48, 57), (65, 90), (97, 122)):
    _WORD[_a : _b + 1] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that every output bit depends on every input bit."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def seeds(count: int, salt: int) -> np.ndarray:
    """Odd 64-bit constants derived from a number."""
    steps = np.arange(1, count + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)
    return mix(steps + mix(np.array([salt], _U))) | _U(1)


_BYTE = seeds(256, 1)
_BASE = seeds(1, 2)[0]


def _powers(count: int) -> np.ndarray:
    out = np.ones(max(count, 1), _U)
    out[1:] = _BASE
    return np.multiply.accumulate(out)


_POWERS = _powers(POWERS)


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [start, stop) of a string column, each of about ``limit`` bytes at most."""
    n = len(column)
    if n == 0:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    total = np.cumsum(sizes)
    start = 0
    while start < n:
        done = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, done + limit, "right")))
        yield start, stop
        start = stop


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its texts; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, at - at[0]


class Words:
    """The words of several texts: ``hashes`` in order, and how many each text has."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, prefix: int = 0):
        inside = _WORD[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        firsts = offsets[:-1][offsets[:-1] < len(data)]
        begins[firsts] = inside[firsts]
        places = np.flatnonzero(begins)
        self.counts = np.diff(np.searchsorted(places, offsets))
        letters = _LOWER[data[inside]]
        starts = np.flatnonzero(begins[inside])
        self.hashes = np.zeros(0, _U)
        self.prefixes = np.zeros(0, _U)
        if len(starts) == 0:
            return
        lengths = np.diff(np.append(starts, len(letters)))
        position = np.arange(len(letters)) - np.repeat(starts, lengths)
        powers = _POWERS if lengths.max() <= POWERS else _powers(int(lengths.max()))
        terms = _BYTE[letters] * powers[position]
        self.hashes = mix(np.add.reduceat(terms, starts) + lengths.astype(_U))
        if prefix:
            terms[position >= prefix] = 0
            self.prefixes = mix(np.add.reduceat(terms, starts))

    @property
    def owners(self) -> np.ndarray:
        """For each word, the number of its text."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``width`` words and the number per text.

        A text with fewer words has one shingle of all its words; without words, none.
        """
        counts = self.counts
        many = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
        total = int(many.sum())
        if total == 0:
            return np.zeros(0, _U), many
        ends = np.cumsum(counts)
        first = np.repeat(ends - counts, many)
        at = first + np.arange(total) - np.repeat(np.cumsum(many) - many, many)
        left = np.repeat(ends, many) - at
        padded = np.concatenate([self.hashes, np.zeros(width, _U)])
        out = np.zeros(total, _U)
        factors = seeds(width, 3)
        short = bool((left < width).any())
        for j in range(width):
            term = padded[at + j] * factors[j]
            if short:
                term[left <= j] = 0
            out += term
        return mix(out), many


def words_in(column: pa.Array, prefix: int = 0) -> Words:
    return Words(*raw_bytes(column), prefix=prefix)
