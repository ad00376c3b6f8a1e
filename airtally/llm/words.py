"""Words of many texts at once, as arrays of bytes, bounds and numbers.

A word is a maximal run of bytes other than ASCII white space, so texts need no decoding.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes whose powers are held at a time, besides a longer single word.
BLOCK = 1 << 20
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True


@dataclass
class Words:
    """All words of some texts: bounds in ``data``, and the first word of each text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self) -> np.ndarray:
        """The number of each word's text."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def split(self) -> list[bytes]:
        data = self.data.tobytes()
        return [data[a:b] for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True)]


def words_of(texts: pa.StringArray) -> Words:
    """The words of texts without nulls."""
    _, offsets, values = texts.buffers()
    bounds = np.frombuffer(offsets, np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(values, np.uint8)[bounds[0] : bounds[-1]] if values is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    word = ~_SPACE[data]
    begins, finishes = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    finishes[:-1] &= ~word[1:]
    # neighbouring texts have no white space between them
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[inner] = word[inner]
    finishes[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    return Words(data, starts, ends, np.searchsorted(starts, bounds))


def spread(x: np.ndarray) -> np.ndarray:
    """Mix the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(words: Words) -> np.ndarray:
    """A 64-bit number for each word, equal for equal words."""
    out = np.zeros(len(words.starts), dtype=np.uint64)
    at = 0
    while at < len(out):
        begin = int(words.starts[at])
        end = max(at + 1, int(np.searchsorted(words.ends, begin + BLOCK, "right")))
        starts, ends = words.starts[at:end] - begin, words.ends[at:end] - begin
        size = int(ends[-1])
        up, down = (np.full(size + 1, base, dtype=np.uint64) for base in (BASE, INVERSE))
        up[0] = down[0] = 1
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        sums = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum((words.data[begin : begin + size].astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        out[at:end] = spread((sums[ends] - sums[starts]) * down[starts])
        at = end
    return out


def grams(numbers: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit number for each ``size`` consecutive words, whatever text they are of."""
    out = np.zeros(max(len(numbers) - size + 1, 0), dtype=np.uint64)
    for i in range(size):
        out = (out ^ numbers[i : len(out) + i]) * np.uint64(BASE)
        out ^= out >> np.uint64(29)
    return out
