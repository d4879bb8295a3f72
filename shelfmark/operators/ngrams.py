"""n-grams of many texts at once, as pairs of 64-bit hashes over the UTF-8 bytes.

A block's words arrive as one string: words with one blank between them, or, for characters, padded words one
after the other, so that a word begins and ends with a blank.  Either way an n-gram is a piece of that string,
its hash comes from running sums, and its text can be cut out again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Texts go through in groups of about so many bytes; a longer text is a group of its own.
GROUP_BYTES = 1 << 19
BLANK = 0x20


def _scrambled(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * U(0xA0761D6478BD642F)
    return x ^ (x >> U(32))


class _Radix:
    """An odd base, its powers and those of its inverse, and a value per byte; made anew in each process."""

    def __init__(self, seed: int):
        self.seed = seed
        self.base = U(0x9E3779B97F4A7C15 + 2 * seed)
        self.bytes = _scrambled(np.arange(1 + 1000 * seed, 257 + 1000 * seed, dtype=U))
        self.up = self.down = np.ones(1, U)

    def __reduce__(self):
        return _Radix, (self.seed,)

    def sums(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if len(self.up) <= n:
            size = max(n + 1, 2 * GROUP_BYTES)
            inverse = U(pow(int(self.base), -1, 1 << 64))
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(size, b, U)])) for b in (self.base, inverse))
        out = np.zeros(n + 1, U)
        np.cumsum(self.bytes[data] * self.up[:n], out=out[1:])
        return out

    def hashes(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _scrambled((sums[end] - sums[start]) * self.down[start] + (end - start).astype(U))


RADIX = _Radix(0), _Radix(1)


def text_groups(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows; a null text is empty."""
    column = column.fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + GROUP_BYTES, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_pieces(data: np.ndarray, offsets: np.ndarray, low: int, high: int) -> tuple[np.ndarray, ...]:
    """Start, end and text of all n-grams of words for ``low <= n <= high``."""
    blank = data == BLANK
    first = np.ones(len(data) + 1, bool)
    first[1:] = np.append(blank, True)[:-1]
    first[offsets] = True
    start = np.flatnonzero(first[:-1] & ~blank)
    last = np.ones(len(data), bool)
    last[:-1] = blank[1:]
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    end = np.flatnonzero(last & ~blank) + 1
    text = np.searchsorted(offsets, start, "right") - 1
    found = []
    for n in range(low, high + 1):
        m = max(0, len(start) - n + 1)
        inside = text[:m] == text[n - 1 :] if m else np.zeros(0, bool)
        found.append((start[:m][inside], end[n - 1 :][inside] if m else end[:0], text[:m][inside]))
    return tuple(np.concatenate(x) for x in zip(*found))


def character_pieces(data: np.ndarray, offsets: np.ndarray, low: int, high: int) -> tuple[np.ndarray, ...]:
    """Start, end and text of all character n-grams inside padded words; a word shorter than ``low`` gives itself."""
    begins = np.flatnonzero((data & 0xC0) != 0x80)  # of code points
    blank = data[begins] == BLANK
    text_of = np.searchsorted(offsets, begins, "right") - 1
    # Blanks come in pairs in every text: one opens a word, one closes it.
    blanks = np.flatnonzero(blank)
    opens, closes = blanks[::2], blanks[1::2]
    ends = np.append(begins, len(data))
    found = []
    length = closes - opens + 1
    for n in range(low, high + 1):
        count = np.maximum(length - n + 1, 0)
        if n == low:
            count = np.where(length < n, 1, count)
        word = np.repeat(np.arange(len(opens)), count)
        at = opens[word] + np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
        stop = np.minimum(at + n, closes[word] + 1)
        found.append((begins[at], ends[stop], text_of[at]))
    return tuple(np.concatenate(x) for x in zip(*found))


def hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tuple(r.hashes(r.sums(data), start, end) for r in RADIX)


def counted(text: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of one occurrence of each distinct (text, hash), by text, and how often it occurs there."""
    # By hash, then stably by text; small numbers are sorted in one pass.
    order = np.argsort(one)
    own = text[order]
    order = order[np.argsort(own.astype(np.uint16) if len(own) and own.max() < 1 << 16 else own, kind="stable")]
    t, h = text[order], one[order]
    new = np.ones(len(order), bool)
    new[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return order[at], np.diff(np.append(at, len(order)))


def cut(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The pieces as strings."""
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)])
    place = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[place])]).cast(pa.string())


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))
