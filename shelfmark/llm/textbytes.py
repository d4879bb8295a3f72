"""Words, hashes and shingles of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
STEP, STEP_BACK = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Texts are handled in groups of about so many bytes; a longer text is a group of its own.
GROUP_BYTES = 1 << 19


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_VALUES = mixed(np.arange(1, 257, dtype=U) * STEP)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_VALUES = BYTE_VALUES[LOWER]


def _table(is_word) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)])


#: Bytes that belong to a word: everything but ASCII white space.
NOT_BLANK = _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: ASCII letters and digits, and every byte beyond ASCII.
LETTERS = _table(lambda b: b >= 0x80 or chr(b).isalnum())

class _Powers:
    """Powers of STEP and its inverse, made once per process and never sent with a task."""

    def __init__(self):
        self.size, self.up, self.down = 0, None, None

    def __reduce__(self):
        return _Powers, ()

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if self.size <= n:
            self.size = max(n + 1, GROUP_BYTES + 1)
            made = []
            for base in (STEP, STEP_BACK):
                values = np.full(self.size, base, U)
                values[0] = 1
                made.append(np.multiply.accumulate(values))
            self.up, self.down = made
        return self.up, self.down


_made = _Powers()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """STEP and its inverse to the powers 0 to n at least."""
    return _made.upto(n)


def groups(batch: pa.RecordBatch, column: str, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows; a null text is empty."""
    texts = batch.column(column)
    texts = texts.fill_null("" if not pa.types.is_binary(texts.type) else b"") if texts.null_count else texts
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the words; no word crosses from one text into the next."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = table[data]
    opens, closes = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    edges = offsets[1:-1]
    both = edges[inside[edges] & inside[edges + 1]] if len(data) else edges[:0]
    opens[both] = closes[both] = True
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes), np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = LOWER_VALUES) -> np.ndarray:
    """A 64-bit hash of each piece of ``data``, with A-Z lower-cased unless other ``values`` are given."""
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, U)
    np.multiply(values[data], up[: len(data)], out=sums[1:])
    np.cumsum(sums[1:], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))


def shingles(hashes: np.ndarray, text: np.ndarray, n_texts: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words and their text numbers; a shorter text is one shingle, none is none."""
    counts = np.bincount(text, minlength=n_texts)
    factors = mixed(np.arange(1, width + 1, dtype=U) * U(0xD1342543DE82EF95)) | U(1)
    n = max(0, len(hashes) - width + 1)
    full = np.zeros(n, U)
    for j in range(width):
        full += hashes[j : j + n] * factors[j]
    valid = text[:n] == text[width - 1 :] if n else np.zeros(0, bool)
    full, owner = full[valid], text[:n][valid]
    place = np.arange(len(text)) - (np.cumsum(counts) - counts)[text]
    short = counts[text] < width
    if short.any():
        sums = np.zeros(n_texts, U)
        np.add.at(sums, text[short], hashes[short] * factors[place[short]])
        few = np.flatnonzero((counts > 0) & (counts < width))
        full = np.concatenate([full, sums[few] + mixed(counts[few].astype(U))])
        owner = np.concatenate([owner, few])
        order = np.argsort(owner, kind="stable")
        full, owner = full[order], owner[order]
    return mixed(full), owner


def distinct_by_text(values: np.ndarray, text: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct values of each text, their text numbers, and the bounds of the texts; ``text`` ascends."""
    values = values.copy()
    bounds = np.searchsorted(text, np.arange(n_texts + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a > 1:
            values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    values, text = values[keep], text[keep]
    return values, text, np.searchsorted(text, np.arange(n_texts + 1))
