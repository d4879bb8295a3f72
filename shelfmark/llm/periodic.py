"""Periodic runs of words: branching tandem repeats from an enhanced suffix array, rotated and merged into runs.

A task handles its texts in groups of bounded size; all steps are array operations over the words of a group.

1. Suffix array, its inverse and the LCP array by prefix doubling; the first symbol holds the text, so no
   suffix shares a prefix with one of another text.  Only suffixes that are still tied are sorted again.
2. LCP intervals come as pairs of bounds from nearest smaller values of the LCP array; no tree is built.
   Every boundary of depth l opens one child of its interval; the largest child of an interval is left out,
   so all children together have at most n log n suffixes.
3. Each suffix i of a smaller child checks whether ISA[i + l] and ISA[i - l] lie in the interval's bounds: then a
   square of two times l words starts at i or i - l.  It is branching where the word after it breaks the period.
4. A branching square is the end of a run; it is rotated to the left, in blocks that double, until the period
   breaks.  Squares that give one stretch are one run with the least of their periods.

A run is reported from ``least`` words and ``power`` periods on.  ``collapsed`` is the text without the words
that repeat a run's first period.  A row is handled as a whole by one task: memory is proportional to its
words, and to the logarithm of its longest repeat.

Defined cases: a null, empty or blank text has no words and no runs, its collapsed text is empty; a null id
counts as the empty text where words are rebuilt by id; rows are handled one by one, so repeated rows and
ids give repeated results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfmark.llm.common import bounded_batches, table
from shelfmark.llm.textbytes import BYTE_VALUES, NOT_BLANK, STEP, U, groups, mixed, word_hashes, words

LEAST, POWER = 6, 4
#: Suffixes of smaller children that are looked up at once.
CHUNK = 1 << 20


def _opens(sorted_values: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    new = np.ones(len(sorted_values), bool)
    new[1:] = sorted_values[1:] != sorted_values[:-1]
    return new


def _tied(new: np.ndarray) -> np.ndarray:
    return ~(new & np.append(new[1:], True))


def suffix_array(symbols: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, and their ranks by the first 1, 2, 4, ... symbols; the last ranks are the inverse.

    ``end`` is the end of each position's text; a suffix that ends sorts before longer ones.
    """
    n = len(symbols)
    order = np.argsort(symbols)
    new = _opens(symbols[order])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    ranks, slots, width = [rank], np.flatnonzero(_tied(new)), 1
    while len(slots):
        suffix = order[slots]
        after = suffix + width
        key = rank[suffix] * (n + 1) + np.where(after < end[suffix], rank[np.minimum(after, n - 1)] + 1, 0)
        by_key = np.argsort(key)
        key, suffix = key[by_key], suffix[by_key]
        order[slots] = suffix
        new = _opens(key)
        rank = rank.copy()
        rank[suffix] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        ranks.append(rank)
        slots, width = slots[_tied(new)], width * 2
    return order, ranks


def lcp_array(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Length of the common prefix of each suffix and the one before it; 0 at both ends (n + 1 values)."""
    n = len(order)
    lcp = np.zeros(n + 1, np.int64)
    slots = np.flatnonzero(ranks[0][order[1:]] == ranks[0][order[:-1]]) + 1 if n else np.zeros(0, np.int64)
    a, b = order[slots - 1], order[slots]
    for level in range(len(ranks) - 1, -1, -1):
        rank = np.append(ranks[level], -1)
        same = rank[a] == rank[b]
        a, b = a + (same << level), b + (same << level)
    lcp[slots] = b - order[slots]
    return lcp


def _nearest(lcp: np.ndarray, inner: np.ndarray, pointer: np.ndarray, strict: bool) -> np.ndarray:
    """Follow ``pointer`` from each inner index past larger values (``strict``: equal ones too); 0 stops."""
    pointer = pointer.copy()
    active = inner
    while len(active):
        at = pointer[active]
        past = lcp[at] >= lcp[active] if strict else lcp[at] > lcp[active]
        active = active[past]
        pointer[active] = pointer[at[past]]
    return pointer


def smaller_children(lcp: np.ndarray) -> tuple[np.ndarray, ...]:
    """All children but the largest of each LCP interval: first slot, size, depth, interval's first and last slot."""
    inner = np.flatnonzero(lcp > 0)
    place = np.arange(len(lcp))
    before = _nearest(lcp, inner, place - 1, False)
    below = _nearest(lcp, inner, before, True)
    after = _nearest(lcp, inner, place + 1, False)
    beyond = _nearest(lcp, inner, after, True)
    first = inner[lcp[before[inner]] < lcp[inner]]
    boundary = np.concatenate([inner, first])
    start = np.concatenate([inner, below[first]])
    size = np.concatenate([after[inner] - inner, first - below[first]])
    low, high = below[boundary], beyond[boundary] - 1
    interval = low * len(lcp) + high
    order = np.lexsort((-size, interval))
    order = order[~_opens(interval[order])]
    return start[order], size[order], lcp[boundary[order]], low[order], high[order]


def _ragged(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and number within it of each element of groups of the given sizes."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def branching_squares(symbols: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of every branching square."""
    n = len(symbols)
    order, ranks = suffix_array(symbols, end)
    inverse = ranks[-1]
    start, size, depth, low, high = smaller_children(lcp_array(order, ranks))
    del ranks
    found = []
    cut = np.searchsorted(np.cumsum(size), np.arange(CHUNK, size.sum() + CHUNK, CHUNK)) + 1 if len(size) else []
    at = 0
    for stop in cut:
        part = slice(at, stop)
        at = stop
        owner, number = _ragged(size[part])
        suffix = order[start[part][owner] + number]
        period, low_, high_ = depth[part][owner], low[part][owner], high[part][owner]
        for square, mate, inside in (
            (suffix, suffix + period, suffix + period < end[suffix]),
            (suffix - period, suffix - period, suffix - period >= begin[suffix]),
        ):
            slot = inverse[np.where(inside, mate, 0)]
            ok = np.flatnonzero(inside & (low_ <= slot) & (slot <= high_))
            square, length = square[ok], period[ok]
            last = square + 2 * length
            branching = (last >= end[square]) | (symbols[square + length] != symbols[np.minimum(last, n - 1)])
            found.append((square[branching] * (n + 1) + length[branching]))
    keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return keys // (n + 1), keys % (n + 1)


def rotate_left(symbols: np.ndarray, begin: np.ndarray, square: np.ndarray, period: np.ndarray) -> np.ndarray:
    """First word of the run that each square ends."""
    left, active, step = square.copy(), np.arange(len(square)), 16
    while len(active):
        here, length = left[active], period[active]
        room = np.minimum(step, here - begin[square[active]])
        owner, number = _ragged(room)
        at = here[owner] - number - 1
        broken = np.flatnonzero(symbols[at] != symbols[at + length[owner]])[::-1]
        moved = room.copy()
        moved[owner[broken]] = number[broken]  # the first break is written last
        left[active] = here - moved
        active = active[(moved == room) & (room == step)]
        step *= 2
    return left


def runs_of(symbols: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int = LEAST, power: int = POWER) -> tuple[np.ndarray, ...]:
    """(start, length, period) of the runs of all texts, by start, then period."""
    if not len(symbols):
        return (np.zeros(0, np.int64),) * 3
    square, period = branching_squares(symbols, begin, end)
    far = square - max(power - 2, 0) * period  # where a run of enough periods has begun
    enough = far >= begin[square]
    square, period, far = square[enough], period[enough], far[enough]
    enough = symbols[far] == symbols[far + period]
    square, period = square[enough], period[enough]
    # Of the squares with one end the least period is rotated first; multiples of it inside its run are the same run.
    order = np.lexsort((period, square + 2 * period))
    square, period = square[order], period[order]
    found = []
    while len(square):
        stop = square + 2 * period
        new = _opens(stop)
        start = rotate_left(symbols, begin, square[new], period[new])
        found.append((start, stop[new] - start, period[new]))
        group = np.cumsum(new) - 1
        left = (square < start[group]) | (period % period[new][group] != 0)
        square, period = square[left & ~new], period[left & ~new]
    start, length, period = (np.concatenate(x) for x in zip(*found)) if found else (square,) * 3
    long = length >= np.maximum(least, power * period)
    start, length, period = start[long], length[long], period[long]
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _search(least: int, power: int, tail: Callable | None):
    fields = [pa.field(n, pa.int64()) for n in ("start", "length", "period")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in groups(batch, "text"):
                starts, ends, text = words(data, offsets, NOT_BLANK)
                symbols = mixed(word_hashes(data, starts, ends, BYTE_VALUES) + text.astype(U) * STEP)
                bounds = np.searchsorted(text, np.arange(b - a + 1))
                begin, end = bounds[text], bounds[text + 1]
                source = np.arange(len(text))
                if tail is not None:
                    for t, key in enumerate(batch.column("id").slice(a, b - a).to_pylist()):
                        low, high = bounds[t], bounds[t + 1]
                        change = tail(key, int(high - low))
                        if change is not None:
                            first, period = change
                            source[low + first : high] = low + first + np.arange(high - low - first) % period
                    symbols = symbols[source]
                start, length, period = runs_of(symbols, begin, end, least, power)
                steps = np.zeros(len(text) + 1, np.int64)
                np.add.at(steps, start + period, 1)
                np.add.at(steps, start + length, -1)
                keep = np.cumsum(steps[:-1]) == 0
                collapsed = []
                for t in range(b - a):
                    low, high = int(bounds[t]), int(bounds[t + 1])
                    parts = data[offsets[t] : offsets[t + 1]].tobytes().split()
                    if tail is not None and source[high - 1 if high > low else 0 : high].tolist() != [high - 1] * (high > low):
                        parts = [parts[j] for j in (source[low:high] - low).tolist()]
                    kept = keep[low:high]
                    if not kept.all():
                        parts = compress(parts, kept.tolist())
                    collapsed.append(b" ".join(parts))
                owner = text[start] if len(start) else start
                relative = [start - bounds[owner], length, period]
                runs = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(owner, np.arange(b - a + 1)).astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array(x) for x in relative], fields=fields),
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a), pa.array(np.diff(bounds)), runs, pa.array(collapsed, pa.binary()).cast(pa.string())],
                    ["id", "n_words", "runs", "collapsed"],
                )

    return run


def find_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, power: int = POWER,
    tail: Callable | None = None,
) -> DataFrame:
    """Per row of ``docs``: id, ``n_words``, ``runs`` (start, length, period; by start, then period), ``collapsed``.

    ``tail(id, n)`` may give (a, p): from word a on, the text is then read as its words a to a + p - 1 over and over.
    """
    texts = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = texts.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return texts.mapInArrow(_search(least, power, tail), schema).withColumnRenamed("id", id_col)


def planted_tail(doc_id, n: int):
    """The contract's rebuilt texts: one id in ten repeats a part of itself to its end."""
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def op13_periodic_runs(spark, sf_dir):
    """Every document's runs, the longest one, and the text without repeated periods, as digests."""
    found = find_runs(table(spark, sf_dir, "documents"), tail=planted_tail)
    longest = F.array_min(F.transform("runs", lambda r: F.struct(-r["length"], r["start"], r["period"])))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("longest.start").alias("start"),
        (-F.col("longest.col1")).alias("length"),
        F.col("longest.period").alias("period"),
        F.expr("-longest.col1 * 1000 div longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def sql_crc32(number: str) -> str:
    """DuckDB expression for the unsigned crc32 of the decimal text of ``number``."""
    return (
        "xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split("
        f"({number})::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda acc, byte: list_reduce(list_prepend(xor(acc, byte), "
        "[1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]), lambda s, bit: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384::BIGINT) ELSE s >> 1 END)))"
    )


ORACLE = f"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') AS words, {sql_crc32('doc_id')} AS h
  FROM documents),
e AS (
  SELECT *, len(words) AS n, CASE WHEN h % 10 = 0 AND len(words) > 0 THEN (h // 10) % len(words) END AS a FROM d),
f AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM e),
w AS (
  SELECT doc_id, i, n, words[1 + CASE WHEN a IS NULL OR i < a THEN i ELSE a + (i - a) % p END] AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM f)),
pairs AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q, x.i - row_number() OVER (PARTITION BY x.doc_id, y.i - x.i ORDER BY x.i) AS island
  FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND y.i - x.i <= x.n // {POWER}),
stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM pairs GROUP BY doc_id, q, island),
runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM stretches
  WHERE length >= greatest({LEAST}, {POWER} * q) GROUP BY doc_id, start, length),
dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS collapsed
  FROM w LEFT JOIN dropped x ON w.doc_id = x.doc_id AND w.i = x.i WHERE x.i IS NULL GROUP BY w.doc_id),
digests AS (
  SELECT doc_id, count(*) AS n_runs, min({{'a': -length, 'b': start, 'c': period}}) AS longest,
         string_agg(start::BIGINT || ',' || length::BIGINT || ',' || period::BIGINT || chr(10), '' ORDER BY start, period) AS lines
  FROM runs GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, longest.b::BIGINT AS start, -longest.a::BIGINT AS length,
       longest.c::BIGINT AS period, (-longest.a * 1000 // longest.c)::BIGINT AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM d LEFT JOIN digests USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
