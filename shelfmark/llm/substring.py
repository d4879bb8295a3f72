"""Repeated passages: winnowed anchors as seeds, joined, extended both ways, cut from ``length`` words on.

1. Every window of ``length`` words chooses its least k-gram (winnowing), so equal windows choose equal ones: an
   anchor.  The windows that chose one anchor occurrence form its segment, at most 2 * length - k words.
2. Seeds: occurrences meet by anchor, in one shuffle of some 30 bytes for every seven words.  Those whose whole
   segments are equal form a class: all but the first of a class repeat all their windows.  An anchor with
   one occurrence is unique text and goes no further; the first ones of an anchor with several classes are
   forks, the ends of maximal repeats.
3. Extension: each fork is compared, word by word to the left and to the right, with the anchor's first
   occurrence, one comparison a fork.  Windows inside the match repeat it.
4. The rest: windows of forks that the first occurrence doesn't hold may be held by another fork; they are
   matched exactly by the anchor, their place around it and the hash of all their words.
5. Matches that touch or overlap are merged by document into maximal repeats and cut out.

No pairs within a group are formed.  Anchors of more than ``HOT`` occurrences, found by counters in a pass
before, don't meet in one task: their classes are minima combined before the shuffle and joined back, and
the first occurrence is copied to ``SALTS`` parts of its forks.  A passage or an anchor may thus be in any share
of the documents.  What grows with the input is joined by shuffle at every size; only the list of hot
anchors, at most ``MOST_HOT``, is broadcast.

The earlier of two occurrences, by (id, hash of row, word), stays.  Defined cases: a null, empty or blank text has no
words; a null id sorts first; rows of one id are ordered by a hash of their text, rows equal in both are one
document and lose the same words; a text of fewer than ``length`` words loses nothing; a text may repeat
itself; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfmark.llm.common import BROADCAST_BYTES, bounded_batches, table
from shelfmark.llm.textbytes import BYTE_VALUES, NOT_BLANK, STEP, U, groups, mixed, powers, word_hashes, words
from shelfmark.operators.features import Counters
from shelfmark.session import broadcast_if_small, write_through

LENGTH, GRAM = 20, 8
#: An anchor is hot from so many occurrences on; a task reports what it has seen often, from ``COUNTERS`` counters.
HOT, OFTEN, COUNTERS, MOST_HOT = 50_000, 8, 1 << 14, 1 << 20
SALTS = 64
#: Bits for the place of a word in a group of texts; the hash bits above them choose a window's k-gram.
PLACE_BITS = U(28)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(U).view(np.int64))


def least_grams(grams: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of each ``width`` consecutive k-grams, the leftmost on a tie."""
    least = (grams >> PLACE_BITS << PLACE_BITS) | np.arange(len(grams), dtype=U)
    have = 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return (least & ((U(1) << PLACE_BITS) - U(1))).astype(np.int64)


def anchors(hashes: np.ndarray, text: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Anchor, segment hash, place, first and last window of each anchor occurrence of a group of texts."""
    n = len(hashes) - length + 1
    if n <= 0:
        return (np.zeros(0, U),) * 2 + (np.zeros(0, np.int64),) * 3
    factors = mixed(np.arange(1, gram + 1, dtype=U) * U(0xD1342543DE82EF95)) | U(1)
    grams = np.zeros(len(hashes) - gram + 1, U)
    for j in range(gram):
        grams += hashes[j : j + len(grams)] * factors[j]
    grams = mixed(grams)
    window = np.flatnonzero(text[:n] == text[length - 1 :])
    place = least_grams(grams, length - gram + 1)[window]
    new = np.ones(len(window), bool)
    new[1:] = place[1:] != place[:-1]
    at = np.flatnonzero(new)
    place, first = place[at], window[at]
    last = window[np.append(at[1:], len(window)) - 1] if len(at) else first
    up, down = powers(len(hashes))
    sums = np.zeros(len(hashes) + 1, U)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    shape = (place - first).astype(U) << U(8) | (place - last).astype(U)
    segment = mixed((sums[last + length] - sums[first]) * down[first] + mixed(shape + U(1)))
    return grams[place], segment, place, first, last


def _words(data, offsets, n_texts):
    starts, ends, text = words(data, offsets, NOT_BLANK)
    return word_hashes(data, starts, ends, BYTE_VALUES), text, np.searchsorted(text, np.arange(n_texts + 1))


def _frequent(length: int, gram: int, often: int):
    """(anchor, n): the anchors that a task has seen ``often`` or more, with lower bounds of how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = Counters(COUNTERS)
        for batch in batches:
            for a, b, data, offsets in groups(batch, "text"):
                hashes, text, _ = _words(data, offsets, b - a)
                anchor, count = np.unique(anchors(hashes, text, length, gram)[0], return_counts=True)
                counters.add(anchor, anchor, count)
        kept = counters.low >= often
        yield pa.RecordBatch.from_arrays([_signed(counters.one[kept]), pa.array(counters.low[kept])], ["anchor", "n"])

    return run


def _occurrences(length: int, gram: int):
    """(anchor, segment, id, row, place); ``place`` packs the word and the reach of its windows to the left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in groups(batch, "text"):
                hashes, text, bounds = _words(data, offsets, b - a)
                anchor, segment, place, first, last = anchors(hashes, text, length, gram)
                owner = text[place]
                packed = (place - bounds[owner]) << 16 | (place - first) << 8 | (place - last)
                rows = pa.array(owner + a)
                yield pa.RecordBatch.from_arrays(
                    [_signed(anchor), _signed(segment), batch.column("id").take(rows), batch.column("row").take(rows), pa.array(packed)],
                    ["anchor", "segment", "id", "row", "place"],
                )

    return run


def _segments(length: int, gram: int):
    """The word hashes around each fork: a fixed number of them, 0 outside its segment."""
    reach = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in groups(batch, "text"):
                hashes, text, bounds = _words(data, offsets, b - a)
                forks = batch.column("forks").slice(a, b - a)
                owner = np.repeat(np.arange(b - a), np.diff(forks.offsets.to_numpy()))
                anchor, packed, first = forks.flatten().flatten()
                place = packed.to_numpy()
                column = np.arange(-reach, length)
                inside = (column >= -(place >> 8 & 255)[:, None]) & (column < length - (place & 255)[:, None])
                at = (bounds[owner] + (place >> 16))[:, None] + column
                held = np.where(inside, hashes[np.clip(at, 0, max(len(hashes) - 1, 0))], U(0))
                rows = pa.array(owner + a)
                size = 8 * len(column)
                yield pa.RecordBatch.from_arrays(
                    [
                        anchor, batch.column("id").take(rows), batch.column("row").take(rows), packed, first,
                        pa.Array.from_buffers(pa.binary(size), len(held), [None, pa.py_buffer(np.ascontiguousarray(held))]).cast(pa.binary()),
                    ],
                    ["anchor", "id", "row", "place", "first", "held"],
                )

    return run


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), U).reshape(len(column), width)


def extent(one: np.ndarray, two: np.ndarray, reach: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """How many words equal ones go on to the left and to the right of the anchor, row by row."""
    same = (one == two) & (one != 0)
    left = np.minimum.accumulate(same[:, :reach][:, ::-1], axis=1).sum(axis=1)
    right = np.minimum.accumulate(same[:, reach + gram :], axis=1).sum(axis=1)
    return left, right


def _extend(length: int, gram: int):
    """Matches (start, end) with the anchor's first occurrence, and the windows it doesn't hold (offset, window).

    Rows come sorted by anchor and part, the first occurrence before the others.
    """
    reach = length - gram
    width = reach + length
    factors = mixed(np.arange(1, length + 1, dtype=U) * U(0xD1342543DE82EF95)) | U(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = np.zeros((1, width), U)
        for batch in batches:
            first = batch.column("first").to_numpy(zero_copy_only=False)
            held = np.concatenate([current, _matrix(batch.column("held"), width)])
            # The row of ``held`` with the latest first occurrence, for every row.
            latest = np.maximum.accumulate(np.where(np.concatenate([[True], first]), np.arange(len(held)), 0))
            current = held[latest[-1:]]
            batch = batch.filter(pa.array(~first))
            if not batch.num_rows:
                continue
            firsts, held = held[latest[1:][~first]], held[1:][~first]
            left, right = extent(held, firsts, reach, gram)
            place = batch.column("place").to_numpy()
            most, least = place >> 8 & 255, place & 255
            # Windows that begin ``offset`` words before the anchor, from ``low`` to ``high``, are matched.
            low, high = np.maximum(least, reach - right), np.minimum(most, left)
            matched = np.flatnonzero(low <= high)
            rows, offsets, windows = [matched], [np.full(len(matched), -1)], [np.zeros(len(matched), U)]
            start, end = [(place >> 16)[matched] - high[matched]], [(place >> 16)[matched] - low[matched] + length]
            for offset in range(reach + 1):
                other = np.flatnonzero((least <= offset) & (offset <= most) & ~((low <= offset) & (offset <= high)))
                rows.append(other)
                offsets.append(np.full(len(other), offset))
                part = held[other, reach - offset : reach - offset + length]
                windows.append(mixed((part * factors).sum(axis=1, dtype=U)))
                start.append((place >> 16)[other] - offset)
                end.append((place >> 16)[other] - offset + length)
            take = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(take) for c in ("anchor", "id", "row")]
                + [pa.array(np.concatenate(offsets)), _signed(np.concatenate(windows)), pa.array(np.concatenate(start)), pa.array(np.concatenate(end))],
                ["anchor", "id", "row", "offset", "window", "start", "end"],
            )

    return run


def _later(rows: DataFrame, keys: list[str], at: str, firsts: DataFrame) -> DataFrame:
    """Rows of groups of several that aren't the first of their group; ``firsts`` is (keys, n, first)."""
    several = broadcast_if_small(firsts.where("n > 1").select(*keys, "first"), BROADCAST_BYTES)
    return rows.join(several, keys).where(~F.struct("id", "row", F.col(at).alias("at")).eqNullSafe(F.col("first")))


def _firsts(rows: DataFrame, keys: list[str], at: str, name: str) -> DataFrame:
    first = F.min(F.struct("id", "row", F.col(at).alias("at"))).alias("first")
    return write_through(rows.groupBy(*keys).agg(F.count("*").alias("n"), first), name)


def _seeds(found: DataFrame) -> DataFrame:
    """Of occurrences (anchor, segment, id, row, place) of repeated anchors: those that are later in their class, and
    the first ones of classes where the anchor has several; ``first`` marks the anchor's first occurrence."""
    here = F.struct("id", "row", F.col("place").alias("at"))
    in_class = Window.partitionBy("anchor", "segment").orderBy("id", "row", "place")
    of_anchor = Window.partitionBy("anchor")
    marked = found.select(
        "anchor", "id", "row", "place",
        (F.rank().over(in_class) > 1).alias("later"),
        (F.min("segment").over(of_anchor) != F.max("segment").over(of_anchor)).alias("several"),
        here.eqNullSafe(F.min(here).over(of_anchor)).alias("first"),
    )
    return marked.where("later or several").select("anchor", "id", "row", "place", "later", "first")


def _hot_seeds(found: DataFrame) -> DataFrame:
    """The same for anchors too frequent for one task."""
    found = write_through(found, "repeat-hot")
    classes = _firsts(found, ["anchor", "segment"], "place", "repeat-classes")
    later = _later(found, ["anchor", "segment"], "place", classes)
    of_anchor = classes.groupBy("anchor").agg(F.count("*").alias("classes"), F.min("first").alias("least")).where("classes > 1")
    forks = classes.join(broadcast_if_small(write_through(of_anchor, "repeat-forked"), BROADCAST_BYTES), "anchor")
    return later.select("anchor", "id", "row", "place", F.lit(True).alias("later"), F.lit(False).alias("first")).unionByName(
        forks.select(
            "anchor", "first.id", "first.row", F.col("first.at").alias("place"), F.lit(False).alias("later"),
            F.col("first").eqNullSafe(F.col("least")).alias("first"),
        )
    )


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(id, row, spans) of the rows that repeat an earlier passage of ``length`` words or more, written.

    ``row`` is the hash of id and text; spans (start, end) are words, end exclusive, neither sorted nor merged.
    """
    texts = bounded_batches(docs).select(
        F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("row"), F.col(text_col).alias("text")
    )
    id_type = texts.schema["id"].dataType.simpleString()
    often = texts.select("text").mapInArrow(_frequent(length, gram, min(OFTEN, HOT)), "anchor long, n long")
    hot = often.groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") > HOT).orderBy(F.desc("n"), "anchor").limit(MOST_HOT)
    hot = write_through(hot.select("anchor"), "repeat-anchors")
    found = texts.mapInArrow(_occurrences(length, gram), f"anchor long, segment long, id {id_type}, row long, place long")
    seeds = _seeds(found.join(F.broadcast(hot), "anchor", "left_anti"))
    any_hot = not hot.isEmpty()
    if any_hot:
        seeds = seeds.unionByName(_hot_seeds(found.join(F.broadcast(hot), "anchor", "left_semi")))
    seeds = write_through(seeds, "repeat-seeds")

    word, most, least = (F.expr(x) for x in ("shiftright(place, 16)", "shiftright(place, 8) & 255", "place & 255"))
    whole = seeds.where("later").select("id", "row", (word - most).alias("start"), (word - least + length).alias("end"))
    # Rows equal in id and text give equal forks.
    by_row = seeds.where("not later").groupBy("id", "row").agg(F.collect_set(F.struct("anchor", "place", "first")).alias("forks"))
    forked = _with_row(texts, by_row, "inner").dropDuplicates(["row", "id"]) if _repeated(docs, id_col) else _with_row(texts, by_row, "inner")
    held = forked.select("id", "row", "text", "forks").mapInArrow(
        _segments(length, gram), f"anchor long, id {id_type}, row long, place long, first boolean, held binary"
    )
    if any_hot:
        held = held.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "anchor", "left")
        parts = F.when(F.col("hot") & F.col("first"), F.sequence(F.lit(0), F.lit(SALTS - 1))).when(
            F.col("hot"), F.array(F.pmod("row", F.lit(SALTS)).cast("int"))
        )
        held = held.withColumn("part", F.explode(F.coalesce(parts, F.array(F.lit(0)))))
    else:
        held = held.withColumn("part", F.lit(0))
    together = held.repartition("anchor", "part").sortWithinPartitions("anchor", "part", F.desc("first"))
    extended = write_through(
        bounded_batches(together.select("anchor", "id", "row", "place", "first", "held")).mapInArrow(
            _extend(length, gram), f"anchor long, id {id_type}, row long, offset long, window long, start long, end long"
        ),
        "repeat-extended",
    )
    rest, keys = extended.where("offset >= 0"), ["anchor", "offset", "window"]
    others = _later(rest, keys, "start", _firsts(rest, keys, "start", "repeat-windows"))
    spans = whole.unionByName(extended.where("offset < 0").select("id", "row", "start", "end")).unionByName(
        others.select("id", "row", "start", "end")
    )
    return write_through(
        spans.groupBy("id", "row").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "repeat-spans"
    )


def _repeated(docs: DataFrame, id_col: str) -> bool:
    """Whether any id, or none, is that of several rows."""
    return not docs.groupBy(id_col).count().where("count > 1").isEmpty()


def _with_row(texts: DataFrame, side: DataFrame, how: str) -> DataFrame:
    """``texts`` (id, row, ...) with the columns of ``side`` (id, row, ...), by shuffle at every size."""
    side = side.withColumnsRenamed({"id": "side_id", "row": "side_row"}).hint("shuffle_hash")
    same: Column = (F.col("row") == F.col("side_row")) & F.col("id").eqNullSafe(F.col("side_id"))
    return texts.join(side, same, how).drop("side_id", "side_row")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merged spans, counts and the text that is left, its words joined by one space."""
    fields = [pa.field("start", pa.int64()), pa.field("end", pa.int64())]
    for batch in batches:
        for a, b, data, offsets in groups(batch, "text"):
            n_words, n_removed, merged, kept = [], [], [], []
            for t, spans in enumerate(batch.column("spans").slice(a, b - a).to_pylist()):
                parts = data[offsets[t] : offsets[t + 1]].tobytes().split()
                n_words.append(len(parts))
                one: list[dict] = []
                for s in sorted((s["start"], s["end"]) for s in spans or ()):
                    if one and s[0] <= one[-1]["end"]:
                        one[-1]["end"] = max(one[-1]["end"], s[1])
                    else:
                        one.append({"start": s[0], "end": s[1]})
                if one:
                    edges = [0] + [x for s in one for x in (s["start"], s["end"])] + [len(parts)]
                    parts = [w for x, y in zip(edges[::2], edges[1::2]) for w in parts[x:y]]
                n_removed.append(n_words[-1] - len(parts))
                merged.append(one)
                kept.append(b" ".join(parts))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").slice(a, b - a), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                    pa.array(merged, pa.list_(pa.struct(fields))), pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                ["id", "n_words", "n_removed", "spans", "kept"],
            )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per row of ``docs``: id, ``n_words``, ``n_removed``, ``spans`` removed (maximal, sorted) and the ``kept`` text."""
    repeats = find_repeats(docs, id_col, text_col, length, gram)
    texts = bounded_batches(docs).select(
        F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("row"), F.col(text_col).alias("text")
    )
    id_type = texts.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, n_words long, n_removed long, spans array<struct<start:bigint,end:bigint>>, kept string"
    return _with_row(texts, repeats, "left").select("id", "text", "spans").mapInArrow(_cut, schema).withColumnRenamed("id", id_col)


def op12_substring(spark, sf_dir):
    """Every document with its words, how many go, and a digest of what is left."""
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = f"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') AS words FROM documents),
w AS (
  SELECT doc_id, i, array_to_string(words[i + 1:i + {LENGTH}], ' ') AS passage
  FROM (SELECT doc_id, words, unnest(range(0, len(words) - {LENGTH - 1})) AS i FROM d)),
f AS (SELECT passage, min({{'a': doc_id, 'b': i}}) AS first FROM w GROUP BY passage HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + {LENGTH})) AS place
  FROM w JOIN f USING (passage) WHERE NOT (doc_id = first.a AND i = first.b)),
k AS (
  SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.place) AS kept
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(0, len(words))) AS place FROM d) x
  LEFT JOIN gone g ON g.doc_id = x.doc_id AND g.place = x.place WHERE g.place IS NULL GROUP BY x.doc_id),
g AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)
"""
