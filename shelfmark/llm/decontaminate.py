"""Benchmark decontamination with an FM-index per training shard.

A shard is a group of texts inside a task.  Its index is built over word numbers: a word that no test
phrase has is a stop symbol, and stretches between stops that are shorter than the shortest phrase can't
hold one and are left out, so the index covers exactly the words that could match.  Suffixes are sorted by
prefix doubling, the last column is held as a wavelet matrix, and suffix positions are sampled.  All test
phrases of a length search backward together; rows of the survivors walk to a sampled position, and the
words they cover are merged to removal spans.

Test phrases come in blocks of about ``BLOCK_BYTES`` of benchmark text, each one broadcast of bounded size
and one pass; a document's findings of all blocks are merged by a group over short rows.  Texts are never
shuffled.  Words are known by 64-bit hashes of their lower-cased bytes.

Defined cases: null or empty texts have no words, on both sides; an item without words finds nothing; a
null item id counts as the empty id, rows with one item id are one item; repeated documents give repeated
rows; an empty benchmark leaves everything clean; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfmark.llm.common import BROADCAST_BYTES, bounded_batches, row_key, table
from shelfmark.llm.textbytes import LETTERS, STEP, U, groups, mixed, word_hashes, words
from shelfmark.session import broadcast_if_small, write_through

WINDOW = 10
BLOCK_BYTES = 8 * 1024 * 1024
SHARD_BYTES = 1024 * 1024
SAMPLE = 8


class Phrases:
    """The distinct windows of some items: word numbers by window length, and the items of each window."""

    def __init__(self, items: list[tuple[str, str]], width: int = WINDOW):
        batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in items], pa.large_string())], ["text"])
        self.item_ids = sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(self.item_ids)}
        hashes, owners = [np.zeros(0, U)], [np.zeros(0, np.int64)]
        for a, _, data, offsets in groups(batch, "text"):
            starts, ends, text = words(data, offsets, LETTERS)
            hashes.append(word_hashes(data, starts, ends))
            owners.append(text + a)
        hashes, owner = np.concatenate(hashes), np.concatenate(owners)
        self.vocabulary, word = np.unique(hashes, return_inverse=True)
        word = word.astype(np.int32) + 2  # 0 ends the shard, 1 is a stop
        counts = np.bincount(owner, minlength=len(items))
        first = np.cumsum(counts) - counts
        length = np.minimum(counts, width)
        per_item = np.where(counts > 0, counts - length + 1, 0)
        row_item = np.repeat(np.arange(len(items)), per_item)
        begin = first[row_item] + np.arange(len(row_item)) - (np.cumsum(per_item) - per_item)[row_item]
        size = length[row_item]
        key = mixed(size.astype(U))
        for j in range(width):
            inside = j < size
            key[inside] = mixed(key[inside] * STEP + word[begin[inside] + j].astype(U))
        self.words = word
        _, chosen, same = np.unique(key, return_index=True, return_inverse=True)
        self.begin, self.size = begin[chosen], size[chosen]
        owners = np.array([number[i] for i, _ in items], np.int64)[row_item]
        pairs = np.unique(np.stack([same.ravel(), owners]), axis=1) if len(same) else np.zeros((2, 0), np.int64)
        self.items = pairs[1]
        self.item_bounds = np.searchsorted(pairs[0], np.arange(len(chosen) + 1))
        self.shortest = int(self.size.min()) if len(chosen) else 0


def numbers(vocabulary: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Word numbers of a shard; 1 where no phrase has the word."""
    if not len(vocabulary):
        return np.ones(len(hashes), np.int32)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at + 2, 1).astype(np.int32)


class FMIndex:
    """Backward search and locating over a sequence of symbols that ends in its only 0."""

    def __init__(self, symbols: np.ndarray, sample: int = SAMPLE):
        n = len(symbols)
        order = _suffixes(symbols)
        last = symbols[order - 1]  # the symbol before the first suffix is the final 0
        top = int(symbols.max()) if n else 0
        counts = np.bincount(symbols, minlength=top + 2)
        self.before = np.concatenate([[0], np.cumsum(counts)])  # symbols smaller than c
        self.bits = list(range(max(1, top.bit_length()) - 1, -1, -1))
        self.ones, self.zeros, column = [], [], last
        for b in self.bits:
            bit = (column >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(n - int(self.ones[-1][-1]))
            column = np.concatenate([column[bit == 0], column[bit == 1]])
        self.start = self._down(np.arange(top + 1), np.zeros(top + 1, np.int64))
        self.marked = order % sample == 0
        self.mark_rank = np.cumsum(self.marked) - 1
        self.samples = order[self.marked]
        self.n = n

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for b, ones, zeros in zip(self.bits, self.ones, self.zeros):
            up = ones[at]
            at = np.where((symbol >> b) & 1, zeros + up, at - up)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs in the last column before row ``at``."""
        return self._down(symbol, at) - self.start[symbol]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrase numbers with their row ranges, for the rows of a matrix of symbols that occur."""
        who = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[who, j]
            known = symbol < len(self.start)
            who, symbol, low, high = who[known], symbol[known], low[known], high[known]
            low = self.before[symbol] + self.rank(symbol, low)
            high = self.before[symbol] + self.rank(symbol, high)
            open_ = low < high
            who, low, high = who[open_], low[open_], high[open_]
        return who, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in ``rows``: steps back to a sampled one, counted."""
        rows, found, steps = rows.copy(), np.zeros(len(rows), np.int64), 0
        left = np.arange(len(rows))
        while len(left):
            here = rows[left]
            done = self.marked[here]
            found[left[done]] = self.samples[self.mark_rank[here[done]]] + steps
            left, here = left[~done], here[~done]
            at, symbol = here, np.zeros(len(here), np.int64)
            for b, ones, zeros in zip(self.bits, self.ones, self.zeros):
                up = ones[at]
                bit = ones[at + 1] - up
                symbol |= bit.astype(np.int64) << b
                at = np.where(bit, zeros + up, at - up)
            rows[left] = self.before[symbol] + at - self.start[symbol]
            steps += 1
        return found


def _suffixes(symbols: np.ndarray) -> np.ndarray:
    """Suffix positions in order, by prefix doubling; ranks that are settled are not sorted again."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    rank = np.zeros(n, np.int64)
    step = symbols[order[1:]] != symbols[order[:-1]]
    rank[order[1:]] = np.cumsum(step)  # rank = number of groups before
    rank[order] = _group_starts(rank[order])
    width = 1
    while True:
        sorted_rank = rank[order]
        open_ = np.zeros(n, bool)
        same = sorted_rank[1:] == sorted_rank[:-1]
        open_[1:] |= same
        open_[:-1] |= same
        if not same.any():
            return order
        rows = np.flatnonzero(open_)
        suffix = order[rows]
        after = np.where(suffix + width < n, rank[np.minimum(suffix + width, n - 1)] + 1, 0)
        key = sorted_rank[rows] * (n + 2) + after
        inner = np.argsort(key, kind="stable")
        order[rows] = suffix[inner]
        key = key[inner]
        # Each open group keeps its rows; its members get the row of the first equal key as rank.
        fresh = np.ones(len(rows), bool)
        fresh[1:] = key[1:] != key[:-1]
        rank[order[rows]] = rows[np.maximum.accumulate(np.where(fresh, np.arange(len(rows)), 0))]
        width *= 2


def _group_starts(sorted_groups: np.ndarray) -> np.ndarray:
    fresh = np.ones(len(sorted_groups), bool)
    fresh[1:] = sorted_groups[1:] != sorted_groups[:-1]
    return np.maximum.accumulate(np.where(fresh, np.arange(len(sorted_groups)), 0))


def occurrences(phrases, number: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, first word) of all occurrences among the words of a shard (numbers and text numbers)."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not phrases.shortest or not len(number):
        return none
    stop = np.ones(len(number) + 1, bool)  # whether a stretch ends before word i
    stop[1:-1] = (number[1:] == 1) | (number[:-1] == 1) | (text[1:] != text[:-1])
    bounds = np.flatnonzero(stop)
    long_enough = (np.diff(bounds) >= phrases.shortest) & (number[bounds[:-1]] != 1)
    begin, size = bounds[:-1][long_enough], np.diff(bounds)[long_enough]
    if not len(begin):
        return none
    # Stretches one after the other, each followed by a stop; the last symbol ends the shard.
    place = np.cumsum(size + 1) - size - 1
    total = int(size.sum()) + len(size)
    symbols, word = np.ones(total + 1, np.int64), np.full(total + 1, -1, np.int64)
    inside = np.repeat(place - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    word[inside] = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    symbols[inside] = number[word[inside]]
    symbols[-1] = 0
    index, found = FMIndex(symbols), []
    for length in np.unique(phrases.size).tolist():
        own = np.flatnonzero(phrases.size == length)
        matrix = phrases.words[phrases.begin[own][:, None] + np.arange(length)].astype(np.int64)
        who, low, high = index.search(matrix)
        many = high - low
        rows = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        found.append((own[np.repeat(who, many)], word[index.locate(rows)]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _search(phrases_of, all_rows: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = SimpleNamespace(**phrases_of.value)
        ids = np.array(phrases.item_ids, object)
        span_type = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for a, b, data, offsets in groups(batch, "text", SHARD_BYTES):
                starts, ends, text = words(data, offsets, LETTERS)
                number = numbers(phrases.vocabulary, word_hashes(data, starts, ends))
                phrase, word = occurrences(phrases, number, text)
                edge = np.zeros(len(starts) + 1, np.int64)
                np.add.at(edge, word, 1)
                np.add.at(edge, word + phrases.size[phrase], -1)
                hit = np.cumsum(edge)[:-1] > 0
                opens = hit & np.concatenate([[True], ~hit[:-1] | (text[1:] != text[:-1])]) if len(hit) else hit
                closes = hit & np.concatenate([opens[1:] | ~hit[1:], [True]]) if len(hit) else hit
                first, last = np.flatnonzero(opens), np.flatnonzero(closes)
                word_base = np.searchsorted(text, np.arange(b - a + 1))
                n_words = np.diff(word_base)
                spans: list[list] = [[] for _ in range(b - a)]
                items: list[list] = [[] for _ in range(b - a)]
                if len(first):
                    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    for f, l in zip(first.tolist(), last.tolist()):
                        t = int(text[f])
                        zero = int(points[offsets[t]])
                        spans[t].append({
                            "first": f - int(word_base[t]), "last": l - int(word_base[t]),
                            "start": int(points[starts[f]]) - zero, "end": int(points[ends[l]]) - zero,
                        })
                    seen = np.unique(np.stack([text[word], phrase]), axis=1)
                    for t, p in seen.T.tolist():
                        items[t].append(phrases.items[phrases.item_bounds[p] : phrases.item_bounds[p + 1]])
                found = [sorted(set(ids[np.concatenate(x)].tolist())) if x else [] for x in items]
                out = pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(a, b - a) for c in ("id", "row1", "row2")]
                    + [pa.array(n_words.astype(np.int64)), pa.array(spans, span_type), pa.array(found, pa.list_(pa.string()))],
                    ["id", "row1", "row2", "n_words", "spans", "items"],
                )
                yield out if all_rows else out.filter(pa.array([bool(x) for x in spans]))

    return run


#: Overlapping or touching removal spans of several blocks become one.
MERGED = """aggregate(array_sort(flatten(collect_list(spans))), cast(array() as array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>),
  (a, s) -> if(size(a) > 0 and s.first <= element_at(a, -1).last + 1,
    concat(slice(a, 1, size(a) - 1), array(named_struct('first', element_at(a, -1).first, 'last', greatest(element_at(a, -1).last, s.last),
      'start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, s.end)))),
    concat(a, array(s))))"""


def find_passages(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Per row of ``docs``: id, row1, row2 (its key), n_words, ``spans`` to remove (words ``first`` to
    ``last``, code points ``start`` to ``end``), and ``items``, the ids of the items found, sorted."""
    spark = docs.sparkSession
    asked = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("text")).where("text is not null")
    # No window spans rows and findings are united by item, so equal rows count once and blocks may cut an item.
    asked = write_through(asked.distinct(), "test-items")
    size = asked.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    texts = bounded_batches(docs).select(
        F.col(id_col).alias("id"), *[k.alias(n) for k, n in zip(row_key(id_col, text_col), ("row1", "row2"))], F.col(text_col).alias("text")
    )
    schema = (
        f"id {texts.schema['id'].dataType.simpleString()}, row1 long, row2 long, n_words long,"
        " spans array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>, items array<string>"
    )
    found = None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
        phrases = spark.sparkContext.broadcast(vars(Phrases([(r["item"], r["text"]) for r in rows])))
        part = texts.mapInArrow(_search(phrases, block == 0), schema)
        if blocks > 1:  # one block's phrases are held at a time
            part = write_through(part, "test-found")
            phrases.destroy()
        found = part if found is None else found.unionByName(part)
    if blocks == 1:
        return found
    merged = found.groupBy("id", "row1", "row2").agg(
        F.max("n_words").alias("n_words"),
        F.expr(MERGED).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return texts.select("row1", "row2").join(merged, ["row1", "row2"]).select("id", "row1", "row2", "n_words", "spans", "items")


def op4_decontaminate(spark, sf_dir):
    """Every document with its words, words hit and items found."""
    found = find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.expr("aggregate(spans, 0L, (a, s) -> a + s.last - s.first + 1)")
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def remove_passages(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """``docs`` with the spans cut out of their texts, a line break in the place of each."""
    found = find_passages(docs, items, id_col, text_col, **names).where(F.size("spans") > 0).select("row1", "row2", "spans")
    found = write_through(found.dropDuplicates(["row1", "row2"]), "test-spans").toDF("cut row1", "cut row2", "cut spans")
    keyed = docs.withColumns(dict(zip(("cut row1", "cut row2"), row_key(id_col, text_col))))
    pieces = (
        "zip_with(concat(array(0L), `cut spans`.end), concat(`cut spans`.start, array(cast(length({0}) as bigint))),"
        " (a, b) -> substring({0}, cast(a + 1 as int), cast(b - a as int)))"
    ).format(f"`{text_col}`")
    cut = F.when(F.col("cut spans").isNull(), F.col(text_col)).otherwise(F.expr(f"array_join({pieces}, '\\n')"))
    joined = keyed.join(broadcast_if_small(found, BROADCAST_BYTES), ["cut row1", "cut row2"], "left")
    return joined.withColumn(text_col, cut).select(*docs.columns)


def stage(spark, docs, sf_dir):
    """Pipeline stage: documents that hold a benchmark passage go."""
    found = find_passages(docs, table(spark, sf_dir, "benchmark")).where(F.size("spans") > 0)
    gone = write_through(found.select("row1", "row2").distinct(), "test-documents").toDF("gone row1", "gone row2")
    keyed = docs.withColumns(dict(zip(("gone row1", "gone row2"), row_key("doc_id", "text"))))
    return keyed.join(broadcast_if_small(gone, BROADCAST_BYTES), ["gone row1", "gone row2"], "left_anti").select(*docs.columns)


ORACLE = f"""
WITH b AS (
  SELECT item_id::VARCHAR AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS words
  FROM benchmark),
p AS (
  SELECT DISTINCT item, len(words[i:i + {WINDOW - 1}]) AS n, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, greatest(len(words) - {WINDOW}, 0) + 2)) AS i FROM b WHERE len(words) > 0)),
d AS (
  SELECT doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS words
  FROM documents),
s AS (
  SELECT doc_id, i, n, array_to_string(words[i:i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM d) CROSS JOIN (SELECT DISTINCT n FROM p)
  WHERE i + n - 1 <= len(words)),
h AS (SELECT s.doc_id, s.i, s.n, p.item FROM s JOIN p ON s.n = p.n AND s.phrase = p.phrase),
c AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS w FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(g.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(g.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN g USING (doc_id)
"""
