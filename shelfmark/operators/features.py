"""TF-IDF vocabularies and vectors as DataFrames.

A *block* is one feature space (category words, department words, department
characters).  Several blocks can be fitted and applied in one pass; their
feature positions follow each other, so a vector over two blocks is the two
blocks side by side.

Vectors are packed, one row each: ``row_id, indices array<int>, weights
array<double>``.  Within a block, positions are numbered from the rarest term to
the most common one.

Terms travel as two 64-bit hashes; only terms that may enter the vocabulary become strings again, in a
second look at the texts (see ``candidate_counts``).  Texts are never shuffled: a task counts the terms
inside each of its rows, and a learnt vocabulary, whose size is a parameter, goes to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfmark.functions import tokens
from shelfmark.operators import ngrams
from shelfmark.operators.ngrams import U, signed
from shelfmark.session import BROADCAST_LIMIT, bounded_batches, broadcast_if_small, drop_table, write_through

#: Counters a task keeps per block while it looks for frequent terms.
COUNTERS = 1 << 20
#: Bytes of one term in a task's lookup table.
TERM_BYTES = 28


@dataclass(frozen=True)
class Block:
    name: str
    text: str
    low: int
    high: int
    max_features: int
    min_df: int = 1
    characters: bool = False

    def joined(self) -> Column:
        """The words of the text in one string, from which the n-grams are cut."""
        text = F.coalesce(F.col(self.text), F.lit(""))
        found = tokens.padded_words(text) if self.characters else tokens.words(text)
        return F.array_join(found, "" if self.characters else " ").alias(self.name)

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        cut = ngrams.character_pieces if self.characters else ngrams.word_pieces
        return cut(data, offsets, self.low, self.high)


CATEGORY = Block("category", "category_text", 1, 2, 50_000)
DEPARTMENT_WORDS = Block("department_words", "department_word_text", 1, 3, 100_000)
DEPARTMENT_CHARS = Block(
    "department_chars", "department_char_text", 3, 5, 50_000, min_df=2, characters=True
)
DEPARTMENT = (DEPARTMENT_WORDS, DEPARTMENT_CHARS)


def _joined(docs: DataFrame, blocks, *keep: str) -> DataFrame:
    return bounded_batches(docs.select(*keep, *[b.joined() for b in blocks]))


def _row_terms(batch: pa.RecordBatch, block: Block) -> Iterator[tuple]:
    """Per group of texts: the bytes, and start, end, row, hashes and count of each distinct term of each row."""
    for row, _, data, offsets in ngrams.text_groups(batch.column(block.name)):
        start, end, text = block.pieces(data, offsets)
        first, second = ngrams.RADIX
        one = first.hashes(first.sums(data), start, end)
        place, tf = ngrams.counted(text, one)
        start, end = start[place], end[place]
        # The second hash is needed once per term and row.
        yield data, start, end, text[place] + row, one[place], second.hashes(second.sums(data), start, end), tf


def _by_term(one: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Place of one occurrence of each distinct hash, and the sums of ``values``."""
    order = np.argsort(one)
    at = np.flatnonzero(np.concatenate([[True], one[order][1:] != one[order][:-1]])[: len(order)])
    return order[at], *(np.add.reduceat(v[order], at) if len(at) else v for v in values)


def _counted_terms(blocks, candidates=None):
    """(block, term, h1, h2, df, ctf) of the terms of each group of texts, or of those in ``candidates``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks:
                for data, start, end, _, one, two, tf in _row_terms(batch, b):
                    if candidates is not None:
                        wanted = candidates.value[b.name]
                        at = np.searchsorted(wanted, one)
                        here = np.flatnonzero(wanted[np.minimum(at, len(wanted) - 1)] == one) if len(wanted) else at[:0]
                        start, end, one, two, tf = (x[here] for x in (start, end, one, two, tf))
                    place, df, ctf = _by_term(one, np.ones(len(one), np.int64), tf)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([b.name]).take(pa.array(np.zeros(len(place), np.int64))), ngrams.cut(data, start[place], end[place]),
                            signed(one[place]), signed(two[place]), pa.array(df), pa.array(ctf),
                        ],
                        ["block", "term", "h1", "h2", "df", "ctf"],
                    )

    return run


COUNTED = "block string, term string, h1 long, h2 long, df long, ctf long"


def corpus_counts(docs: DataFrame, blocks) -> DataFrame:
    """``block, term, df, ctf``: rows holding the term and occurrences in all, of every term.

    Each row gives a term once, with its count; rows are combined inside a task's groups of texts.
    """
    found = _joined(docs, blocks).mapInArrow(_counted_terms(blocks), COUNTED)
    return found.groupBy("block", "term").agg(F.sum("df").alias("df"), F.sum("ctf").alias("ctf"))


class Counters:
    """Misra-Gries counters: terms with lower bounds of their counts; a true count is at most ``error`` higher.

    New counts wait until there are as many as counters, so that each is sorted in a few times, not once per ``add``.
    """

    def __init__(self, capacity: int):
        self.capacity, self._error = capacity, 0
        self._one = self._two = np.zeros(0, U)
        self._low = np.zeros(0, np.int64)
        self._new, self._waiting = [], 0

    def add(self, one: np.ndarray, two: np.ndarray, n: np.ndarray) -> None:
        self._new.append((one, two, n))
        self._waiting += len(n)
        if self._waiting >= self.capacity:
            self._settle()

    def _settle(self) -> None:
        if not self._new:
            return
        one, two, n = (np.concatenate(x) for x in zip((self._one, self._two, self._low), *self._new))
        self._new, self._waiting = [], 0
        place, n = _by_term(one, n)
        one, two = one[place], two[place]
        if len(n) > self.capacity:
            cut = int(np.partition(n, len(n) - self.capacity - 1)[len(n) - self.capacity - 1])
            self._error += cut
            kept = n > cut
            one, two, n = one[kept], two[kept], n[kept] - cut
        self._one, self._two, self._low = one, two, n

    @property
    def one(self) -> np.ndarray:
        self._settle()
        return self._one

    @property
    def two(self) -> np.ndarray:
        self._settle()
        return self._two

    @property
    def low(self) -> np.ndarray:
        self._settle()
        return self._low

    @property
    def error(self) -> int:
        self._settle()
        return self._error


def _sketch(blocks, capacity: int):
    """(block, h1, h2, low): a task's frequent terms; the row without hashes has its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = {b.name: Counters(capacity) for b in blocks}
        for batch in batches:
            for b in blocks:
                for _, _, _, _, one, two, tf in _row_terms(batch, b):
                    place, ctf = _by_term(one, tf)
                    counters[b.name].add(one[place], two[place], ctf)
        for name, c in counters.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(c.one), pa.string()), signed(c.one), signed(c.two), pa.array(c.low)], ["block", "h1", "h2", "low"]
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([c.error], pa.int64())],
                ["block", "h1", "h2", "low"],
            )

    return run


def _hash_counts(blocks, capacity: int):
    """(block, h1, h2, df, ctf) of all terms of a task, sums of up to about ``capacity`` terms at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {b.name: [] for b in blocks}
        size = dict.fromkeys(held, 0)

        def summed(name: str) -> None:
            one, two, df, ctf = (np.concatenate(x) for x in zip(*held[name]))
            place, df, ctf = _by_term(one, df, ctf)
            held[name] = [(one[place], two[place], df, ctf)]
            size[name] = len(place)

        def given(name: str) -> pa.RecordBatch:
            one, two, df, ctf = held[name].pop()
            size[name] = 0
            return pa.RecordBatch.from_arrays(
                [pa.array([name]).take(pa.array(np.zeros(len(one), np.int64))), signed(one), signed(two), pa.array(df), pa.array(ctf)],
                ["block", "h1", "h2", "df", "ctf"],
            )

        for batch in batches:
            for b in blocks:
                for _, _, _, _, one, two, tf in _row_terms(batch, b):
                    place, df, ctf = _by_term(one, np.ones(len(one), np.int64), tf)
                    held[b.name].append((one[place], two[place], df, ctf))
                    size[b.name] += len(place)
                    if size[b.name] > 2 * capacity:
                        summed(b.name)
                        if size[b.name] > capacity:
                            yield given(b.name)
        for name in held:
            if held[name]:
                summed(name)
                yield given(name)

    return run


def candidate_counts(docs: DataFrame, blocks, capacity: int = COUNTERS, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Exact ``block, term, h1, h2, df, ctf`` of all terms that can be among the most frequent ones, written.

    1. Each task counts into ``capacity`` counters and reports them with the most a missing term can have; only
       these are shuffled.
    2. The n-th largest lower bound is a floor under the n-th largest count.  Terms whose upper bound reaches it
       are candidates; their exact counts and their strings come from a second look at the texts.
    3. Proof: if the n-th candidate's count is above what any other term can have, none is missing.
    4. If not, all terms are counted by their hashes alone; those that reach the n-th largest count are candidates.
    5. If the candidates exceed ``limit`` bytes even so, all terms are counted with their strings.
    """
    texts = _joined(docs, blocks)
    sketch = texts.mapInArrow(_sketch(blocks, capacity), "block string, h1 long, h2 long, low long")
    sketch = write_through(sketch.groupBy("block", "h1", "h2").agg(F.sum("low").alias("low")), "term-sketch")
    error = {r["block"]: r["low"] for r in sketch.where("h1 is null").collect()}  # one row per block
    known = sketch.where("h1 is not null")
    # A block with a document floor looks further down, since terms below the floor don't count.
    wanted = {b.name: b.max_features if b.min_df == 1 else b.max_features + b.max_features // 4 for b in blocks}
    floors = _cuts(known.select("block", F.col("low").alias("ctf")), wanted)
    bound = {n: floors[n][0] - error.get(n, 0) if n in floors else 0 for n in wanted}
    at_least = reduce(lambda acc, n: acc.when(F.col("block") == n, bound[n]), wanted, F)
    chosen = known.where(F.col("low") >= at_least)
    sizes = {r["block"]: r["n"] for r in chosen.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}
    # A term without a counter has at most the error; one below the bound has less than the floor.
    complete = all(error.get(n, 0) == 0 or (n in floors and error[n] < floors[n][0]) for n in wanted)
    if complete and 8 * sum(sizes.values()) <= limit:
        counts = _exact(texts.mapInArrow(_counted_terms(blocks, _lookup(chosen, wanted)), COUNTED))
        if _proven(counts, blocks, {n: max(error.get(n, 0), floors[n][0] - 1) if n in floors else 0 for n in wanted}):
            drop_table(sketch)
            return counts
        drop_table(counts)
    drop_table(sketch)
    hashes = texts.mapInArrow(_hash_counts(blocks, capacity), "block string, h1 long, h2 long, df long, ctf long")
    hashes = write_through(hashes.groupBy("block", "h1", "h2").agg(F.sum("df").alias("df"), F.sum("ctf").alias("ctf")), "term-hashes")
    kept = hashes.where(F.col("df") >= reduce(lambda acc, b: acc.when(F.col("block") == b.name, b.min_df), blocks, F))
    cuts = _cuts(kept, {b.name: b.max_features for b in blocks})
    chosen = kept.where(F.col("ctf") >= reduce(lambda acc, b: acc.when(F.col("block") == b.name, cuts.get(b.name, (0, 0))[0]), blocks, F))
    lookup = _lookup(chosen, wanted) if 8 * chosen.count() <= limit else None
    drop_table(hashes)
    return _exact(texts.mapInArrow(_counted_terms(blocks, lookup), COUNTED))


def _lookup(chosen: DataFrame, names):
    """Per block the sorted hashes of the ``chosen`` terms, sent to the tasks; the caller has measured them."""
    parts = {n: [] for n in names}
    for batch in chosen.select("block", "h1").toArrow().to_batches():
        blocks, hashes = batch.column("block").to_numpy(zero_copy_only=False), batch.column("h1").to_numpy().view(U)
        for n in parts:
            parts[n].append(hashes[blocks == n])
    lookup = {n: np.unique(np.concatenate(p)) if p else np.zeros(0, U) for n, p in parts.items()}
    return chosen.sparkSession.sparkContext.broadcast(lookup)


def _exact(found: DataFrame) -> DataFrame:
    """Sums by hash, written; two terms of one hash are an error."""
    one = F.min("term") == F.max("term")
    term = F.when(one, F.min("term")).otherwise(F.raise_error(F.lit("two terms have the same hashes")))
    summed = found.groupBy("block", "h1", "h2").agg(term.alias("term"), F.sum("df").alias("df"), F.sum("ctf").alias("ctf"))
    return write_through(summed.select("block", "term", "h1", "h2", "df", "ctf"), "term-counts")


def _proven(counts: DataFrame, blocks, others: dict[str, int]) -> bool:
    """Whether every block's n-th count is above ``others``, the most a term that wasn't counted can have."""
    if not any(others.values()):
        return True
    floor = reduce(lambda acc, b: acc.when(F.col("block") == b.name, b.min_df), blocks, F)
    cuts = _cuts(counts.where(F.col("df") >= floor), {b.name: b.max_features for b in blocks}, full=True)
    return all(not most or (n in cuts and cuts[n][0] > most) for n, most in others.items())


def _cuts(counts: DataFrame, limits: dict[str, int], full: bool = False) -> dict[str, tuple[int, int]]:
    """Per block with more terms than its limit (``full``: as many): the count at which the limit is reached, and
    the number of terms above it; from a histogram of the counts, which has few rows, as counts repeat."""
    limit = reduce(lambda acc, n: acc.when(F.col("block") == n, limits[n]), limits, F)
    down = Window.partitionBy("block").orderBy(F.desc("ctf"))
    reached = (F.col("upto") >= limit) if full else (F.col("upto") > limit)
    below = (F.col("upto") - F.col("n") < limit) if full else (F.col("upto") - F.col("n") <= limit)
    rows = (
        counts.groupBy("block", "ctf")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", F.sum("n").over(down))
        .where(reached & below)
        .groupBy("block")
        .agg(F.max("ctf").alias("cut"), F.max_by(F.col("upto") - F.col("n"), "ctf").alias("above"))
        .collect()  # one row per block
    )
    return {r["block"]: (r["cut"], r["above"]) for r in rows}


def top_terms(counts: DataFrame, blocks) -> DataFrame:
    """The ``max_features`` most frequent terms of each block, ties by term; ``counts`` is read several times.

    A histogram of the exact counts (few rows, as counts repeat) gives the count at which the limit is
    reached.  Terms above it are taken without any ranking; only the ties at it are put in order, by a
    distributed top-k.
    """
    floor = reduce(lambda acc, b: acc.when(F.col("block") == b.name, b.min_df), blocks, F)
    kept = counts.where(F.col("df") >= floor)
    cuts = _cuts(kept, {b.name: b.max_features for b in blocks})
    parts = []
    for b in blocks:
        own = kept.where(F.col("block") == b.name)
        if b.name not in cuts:
            parts.append(own)
            continue
        cut, above = cuts[b.name]
        parts.append(own.where(F.col("ctf") > cut))
        parts.append(own.where(F.col("ctf") == cut).orderBy("term").limit(b.max_features - above))
    return reduce(DataFrame.unionByName, parts)


def inverse_document_frequency(df: Column, n_docs: Column) -> Column:
    return F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + df)) + F.lit(1.0)


def vocabulary(docs: DataFrame, blocks, counts: DataFrame | None = None) -> DataFrame:
    """``block, term, h1, h2, idx, df, idf``: the learnt terms of all blocks; ``counts`` are ``candidate_counts``."""
    if counts is None:
        counts = candidate_counts(docs, blocks)
    n_docs = docs.agg(F.count(F.lit(1))).scalar()
    offset = F
    before = 0
    for b in blocks:
        offset = offset.when(F.col("block") == b.name, before)
        before += b.max_features
    # At most max_features rows per block reach this ranking.
    rarest_first = Window.partitionBy("block").orderBy("df", "term")
    return top_terms(counts, blocks).select(
        "block",
        "term",
        "h1",
        "h2",
        (F.row_number().over(rarest_first) - 1 + offset).cast("int").alias("idx"),
        "df",
        inverse_document_frequency(F.col("df"), n_docs).alias("idf"),
    )


def fit(docs: DataFrame, blocks, counts: DataFrame | None = None) -> DataFrame:
    """Learn the vocabulary and write it through, ready for repeated use."""
    return write_through(vocabulary(docs, blocks, counts), "vocabulary")


def n_features(blocks) -> int:
    return sum(b.max_features for b in blocks)


def _row_hashes(blocks):
    """(row_id, block, h1, h2, tf) of the distinct terms of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks:
                for _, _, _, row, one, two, tf in _row_terms(batch, b):
                    names = pa.array([b.name]).take(pa.array(np.zeros(len(row), np.int64)))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("row_id").take(pa.array(row)), names, signed(one), signed(two), pa.array(tf)],
                        ["row_id", "block", "h1", "h2", "tf"],
                    )

    return run


def weigh(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """``row_id, idx, raw``: sublinear count times idf of ``counts`` (row_id, block, h1, h2, tf); unknown terms are dropped."""
    known = vocab.select("block", "h1", "h2", "idx", "idf")
    return counts.join(known, ["block", "h1", "h2"]).select(
        "row_id", "idx", ((F.lit(1.0) + F.log(F.col("tf").cast("double"))) * F.col("idf")).alias("raw")
    )


def _weigh_rows(blocks, shared, keep=()):
    """Packed vectors of the rows that have a known term; ``shared`` has hashes, positions and idf by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for k, b in enumerate(blocks):
                h1, h2, idx, idf = shared.value[b.name]
                for _, _, _, row, one, two, tf in _row_terms(batch, b):
                    at = np.minimum(np.searchsorted(h1, one), max(len(h1) - 1, 0))
                    known = np.flatnonzero((h1[at] == one) & (h2[at] == two)) if len(h1) else at[:0]
                    at = at[known]
                    parts.append((row[known], np.full(len(at), k), idx[at], (1.0 + np.log(tf[known])) * idf[at]))
            if not parts:
                continue
            row, block, idx, raw = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((idx, row))
            row, block, idx, raw = row[order], block[order], idx[order], raw[order]
            # Positions of a row ascend by block, so its blocks follow each other.
            own = row * len(blocks) + block
            opens = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])[: len(own)])
            if len(opens):
                length = np.sqrt(np.add.reduceat(raw * raw, opens))
                raw = raw / np.repeat(length, np.diff(np.append(opens, len(own))))
            rows, sizes = np.unique(row, return_counts=True)
            bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).take(pa.array(rows)) for c in ("row_id", *keep)),
                    pa.ListArray.from_arrays(bounds, pa.array(idx.astype(np.int32))), pa.ListArray.from_arrays(bounds, pa.array(raw)),
                ],
                ["row_id", *keep, "indices", "weights"],
            )

    return run


def pack(weighed: DataFrame, blocks) -> DataFrame:
    """Packed vectors, each block scaled to length 1.

    The squares are added up in feature order, so equal texts give exactly equal
    weights wherever they are computed.
    """
    vec = (
        weighed.groupBy("row_id")
        .agg(F.array_sort(F.collect_list(F.struct("idx", "raw"))).alias("vec"))
    )
    bounds, start = [], 0
    for b in blocks:
        bounds.append((start, start + b.max_features))
        start += b.max_features

    def length(lo, hi):
        def add(acc, x):
            inside = (x["idx"] >= lo) & (x["idx"] < hi)
            return acc + F.when(inside, x["raw"] * x["raw"]).otherwise(F.lit(0.0))

        return F.sqrt(F.aggregate("vec", F.lit(0.0), add))

    lengths = vec.select("row_id", "vec", *[length(*b).alias(f"len{i}") for i, b in enumerate(bounds)])

    def scaled(x):
        out = F
        for i, (_, hi) in enumerate(bounds):
            own = F.col(f"len{i}")
            out = out.when((x["idx"] < hi) & (own > 0), x["raw"] / own)
        return out

    return lengths.select(
        "row_id",
        F.col("vec.idx").alias("indices"),
        F.transform("vec", scaled).alias("weights"),
    )


def vectors(docs: DataFrame, vocab: DataFrame, blocks, *keep: str, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Apply a learnt vocabulary.  Rows without a known term have no vector; columns of ``keep`` stay beside it.

    A vocabulary has at most ``n_features`` terms; up to ``limit`` bytes it goes to the tasks, beyond it terms and
    vocabulary meet by hash.
    """
    if keep and not _one_row_each(docs):
        # Rows of one id have each other's columns, as joins by id give them.
        return vectors(docs, vocab, blocks, limit=limit).join(docs.select("row_id", *keep), "row_id").select("row_id", *keep, "indices", "weights")
    texts = _joined(docs, blocks, "row_id", *keep)
    if n_features(blocks) * TERM_BYTES > limit:
        found = texts.mapInArrow(_row_hashes(blocks), "row_id long, block string, h1 long, h2 long, tf long")
        packed = pack(weigh(found, vocab), blocks)
        return packed.join(docs.select("row_id", *keep), "row_id").select("row_id", *keep, "indices", "weights") if keep else packed
    rows = vocab.select("block", "h1", "h2", "idx", "idf").toPandas()  # at most ``limit`` bytes
    lookup = {}
    for b in blocks:
        own = rows[rows["block"] == b.name]
        h1 = own["h1"].to_numpy(np.int64).view(U)
        order = np.argsort(h1)
        lookup[b.name] = (
            h1[order], own["h2"].to_numpy(np.int64).view(U)[order], own["idx"].to_numpy(np.int64)[order], own["idf"].to_numpy(np.float64)[order],
        )
    shared = docs.sparkSession.sparkContext.broadcast(lookup)
    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) if keep else ""
    return texts.mapInArrow(_weigh_rows(blocks, shared, keep), f"row_id long{kept}, indices array<int>, weights array<double>")


def _one_row_each(docs: DataFrame) -> bool:
    """Whether every row of ``docs`` has an id of its own."""
    return docs.groupBy("row_id").count().where("count > 1 or row_id is null").isEmpty()


def long_form(packed: DataFrame) -> DataFrame:
    """``row_id, idx, weight``: one row per non-zero weight."""
    return packed.select(
        "row_id", F.explode(F.arrays_zip("indices", "weights")).alias("x")
    ).select("row_id", F.col("x.indices").alias("idx"), F.col("x.weights").alias("weight"))


def tfidf(docs: DataFrame, vocab: DataFrame, blocks) -> DataFrame:
    """Long TF-IDF table with terms: ``row_id, block, term, weight``."""
    names = vocab.select("idx", "block", "term")
    return long_form(vectors(docs, vocab, blocks)).join(broadcast_if_small(names), "idx").select(
        "row_id", "block", "term", "weight"
    )
