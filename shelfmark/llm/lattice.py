"""Likelihood of texts under a subword lattice: every segmentation of a word counts.

Pieces come from a public vocabulary file whose path is a parameter; their first scores are the file's.
Words are scored over their UTF-8 bytes after a blank (the file's word mark); all 256 single bytes are
pieces too, so every text has a segmentation.  A word's probability is the sum over its segmentations,
found by a forward recursion in log space; a text's is the product over its words and one end, which is a
piece of its own: the marginal probability of the text, and nothing else, is ``score``.  The pieces'
probabilities are fitted to the training texts by expectation-maximisation: expected counts over the distinct
training words, each weighted by its count.

``word_score`` is a further column for comparison: there a word seen in training has one more arc, over the
whole word, with its discounted relative frequency, and the discount's share goes to the segmentations.

1. Tasks count the words of their texts; one aggregation by word gives the word table.
2. ``ROUNDS`` passes over the word table sum expected piece counts; one number per piece of the vocabulary
   reaches the driver.  A last pass stores each word's log probabilities beside its count.
3. The ``HEAD_WORDS`` most frequent words at most are broadcast; a text's other words are kept with its row
   and joined with the word table by hash.  Both ways together are exact at any size.

Words are known by 64-bit hashes.  Defined cases: a null or empty text is one end and nothing else; a null
id counts as the empty id for the fold; repeated rows are separate texts; without training texts all counts
are 0 and the file's scores stand; bytes of no longer piece use the byte pieces; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfmark.llm.common import bounded_batches, in_fold, table
from shelfmark.llm.textbytes import (
    BYTE_VALUES, LOWER, NOT_BLANK, U, groups, mixed, powers, word_hashes, words,
)
from shelfmark.session import write_through

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
WORD_MARK = "▁"
ROUNDS = 3
END_WITHOUT_TEXTS = 1e-3
PSEUDO_COUNT = 0.05
HEAD_WORDS = 1 << 18
GROUP = 1 << 21
WORDS_AT_ONCE = 1 << 16


def read_vocabulary(path: str = VOCABULARY) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes, the word mark as a blank, and log probabilities from the file's scores.

    Scores that are ranks (a merge vocabulary counts down from 0) are read as Zipf weights; scores that are
    log probabilities are taken as they are.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scores: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i).replace(WORD_MARK, " ").encode()
        if b" " in piece[1:]:
            continue  # a run of blanks or two words: no word holds it
        scores[piece] = max(scores.get(piece, -math.inf), model.get_score(i))
    values = np.array(list(scores.values()))
    if len(values) and values.min() < -1000:
        values = -np.log(10 - values)
    lowest = values.min() - 1 if len(values) else 0.0
    pieces = list(scores) + [bytes([b]) for b in range(256) if bytes([b]) not in scores]
    log_p = np.concatenate([values, np.full(len(pieces) - len(values), lowest)])
    return pieces, log_p - np.log(np.exp(log_p).sum())


class Pieces:
    """Pieces that are found by the hash of their bytes."""

    def __init__(self, pieces: list[bytes]):
        sizes = np.array([len(p) for p in pieces])
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        hashes = word_hashes(data, ends - sizes, ends, BYTE_VALUES)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.longest = int(sizes.max())
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(hashes >> U(44)).astype(np.int64)] = True


def arcs(pieces, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """All pieces inside the words: (first byte, byte after, piece, end within its word, length), by the latter two."""
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=sums[1:])
    room = np.repeat(ends, ends - starts) - np.arange(len(data))
    inside = np.arange(len(data)) - np.repeat(starts, ends - starts)
    begin = np.arange(len(data))
    found = []
    for length in range(1, pieces.longest + 1):
        begin = begin[room[begin] >= length]
        if not len(begin):
            break
        hashes = mixed((sums[begin + length] - sums[begin]) * down[begin] + U(length))
        near = pieces.maybe[(hashes >> U(44)).astype(np.int64)]
        hashes, here = hashes[near], begin[near]
        at = np.minimum(np.searchsorted(pieces.hashes, hashes), len(pieces.hashes) - 1)
        hit = pieces.hashes[at] == hashes
        here = here[hit]
        found.append((here, here + length, pieces.order[at[hit]], inside[here] + length, np.full(len(here), length)))
    first, after, piece, end, length = (np.concatenate(x) for x in zip(*found))
    order = _by(end, length)
    return first[order], after[order], piece[order], end[order], length[order]


def _by(place: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Order by place in the word, then length; small keys take the radix sort of 16-bit numbers."""
    wide = int(length.max()) + 1 if len(length) else 1
    key = place * wide + length
    return np.argsort(key.astype(np.uint16) if len(key) and key.max() < 1 << 16 else key, kind="stable")


def _steps(end: np.ndarray, length: np.ndarray) -> list[tuple[int, int]]:
    """Runs of arcs with equal end and length: at most one of each word."""
    change = np.flatnonzero((end[1:] != end[:-1]) | (length[1:] != length[:-1])) + 1
    bounds = [0, *change.tolist(), len(end)]
    return list(zip(bounds[:-1], bounds[1:]))


def lattice(pieces, log_p: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, weights=None):
    """Log probabilities of the words; with ``weights``, also the expected piece counts.

    ``data`` holds the words one after the other, each with its blank in front.
    """
    first, after, piece, end, length = arcs(pieces, data, starts, ends)
    # Node i + word number stands before byte i of its word; one more node ends each word.
    word = np.repeat(np.arange(len(starts)), ends - starts)[first]
    source, target = first + word, after + word
    opening, closing = starts + np.arange(len(starts)), ends + np.arange(len(starts))
    gain = log_p[piece]
    forward = np.full(len(data) + len(starts), -np.inf)
    forward[opening] = 0
    steps = _steps(end, length)
    for a, b in steps:
        t = target[a:b]
        forward[t] = np.logaddexp(forward[t], forward[source[a:b]] + gain[a:b])
    total = forward[closing]
    if weights is None:
        return total, None
    # Backward: by first byte from the right; arcs of one start and length belong to different words.
    start = end - length
    order = _by(start, length)[::-1]
    backward = np.full(len(forward), -np.inf)
    backward[closing] = 0
    s, t, g = source[order], target[order], gain[order]
    for a, b in _steps(start[order], length[order]):
        x = s[a:b]
        backward[x] = np.logaddexp(backward[x], backward[t[a:b]] + g[a:b])
    share = np.exp(forward[source] + gain + backward[target] - total[word]) * weights[word]
    return total, np.bincount(piece, weights=share, minlength=len(log_p))


def _packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of a binary column with a blank in front of each: bytes, starts, ends."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    old = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    sizes = np.diff(offsets)
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    data = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
    keep = np.ones(len(data), bool)
    keep[starts] = False
    data[keep] = old[offsets[0] : offsets[-1]]
    return data, starts, ends


def _collected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together to about ``WORDS_AT_ONCE`` rows."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= WORDS_AT_ONCE:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows = [], 0
    if rows:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, word, count in training texts) of the distinct words of each group of texts."""
    for batch in batches:
        training = batch.column("training").to_numpy(zero_copy_only=False)
        for a, b, data, offsets in groups(batch, "text", GROUP):
            starts, ends, text = words(data, offsets, NOT_BLANK)
            if not len(starts):
                continue
            hashes = word_hashes(data, starts, ends)
            distinct, one, same = np.unique(hashes, return_index=True, return_inverse=True)
            count = np.bincount(same.ravel(), weights=training[a:b][text].astype(np.float64)).astype(np.int64)
            sizes = (ends - starts)[one]
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            at = np.repeat(starts[one] - bounds[:-1], sizes) + np.arange(bounds[-1])
            packed = pa.Array.from_buffers(
                pa.binary(), len(one), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(LOWER[data[at]])]
            )
            yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), packed, pa.array(count)], ["hash", "word", "count"])


def _expected(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, log_p = sent.value
        pieces, sums = SimpleNamespace(**found), np.zeros(len(log_p))
        for batch in _collected(batches):
            sums += lattice(pieces, log_p, *_packed(batch.column("word")), batch.column("count").to_numpy().astype(float))[1]
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], ["piece", "expected"])

    return run


def _word_scores(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, log_p, discount, n, rest = sent.value
        pieces = SimpleNamespace(**found)
        for batch in _collected(batches):
            by_pieces = lattice(pieces, log_p, *_packed(batch.column("word")))[0]
            whole = np.maximum(batch.column("count").to_numpy() - discount, 0) / n
            with np.errstate(divide="ignore"):
                log_word = np.logaddexp(by_pieces + math.log(rest), np.log(whole))
            yield pa.RecordBatch.from_arrays(
                [batch.column("hash"), batch.column("count"), pa.array(by_pieces / math.log(10)), pa.array(log_word / math.log(10))],
                ["hash", "count", "log10_p", "log10_word"],
            )

    return run


def learn(texts: DataFrame, vocabulary: str = VOCABULARY, rounds: int = ROUNDS) -> dict:
    """The model of ``texts`` (training, text): the scored word table and its totals."""
    spark = texts.sparkSession
    counted = bounded_batches(texts).mapInArrow(_count_words, "hash long, word binary, count long")
    word_table = write_through(counted.groupBy("hash", "word").agg(F.sum("count").alias("count")), "lm-words")
    n_texts = texts.where("training").count()
    seen = F.col("count") > 0
    found_ = word_table.agg(
        F.sum("count").alias("n"), F.count_if(seen).alias("v"),
        F.count_if(F.col("count") == 1).alias("once"), F.count_if(F.col("count") == 2).alias("twice"),
    ).first()
    n, v = (found_["n"] or 0) + n_texts, found_["v"] + (n_texts > 0)
    discount = found_["once"] / (found_["once"] + 2 * found_["twice"]) if found_["once"] and found_["twice"] else 0.5
    pieces, log_p = read_vocabulary(vocabulary)
    by_hash = vars(Pieces(pieces))
    # The end of a text is one more piece.
    p_end = END_WITHOUT_TEXTS
    for _ in range(rounds if found_["v"] else 0):
        sent = spark.sparkContext.broadcast((by_hash, log_p))
        sums = word_table.where(seen).select("word", "count").mapInArrow(_expected(sent), "piece long, expected double")
        counts = np.full(len(pieces), PSEUDO_COUNT)
        for r in sums.groupBy("piece").agg(F.sum("expected").alias("expected")).collect():  # a row per piece at most
            counts[r["piece"]] += r["expected"]
        p_end = n_texts / (counts.sum() + n_texts)
        log_p = np.log(counts / counts.sum())
    log_p = log_p + math.log1p(-p_end)
    # What the discount takes from seen words and ends goes to the pieces.
    rest = discount * v / n if n else 1 - END_WITHOUT_TEXTS
    end = (n_texts - discount) / n if n_texts else END_WITHOUT_TEXTS
    sent = spark.sparkContext.broadcast((by_hash, log_p, discount, max(n, 1), rest))
    scored = write_through(word_table.mapInArrow(_word_scores(sent), "hash long, count long, log10_p double, log10_word double"), "lm-scores")
    return {
        "words": scored, "train_tokens": n, "distinct": v, "ends": n_texts, "pieces": pieces, "log_p": log_p,
        "log10_end": math.log10(p_end), "log10_word_end": math.log10(end),
    }


def _score_texts(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, base, model, by_words, known = sent.value
        for batch in batches:
            for a, b, data, offsets in groups(batch, "text", GROUP):
                starts, ends, text = words(data, offsets, NOT_BLANK)
                own = word_hashes(data, starts, ends).view(np.int64)
                at = np.minimum(np.searchsorted(hashes, own), max(0, len(hashes) - 1))
                frequent = hashes[at] == own if len(hashes) else np.zeros(len(own), bool)
                at, where = at[frequent], text[frequent]
                n = b - a
                sums = [np.bincount(where, weights=x[at], minlength=n).astype(np.float64) for x in (known, base, model, by_words)]
                rare, rare_text = own[~frequent], text[~frequent]
                bounds = np.searchsorted(rare_text, np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(a, n) for c in ("row", "id", "held_out")]
                    + [pa.array(np.bincount(text, minlength=n).astype(np.int64)), pa.array(sums[0].astype(np.int64)), *map(pa.array, sums[1:])]
                    + [pa.ListArray.from_arrays(bounds, pa.array(rare))],
                    ["row", "id", "held_out", "n_words", "n_known", "base", "model", "by_words", "rare"],
                )

    return run


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", head_words: int = HEAD_WORDS) -> DataFrame:
    """Per row of ``docs`` (which has ``held_out``): id, held_out, n_tokens, n_known, train_tokens, base_score, score, word_score."""
    spark = docs.sparkSession
    lexicon, n, v = model["words"], model["train_tokens"], model["distinct"]
    floor = math.log10(n + 0.5 * (v + 1))
    base = F.log10(F.col("count") + 0.5) - floor
    size = lexicon.count()
    cut = -1
    if size > head_words:
        share = 1 - head_words / size
        cut = lexicon.agg(F.percentile_approx("count", share, 1_000_000).alias("cut")).first()["cut"]
        while lexicon.where(F.col("count") > cut).count() > head_words:
            cut = 2 * cut + 1
    head = lexicon.where(F.col("count") > cut).select("hash", base.alias("base"), "log10_p", "log10_word", (F.col("count") > 0).cast("double").alias("known"))
    head = head.toArrow().sort_by("hash")  # HEAD_WORDS rows of 40 bytes at most
    kinds = {"hash": np.int64, "base": np.float64, "log10_p": np.float64, "log10_word": np.float64, "known": np.float64}
    sent = spark.sparkContext.broadcast(tuple(head[c].to_numpy().astype(k) for c, k in kinds.items()))
    texts = bounded_batches(docs).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), "held_out", F.col(text_col).alias("text")
    )
    schema = (
        f"row long, id {texts.schema['id'].dataType.simpleString()}, held_out boolean, n_words long, n_known long,"
        " base double, model double, by_words double, rare array<long>"
    )
    texts = write_through(texts.mapInArrow(_score_texts(sent), schema), "lm-texts")
    rare = texts.select("row", F.explode("rare").alias("hash")).join(lexicon.where(F.col("count") <= cut), "hash")
    rare = rare.groupBy("row").agg(
        F.count_if(F.col("count") > 0).alias("more_known"), F.sum(base).alias("more_base"), F.sum("log10_p").alias("more_model"), F.sum("log10_word").alias("more_words"),
    )
    zero = F.lit(0.0)
    end_base = math.log10(model["ends"] + 0.5) - floor
    return texts.drop("rare").join(rare, "row", "left").select(
        F.col("id").alias(id_col),
        "held_out",
        (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("n_known") + F.coalesce("more_known", F.lit(0)) + int(model["ends"] > 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero) + end_base).alias("base_score"),
        (F.col("model") + F.coalesce("more_model", zero) + model["log10_end"]).alias("score"),
        (F.col("by_words") + F.coalesce("more_words", zero) + model["log10_word_end"]).alias("word_score"),
    )


def op6_lattice(spark, sf_dir):
    """Every document's score; a fifth of the ids is held out from learning."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", in_fold("doc_id", 1))
    model = learn(docs.select((~F.col("held_out")).alias("training"), "text"))
    return score(docs, model)
