"""Document fingerprints that follow edit distance: Order MinHash.

Every k-mer of code points is numbered by its occurrence in the text, hashed with that number, and falls
into one of ``BINS`` bins by the top bits of its hash, so one hash serves all tuples.  In each bin the
``PICK`` smallest are taken, put back into text order, and the hash of that tuple is the bin's value: equal
sets of k-mers in another order give other tuples.  Likeness is the share of equal tuples among bins that
either text fills, brought back to the scale of single k-mers by the root of degree ``PICK``.

``edited_fingerprints`` needs each document's successor in descending id order.  Ids (numbers) are cut into
ranges of about ``RANGE_BYTES``, an id that many rows share, or none, by the hash of the text as well; a range is one
partition and one sorted run, and the first document of a range is also sent to the range that ends just
before it.  Texts are shuffled once.

Defined cases: a null text is empty; an empty text has no k-mer, and two texts without any have likeness
1; a text shorter than k is one k-mer; null ids come last in the order; rows of equal id are ordered by the
hash of their text; a single document is its own successor; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.llm.common import bounded_batches, table
from shelfmark.llm.textbytes import STEP, U, mixed, powers

K, BINS, PICK = 8, 64, 2
#: Bytes of text in a range, as long as there are no more ranges than this.
RANGE_BYTES, MOST_RANGES = 16 << 20, 20_000
CROWD = 12  # candidates a bin needs on average before smaller hashes alone are looked at


def kmer_hashes(points: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the k-mers of a text's code points; a shorter text is one k-mer, an empty one has none."""
    n = len(points)
    if not n:
        return np.zeros(0, U)
    k = min(k, n)
    up, down = powers(n)
    sums = np.zeros(n + 1, U)
    np.cumsum(mixed(points.astype(U) + U(1)) * up[:n], out=sums[1:])
    return mixed((sums[k:] - sums[:-k]) * down[: n - k + 1] + np.full(1, k, U))


def fingerprint(points: np.ndarray, k: int = K, bins: int = BINS, pick: int = PICK) -> np.ndarray:
    """One 32-bit value per bin, 0 for an empty bin; ``bins`` is a power of 2."""
    result = np.zeros(bins, np.uint32)
    kmers = kmer_hashes(points, k)
    n = len(kmers)
    if not n:
        return result
    low = U(max(1, (n - 1).bit_length()))
    place_mask = (U(1) << low) - U(1)
    # Sorted by k-mer, then place: the number within a run is the occurrence.  The packed word, whose cleared
    # bits follow the text's length, gives the order only.
    packed = (kmers & ~place_mask) | np.arange(n, dtype=U)
    packed.sort()
    place = packed & place_mask
    kmer = kmers[place]
    at = np.arange(n)
    fresh = np.ones(n, bool)
    fresh[1:] = kmer[1:] != kmer[:-1]
    if (fresh[1:] & ((packed[1:] ^ packed[:-1]) <= place_mask)).any():  # k-mers that differ in cleared bits only
        place = np.argsort(kmers, kind="stable").astype(U)
        kmer = kmers[place]
        fresh[1:] = kmer[1:] != kmer[:-1]
    number = at - np.maximum.accumulate(np.where(fresh, at, 0))
    value = mixed(kmer + (number + 1).astype(U) * STEP)
    shift = U(bins.bit_length() - 1)
    chosen = None
    if n > 2 * CROWD * bins:
        few = (value << shift) < U(int(2**64 * CROWD * bins / n))
        chosen = _smallest(value[few], place[few], place_mask, shift, bins, pick)
    if chosen is None or (chosen[1] < pick).any():
        chosen = _smallest(value, place, place_mask, shift, bins, pick)
    places, counts = chosen
    order = np.sort(places, axis=1)  # text order; absent ones, at the largest place, come last
    tuples = np.zeros(bins, U)
    for j in range(pick):
        have = j < counts
        tuples = np.where(have, mixed(tuples * STEP + kmers[np.where(have, order[:, j], 0)]), tuples)
    values = (tuples >> U(32)).astype(np.uint32)
    return np.where(counts > 0, np.maximum(values, 1), 0).astype(np.uint32)


def _smallest(value, place, place_mask, shift, bins, pick):
    """Places of the ``pick`` smallest values of each bin, and how many there are."""
    packed = (value & ~place_mask) | place
    packed.sort()
    bounds = np.searchsorted(packed, np.arange(bins, dtype=U) << (U(64) - shift))
    counts = np.minimum(np.diff(np.append(bounds, len(packed))), pick)
    places = np.full((bins, pick), np.iinfo(np.int64).max)
    for j in range(pick):
        have = np.flatnonzero(j < counts)
        places[have, j] = (packed[bounds[have] + j] & place_mask).astype(np.int64)
    return places, counts


def likeness(a: np.ndarray, b: np.ndarray, pick: int = PICK) -> float:
    filled = np.count_nonzero((a != 0) | (b != 0))
    return (np.count_nonzero((a == b) & (a != 0)) / filled) ** (1 / pick) if filled else 1.0


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _row(id_, text, points, own, following):
    """One result row; ``following`` is the next document's (text, code points, fingerprint)."""
    n = len(points)
    cut = n // 3
    edited = np.concatenate([points[: n - cut], following[1][:cut]])
    changed = fingerprint(edited)
    digest = hashlib.sha256((text[: n - cut] + following[0][:cut]).encode()).hexdigest()
    name = lambda x: x.astype(">u4").tobytes().hex()
    return id_, n, digest, name(own), name(changed), likeness(own, changed), likeness(own, following[2])


def _pair_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, borrowed, order): each own row with the row after it."""
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    held = bucket = kind = None
    out = []

    def flush():
        columns = [pa.array(c, t) for c, t in zip(zip(*out), [kind, pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()])]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names)

    for batch in batches:
        kind = batch.column("id").type
        columns = [batch.column(c) for c in ("id", "text", "bucket", "borrowed")]
        for i in range(batch.num_rows):
            id_, text, here, borrowed = (c[i].as_py() for c in columns)
            if here != bucket:
                bucket, held = here, None
            if borrowed and held is None:
                continue  # further copies of the successor
            points = code_points(text)
            now = (text, points, fingerprint(points))
            if held is not None:
                out.append(_row(held[0], held[1][0], held[1][1], held[1][2], now))
            held = None if borrowed else (id_, now)
            if len(out) >= 1000:
                yield flush()
    if out:
        yield flush()


def _ranges(texts: DataFrame) -> tuple[Column, int]:
    """The range of a row (id, text, hash) in the order of descending ids, and how many there are.

    Ids are cut at approximate quantiles, as many as the texts' bytes ask for.  An id that holds several quantiles,
    or none, is cut further by even stretches of the hash, which orders its rows.
    """
    spark = texts.sparkSession
    sizes = texts.agg(
        F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n"), F.count_if(F.col("id").isNull()).alias("none")
    ).first()
    parts = min(max(-(-(sizes["bytes"] or 0) // RANGE_BYTES), 4 * spark.sparkContext.defaultParallelism), MOST_RANGES)
    share = [i / parts for i in range(1, parts)]
    found = texts.agg(F.percentile_approx("id", share or [0.5], 100_000).alias("cuts")).first()["cuts"] or []
    cuts = sorted(set(found))
    # Ids in (cut before, cut] are one bucket, whose greatest id may be cut by hash; null ids are the last bucket.
    slices = [found.count(c) if found.count(c) > 1 else 0 for c in cuts]
    above = [(0, 1)]  # ids over all cuts; (slices of the greatest id, ranges)
    for k in reversed(slices):
        above.append((k, k + 1))
    none = max(1, -(-sizes["none"] * parts // max(sizes["n"], 1)))
    above.append((none, none))
    starts = [0]
    for _, n in above:
        starts.append(starts[-1] + n)
    below = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("id"))) if cuts else F.lit(0)
    bucket = F.when(F.col("id").isNull(), len(cuts) + 1).otherwise(F.lit(len(cuts)) - below)
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), bucket + 1)
    # The hash as a number from 0 to 2 ** 24, in its own order.
    even = F.shiftrightunsigned(F.col("hash").bitwiseXOR(F.lit(-(1 << 63)).cast("long")), 40)
    k = pick([k for k, _ in above])
    kind = texts.schema["id"].dataType
    greatest = F.element_at(F.array(*[F.lit(c).cast(kind) for c in (None, *reversed(cuts), None)]), bucket + 1)
    cut_here = F.col("id").isNull() | (F.col("id") == greatest)
    slice_ = F.when(k == 0, 0).when(cut_here, F.expr("0") + (even * k / F.lit(1 << 24)).cast("int")).otherwise(k)
    return (pick(starts[:-1]) + slice_).cast("int"), starts[-1]


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, with both likenesses."""
    texts = bounded_batches(docs).select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash")
    )
    place, ranges = _ranges(texts)
    placed = texts.withColumn("bucket", place)
    # The first document of each range that has any, in the order of ids; one row a range.
    first = F.max(F.struct("id", F.bitwise_not("hash").alias("turned"))).alias("first")
    firsts = sorted(placed.select("bucket", "id", "hash").groupBy("bucket").agg(first).collect(), key=lambda r: r["bucket"])
    # It follows the last one of the range before; the very first follows the very last.
    known = {r["bucket"]: (r["first"]["id"], ~r["first"]["turned"], firsts[i - 1]["bucket"]) for i, r in enumerate(firsts)}
    id_type = texts.schema["id"].dataType
    column = lambda k, kind: F.array(*[F.lit(known[b][k] if b in known else None).cast(kind) for b in range(ranges)])
    at = lambda values: F.element_at(values, F.col("bucket") + 1)
    is_first = F.col("id").eqNullSafe(at(column(0, id_type))) & (F.col("hash") == at(column(1, "long")))
    both = F.array(
        F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("borrowed")),
        F.when(is_first, F.struct(at(column(2, "int")).alias("bucket"), F.lit(True).alias("borrowed"))),
    )
    dealt = (
        placed.select("id", "text", "hash", F.explode(F.filter(both, lambda x: x.isNotNull())).alias("to"))
        .select("id", "text", "hash", "to.bucket", "to.borrowed")
        .repartitionById(ranges, "bucket")
        .sortWithinPartitions("bucket", "borrowed", F.col("id").desc_nulls_last(), "hash")
        .drop("hash")
    )
    schema = (
        f"id {texts.schema['id'].dataType.simpleString()}, n_chars long, edited_sha256 string, fingerprint string,"
        " edited_fingerprint string, near_edited double, near_next double"
    )
    return dealt.mapInArrow(_pair_up, schema).withColumnRenamed("id", id_col)


def op5_fingerprint(spark, sf_dir):
    """Every document's fingerprints and likenesses."""
    return edited_fingerprints(table(spark, sf_dir, "documents"))
