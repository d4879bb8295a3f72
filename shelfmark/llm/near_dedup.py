"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, components.

1. A task hashes the distinct five-word shingles of its texts and draws SuperMinHash signatures: every
   shingle walks a pseudo-random permutation of the slots, round by round; a text stops as soon as all its
   slots are taken, since later rounds only bring larger values.  180 slots make 30 bands of 6 for a limit
   of 85 percent and 36 bands of 5 for 80: two texts at the limit share no band with a probability under 1e-6.
2. Equal shingle sets become one vertex, a 64-bit number; buckets are the bands of vertices.  Buckets with
   the same members are kept once.
3. Shingle sets of the vertices that share a bucket are computed from whole texts again and verified
   exactly, pair by pair of those that share a band: the intersections of a cluster of touching buckets come
   from products of 0/1 blocks.  Only the links of a spanning forest leave a task, never all pairs.
4. A cluster of more than ``BLOCK`` vertices or ``CELL`` shingles goes bucket by bucket: the members are compared
   with one of them, what is linked becomes one component, and only buckets that still hold several components
   go on, with another member as centre.  After ``ROUNDS`` such rounds the buckets left are compared in
   pairs of blocks, so no task holds more than two blocks, and a large group of real copies costs a linear
   number of comparisons.
5. Components on vertex numbers; each takes the smallest id of its rows.

Defined cases: a null, empty or blank text has no shingles, is linked with nothing and stays; fewer than
five words are one shingle; a row with a null id is linked with nothing, has a null component and stays;
rows with equal texts are linked; rows of one id with different texts are judged row by row; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfmark.llm.common import BROADCAST_BYTES, bounded_batches, fresh, table
from shelfmark.llm.components import components
from shelfmark.llm.textbytes import (
    NOT_BLANK, STEP, U, distinct_by_text, groups, mixed, shingles, word_hashes, words,
)
from shelfmark.session import broadcast_if_small, write_through

WIDTH, PERCENT, STAGE_PERCENT = 5, 85, 80
SLOTS, ROWS, STAGE_ROWS = 180, 6, 5
#: Vertices and shingles of a task's block.
BLOCK, CELL = 512, 1 << 20
ROUNDS = 3
EMPTY = U(2**64 - 1)


def shingle_sets(data, offsets, width: int = WIDTH):
    """Sorted distinct shingles of a group of texts, their text numbers and the bounds of the texts."""
    starts, ends, text = words(data, offsets, NOT_BLANK)
    n = len(offsets) - 1
    values, text = shingles(word_hashes(data, starts, ends), text, n, width)
    return distinct_by_text(values, text, n)


def signatures(values: np.ndarray, text: np.ndarray, n_texts: int, slots: int) -> np.ndarray:
    """SuperMinHash: one row of ``slots`` values per text; a value holds the round, then the random part."""
    found = np.full(n_texts * slots, EMPTY, U)
    walk = None
    for j in range(slots):
        if not len(values):
            break
        random = mixed(values + np.array([j + 1], U) * STEP)
        target = ((random >> U(32)) * U(slots - j) >> U(32)).astype(np.int64) + j
        value = (random & U((1 << 56) - 1)) | (U(j) << U(56))
        if j == 0:
            place, first = target, target
        else:
            own = np.arange(len(values))
            if walk is None:
                walk = np.tile(np.arange(slots, dtype=np.uint8), (len(values), 1))
                walk[own, 0] = first
                walk[own, first] = 0
            place = walk[own, target].astype(np.int64)
            walk[own, target] = walk[:, j]
            walk[:, j] = place
        np.minimum.at(found, text * slots + place, value)
        unfinished = (found.reshape(n_texts, slots) == EMPTY).any(axis=1)[text]
        if not unfinished.all():
            values, text = values[unfinished], text[unfinished]
            first = first[unfinished]
            walk = walk[unfinished] if walk is not None else None
    return found.reshape(n_texts, slots)


def _signed(values: np.ndarray):
    return pa.array(values.astype(U).view(np.int64))


def _sign(rows: int):
    """(id, n, set1, set2, bands) of each text; a band is ``rows`` slots."""
    n_bands = SLOTS // rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in groups(batch, "text"):
                values, text, bounds = shingle_sets(data, offsets)
                set1, set2 = _keys(values, bounds)
                slots = signatures(values, text, b - a, SLOTS).reshape(b - a, n_bands, rows)
                keys = np.zeros((b - a, n_bands), U)
                for r in range(rows):
                    keys = mixed(keys * STEP + slots[:, :, r])
                keys = mixed(keys + np.arange(n_bands, dtype=U))
                bands = pa.ListArray.from_arrays(np.arange(b - a + 1, dtype=np.int32) * n_bands, _signed(keys.ravel()))
                n = pa.array(np.diff(bounds).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a), n, _signed(set1), _signed(set2), bands], ["id", "n", "set1", "set2", "bands"]
                )

    return run


def _keys(values: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Two hashes of each text's set of shingles."""
    out = []
    for k in range(2):
        total = np.zeros(len(values) + 1, U)
        np.cumsum(mixed(values + np.array([k + 101], U) * STEP), out=total[1:])
        out.append(total[bounds[1:]] - total[bounds[:-1]])
    return out


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(set1, set2, shingles as bytes) of each text."""
    for batch in batches:
        for a, b, data, offsets in groups(batch, "text"):
            values, _, bounds = shingle_sets(data, offsets)
            packed = pa.Array.from_buffers(
                pa.binary(), b - a, [None, pa.py_buffer((bounds * 8).astype(np.int32)), pa.py_buffer(values)]
            )
            yield pa.RecordBatch.from_arrays([*map(_signed, _keys(values, bounds)), packed], ["set1", "set2", "shingles"])


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections; columns only one set has are left out, the others go in blocks."""
    n = len(sets)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    shared = count[column] > 1
    number = np.cumsum(count > 1) - 1
    column, row = number[column[shared]], row[shared]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    total = np.zeros((n, n), np.float64)
    width = 4096
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (low, low + width))
        part = np.zeros((n, min(width, int(column[-1]) + 1 - low)), np.float32)
        part[row[a:b], column[a:b] - low] = 1
        total += part @ part.T
    return total


def share_band(bands: np.ndarray) -> np.ndarray:
    """Which pairs of rows of ``bands`` have an equal value in one column."""
    together = np.zeros((len(bands), len(bands)), bool)
    for column in bands.T:
        together |= column[:, None] == column[None, :]
    return together


def forest(vertices: list, sets: list[np.ndarray], bands: np.ndarray, percent: int = PERCENT) -> list[tuple]:
    """Links (a, b) that connect what the exact links among ``sets`` that share a band connect."""
    if len(sets) < 2:
        return []
    sizes = np.array([len(s) for s in sets], np.float64)
    common = intersections(sets)
    linked = (100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)) & share_band(bands)
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for a, b in np.argwhere(np.triu(linked, 1)).tolist():
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((vertices[a], vertices[b]))
    return kept


def _verify(percent: int):
    """Links of the groups in rows sorted by (key, part): each run of equal ones is one group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, vertices, sets, bands = None, [], [], []

        def links():
            found = forest(vertices, sets, np.stack(bands), percent) if bands else []
            a, b = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            keys = zip(batch.column("key").to_pylist(), batch.column("part").to_pylist())
            columns = batch.column("vertex").to_pylist(), batch.column("shingles"), batch.column("bands")
            for here, vertex, packed, own in zip(keys, *columns):
                if here != key:
                    yield links()
                    key, vertices, sets, bands = here, [], [], []
                vertices.append(vertex)
                sets.append(np.frombuffer(packed.as_py(), U))
                bands.append(own.values.to_numpy())
        yield links()

    return run


def _compare(percent: int):
    """The pairs (a, b) whose sets are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for one, two in zip(batch.column("shingles"), batch.column("other_shingles")):
                x, y = np.frombuffer(one.as_py(), U), np.frombuffer(two.as_py(), U)
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


def _in_groups(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of each (key, part) group of ``rows`` (key, part, vertex)."""
    rows = broadcast_if_small(write_through(rows.select("key", "part", "vertex"), "near-groups"), BROADCAST_BYTES)
    together = sets.join(rows, "vertex").select("key", "part", "vertex", "shingles", "bands")
    together = together.repartition("key", "part").sortWithinPartitions("key", "part")
    return bounded_batches(together).mapInArrow(_verify(percent), "a long, b long")


def _labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` (vertex, n, keys) with their ``component`` and those of their buckets that aren't known to be connected.

    A vertex goes by the smallest one it is linked to: equal names are connected, different ones may be.  It is
    named once, not once per bucket.
    """
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    named = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("vertex"), F.least("a", "least").alias("component"))
    named = broadcast_if_small(write_through(named, "near-named"), BROADCAST_BYTES)
    labelled = members.select("vertex", "n", "keys").join(named, "vertex", "left").withColumn("component", F.coalesce("component", "vertex"))
    placed = _by_key(write_through(labelled, "near-labelled"))
    open_ = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    return write_through(_by_vertex(placed.join(open_, "key", "left_semi"), "component"), "near-open")


def _by_key(members: DataFrame) -> DataFrame:
    return members.withColumn("key", F.explode("keys")).drop("keys")


def _by_vertex(members: DataFrame, *keep: str) -> DataFrame:
    """One row per vertex; a vertex has as many keys as there are bands at most."""
    return members.groupBy("vertex").agg(*[F.first(c).alias(c) for c in ("n", *keep)], F.collect_list("key").alias("keys"))


def _large_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of the buckets of large clusters; ``members`` is (key, vertex, n)."""
    links = None
    open_ = write_through(_by_vertex(members).withColumn("component", F.col("vertex")), "near-open")
    # Every round reads the sets of these vertices only.
    own = broadcast_if_small(open_.select("vertex"), BROADCAST_BYTES)
    sets = write_through(sets.join(own, "vertex", "left_semi"), "near-large-sets")
    for round_ in range(ROUNDS):
        order = F.col("vertex") if not round_ else F.xxhash64("vertex", F.lit(round_))
        placed = _by_key(open_)
        centres = placed.groupBy("key").agg(F.min_by(F.struct("vertex", "component"), order).alias("centre"))
        # Each pair once, however many buckets it shares.
        pairs = placed.join(centres, "key").where("component != centre.component").select(
            F.least("vertex", "centre.vertex").alias("a"), F.greatest("vertex", "centre.vertex").alias("b")
        )
        pairs = broadcast_if_small(write_through(pairs.distinct(), "near-pairs"), BROADCAST_BYTES)
        both = sets.select(F.col("vertex").alias("a"), "shingles").join(pairs, "a").join(
            sets.select(F.col("vertex").alias("b"), F.col("shingles").alias("other_shingles")), "b"
        )
        found = bounded_batches(both.select("a", "b", "shingles", "other_shingles")).mapInArrow(_compare(percent), "a long, b long")
        links = write_through(found if links is None else links.unionByName(found), "near-links")
        open_ = _labelled(open_, links)
        if open_.isEmpty():
            return links
    # What is left: pairs of blocks of a bucket, cut by members and by shingles.
    cut = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / CELL)).cast("int").alias("blocks")
    open_ = _by_key(open_)
    placed = open_.join(open_.groupBy("key").agg(cut), "key").withColumn("block", F.expr("cast(pmod(xxhash64(vertex), blocks) as int)"))
    tasks = placed.select("key", "vertex", "block", F.explode(F.expr("sequence(0, blocks - 1)")).alias("mate")).select(
        "key", "vertex", F.concat_ws("-", F.least("block", "mate"), F.greatest("block", "mate")).alias("part")
    )
    rest = _in_groups(tasks, sets, percent)
    return rest if links is None else links.unionByName(rest)


def _links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that connect what the exact links inside buckets connect; ``members`` is (key, vertex, n).

    Vertices whose buckets touch form a cluster.  A cluster that fits a block is verified as a whole, so that each
    set travels once; a larger one bucket by bucket.  Either way only pairs that share a band can be linked.
    """
    first = members.groupBy("key").agg(F.min("vertex").alias("first"))
    touching = members.join(first, "key").select(F.col("vertex").alias("a"), F.col("first").alias("b"))
    cluster = write_through(components(touching).toDF("vertex", "cluster"), "near-clusters")
    n = members.select("vertex", "n").distinct()
    size = cluster.join(n, "vertex").groupBy("cluster").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))
    fits = (F.col("size") <= BLOCK) & (F.col("shingles") <= CELL)
    sized = write_through(cluster.join(size.withColumn("fits", fits).select("cluster", "fits"), "cluster"), "near-sized")
    links = _in_groups(sized.where("fits").select(F.col("cluster").alias("key"), F.lit("").alias("part"), "vertex"), sets, percent)
    large = write_through(members.join(sized.where("not fits").select("vertex"), "vertex", "left_semi"), "near-large")
    return links if large.isEmpty() else links.unionByName(_large_links(large, sets, percent))


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, rows: int = ROWS
) -> DataFrame:
    """Per row of ``docs``: id, ``n_shingles``, ``component_id``, ``kept``; links are at ``percent`` or more.

    Bands of ``rows`` slots choose what is compared: fewer rows for a lower ``percent``.
    """
    texts = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = texts.schema["id"].dataType.simpleString()
    signed = write_through(
        texts.mapInArrow(_sign(rows), f"id {id_type}, n long, set1 long, set2 long, bands array<long>"), "near-signed"
    )
    known = signed.where("n > 0 and id is not null")
    distinct = known.groupBy("set1", "set2").agg(
        F.min("id").alias("id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands")
    )
    vertices = write_through(distinct.withColumn("vertex", F.monotonically_increasing_id()), "near-vertices")
    entries = vertices.select("vertex", F.explode("bands").alias("key"))
    buckets = entries.groupBy("key").agg(
        F.count("*").alias("members"),
        F.bit_xor(F.xxhash64("vertex")).alias("x1"),
        F.bit_xor(F.xxhash64(F.lit("second"), "vertex")).alias("x2"),
    )
    buckets = buckets.where("members > 1").groupBy("members", "x1", "x2").agg(F.min("key").alias("key"))
    buckets = write_through(buckets.select("key"), "near-buckets")
    members = write_through(
        vertices.select("vertex", "n", F.explode("bands").alias("key")).join(broadcast_if_small(buckets, BROADCAST_BYTES), "key").select("key", "vertex", "n"),
        "near-members",
    )
    shared = members.select("vertex").distinct()
    needed = write_through(vertices.join(shared, "vertex", "left_semi").select("id", "set1", "set2", "vertex", "bands"), "near-needed")
    # The texts of the vertices' rows; another row of the same id may have another set.
    own = texts.join(broadcast_if_small(write_through(needed.select("id").distinct(), "near-ids"), BROADCAST_BYTES), "id", "left_semi")
    sets = own.mapInArrow(_sets, "set1 long, set2 long, shingles binary").join(
        broadcast_if_small(needed.drop("id"), BROADCAST_BYTES), ["set1", "set2"]
    )
    sets = write_through(sets.select("vertex", "shingles", "bands"), "near-sets")
    if not sets.groupBy("vertex").count().where("count > 1").isEmpty():
        sets = write_through(sets.dropDuplicates(["vertex"]), "near-sets")
    named = components(_links(members, sets, percent)).withColumnRenamed("id", "vertex")
    named = write_through(named.join(vertices.select("vertex", "id"), "vertex"), "near-named")
    least = named.groupBy("component").agg(F.min("id").alias("least"))
    named = named.join(least, "component").select("vertex", F.col("least").alias("component"))
    groups_ = vertices.select("vertex", "set1", "set2", "copies", F.col("id").alias("own")).join(named, "vertex", "left")
    # Only sets that several rows share or that a link touches can differ from their row's own id.
    groups_ = groups_.where("copies > 1 or component is not null").select(
        "set1", "set2", F.coalesce("component", "own").alias("component")
    )
    groups_ = broadcast_if_small(write_through(groups_, "near-groups"), BROADCAST_BYTES)
    return signed.select("id", "n", "set1", "set2").join(groups_, ["set1", "set2"], "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.coalesce("component", "id")).otherwise(F.col("id")).alias("component_id"),
    ).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def op7_near_dedup(spark, sf_dir):
    """Every document with its group and whether it stays."""
    return near_groups(table(spark, sf_dir, "documents"))


def stage(spark, docs, sf_dir):
    """Pipeline stage: one row of each group, linked at ``STAGE_PERCENT``, stays; rows with a null id stay.

    A row is its id and the hash of its text, so rows of one id with different texts are documents of their
    own; of rows equal in both one stays.
    """
    one, two = (fresh(docs, n) for n in ("near_id", "near_text"))
    keys = F.col("doc_id").alias(one), F.xxhash64("text").alias(two)
    rows = docs.where("doc_id is not null").select(F.struct(*keys).alias("row"), "text")
    found = near_groups(rows, "row", percent=STAGE_PERCENT, rows=STAGE_ROWS).select("row.*", "kept")
    found = found.groupBy(one, two).agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    found = write_through(found.where("not kept or n > 1"), "near-result")
    gone = broadcast_if_small(found.where("not kept").select(one, two), BROADCAST_BYTES)
    repeated = broadcast_if_small(found.where("kept").select(one, two), BROADCAST_BYTES)
    kept = docs.withColumns({one: F.col("doc_id"), two: F.xxhash64("text")}).join(gone, [one, two], "left_anti")
    return kept.join(repeated, [one, two], "left_anti").unionByName(
        kept.join(repeated, [one, two], "left_semi").dropDuplicates([one, two])
    ).select(*docs.columns)


ORACLE = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[ \\t-\\r]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {WIDTH} THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - {WIDTH} + 2), lambda i: array_to_string(words[i:i + {WIDTH - 1}], ' ')) END) AS shingle
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * common >= {PERCENT} * (x.n + y.n - common)),
reach AS (
  SELECT doc_id AS id, doc_id AS other FROM documents
  UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.other) AS component_id, d.doc_id = min(r.other) AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach r ON r.id = d.doc_id GROUP BY d.doc_id
"""
