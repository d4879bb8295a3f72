"""Trie of conversation prefixes: ROLLUP over positional turn-id columns, in blocks chained by the prior block's node.

1. Turns are numbered inside their conversation without gathering one: rows are cut into ranges by
   (conversation, turn), sorted, numbered by range, and the counts of earlier ranges are added.
2. A block is ``BLOCK`` consecutive turns of a conversation in as many columns of turn ids (120 bits of the md5
   of role and text).  It is keyed by the node its conversation has reached before it: the xor of hashes of
   (place, turn id) so far, 128 bits.
3. One ``GROUP BY key, block, ROLLUP(t1, ..., tB)`` over all blocks gives every node of every depth, with its
   members; ``grouping_id`` tells the depth.  Groups of blocks that end before that depth drop out.
4. Subtree figures come from a second ROLLUP: each node's value lies with its smallest member, each member
   carries the sum from every turn to its end, and a group adds up its members' sums.  Members that own no
   node are left out, so copies cost nothing here.
5. The digest of the members that end at a node is taken over pieces: ids are range-sorted, joined piece by
   piece, and only the pieces of a node meet, in order and as a stream.

Aggregations are combined before their shuffle; parents of many children are joined by broadcast of a measured
table, running sums over long conversations go in two levels.  A conversation, a prefix or an end may thus
hold any share of the rows.

Defined cases: a null role or text is empty; a null turn number comes first; turns of one number are ordered
by the md5 of their role and text, repeated rows are turns of their own; rows with a null conversation
id belong to none and are left out; an empty table has no node; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from shelfmark.llm.common import BROADCAST_BYTES, table
from shelfmark.llm.periodic import sql_crc32
from shelfmark.session import broadcast_if_small, write_through

BLOCK = 8
#: Blocks of a conversation that one window of a running sum covers.
CHUNK = 1024
#: Turns of a conversation that meet one copy of what is joined to them.
PART = 1 << 16
#: From so many children on a parent is joined by broadcast.
MANY = 10_000


def number_turns(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Turns as (conv, pos, id1, id2, bytes), ``pos`` from 1, and conversations as (conv, n)."""
    role_, text_ = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    digest = F.md5(F.concat(F.length(role_), F.lit(":"), role_, text_).cast("binary"))
    rows = (
        turns.where(F.col(conv).isNotNull())
        .select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), digest.alias("digest"), F.octet_length(text_).cast("long").alias("bytes"))
        .select("conv", "turn", *[F.conv(F.substring("digest", a, 15), 16, 10).cast("long").alias(n) for n, a in (("id1", 1), ("id2", 16))], "bytes")
    )
    order = ["conv", F.col("turn").asc_nulls_first(), "id1", "id2"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = write_through(
        ranged.select("conv", "id1", "id2", "bytes", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")),
        "trie-sorted",
    )
    parts = ranged.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = write_through(parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "trie-parts")
    numbered = ranged.join(parts.select("conv", "part", "first", "before"), ["conv", "part"]).select(
        "conv", (F.col("at") - F.col("first") + F.col("before") + 1).alias("pos"), "id1", "id2", "bytes"
    )
    return write_through(numbered, "trie-turns"), parts.groupBy("conv").agg(F.sum("n").alias("n"))


def _carried(blocks: DataFrame, values: dict[str, str], backward: bool) -> DataFrame:
    """``blocks`` with each value combined over the conversation's earlier (later) blocks, as ``name_far``.

    ``values`` maps columns to ``bit_xor`` or ``sum``.  A window covers ``CHUNK`` blocks; what lies beyond is
    one row a chunk.
    """
    combine = {n: (F.bit_xor if f == "bit_xor" else F.sum) for n, f in values.items()}
    order = F.col("block").desc() if backward else F.col("block")
    near = Window.partitionBy("conv", "chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    chunk_order = F.col("chunk").desc() if backward else F.col("chunk")
    far = Window.partitionBy("conv").orderBy(chunk_order).rowsBetween(Window.unboundedPreceding, -1)
    chunked = blocks.withColumn("chunk", F.expr(f"block div {CHUNK}"))
    several = chunked.where("chunk > 0").select("conv").distinct()
    chunks = chunked.join(several, "conv", "left_semi").groupBy("conv", "chunk").agg(*[combine[n](n).alias(n) for n in values])
    chunks = write_through(
        chunks.select("conv", "chunk", *[F.coalesce(combine[n](n).over(far), F.lit(0)).alias(f"{n}_chunk") for n in values]), "trie-chunks"
    )
    joined = chunked.join(broadcast_if_small(chunks, BROADCAST_BYTES), ["conv", "chunk"], "left")
    for n, f in values.items():
        here, there = F.coalesce(combine[n](n).over(near), F.lit(0)), F.coalesce(F.col(f"{n}_chunk"), F.lit(0))
        joined = joined.withColumn(f"{n}_far", here.bitwiseXOR(there) if f == "bit_xor" else here + there)
    return joined.drop("chunk", *[f"{n}_chunk" for n in values])


def _blocks(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per conversation and block: key of the node before it, turn ids and bytes by position, ``filled``."""
    all_ = turns.select("conv", "pos", "id1", "id2", "bytes").unionByName(
        convs.select("conv", *[F.lit(None).cast("long").alias(c) for c in ("pos", "id1", "id2", "bytes")])
    )
    placed = all_.select(
        "*",
        F.expr(f"coalesce((pos - 1) div {BLOCK}, 0)").alias("block"),
        F.expr(f"(pos - 1) % {BLOCK}").alias("slot"),
        *[F.expr(f"if(pos is null, 0L, {_hash(s, 'pos', 'id1', 'id2')})").alias(f"x{s}") for s in (1, 2)],
    )
    columns = [
        F.max(F.when(F.col("slot") == j, F.col(c))).alias(f"{n}{j + 1}")
        for j in range(BLOCK) for c, n in (("id1", "a"), ("id2", "b"), ("bytes", "bytes"))
    ]
    wide = placed.groupBy("conv", "block").agg(
        *columns, F.count("pos").alias("filled"), F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2")
    )
    keyed = _carried(write_through(wide, "trie-wide"), {"x1": "bit_xor", "x2": "bit_xor"}, backward=False)
    return write_through(keyed.withColumnsRenamed({"x1_far": "key1", "x2_far": "key2"}), "trie-blocks")


def _hash(seed: int, place: str, one: str, two: str) -> str:
    return f"xxhash64({seed}L, {place}, {one}, {two})"


def _rolled(blocks: DataFrame, figures: str) -> DataFrame:
    """Nodes (depth, node1, node2, parent1, parent2) with the aggregates ``figures`` of the blocks through them."""
    slots = range(1, BLOCK + 1)
    rollup = ", ".join(f"(a{j}, b{j})" for j in slots)
    rolled = blocks.sparkSession.sql(
        f"SELECT key1, key2, block, {', '.join(f'a{j}, b{j}' for j in slots)}, "
        f"{BLOCK} - bit_count(grouping_id()) div 2 AS level, {figures} FROM {{blocks}} GROUP BY key1, key2, block, ROLLUP({rollup})",
        blocks=blocks,
    )
    # A block that ends before a level has nulls there; the empty prefix of a later block is its prior block's node.
    reached = " + ".join(f"cast(a{j} is not null as int)" for j in slots)
    rolled = rolled.where(f"{reached} = level and (level > 0 or block = 0)")
    place = lambda j: f"block * {BLOCK} + {j}"
    last = lambda s: "case level " + " ".join(f"when {j} then {_hash(s, place(j), f'a{j}', f'b{j}')}" for j in slots) + " else 0L end"
    nodes = rolled.select(
        "*",
        F.expr(f"block * {BLOCK} + level").alias("depth"),
        *[
            F.expr(f"key{s}" + "".join(f" ^ if(a{j} is null, 0L, {_hash(s, place(j), f'a{j}', f'b{j}')})" for j in slots)).alias(f"node{s}")
            for s in (1, 2)
        ],
    )
    return nodes.select("*", *[F.expr(f"if(depth = 0, null, node{s} ^ {last(s)})").alias(f"parent{s}") for s in (1, 2)])


def _at_level(name: str, zero: str = "0L") -> str:
    return "case level " + " ".join(f"when {j} then {name}{j}" for j in range(1, BLOCK + 1)) + f" else {zero} end"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node1, node2, conv) as (node1, node2, first, ids): the ids of a node in one batch, comma-joined."""
    for batch in batches:
        out: list[list] = [[], [], [], []]
        now, ids = None, []
        for one, two, conv in zip(*(batch.column(c).to_pylist() for c in ("node1", "node2", "conv"))):
            if (one, two) != now:
                if now is not None:
                    out[3].append(",".join(ids))
                now, ids = (one, two), []
                for values, value in zip(out, (one, two, conv)):
                    values.append(value)
            ids.append(str(conv))
        if now is not None:
            out[3].append(",".join(ids))
        kinds = pa.int64(), pa.int64(), batch.schema.field("conv").type, pa.string()
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], ["node1", "node2", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, read in order; one piece is held at a time."""
    now, digest, out = None, None, []

    def flush():
        one, two, hexes = zip(*out)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(hexes)], ["node1", "node2", "ends_sha256"])

    for batch in batches:
        for one, two, ids in zip(*(batch.column(c).to_pylist() for c in ("node1", "node2", "ids"))):
            if (one, two) != now:
                if now is not None:
                    out.append((*now, digest.hexdigest()))
                now, digest = (one, two), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        if out:
            yield flush()
    if now is not None:
        out.append((*now, digest.hexdigest()))
        yield flush()


def _ends(blocks: DataFrame) -> DataFrame:
    """(node1, node2, ends_sha256) of the nodes at which a conversation ends."""
    last = blocks.groupBy("conv").agg(F.max("block").alias("block"))
    ends = blocks.join(last, ["conv", "block"]).select(*[F.expr(f"key{s} ^ x{s}").alias(f"node{s}") for s in (1, 2)], "conv")
    conv_type = blocks.schema["conv"].dataType.simpleString()
    order = ["node1", "node2", "conv"]
    ends = write_through(ends, "trie-ends")
    pieces = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _pieces, f"node1 long, node2 long, first {conv_type}, ids string"
    )
    together = pieces.repartition("node1", "node2").sortWithinPartitions("node1", "node2", "first")
    return together.mapInArrow(_digests, "node1 long, node2 long, ends_sha256 string")


def _with_parents(nodes: DataFrame) -> DataFrame:
    """``nodes`` with their parents' ``conv_id``; a parent of many children doesn't meet them in one task."""
    parents = nodes.where("n_children > 0").select(
        F.col("node1").alias("parent1"), F.col("node2").alias("parent2"), F.col("conv_id").alias("parent_conv_id"), "n_children"
    )
    key = ["parent1", "parent2"]
    large = parents.where(F.col("n_children") >= MANY).drop("n_children")
    tried = nodes.join(broadcast_if_small(large, BROADCAST_BYTES), key, "left")
    rest = tried.where("parent_conv_id is null").drop("parent_conv_id")
    return tried.where("parent_conv_id is not null").unionByName(
        rest.join(parents.where(F.col("n_children") < MANY).drop("n_children"), key, "left").select(*tried.columns)
    )


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes of the trie of numbered ``turns`` (see ``number_turns``); ``convs`` (conv) may have turnless ones.

    Columns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` (bytes of texts that members share beyond the first, over the subtree),
    ``ends_sha256`` and the node's two-part key ``node1``, ``node2``.
    """
    slots = range(1, BLOCK + 1)
    blocks = _blocks(turns, convs)
    figures = "min(conv) AS conv_id, count(*) AS n_convs, " + ", ".join(f"max(bytes{j}) AS bytes{j}" for j in slots)
    nodes = _rolled(blocks, figures).select(
        "depth", "node1", "node2", "parent1", "parent2", "conv_id", "n_convs",
        F.expr(f"(n_convs - 1) * {_at_level('bytes')}").alias("value"),
    )
    nodes = write_through(nodes, "trie-nodes")
    children = nodes.where("depth > 0").groupBy("parent1", "parent2").agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children.toDF("node1", "node2", "n_children"), ["node1", "node2"], "left").fillna(0, ["n_children"])
    nodes = write_through(nodes, "trie-children")

    owned = nodes.where("depth > 0").select(
        F.col("conv_id").alias("conv"), F.expr(f"(depth - 1) div {BLOCK}").alias("block"), F.expr(f"(depth - 1) % {BLOCK}").alias("slot"),
        "value", (F.col("n_children") == 0).cast("long").alias("leaf"),
    )
    owned = owned.groupBy("conv", "block").agg(
        F.sum("value").alias("total"), F.sum("leaf").alias("leaf"),
        *[F.coalesce(F.sum(F.when(F.col("slot") >= j - 1, F.col("value"))), F.lit(0)).alias(f"from{j}") for j in slots],
    )
    own = ["total", "leaf", *[f"from{j}" for j in slots]]
    valued = blocks.drop("x1", "x2", "filled", *[f"bytes{j}" for j in slots]).join(owned, ["conv", "block"], "left").fillna(0, own)
    valued = _carried(write_through(valued, "trie-valued"), {"total": "sum", "leaf": "sum"}, backward=True)
    valued = valued.where("total + total_far + leaf + leaf_far > 0")
    sums = "sum(leaf + leaf_far) AS n_leaves, " + ", ".join(f"sum(from{j} + total_far) AS saved{j}" for j in slots)
    subtree = _rolled(valued, sums).select("node1", "node2", "n_leaves", F.expr(_at_level("saved", "saved1")).alias("saved_tokens"))

    found = _with_parents(nodes).join(subtree, ["node1", "node2"], "left").join(_ends(blocks), ["node1", "node2"], "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        F.when(F.col("n_children") == 0, F.lit(1).cast("long")).otherwise(F.col("n_leaves")).alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0).cast("long")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        "node1", "node2",
    )


def prefix_trie(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """The trie of all prefixes of the conversations in ``turns``."""
    numbered, lengths = number_turns(turns, conv, turn, role, text)
    return trie(numbered, lengths.select("conv"))


def rebuilt(turns: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The contract's conversations: the first h turns of every fifth one, then the own turns after the first h."""
    heads = lengths.select(
        "conv", "n", (F.crc32(F.col("conv").cast("string").cast("binary")) % 9).alias("h"), (F.col("conv") - F.col("conv") % 5).alias("base")
    )
    heads = heads.join(lengths.select(F.col("conv").alias("base"), F.col("n").alias("n_base")), "base", "left")
    heads = write_through(heads.withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0)))), "trie-heads")
    ids = "id1", "id2", "bytes"
    copies = heads.withColumn("part", F.explode(F.expr(f"sequence(0L, n div {PART})")))
    own = (
        turns.withColumn("part", F.expr(f"pos div {PART}"))
        .join(copies.select("conv", "part", "h", "taken"), ["conv", "part"])
        .where("pos > h")
        .select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), *ids)
    )
    first = turns.where("pos <= 8 and conv % 5 = 0").select(F.col("conv").alias("base"), "pos", *ids)
    borrowed = heads.select("conv", "base", "h").join(first, "base").where("pos <= h").select("conv", "pos", *ids)
    return write_through(own.unionByName(borrowed), "trie-rebuilt"), heads.select("conv")


def op11_prefix_trie(spark, sf_dir):
    """Every node of the trie of the rebuilt conversations."""
    turns, lengths = number_turns(table(spark, sf_dir, "conversations"))
    return trie(*rebuilt(turns, lengths)).drop("node1", "node2")


ORACLE = f"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos,
         md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
         strlen(coalesce(text, ''))::BIGINT AS bytes
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, count(*) AS n FROM t GROUP BY c),
h AS (
  SELECT n.c, n.c - n.c % 5 AS base, {sql_crc32('n.c')} % 9 AS h, coalesce(b.n, 0) AS n_base
  FROM n LEFT JOIN n b ON b.c = n.c - n.c % 5),
r AS (
  SELECT h.c, t.pos, t.id, t.bytes FROM h JOIN t ON t.c = h.base AND t.pos <= h.h
  UNION ALL
  SELECT h.c, t.pos - h.h + least(h.h, h.n_base), t.id, t.bytes FROM h JOIN t ON t.c = h.c AND t.pos > h.h),
l AS (
  SELECT n.c, coalesce(list(r.id ORDER BY r.pos) FILTER (r.id IS NOT NULL), []) AS ids,
         coalesce(list(r.bytes ORDER BY r.pos) FILTER (r.id IS NOT NULL), []) AS bytes
  FROM n LEFT JOIN r ON r.c = n.c GROUP BY n.c),
p AS (
  SELECT c, depth, CASE WHEN depth = 0 THEN [] ELSE ids[1:depth] END AS prefix, CASE WHEN depth = 0 THEN 0 ELSE bytes[depth] END AS bytes, len(ids) AS n
  FROM (SELECT *, unnest(range(0, len(ids) + 1)) AS depth FROM l)),
nodes AS (
  SELECT prefix, depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS value,
         coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = depth), '') AS ends
  FROM p GROUP BY prefix, depth),
k AS (SELECT prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM nodes WHERE depth > 1 GROUP BY 1
      UNION ALL SELECT [], count(*) FROM nodes WHERE depth = 1),
full_ AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN k USING (prefix)),
up AS (
  SELECT CASE WHEN d = 0 THEN [] ELSE prefix[1:d] END AS prefix, value, n_children = 0 AS leaf
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM full_)),
s AS (SELECT prefix, sum(value) AS saved_tokens, count(*) FILTER (leaf) AS n_leaves FROM up GROUP BY prefix)
SELECT f.conv_id, f.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_ f JOIN s USING (prefix)
LEFT JOIN full_ q ON f.depth > 0 AND q.prefix = CASE WHEN f.depth = 1 THEN [] ELSE f.prefix[1:f.depth - 1] END
"""
