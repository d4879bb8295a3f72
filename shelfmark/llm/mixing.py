"""Mixing sources to target weights: budgets flow down a domain-language-source tree, leaves give token prefixes.

A node's budget is shared among its children by weight, none getting more than its subtree can give
(tokens times ``max_epochs``); what a child can't take goes to its siblings, and only what a whole subtree
can't take was left at the level above.  For one family this is a water level: children sorted by capacity
over weight, level = the largest (budget - capacities before) / (weights from here on), computed by window
functions over the small table of nodes.

A leaf's epochs are seeded orders of its documents (md5 of seed, epoch and id).  A budget of several epochs
takes whole ones and the longest prefix of the next that fits.  The prefix is found without sorting a leaf:
token sums by (leaf, hash slot) give the one slot that holds the end, and only that slot is ranked.  What a
document needs to know is then one threshold of its leaf, so texts are not shuffled.

Defined cases: a null or empty text has no tokens and is never drawn; null tree columns count as the empty
name; an unlisted child has the level's ``other`` weight; a weight of 0 takes nothing; a null id counts as
the empty id; rows with equal leaf and id are drawn together; an empty table gives an empty one; other
columns pass unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfmark.llm.common import BROADCAST_BYTES, fresh, table
from shelfmark.session import broadcast_if_small, write_through


@dataclass(frozen=True)
class Level:
    """One level of the tree: its name, the expression that names a document's node, weights of the nodes."""

    name: str
    node: str
    weights: dict = field(default_factory=dict)
    other: float = 1.0


DOMAIN = "CASE coalesce(cast(regexp_extract(source, '([0-9]+)$', 1) as int), 0) % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'books' ELSE 'forum' END"
TREE = (
    Level("domain", DOMAIN, {"web": 0.5, "books": 0.3, "forum": 0.2}),
    Level("language", "coalesce(lang, '')", {"en": 0.4, "fr": 0.2, "de": 0.2, "es": 0.2}, 0.05),
    Level("origin", "coalesce(source, '')"),
)
SHARE, MAX_EPOCHS, SEED, SLOT_DIGITS = 0.5, 3, 17, 3


def _weight(level: Level) -> Column:
    known = [F.lit(x) for k, w in level.weights.items() for x in (k, float(w))]
    found = F.element_at(F.create_map(*known), F.col(level.name)) if known else F.lit(None).cast("double")
    return F.coalesce(found, F.lit(float(level.other)))


def allocate(leaves: DataFrame, tree, budget: float) -> DataFrame:
    """The budget of every leaf; ``leaves`` has one column per level and ``capacity``."""
    names = [level.name for level in tree]
    nodes = leaves
    for level in tree:  # a weight of 0 anywhere above shuts the leaf
        nodes = nodes.withColumn("capacity", F.when(_weight(level) > 0, F.col("capacity")).otherwise(0.0))
    given = None
    above: list[str] = []
    for depth, level in enumerate(tree):
        here = names[: depth + 1]
        children = nodes.groupBy(*here).agg(F.sum("capacity").alias("capacity")).withColumn("weight", _weight(level))
        family = children.join(given, above) if above else children.withColumn("budget", F.lit(float(budget)))
        order = Window.partitionBy(*(above or [F.lit(0)])).orderBy(
            F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).asc_nulls_last(), level.name
        )
        open_ = F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0)
        before = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        after = F.sum(open_).over(order.rowsBetween(0, Window.unboundedFollowing))
        levelled = family.withColumn("mark", F.when(after > 0, (F.col("budget") - before) / after))
        water = F.max("mark").over(Window.partitionBy(*(above or [F.lit(0)])))
        given = levelled.withColumn("water", water).select(
            *here, F.least(F.col("capacity"), F.coalesce(F.col("water") * open_, F.lit(0.0))).alias("budget")
        )
        above = here
    return given


def draw(
    docs: DataFrame, tree=TREE, id_col: str = "doc_id", text_col: str = "text",
    share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED,
) -> tuple[DataFrame, str, str]:
    """The drawn rows of ``docs``, one per epoch, and the names of two added columns: epoch and tokens."""
    names = [level.name for level in tree]
    tokens = F.size(F.filter(F.split(F.col(text_col), r"[ \t-\r]+", -1), lambda w: w != "")).cast("long")
    tokens = F.when(F.col(text_col).isNull(), F.lit(0).cast("long")).otherwise(tokens)
    identity = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    sizes = docs.select(*[F.expr(x.node).alias(x.name) for x in tree], identity.alias("id"), tokens.alias("tokens"))
    sizes = write_through(sizes, "mix-sizes")
    leaves = sizes.groupBy(*names).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    leaves = write_through(leaves, "mix-leaves")
    total = (leaves.agg(F.sum("tokens").alias("tokens")).first()["tokens"] or 0) * share
    budgets = allocate(
        leaves.select(*names, (F.col("tokens") * max_epochs).cast("double").alias("capacity")), tree, total
    )
    plan = leaves.join(budgets, names).withColumn("budget", F.floor(F.round("budget", 6)))
    plan = plan.select(
        *names, F.expr("cast(budget div tokens as int)").alias("whole"), (F.col("budget") % F.col("tokens")).alias("rest")
    )
    plan = write_through(plan.where("whole > 0 or rest > 0"), "mix-plan")

    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole"), F.col("id")).cast("binary"))
    open_leaves = broadcast_if_small(plan.where("rest > 0"), BROADCAST_BYTES)
    slot = F.substring("key", 1, SLOT_DIGITS).alias("slot")
    keyed = sizes.join(open_leaves, names).select(*names, "rest", "id", "tokens", key.alias("key")).select("*", slot)
    slots = keyed.groupBy(*names, "rest", "slot").agg(F.sum("tokens").alias("tokens"))
    upto = Window.partitionBy(*names).orderBy("slot")
    ends = slots.withColumn("end", F.sum("tokens").over(upto)).withColumn("before", F.col("end") - F.col("tokens"))
    cut = ends.where("before <= rest and end > rest").groupBy(*names, "rest").agg(
        F.min("slot").alias("slot"), F.min("before").alias("before")
    )
    cut = write_through(cut, "mix-cut")
    at_cut = keyed.join(broadcast_if_small(cut.drop("rest"), BROADCAST_BYTES), [*names, "slot"])
    at_cut = at_cut.groupBy(*names, "rest", "before", "key", "id").agg(F.sum("tokens").alias("tokens"))
    by_key = Window.partitionBy(*names).orderBy("key", "id")
    last = (
        at_cut.withColumn("end", F.col("before") + F.sum("tokens").over(by_key))
        .where("end <= rest")
        .groupBy(*names)
        .agg(F.max(F.struct("key", "id")).alias("last"))
    )
    cut = cut.select(*names, F.col("slot").alias("cut_slot"))
    thresholds = write_through(plan.join(cut, names, "left").join(last, names, "left"), "mix-thresholds")

    # Names of our own beside those of the documents.
    mine = {n: fresh(docs, n) for n in (*names, "whole", "rest", "cut_slot", "last")}
    epoch, count, place = fresh(docs, "epoch"), fresh(docs, "n_tokens"), fresh(docs, "place_in_epoch")
    plans = broadcast_if_small(thresholds.select(*[F.col(n).alias(m) for n, m in mine.items()]), BROADCAST_BYTES)
    marked = docs.withColumns({mine[x.name]: F.expr(x.node) for x in tree}).withColumn(count, tokens)
    whole, ends_at, last_at = F.col(mine["whole"]), F.col(mine["cut_slot"]), F.col(mine["last"])
    own = F.md5(F.concat_ws(":", F.lit(str(seed)), whole, identity).cast("binary"))
    own_slot = F.substring(own, 1, SLOT_DIGITS)
    partly = F.coalesce(
        (own_slot < ends_at) | ((own_slot == ends_at) & (F.struct(own.alias("key"), identity.alias("id")) <= last_at)), F.lit(False)
    )
    joined = marked.where(F.col(count) > 0).join(plans, [mine[n] for n in names])
    drawn = joined.withColumn(place, whole + F.when(partly, 1).otherwise(0))
    drawn = drawn.where(F.col(place) > 0).withColumn(epoch, F.explode(F.sequence(F.lit(0), F.col(place) - 1)))
    return drawn.select(*docs.columns, epoch, count), epoch, count


def op2_mixing(spark, sf_dir):
    """The drawn documents with their leaf, epoch and number of tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    drawn, epoch, count = draw(docs)
    return drawn.select("doc_id", "lang", "source", F.col(epoch).cast("long").alias("epoch"), F.col(count).alias("n_tokens"))


def stage(spark, docs, sf_dir):
    """Pipeline stage: the mixture, with the epoch and the number of tokens of each drawn document."""
    return draw(docs)[0]


def _oracle() -> str:
    names = [x.name for x in TREE]
    weight = {
        x.name: "CASE " + x.name + "".join(f" WHEN '{k}' THEN {float(w)}::DOUBLE" for k, w in x.weights.items())
        + f" ELSE {float(x.other)}::DOUBLE END" if x.weights else f"{float(x.other)}::DOUBLE"
        for x in TREE
    }
    domain = (
        "CASE coalesce(try_cast(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS INT), 0) % 3"
        " WHEN 0 THEN 'web' WHEN 1 THEN 'books' ELSE 'forum' END"
    )
    sql = f"""
WITH sizes AS (
  SELECT doc_id, lang, source, {domain} AS domain, coalesce(lang, '') AS language, coalesce(source, '') AS origin,
         len(list_filter(string_split_regex(coalesce(text, ''), '[ \\t-\\r]+'), lambda w: w <> ''))::BIGINT AS tokens
  FROM documents),
leaves AS (SELECT {', '.join(names)}, sum(tokens)::BIGINT AS tokens FROM sizes GROUP BY ALL HAVING sum(tokens) > 0),
given0 AS (SELECT sum(tokens)::DOUBLE * {SHARE} AS budget FROM leaves)"""
    for depth, name in enumerate(names):
        here, above = ", ".join(names[: depth + 1]), ", ".join(names[:depth])
        by = f"PARTITION BY {above}" if above else ""
        sql += f""",
family{depth + 1} AS (
  SELECT c.*, {weight[name]} AS weight, g.budget
  FROM (SELECT {here}, sum(tokens * {MAX_EPOCHS})::DOUBLE AS capacity FROM leaves GROUP BY ALL) c
  JOIN given{depth} g {f'USING ({above})' if above else 'ON true'}),
marks{depth + 1} AS (
  SELECT *, (budget - coalesce(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS mark
  FROM family{depth + 1} WINDOW w AS ({by} ORDER BY capacity / weight, {name})),
given{depth + 1} AS (
  SELECT {here}, least(capacity, max(mark) OVER ({by}) * weight) AS budget FROM marks{depth + 1})"""
    return sql + f""",
plan AS (
  SELECT l.*, floor(round(g.budget, 6))::BIGINT // l.tokens AS whole, floor(round(g.budget, 6))::BIGINT % l.tokens AS rest
  FROM leaves l JOIN given{len(names)} g USING ({', '.join(names)})),
ranked AS (
  SELECT s.*, p.whole, p.rest,
         sum(s.tokens) OVER (PARTITION BY {', '.join('s.' + n for n in names)}
                             ORDER BY md5('{SEED}:' || p.whole || ':' || s.doc_id), s.doc_id::VARCHAR) AS taken
  FROM sizes s JOIN plan p USING ({', '.join(names)}) WHERE s.tokens > 0)
SELECT doc_id, lang, source, unnest(range(whole + (taken <= rest)::BIGINT))::BIGINT AS epoch, tokens AS n_tokens
FROM ranked WHERE whole + (taken <= rest)::BIGINT > 0
"""


ORACLE = _oracle()
