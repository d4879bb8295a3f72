"""Exact-match rules: keys that point to one category only, and their lookup.

All category rules live in one long table ``kind, key, category_id``.  The keys
of a row are exploded, so learning is one scan and one aggregation (minimum and
maximum category of a key, combined on the map side) and applying is one join,
whatever the number of rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.functions.text import rule_key, strip

# Later kinds override earlier ones.
TITLE_SHOP_CATEGORY = 0
TITLE_VENDOR = 1
SHOP_CATEGORY = 2
VENDOR_CODE = 3
KINDS = (TITLE_SHOP_CATEGORY, TITLE_VENDOR, SHOP_CATEGORY, VENDOR_CODE)


def usable_shop_category(c: Column) -> Column:
    return c.isNotNull() & ~strip(c).isin("", "-")


def _key(kind: int) -> Column:
    """The key of a row for one kind of rule; NULL where the row has none."""
    if kind == TITLE_SHOP_CATEGORY:
        return rule_key(F.col("title"), F.col("shop_category_name"))
    if kind == TITLE_VENDOR:
        return rule_key(F.col("title"), F.col("vendor_name"))
    if kind == SHOP_CATEGORY:
        scn = F.col("shop_category_name")
        return F.when(usable_shop_category(scn), scn)
    return F.col("vendor_code")


def _keys(offers: DataFrame, kinds, *keep: str) -> DataFrame:
    found = F.array(*[F.struct(F.lit(k).alias("kind"), _key(k).alias("key")) for k in kinds])
    return (
        offers.select(*keep, F.explode(found).alias("x"))
        .where(F.col("x.key").isNotNull())
        .select(*keep, F.col("x.kind").alias("kind"), F.col("x.key").alias("key"))
    )


def unanimous(rows: DataFrame, key: list[str], label: str) -> DataFrame:
    """Keys whose rows carry one distinct non-null ``label``."""
    return (
        rows.groupBy(*key)
        .agg(F.min(label).alias(label), F.max(label).alias("other"))
        .where(F.col(label) == F.col("other"))
        .drop("other")
    )


def category_rules(train: DataFrame, kinds=KINDS) -> DataFrame:
    """``kind, key, category_id``."""
    return unanimous(_keys(train, kinds, "category_id"), ["kind", "key"], "category_id")


def single_rule(train: DataFrame, kind: int) -> DataFrame:
    """``key, category_id`` for one kind of rule."""
    return category_rules(train, (kind,)).drop("kind")


def shop_category_departments(train: DataFrame) -> DataFrame:
    """``key, department_id``: shop categories of one department."""
    keys = _keys(train, (SHOP_CATEGORY,), "department_id")
    return unanimous(keys, ["key"], "department_id")


def category_departments(train: DataFrame) -> DataFrame:
    """``category_id, department_id``: the first non-null department in row order."""
    return (
        train.where(F.col("category_id").isNotNull() & F.col("department_id").isNotNull())
        .groupBy("category_id")
        .agg(F.min_by("department_id", "row_id").alias("department_id"))
    )


def modal_category(train: DataFrame) -> DataFrame:
    """One row: the most frequent category, the lowest id on ties."""
    return (
        train.where(F.col("category_id").isNotNull())
        .groupBy("category_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "category_id")
        .limit(1)
    )


def apply_rules(offers: DataFrame, rules: DataFrame) -> DataFrame:
    """``row_id, rule_category`` for every offer; NULL where no rule covers it.

    Every offer has its two title keys, so none is lost.  The rule side of the
    join has one row per key; a key held by a large share of the offers makes
    one long partition on the offer side only, which adaptive execution splits.
    """
    hits = _keys(offers, KINDS, "row_id").join(rules, ["kind", "key"], "left")
    return hits.groupBy("row_id").agg(
        F.max_by("category_id", F.when(F.col("category_id").isNotNull(), F.col("kind"))).alias(
            "rule_category"
        )
    )


def coverage(applied: DataFrame) -> DataFrame:
    """One row: offers, covered offers and their share."""
    return applied.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("rule_category").alias("n_covered"),
        F.avg(F.col("rule_category").isNotNull().cast("double")).alias("share"),
    )
