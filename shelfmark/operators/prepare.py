"""De-duplication, the stratified hold-out and the known-category filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfmark.session import broadcast_if_small, write_through

# Rows equal in these fields are copies.
DUPLICATE_KEY = ["title", "description", "shop_category_name", "category_id", "department_id"]
# Rows are first placed by the leading hex digits of their hash; only the rows of
# one such slot per class are ever sorted.
SLOT_DIGITS = 4


def drop_duplicates(offers: DataFrame, key=DUPLICATE_KEY) -> DataFrame:
    """Keep the lowest ``row_id`` of equal rows; NULLs are equal to each other.

    Only ``row_id`` and a digest of the key are grouped; the rows that stay are
    found by ``row_id``, which must be unique.
    """
    # NULL fields are left out of the JSON text, which keeps NULL apart from "".
    digest = F.sha2(F.to_json(F.struct(*key)), 256)
    first = offers.groupBy(digest.alias("digest")).agg(F.min("row_id").alias("row_id"))
    return offers.join(first.select("row_id"), "row_id", "left_semi")


def known_categories(rows: DataFrame, train: DataFrame) -> DataFrame:
    """Rows whose category occurs in ``train``."""
    return rows.join(train.select("category_id").distinct(), "category_id", "left_semi")


def _draw(seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col("row_id").cast("string")))


def stratified_flag(
    rows: DataFrame, share: float = 0.15, seed: int = 42, by: str = "department_id"
) -> DataFrame:
    """``rows`` with ``held_out``: in each class the rows with the lowest hashes, ``share`` of them.

    The cut is found from counts by class and hash slot (pre-aggregated); only
    the slot that holds the cut is ranked, so no class is sorted as a whole.
    """
    drawn = rows.withColumn("draw", _draw(seed)).withColumn(
        "slot", F.substring("draw", 1, SLOT_DIGITS)
    )
    in_order = Window.partitionBy(by).orderBy("slot")
    slots = (
        drawn.groupBy(by, "slot")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.sum("n").over(in_order) - F.col("n"))
        .withColumn("take", F.floor(F.sum("n").over(Window.partitionBy(by)) * F.lit(share) + 0.5))
    )
    # The first slot that is not taken whole, with the number of rows taken from it.
    cuts = (
        slots.where(F.col("before") + F.col("n") > F.col("take"))
        .groupBy(by)
        .agg(
            F.min("slot").alias("cut"),
            F.min_by(F.col("take") - F.col("before"), "slot").alias("rest"),
        )
    )
    # One row per value of ``by``; broadcast when that is few enough.
    cuts = broadcast_if_small(write_through(cuts.withColumnRenamed(by, "class"), "cuts"))
    placed = drawn.join(cuts, F.col(by).eqNullSafe(F.col("class")), "left")
    # The last hash that is held out of the slot with the cut: only rows of that slot are ranked.
    at_cut = Window.partitionBy(by).orderBy("draw", "row_id")
    last = (
        placed.where(F.col("slot") == F.col("cut"))
        .select(by, "draw", "row_id", "rest", F.row_number().over(at_cut).alias("rank"))
        .where(F.col("rank") == F.col("rest"))
        .select(F.col(by).alias("of"), F.struct("draw", "row_id").alias("last"))
    )
    marked = placed.join(broadcast_if_small(write_through(last, "last-held-out")), F.col(by).eqNullSafe(F.col("of")), "left")
    inside = F.col("last").isNotNull() & (F.struct("draw", "row_id") <= F.col("last"))
    held_out = (
        F.when(F.col("cut").isNull() | (F.col("slot") < F.col("cut")), True)
        .when(F.col("slot") == F.col("cut"), inside)
        .otherwise(False)
    )
    return marked.withColumn("held_out", held_out).select(*rows.columns, "held_out")


def split_counts(flagged: DataFrame) -> DataFrame:
    """Rows and distinct labels on both sides of the hold-out."""
    return flagged.groupBy("held_out").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("department_id").alias("n_departments"),
        F.count_distinct("category_id").alias("n_categories"),
    )


def label_lists(rows: DataFrame) -> DataFrame:
    """``kind, id, n``: the distinct departments and categories with their rows, in order of id."""
    labels = F.array(
        *[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_id").alias("id")) for k in ("department", "category")]
    )
    return (
        rows.select(F.explode(labels).alias("x"))
        .where(F.col("x.id").isNotNull())
        .groupBy("x.kind", "x.id")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("kind", "id")
    )
