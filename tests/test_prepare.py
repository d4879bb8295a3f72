import hashlib
import math

from pyspark.sql import functions as F

from shelfmark.operators import prepare

SCHEMA = ("row_id long, title string, description string, shop_category_name string, vendor_name string, "
          "vendor_code string, category_id long, department_id long")


def test_duplicates_keep_the_first_row(spark):
    rows = [
        (5, "a", None, "s", "late", None, 1, 1), (2, "a", None, "s", "first", "x", 1, 1), (9, "a", "", "s", "v", None, 1, 1),
        (4, "a", None, None, "v", None, 1, 1), (3, "a", "s", None, "v", None, 1, 1), (7, "a", None, "s", "v", None, None, 1),
    ]
    got = prepare.drop_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert sorted((r["row_id"], r["vendor_name"]) for r in got.collect()) == [
        (2, "first"), (3, "v"), (4, "v"), (7, "v"), (9, "v"),
    ]
    assert got.columns == [c.split()[0] for c in SCHEMA.split(", ")]


def draw(i):
    return hashlib.md5(f"42:{i}".encode()).hexdigest()


def test_split_matches_sorting_by_hash(spark):
    # One class holds two thirds of the rows, one has three, one has no label.
    label = {i: 1 if i % 3 else (2 if i % 2 else 3) for i in range(5000)}
    label.update({5000: 7, 5001: 7, 5002: 7, 5003: None, 5004: None})
    rows = spark.createDataFrame(list(label.items()), "row_id long, department_id long")
    got = {r["row_id"]: r["held_out"] for r in prepare.stratified_flag(rows).collect()}
    want = {}
    for d in set(label.values()):
        ids = sorted((i for i in label if label[i] == d), key=draw)
        take = math.floor(len(ids) * 0.15 + 0.5)
        want.update({i: k < take for k, i in enumerate(ids)})
    assert got == want


def test_split_with_shares_at_the_ends(spark):
    rows = spark.range(50).select(F.col("id").alias("row_id"), (F.col("id") % 2).alias("department_id"))
    assert prepare.stratified_flag(rows, 0.0).where("held_out").count() == 0
    assert prepare.stratified_flag(rows, 1.0).where("held_out").count() == 50


def test_known_categories(spark):
    rows = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "row_id long, category_id long")
    train = spark.createDataFrame([(1,), (1,), (None,)], "category_id long")
    assert [r["row_id"] for r in prepare.known_categories(rows, train).collect()] == [1]
