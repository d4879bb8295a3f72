import pytest
from pyspark.sql import functions as F

from shelfmark.session import new_table_path
from shelfmark.sources import offers

HEADER = "title\tdescription\tshop_category_name\tvendor_name\tvendor_code\tcategory_id\tdepartment_id\n"


def test_quoted_fields_and_missing_values(spark, tmp_path):
    (tmp_path / "train.tsv").write_text(
        HEADER + '"a ""quoted"" title"\t"tab\there\nnew line"\tNA\tn/a\t007\t5\t1\n' + 'b\t\tnan\tNone\t<NA>\t6\t\n',
        encoding="utf-8",
    )
    a, b = offers.read_offers(spark, str(tmp_path / "train.tsv")).orderBy("row_id").collect()
    assert (a["row_id"], a["title"], a["description"], a["vendor_code"]) == (0, 'a "quoted" title', "tab\there\nnew line", "007")
    assert a["shop_category_name"] is None and a["vendor_name"] is None
    assert (b["row_id"], b["category_id"], b["department_id"], b["description"]) == (1, 6, None, None)


def test_row_ids_follow_files_and_positions(spark, tmp_path):
    sizes = [3, 40, 1, 17]
    for i, n in enumerate(sizes):
        lines = "".join(f"f{i}r{j}\t{'x' * (50 * i)}\t\t\t\t1\t1\n" for j in range(n))
        (tmp_path / f"part-{i}.tsv").write_text(HEADER + lines)
    got = offers.read_offers(spark, str(tmp_path)).orderBy("row_id").collect()
    assert [r["row_id"] for r in got] == list(range(sum(sizes)))
    assert [r["title"] for r in got] == [f"f{i}r{j}" for i, n in enumerate(sizes) for j in range(n)]


def test_unlabelled_offers(spark, tmp_path):
    (tmp_path / "test.tsv").write_text("title\tdescription\tshop_category_name\tvendor_name\tvendor_code\nt\td\ts\tv\tc\n")
    row = offers.read_offers(spark, str(tmp_path / "test.tsv"), labels=False).first()
    assert row.asDict() == {"row_id": 0, "title": "t", "description": "d", "shop_category_name": "s",
                            "vendor_name": "v", "vendor_code": "c"}


def test_predictions_are_written_in_input_order(spark):
    rows = spark.range(500).select(
        F.col("id").alias("row_id"), (F.col("id") * 7).alias("category_id"), (F.col("id") % 5).alias("department_id")
    ).orderBy(F.rand(3))
    path = new_table_path(spark, "predictions")
    offers.write_predictions(rows, path)
    from pathlib import Path
    lines = []
    for part in sorted(Path(path.replace("file:", "")).glob("part-*.csv")):
        head, *body = part.read_text().splitlines()
        assert head == "category_id,department_id"
        lines += body
    assert lines == [f"{i * 7},{i % 5}" for i in range(500)]
    keyed = new_table_path(spark, "keyed")
    offers.write_keyed_predictions(rows, keyed)
    assert spark.read.parquet(keyed).count() == 500


def test_order_needs_no_sampling(spark):
    """Stretches of row numbers are partitions; gaps and a missing number don't matter."""
    rows = spark.range(0, 1000, 3).select(F.col("id").alias("row_id"), F.lit(1).alias("category_id")).orderBy(F.rand(5))
    ordered = offers._in_order(rows, most=100)
    assert "rangepartitioning" not in ordered._jdf.queryExecution().executedPlan().toString().split("Sort [row_id")[0]
    parts = [[r["row_id"] for r in p] for p in ordered.select("row_id").rdd.glom().collect()]
    assert [x for p in parts for x in p] == list(range(0, 1000, 3)) and len(parts) == 10
    assert offers._in_order(rows.where("false")).count() == 0


def test_columns_are_taken_by_name(spark, tmp_path):
    """Another order, a column more, and vendor codes that look like numbers."""
    (tmp_path / "a.tsv").write_text("extra\tdepartment_id\ttitle\tvendor_code\tcategory_id\tdescription\tvendor_name\tshop_category_name\n"
                                    "x\t2\tt\t007\t9\td\tv\ts\n")
    row = offers.read_offers(spark, str(tmp_path / "a.tsv")).first()
    assert row.asDict() == {"row_id": 0, "title": "t", "description": "d", "shop_category_name": "s", "vendor_name": "v",
                            "vendor_code": "007", "category_id": 9, "department_id": 2}


def test_missing_columns_and_different_headers_are_refused(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("title\tdescription\nx\ty\n")
    with pytest.raises(ValueError, match="shop_category_name"):
        offers.read_offers(spark, str(tmp_path / "a.tsv"))
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "a.tsv").write_text(HEADER + "a\t\t\t\t\t1\t1\n")
    (tmp_path / "two" / "b.tsv").write_text(HEADER.replace("title\tdescription", "description\ttitle") + "a\t\t\t\t\t1\t1\n")
    with pytest.raises(Exception, match="header"):
        offers.read_offers(spark, str(tmp_path / "two")).collect()


def test_files_are_ordered_by_number(spark, tmp_path):
    for n in (99998, 99999, 100000, 100001):
        (tmp_path / f"part-{n}-x.tsv").write_text(HEADER + f"f{n}\t\t\t\t\t1\t1\n")
    got = offers.read_offers(spark, str(tmp_path)).orderBy("row_id").collect()
    assert [r["title"] for r in got] == ["f99998", "f99999", "f100000", "f100001"]


def test_files_are_split_without_line_breaks_in_fields(spark, tmp_path):
    (tmp_path / "a.tsv").write_text(HEADER + "".join(f"r{i}\t{'x' * 200}\t\t\t\t1\t1\n" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        got = offers.read_offers(spark, str(tmp_path), multi_line=False)
        titles = [r["title"] for r in got.orderBy("row_id").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert titles == [f"r{i}" for i in range(3000)]
