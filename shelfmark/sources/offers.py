"""Reading and writing offers as tab-separated files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from shelfmark.functions.text import null_if_missing
from shelfmark.session import broadcast_if_small, write_through
from shelfmark.sources.quoted import read_records

TEXT_COLUMNS = ["title", "description", "shop_category_name", "vendor_name", "vendor_code"]
LABEL_COLUMNS = ["category_id", "department_id"]
#: Rows of a written file, as long as there are no more files than this.
ROWS_OF_FILE, MOST_FILES = 1_000_000, 100_000


def _schema(labels: bool) -> T.StructType:
    names = TEXT_COLUMNS + (LABEL_COLUMNS if labels else [])
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_offers(
    spark: SparkSession, path: str, labels: bool = True, columns=None, multi_line: bool = True
) -> DataFrame:
    """Offers with ``row_id`` in input order: files by path, numbers in names by value, rows by position.

    Columns are taken by name from the header, further columns are ignored;
    files whose headers differ are refused.  Vendor codes stay strings, so a
    code such as ``007`` keeps its zeros.  Quoted fields may hold tabs, line
    breaks and doubled quotes.  Files are split in any case; with
    ``multi_line=False`` (no field has a line break) they are read once instead
    of twice and without Python.
    """
    wanted = _schema(labels).names if columns is None else list(columns)
    reader = (
        spark.read.option("sep", "\t")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
    )
    header = reader.csv(path).columns  # the first file's; every other file is held against it when it is read
    missing = [n for n in wanted if n not in header]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)} in the header {header}")
    if multi_line:
        rows = _multi_line(spark, path, header, wanted)
    else:
        schema = T.StructType([T.StructField(n, T.StringType()) for n in header])
        rows = reader.schema(schema).option("enforceSchema", False).csv(path).select(
            *[null_if_missing(F.col(n)).alias(n) for n in wanted],
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("at"),
        )
    for name in LABEL_COLUMNS:
        if name in wanted:
            rows = rows.withColumn(name, F.col(name).cast("double").cast("long"))
    return with_row_id(rows, ["file", "block"], "at").select("row_id", *wanted)


def _multi_line(spark: SparkSession, path: str, header: list[str], wanted: list[str]) -> DataFrame:
    """The records without the headers; ``at`` is their number in the range they begin in."""
    records = read_records(spark, path, len(header))
    same = F.col("fields") == F.array(*[F.lit(n) for n in header])
    differs = F.raise_error(F.concat(F.lit("another header in "), F.col("file"))).cast("boolean")
    is_record = F.when((F.col("block") > 0) | (F.col("k") > 0), True).otherwise(F.when(same, False).otherwise(differs))
    return records.where(is_record).select(
        *[null_if_missing(F.col("fields")[header.index(n)]).alias(n) for n in wanted], "file", "block", F.col("k").alias("at")
    )


def _file_order() -> list[Column]:
    """Files by path, with the numbers in it compared as numbers: part-99999 comes before part-100000."""
    padded = F.regexp_replace(F.regexp_replace("file", "([0-9]+)", "0000000000000000000$1"), "0*([0-9]{20})(?![0-9])", "$1")
    return [padded, F.col("file")]


def with_row_id(rows: DataFrame, origin: list[str], at: str) -> DataFrame:
    """Number rows 0, 1, 2, ... by ``origin`` (``file``, then block), then by ``at`` within it.

    ``at`` must be ``monotonically_increasing_id`` taken on the scan, so that it has no gaps
    within one origin.  Only one row per origin is put in order and numbered;
    the rows themselves are not moved.
    """
    starts = (
        rows.groupBy(*origin)
        .agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.sum("n").over(Window.orderBy(*_file_order(), *origin[1:])) - F.col("n"))
        .drop("n")
    )
    starts = broadcast_if_small(write_through(starts, "split-starts"))  # one row per input split
    return (
        rows.join(starts, origin)
        .withColumn("row_id", F.col(at) - F.col("first") + F.col("before"))
        .drop("first", "before")
    )


def write_offers(offers: DataFrame, path: str) -> None:
    """Write offers as tab-separated files with a header, in ``row_id`` order."""
    _in_order(offers).drop("row_id").write.option("sep", "\t").option("header", True).option(
        "quote", '"'
    ).option("escape", '"').csv(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Write ``category_id, department_id`` as CSV files whose names follow the input order."""
    answers = write_through(predictions.select("row_id", *LABEL_COLUMNS), "predictions")
    _in_order(answers).select(*LABEL_COLUMNS).write.option("header", True).csv(path)


def write_keyed_predictions(predictions: DataFrame, path: str) -> None:
    """Write ``row_id, category_id, department_id`` as parquet."""
    predictions.select("row_id", *LABEL_COLUMNS).write.parquet(path)


def _in_order(rows: DataFrame, most: int = ROWS_OF_FILE) -> DataFrame:
    """``rows`` in ``row_id`` order: a partition is a stretch of the numbers, so nothing has to be sampled to cut them.

    Numbers start at 0 and are dense where they come from a reader; where they are not, some stretches are short.
    """
    last = rows.agg(F.max("row_id").alias("last")).first()["last"] or 0
    cores = rows.sparkSession.sparkContext.defaultParallelism
    stretch = max(min(most, -(-(last + 1) // cores)), -(-(last + 1) // MOST_FILES), 1)
    number = F.expr(f"cast(row_id div {stretch} as int)")
    return rows.repartitionById(last // stretch + 1, number).sortWithinPartitions("row_id")
