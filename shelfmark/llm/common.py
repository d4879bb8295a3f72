"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BROADCAST_BYTES = 16 * 1024 * 1024
BATCH_BYTES = 4 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no column of that name (in any letter case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(*columns: str) -> list[Column]:
    """Two non-null longs that stand for the values of ``columns`` (nulls included) in joins and groups."""
    return [F.xxhash64(*columns), F.xxhash64(F.lit("second"), *columns)]


def in_fold(column: str, fold: int) -> Column:
    """crc32 of the id as text, modulo 5, is ``fold``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5 == fold


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``; tasks of its session get Arrow batches of at most ``BATCH_BYTES``, or of one row.

    Without it a batch has a number of rows, and a task's memory follows the lengths of its texts.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df
