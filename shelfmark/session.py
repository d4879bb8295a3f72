"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import os
import uuid
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

BROADCAST_LIMIT = 64 * 1024 * 1024
BATCH_BYTES = 4 * 1024 * 1024


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and the bench; on a cluster the submitter makes the session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("shelfmark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", os.environ.get("SHELFMARK_CHECKPOINTS", "/tmp/checkpoints"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which the driver and all executors must share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder the driver and all executors share")
    return folder.rstrip("/")


def application_folder(spark: SparkSession) -> str:
    """Where the tables of this application lie."""
    return f"{shared_folder(spark)}/shelfmark-{spark.sparkContext.applicationId}"


def remove_tables(spark: SparkSession) -> None:
    """Remove all tables this application has written through; call it when its results are saved."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(application_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{application_folder(spark)}/{name}-{uuid.uuid4().hex}"


def write_through(df: DataFrame, name: str, schema=None, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where a result feeds several jobs: the lineage ends in files that
    survive lost executors, and later reads prune columns and know their size.
    """
    spark = df.sparkSession
    path = new_table_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    reader = spark.read.schema(schema or df.schema)
    return reader.parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove the files of a table that ``write_through`` gave, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.rsplit("/", 2)[-2] != application_folder(spark).rsplit("/", 1)[-1]:
            raise ValueError(f"{folder} isn't a table of this application")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``; tasks of its session get Arrow batches of at most ``BATCH_BYTES``, or of one row.

    Without it a batch has a number of rows, and a task's memory follows their lengths.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def _content(value: Column, kind: T.DataType) -> Column:
    """Bytes of a value: the content of strings, binaries, arrays, maps and structs, 16 for anything else."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + F.lit(16)
    if isinstance(kind, T.StructType):
        return reduce(add, [_content(value[f.name], f.dataType) for f in kind.fields], F.lit(16).cast("long"))
    if isinstance(kind, T.MapType):
        return _content(F.map_keys(value), T.ArrayType(kind.keyType)) + _content(F.map_values(value), T.ArrayType(kind.valueType))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.StructType, T.MapType, T.ArrayType)):
            inside = F.aggregate(value, F.lit(0).cast("long"), lambda n, x: n + _content(x, kind.elementType))
        else:
            inside = F.size(value).cast("long") * F.lit(16)
        return F.lit(16).cast("long") + F.greatest(F.coalesce(inside, F.lit(0).cast("long")), F.lit(0).cast("long"))
    return F.lit(16).cast("long")


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Mark a written table for broadcast when its measured content is below ``limit`` bytes.

    Larger tables are returned as they are and join through a shuffle.  Call it
    on written tables only: the measurement reads ``df`` once.
    """
    return F.broadcast(df) if is_small(df, limit) else df


def is_small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> bool:
    """Whether the content of a written table is at most ``limit`` bytes."""
    width = reduce(add, [_content(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields], F.lit(16).cast("long"))
    size = df.agg(F.sum(width).alias("bytes")).first()["bytes"] or 0
    return size <= limit
