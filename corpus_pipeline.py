"""A training corpus from ``documents``: five stages, each one operator of ``shelfmark.llm``.

Every stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the
next one's ``docs``, so a lost executor costs one stage at most.  The first four return the columns of
``documents``, the last one adds the epoch and the number of tokens of each drawn document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm import decontaminate, langid, line_dedup, mixing, near_dedup
from shelfmark.llm.common import table
from shelfmark.session import write_through

STAGES = [
    ("language_id", langid.stage),
    ("line_dedup", line_dedup.stage),
    ("near_dedup", near_dedup.stage),
    ("decontaminate", decontaminate.stage),
    ("mixing", mixing.stage),
]

#: The language network has no SQL form; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_through(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
