"""Offers derived from the given tables, in Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of files that make a part of a table of long texts.
PART_BYTES = 8 * 1024 * 1024


def n_parts(rows: DataFrame, part_bytes: int = PART_BYTES) -> int:
    """One part per ``part_bytes`` of the files under ``rows``, and one per core at least."""
    files = rows.select("_metadata.file_path", "_metadata.file_size").distinct()
    size = files.agg(F.sum("file_size").alias("size")).first()["size"] or 0
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-size // part_bytes))


def dealt(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table of long texts, dealt out in parts of bounded size: the given tables are one file, so one task, each."""
    rows = table(spark, sf_dir, name)
    return rows.repartition(n_parts(rows), key)


def _ranked(rows: DataFrame, column: str, rank: str) -> DataFrame:
    """``rows`` with the rank of ``column`` among its distinct values (a short list); null is the last of them.

    The list goes to the rows: by value, a few tasks would get all of them.
    """
    values = rows.select(F.col(column).alias("value")).distinct()
    ranks = values.select("value", F.row_number().over(Window.orderBy(F.col("value").asc_nulls_last())).cast("long").alias(rank))
    return rows.join(F.broadcast(ranks), F.col(column).eqNullSafe(F.col("value"))).drop("value")


def offers_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _ranked(table(spark, sf_dir, "part"), "p_type", "category_id")
    size = F.col("p_size")
    return part.select(
        F.col("p_partkey").alias("row_id"),
        F.col("p_name").alias("title"),
        F.lit(None).cast("string").alias("description"),
        F.when(size % 10 == 0, "-")
        .otherwise(F.concat("p_brand", F.lit(" / "), "p_name"))
        .alias("shop_category_name"),
        F.when(size % 7 == 0, "no brand").otherwise(F.col("p_brand")).alias("vendor_name"),
        F.when(size % 5 != 0, F.round(F.col("p_retailprice") * 10).cast("long").cast("string")).alias(
            "vendor_code"
        ),
        "category_id",
        (F.col("category_id") % 3).alias("department_id"),
    )


def offers_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _ranked(dealt(spark, sf_dir, "documents", "doc_id"), "lang", "department_id")
    return docs.select(
        F.col("doc_id").alias("row_id"),
        F.col("text").alias("title"),
        F.col("text").alias("description"),
        F.when(F.col("doc_id") % 3 != 0, F.concat("lang", F.lit(" / "), "source")).alias(
            "shop_category_name"
        ),
        F.col("source").alias("vendor_name"),
        F.lit(None).cast("string").alias("vendor_code"),
        (100 * F.col("department_id") + F.regexp_extract("source", "([0-9]+)", 1).cast("long")).alias(
            "category_id"
        ),
        "department_id",
    )


def embedding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as labelled rows: category = label, department = label modulo 4.

    Component i gives term 2i its positive part and term 2i + 1 its negative part, scaled to length 1, so
    every term occurs in about half of the rows: the hardest case for the search.
    """
    parts = F.transform(
        "embedding",
        lambda x, i: F.struct(
            F.when(x > 0, 2 * i).otherwise(2 * i + 1).alias("idx"), F.abs(x.cast("double")).alias("w")
        ),
    )
    length = F.sqrt(F.aggregate("vec.w", F.lit(0.0), lambda acc, w: acc + w * w))
    return (
        table(spark, sf_dir, "embeddings")
        .select(
            F.col("vec_id").alias("row_id"),
            F.col("label").cast("long").alias("category_id"),
            (F.col("label") % 4).cast("long").alias("department_id"),
            "embedding",
            F.filter(parts, lambda x: x["w"] > 0).alias("vec"),
        )
        .withColumn("length", length)
        .select(
            "row_id", "category_id", "department_id", "embedding",
            F.col("vec.idx").alias("indices"),
            F.transform("vec.w", lambda w: F.when(F.col("length") > 0, w / F.col("length"))).alias("weights"),
        )
    )


def quarter_scores(embedding: Column) -> Column:
    """Four department scores: the sums of 16 components each."""
    def total(k):
        part = F.slice(embedding, 16 * k + 1, 16)
        return F.aggregate(part, F.lit(0.0), lambda acc, x: acc + x.cast("double"))

    return F.array(*[total(k) for k in range(4)])


# A lexicon for the Latin texts of the tables.
LATIN_UNITS = (
    ("__unit_digits__", r"\d+\s*(the|de|of\b)"),
    ("__unit_inch__", r"\d+\s*(inch|\")"),
)
LATIN_TYPES = (
    ("__type_the__", r"\b(the\b|and\b|this|that)"),
    ("__type_der__", r"\b(der\b|die\b|sch|ver)"),
    ("__type_el__", r"\b(el\b|los\b|las\b|qué|ción)"),
    ("__type_le__", r"\b(le\b|les\b|des\b|et\b)"),
)
LATIN_TOPICS = (
    ("__topic_end__", r"tion\s*\."),
    ("__topic_stop__", r"the of|in the|und der|de la"),
    ("__topic_accent__", r"é[a-z]|ü|ñ"),
    ("__topic_mail__", r"@|http"),
)


def lemma_table(words: DataFrame) -> DataFrame:
    """``word, lemma`` made of all ``words`` (one column): a word of five letters or more loses its last two."""
    return words.toDF("word").where("word != ''").distinct().select(
        "word", F.expr("if(length(word) >= 5, left(word, length(word) - 2), word)").alias("lemma")
    )


def left_out(word: Column) -> Column:
    """A fifth of the words, by their length and first character."""
    return (F.length(word) + F.ascii(word)) % 5 == 0
