"""Rows with every awkward case, for all operators on documents."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names operators use inside.
EXTRA = "row long, row1 long, id string, key string, place int, epoch string, n_removed int, domain string, n_tokens int"


def awkward(seed=3):
    """Null ids and texts, empty and very long texts, repeated rows, copies and near copies, null labels."""
    rng = random.Random(seed)
    words = ["the", "of", "and", "Straße", "ção", "naïve", "x1", "Zebra", "über", "été", "😀", "mañana", "12", "a-b"]
    text = lambda n: " ".join(rng.choice(words) + (rng.choice("abc") * rng.randrange(3)) for _ in range(n))
    base = text(80)
    rows = [(i, text(rng.randrange(1, 60)), rng.choice(["en", "de"]), f"s{i % 12}", 5) for i in range(25)]
    rows += [
        (100, base, "en", "s1", 1), (101, base, "en", "s2", 1), (102, base + " tail", "de", "s2", None),
        (103, None, "en", "s3", None), (104, "", "en", None, 0), (105, " \t\n ", None, "s3", 3),
        (None, base, "en", "s1", 1), (None, None, None, None, None), (106, "one two", "fr", "s4", 7),
        (106, "one two", "fr", "s4", 7), (107, "ONE TWO", "fr", "s5", 7), (108, "\n".join([text(30)] * 3), "en", "s1", 0),
        (109, text(20_000), "en", "s1", 9), (110, "w" * 30_000, "de", "s2", 9), (111, "!!! ...", "en", "s1", 3),
    ]
    return rows


def frame(spark, rows, extra=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        for part in EXTRA.split(", "):
            name, kind = part.split()
            df = df.withColumn(name, F.lit("7").cast(kind))
    return df


def plain(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, str(x)) for x in r))
