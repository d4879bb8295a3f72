"""Connected components of a link table, with the smallest id as the name of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfmark.session import write_through


def _nearest(edges: DataFrame) -> DataFrame:
    """Edges seen from both ends, each with the smallest id around its first end (the end itself included)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    return both.join(least, "a")


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b); component is the smallest id that can be reached.

    Every round hangs larger neighbours on the smallest id around (large star), then smaller ones (small
    star), until each id hangs on its component's smallest.  Both steps are a minimum by id and a join back;
    no neighbourhood is gathered.  Rounds are written, so a lost executor costs one round at most.
    """
    edges = write_through(
        links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    state = None
    while True:
        large = _nearest(edges).where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        small = _down(large.where("a != b"))
        edges = write_through(small, "links")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state or not now[0]:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
            )
        state = now


def _down(edges: DataFrame) -> DataFrame:
    """Small star: an id and its smaller neighbours hang on the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    hung = edges.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return hung.unionByName(least.select("a", F.col("least").alias("b"))).where("a != b").distinct()
